"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import exact_dedup, language_id, mixing, ngram_join, packing, ppm, quality_rules, token_counts, token_shards, url_filter

#: host, path, verdict; fixed by the contract.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: Names of files among the public tokenizers; where they lie is asked of that package.
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer(WORD_TOKENIZER), capacity=2048)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.training_fold(F.col("doc_id"), 3) == 1)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer(BYTE_TOKENIZER), limit=512)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_shards.write_shards(_table(spark, sf_dir, "documents"), tokenizer(BYTE_TOKENIZER), key="training order")
    return rows.drop("file")  # its folder has another name in every run


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"), language_id.training_fold(F.col("doc_id"), 7) == 2)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ngram_join.near_components(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return placed.select("doc_id", "n_shingles", "component_id")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(mixing.document_sizes(_table(spark, sf_dir, "documents")))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pack_documents": op2_pack_documents,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_shards": op6_token_shards,
    "op7_lm_score": op7_lm_score,
    "op8_ngram_join": op8_ngram_join,
    "op9_mix_sources": op9_mix_sources,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, text_sha256
        from d window g as (partition by text_sha256)""",
    "op9_mix_sources": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight,
                     source_size * 2.0::double as most from s),
        l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(most) over (
                  order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0::double))
                  / sum(weight) over (order by most / weight, source is null, source rows between current row and unbounded following) as level from w),
        f as (select min(struct_pack(a := most / weight, b := source is null, c := coalesce(source, ''), level := level)) filter (most >= level * weight) as final from l),
        t as (select source, source_size, coalesce(least(most, final.level * weight), most) as target from l, f),
        e as (select d.doc_id, d.size, t.source_size, t.target, d.key,
                     case when t.source_size > 0 then floor(t.target)::bigint // t.source_size else 0 end as epochs,
                     sum(d.size) over (partition by d.source order by d.key, d.doc_id rows unbounded preceding) - d.size as before
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
        from e""",
    "op10_url_filter": r"""
        with r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        u as (select page_id, row_number() over () as n,
                     translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
        f as (select u.n, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as best
              from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.n)
        select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from u left join f using (n)""",
}
