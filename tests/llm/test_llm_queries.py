"""The registered queries and the pipeline on the smallest tables and on odd rows, against SQL or brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_llm_small import base, prose, slow_components, slow_mix

from tastemill.llm import language_id, queries, token_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def encoder(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, str(DATA)).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, str(DATA)).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(want.column_names)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda t: sorted((tuple(value(r[c]) for c in columns) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


def test_packing(spark, documents):
    encode, by_doc, by_sequence = encoder("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in run(spark, "op2_pack_documents"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for i, d in documents.items():
        ids = [*encode(d["text"]), 0]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in own] == list(enumerate(range(0, len(ids), 2048)))
        for r in own:
            part = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for own in by_sequence.values():
        ends = np.cumsum([0, *[r["length"] for r in sorted(own, key=lambda r: r["offset"])]])
        assert sorted(r["offset"] for r in own) == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_language(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op3_language_id")}
    assert set(got) == set(documents)
    known = {d["lang"] for i, d in documents.items() if d["lang"] and zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1 for i, r in got.items())
    judged = [got[i]["lang_pred"] == d["lang"] for i, d in documents.items() if got[i]["held_out"] and d["lang"] and len(d["text"] or "") > 20]
    assert len(judged) > 30 and sum(judged) >= 0.95 * len(judged)


def test_token_counts(spark, documents):
    encode = encoder("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in run(spark, "op4_token_counts")}
    for i, d in documents.items():
        n = len(encode(d["text"]))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((d["text"] or "").encode()), n, n > 512)
        assert len(encode((d["text"] or "")[: got[i]["fit_chars"]])) == n if n <= 512 else len(encode(d["text"][: got[i]["fit_chars"]])) <= 512


def test_quality(spark, documents):
    for r in run(spark, "op5_quality_rules"):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(documents[r["doc_id"]]["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_shards(spark, documents):
    encode, text = encoder("byte_bpe_50k.json"), defaultdict(dict)
    rows = token_shards.write_shards(spark.read.parquet(str(DATA / "documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"), key="training order").orderBy("slot").collect()
    assert [tuple(r)[:-1] for r in rows] == sorted((tuple(r) for r in run(spark, "op6_token_shards")), key=lambda r: r[3])
    for r, x in zip(rows, token_shards.read_slots(rows[0]["file"].rsplit("/", 1)[0], 0, len(rows))):
        text[r["doc_id"]][r["piece"]] = x[: r["n_tokens"]].tolist()
    for i, d in documents.items():
        assert sum((text[i][p] for p in sorted(text[i])), []) == [*encode(d["text"]), 50256]


def test_scores(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op7_lm_score")}
    words = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").encode().lower()), None] for i, d in documents.items()}  # bytes.lower is A-Z alone
    train = [i for i in documents if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (i not in set(train), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and got[i]["score"] < 0


def test_near_documents(spark, documents):
    ids = sorted(documents)
    slow = slow_components([documents[i]["text"] for i in ids], 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op8_ngram_join")}
    assert got == {i: (n, ids[k]) for i, (n, k) in zip(ids, slow)}


# the pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, cls long, lang_pred string"


def odd_documents():
    """Copies, near copies, junk, nulls, empty and long texts of two languages and three sources."""
    words = {"en": "the of and song light winter river stone bird morning under over glass paper garden window".split(), "xx": "lor mel tin sab qux vyz wok pum dur zad kif nol gry hesp".split()}
    rng = np.random.default_rng(12)
    texts = []
    for k in range(60):
        lang = ("en", "xx")[k % 2]
        texts.append((" ".join(rng.choice(words[lang], 25 + 3 * k)), lang))
    texts += [(texts[4][0], "en"), (texts[4][0], "en"), (texts[9][0], None), (texts[30][0] + " river", "en"), (texts[31][0] + " lor", "xx")]
    texts += [(None, "en"), ("", None), ("12 34 !!", "en"), (" \n ", "xx"), (" ".join(rng.choice(words["en"], 5000)), "en")]
    return [(i, t, lang, ("a", "b", None)[i % 3], None if t is None else len(t), i, f"k{i}", -i, "?") for i, (t, lang) in enumerate(texts)]


def first_words(text, n):
    return "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:n])


def test_pipeline(spark, tmp_path):
    """Each stage's decisions by brute force, and the packed ids of what is left."""
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "pack_documents"]
    known = language_id.train_filters(df.select("text", "lang"))
    kept = [r for r in rows if (said := known.decide(r[1]))[0] != "und" and said[1] >= 0.2]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {r[0] for r in rows if not any(map(str.isalpha, r[1] or ""))}
    last = {r[1]: r for r in kept}  # the largest id of equal texts
    unique = sorted(last.values())
    near = slow_components([r[1] for r in unique], 5, 80)
    left = [r for i, (r, (_, k)) in enumerate(zip(unique, near)) if i == k]
    assert len(left) < len(unique) < len(kept)
    docs = df
    for name, want in (("language_id", kept), ("exact_dedup", unique), ("ngram_join", left)):
        docs = stage[name](spark, docs, str(tmp_path))
        assert docs.columns == df.columns and sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr)
    mixed = stage["mix_sources"](spark, docs, str(tmp_path))
    assert mixed.columns == df.columns
    text = {r[0]: r[1] for r in left}
    sizes, target = slow_mix([(r[0], r[3], len(r[1].split())) for r in left])
    words, whole = defaultdict(int), mixed.collect()
    for r in whole:
        assert r["text"] == first_words(text[r["doc_id"]], len(r["text"].split()))
        words[r["source"]] += len(r["text"].split())
    assert all(words[s] == math.floor(target[s]) for s in sizes)
    encode = encoder("word_bpe_49k.json")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids, room = defaultdict(bytes), Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(ids[r["sequence_id"]]) == 4 * r["offset"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        ids[r["sequence_id"]] += r["ids"]
    assert Counter(np.frombuffer(b"".join(ids.values()), "<u4").tolist()) == Counter(x for r in whole for x in (*encode(r["text"]), 0))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    (tmp_path / "x").mkdir()
    spark.createDataFrame([(1, None, None, None, None, 1, None, 1, None), (1, prose(1, 9), None, "s", 1, 1, None, 1, None)], SCHEMA).write.parquet(str(tmp_path / "x/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "x")).count() == 0  # no labelled text: nothing is recognised
