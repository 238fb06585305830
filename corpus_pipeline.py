"""A training corpus in five stages over `documents`; each stage reads what its predecessor wrote.

Language ID drops texts that no language's filters recognise; exact dedup keeps one row of equal texts; the n-gram
join keeps one document of each group of near duplicates (five words, similarity 0.8); mixing takes each source to
its target, whole epochs as repeated rows; packing places every token in sequences of 2048 and returns
the pieces' token ids (little-endian u32 bytes): mixing repeats and shortens documents, so doc_id alone does not give them.

Defined cases, for any columns beside those of `documents`, whatever their names: all but the last stage return the
columns of their input. An empty table gives an empty result. Null ids, languages and sources and repeated rows are
ordinary values; what becomes of null and empty texts each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastemill.llm import exact_dedup, language_id, mixing, ngram_join, packing, queries
from tastemill.llm._common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows go through Python here: from this stage on in Arrow batches of 250 rows instead of Spark's 10,000, and
    Parquet is read 512 rows at a time instead of 4,096. Whole texts in larger batches are arrays of many megabytes, for
    which each executor's heap grows to its limit and stays there, beside the buffers that Arrow keeps.

    Null texts, texts without letters and texts that no language's filter has a fifth of go; without labelled texts all go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 250)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
    return language_id.keep_identified(docs, min_score=0.2)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, of rows equal in id and text one; a null text equals the empty one."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the rows with its smallest id stay; texts without words are near nothing and stay."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are not taken; one text a source may be cut to its first words."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text, a null one too, ends with the end id; longer ones than a sequence are cut."""
    return packing.pack_documents(docs, queries.tokenizer(queries.WORD_TOKENIZER), capacity=2048, keep_ids=True)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix),
    ("pack_documents", pack),
]

#: Language ID, the tokenizer and the packing plan can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
