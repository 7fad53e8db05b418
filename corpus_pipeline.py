"""A corpus pipeline of five stages, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. Rows with a null doc_id are never merged; a stage on an empty table gives
an empty table.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from seriesforge.llm._session import Tables, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.5
#: Words and stems whose ids a worker keeps while it packs: after four other stages an executor's JVM has taken most of its memory.
PACKING_CACHES = {"cached_words": 600_000, "cached_stems": 500_000}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs.select(COLUMNS), quality.train(docs, labels)).where(F.col("score") >= LEAST_QUALITY).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group that links connect.

    A repeated row (the same id and text) stays once; rows of the kept id with other texts all stay.
    """
    prepare(spark)
    docs = docs.select(COLUMNS)
    found = jaccard_join.linked_components(docs)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    numbered = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumns({"text_hash": F.xxhash64("text"), "text_size": F.octet_length("text")})
    one_each = numbered.dropDuplicates(["doc_id", "text_hash", "text_size"])
    return one_each.select(COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of passages that also start earlier in the corpus."""
    prepare(spark)
    cut = substring_dedup.dedup_texts(docs.select(COLUMNS))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    prepare(spark)
    return decontaminate.clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences, with the token ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), make=functools.partial(packing.word_tokenizer, **PACKING_CACHES))


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

#: SQL can't express the classifier or the tokenizer. Tests hold each stage against its operator's results, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again in the shared folder; only the last table stays there."""
    prepare(spark)
    tables = Tables(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return docs
