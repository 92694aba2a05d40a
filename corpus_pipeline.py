"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from lexweave.llm._work import dropped, scratch, small, table, written

#: Token shares of documents that are good text most likely, which are kept whole, and of all other after mixing.
SHARES = (0.95, 0.05)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; all labelled rows may be learned from. Each row is judged by its text alone."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name="__score", keep_text=True).filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, the doc_id; rows without one are documents named by their texts, after all that have one."""
    return docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + F.lit(1 << 62)))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near duplicates, as one row.

    Of rows of one document the one stays whose text and other columns come first by their hashes.
    """
    named = _named(docs)
    groups = written(near_dedup.near_duplicates(named, "__key"), spark)
    gone = written(groups.filter("not kept").select(F.col("id").alias("__id")).distinct(), spark)
    kept = named.join(small(gone, gone.count()), F.col("__key") == F.col("__id"), "left_anti")
    rows, ids = groups.agg(F.count("*")).first()[0], groups.select("id").distinct().count()
    if rows > ids:
        whole = F.struct(*docs.columns)
        kept = kept.groupBy("__key").agg(F.min_by(whole, F.struct(F.md5("text"), F.xxhash64(*docs.columns))).alias("r")).select("r.*")
    return kept.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Rows are told apart by doc_id, which may be null, and text."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = written(found.filter("n_hit > 0").select(F.col("id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), spark)
    met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text", F.length("text")) == F.col("__text"))
    return docs.join(small(hit, hit.count()), met, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are good text most likely, and thins out the others to their rates. A document with any row that is kept is kept."""
    named = _named(docs)
    rated = mixing.thinned(named, table(spark, sf_dir, "labels"), "__key", shares=SHARES, label_id="doc_id")
    gone = written(rated.groupBy(F.col("id").alias("__id")).agg(F.max("copies").alias("c")).filter("c < 1").select("__id"), spark)
    return named.join(small(gone, gone.count()), F.col("__key") == F.col("__id"), "left_anti").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of each document."""
    return sharding.sharded(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicate),
    ("benchmark_decontamination", benchmark),
    ("soft_mixing", mix),
    ("sharding", shard),
]

#: Learned stages can't be stated in SQL; tests/llm hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again; what a stage needed by itself is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as tables:
            kept = written(stage(spark, docs, sf_dir), spark)
            tables[:] = [t for t in tables if t is not kept]
        if k:
            dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
