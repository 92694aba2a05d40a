"""Shards that balance bytes, tokens and rows jointly, by vector bin packing.

A group is all rows of one text. Large groups, and the cells into which the hashes of the others
fall, are vectors of (bytes, tokens, rows); the largest first, each goes to the shard whose
residual capacity has the highest dot product with it. Only those vectors reach the driver: their
number is bounded by the constants below, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm._work import dropped, partitions, table, written

#: Cells of small groups; groups that hold this share of any total or more are packed by themselves, so at most 3 * CELLS.
CELLS = 8192


def packed(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``vectors``, whose columns are balanced jointly."""
    capacity = np.maximum(vectors.sum(axis=0), 1) / shards
    items = vectors / capacity
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1) if len(items) else np.zeros(0))):
        fits = (residual >= items[i]).all(axis=1)
        dot = residual @ items[i]
        s = int(np.where(fits, dot, -np.inf).argmax()) if fits.any() else int(dot.argmax())
        out[i] = s
        residual[s] -= items[i]
    return out


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Each row's shard: id, size (UTF-8 bytes and 1), tokens, text_crc32, shard, slot (gapless from 0 in each shard).

    Equal texts share a shard; null counts as empty. Only a text whose copies hold more bytes than a
    whole shard may is split, by the hash of the id, into pieces of half a shard. Rows of equal id
    and text are in any order. The law is equal bytes: sizes differ by about a cell.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"),
    )
    rows = written(rows, spark)
    groups = rows.groupBy("k", "text_crc32", "size").agg(F.sum("tokens").alias("t"), F.count("*").alias("r")).withColumn("b", F.col("size") * F.col("r"))
    groups = written(groups, spark)
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"]).first()
    large = (F.col("b") * CELLS >= total.b) | (F.col("t") * CELLS >= max(total.t, 1)) | (F.col("r") * CELLS >= total.r)
    heavy = groups.filter(large).orderBy("k", "text_crc32", "size").collect()
    cell = F.pmod("k", F.lit(CELLS)).cast("int")
    light = groups.filter(~large).groupBy(cell.alias("cell")).agg(*[F.sum(c).alias(c) for c in "btr"]).orderBy("cell").collect()
    items = [((h.k, h.text_crc32, h.size, j), (h.b / n, h.t / n, h.r / n)) for h in heavy for n in [1 if h.b * shards <= total.b else -(-2 * h.b * shards // total.b)] for j in range(n)]
    pieces: dict = {}
    for key, _ in items:
        pieces[key[:3]] = pieces.get(key[:3], 0) + 1
    where = packed(np.array([v for _, v in items] + [(x.b, x.t, x.r) for x in light], float).reshape(-1, 3), shards)
    own = spark.createDataFrame([(*key, pieces[key[:3]], int(s)) for (key, _), s in zip(items, where, strict=False)], "hk bigint, hc bigint, hs bigint, piece int, of int, own int")
    of = spark.createDataFrame([(x.cell, int(s)) for x, s in zip(light, where[len(items) :], strict=True)], "c int, common int")
    pieced = own.select("hk", "hc", "hs", "of").distinct()
    placed = rows.join(F.broadcast(pieced), (F.col("k") == F.col("hk")) & (F.col("text_crc32") == F.col("hc")) & (F.col("size") == F.col("hs")), "left").drop("hk", "hc", "hs")
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1))).cast("int"))
    placed = placed.join(F.broadcast(own.drop("of")), (F.col("k") == F.col("hk")) & (F.col("text_crc32") == F.col("hc")) & (F.col("size") == F.col("hs")) & (F.col("cut") == F.col("piece")), "left")
    placed = placed.join(F.broadcast(of), cell == F.col("c"), "left").withColumn("shard", F.coalesce("own", "common"))
    # Slots: rows are numbered within many parts of each shard, and parts begin where the ones before end.
    n_parts = partitions(spark)
    placed = written(placed.select("id", "size", "tokens", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(n_parts)).cast("int").alias("part")), spark)
    dropped(rows, groups)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", F.col("part").alias("q"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32")) - 1
    numbered = placed.withColumn("inner", inner).join(F.broadcast(first.withColumnRenamed("shard", "s")), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("q")))
    return numbered.select("id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("inner")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard out of eight, under the law of equal bytes."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
