"""Packing of token sequences by best fit, in steps that all documents and gaps take at once.

A step cuts each gap into slots that the longest document left fits, range-sorts documents and slots
by size, and sweeps every range upwards: a slot takes the longest document below it that is still
free, as a closing bracket takes the last open one. What a range leaves over, only counts of which
reach the driver, is matched by its rank across ranges in the same way. Then gaps shrink, and the
next step follows, until nothing is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm._tokens import WordIds, kept
from lexweave.llm._work import dropped, partitions, table, text_batches, written

CAPACITY = 4096
END = 1
#: Rows that a task sweeps, about.
RANGE = 500_000


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each text's ids, with ``end`` after them, cut into pieces of ``capacity``; null is empty."""
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"words {tokenizer}", lambda: WordIds(tokenizer))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(words.of(batch.column(1))):
                ids = np.append(ids, end).astype("<u4")
                rows += [(k, p, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity])) for p, a in enumerate(range(0, len(ids), capacity))]
            if rows:
                k, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    text_batches(docs.sparkSession, 4_000)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(cut, f"id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


_LEFT = "what tinyint, key bigint, bin bigint, slot int, size int, part int, rank bigint"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, slot or document, key, slot), in order of size: 0 a match, 1 a document left over, 2 a slot left over, ranked."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    size, kind, key, slot = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in range(4))
    opens = kind == 0
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero((level[order[:-1]] == level[order[1:]]) & opens[order[:-1]] & ~opens[order[1:]])
    doc, gap = order[pair], order[pair + 1]
    free = np.ones(len(size), bool)
    free[doc] = free[gap] = False
    part = TaskContext.get().partitionId()
    docs, gaps = np.flatnonzero(free & opens), np.flatnonzero(free & ~opens)
    for what, d, g in ((0, doc, gap), (1, docs, None), (2, None, gaps)):
        n = len(d if d is not None else g)
        none = pa.nulls(n, pa.int64())
        for a in range(0, n, 100_000):
            cut = slice(a, min(n, a + 100_000))
            m = cut.stop - a
            yield pa.record_batch(
                [
                    pa.array(np.full(m, what, np.int8)), pa.array(key[d[cut]]) if d is not None else none[cut], pa.array(key[g[cut]]) if g is not None else none[cut],
                    pa.array(slot[g[cut]].astype(np.int32)) if g is not None else pa.nulls(m, pa.int32()), pa.array(size[d[cut] if d is not None else g[cut]].astype(np.int32)),
                    pa.array(np.full(m, part, np.int32)), pa.array(np.arange(a, cut.stop, dtype=np.int64)),
                ],
                ["what", "key", "bin", "slot", "size", "part", "rank"],
            )


def _across(counts: dict[int, list[int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Matches between ranges, from (documents, slots) left over in each: (range, from, to, number) of documents, counted from the longest, and (range, to, number) of slots."""
    stack: list[list[int]] = []  # range, documents taken so far, documents left
    docs, slots, number = [], [], 0
    for part in sorted(counts):
        free, wanted = counts[part]
        first, taken = number, 0
        while wanted and stack:
            top = stack[-1]
            n = min(wanted, top[2])
            docs.append((top[0], top[1], top[1] + n, number))
            number, wanted, taken = number + n, wanted - n, taken + n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if taken:
            slots.append((part, taken, first))
        if free:
            stack.append([part, 0, free])
    return docs, slots


def _rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A few rows of integers, of a number that the partitions bound."""
    values = ", ".join(f"({', '.join(f'{x}L' for x in r)})" for r in rows or [(0,) * len(names)])
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})").limit(len(rows)) if not rows else spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def _step(spark: SparkSession, todo: DataFrame, gaps: DataFrame, least: int, top: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One step: (key, bin, slot, size) of what is placed, written; (key, size) of what isn't, the table that it reads, and its number of rows."""
    k = F.greatest(F.expr(f"gap div {top}"), F.lit(1)).cast("int")
    slots = gaps.filter(F.col("gap") >= least).select(F.expr("gap").alias("gap"), "bin", k.alias("k")).select(F.expr("gap div k").cast("int").alias("size"), F.lit(1).alias("kind"), F.col("bin").alias("key"), F.explode(F.sequence(F.lit(1), "k")).alias("slot"))
    both = todo.select(F.col("size").cast("int"), F.lit(0).alias("kind"), "key", F.lit(0).alias("slot")).unionByName(slots)
    order = ["size", "kind", "key", "slot"]
    swept = written(both.repartitionByRange(max(partitions(spark), rows // RANGE), *order).sortWithinPartitions(*order).mapInArrow(_sweep, _LEFT), spark)
    counts: dict[int, list[int]] = {}
    for r in swept.filter("what > 0").groupBy("part", "what").count().collect():
        counts.setdefault(r.part, [0, 0])[r.what - 1] = r["count"]
    docs, taken = _across(counts)
    from_top = _rows(spark, [(p, counts[p][0], a, b, n) for p, a, b, n in docs], ("part", "free", "lo", "hi", "number"))
    left = swept.filter("what = 1").join(F.broadcast(from_top), "part", "left").withColumn("place", F.col("free") - 1 - F.col("rank"))
    # A range's documents are taken from the longest on, in runs; at most one run holds a place.
    met = left.filter("place >= lo AND place < hi").select("key", "size", (F.col("number") + F.col("place") - F.col("lo")).alias("number"))
    of_slots = _rows(spark, taken, ("part", "taken", "first"))
    open_ = swept.filter("what = 2").join(F.broadcast(of_slots), "part").filter("rank < taken").select("bin", "slot", (F.col("first") + F.col("rank")).alias("number"))
    crossed = met.join(open_, "number").select("key", "bin", "slot", "size")
    placed = written(swept.filter("what = 0").select("key", "bin", "slot", "size").unionByName(crossed), spark)
    keep = {p: counts[p][0] - max([0, *(b for q, _, b, _ in docs if q == p)]) for p in counts}
    rest = swept.filter("what = 1").join(F.broadcast(_rows(spark, list(keep.items()), ("part", "keep"))), "part").filter("rank < keep").select("key", "size")
    return placed, rest, swept, sum(keep.values())


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """key, bin, offset of each row of ``items`` (key, size), a written table: bins hold ``capacity`` at most, without gaps before their last item.

    Sizes are from 1 to ``capacity``. Bins opened at the start are as few as could hold everything, and
    more follow when what is left has no room. An empty table gives no rows.
    """
    spark = items.sparkSession
    full = items.filter(F.col("size") == capacity).select("key", (-1 - F.col("key")).alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    todo, gaps, opened, steps, olds = items.filter(F.col("size") < capacity).select("key", "size"), None, 0, [], []
    n, before = None, None
    while n != 0:
        n, total, least, top = todo.agg(F.count("*"), F.sum("size"), F.min("size"), F.max("size")).first()
        if not n:
            break
        room = gaps.filter(F.col("gap") >= least).agg(F.sum("gap")).first()[0] or 0 if gaps is not None else 0
        slow = before is not None and (before - n) * 8 < n
        new = max(0, -(-(total if slow or not room else total - room) // capacity))
        if new:
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("bigint").alias("gap"))
            gaps, opened = fresh if gaps is None else gaps.unionByName(fresh), opened + new
        before = n
        placed, todo, swept, n = _step(spark, todo, gaps, least, top, 2 * n)
        steps.append(placed.withColumn("step", F.lit(len(steps))))
        if n:
            used = placed.groupBy("bin").agg(F.sum("size").alias("used"))
            gaps = written(gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).filter("gap > 0"), spark)
            dropped(*olds)
            olds = [swept, gaps]
    if not steps:
        return full
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    earlier = Window.partitionBy("bin").orderBy("step", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return full.unionByName(every.select("key", "bin", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("bigint").alias("offset")))


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row's text.

    A null or empty text is its end token alone. Repeated rows, and rows of a null id, are packed each
    by itself. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, id_col, text_col, capacity, end).withColumn("key", F.monotonically_increasing_id()), spark)
    places = packed(cut.select("key", F.col("length").alias("size")), capacity)
    return cut.join(places, "key").select("id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    return sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
