"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k least distinct hashes of a text's five-word shingles. The
sketch of a union is the bottom k of the merged sketches, so parts can be sketched apart. Two
sketches estimate resemblance, containment and distinct shingle counts; sketches of fewer than k
hashes are whole sets, and estimates over them are exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm._work import partitions, small, table, written

K = 256
GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def with_sketch(rows: DataFrame, text_col: str, name: str, k: int = K, shingle: int = 5) -> DataFrame:
    """``rows`` with the bottom-k sketch of a text column as array<bigint> ``name``.

    Empty for null, empty and wordless texts; a text of fewer words than a shingle, but not none,
    has one shingle: all its words.
    """
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), GAPS), "")
    # A generator keeps the words from being split again for each use below.
    worded = rows.select("*", F.explode(F.array(words)).alias("__w"))
    last = F.greatest(F.size("__w") - (shingle - 1), F.lit(1))
    runs = F.arrays_zip(*[F.slice("__w", F.lit(i + 1), last).alias(f"w{i}") for i in range(shingle)])
    hashes = F.when(F.size("__w") > 0, F.transform(runs, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    return worded.withColumn(name, _bottom(F.array_distinct(hashes), k)).drop("__w")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return _bottom(F.array_union(a, b), k)


def _union(a: Column, b: Column, k: int) -> Column:
    """The least hashes of the union: k of them, or all if both sketches are whole sets."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    return F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.when(whole, F.lit(2 * k)).otherwise(F.lit(k)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if only one is empty."""
    low = _union(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), low)
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(low))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 if a is empty."""
    low = _union(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), low)) / F.size(low)
    whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.when(whole, F.size(low).cast("double")).otherwise(distinct_count(merged(a, b, k), k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both * union / distinct_count(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


#: Rows whose keys are read for each bound between ranges.
READ = 20


def _ranges(rows: DataFrame, id_col: str, n: int) -> Column:
    """The range, out of ``n`` of about as many rows each, that a row with ``id_col`` and ``__h`` falls into; range 0 holds the highest ids.

    Bounds are (id, hash of the text), so that rows of one id are dealt out too. They are chosen among
    about READ * n rows, picked by a hash, whose two numbers are all the driver gets.
    """
    key = rows.select(F.col(id_col).cast("decimal(20,0)").alias("i"), F.col("__h").alias("h"))
    share = READ * n / max(rows.count(), 1)
    few = key.filter(F.col("i").isNotNull() & (F.shiftrightunsigned(F.xxhash64("i", "h"), 11) / F.lit(float(1 << 53)) < share)).collect()
    ranked = sorted((-r.i, r.h) for r in few)
    bounds = [(str(-i), h) for i, h in ranked[READ::READ]]
    size = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    own = F.col(id_col).cast("decimal(20,0)")
    after = lambda b: (own < b["i"]) | ((own == b["i"]) & (F.col("__h") >= b["h"]))
    read = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    count = lambda a: F.size(F.filter(a, after))
    one = "struct<i:decimal(20,0),h:bigint>"
    if not bounds:
        return F.when(own.isNull(), 1).otherwise(0)
    entry = lambda b: {"i": b[0], "h": b[1]}
    block = count(read([entry(g[0]) for g in groups], f"array<{one}>"))
    inner = F.try_element_at(read([[entry(b) for b in g[1:]] for g in groups], f"array<array<{one}>>"), block)
    return F.when(own.isNull(), len(bounds) + 1).when(block == 0, 0).otherwise((block - 1) * size + 1 + count(inner))


def with_next(rows: DataFrame, id_col: str, text_col: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prepare(rows)`` with ``next``: a struct of the prepared columns of the row with the next lower id, after the lowest the highest.

    Rows are dealt into ranges of the id, in which each is followed by the next; only the last row of
    a range looks outside it, to the first row of the next range. ``prepare`` runs after rows are
    dealt out, once for each. Rows of equal id are in the order of the hash of their text, those of
    equal text in any; rows with a null id come last, all in one range. The only row of a table is
    followed by itself; an empty table gives no rows.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("__h", F.xxhash64(text_col))
    dealt = hashed.withColumn("__part", _ranges(hashed, id_col, 4 * partitions(spark)))
    own = F.col(id_col).cast("decimal(20,0)")
    place = F.struct(own.isNull(), -own, F.col("__h"), F.col(text_col))
    firsts = written(dealt.groupBy("__part").agg(F.min_by(F.struct(*rows.columns), place).alias("r")), spark)
    parts = sorted(r[0] for r in firsts.select("__part").collect())
    before = spark.createDataFrame([(q, parts[k - 1]) for k, q in enumerate(parts)], "__part int, __p int")
    heads = prepare(firsts.join(F.broadcast(before), "__part").select("__p", "r.*"))
    columns = [c for c in heads.columns if c != "__p"]
    heads = heads.select("__p", F.struct(*columns).alias("__head"))
    w = Window.partitionBy("__part").orderBy(F.col(id_col).desc_nulls_last(), "__h", text_col)
    inner = prepare(dealt.repartition("__part")).withColumn("__next", F.lead(F.struct(*columns)).over(w))
    out = inner.join(small(heads, len(parts)), F.col("__part") == F.col("__p"))
    return out.select(*columns, F.coalesce("__next", "__head").alias("next"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, that of an edited text, and its likeness to both that and the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document in descending order of doc_id. A null text is an empty one; see ``with_next`` for
    null and repeated ids.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Sketches are made after the rows are dealt out, so that the shuffle carries texts alone.
    rows = with_next(docs, "doc_id", "text", lambda d: with_sketch(d, "text", "a")).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next.text", F.lit(1), half))
    both = with_sketch(rows.select("doc_id", "n", "a", F.col("next.a").alias("c"), edited.alias("edited")), "edited", "b")
    return both.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("a")).alias("fingerprint"),
        encoded(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"),
        resemblance(F.col("a"), F.col("c")).alias("near_next"),
    )
