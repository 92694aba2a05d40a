"""Codes of vectors by product quantisation, in integers throughout, so that every run gives the same bytes.

Vectors become columnar blocks, one row of integers for each component, in a written table. Each
round adds up, block by block, the vectors nearest to each codebook entry, and merges sums and counts
through a reduction tree of an RDD; only those tensors, whose size the parameters fix, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._work import dropped, small, spread_join, table, text_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of larger magnitude, after scaling, would overflow the sums of 64-bit integers.
LARGEST = 1 << 27
#: Vectors of a block.
BLOCK = 4096


def integers(column: pa.Array, width: int, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """The vectors of a list column as integers, floor(scale * x), one row for each component.

    Components of zero are added until they can be cut into ``parts`` equal parts.
    """
    n = len(column)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(n, width)
    if n and np.abs(flat).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} in magnitude can't be coded")
    out = np.zeros((-(-width // parts) * parts, n), np.int32)
    out[:width] = flat.T
    return out


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the index of the nearest entry, the lower of two, and its squared distance."""
    parts, entries, width = books.shape
    codes, least = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            gap = block[p * width + d].astype(np.int64) - books[p, :, d, None]
            gap *= gap
            far += gap
        codes[p] = far.argmin(axis=0)
        least[p] = np.take_along_axis(far, codes[p][None], axis=0)[0]
    return codes, least


def gathered(total, block: np.ndarray, books: np.ndarray):
    """``total``, sums and counts by part and entry, with a block's vectors added to their nearest entries."""
    parts, _, width = books.shape
    sums, counts = total or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
    codes, _ = nearest(block, books)
    for p in range(parts):
        np.add.at(sums[p], codes[p], block[p * width : (p + 1) * width].T.astype(np.int64))
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def merged(a, b):
    """Two totals as one; None is the total of no block."""
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def moved(books: np.ndarray, total) -> np.ndarray:
    """The codebooks with each entry that has vectors replaced by their mean, rounded down."""
    if not total:
        return books
    sums, counts = total
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vector of the rows whose vector has components, none of them null, infinite or NaN."""
    v = F.col(vector_col)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("vector")).filter((F.size("vector") > 0) & ~broken)


def codebooks(spark: SparkSession, rows: DataFrame, first: list, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds, begun with the vectors ``first``."""
    width = len(first[0])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = integers(batch.column(0), width, parts, scale)
                yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int32()), "block": pa.array([out.tobytes()], pa.binary())})

    text_batches(spark, BLOCK)
    at = written(rows.select("vector").mapInArrow(blocks, "n int, block binary"), spark)
    books = integers(pa.array(first, pa.list_(pa.float64())), width, parts, scale).T.reshape(len(first), parts, -1).transpose(1, 0, 2).astype(np.int64)
    for _ in range(rounds):
        total = at.rdd.map(lambda r: np.frombuffer(r.block, np.int32).reshape(-1, r.n)).treeAggregate(None, lambda t, b, now=books: gathered(t, b, now), merged)
        books = moved(books, total)
    dropped(at)
    return books


def coded(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each row with a usable vector.

    A code is the entries' numbers in order of parts, two hexadecimal digits each; error the squared
    distance to the coded vector; label_error the sum of errors over rows of the same label, null being one.

    Rows whose vector is null, empty, or holds a null, infinite or NaN component are left out; so are
    those with another number of components than the row of the least id. Rows with equal ids are coded
    each by itself; among the first entries they are ordered by their vectors. Ids that are null come last.
    Fewer rows than ``entries`` make as many entries. A table without usable rows gives no rows. Other
    columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    names = {"id": rows.schema["id"].dataType, "label": rows.schema["label"].dataType}
    schema = f"id {names['id'].simpleString()}, label {names['label'].simpleString()}, code string, error bigint"
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema).select("id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = len(head[0].vector)
    rows = rows.filter(F.size("vector") == width)
    first = [r.vector for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = codebooks(spark, rows, first, parts, entries, rounds, scale)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, least = nearest(integers(batch.column(2), width, parts, scale), books)
                digits = [c.tobytes().hex() for c in np.ascontiguousarray(codes.T.astype(np.uint8))]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digits, pa.string()), pa.array(least.sum(axis=0), pa.int64())], ["id", "label", "code", "error"])

    out = written(rows.mapInArrow(code, schema), spark)
    by_label = written(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("c")), spark)
    labels = by_label.count()
    whole = F.lit(digest(books)).alias("codebooks_sha256")
    if small(by_label, labels) is by_label:  # too many labels to send to all executors
        none, key = F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(names["label"])).alias("key")
        joined = spread_join(out.select("id", "code", "error", none, key), by_label.select(none, key, "label_error", "c"), "none", "key")
    else:
        joined = out.alias("o").join(F.broadcast(by_label.drop("c")).alias("l"), F.col("o.label").eqNullSafe(F.col("l.label")))
    return joined.select("id", "code", "error", "label_error", whole)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``embeddings``."""
    return coded(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _sql() -> str:
    """The rounds unrolled: entries of each part and place, nearest entries, and their means rounded down."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""cells AS (SELECT r, (i - 1) // w AS p, (i - 1) % w AS d, x FROM (
            SELECT r, len(embedding) // {PARTS} AS w, unnest([floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM kept))""",
        f"book0 AS (SELECT p, r - 1 AS e, d, x FROM cells WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"far{k} AS (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far FROM cells c JOIN book{k} b USING (p, d) GROUP BY ALL)")
        steps.append(f"near{k} AS (SELECT r, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM far{k} GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"mean{k} AS (SELECT p, e, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM cells JOIN near{k} USING (r, p) GROUP BY ALL)")
            steps.append(f"book{k + 1} AS (SELECT p, e, d, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (p, e, d))")
    return f"""WITH {", ".join(steps)},
        sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) AS s FROM book{ROUNDS}),
        done AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM done JOIN kept USING (r), sha"""


SQL = _sql()
