"""Shared storage for intermediate tables, checked broadcasts and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows of a few fixed-width columns that is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000
#: The same in bytes, for tables with strings and arrays.
BROADCAST_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, but on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lexweave-")
        shared_dir.own = found
    return found.rstrip("/")


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends, and lost executors lose nothing."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this job go with it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._lexweave_path = path
    scopes = getattr(spark, "_lexweave_scopes", None)  # on the session, as functions are shipped with the globals that they use
    if scopes:
        scopes[-1].append(out)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables written within when it ends, but for those taken out of the list it gives."""
    tables: list[DataFrame] = []
    scopes = spark._lexweave_scopes = getattr(spark, "_lexweave_scopes", None) or []
    scopes.append(tables)
    try:
        yield tables
    finally:
        scopes.pop()
        dropped(*tables)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t._lexweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``rows``, which the caller has counted, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_bytes(df: DataFrame) -> DataFrame:
    """A broadcast hint if the rows of ``df``, a written table, are counted as few and short enough."""
    length = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(length.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _bytes(c, kind: T.DataType):
    """About the bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(16), lambda t, x: t + _bytes(x, kind.elementType)), F.lit(16))
    return F.lit(8)


def spread_join(rows: DataFrame, keys: DataFrame, *key: str, least: int = 256, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``keys``, a written table of one row for each key and its number of rows as ``c``, which is left out.

    Rows of a key that has many are dealt out over ``salts`` parts. Those keys are sent to all
    executors; at most 100,000 can have as many rows as that takes.
    """
    total = keys.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    many = F.col("c") >= max(least, total // 100_000)
    hot = keys.filter(many).select(*key, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return rows.join(keys.drop("c"), [*key])
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int")
    salted = rows.join(F.broadcast(hot), [*key], "left").withColumn("__s", salt).drop("__hot")
    parts = F.explode(F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(keys.withColumn("__s", parts).drop("c"), [*key, "__s"]).drop("__s")


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of ``rows`` texts at most, unless the session has set a number itself.

    Spark bounds their bytes too (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default). The
    setting stays, as plans made now run later.
    """
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
