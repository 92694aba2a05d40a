"""Counts and sums by group that are kept up to date by what is added and taken away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.snapshots import Snapshots

#: Parts that groups are kept in, by the hash of their keys; changing it takes a new table.
PARTS = 64


class MaintainedCounts:
    """Rows by key columns, n and sums, of which a change reads and writes only the parts that its groups are in.

    What is added counts once, what is taken away minus once; an update is both. Null keys are a group.
    Null values add nothing to sums. Groups without rows are dropped. Sums are exact where their type is:
    decimals and integers; floating point sums keep the errors of what came and went.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], sums: list[str] | None = None):
        self.spark, self.store, self.keys, self.sums = spark, Snapshots(spark, root), keys, sums or []

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(PARTS)).cast("int")

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*self.keys, F.lit(sign).cast("bigint").alias("n"), *[(F.col(c) * sign).alias(c) for c in self.sums])

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("n").alias("n"), *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.sums])

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> list[int]:
        """Counts rows in and out as one change; gives the numbers of the parts that were touched."""
        signed = [self._signed(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
        if not signed:
            return []
        delta = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        with self.store.change() as made:
            before = self.store.parts("groups", [], made.base)
            if before is not None:
                delta = delta.select([F.col(f.name).cast(f.dataType) for f in before.schema.fields])
            delta = self._merged(delta)
            made.append("delta", delta)
            path = made.tables.pop("delta")[-1]["path"]
            delta = self.spark.read.schema(delta.schema).parquet(path)
            touched = sorted(r.p for r in delta.select(self._part().alias("p")).distinct().collect())
            old = self.store.parts("groups", touched, made.base)
            now = self._merged(delta if old is None else old.unionByName(delta)).filter("n <> 0")
            made.put("groups", now.withColumn("part", self._part()).repartition("part"), "part", touched)
        self.store.delete(path)
        return touched

    def read(self) -> DataFrame:
        """The key columns, n and sums of every group that has rows."""
        return self.store.parts("groups")
