"""A stored index of vectors: inverted lists around trained centroids, searched by a number of probes, or all for exact answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.sources.snapshots import Snapshots

#: Rows that the centroids are trained on, at most.
SAMPLE = 100_000
#: Rows of a list, and queries of it, that are compared in one task.
BLOCK = 4_096


def _unit(vectors) -> np.ndarray:
    m = np.array(list(vectors), np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class VectorIndex:
    """Rows (id, vector) of one number of components. Rows without a direction, as their vector is null, empty, zero or holds null or NaN, aren't kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    @staticmethod
    def _usable(rows: DataFrame) -> DataFrame:
        v = F.transform("vector", lambda x: x.cast("double"))
        square = F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
        return rows.select("id", v.alias("vector")).filter((square > 0) & ~F.isnan(square))

    def build(self, rows: DataFrame, lists: int, seed: int = 1) -> None:
        """Trains ``lists`` centroids by angles on ``SAMPLE`` rows at most, chosen by the hash of their ids, and deals out all rows."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = self._usable(rows)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("vector").alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        centres = _unit(model.clusterCenters())
        with self.store.change() as made:
            made.replace("centres", self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>"))
            dealt = rows.mapInPandas(self._probes(centres, 1), "id bigint, vector array<double>, list int")
            made.replace("lists", dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "id"), "list")

    def add(self, rows: DataFrame) -> None:
        """Adds rows to the lists that are there."""
        with self.store.change() as made:
            made.append("lists", self._usable(rows).mapInPandas(self._probes(self._centres(), 1), "id bigint, vector array<double>, list int"), "list")

    def _centres(self) -> np.ndarray:
        return np.array([r.centre for r in self.store.read("centres").orderBy("list").collect()])  # as many as there are lists

    @staticmethod
    def _probes(centres: np.ndarray, probes: int):
        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    order = np.argsort(-(_unit(batch.vector) @ centres.T), axis=1, kind="stable")[:, :probes]
                    out = batch.loc[batch.index.repeat(order.shape[1])].reset_index(drop=True)
                    yield out.assign(list=order.ravel().astype(np.int32))

        return near

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Id, neighbour, similarity, rank of the ``k`` rows most alike to each query (id, vector) among the ``probes`` lists nearest to it, all lists by default.

        Similarities are rounded to six digits, of equal ones the lower id comes first. A list of many rows
        or queries is compared in blocks, each by a task of its own.
        """
        centres = self._centres()
        asked = self._usable(queries).mapInPandas(self._probes(centres, min(probes or len(centres), len(centres))), "id bigint, vector array<double>, list int")
        stored = self.store.read("lists").select("list", "id", "vector")
        sizes = {"r": stored.groupBy("list").count().collect(), "q": asked.groupBy("list").count().collect()}  # a row for each list
        blocks = {side: {r["list"]: -(-r["count"] // BLOCK) for r in rows} for side, rows in sizes.items()}

        def of(side: str):
            return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in blocks[side].items() for x in kv]), F.col("list")), F.lit(1)) if blocks[side] else F.lit(1)

        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        left = asked.select("list", "id", "vector", part(of("q")).alias("q"), F.explode(F.sequence(F.lit(0), of("r") - 1)).alias("r"))
        right = stored.select("list", "id", "vector", part(of("r")).alias("r"), F.explode(F.sequence(F.lit(0), of("q") - 1)).alias("q"))

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(b):
                ids, rows = b["id"].to_numpy(), _unit(b.vector)
                order = np.argsort(ids, kind="stable")
                ids, rows = ids[order], rows[order]
                for lo in range(0, len(a), 512):
                    own = a.iloc[lo : lo + 512]
                    near = np.round(_unit(own.vector) @ rows.T, 6)
                    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    found.append(pd.DataFrame({"id": own["id"].to_numpy().repeat(best.shape[1]), "neighbour": ids[best].ravel(), "similarity": np.take_along_axis(near, best, axis=1).ravel()}))
            return pd.concat(found) if found else pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

        keys = ["list", "q", "r"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "id bigint, neighbour bigint, similarity double")
        first = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
        return met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
