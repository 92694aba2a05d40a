"""Trees and chains of any edges: ancestors, descendants and threads by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.sources import files


def trails(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """The key, trail (its ancestors' keys from the root down, and itself) and looped of each row of ``nodes``.

    Each step joins a row's trail with that of the row above it, so that known trails double: steps are
    as many as the logarithm of the depth. A parent that isn't among the rows counts as none. Who gets
    into a loop on the way up is looped, with a trail of what it met before that. Keys are unique and not
    null; other rows are left out. Each step's rows are written to the shared folder.
    """
    spark = nodes.sparkSession
    rows = nodes.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("up"))
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    parented = F.when(F.col("there"), F.col("up")).alias("up")
    state = rows.join(known, "up", "left").select("id", parented, F.array("id").alias("trail"), F.lit(False).alias("looped"))
    while True:
        at = files.workspace(spark)
        state.write.parquet(at)
        state = spark.read.schema(state.schema).parquet(at)
        if state.filter("up IS NOT NULL AND NOT looped").isEmpty():
            return state.select(F.col("id").alias(key), "trail", "looped")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("trail").alias("__trail"), F.col("looped").alias("__looped"))
        going = F.col("up").isNotNull() & ~F.col("looped")
        met = state.withColumn("__next", F.when(going, F.col("up"))).drop("up").join(above.withColumnRenamed("up", "__next"), "__next", "left")
        both = F.when(F.col("__next").isNotNull(), F.concat("__trail", "trail")).otherwise(F.col("trail"))
        twice = F.size(F.array_distinct(both)) < F.size(both)
        state = met.select("id", F.when(~twice, F.col("__up")).alias("up"), F.when(twice, F.array_distinct(both)).otherwise(both).alias("trail"), (F.col("looped") | F.coalesce("__looped", F.lit(False)) | twice).alias("looped"))


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """J15 up: the key, root, depth (0 at a root) and looped; a looped row has neither root nor depth."""
    whole = ~F.col("looped")
    return trails(nodes, key, parent).select(key, F.when(whole, F.get("trail", F.lit(0))).alias("root"), F.when(whole, F.size("trail") - 1).alias("depth"), "looped")


def descendants(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """J15 down: ancestor, the key, distance of every row that isn't looped and each row above it, and itself at 0."""
    rows = trails(nodes, key, parent).filter("NOT looped").select(key, F.size("trail").alias("__n"), F.posexplode("trail").alias("__p", "ancestor"))
    return rows.select("ancestor", key, (F.col("__n") - 1 - F.col("__p")).alias("distance"))


def threads(nodes: DataFrame, key: str, parent: str, text: str, mark: str = "\n") -> DataFrame:
    """The key, depth and thread: the texts from the root down to each row that isn't looped, joined by ``mark``; null texts are left out."""
    above = descendants(nodes, key, parent).join(nodes.select(F.col(key).alias("ancestor"), F.col(text).alias("__text")), "ancestor")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("p"), F.col("__text").alias("t"))))
    return above.groupBy(key).agg(F.max("distance").alias("depth"), F.array_join(F.transform(ordered, lambda x: x["t"]), mark).alias("thread"))
