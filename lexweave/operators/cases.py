"""Loads of cases with all their tables at once: a reader sees a case whole, in its old or its new state, and a load that fails changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.salvage import overridden
from lexweave.operators.load import children
from lexweave.sources.snapshots import Snapshots

#: Parts of each table by the hash of the case; changing it takes a new store.
PARTS = 64
VALUES = ("county", "outcome", "summary")
MODES = ("complete", "regex", "hybrid")


def case_tables(rows: DataFrame, mode: str, key: str = "id") -> dict[str, DataFrame]:
    """The tables of cases (key, rules, model), two structs of county, outcome, summary, parties, judges (structs of name), issues and arguments (structs of text).

    ``complete`` takes what the model says, ``regex`` what the rules say, ``hybrid`` the rules' values
    before the model's, the model's parties unless all are placeholders, and judges of both. All
    arguments belong to the case's first issue; those of a case without issues to none. Null structs and
    arrays count as empty.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode!r}")
    kinds = {n: rows.schema["model"].dataType[n].dataType.simpleString() for n in ("parties", "judges", "issues", "arguments")}

    def lists(source: str, name: str) -> Column:
        return F.coalesce(F.col(source)[name], F.array().cast(kinds[name]))

    if mode == "hybrid":
        own = overridden({v: F.col("rules")[v] for v in VALUES}, {v: F.col("model")[v] for v in VALUES}, (lists("rules", "parties"), lists("model", "parties")), (lists("rules", "judges"), lists("model", "judges")))
        own |= {n: F.when(F.size(lists("model", n)) > 0, lists("model", n)).otherwise(lists("rules", n)) for n in ("issues", "arguments")}
    else:
        source = "model" if mode == "complete" else "rules"
        own = {v: F.col(source)[v] for v in VALUES} | {n: lists(source, n) for n in kinds}
    cases = rows.select(key, *[c.alias(n) for n, c in own.items()])
    tables = {"cases": cases.select(key, *VALUES, F.lit(mode).alias("mode"))} | {n: children(cases, key, n) for n in kinds}
    tables["issues"] = tables["issues"].withColumn("issue_id", F.xxhash64(key, "position"))
    has_issue = cases.select(key, F.when(F.exists("issues", lambda x: x.isNotNull()), F.xxhash64(key, F.lit(1))).alias("issue_id"))
    tables["arguments"] = tables["arguments"].join(has_issue, key)
    return tables


class CaseStore:
    """Tables by case, of which a load puts each of its cases' rows in place of what was there."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Snapshots(spark, root)

    def load(self, tables: dict[str, DataFrame], key: str = "id") -> dict[str, int]:
        """Loads ``cases``, one row each, and their other tables as one change, reading and writing only the parts that they are in; how many were inserted and replaced.

        Rows of cases that aren't among ``cases`` are an error, as is a case that comes twice.
        """
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        with self.store.change() as made:
            made.append("loading", tables["cases"].select(key))
            path = made.tables.pop("loading")[-1]["path"]
            ids = self.store.spark.read.schema(tables["cases"].select(key).schema).parquet(path)
            touched = sorted(r.p for r in ids.select(part.alias("p")).distinct().collect())
            if ids.count() > ids.distinct().count():
                raise ValueError("a case comes twice in one load")
            before = self.store.parts("cases", touched, made.base)
            replaced = 0 if before is None else before.join(ids, key, "left_semi").count()
            for name, rows in tables.items():
                strange = rows.join(ids, key, "left_anti")
                if not strange.isEmpty():
                    raise ValueError(f"{name} has rows of cases that aren't loaded")
                old = self.store.parts(name, touched, made.base)
                kept = rows if old is None else old.join(ids, key, "left_anti").unionByName(rows)
                made.put(name, kept.withColumn("part", part).repartition("part"), "part", touched)
            loaded = ids.count()
        self.store.delete(path)
        return {"inserted": loaded - replaced, "replaced": replaced}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.store.parts(table, version=version)
        if found is None:
            raise KeyError(table)
        return found
