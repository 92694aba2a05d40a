"""Maintained counts, trees and loads of cases against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import trees
from lexweave.operators.cases import CaseStore, case_tables
from lexweave.operators.counts import MaintainedCounts


def test_counts_follow_inserts_updates_and_deletes(spark, tmp_path):
    rng, now = random.Random(3), []
    counts = MaintainedCounts(spark, f"file://{tmp_path}", ["k", "g"], ["v"])
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, g string, v decimal(12,2)")
    from decimal import Decimal

    for step in range(4):
        new = [(rng.choice([None, *range(30)]), rng.choice(["a", None]), rng.choice([None, Decimal(rng.randrange(999)) / 100])) for _ in range(60 if step < 3 else 1)]
        old = rng.sample(now, len(now) // 2)
        touched = counts.apply(frame(new), frame(old) if old else None)
        for r in old:
            now.remove(r)
        now += new
        n, v = Counter((k, g) for k, g, _ in now), Counter()
        for k, g, x in now:
            v[k, g] += x or 0
        got = {(r.k, r.g): (r.n, r.v or 0) for r in counts.read().collect()}
        assert got == {key: (n[key], v[key]) for key in n}
    before = counts.store.manifest()
    assert counts.apply(frame([(5, "a", None)])) and counts.apply() == []
    after = counts.store.manifest()
    assert sum(before[p] != after.get(p) for p in before if "/" in p) <= 1 <= len(touched)  # only the group's own part is written


def test_ancestors_descendants_and_threads(spark):
    rng = random.Random(4)
    up = {i: rng.choice([None, -1, *range(max(0, i - 6), i)]) for i in range(80)} | {i: i - 1 for i in range(101, 200)} | {100: None, 300: 301, 301: 302, 302: 300, 303: 300, 304: 303, 310: 310}
    rows = spark.createDataFrame([(i, p, None if i % 9 == 0 else f"t{i}") for i, p in up.items()] + [(None, 3, "x")], "id bigint, up bigint, text string")

    def above(i):
        path = []
        while i in up and i not in path:
            path.append(i)
            i = up[i]
        return None if i in path else path

    paths = {i: above(i) for i in up}
    got = {r.id: (r.root, r.depth, r.looped) for r in trees.ancestors(rows, "id", "up").collect()}
    assert got == {i: (p[-1], len(p) - 1, False) if p else (None, None, True) for i, p in paths.items()}
    pairs = {(r.ancestor, r.id, r.distance) for r in trees.descendants(rows, "id", "up").collect()}
    assert pairs == {(a, i, k) for i, p in paths.items() if p for k, a in enumerate(p)}
    said = {r.id: r.thread for r in trees.threads(rows, "id", "up", "text").collect()}
    assert said == {i: "\n".join(f"t{a}" for a in reversed(p) if a % 9) for i, p in paths.items() if p}


FOUND = "struct<county:string,outcome:string,summary:string,parties:array<struct<name:string>>,judges:array<struct<name:string>>,issues:array<struct<text:string>>,arguments:array<struct<text:string>>>"


def found(spark, rows):
    return spark.createDataFrame(rows, f"id bigint, rules {FOUND}, model {FOUND}")


def case(parties=(), judges=(), issues=(), arguments=(), county=None):
    return (county, None, None, [(x,) for x in parties], [(x,) for x in judges], [(x,) for x in issues], [(x,) for x in arguments])


def names(store, table, column="name"):
    return sorted((r.id, r[column]) for r in store.read(table).collect())


def test_a_load_is_whole_or_nothing(spark, tmp_path):
    store = CaseStore(spark, f"file://{tmp_path}")
    rows = [(i, case([f"r{i}"], ["J"]), case(["Unknown"] if i % 2 else [f"m{i}"], ["j", "k"], ["x", "y"], ["a"], "King")) for i in range(20)] + [(50, None, None)]
    assert store.load(case_tables(found(spark, rows), "complete")) == {"inserted": 21, "replaced": 0}
    assert store.load(case_tables(found(spark, rows[:2] + [(60, *rows[0][1:])]), "hybrid")) == {"inserted": 1, "replaced": 2}
    assert store.load(case_tables(found(spark, rows[2:3]), "regex")) == {"inserted": 0, "replaced": 1}
    parties = names(store, "parties")
    assert parties == sorted([(0, "m0"), (1, "r1"), (2, "r2"), (60, "m0")] + [(i, "Unknown" if i % 2 else f"m{i}") for i in range(3, 20)])
    assert [x for x in names(store, "judges") if x[0] in (0, 2)] == [(0, "j"), (0, "k"), (2, "J")]
    first = {r.id: r.issue_id for r in store.read("issues").filter("position = 1").collect()}
    assert all(r.issue_id == first[r.id] for r in store.read("arguments").collect()) and 2 not in first and 50 not in first
    version = store.store.latest()
    broken = case_tables(found(spark, rows[:5]), "regex")
    broken["judges"] = broken["judges"].withColumn("name", F.when(F.col("id") == 4, F.raise_error(F.lit("half-way")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="half-way"):
        store.load(broken)
    stray = case_tables(found(spark, rows[:2]), "complete")
    stray["parties"] = stray["parties"].withColumn("id", F.lit(99).cast("bigint"))
    with pytest.raises(ValueError, match="parties has rows"):
        store.load(stray)
    with pytest.raises(ValueError, match="twice"):
        store.load(case_tables(found(spark, [rows[0], rows[0]]), "complete"))
    with pytest.raises(ValueError, match="mode"):
        case_tables(found(spark, rows), "other")
    assert store.store.latest() == version and names(store, "parties") == parties
    assert len(names(CaseStore(spark, f"file://{tmp_path}"), "parties")) == len(parties) and store.read("parties", 1).count() == 20
