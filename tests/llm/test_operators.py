"""Each operator against a brute-force version on a table with nulls, empty and long texts, copies, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import decontaminate, fingerprint, licenses, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, n bigint, key string, h bigint"


def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 7)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \n\t ", "One", "two Words", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in (2, 5, 9, 14):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(120)] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 300))) for _ in range(12)]
    texts.append(" ".join(word() for _ in range(6000)))
    texts += ["start " + " ".join(base[20:90]) + f" end {i}" for i in range(4)]
    texts += ["x" * 1000, "ab" * 400]
    texts += [f"line {i}\nShared line here\nReleased under the MIT License.\nlast {i}" for i in range(7)]
    out = [(i * 3, t, "en", f"src{i % 6}", len(t or ""), 7, 7, "k", 1) for i, t in enumerate(texts)]
    return [*out, out[5], out[0]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id():
    return {r[0]: r[1] or "" for r in rows()}


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(table, empty):
    sets = {i: shingles(t) for i, t in by_id().items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows())
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), root[r.id], root[r.id] == r.id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicate_keys_in_blocks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 14)):
            own[rng.randrange(150)] = word()
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    root = list(range(60))
    for _ in range(8):
        for a in range(60):
            for b in range(60):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    old, near_dedup.BLOCK = near_dedup.BLOCK, 7
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    finally:
        near_dedup.BLOCK = old
    assert sorted((r.id, r.component_id) for r in got) == list(enumerate(root))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_passages(table, empty, hot):
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    expected = []
    for i, b in texts:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                hit[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        expected.append((i, len(b), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    old, substring_dedup.HOT = substring_dedup.HOT, hot
    try:
        got = [(r.id, r.n_bytes, len(r.spans), r.kept_sha256) for r in substring_dedup.repeated_passages(table).collect()]
    finally:
        substring_dedup.HOT = old
    assert sorted(got) == sorted(expected)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_decontamination(spark, table, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    base = words(by_id()[15])
    items = [(1, " ".join(base[30:55])), (2, "One"), (3, None), (4, ""), (5, "two words"), (6, " ".join(base[30:42])), (6, " ".join(base[30:42]))]
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    expected = []
    for i, t, *_ in rows():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        expected.append((i, len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(table, bench).collect()]
    assert sorted(got) == sorted(expected)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(table, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_fingerprints(spark, table, empty):
    from pyspark.sql import functions as F

    small = table.select("doc_id", "text").dropDuplicates(["doc_id"])
    nexts = {r.doc_id: r.next.text for r in fingerprint.with_next(small.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", lambda d: d).collect()}
    ids, texts = sorted(by_id(), reverse=True), by_id()
    assert nexts == {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    drawn = fingerprint.with_sketch(small, "text", "a")
    pairs = drawn.alias("x").join(drawn.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select(F.col("x.doc_id").alias("i"), F.col("y.doc_id").alias("j"), fingerprint.resemblance(F.col("x.a"), F.col("y.a")).alias("s"), fingerprint.containment(F.col("x.a"), F.col("y.a")).alias("c"))
    for r in pairs.collect():
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        assert abs(r.s - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(r.c - (len(a & b) / len(a) if a else 1)) < 0.2
    for r in drawn.select("doc_id", fingerprint.distinct_count(F.col("a")).alias("n")).collect():
        assert abs(r.n - len(shingles(texts[r.doc_id]))) <= 0.2 * len(shingles(texts[r.doc_id]))
    assert fingerprint.with_next(empty.select("doc_id", "text"), "doc_id", "text", lambda d: d).count() == 0


def test_sharding(table, empty):
    got = sharding.sharded(table, shards=4).collect()
    texts = by_id()
    assert len(got) == len(rows()) and sharding.sharded(empty).count() == 0
    assert all(r.size == len(texts[r.id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.id].encode()) for r in got)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    where = {}
    for r in got:
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_packing_balances():
    rng = np.random.default_rng(0)
    v = rng.pareto(1.5, (5000, 3)) + 0.1
    v = np.minimum(v, 20)
    sums = np.array([v[sharding.packed(v, 8) == s].sum(axis=0) for s in range(8)])
    assert (np.abs(sums / sums.mean(axis=0) - 1) < 0.02).all()


def test_line_dedup(table, empty):
    lines = {}
    for r in rows():
        for x in (r[1] or "").split("\n") if r[1] is not None else ():
            if x.strip(" \t\r"):
                lines.setdefault(x.strip(" \t\r"), set()).add(r[3])
    wide = {x for x, s in lines.items() if len(s) >= 5}
    expected = [(r[0], 0 if r[1] is None else len(r[1].split("\n")), None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" \t\r") not in wide)) for r in rows()]
    got = [(r.id, r.n_lines, r.text) for r in line_dedup.without_boilerplate(table).collect()]
    assert wide and sorted(map(str, got)) == sorted(map(str, expected))
    assert line_dedup.without_boilerplate(empty).count() == 0


def test_licenses(spark, table, empty):
    got = {r.id: (r.licences, r.n_rules) for r in licenses.scanned(table).collect()}
    assert all((x[0] == ["MIT"]) == ("MIT License" in by_id()[i]) for i, x in got.items())
    s = licenses.SENTENCES
    texts = ["\n".join([s["bsd-use"], s["bsd-source"].replace("of source", "of\n source"), "Other words.", s["bsd-binary"]]), "\n".join([s["bsd-source"], s["bsd-use"], s["bsd-binary"]]), "\n".join([s["bsd-use"], *["Filler words."] * 4, s["bsd-source"], s["bsd-binary"]])]
    found = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("id").collect()
    assert [r.licences for r in found] == [["BSD-2-Clause"], [], []]
    assert licenses.scanned(empty).count() == 0


def test_classifiers_and_rates(spark, table, empty):
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 3 == 0)) for i, r in enumerate(rows()[:30])] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        tox = toxicity.scored(table.select("doc_id", "text"), toxicity.fit(table, labelled)).collect()
        good = quality.scored(table.select("doc_id", "text"), quality.fit(table, labelled)).collect()
        for got in (tox, good):
            assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    mixed = mixing.mixed(table, labels).collect()
    assert len(mixed) == len(rows()) and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in mixed)
    assert mixing.mixed(empty, labels).count() == 0 and toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    members = spark.createDataFrame([(i, int(rng.integers(1, 500)), [float(x) for x in p[i]]) for i in range(400)], "id bigint, tokens bigint, p array<double>")
    got = mixing.rates(members, (0.6, 0.3, 0.1), budget=30_000.0).collect()
    sums = sum(r.rate * r.tokens * np.array(r.p) for r in got)
    assert np.allclose(sums, [18_000, 9_000, 3_000], rtol=1e-2) and min(r.rate for r in got) >= 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for op, label, least in ((toxicity.op6_toxicity, "toxic", 0.8), (quality.op9_quality_classifier, "quality", 0.85)):
        held = [(r.score, labels[r.doc_id][label]) for r in op(spark, d).collect() if r.held_out and r.doc_id in labels]
        pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
        assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > least


def test_pipeline_stages(spark, table, empty):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    clean = table.select(*columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clean, d)
        assert out.columns == columns, name
        assert stage(spark, empty.select(*columns), d).count() == 0, name
    assert near_duplicates_kept(corpus_pipeline.near_duplicate(spark, clean, d).collect())


def near_duplicates_kept(kept):
    ids = [r.doc_id for r in kept]
    return len(ids) == len(set(ids)) and 15 in ids and 18 not in ids
