"""Stored indexes and tables that change together, against plain Python."""

import random
import re

import duckdb
import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.operators import grams, search, text
from lexweave.operators.grams import TrigramIndex
from lexweave.operators.inverted import InvertedIndex
from lexweave.operators.vectors import VectorIndex
from lexweave.sources.snapshots import Conflict, Snapshots

WORDS = "ab cd ef gh it's o'neil ab's 12 x2 of the".split()


def words(t):
    found = re.findall(r"[\w][\w'-]*[\w]", (t or "").lower())
    return [re.sub("'s$", "", w) for w in found if re.search("[a-z]", w)]


def documents(n, seed):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(25))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id bigint, text string")


def covers(own, query):
    """The places of each least stretch that holds all words."""
    marked = [(i, w) for i, w in enumerate(own) if w in query]
    out, before = [], -1
    for k in range(len(marked)):
        last = [max((j for j in range(k + 1) if marked[j][1] == w), default=-1) for w in query]
        if min(last) > before:
            before = min(last)
            out.append((marked[before][0], marked[k][0], k - before))
    return out


def same(index, docs):
    lists = {i: words(t) for i, t in docs.items() if t is not None}
    assert {r.id for r in index.holding(["AB", "the"]).collect()} == {i for i, w in lists.items() if {"ab", "the"} <= set(w)}
    assert index.holding([" "]).collect() == [] and index.phrase([]).collect() == []
    for phrase in (["of", "the"], ["ab", "ab"], ["ab", "cd", "ab"], ["it", "x2"], ["nowhere"]):
        want = sorted((i, k) for i, w in lists.items() for k in range(len(w)) if w[k : k + len(phrase)] == phrase)
        assert sorted((r.id, r.start) for r in index.phrase(phrase).collect()) == want
    assert {r.id for r in index.boolean("(ab & cd) | !the").collect()} == {i for i, w in lists.items() if {"ab", "cd"} <= set(w) or "the" not in w}
    assert {r.id: (r.length, r.words) for r in index.lengths().collect()} == {i: (len(w), len(set(w))) for i, w in lists.items()}
    query = ["ab", "of", "the"]
    n, mean = len(lists), sum(map(len, lists.values())) / max(1, len(lists))
    df = {q: sum(q in w for w in lists.values()) for q in query}
    idf = {q: np.log1p((n - df[q] + 0.5) / (df[q] + 0.5)) for q in query}
    want = {i: sum(idf[q] * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for q in query) for i, w in lists.items() if set(query) & set(w)}
    assert {r.id: r.score for r in index.bm25(query).collect()} == pytest.approx(want)
    want = {i: sum(0.1 / (1 + hi - lo - k) for lo, hi, k in covers(w, query)) for i, w in lists.items() if set(query) <= set(w)}
    assert {r.id: r.score for r in index.cover_density(query).collect()} == pytest.approx(want)
    long = {i: s / (1 + np.log(len(lists[i]))) / len(set(lists[i])) for i, s in want.items()}
    assert {r.id: r.score for r in index.cover_density(query, normal=1 | 8).collect()} == pytest.approx(long)


def test_inverted_index_through_changes(spark, tmp_path):
    index, now = InvertedIndex(spark, f"file://{tmp_path}"), documents(60, 1)
    now |= {100: None, 101: "", 102: " 7 ", 103: "of " * 3000}
    index.add(frame(spark, now))
    same(index, now)
    later = {i: t for i, t in documents(90, 2).items() if i >= 40}
    index.add(frame(spark, later))
    now |= later
    index.remove(spark.createDataFrame([(i,) for i in (3, 50, 999)], "id bigint"))
    now = {i: t for i, t in now.items() if i not in (3, 50)}
    same(index, now)
    index.merge()
    same(index, now)
    index.add(frame(spark, {3: "ab of the"}))
    same(index, now | {3: "ab of the"})
    assert [(r.word, r.n) for r in index.prefixed("o", 2).collect()] == sorted(((w, sum(words(t).count(w) for t in (now | {3: "ab of the"}).values())) for w in ("of", "o'neil")), key=lambda x: (-x[1], x[0]))


def test_a_query_reads_its_words_folders(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}")
    index.add(frame(spark, documents(40, 3)))
    plan = index.postings(["ab"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(word,ab)" in plan.replace("In(word, [ab])", "EqualTo(word,ab)")


def test_no_documents(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}")
    index.add(frame(spark, {}))
    same(index, {})


def test_trigram_index(spark, tmp_path):
    texts = documents(80, 4) | {200: None, 201: "", 202: "AB cd", 203: "abcd efgh"}
    index = TrigramIndex(spark, f"file://{tmp_path}")
    index.add(frame(spark, {i: t for i, t in texts.items() if i < 40}))
    index.add(frame(spark, {i: t for i, t in texts.items() if i >= 40}))
    rows = frame(spark, texts)
    for query in ("ab cd", "the of it's", "12", "", "zz"):
        want = {r.id: r.s for r in rows.select("id", search.trigram_similarity(F.col("text"), F.lit(query)).alias("s")).filter("s > 0.3").collect()}
        assert {r.id: r.similarity for r in index.similar(query).collect()} == pytest.approx(want)
    for piece in ("ab cd", "b c", "T'S", "bc", "x", "o'neil the", "", " of"):
        assert {r.id for r in index.containing(piece).collect()} == {i for i, t in texts.items() if t is not None and piece.lower() in t.lower()}
    assert grams.grams_within("bcd e") == ["  e", "bcd", "cd "]


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexweave.operators.vectors.BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)] + [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8)]
    data = spark.createDataFrame(rows, "id bigint, vector array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}")
    index.build(data.filter("id < 200"), lists=6)
    index.add(data.filter("id >= 200"))
    own = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 300}
    got = {}
    for r in index.search(data.filter("id % 20 = 0"), 5).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, r.similarity)
    for q in (i for i in own if i % 20 == 0):
        want = sorted(((-round(float(own[q] @ v), 6), i) for i, v in own.items()))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, pytest.approx(-s)) for s, i in want]
    near = {(r.id, r.neighbour) for r in index.search(data.filter("id % 20 = 0"), 5, probes=4).collect()}
    assert len(near & {(q, n) for q, x in got.items() for n, _ in x.values()}) >= 0.8 * 5 * len(got)


def test_changes_are_whole_or_undone(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    with store.change() as made:
        made.append("cases", spark.range(3))
        made.append("parties", spark.range(5))
    with pytest.raises(ZeroDivisionError), store.change() as made:
        made.replace("cases", spark.range(9))
        made.append("parties", spark.range(7))
        raise ZeroDivisionError
    with pytest.raises(Exception, match="raised"), store.change() as made:
        made.append("cases", spark.range(9))
        made.append("parties", spark.range(2).select(F.raise_error(F.lit("raised")).cast("bigint").alias("id")))
    assert store.latest() == 1 and store.read("cases").count() == 3 and store.read("parties").count() == 5
    assert len(list((tmp_path / "cases").iterdir())) == 1  # nothing is left of what was undone
    with pytest.raises(Conflict), store.change() as late:
        late.append("cases", spark.range(9))
        with store.change() as first:
            first.append("cases", spark.range(1))
    assert store.latest() == 2 and store.read("cases").count() == 4 and store.read("cases", 1).count() == 3
    with pytest.raises(KeyError):
        store.read("none")


def test_text_and_index_cut_the_same_words(spark):
    docs = documents(30, 6)
    got = {r.id: r.w for r in frame(spark, docs).select("id", text.tokens(F.col("text")).alias("w")).collect()}
    assert got == {i: words(t) for i, t in docs.items()}


def test_fuzzy_join_loses_no_pair(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
    left = [word() for _ in range(60)] + [None, " ", "x"]
    near = [list(w) for w in left[:40]]
    for w in near:
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcdx")
    right = ["".join(w) for w in near] + [word() + w + word() for w in left[:20]] + ["", "x"]
    got = search.fuzzy_join(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), "a", "b")
    want = sorted((a, b, search._partial(a, b)) for a in left if a and a.strip() for b in right if b.strip() and search._partial(a, b) >= 80)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["a13_consecutive_words", "a13_indexed_consecutive_words"])
def test_phrases_at_the_end_of_a_text_follow_the_sql(spark, tmp_path, name):
    """two words that end a text were counted, which the SQL doesn't."""
    texts = ["in the", "We live in the", "in the house, in the", "In the end", "in", "", "the in the in the in"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    next(iter((tmp_path / "documents").glob("*.parquet"))).rename(tmp_path / "documents.parquet")
    df, con = entry.queries()[name](spark, str(tmp_path)), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rows = [tuple(r) for r in df.collect()]
    assert {r[0] for r in rows} == {2, 3, 6} and not differences(name, rows, df.columns, con.execute(entry.oracle_sql()[name]))
