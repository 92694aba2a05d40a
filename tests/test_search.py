"""Search operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import salvage
from lexweave.functions.stem import stemmed
from lexweave.operators import load, search, text


def test_fuzzy_join_loses_no_pair(spark):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("abc") for _ in range(rng.randrange(0, most)))
    left, right = [word(9) for _ in range(60)] + ["axb", "court"], [word(14) for _ in range(60)] + ["zab", "the courts"]
    expected = sorted((a, b, search._partial(a, b)) for a in left for b in right if a.strip() and b.strip() and search._partial(a, b) >= 80)
    rows = lambda x, c: spark.createDataFrame([(v,) for v in [*x, None]], f"{c} string")
    got = search.fuzzy_join(rows(left, "a"), rows(right, "b"), "a", "b")
    assert sorted((r.a, r.b, r.score) for r in got.collect()) == expected
    assert ("axb", "zab", 80) in expected


def test_fuzzy_columns_skip_blank_cells(spark):
    rows = spark.createDataFrame([(1, "nan", "the order"), (2, "", None)], "i int, p string, q string")
    words = spark.createDataFrame([("order",), ("nan",)], "w string")
    assert [(r.i, r.source_column, r.w, r.score) for r in search.fuzzy_columns(rows, ["p", "q"], words, "w").collect()] == [(1, "q", "order", 100)]


def test_queries_that_are_odd_or_malformed(spark):
    df = spark.createDataFrame([(["the", "court", "agreed"],), (["no", "court"],), ([],)], "w array<string>")
    count = lambda test: df.filter(test).count()
    assert [count(search.web_query(q, df.w)) for q in ("or court", "court or", "or", "", "-court", '"the court" or no', "!!!")] == [2, 2, 0, 0, 1, 2, 0]
    assert count(search.boolean_query("court & !(agreed | no)", df.w)) == 0 and count(search.boolean_query("no | the", df.w)) == 2
    for bad in ("", "&", "court &", "(court", "court)", "!", "| court"):
        with pytest.raises(ValueError):
            search.boolean_query(bad, df.w)


def test_stems_and_phrases(spark):
    known = {"caresses": "caress", "flies": "fli", "dies": "die", "agreed": "agre", "plotted": "plot", "itemization": "item", "generously": "generous", "custody": "custodi", "rationally": "ration", "hoping": "hope", "hopping": "hop", "possibly": "possibl", "knightly": "knight", "consistency": "consist"}
    assert {w: stemmed(w) for w in known} == known
    rows = spark.createDataFrame([(1, "The courts appealed the decisions."), (2, "An appeal of the court"), (3, None), (4, "")], "id int, text string")
    assert sorted(r.id for r in search.holding_stems(rows, "the court's appeals").collect()) == [1, 2]
    assert search.holding_stems(rows, "the of").count() == 0 and search.holding(rows, [" "]).count() == 0
    starts = search.phrase_starts(rows, search.stemmed_query("court appeals"), lambda t: search.lexemes(text.tokens(t)))
    assert [(r.id, r.start) for r in starts.collect()] == [(1, 1)]


def test_predecessors_of_one_time(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 6), (4, None, 6), (3, "a", 6)], "id int, k string, at int")
    earlier = spark.createDataFrame([(7, "a", 4), (8, "a", 4), (9, "a", 5), (6, None, 1)], "id int, k string, at int")
    assert sorted((r.id, r.responds_to or 0) for r in load.predecessor(rows, earlier, "k", "at", "id").collect()) == [(1, 8), (2, 8), (3, 9), (3, 9), (4, 0)]


def test_contains_join_takes_every_needle(spark):
    rng = random.Random(1)
    hay, needles = ["".join(rng.choice("abAB") for _ in range(rng.randrange(12))) for _ in range(50)], ["a", "AB", "bba", "", "abab"]
    got = load.containing(spark.createDataFrame([(h,) for h in hay], "h string"), "h", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    assert sorted(map(tuple, got.collect())) == sorted((h, n) for h in hay for n in needles if n and n.lower() in h.lower())


def test_repaired_objects():
    assert salvage.repair('x ```{"a": "b",}``` y') == {"a": "b"}
    assert salvage.repair("{'a': 'it'}") == {"a": "it"}
    assert salvage.repair("[1]") == {} and salvage.repair("") == {}
    assert salvage.repair('{"summary": "he said "no" to it", "county": "King"} and so on') == {"summary": 'he said "no" to it', "county": "King"}
    assert salvage.repair('{"a": [1 2 true {"b": null}] "c": "x\\ny"}') == {"a": [1, 2, True, {"b": None}], "c": "x\ny"}
    assert salvage.repair('{"county": "King", "other": 1, "issues": [{"x": ') == {"county": "King"}
    assert salvage.repair('{"a": ' + '[' * 200_000) == {} and salvage.scanned('{"a": ' + '[' * 50_000 + ']' * 50_000 + '}')[1]


def test_embeddings_keep_places_and_fail_as_null(spark):
    def model(t):
        if "bad" in t:
            raise ValueError
        return [1.0, 2.0] if "short" not in t else [1.0]

    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "bad"), (5, "short"), (6, "y")], "id int, text string")
    got = {r.id: (r.embedding, r.dimension) for r in text.embedded(rows, model, "m", 2).collect()}
    assert got == {1: ([1.0, 2.0], 2), 6: ([1.0, 2.0], 2), **{i: (None, None) for i in (2, 3, 4, 5)}}


def test_nearest_without_length(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in search.nearest(vectors, [2.0, 0.0], 3).collect()] == [1, 3, 2]
    assert vectors.count() == 3 and search.nearest(vectors.filter(F.lit(False)), [1.0, 0.0], 3).count() == 0
