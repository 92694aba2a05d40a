"""Queries against DuckDB on the smallest tables, and rules that SQL can't state against plain Python."""

import random

import pytest
from oracle import connection, differences

import __spark_entry__ as entry
from lexweave.operators import search, text
from lexweave.plans import load_queries, rule_queries, table_queries, text_queries

SMALL = "/root/testdata/sf0.001"
ORACLES = sorted([*text_queries.ORACLE_SQL, *table_queries.ORACLE_SQL, *rule_queries.ORACLE_SQL, *load_queries.ORACLE_SQL])


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", ORACLES)
def test_against_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    assert not differences(name, [tuple(r) for r in df.collect()], df.columns, duck.execute(entry.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["j6_anti_join", "j7_theta_first_match", "r18_find_with_context", "t8_section_kind", "r15_navigation", "t19_legal_phrases", "j10_statute_cascade", "j8_cascade_link"])
def test_rows_are_compared(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_fuzzy_join_query_against_all_pairs(spark):
    names = {r.p_name for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    words = {w for n in names for w in n.split(" ")}
    got = {(r.word, r.name, r.score) for r in entry.queries()["j18_fuzzy_join"](spark, SMALL).collect()}
    assert got and got == {(w, n, search._partial(w, n)) for w in words for n in names if search._partial(w, n) >= 80}


def test_every_kind_is_met(spark):
    kinds = {r.kind for r in entry.queries()["t8_section_kind"](spark, "/root/testdata/sf0.01").collect()}
    assert kinds == {"FACTS", "ANALYSIS", "CONCLUSION", "CUSTODY", "SUPPORT", "PROPERTY", "FEES", "GENERAL"}
    strategies = {r.strategy for r in entry.queries()["j8_cascade_link"](spark, SMALL).collect()}
    assert strategies == {None, 1, 2, 3} and {r.strategy for r in entry.queries()["j10_statute_cascade"](spark, SMALL).collect()} == {1, 2, 3, 4}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_chunks_follow_the_rule(spark):
    rng = random.Random(5)
    paras = [(d, p, rng.choice("AB"), " ".join(["w"] * rng.choice([5, 40, 90, 200, 600]))) for d in range(6) for p in range(rng.randrange(1, 12))]
    df = spark.createDataFrame([(*x, len(x[3].split())) for x in paras], "id int, pos int, section string, text string, words int")
    got = [(r.id, r.chunk_order, r.section, r.text, r.word_count) for r in text.chunks(df).collect()]
    expected = []
    for d in range(6):
        now, sec, order = [], None, 0

        def close():
            nonlocal now, order
            joined = "\n\n".join(now)
            if now and len(joined.split()) >= 100:
                order += 1
                expected.append((d, order, sec, joined, len(joined.split())))
            now = []

        for _, _, s, t in sorted(x for x in paras if x[0] == d):
            if s != sec:
                close()
            sec = s
            now.append(t)
            if sum(len(x.split()) for x in now) >= 350:
                close()
        close()
    assert sorted(got) == sorted(expected)


def test_tokens(spark):
    df = spark.createDataFrame([("The plaintiff's co-petitioner didn't pay $500 in 2024, as a's share; plaintiffs' été.",)], "t string")
    got = df.select(text.tokens(df.t)).first()[0]
    assert got == ["the", "plaintiff", "co-petitioner", "didn't", "pay", "in", "as", "a", "share", "plaintiffs", "été"]


def test_sentences_protect_citations(spark):
    df = spark.createDataFrame([(1, "See below. RCW 26.09.170 applies here. The court agreed."), (2, "It cited 12 S. Ct. 345 today. Then it ended."), (3, None), (4, "")], "id int, text string")
    assert text.sentences(df, least=1).groupBy("id").count().orderBy("id").collect() == [(1, 2), (2, 2)]


def test_web_query_and_stems(spark):
    df = spark.createDataFrame([(["the", "court", "agreed"],), (["no", "court"],)], "w array<string>")
    assert df.filter(search.web_query('"court agreed" or -court', df.w)).count() == 1
    assert df.select(search.stems(df.w)).first()[0] == ["the", "court", "agre"]
