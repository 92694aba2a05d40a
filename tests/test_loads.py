from pyspark.sql import functions as F

from lexweave.operators import load
from lexweave.sources import files
from lexweave.streaming import ingest


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    once = load.upsert(old, new, ["k"], F.desc("at"))
    assert sorted((r.k, r.v, r.was_inserted) for r in once.collect()) == [(1, "a", False), (2, "d", False), (3, "e", True)]
    twice = load.upsert(once.drop("was_inserted"), new, ["k"], F.desc("at"))
    assert sorted(r.v for r in twice.collect()) == ["a", "d", "e"]


def test_insert_ignore_and_dimension(spark):
    old = spark.createDataFrame([(1, None)], "k int, pin string")
    new = spark.createDataFrame([(1, None), (1, "x"), (1, "x")], "k int, pin string")
    assert load.insert_ignore(old, new, ["k", "pin"]).count() == 2
    known = spark.createDataFrame([(5, "Appeals")], "id bigint, name string")
    names = spark.createDataFrame([(" Appeals ",), ("Supreme",), ("",)], "name string")
    out = load.dimension(known, names, "name", "id")
    assert sorted(r.name for r in out.collect()) == ["Appeals", "Supreme"] and load.dimension(out, names, "name", "id").count() == 2


def test_cascade_predecessor_merge_taxonomy(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, 10)], "k int, target int"), spark.createDataFrame([(1, 5), (2, 7), (2, 6)], "k int, target int")
    assert [(r.k, r.target, r.strategy) for r in load.cascade(left, "k", a, b).orderBy("k").collect()] == [(1, 10, 1), (2, 6, 2), (3, None, None)]
    rows = spark.createDataFrame([(9, 1, 5), (8, 2, 5)], "id int, k int, at int")
    earlier = spark.createDataFrame([(1, 1, 2), (2, 1, 4), (3, 1, 9)], "id int, k int, at int")
    assert [(r.id, r.responds_to) for r in load.predecessor(rows, earlier, "k", "at", "id").orderBy("id").collect()] == [(8, None), (9, 2)]
    meta, rule = spark.createDataFrame([(1, None, "x")], "id int, a string, b string"), spark.createDataFrame([(1, "y", "z"), (2, "w", None)], "id int, a string, b string")
    got = load.merged(["a", "b"], meta=meta, rule=rule).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == [("y", "x"), ("w", None)] and got[0].provenance == {"a": "rule", "b": "meta"}
    paths = spark.createDataFrame([("c", "d", None), ("c", "e", "f")], "t string, u string, v string")
    assert load.taxonomy(paths, "t", "u", "v").count() == 4


def test_files_and_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(name.encode())

    def parse(content):
        if content == b"b":
            raise ValueError("broken")
        return content.decode()

    out = files.parsed(files.scan(spark, str(tmp_path / "in")), parse).cache()
    assert [r.text for r in out.filter("error is null").collect()] == ["a"] and files.quarantine(out).first().error == "broken"
    assert files.pending(out, out).count() == 0
    (tmp_path / "m.csv").write_text("case_number,x\n 1 ,a\n1,b\n2,c\n")
    assert sorted((r.case_number, r.x) for r in files.metadata(spark, str(tmp_path / "m.csv")).collect()) == [("1", "b"), ("2", "c")]
    docs = spark.range(10).withColumn("text", F.lit("t"))
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "docs"), docs.schema, ingest.partitioned_load(str(tmp_path / "out"), "id"), str(tmp_path / "ckpt"), 1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_urls_of_a_case_are_not_met_by_every_brief(spark):
    """each choice of words against a plain search, and a case with 6,000 briefs and 6,000 URLs, whose 36 million pairs took minutes."""
    import random
    import re
    import time
    from urllib.parse import unquote_plus

    rng, pool = random.Random(7), ["amended", "Appellants", "brief", "of", "reply", "cross-appellant", "Respondent", "cross", "2024", "851234", "motion"]
    urls = [(str(i % 3), rng.choice(["Exhibit", "Appellant Brief", "Respondent Reply"]), "http://x/" + rng.choice(["%20", "-", "_"]).join(rng.sample(pool, rng.randrange(1, 5))) + ".pdf", i) for i in range(60)]
    briefs = [(i, "_".join(rng.sample(pool, rng.randrange(1, 5))) + rng.choice([".pdf", ".PDF", ""]), str(i % 4), rng.choice(["Opening", "Reply", "Other"])) for i in range(200)] + [(200, None, "1", "Other"), (201, "a_b.pdf", None, "Other")]

    def plain(source, case, kind):
        own = [u for u in urls if u[0] == case]
        for _, typed, url, _ in own:
            low = typed.lower()
            if kind == ("Reply" if "reply" in low else "Response" if "respondent" in low else "Opening" if "appellant" in low else None):
                return url, 1
        name = re.sub(r"\.(pdf|PDF)$", "", source or "").replace("_", " ").lower()
        words = re.split(r"\s+", name)
        for _, _, url, _ in own:
            low = unquote_plus(url).lower()
            shared = sum(len(w) > 3 and w in low for w in words)
            if source is not None and (all(x in y for x in ("amended", "appellant") for y in (name, low)) or ("cross-appellant" in name and ("cross-appellant" in low or "cross appellant" in low)) or all(x in y for x in ("respondent", "cross") for y in (name, low)) or (shared >= len(words) - 1 and shared >= 2)):
                return url, 2
        return (own[0][2], 3) if own else (None, None)

    kinds = "brief_id int, source_file string, case_id string, brief_type string", "case_id string, document_type string, pdf_url string, at int"
    got = files.matched_urls(spark.createDataFrame(briefs, kinds[0]), spark.createDataFrame(urls, kinds[1])).collect()
    assert {r.brief_id: (r.url, r.strategy) for r in got} == {b[0]: plain(*b[1:]) for b in briefs} and len(got) == len(briefs)
    assert {r.strategy for r in got} == {None, 1, 2, 3}

    many = spark.range(6000).selectExpr("cast(id as int) brief_id", "concat(id, '_none_ofcourt_here.pdf') source_file", "'1' case_id", "'Other' brief_type")
    listed = spark.range(6000).selectExpr("'1' case_id", "'Exhibit' document_type", "concat('http://x/', id + 9000000, '%20some%20longer%20name%20of%20a%20file.pdf') pdf_url", "cast(id as int) at")
    began = time.time()
    assert {r.strategy for r in files.matched_urls(many, listed).collect()} == {3} and time.time() - began < 60


def test_statutes_of_one_section_are_not_met_by_every_citation(spark):
    """each strategy, and 20,000 citations of a section that 20,000 statutes have, whose 400 million pairs took minutes."""
    import time

    known = [(9, "1", "2.3", "(1)"), (4, "1", "2.3", "(2)"), (7, "1", "2.3", None), (5, "1", "2.31", "(1)"), (3, "2", "8", "(4)")]
    statutes = spark.createDataFrame(known, "statute_id bigint, title string, section string, subsection string")
    texts = ["RCW 1.2.3(1)", "RCW 1.2.3(2)", "RCW 1.2.3(9)", "RCW 1.2.3", "RCW 1.2", "RCW 2.8(5)", "RCW 3.1(1)", "RCW 3.1(1)", "none", None]
    found, all_ = load.resolved_statutes(spark.createDataFrame(list(enumerate(texts)), "id int, citation string"), statutes)
    got = {r.id: (r.strategy, r.statute_id) for r in found.collect()}
    assert len(got) == found.count() == 10 and [got[i] for i in range(6)] == [(1, 7), (1, 4), (1, 7), (2, 4), (3, 4), (2, 3)]
    assert got[6] == got[7] and got[6][0] == 4 and got[8] == got[9] == (None, None) and all_.count() == 6

    many = spark.range(20000).selectExpr("id statute_id", "'1' title", "'2.3' section", "concat('(', id, ')') subsection")
    cited = spark.range(20000).selectExpr("id", "concat('RCW 1.2.3(', id + 30000, ')') citation")
    began = time.time()
    found, _ = load.resolved_statutes(cited, many)
    assert [tuple(r) for r in found.groupBy("strategy", "statute_id").count().collect()] == [(2, 0, 20000)] and time.time() - began < 40
