"""Cross-site boilerplate lines: distinct sites of each line by HyperLogLog sketches, merged by aggregation.

Texts are cut into lines and hashed once. One aggregation by line merges counts and sketches of
sites; a sketch's estimate decides where it is clear of the threshold, and lines nearer to it than
``MARGIN`` get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._work import dropped, small, table, written

#: Sites on which a line is boilerplate.
SITES = 5
#: Bits of the sketch's register number, and the share of the threshold within which it isn't trusted: over ten standard errors.
LOG_REGISTERS, MARGIN = 12, 0.2


def normal(line: Column) -> Column:
    """Lines are compared without leading and trailing blanks and tabs; empty ones never count as boilerplate."""
    return F.trim(F.translate(line, "\t\r", "  "))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """id, t (hash of the text), site, lines: pos (from 0), h1 and h2 of the lines that aren't empty."""
    base = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    # A generator keeps the lines from being cut again for each use below.
    cut = base.select("id", "site", F.xxhash64("text").alias("t"), F.explode(F.array(F.transform(F.split("text", "\n"), normal))).alias("x"))
    named = F.transform("x", lambda x, i: F.when(x != "", F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"), F.hash(x, F.length(x)).alias("h2"))))
    return cut.select("id", "t", "site", F.filter(named, lambda x: x.isNotNull()).alias("lines"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2 of the lines on ``sites`` sites or more, from ``hashed_lines``. A null site is no site."""
    spark = lines.sparkSession
    keyed = lines.filter("site is not null").select("site", F.inline("lines")).select("site", "h1", "h2")
    spread = keyed.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.hll_sketch_agg("site", LOG_REGISTERS).alias("s"))
    spread = written(spread.filter(F.col("c") >= sites).select("h1", "h2", F.hll_sketch_estimate("s").alias("n")), spark)
    clear = spread.filter(F.col("n") > sites * (1 + MARGIN)).select("h1", "h2")
    near = written(spread.filter(F.abs(F.col("n") - sites) <= sites * MARGIN).select("h1", "h2"), spark)
    pairs = keyed.join(small(near, near.count()), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= sites)
    out = written(clear.union(exact.select("h1", "h2")), spark)
    dropped(spread, near)
    return out


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """id, n_lines, n_removed and text (the other lines, joined again) for each input row.

    Null texts have no lines and stay null; an empty text is one empty line, which always stays; a
    text whose lines are all boilerplate becomes empty; copies of a line within a site count once;
    repeated rows get equal rows, and rows of a null id are told apart by their text. An empty table
    gives no rows. Only the three columns named are read, so others can't clash.
    """
    spark = docs.sparkSession
    lines = written(hashed_lines(docs, id_col, text_col, site_col), spark)
    wide = boilerplate(lines, sites)
    n = wide.count()
    # Repeated rows hold the same lines, so positions are gathered as a set.
    found = lines.select("id", "t", F.inline("lines")).join(small(wide, n), ["h1", "h2"], "left_semi").groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))
    found = written(found.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "drop"), spark)
    dropped(lines, wide)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = base.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("t_")), "left")
    # Cut once, in a row of its own; then kept places are what dropped ones leave, in time that grows with the lines.
    met = met.select("id", "text", "drop", F.explode(F.array(F.when(F.col("drop").isNotNull(), F.split("text", "\n")))).alias("parts"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "drop"), lambda i: F.get("parts", i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return met.select("id", n_lines.cast("bigint").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("bigint").alias("n_removed"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on five sources or more."""
    out = without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH own AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT *, trim(replace(replace(raw, chr(9), ' '), chr(13), ' '), ' ') AS line FROM own
), wide AS (
  SELECT line FROM lines WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM wide)) AS n_removed,
    string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM wide)) AS kept
  FROM lines GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""
