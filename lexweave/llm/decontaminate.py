"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window lies in
a document only if all its two-word shingles do, so under exact containment the prefix that must be
joined is one shingle: the one that is rarest over all documents. Documents are exploded into
shingles, the join with those necessary shingles gives (document, start) candidates, positional and
length bounds cut those that can't fit, and the words themselves are compared at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._work import dropped, small, small_bytes, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever is not a word.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def _shingles(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, token: each word hashed with the next one, the last one alone."""
    pairs = F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("y"))
    return rows.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", F.xxhash64("p.x", "p.y").alias("token"))


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """win (hash), w (words), n (their number), items (distinct ids that hold the window)."""
    worded = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    cut = worded.select("item", "w", start.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.xxhash64("w").alias("win"), "w", F.size("w").alias("n"), "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The words of each document that lie in an occurrence of a benchmark window.

    Returns one row per input row: id, text_hash (xxhash64 of the text and its length), n_words,
    n_hit, n_items, items (ids as strings, sorted), spans (start and length, in words, of the
    occurrences found). Null and wordless texts have no words and no hits, wordless items no windows;
    windows of items without an id hit, but aren't counted as items. Repeated rows get equal rows, rows of one id or a null one are told
    apart by their text. An empty table gives no rows, an empty benchmark no hits. Columns besides
    the two named are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = base.select(F.col("id"), F.xxhash64("text", F.length("text")).alias("th"), "text")
    wins = written(windows(items, item_id, item_text, window), spark)
    n_wins = wins.count()
    tokens = _shingles(wins, "win", "n").filter("pos < n - 1 or n = 1").withColumnRenamed("pos", "off")
    ends = wins.filter("n = 1").select("win", "n", F.xxhash64(F.col("w")[0], F.lit(None).cast("string")).alias("token"))

    # How often each shingle of the benchmark occurs over all documents. One-word items, if any, need single words too.
    short = not ends.isEmpty()
    worded = keyed.select("id", "th", words(F.col("text")).alias("w"))
    spread = _shingles(worded, "id", "th")
    if short:
        spread = spread.union(worded.select("id", "th", F.posexplode("w").alias("pos", "x")).select("id", "th", "pos", F.xxhash64("x", F.lit(None).cast("string")).alias("token"))).distinct()
    asked = tokens.select("token").distinct()
    counts = written(spread.select("token").join(small(asked, n_wins * window), "token").groupBy("token").agg(F.count("*").alias("seen")), spark)
    # The rarest shingle of each window; a window with a shingle that is nowhere can't occur.
    rare = tokens.join(counts, "token", "left").groupBy("win", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "off")).alias("r"))
    rare = written(rare.filter("r.seen > 0").select("win", "n", F.col("r.token").alias("token"), F.col("r.off").alias("off")), spark)
    found = spread.join(small(rare, n_wins), "token").select("id", "th", (F.col("pos") - F.col("off")).alias("start"), "win", "n").filter("start >= 0").distinct()
    found = written(found, spark)
    per = written(found.groupBy("id", "th").agg(F.collect_list(F.struct("start", "win", "n")).alias("c")).select(F.col("id").alias("id_"), F.col("th").alias("th_"), "c"), spark)

    # One more pass over the texts: word counts of all, and the words at each candidate.
    met = keyed.join(small_bytes(per), F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    met = met.select("id", "th", "c", F.explode(F.array(words(F.col("text")))).alias("w"))
    # Only candidates whose words have the window's hash carry their words on.
    fits = F.filter("c", lambda x: (x["start"] + x["n"] <= F.size("w")) & (F.xxhash64(F.slice("w", x["start"] + 1, x["n"])) == x["win"]))
    cut = F.transform(fits, lambda x: F.struct(x["start"].alias("start"), x["win"].alias("win"), F.slice("w", x["start"] + 1, x["n"]).alias("w")))
    all_rows = written(met.select("id", "th", F.size("w").alias("n_words"), cut.alias("c")), spark)
    hits = all_rows.filter("size(c) > 0").dropDuplicates(["id", "th"]).select("id", "th", F.explode("c").alias("c")).select("id", "th", "c.*")
    sure = hits.join(small_bytes(wins.withColumnRenamed("w", "words")), "win").filter("w = words")
    by_doc = sure.groupBy("id", "th").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"),
    )
    by_doc = by_doc.select(F.col("id").alias("id_"), F.col("th").alias("th_"), F.size("at").cast("bigint").alias("n_hit"), "items", "spans")
    out = all_rows.drop("c").join(by_doc, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    none = F.array().cast("array<string>")
    dropped(counts, found, per, rare)
    return out.select(
        "id", F.col("th").alias("text_hash"), F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark windows it holds."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
