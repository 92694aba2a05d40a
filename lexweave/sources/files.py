"""File sources and sinks: scans, metadata, quarantine, and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.normalize import brief_file


def workspace(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; a temporary one only where that is unset, and on a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lexweave-")
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def scan(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Path, content and size of files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content", F.col("length").alias("size"))


def parsed(files: DataFrame, parser: Callable[[bytes], str], tries: int = 3) -> DataFrame:
    """Path, text, error by a parser of bytes; an error of each try is kept to 500 characters, and a failed file is a row."""

    def run(content: bytes | None) -> tuple[str | None, str | None]:
        text = error = None
        for _ in range(tries):
            try:
                text, error = parser(bytes(content)), None
                break
            except Exception as e:  # a parser may raise anything; the file goes to quarantine
                error = str(e)[:500]
        return text, error

    # Sent to Python by hundreds of files, where batches of Arrow hold ten thousand whole ones.
    one = F.udf(run, "text string, error string", useArrow=False)
    return files.select("path", one("content").alias("r")).select("path", "r.text", "r.error")


def quarantine(results: DataFrame) -> DataFrame:
    """The failed files; a source for a retry."""
    return results.filter("error is not null").select("path", "error")


def pending(files: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Files that no earlier run has seen, failed ones included; files are told apart by ``key``."""
    return files.join(processed.select(key).distinct(), key, "left_anti")


def metadata(spark: SparkSession, path: str, key: str = "case_number") -> DataFrame:
    """CSV files with a header, keys trimmed; of rows of one key the last counts, files in the order of their names."""
    rows = spark.read.option("header", True).csv(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("__at")).withColumn(key, F.trim(key))
    newest = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__at")


def successful(rows: DataFrame, status: str = "download_status") -> DataFrame:
    """The rows whose download succeeded."""
    return rows.filter(F.col(status) == "Success")


def sheets(tables: dict[str, DataFrame], order: dict[str, str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Sheets by name as one table of strings, missing cells empty, with row_index, a row's number from 1 in its sheet by ``order``; of each ``limit`` rows after ``skip``."""
    out = None
    for name, rows in tables.items():
        # Rows are numbered within ranges of a number that they are ordered by, which are counted first, so that no task has a whole sheet.
        place = F.col(order[name])
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = sorted(set(rows.select(place.cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n)))
        part = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= place.cast("double"))) if bounds else F.lit(0)
        placed = rows.withColumn("__p", part)
        counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
        before = counts.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__b")
        own = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(place, *rows.columns)))
        own = own.join(F.broadcast(before), "__p").withColumn("row_index", (F.col("__b") + F.col("__i")).cast("bigint"))
        own = own.filter(F.col("row_index") > skip) if limit is None else own.filter(F.col("row_index").between(skip + 1, skip + limit))
        own = own.select(F.lit(name).alias("sheet"), "row_index", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.select("sheet", "row_index", *[F.coalesce(c, F.lit("")).alias(c) for c in out.columns[2:]])


def validity(files: DataFrame) -> DataFrame:
    """Path, valid (whether the content begins as a PDF does), version, page_count (by its page objects) and size of files (path, content)."""
    text = F.decode("content", "ISO-8859-1")
    valid = F.startswith(text, F.lit("%PDF-"))
    return files.select("path", F.coalesce(valid, F.lit(False)).alias("valid"), F.nullif(F.regexp_extract(text, r"\A%PDF-(\d\.\d)", 1), F.lit("")).alias("version"), F.when(valid, F.regexp_count(text, F.lit(r"/Type\s*/Page(?!s)"))).cast("int").alias("page_count"), F.length("content").cast("bigint").alias("size"))


#: Characters of a case number that are looked up in file names.
ANCHOR = 8


def resolved(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, year, month, pdf_filename, case_number) with path and strategy from ``listing`` (path: .../year/month/file).

    Strategy 1: the path itself; 2: a folder of the year whose name's first three letters begin the
    month; 3: a file of the year whose name holds the case number, commas left out. Of several paths
    the least by name. For strategy 3, the number's first ``ANCHOR`` characters, or as many as it has,
    are joined with as long pieces of the file names of its year; numbers of any length are then compared whole.
    """
    parts = F.split("path", "/")
    files = listing.select("path", F.element_at(parts, -3).alias("year"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"))
    wanted = rows.select(key, F.col("year").cast("string").alias("year"), F.trim("month").alias("month"), F.trim("pdf_filename").alias("file"), F.replace(F.trim("case_number"), F.lit(","), F.lit("")).alias("number"))
    exact = wanted.join(files, (wanted["year"] == files["year"]) & (wanted["month"] == files["folder"]) & (wanted["file"] == files["file"])).select(key, "path", F.lit(1).alias("strategy"))
    near = wanted.join(files, (wanted["year"] == files["year"]) & (wanted["file"] == files["file"]) & F.startswith(F.lower("month"), F.left(F.lower("folder"), F.lit(3)))).select(key, "path", F.lit(2).alias("strategy"))
    bare = F.replace("file", F.lit(","), F.lit(""))
    pieces = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.length("b")), lambda i: i <= F.length("b") - n + 1), lambda i: F.substring("b", i, F.lit(n)))
    anchored = wanted.filter("number <> ''").withColumn("anchor", F.left("number", F.lit(ANCHOR)))
    # Only pieces as long as an anchor that begin with a letter that one begins with; both are few, whatever the rows.
    kinds = anchored.select(F.length("anchor").alias("n"), F.left("anchor", F.lit(1)).alias("c")).distinct().collect()
    begun = {n: [r.c for r in kinds if r.n == n] for n in sorted({r.n for r in kinds})}
    none = F.array().cast("array<string>")
    begins = lambda cs: lambda x: F.left(x, F.lit(1)).isin(cs)
    every = F.explode(F.array_distinct(F.concat(none, *[F.filter(pieces(n), begins(cs)) for n, cs in begun.items()])))
    grams = files.select("path", "year", bare.alias("b")).filter("b <> ''").select("path", "year", "b", every.alias("anchor"))
    held = anchored.join(grams, ["year", "anchor"]).filter(F.contains("b", "number")).select(key, "path", F.lit(3).alias("strategy"))
    best = exact.union(near).union(held).groupBy(key).agg(F.min(F.struct("strategy", "path")).alias("b")).select(key, "b.path", "b.strategy")
    return rows.join(best, key, "left")


def first_urls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (case_id, document_type, pdf_url, and at, the rows' order) the first URL of each (case_id, brief_type), and all URLs of each case in order. Rows with a blank cell are left out."""
    clean = rows.select(*[F.trim(c).alias(c) for c in ("case_id", "document_type", "pdf_url")], "at").filter("case_id <> '' and document_type <> '' and pdf_url <> ''")
    kind = F.lower("document_type")
    typed = clean.withColumn("brief_type", F.when(kind.contains("reply"), "Reply").when(kind.contains("respondent"), "Response").when(kind.contains("appellant"), "Opening"))
    first = typed.filter("brief_type is not null").groupBy("case_id", "brief_type").agg(F.min_by("pdf_url", F.struct("at", "pdf_url")).alias("pdf_url"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "document_type", "pdf_url")))
    return first, clean.groupBy("case_id").agg(F.transform(ordered, lambda x: F.struct(x["document_type"].alias("document_type"), x["pdf_url"].alias("pdf_url"))).alias("urls"))


def _cut(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with g, each run of four characters of a text, or all of a shorter one."""
    at = rows.select(*{text: None, **dict.fromkeys(keep)}, F.explode(F.sequence(F.lit(1), F.greatest(F.length(text) - 3, F.lit(1)))).alias("__i"))
    return at.select(*keep, F.substring(text, F.col("__i"), F.lit(4)).alias("g"))


def _first_by_words(names: DataFrame, urls: DataFrame) -> DataFrame:
    """case_id, name and the least u of the case's URLs (case_id, url, u) that hold all but one of a name's words (case_id, name, w), and two at the least; only words of four characters or more count.

    Words are looked up by the run of four characters that the fewest of the case's URLs have, each once a
    case, so names without enough words that occur meet no URL. Of the others, each distinct set of words
    that leaves one out is looked up once a case by its rarest word.
    """
    each = names.select("case_id", "name", F.posexplode("w").alias("k", "word"))
    words = each.filter(F.length("word") > 3).select("case_id", "word").distinct()
    runs = _cut(words, "word", "case_id", "word")
    near = lambda rows, wanted: rows.join(F.broadcast(wanted.select("g").distinct()), "g", "left_semi")  # noqa: E731  runs of four characters are few
    counts = near(_cut(urls, "url", "case_id"), runs).groupBy("case_id", "g").agg(F.count("*").alias("n"))
    rarest = runs.join(counts, ["case_id", "g"], "left").groupBy("case_id", "word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0")
    met = each.join(rarest, ["case_id", "word"], "left").groupBy("case_id", "name").agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "word", "k"))).alias("there"))
    left_out = F.when(F.size("there") < F.col("size"), F.array(F.lit(-1))).when(F.col("size") == 2, F.array(F.lit(-1))).otherwise(F.transform("there", lambda x: x["k"]))
    sets = met.filter((F.size("there") >= 2) & (F.size("there") >= F.col("size") - 1)).select("case_id", "name", "there", F.explode(left_out).alias("out"))
    sets = sets.select("case_id", "name", F.filter("there", lambda x: x["k"] != F.col("out")).alias("there"))
    sets = sets.select("case_id", "name", F.array_sort(F.array_distinct(F.transform("there", lambda x: x["word"]))).alias("set"), F.array_min(F.transform("there", lambda x: x["r"]))["g"].alias("g"))
    asked = sets.select("case_id", "set", "g").distinct()
    held = near(_cut(urls, "url", "case_id", "url", "u"), asked).join(asked, ["case_id", "g"]).filter(F.forall("set", lambda w: F.contains(F.col("url"), w)))
    return sets.join(held.groupBy("case_id", "set").agg(F.min("u").alias("u")), ["case_id", "set"]).groupBy("case_id", "name").agg(F.min("u").alias("u"))


def matched_urls(briefs: DataFrame, rows: DataFrame) -> DataFrame:
    """``briefs`` (brief_id, source_file, case_id, brief_type) with url and strategy: 1 by case and type, 2 by words of the file's name in the case's URLs, 3 the case's first URL.

    A case's first URL, and the first of each kind that names may ask for, are found once a case. All words
    of a name but one at the most have to be in a URL, so each distinct set of words that leaves one out is
    looked up once a case: no brief meets all URLs.
    """
    clean = rows.select(*[F.trim(c).alias(c) for c in ("case_id", "document_type", "pdf_url")], "at").filter("case_id <> '' and document_type <> '' and pdf_url <> ''")
    own = clean.select("case_id", "document_type", F.lower(F.coalesce(F.try_url_decode("pdf_url"), "pdf_url")).alias("url"), F.struct("at", "document_type", "pdf_url").alias("u"))
    kind, url = F.lower("document_type"), F.col("url")
    typed = F.when(kind.contains("reply"), "Reply").when(kind.contains("respondent"), "Response").when(kind.contains("appellant"), "Opening")
    first = own.select("case_id", typed.alias("brief_type"), F.struct("u.at", "u.pdf_url").alias("u")).filter("brief_type is not null").groupBy("case_id", "brief_type").agg(F.min("u").alias("__first"))
    kinds = {
        "__amended": url.contains("amended") & url.contains("appellant"),
        "__crossed": url.contains("cross-appellant") | url.contains("cross appellant"),
        "__answered": url.contains("respondent") & url.contains("cross"),
    }
    by_case = own.groupBy("case_id").agg(F.min("u").alias("__any"), *[F.min(F.when(test, F.col("u"))).alias(c) for c, test in kinds.items()])

    name = F.lower(F.replace(F.regexp_replace("source_file", r"\.(?:pdf|PDF)$", ""), F.lit("_"), F.lit(" ")))
    named = briefs.withColumn("__name", name)
    names = named.select("case_id", F.col("__name").alias("name")).filter("case_id is not null and name is not null").distinct().withColumn("w", F.split("name", r"\s+"))
    shared = _first_by_words(names, own.select("case_id", "url", "u")).select("case_id", F.col("name").alias("__name"), F.col("u").alias("__shared"))

    met = named.join(first, ["case_id", "brief_type"], "left").join(by_case, "case_id", "left").join(shared, ["case_id", "__name"], "left")
    asks = F.col("__name")
    second = F.array_min(F.array_compact(F.array(
        F.when(asks.contains("amended") & asks.contains("appellant"), F.col("__amended")),
        F.when(asks.contains("cross-appellant"), F.col("__crossed")),
        F.when(asks.contains("respondent") & asks.contains("cross"), F.col("__answered")),
        F.col("__shared"),
    )))["pdf_url"]
    one, third = F.col("__first")["pdf_url"], F.col("__any")["pdf_url"]
    found = met.withColumns({"url": F.coalesce(one, second, third), "strategy": F.when(one.isNotNull(), 1).when(second.isNotNull(), 2).when(third.isNotNull(), 3)})
    return found.select(*briefs.columns, "url", "strategy")


def load_metadata(rows: DataFrame) -> DataFrame:
    """A metadata table's columns by the names of the load, publication_status from file_contains."""
    names = {"case_number": "case_file_id", "case_title": "title", "division": "division", "opinion_type": "opinion_type", "month": "decision_month", "file_date": "file_date", "case_info_url": "case_info_url", "pdf_url": "source_url", "pdf_filename": "source_file", "file_contains": "file_contains", "download_status": "download_status"}
    status = F.when(F.col("file_contains").contains("Unpublished"), "Unpublished").otherwise("Published")
    return rows.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in names.items()], F.trim(F.col("year").cast("string")).try_cast("int").alias("decision_year"), status.alias("publication_status"))


def briefs(files: DataFrame) -> DataFrame:
    """Files with what their paths say."""
    return files.withColumn("brief", brief_file(F.col("path")))


def text_columns(rows: DataFrame) -> list[str]:
    """S15."""
    return [c for c, kind in rows.dtypes if kind == "string"]


def report(rows: DataFrame, path: str, first: list[str]) -> None:
    """A CSV with the given columns first, then the rest by name."""
    rows.select(*first, *sorted(c for c in rows.columns if c not in first)).write.mode("overwrite").option("header", True).csv(path)


def summary(rows: DataFrame, **metrics: Column) -> DataFrame:
    """One row with the metrics as JSON."""
    return rows.agg(F.to_json(F.struct(*[m.alias(k) for k, m in metrics.items()])).alias("report"))


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Writes whole partitions in place of those with the same values; a failed job leaves the old ones."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
