"""A stored positional inverted index of documents: words' places by bucket, searched without the texts.

Postings are kept in folders by a hash of the word, and sorted by word within their files, so a query
reads only its words' folders and there only what may hold them. Added documents become a segment;
documents that go are named, and their postings are passed over until ``merge`` leaves them out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.search import boolean_query
from lexweave.operators.text import tokens
from lexweave.sources.snapshots import Change, Snapshots

#: Folders by the hash of a word; changing it takes a new index.
BUCKETS = 64
#: Deleted documents that are sent to all executors; beyond it, they are joined by shuffles.
SENT = 500_000


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _less(k: int) -> Callable[[Column], Column]:
    return lambda place: place - k


def _marked(k: int) -> Callable[[Column], Column]:
    return lambda place: F.struct(place.alias("place"), F.lit(k).alias("word"))


class InvertedIndex:
    """Documents (id, text), one row each; a null text or id isn't kept. An id that is added again takes the place of the earlier document."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    def _segment(self, made: Change, docs: DataFrame) -> None:
        number = made.base + 1
        rows = docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.explode(F.array(tokens(F.col("text")))).alias("w"))
        # Places of a word in a document are gathered in its row: words are sorted with their places, and cut where the word changes.
        pairs = F.sort_array(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("place"))))
        placed = rows.select("id", F.explode(F.array(pairs)).alias("p")).filter(F.size("p") > 0)
        begins = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["word"] != F.get("p", i - 1)["word"]))
        runs = placed.select("id", F.col("p.word").alias("ws"), F.col("p.place").alias("at"), F.explode(F.array(begins)).alias("b"))
        each = F.transform("b", lambda i, k: F.struct(F.get("ws", i).alias("word"), F.slice("at", i + 1, F.coalesce(F.get("b", k + 1), F.size("at")) - i).alias("places")))
        n = max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        of = (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int")
        postings = runs.select("id", F.inline(each)).select("word", "id", "places")
        # Buckets and segments are the same for many rows, so they are put to them after the shuffle.
        sorted_ = postings.repartitionByRange(n, of, "word", "id").select("*", F.lit(number).alias("segment"), of.alias("bucket"))
        made.append("postings", sorted_.sortWithinPartitions("bucket", "word", "id"), "bucket")
        made.append("lengths", rows.select("id", F.size("w").alias("length"), F.size(F.array_distinct("w")).alias("words"), F.lit(number).alias("segment")))

    def add(self, docs: DataFrame) -> None:
        """Adds documents in one change; readers see all of them or none."""
        with self.store.change() as made:
            if made.tables:
                made.append("gone", docs.select("id", F.lit(made.base + 1).alias("before")).filter("id IS NOT NULL").distinct())
            self._segment(made, docs)

    def remove(self, ids: DataFrame) -> None:
        """Takes documents (id) out."""
        with self.store.change() as made:
            made.append("gone", ids.select("id", F.lit(made.base + 1).alias("before")).filter("id IS NOT NULL").distinct())

    def merge(self) -> None:
        """Writes all segments as one, without what is gone."""
        with self.store.change() as made:
            for table, by, order in (("postings", ("bucket",), ("bucket", "word", "id")), ("lengths", (), ("id",))):
                live = self._live(self.store.read(table, made.base), made.base)
                rows = live.repartitionByRange(max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
                made.replace(table, rows.withColumn("segment", F.lit(made.base + 1)), *by)
            made.tables.pop("gone", None)

    def _live(self, rows: DataFrame, version: int) -> DataFrame:
        if not self.store.has("gone", version):
            return rows
        gone = self.store.read("gone", version).groupBy("id").agg(F.max("before").alias("before")).select(F.col("id").alias("__id"), "before")
        # Most segments are all there or all gone, which their documents tell: only the others' rows are compared with what is gone.
        met = self.store.read("lengths", version).join(gone, F.col("id") == F.col("__id"), "left")
        dead = F.coalesce(F.col("segment") < F.col("before"), F.lit(False))
        kinds = {r.segment: r.dead and (r.dead == r.n or None) for r in met.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(dead).alias("dead")).collect()}
        whole, part = [s for s, d in kinds.items() if d == 0], [s for s, d in kinds.items() if d is None]
        there = rows.filter(F.col("segment").isin(whole))
        if not part:
            return there
        gone = F.broadcast(gone) if gone.count() <= SENT else gone
        return there.unionByName(rows.filter(F.col("segment").isin(part)).join(gone, (F.col("id") == F.col("__id")) & (F.col("segment") < F.col("before")), "left_anti"))

    def postings(self, words: list[str], version: int | None = None) -> DataFrame:
        """word, id, places of the words, which are lower-cased tokens."""
        version = self.store.latest() if version is None else version
        rows = self.store.read("postings", version).filter(F.col("bucket").isin(sorted({bucket(w) for w in words})) & F.col("word").isin(sorted(set(words))))
        return self._live(rows, version).select("word", "id", "places")

    def lengths(self, version: int | None = None) -> DataFrame:
        """id, length in tokens and number of distinct words of each document."""
        version = self.store.latest() if version is None else version
        return self._live(self.store.read("lengths", version), version).select("id", "length", "words")

    def _by_document(self, words: list[str]) -> DataFrame:
        """id and w0, w1, ...: the words' places, null where a document lacks one."""
        distinct = list(dict.fromkeys(words))
        return self.postings(distinct).groupBy("id").agg(*[F.first(F.when(F.col("word") == w, F.col("places")), ignorenulls=True).alias(f"w{k}") for k, w in enumerate(distinct)])

    def holding(self, words: list[str]) -> DataFrame:
        """Id of the documents with all the words; none of a query without words."""
        own = sorted({w.lower() for w in words if w.strip()})
        if not own:
            return self.lengths().select("id").limit(0)
        return self.postings(own).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(own)).select("id")

    def phrase(self, words: list[str], followed: int = 0) -> DataFrame:
        """Id, start of each place (from 0) where the words follow each other, and ``followed`` more come after them."""
        low = [w.lower() for w in words]
        if not low:
            return self.lengths().select("id", F.lit(0).alias("start")).limit(0)
        name = {w: f"w{k}" for k, w in enumerate(dict.fromkeys(low))}
        rows = self._by_document(low).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in name.values()]))
        begins = [F.transform(name[w], _less(k)) for k, w in enumerate(low)]
        found = rows.select("id", F.explode(reduce(F.array_intersect, begins)).alias("start"))
        if not followed:
            return found
        return found.join(self.lengths(), "id").filter(F.col("start") + len(low) + followed <= F.col("length")).select("id", "start")

    def boolean(self, query: str) -> DataFrame:
        """Id of the documents that a query of words, &, |, ! and parentheses holds of. Documents with none of the words count too."""
        words = sorted({w.lower() for w in re.findall(r"[^\s&|!()]+", query)})
        if not words:
            raise ValueError(f"a query needs words: {query!r}")
        found = self.postings(words).groupBy("id").agg(F.collect_set("word").alias("w"))
        test = boolean_query(query, F.coalesce("w", F.array().cast("array<string>")))
        return self.lengths().join(found, "id", "left").filter(test).select("id")

    def bm25(self, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """Id, score of the documents with any of the words, by Okapi BM25 over the documents that are there."""
        own = sorted({w.lower() for w in words})
        lengths = self.lengths()
        totals = F.broadcast(lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")))
        found = self.postings(own).select("word", "id", F.size("places").alias("tf"))
        df = F.broadcast(found.groupBy("word").agg(F.count("*").alias("df")))  # a row for each word of the query
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        term = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return found.join(lengths, "id").join(df, "word").crossJoin(totals).groupBy("id").agg(F.sum(term).alias("score"))

    def cover_density(self, words: list[str], weight: float = 0.1, normal: int = 0) -> DataFrame:
        """Id, score of the documents with all the words: each least stretch that holds them all counts ``weight`` over one and the places in it that hold none.

        Flags of ``normal``: 1 divides by one and the logarithm of the length, 2 by the length, 8 by the
        number of distinct words, 16 by one and its logarithm, 32 makes x to x / (x + 1).
        """
        own = sorted({w.lower() for w in words})
        rows = self._by_document(own).filter(reduce(lambda a, c: a & c, [F.col(f"w{k}").isNotNull() for k in range(len(own))]))
        merged = F.array_sort(F.concat(*[F.transform(f"w{k}", _marked(k)) for k in range(len(own))]))
        none = F.lit(-1)
        start = F.struct(F.array(*[none] * len(own)).alias("last"), none.alias("first"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"))

        def sweep(s: Column, x: Column) -> Column:
            last = F.transform(s["last"], lambda v, k: F.when(k == x["word"], s["at"]).otherwise(v))
            first = F.array_min(last)  # the stretch that ends here begins with it
            noise = (x["place"] - F.get(F.col("merged"), first)["place"]) - (s["at"] - first)
            gain = F.when(first > s["first"], F.lit(weight) / (1 + noise)).otherwise(0.0)
            return F.struct(last.alias("last"), F.greatest(first, s["first"]).alias("first"), (s["sum"] + F.coalesce(gain, F.lit(0.0))).alias("sum"), (s["at"] + 1).alias("at"))

        # As a row of its own, so that places aren't merged again for each of them.
        scored = rows.select("id", F.explode(F.array(merged)).alias("merged")).select("id", F.aggregate("merged", start, sweep, lambda s: s["sum"]).alias("score"))
        if not normal:
            return scored
        met, score = scored.join(self.lengths(), "id"), F.col("score")
        for flag, by in ((1, 1 + F.log(F.col("length").cast("double"))), (2, F.col("length")), (8, F.col("words")), (16, 1 + F.log(F.col("words").cast("double")))):
            score = score / by if normal & flag else score
        return met.select("id", (score / (score + 1) if normal & 32 else score).alias("score"))

    def prefixed(self, prefix: str, k: int) -> DataFrame:
        """The k words of most places that begin with ``prefix``, equal ones by name: word, n."""
        version = self.store.latest()
        rows = self._live(self.store.read("postings", version).filter(F.startswith("word", F.lit(prefix.lower()))), version)
        return rows.groupBy("word").agg(F.sum(F.size("places")).alias("n")).orderBy(F.desc("n"), "word").limit(k)
