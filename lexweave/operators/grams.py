"""A stored index of trigrams: texts alike or holding a piece of text, found without reading the others."""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.search import trigrams
from lexweave.sources.snapshots import Snapshots

#: Folders by the hash of a trigram; changing it takes a new index.
BUCKETS = 64
_WORD = re.compile(r"[^\W_]+")


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def grams_of(text: str) -> list[str]:
    """The distinct trigrams of a query's words, as ``trigrams`` gives them."""
    padded = (f"  {w} " for w in _WORD.findall(text.lower()))
    return sorted({w[i : i + 3] for w in padded for i in range(len(w) - 2)})


def grams_within(piece: str) -> list[str]:
    """The trigrams that every text has that holds ``piece``: of its words, padded only where the piece itself shows that they end."""
    low, out = piece.lower(), set()
    for m in _WORD.finditer(low):
        w = ("  " if m.start() else "") + m[0] + (" " if m.end() < len(low) else "")
        out |= {w[i : i + 3] for i in range(len(w) - 2)}
    return sorted(out)


class TrigramIndex:
    """Rows (id, text) with an id of their own; rows whose text is null aren't kept. Added rows are a segment of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    def add(self, rows: DataFrame) -> None:
        rows = rows.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text")
        grams = rows.select("id", F.explode(F.array(trigrams(F.col("text")))).alias("g")).select("id", F.size("g").alias("n"), F.explode("g").alias("gram"))
        of = (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int")
        n = max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        with self.store.change() as made:
            made.append("grams", grams.withColumn("bucket", of).repartitionByRange(n, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id"), "bucket")
            made.append("texts", rows.repartitionByRange(n, "id").sortWithinPartitions("id"))

    def _postings(self, grams: list[str]) -> DataFrame:
        return self.store.read("grams").filter(F.col("bucket").isin(sorted({bucket(g) for g in grams})) & F.col("gram").isin(grams))

    def similar(self, text: str, above: float = 0.3) -> DataFrame:
        """Id, similarity of the texts whose trigrams are alike by more than ``above``, from 0 up.

        Of n and m trigrams, s shared ones make s / (n + m - s); so only texts of more than ``above`` n and
        fewer than n / ``above`` trigrams are counted, and no text is read.
        """
        own = grams_of(text)
        if not own:
            return self.store.read("texts").select("id", F.lit(0.0).alias("similarity")).limit(0)
        n = len(own)
        near = self._postings(own).filter((F.col("n") > math.floor(above * n)) & (F.col("n") < math.ceil(n / above) if above else F.lit(True)))
        shared = near.groupBy("id").agg(F.count("*").alias("s"), F.first("n").alias("m"))
        return shared.select("id", (F.col("s") / (F.col("m") + n - F.col("s"))).alias("similarity")).filter(F.col("similarity") > above)

    def containing(self, piece: str) -> DataFrame:
        """Id, text of the texts that hold ``piece``, whatever the letters' case. A piece too short to have trigrams is looked for in all."""
        texts, own = self.store.read("texts"), grams_within(piece)
        if own:
            found = self._postings(own).groupBy("id").agg(F.count("*").alias("s")).filter(F.col("s") == len(own)).select("id")
            texts = texts.join(found, "id", "left_semi")
        return texts.filter(F.contains(F.lower("text"), F.lower(F.lit(piece))))
