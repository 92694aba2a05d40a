"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned too: words and word beginnings that labelled toxic texts hold and others
hardly do. It is counted by aggregation over the labelled sample, less the rows that calibrate; only
the entries chosen, which so large a sample bounds, and one row of features for each sampled text
reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._boost import Boosted, Isotonic
from lexweave.llm._features import NAMES, SECOND_PERSON, fold, labelled_sample, terms, tone, word_hash
from lexweave.llm._text import Powers, pieces, texts
from lexweave.llm._work import dropped, table, text_batches, written

#: Labelled texts learned from, at most: those with the least hash of their id.
SAMPLE = 20_000
#: Of the texts that hold an entry, this share is toxic at least; and the log-likelihood ratio of that count is so high that chance hardly makes one such term in a hundred million.
SHARE, RATIO = 0.8, 30.0
THRESHOLD = 0.3
#: Of 16 folds of a labelled sample, by the checksum of the id as text, those from this one on calibrate; folds modulo 4 cut across.
CALIBRATES = 12


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, y0) to (term, texts labelled 1, other texts) of each batch."""
    powers = Powers()
    for batch in batches:
        raw, off = texts(batch.column(1))
        toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        found: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for lo, hi in pieces(off):
            at = off[lo : hi + 1]
            kinds, _, _, first = terms(raw[at[0] : at[-1]], at - at[0], powers)
            for i in range(hi - lo):
                own = np.unique(np.concatenate([h[first[i] : first[i + 1]] for h in kinds]))
                found[bool(toxic[lo + i])].append(own[own != 0])
        both = {k: np.unique(np.concatenate([np.zeros(0, np.uint64), *v]), return_counts=True) for k, v in found.items()}
        term = np.concatenate([both[True][0], both[False][0]])
        count = [np.concatenate([both[True][1], np.zeros(len(both[False][0]), np.int64)]), np.concatenate([np.zeros(len(both[True][0]), np.int64), both[False][1]])]
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), *map(pa.array, count)], ["term", "pos", "neg"])


def lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights (log odds) of the terms that mark texts with y0 = 1; copies of a text count once."""
    texts_ = sample.select("id", "text", "y0").dropDuplicates(["text", "y0"])
    share = texts_.agg(F.avg("y0")).first()[0]
    if not share or share == 1:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = texts_.mapInArrow(_term_counts, "term bigint, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg, n = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    ratio = 2 * (pos * F.log(pos / (n * share)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - share)))).otherwise(0.0))
    rows = counts.filter((pos > 0) & (pos >= SHARE * n) & (ratio >= RATIO)).collect()
    h = np.array([r.term for r in rows], np.int64).view(np.uint64)
    weight = np.log([(r.pos + 0.5) / (r.neg + 0.5) for r in rows]) if rows else np.zeros(0)
    order = np.argsort(h)
    return h[order], np.asarray(weight)[order]


def tones(entries: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Features of the texts in column 1 of each batch."""
    powers = Powers()
    second = np.array(sorted(word_hash(w) for w in SECOND_PERSON), np.uint64)
    for batch in batches:
        raw, off = texts(batch.column(1))
        rows = [tone(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], *entries, powers, second) for lo, hi in pieces(off)]
        yield batch, np.vstack([np.zeros((0, len(NAMES))), *rows])


def sample_features(sample: DataFrame, entries: tuple[np.ndarray, np.ndarray], labels: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The features, labels and ids of a bounded sample, in the order of its ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in tones(entries, it):
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(labels)], pa.array([r.tobytes() for r in x], pa.binary())], ["id", *[f"y{i}" for i in range(labels)], "x"])

    ys = [f"y{i}" for i in range(labels)]
    rows = sample.select("id", "text", *ys).mapInArrow(run, f"id string, {''.join(f'{y} int, ' for y in ys)}x binary").toPandas().sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(rows.x), np.float64).reshape(len(rows), len(NAMES))
    return x, rows[ys].to_numpy(), rows["id"].to_numpy()


class Model:
    """A fitted scorer; ``calls`` gives probabilities for rows of features. The rows of ``held`` calibrate, the others are learned from."""

    def __init__(self, entries: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.entries = entries
        if held.sum() < 20 or held.all():  # too few to hold any back
            held = np.ones(len(y), bool)
        self.trees = Boosted().fit(*((x, y) if held.all() else (x[~held], y[~held])))
        self.calibrated = Isotonic().fit(self.trees.raw(x[held]), y[held])

    def calls(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        # A little of the uncalibrated score keeps the order within flat parts.
        return np.clip(0.98 * self.calibrated(raw) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows (at most ``sample`` of them). Rows with a null id or label aren't learned from; with none every score is near 0."""
    rows = written(labelled_sample(docs, labels, id_col, text_col, [label_col], sample), docs.sparkSession)
    n = rows.count()
    entries = lexicon(rows.filter(fold("id", 16) < CALIBRATES) if n >= 80 else rows)
    x, y, ids = sample_features(rows, entries)
    dropped(rows)
    return Model(entries, x, y[:, 0], np.array([zlib.crc32(i.encode()) % 16 >= CALIBRATES for i in ids], bool))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text, but with ``keep_text``) with a column ``name``: the probability of label 1, for null and empty texts too.

    One row per input row; repeated rows get equal scores, an empty table gives none, and a column of
    the same name is replaced.
    """
    text_batches(docs.sparkSession)
    fields = [f for f in docs.columns if f != name and (f != text_col or keep_text)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def two(it):
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["rest", "text"])

        for batch, x in tones(model.entries, two(it)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.calls(x))], ["rest", name])

    rest = docs.select(F.struct(*[F.col(f"`{f}`") for f in fields]).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rest.schema["rest"], T.StructField(name, T.DoubleType())])
    return rest.mapInArrow(run, schema).select("rest.*", name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held: Column = fold("doc_id", 4) == 2
    model = fit(docs, labels.filter(~held))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
