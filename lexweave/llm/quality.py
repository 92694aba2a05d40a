"""Quality scores by nearest neighbours among labelled latent-semantic vectors.

Texts become rates of their terms, hashed into buckets, and of neighbouring byte classes and of
repeated words and lines, weighted by how rare each is among the labelled texts; a truncated
singular value decomposition of the labelled rows gives the latent space. The labelled vectors,
``NEIGHBOURS`` at most of ``RANK`` numbers each, are broadcast with the basis, and every document
meets all of them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._features import TERMS, WIDTH, fold, labelled_sample, term_vectors
from lexweave.llm._text import pieces, texts
from lexweave.llm._work import table, text_batches

#: Labelled texts that vote, at most: those with the least hash of their id.
NEIGHBOURS = 4_000
RANK = 32
#: Votes are weighted by exp(SHARP * (cosine - best cosine)), over the TOP neighbours.
TOP, SHARP = 40, 40.0
#: The variance of terms over that of byte classes and repeats in the latent space's input.
TERM_SHARE = 0.5
#: Documents that meet the labelled vectors at a time.
BLOCK = 256
THRESHOLD = 0.3
#: Bytes of text whose class counts are held at a time.
PIECE = 1 << 19


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    raw, off = texts(column)
    for lo, hi in pieces(off, PIECE):
        for a in range(lo, hi, 512):
            b = min(hi, a + 512)
            yield term_vectors(raw[off[a] : off[b]], off[a : b + 1] - off[a])


class Latent:
    """Weights and basis fitted on rows of shapes; ``project`` gives unit vectors."""

    def fit(self, x: np.ndarray) -> Latent:
        n = len(x)
        self.weight = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 0.3).astype(np.float32)
        # The terms together weigh TERM_SHARE of the rest, or their number would decide alone.
        spread = (x * self.weight).var(axis=0)
        terms, rest = float(spread[:TERMS].sum()), float(spread[TERMS:].sum())
        if terms > 0 and rest > 0:
            self.weight[:TERMS] *= (TERM_SHARE * rest / terms) ** 0.5
        self.centre = (x * self.weight).mean(axis=0)
        z = x * self.weight - self.centre
        # The leading vectors of z'z: the decomposition of the labelled rows, whatever their number.
        _, v = np.linalg.eigh((z.T @ z).astype(np.float64))
        self.basis = np.ascontiguousarray(v[:, ::-1][:, :RANK].astype(np.float32))
        return self

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight - self.centre) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


class Voters:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.latent = Latent().fit(x) if len(x) else None
        self.points = np.ascontiguousarray(self.latent.project(x).T.astype(np.float32)) if len(x) else None
        self.y = y.astype(np.float32)

    def calls(self, x: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the most similar labelled texts."""
        if self.latent is None:
            return np.full(len(x), 0.5)
        out = np.zeros(len(x))
        top = min(TOP, len(self.y))
        for lo in range(0, len(x), BLOCK):
            cosine = self.latent.project(x[lo : lo + BLOCK]).astype(np.float32) @ self.points
            at = np.argpartition(cosine, len(self.y) - top, axis=1)[:, -top:]
            near = np.take_along_axis(cosine, at, axis=1)
            weight = np.exp(SHARP * (near - near.max(axis=1, keepdims=True)))
            out[lo : lo + BLOCK] = (weight * self.y[at]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = NEIGHBOURS) -> Voters:
    """Learns from labelled rows (at most ``sample`` of them). Rows with a null id or label aren't learned from; with none every score is 0.5."""
    rows = labelled_sample(docs, labels, id_col, text_col, [label_col], sample)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.vstack([np.zeros((0, WIDTH), np.float32), *_rows(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["id", "y0", "x"])

    got = rows.select("id", "text", "y0").mapInArrow(run, "id string, y0 int, x binary").toPandas().sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), WIDTH).astype(np.float32)
    return Voters(x, got.y0.to_numpy())


def scored(docs: DataFrame, model: Voters, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without the text, with a column ``name``: the probability of label 1, for null and empty texts too.

    One row per input row; repeated rows get equal scores, an empty table gives none, and a column of
    the same name is replaced.
    """
    text_batches(docs.sparkSession)
    fields = [f for f in docs.columns if f not in (text_col, name)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            calls = np.concatenate([np.zeros(0), *[model.calls(x.astype(np.float16).astype(np.float32)) for x in _rows(batch.column(1))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calls)], ["rest", name])

    rest = docs.select(F.struct(*[F.col(f"`{f}`") for f in fields]).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rest.schema["rest"], T.StructField(name, T.DoubleType())])
    return rest.mapInArrow(run, schema).select("rest.*", name)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, voted by the labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held: Column = fold("doc_id", 5) == 0
    model = fit(docs, labels.filter(~held))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
