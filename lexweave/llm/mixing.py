"""Mixing to target weights with soft membership.

A softmax classifier fitted on the labelled table gives each document posteriors over domains.
Nonnegative document rates x then minimise the squared distance between the expected tokens of each
domain, sum(x * tokens * posterior), and the targets. Each step of the projected gradient is one
aggregation of a few sums over all documents; the domains' Gram matrix over documents with a
positive rate scales the step. A document's rate after m steps is a closed expression of its
posteriors, so no step writes a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import toxicity
from lexweave.llm._features import NAMES, SECOND_PERSON, labelled_sample, word_hash
from lexweave.llm._text import SPACE, Powers, pieces, texts, words
from lexweave.llm._work import dropped, table, text_batches, written

#: Labelled texts learned from, at most: those with the least hash of their id.
SAMPLE = 10_000
DOMAINS = ("high", "low", "toxic")
#: Shares of tokens by domain.
TARGETS = (0.90, 0.07, 0.03)
#: The first domain's tokens are wanted this many times, so that its documents have a rate of 1 or more.
HEADROOM = 1.05
#: A residual of this share of all tokens is none, and a step that lowers its square by less than this share of it is the last.
ENOUGH, SLIGHT = 1e-6, 1e-4
#: Signs whose rates, besides the tone, tell domains apart. Fixed values.
SIGNS = b"|#&$*%!.,\n"
WIDTH = len(NAMES) + len(SIGNS) + 2


def _features(entries: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch, powers: Powers, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and word counts of the texts in column 1."""
    from lexweave.llm._features import tone

    raw, off = texts(batch.column(1))
    rows, tokens = [np.zeros((0, WIDTH))], [np.zeros(0, np.int64)]
    for lo, hi in pieces(off):
        own, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        n, length = hi - lo, np.maximum(np.diff(at), 1)
        x = tone(own, at, *entries, powers, second)
        h, _, _, first = words(own, at, SPACE)
        signs = []
        for c in SIGNS:
            total = np.concatenate([[0], np.cumsum(own == c)])
            signs.append(np.log1p(1000 * (total[at[1:]] - total[at[:-1]]) / length))
        count = np.diff(first)
        # The share of words that stand at the same place of the text's other half, and repeats of a word in a row.
        owner = np.repeat(np.arange(n), count)
        twice = np.zeros(len(h), bool)
        twice[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        rows.append(np.column_stack([x, *signs, np.bincount(owner[twice], minlength=n) / np.maximum(count, 1), 1 - distinct / np.maximum(count, 1)]))
        tokens.append(count)
    return np.vstack(rows), np.concatenate(tokens)


class Softmax:
    """Multinomial regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, ridge: float = 1e-3):
        self.classes = classes
        self.mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
        self.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(WIDTH)
        z, one = self._inputs(x), np.eye(classes)[y]
        self.w = np.zeros((z.shape[1], classes))
        step, past = len(z) / max((z**2).sum(), 1.0) * 2.0, self.w
        for k in range(steps if len(z) else 0):
            ahead = self.w + k / (k + 3) * (self.w - past)
            p = self._soft(z @ ahead)
            past, self.w = self.w, ahead - step * z.shape[1] ** 0.5 * (z.T @ (p - one) / len(z) + ridge * ahead)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(z), 1)), z, z**2 / 4])

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self._inputs(x) @ self.w)


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, label_id: str | None = None) -> DataFrame:
    """id, tokens, p (one posterior for each of DOMAINS), learned from ``labels`` (quality, toxic, and ``label_id``, which is ``id_col`` if not given)."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = written(labelled_sample(docs, labels.withColumnRenamed(label_id or id_col, id_col), id_col, text_col, ["toxic", "quality"], sample), spark)
    entries = toxicity.lexicon(rows)

    you = np.array(sorted(word_hash(w) for w in SECOND_PERSON), np.uint64)

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in it:
            x, _ = _features(entries, batch, powers, you)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y0", "y1", "x"])

    got = rows.select("id", "text", "y0", "y1").mapInArrow(learn, "id string, y0 int, y1 int, x binary").toPandas().sort_values("id", kind="stable")
    dropped(rows)
    x = np.frombuffer(b"".join(got.x), np.float64).reshape(len(got), WIDTH)
    y = np.where(got.y0 == 1, 2, np.where(got.y1 == 1, 0, 1)).astype(np.int64)
    model = Softmax(x, y, len(DOMAINS))

    def call(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in it:
            x, tokens = _features(entries, batch, powers, you)
            p = model(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), lists], ["id", "tokens", "p"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return source.mapInArrow(call, schema)


def rates(members: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float | None = None, whole: str | None = None) -> DataFrame:
    """``members`` (tokens, p, which are read again in each step) with rate, the fitted nonnegative rate, and residual.

    Expected tokens of domain k are to be targets[k] * budget; the budget by default gives the first
    domain HEADROOM times its tokens. A domain that has no tokens can't be met; ``residual`` is what
    is missed, the root of the squares summed, as a share of all tokens. With ``whole``, a boolean
    column, its rows have a rate of 1 and no other row a higher one.

    With G the Gram matrix of the rows whose rate is free and above 0, and ``miss`` what the expected
    tokens are beyond the targets, a step takes p . (G + damp)^-1 miss off each rate and projects onto
    the rates allowed. Where that changes nothing, y = (G + damp)^-1 miss is orthogonal to all free p,
    so G y = 0 and miss = damp * y: the gradient, p . miss times the tokens, is 0 for free rates and
    points outwards for the others, which is the least-squares optimum, met targets or not. Damping
    falls after a step that helps and rises after one that doesn't, until neither changes anything.
    """
    free = F.lit(True) if whole is None else ~F.col(whole)
    k = len(targets)
    share = [F.col("p")[i] for i in range(k)]
    have = members.agg(*[F.coalesce(F.sum(F.col("tokens") * share[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
    total = max(sum(have), 1.0)
    budget = HEADROOM * have[0] / targets[0] if budget is None else budget
    want = np.array(targets) * budget / total
    rate: Column = F.lit(1.0)
    best, least, gain, damp = rate, np.inf, np.inf, 1e-3
    while damp < 1e6:
        # Sums of expected tokens, and the Gram matrix of the documents whose rate isn't held at 0 or kept at 1.
        rated = members.select(rate.alias("x"), "tokens", free.alias("free"), *[share[i].alias(f"p{i}") for i in range(k)]).withColumn("t", F.when(F.col("free") & (F.col("x") > 0), F.col("tokens")).otherwise(0))
        cells = [F.sum(F.col("t") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
        sums = rated.agg(*[F.coalesce(c, F.lit(0.0)) for c in [*[F.sum(F.col("x") * F.col("tokens") * F.col(f"p{i}")) for i in range(k)], *cells]]).first()
        off = np.array(sums[:k]) / total - want
        if (off**2).sum() < least:
            gain = least - (off**2).sum()
            best, least, miss, gram, damp = rate, (off**2).sum(), off, np.array(sums[k:]).reshape(k, k) / total, max(damp / 10, 1e-8)
            if gain < SLIGHT * least:
                break
        else:
            damp *= 100
        if least < ENOUGH**2:
            break
        toward = np.linalg.solve(gram + damp * max(np.trace(gram), 1e-12) * np.eye(k), miss)
        rate = F.greatest(F.lit(0.0), best - sum((share[i] * F.lit(float(toward[i])) for i in range(k)), F.lit(0.0)))
        if whole is not None:
            rate = F.when(free, F.least(F.lit(1.0), rate)).otherwise(F.lit(1.0))
    return members.withColumn("rate", best).withColumn("residual", F.lit(float(least**0.5)))


def _copies(*of: Column) -> Column:
    """The rate rounded to a neighbouring whole number by the hash of the columns given."""
    unit = F.pmod(F.xxhash64(*of, F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + unit).cast("bigint")


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """id, tokens, p, rate, residual (see ``rates``) and copies (rate rounded to a neighbouring whole number by the hash of the id).

    One row per input row. Null, empty and wordless texts have no tokens and the posteriors that
    their features give; repeated rows get equal rows. Labels with nulls aren't learned from; with no
    labels at all every posterior is the same.
    """
    members = posteriors(docs, labels, id_col, text_col)
    k = len(targets)
    if k < len(DOMAINS):  # the last target is for the last domains together
        last = F.aggregate(F.slice("p", k, len(DOMAINS)), F.lit(0.0), lambda t, x: t + x)
        members = members.withColumn("p", F.concat(F.slice("p", 1, k - 1), F.array(last)))
    members = written(members, docs.sparkSession)
    return rates(members, targets).withColumn("copies", _copies(F.col("id")))


def thinned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: tuple[float, float] = TARGETS[:2], label_id: str | None = None) -> DataFrame:
    """id, tokens, p, good (whether the first domain has the top posterior), rate (1 at most) and copies (0 or 1).

    Good documents are kept whole. The others are thinned until their tokens are to those of the good
    ones as shares[1] to shares[0], if they have more. The targets are the tokens of each domain that
    the documents so kept can be expected to have, so that the doubt in the posteriors of good
    documents isn't made up for by dropping some of them; no rate above 1 is needed to meet them. One
    row per input row, rows with nulls like any others; equal rows get equal rates and copies.
    """
    p = posteriors(docs, labels, id_col, text_col, label_id=label_id)
    members = written(p.withColumn("good", F.col("p")[0] >= F.array_max("p")), docs.sparkSession)
    k = len(DOMAINS)
    sums = members.groupBy("good").agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)]).collect()
    have = {r[0]: np.array(r[1:], float) for r in sums}
    good, rest = (have.get(x, np.zeros(k + 1)) for x in (True, False))
    part = min(1.0, shares[1] / shares[0] * good[0] / max(rest[0], 1.0))
    want = good[1:] + part * rest[1:]
    budget = float(want.sum())
    rated = rates(members, tuple((want / max(budget, 1.0)).tolist()), budget, whole="good")
    return rated.withColumn("copies", _copies(F.col("id")))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors and its rate in a mix of 90 % good, 7 % poor and 3 % toxic tokens."""
    out = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies", "residual")
