"""Dense features of texts, computed on whole Arrow batches, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._text import Powers, mix, words

#: Bytes that end a word: all ASCII but letters, digits, apostrophe, and the signs that stand in for letters.
BREAK = np.ones(256, dtype=bool)
BREAK[128:] = False
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789'@$*":
    BREAK[_c] = False
#: Lengths in bytes of the word beginnings that a lexicon may hold.
STEMS = (4, 5, 6)
#: Second-person pronouns of the corpus languages. Fixed values.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "usted", "ustedes", "ti", "tú", "vosotros")
#: Words apart at which a lexicon hit counts as near a second-person pronoun.
NEAR = 5
NAMES = ("hits", "hit_density", "word_hits", "word_density", "weight_density", "second_person", "near_second_person", "capitals", "all_caps_words", "exclamations", "questions", "punctuation", "digits", "obfuscated", "stretched", "log_words", "word_length")


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), BREAK)[0][0])


def _stem_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray, powers: Powers, length: int) -> np.ndarray:
    """A hash of the first ``length`` bytes of each word; 0 for shorter words."""
    up, _ = powers.to(length + 1)
    fits = e - s >= length
    h = np.zeros(len(s), np.uint64)
    at = s[fits]
    with np.errstate(over="ignore"):
        x = np.zeros(len(at), np.uint64)
        for k in range(length):
            x += (low[at + k].astype(np.uint64) + np.uint64(1)) * up[k]
        h[fits] = mix(x + np.uint64(length << 32))
    return h


def terms(raw: np.ndarray, off: np.ndarray, powers: Powers):
    """Hashes of words and of their beginnings, one array each, and the first word of each text."""
    from lexweave.llm._text import LOWER

    h, s, e, first = words(raw, off, BREAK)
    low = LOWER[raw]
    return [h, *(_stem_hashes(low, s, e, powers, n) for n in STEMS)], s, e, first


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def tone(raw: np.ndarray, off: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, powers: Powers, second: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text. ``lexicon``: sorted hashes, with their ``weights``."""
    n = len(off) - 1
    kinds, s, e, first = terms(raw, off, powers)
    nw, nb = np.maximum(np.diff(first), 1), np.maximum(np.diff(off), 1)
    found, weight = [], np.zeros(len(s))
    for h in kinds:
        at = np.searchsorted(lexicon, h)
        at[at == len(lexicon)] = 0
        hit = lexicon[at] == h if len(lexicon) else np.zeros(len(h), bool)
        found.append(hit)
        if len(lexicon):
            weight = np.maximum(weight, np.where(hit, weights[at], 0))
    any_hit = np.logical_or.reduce(found) if len(s) else np.zeros(0, bool)
    you = np.isin(kinds[0], second)
    where = np.flatnonzero(you)
    near = np.zeros(len(s), bool)
    if len(where):
        i = np.flatnonzero(any_hit)
        p = np.searchsorted(where, i)
        gap = np.minimum(np.abs(i - where[np.minimum(p, len(where) - 1)]), np.abs(i - where[np.maximum(p - 1, 0)]))
        near[i] = gap <= NEAR
    is_up = (raw >= 65) & (raw <= 90)
    is_letter = is_up | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    is_digit = (raw >= 48) & (raw <= 57)
    sign = is_digit | (raw == 64) | (raw == 36) | (raw == 42)
    between = np.zeros(len(raw), bool)
    between[1:-1] = sign[1:-1] & is_letter[:-2] & is_letter[2:]
    triple = np.zeros(len(raw), bool)
    triple[2:] = is_letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    ups = np.concatenate([[0], np.cumsum(is_up)])
    caps = (ups[e] - ups[s] == e - s) & (e - s >= 3)
    by_byte = lambda flags: _per_text(flags, off) / nb
    punct = (raw > 32) & (raw < 127) & ~is_letter & ~is_digit
    hits, word_hits = _per_text(any_hit, first), _per_text(found[0], first)
    columns = [
        np.log1p(hits), hits / nw, np.log1p(word_hits), word_hits / nw, _per_text(weight, first) / nw, _per_text(you, first) / nw, _per_text(near, first) / nw, by_byte(is_up), _per_text(caps, first) / nw,
        by_byte(raw == 33), by_byte(raw == 63), by_byte(punct), by_byte(is_digit), _per_text(between, off) / nw, _per_text(triple, off) / nw, np.log1p(np.diff(first)), nb / nw,
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(NAMES)))


#: Classes of bytes for shapes: signs by themselves, letters and others by kind.
_SIGNS = b".,!?|#&$*%-:;'\"()/<>_=@+"
SHAPE = np.zeros(256, dtype=np.int64)
SHAPE[128:192], SHAPE[192:256] = 1, 2
SHAPE[32], SHAPE[10] = 3, 4
for _lo, _hi, _k in ((97, 123, 5), (65, 91, 6), (48, 58, 7)):
    SHAPE[_lo:_hi] = _k
for _k, _c in enumerate(_SIGNS):
    SHAPE[_c] = 9 + _k
SHAPE[b"aeiou"[0]] = SHAPE[101] = SHAPE[105] = SHAPE[111] = SHAPE[117] = 8
KINDS = 9 + len(_SIGNS)
EXTRA = 6
#: Buckets that terms are hashed into.
TERMS = 1024
WIDTH = TERMS + KINDS * KINDS + EXTRA


def term_vectors(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of log-scaled rates of hashed terms, then of neighbouring byte classes, of repeated words and lines, of lengths."""
    n = len(off) - 1
    c = SHAPE[raw]
    lengths = np.diff(off)
    row = np.repeat(np.arange(n), lengths)
    pair = np.zeros(len(raw), bool)
    if len(raw):
        pair[1:] = row[1:] == row[:-1]
    at = np.flatnonzero(pair)
    code = row[at] * (KINDS * KINDS) + c[at - 1] * KINDS + c[at]
    count = np.bincount(code, minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    line = np.zeros(256, dtype=bool)
    line[10] = True
    extra = np.zeros((n, EXTRA), np.float32)
    for k, breaks in ((0, BREAK), (2, line)):
        h, _, _, first = words(raw, off, breaks)
        total = np.diff(first)
        owner = np.repeat(np.arange(n), total)
        if k == 0:
            terms_ = np.bincount(owner * TERMS + (h & np.uint64(TERMS - 1)).astype(np.int64), minlength=n * TERMS).reshape(n, -1).astype(np.float32)
            terms_ = np.log1p(100 * terms_ / np.maximum(total, 1)[:, None]) / 5
        order = np.lexsort((h, owner))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        extra[:, k] = 1 - distinct / np.maximum(total, 1)
        extra[:, k + 1] = np.log1p(total) / 10
    extra[:, 4] = np.log1p(lengths) / 12
    extra[:, 5] = np.minimum(lengths / np.maximum(extra[:, 3] * 0 + np.expm1(extra[:, 1] * 10), 1), 40) / 40
    rate = np.log1p(1000 * count / np.maximum(lengths, 1)[:, None]) / 7
    return np.hstack([terms_, rate, extra]).astype(np.float32)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows (id as a string, text, labels y0, y1, ...), those with the least hash of the id.

    Rows without an id or a label are left out. An id counts once, with the label of the least hash of
    its labels, and of unlike texts of an id the one with the least hash.
    """
    names = [f"y{i}" for i in range(len(label_cols))]
    rows = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(y) for c, y in zip(label_cols, names, strict=True)]).dropna()
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64(*names).alias("h"), *names)).alias("y")).select("id", *[f"y.{y}" for y in names])
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(bound)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id")
    return met.groupBy("id", *names).agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")).select(F.col("id").cast("string").alias("id"), "text", *names)
