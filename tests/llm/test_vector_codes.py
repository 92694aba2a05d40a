"""Codes of vectors against a plain version, one vector at a time."""

import hashlib
import math
import random

import pytest

from lexweave.llm import vector_codes
from lexweave.llm.vector_codes import coded


def plain(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label_error, sha) of rows (id, vector, label)."""
    ok = [(i, [math.floor(4096 * x) for x in v], s) for i, v, s in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    for _, v, _ in ok:
        v += [0] * (-len(v) % parts)
    w = len(ok[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in ok]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(p, c[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for (i, _, s), c in zip(ok, cut, strict=True):
        codes = [near(p, c[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][codes[p]]) for p in range(parts))
        total[s] = total.get(s, 0) + error
        out.append((i, "".join(f"{k:02x}" for k in codes), error, s))
    return sorted(((i, c, e, total[s], sha) for i, c, e, s in out), key=str)


SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code int, error string"


def frame(spark, rows):
    import numpy as np

    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], s) for i, v, s in rows]
    return rows, spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def vectors(n, width, seed=3):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(n)]


def same(spark, rows):
    rows, df = frame(spark, rows)
    assert sorted((tuple(r) for r in coded(df).collect()), key=str) == plain(rows)


def test_equal_to_a_plain_version(spark):
    rows = vectors(150, 16)
    rows += [(500 + k, rows[k % 7][1], None) for k in range(60)]  # ties
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (7, rows[9][1], 2)]  # repeated rows, a null id, an id with two vectors
    rows += [(900, None, 1), (901, [], 1), (902, [None] + [0.0] * 15, 1), (903, [float("nan")] * 16, 2), (904, [float("-inf")] * 16, 2), (905, [0.5] * 8, 1)]
    same(spark, rows)


def test_fewer_rows_than_entries_and_odd_widths(spark):
    same(spark, vectors(5, 16))
    same(spark, vectors(40, 13))


def test_empty_table_and_no_usable_row(spark):
    for rows in ([], [(1, None, 1), (2, [None], None)]):
        _, df = frame(spark, rows)
        got = coded(df)
        assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr("lexweave.llm._work.BROADCAST_ROWS", 1)
    same(spark, vectors(90, 16))


def test_components_too_large_are_refused(spark):
    _, df = frame(spark, [(1, [1e30] * 8, 1)])
    with pytest.raises(Exception, match="can't be coded"):
        coded(df).collect()
    assert vector_codes.LARGEST == 1 << 27
