"""Packing against the tokenizer's own ids and plain best fit."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from lexweave.llm import packing  # noqa: E402
from lexweave.llm._work import written  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, id string, piece string, key int, bin int, size int"


def best_fit(sizes, capacity):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > s:
            bisect.insort(gaps, gap - s)
    return n


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgéíñ") for _ in range(rng.randrange(1, 9)))
    odd = [None, "", "  \n\t ", "Don't 'stop' now", "<|endoftext|>x<|startoftext|>", "İstanbul ΣΟΦΟΣ é 12.5% 中文字 🙂", "\x00\x1c\x7f", "a" * 500, "x'S y'LL 'tis"]
    long_ = [" ".join(word() for _ in range(n)) for n in (3000, 9000)]
    return odd + long_ + [" ".join(word() for _ in range(rng.randrange(1, 400))) for _ in range(150)] + ["same text"] * 60


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(PATH), list(enumerate(texts()))
    rows += [(None, "no id"), (None, "no id"), (7, "one id, another text"), rows[5], rows[5]]
    got = packing.sequences(spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA).repartition(5), PATH).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    placed(got, 4096)
    fewest = best_fit([w[3] for w in want], 4096)
    assert len({r.sequence_id for r in got}) <= fewest + 1


def placed(rows, capacity):
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for items in own.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize(("low", "high", "slack"), [(1, 4096, 1.01), (1, 60, 1.01), (700, 700, 1.0), (1000, 2100, 1.08)])
def test_about_as_few_bins_as_best_fit(spark, low, high, slack):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(3000)]
    items = written(spark.createDataFrame(list(enumerate(sizes)), "key bigint, size bigint"), spark)
    got = [(r.key, r.bin, r.offset) for r in packing.packed(items).collect()]
    assert sorted(k for k, _, _ in got) == list(range(3000))
    ends = defaultdict(list)
    for k, b, o in got:
        ends[b].append((o, sizes[k]))
    for own in ends.values():
        assert [o for o, _ in sorted(own)] == [sum(s for _, s in sorted(own)[:i]) for i in range(len(own))] and sum(s for _, s in own) <= 4096
    assert len(ends) <= slack * best_fit(sizes, 4096) + 1


def test_ranges_are_matched_like_brackets():
    rng = random.Random(4)
    for _ in range(200):
        counts = {p: [rng.randrange(4), rng.randrange(4)] for p in rng.sample(range(9), rng.randrange(1, 9))}
        docs, slots = packing._across(counts)
        stack, pairs = [], []
        for p in sorted(counts):
            for rank in range(counts[p][1]):
                if stack:
                    pairs.append((stack.pop(), (p, rank)))
            stack += [(p, rank) for rank in range(counts[p][0])]
        doc = {n + k: (p, counts[p][0] - 1 - place) for p, a, b, n in docs for k, place in enumerate(range(a, b))}
        slot = {n + rank: (p, rank) for p, taken, n in slots for rank in range(taken)}
        assert sorted((doc[m], slot[m]) for m in doc) == sorted(pairs) and doc.keys() == slot.keys()


def test_empty_table(spark):
    got = packing.sequences(spark.createDataFrame([], SCHEMA), PATH)
    assert got.columns == ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.collect() == []


def test_all_full(spark):
    items = written(spark.range(3).select(F.col("id").alias("key"), F.lit(4096).cast("bigint").alias("size")), spark)
    assert len({r.bin for r in packing.packed(items).collect()}) == 3
