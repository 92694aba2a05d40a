"""Repeated passages by a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Every 200-byte string has an anchor: the leftmost of its 32-byte grams with the least hash. Equal
strings have equal anchors, so strings are compared only where anchors repeat, and those segments
are dealt out by anchor. Each task indexes the distinct segments it gets, some megabytes at a time:
suffix order by prefix doubling, the transform, its runs, and at run heads and ends the length of
the match with the neighbouring suffix; all but the text and those samples is then let go. Inside a run the longest match at a position is that of the
position before, less one (the runs' reducible matches), so a pass over the text in order streams
the matching statistics from the samples alone. Positions that match over 200 bytes are marked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._text import mix, texts
from lexweave.llm._work import dropped, small, spread_join, table, text_batches, written

#: Bytes of a gram whose hash makes it an anchor; a power of two.
GRAM = 32
#: Bytes of segments that are indexed at a time.
INDEX = 512 << 10
#: Distinct segments of one anchor beyond which the anchor is made longer, so that they are spread over all tasks.
HOT = 5_000
#: A longer anchor leaves fewer than this many bytes at either end of a string.
STEP = 8
#: Window starts whose anchors are sought at a time within one very long text, and the bits that number them.
STRETCH, PLACE = 1 << 20, 21
_M, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h = mix(raw.astype(_U) + _U(77))
    width, m = 1, int(_M)
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * _U(m) + h[width:] if len(h) > width else h[:0]
            width, m = 2 * width, m * m % (1 << 64)
        return mix(h)


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of ``length`` bytes that start in ``raw``: (first start, number of starts, anchor hash, anchor position) of each run of starts with one anchor."""
    starts, span = len(raw) - length + 1, length - GRAM + 1
    h = _gram_hashes(raw)
    bits = _U(PLACE)  # the same for all texts, so that equal strings agree on their anchor
    low = (h >> bits << bits) | np.arange(len(h), dtype=_U)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: starts], low[span - width : span - width + starts])
    at = (low[:starts] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [starts]])), h[at[first]], at[first]


def _segments(raw: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of one text: first starts, numbers of starts, anchor hashes. Those that a stretch's end cuts are given in parts."""
    for lo in range(0, len(raw) - length + 1, STRETCH):
        a, n, h, _ = anchors(raw[lo : lo + STRETCH + length - 1], length)
        yield a + lo, n, h


def longer(part: bytes, n: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """The segment ``part`` of ``n`` starts by longer anchors: (first start, number of starts, the anchor's bytes).

    The anchor grows to both sides in steps of STEP bytes as far as a string reaches, so strings that
    are equal, and so have equal anchors at equal places, still have equal ones.
    """
    _, _, _, at = anchors(np.frombuffer(part, np.uint8), length)
    left = at[0] - np.arange(n)
    right = length - GRAM - left
    kind = (left // STEP) * length + right // STEP
    first = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        yield a, b - a, part[at[0] - left[a] // STEP * STEP : at[0] + GRAM + right[a] // STEP * STEP]


def _find(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, text) to (h, r, p): p packs 23 bits of the text's checksum, 32 of the first start, 8 of the number of starts."""
    for batch in batches:
        raw, off = texts(batch.column(1))
        rows, packed, hashes = [], [], []
        for i in np.flatnonzero(np.diff(off) >= length).tolist():
            own = raw[off[i] : off[i + 1]]
            mark = np.int64(zlib.crc32(own) & 0x7FFFFF) << np.int64(40)
            for a, n, h in _segments(own, length):
                rows.append(np.full(len(a), i))
                packed.append(mark | (a << 8) | n)
                hashes.append(h)
        z = np.zeros(0, np.int64)
        ids = batch.column(0).take(pa.array(np.concatenate([z, *rows])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([z.astype(_U), *hashes]).view(np.int64)), ids, pa.array(np.concatenate([z, *packed]))], ["h", "r", "p"])


def _cut(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, text, segments) to (h, r, p, k1, k2, bytes): the bytes only where this task hasn't given them lately."""
    seen: set[bytes] = set()
    for batch in batches:
        raw, off = texts(batch.column(1))
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        inner = lists.values
        hs, ps = inner.field("h").to_numpy(), inner.field("p").to_numpy()
        h, row, p, k1, k2, content = [], [], [], [], [], []
        size = 0

        def flush():
            rows = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch.column(0).take(rows), pa.array(p, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(content, pa.binary())], ["h", "r", "p", "k1", "k2", "content"])

        for i in range(len(batch)):
            own = raw[off[i] : off[i + 1]].tobytes()
            mark = zlib.crc32(own) & 0x7FFFFF
            for j in range(ends[i], ends[i + 1]):
                x = int(ps[j])
                if x >> 40 != mark:
                    continue
                a, n = (x >> 8) & 0xFFFFFFFF, x & 0xFF
                part = own[a : a + n + length - 1]
                key = hashlib.blake2b(part, digest_size=16).digest()
                fresh = key not in seen
                if fresh:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(key)
                    size += len(part)
                h.append(int(hs[j]))
                row.append(i)
                p.append(x)
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                content.append(part if fresh else None)
            if size > 1 << 22:
                yield flush()
                for x in (h, row, p, k1, k2, content):
                    x.clear()
                size = 0
        yield flush()


class RunIndex:
    """The run-compressed transform of some texts, each shorter than 512 bytes, no two alike."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.array([len(x) for x in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        n = int(self.lengths.sum()) + len(parts)
        text = np.zeros(n + 1, np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        inside = np.ones(n + 1, bool)
        inside[self.starts + self.lengths] = False
        inside[n] = False
        text[inside] = flat.astype(np.int64) + 1
        self.text, n = text, n + 1
        # Ranks by the first 4, 8, ..., 512 symbols. The first 1024 hold a whole text, so their order is that of the suffixes.
        padded = np.concatenate([text, np.zeros(4, np.int64)])
        key = ((padded[:n] * 257 + padded[1 : n + 1]) * 257 + padded[2 : n + 2]) * 257 + padded[3 : n + 3]
        ranks, width, order = {}, 4, np.argsort(key)
        while True:
            if width > 4:  # in the order so far only equal ranks are out of place, which a merging sort makes use of
                order = order[np.argsort(key[order], kind="stable")]
            if width == 1024:
                break
            s = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
            ranks[width] = rank
            after = np.full(n, -1, np.int64)
            after[: max(0, n - width)] = rank[width:]
            key = rank.astype(np.int64) * (n + 1) + after + 1
            width *= 2
        before = text[order - 1]  # the transform
        before[order == 0] = -1  # nothing stands before the first symbol
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(head)
        tails = np.concatenate([heads[1:] - 1, [n - 1]])
        # Of the transform its runs are kept; of the order and the ranks, the positions and matches at run heads and ends.
        self.runs = before[heads], np.diff(np.concatenate([heads, [n]]))
        self.samples = []
        for at, step in ((heads[heads > 0], -1), (tails[tails < n - 1], 1)):
            p = order[at]
            self.samples.append((p, self._common(ranks, p, order[at + step])))

    def _common(self, ranks: dict[int, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at p and q share, up to 1023."""
        p, q = p.copy(), q.copy()
        n, total = len(self.text), np.zeros(len(p), np.int64)
        for width in sorted(ranks, reverse=True):
            rank = ranks[width]
            live = (p < n) & (q < n)
            same = np.zeros(len(p), bool)
            same[live] = rank[p[live]] == rank[q[live]]
            step = width * same
            p, q, total = p + step, q + step, total + step
        for _ in range(3):
            live = (p < n) & (q < n)
            same = np.zeros(len(p), bool)
            same[live] = self.text[p[live]] == self.text[q[live]]
            p, q, total = p + same, q + same, total + same
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that also starts elsewhere, streamed from the samples at run ends."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for p, common in self.samples:
            sample = np.full(n, -1, np.int64)
            sample[p] = common + p
            best = np.maximum(best, np.maximum.accumulate(sample) - np.arange(n))
        return best

    def marked(self, length: int) -> list[np.ndarray]:
        """For each text which of its strings of ``length`` bytes also start elsewhere."""
        long = self.matching_statistics() >= length
        return [long[s : s + m - length + 1] for s, m in zip(self.starts, self.lengths, strict=True)]


def _indexed(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k1, k2, content) in order of h, k1, k2 to (k1, k2, lo, hi): the first and the last marked start of each segment with any."""
    waiting: list[tuple[int, int, bytes]] = []
    group: list[tuple[int, int, bytes]] = []
    last, size = None, 0

    def done():
        flags = RunIndex([x[2] for x in waiting]).marked(length) if waiting else []
        rows = [(x[0], x[1], int(f.argmax()), len(f) - 1 - int(f[::-1].argmax())) for x, f in zip(waiting, flags, strict=True) if f.any()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "lo", "hi"])

    for batch in batches:
        hs, k1, k2 = (batch.column(i).to_numpy() for i in range(3))
        content = batch.column(3)
        for i in range(len(batch)):
            h = int(hs[i])
            if h != last:
                if len(group) > 1:  # an anchor with a single distinct segment has nothing to be compared with
                    waiting += group
                    size += sum(len(x[2]) for x in group)
                    if size >= INDEX:
                        yield done()
                        waiting, size = [], 0
                group, last = [], h
            if not group or group[-1][:2] != (int(k1[i]), int(k2[i])):
                group.append((int(k1[i]), int(k2[i]), content[i].as_py()))
    if len(group) > 1:
        waiting += group
    yield done()


def _parts(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, content) of segments to the parts that longer anchors cut them into: (k1, k2, a, n, h, s1, s2, part)."""
    for batch in batches:
        rows, a, n, h, s1, s2, parts = [], [], [], [], [], [], []
        for i, c in enumerate(batch.column(2).to_pylist()):
            for first, count, anchor in longer(c, len(c) - length + 1, length):
                part = c[first : first + count + length - 1]
                key = hashlib.blake2b(part, digest_size=16).digest()
                rows.append(i)
                a.append(first)
                n.append(count)
                h.append(int.from_bytes(hashlib.blake2b(anchor, digest_size=8).digest(), "little", signed=True))
                s1.append(int.from_bytes(key[:8], "little", signed=True))
                s2.append(int.from_bytes(key[8:], "little", signed=True))
                parts.append(part)
        take = pa.array(rows, pa.int64())
        longs = [pa.array(x, pa.int64()) for x in (a, n, h, s1, s2)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *longs, pa.array(parts, pa.binary())], ["k1", "k2", "a", "n", "h", "s1", "s2", "part"])


def _strings(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, content) to (k1, k2, j, w1, w2): each string by itself, as a 128-bit hash."""
    for batch in batches:
        rows, js, digests = [], [], []
        for i, c in enumerate(batch.column(2).to_pylist()):
            for j in range(len(c) - length + 1):
                rows.append(i)
                js.append(j)
                digests.append(hashlib.blake2b(c[j : j + length], digest_size=16).digest())
        w = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(js, pa.int32()), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["k1", "k2", "j", "w1", "w2"])


def _marks(spark: SparkSession, distinct: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(k1, k2, lo, hi) of the distinct segments (h, k1, k2, content) with strings that other segments of their anchor hold.

    Anchors of too many segments are made longer (level 1). What strings then still have too many for
    their anchor, all but a few of whose bytes it holds, are cut into single strings, which are equal
    or not (level 2).
    """
    hot = written(distinct.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("h"), spark)
    n_hot = hot.count()
    cool = distinct.join(small(hot, n_hot), "h", "left_anti") if n_hot else distinct
    marks = cool.select("h", "k1", "k2", "content").repartition("h").sortWithinPartitions("h", "k1", "k2").mapInArrow(lambda it: _indexed(length, it), "k1 bigint, k2 bigint, lo bigint, hi bigint")
    if not n_hot:
        return marks
    many = distinct.join(small(hot, n_hot), "h", "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", "content")
    if level:
        strings = written(many.mapInArrow(lambda it: _strings(length, it), "k1 bigint, k2 bigint, j int, w1 bigint, w2 bigint"), spark)
        shared = strings.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
        return marks.union(strings.join(shared, ["w1", "w2"]).groupBy("k1", "k2").agg(F.min("j").cast("bigint").alias("lo"), F.max("j").cast("bigint").alias("hi")))
    parts = written(many.mapInArrow(lambda it: _parts(length, it), "k1 bigint, k2 bigint, a bigint, n bigint, h bigint, s1 bigint, s2 bigint, part binary"), spark)
    single = parts.select("h", F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("part").alias("content")).dropDuplicates(["k1", "k2"])
    inner = _marks(spark, single, length, 1).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "lo", "hi")
    copies = parts.groupBy("s1", "s2").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c > 1").select("s1", "s2", F.lit(0).cast("bigint").alias("lo"), (F.col("n") - 1).alias("hi"))
    met = parts.select("k1", "k2", "a", "s1", "s2").join(inner.union(copies), ["s1", "s2"])
    return marks.union(met.groupBy("k1", "k2").agg(F.min(F.col("a") + F.col("lo")).alias("lo"), F.max(F.col("a") + F.col("hi")).alias("hi")))


def _kept(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, marks) to (id, n_bytes, spans, kept_sha256). A mark: p, and the first and the last marked start of its segment.

    Starts of one segment lie nearer than a string is long, so what they cover is one run.
    """
    for batch in batches:
        raw, off = texts(batch.column(1))
        marks = batch.column(2)
        ends = marks.offsets.to_numpy()
        has = marks.is_valid().to_numpy(zero_copy_only=False)
        ps, los, his = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in ("p", "lo", "hi"))
        spans, digests = [], []
        for i in range(len(batch)):
            own = raw[off[i] : off[i + 1]]
            at = slice(ends[i], ends[i + 1]) if has[i] else slice(0, 0)
            p, lo, hi = ps[at], los[at], his[at]
            if len(p):
                mine = (p >> 40) == (zlib.crc32(own) & 0x7FFFFF)
                first = ((p >> 8) & 0xFFFFFFFF)[mine]
                lo, hi = first + lo[mine], first + hi[mine] + length
            if not len(lo):
                spans.append([])
                digests.append(hashlib.sha256(own).hexdigest())
                continue
            order = np.argsort(lo)
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
            starts, stops = lo[fresh].tolist(), hi[np.concatenate([fresh[1:], [True]])].tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(starts, stops, strict=True)])
            rest = hashlib.sha256()
            for x, y in zip([0, *stops], [*starts, len(own)], strict=True):
                rest.update(own[x:y])
            digests.append(rest.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(spans, kind), pa.array(digests)], ["id", "n_bytes", "spans", "kept_sha256"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """The bytes of each text that a string of ``length`` bytes covers which also starts elsewhere, in any text.

    Returns one row per input row: id, n_bytes, spans (start and end, in bytes, of the maximal
    removed runs), kept_sha256 (of the remaining bytes). Null is empty; texts shorter than
    ``length`` are kept whole; repeated rows are copies of each other, so both lose what they share;
    rows of one id or a null one are told apart by their text. An empty table gives no rows. Texts
    longer than 4 GB aren't supported. Only the two columns named are read, so others can't clash.
    """
    if not 2 * GRAM <= length <= 255:
        raise ValueError("length must be from 64 to 255 bytes")
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("r", F.xxhash64("id", "text"))
    found = base.select("r", "text").mapInArrow(lambda it: _find(length, it), "h bigint, r bigint, p bigint")
    again = written(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), spark)
    # Equal rows have equal segments, so those of a row are a set.
    per = spread_join(found, again, "h", least=1000).groupBy("r").agg(F.collect_set(F.struct("h", "p")).alias("segments"))
    met = base.join(per.withColumnRenamed("r", "r_"), F.col("r") == F.col("r_")).select("r", "text", "segments")
    cut = written(met.mapInArrow(lambda it: _cut(length, it), "h bigint, r bigint, p bigint, k1 bigint, k2 bigint, content binary"), spark)

    distinct = cut.filter("content is not null").select("h", "k1", "k2", "content")
    marks = written(_marks(spark, distinct, length), spark)
    # A segment that another row holds whole is marked whole, others where an index marked them.
    copies = written(cut.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.lit(0).cast("bigint").alias("lo"), (F.max(F.col("p").bitwiseAND(F.lit(255))) - 1).alias("hi")).filter("c > 1"), spark)
    others = marks.join(copies, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(1).cast("bigint").alias("c"), "lo", "hi")
    known = written(copies.unionByName(others), spark)
    marked = spread_join(cut.select("r", "p", "k1", "k2"), known, "k1", "k2", least=1000).select("r", "p", "lo", "hi")
    per = written(marked.groupBy("r").agg(F.collect_set(F.struct("p", "lo", "hi")).alias("marks")), spark)
    dropped(again, cut, marks, copies, known)
    met = base.join(per.withColumnRenamed("r", "r_"), F.col("r") == F.col("r_"), "left").select("id", "text", "marks")
    schema = T.StructType([met.schema["id"], *T.StructType.fromDDL("n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string").fields])
    return met.mapInArrow(lambda it: _kept(length, it), schema)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that also stand elsewhere."""
    out = repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, x: t + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
