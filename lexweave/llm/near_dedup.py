"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit signatures.

A text's signature is 80 symbols of 16 bits, split into 20 chunks of 4 symbols. If two signatures
differ in fewer than 40 symbols, then by the pigeonhole principle some chunk differs in one symbol
at most, so the index enumerates, for every chunk, the four ways of leaving one symbol out: two
texts within that distance always share a key. Texts that share keys, directly or through others,
form clusters; within a cluster all pairs under the distance are compared on their full shingle
sets. A pair at resemblance 0.75 exactly is beyond the distance with odds of 1.3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._graph import components
from lexweave.llm._text import mix, pieces, shingle_sets, texts
from lexweave.llm._work import dropped, small, spread_join, table, text_batches, written

SYMBOLS, PER_CHUNK, BITS = 80, 4, 16
CHUNKS = SYMBOLS // PER_CHUNK
#: Signatures that differ in fewer symbols always share a key; pairs that differ in as many or more aren't compared.
DISTANCE = 2 * CHUNKS
#: Texts of one block, where those whose sets take more than UNIT bytes count for more; the blocks of a cluster are met in pairs, each pair in one task.
BLOCK, UNIT = 1024, 2048
#: A cluster of more blocks is compared key by key instead, which takes as many copies of a text as it has keys.
BLOCKS = 64


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    return mix(k) | np.uint64(1), mix(k + np.uint64(1000))


def _signature(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """CHUNKS words of 64 bits; the least value of each permutation leaves 16 of its bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 4096):
            least = np.minimum(least, (mix(h[lo : lo + 4096])[:, None] * mul + add).min(axis=0))
    symbols = ((mix(least) >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
    return symbols.view("<i8")


def _rows(size: int, full: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to id, n, k1, k2 and the signature.

    With ``full``, (id, text, c1, c2, unit, blocks) to those rows whose k1 and k2 are c1 and c2, with
    the whole shingle set as sorted hashes.
    """
    mul, add = _seeds()
    for batch in batches:
        raw, off = texts(batch.column(1))
        for lo, hi in pieces(off):
            at = off[lo : hi + 1]
            n, k1, k2, sig, sets = [], [], [], [], []
            with np.errstate(over="ignore"):
                for h in shingle_sets(raw[at[0] : at[-1]], at - at[0], size):
                    n.append(len(h))
                    k1.append(int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                    k2.append(int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                    sig.append(_signature(h, mul, add) if len(h) else np.zeros(CHUNKS, "<i8"))
                    if full:
                        sets.append(h.tobytes())
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, CHUNKS * (hi - lo) + 1, CHUNKS), pa.int32()), pa.array(np.concatenate(sig), pa.int64()))
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), sigs]
            names = ["id", "n", "k1", "k2", "sig"]
            if full:
                own = pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary()), *[batch.column(k).slice(lo, hi - lo) for k in range(4, 6)]], [*names, "shingles", "unit", "blocks"])
                c1, c2 = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (2, 3))
                yield own.filter(pa.array((np.array(k1) == c1) & (np.array(k2) == c2)))
            else:
                yield pa.RecordBatch.from_arrays(columns, names)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, n (distinct shingles), k1 and k2 (128 bits that name the set), sig (array of bigint)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _rows(shingle, False, it), "id bigint, n bigint, k1 bigint, k2 bigint, sig array<bigint>")


def _keys(sig: str) -> Column:
    """One key for each chunk and left-out symbol; its own number takes the place of the symbol."""
    keys = []
    for j in range(CHUNKS):
        for r in range(PER_CHUNK):
            rest = ~(0xFFFF << (BITS * r)) & (2**64 - 1)
            code = (j * PER_CHUNK + r + 1) << (BITS * r)
            signed = [x - 2**64 if x >= 2**63 else x for x in (rest, code)]
            keys.append(F.col(sig)[j].bitwiseAND(F.lit(signed[0])).bitwiseOR(F.lit(signed[1])))
    return F.array(*keys)


def _met(rows: pa.RecordBatch, num: int, den: int) -> tuple[list[int], list[int]]:
    """The links between two blocks (or within one): columns unit, i, j, block, rep, n, sig, shingles.

    Pairs of like size under the distance are compared on their sets, unless links found here already
    join them; so there are fewer links than texts, and what they join is what all links join.
    """
    i, j, block, rep, n = (rows.column(c).to_numpy() for c in range(1, 6))
    sig = rows.column(6).flatten().to_numpy().view("<u2").reshape(-1, SYMBOLS)
    sets = rows.column(7)
    hashes = np.frombuffer(b"".join(x.as_buffer() for x in sets), np.uint64)
    _, vocabulary = np.unique(hashes, return_inverse=True)
    vocabulary = vocabulary.astype(np.int32)
    ends = np.cumsum(n)
    begins = ends - n
    root = np.arange(len(rep))
    flag = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, bool)
    order = np.argsort(n, kind="stable")  # by size, so that the partners of like size are a range
    sizes = n[order]
    a, b = [], []
    x_side, y_side = block[order] == i[0], block[order] == j[0]
    same = i[0] == j[0]
    for at in np.flatnonzero(x_side).tolist():
        x = order[at]
        lo = np.searchsorted(sizes, -(-num * n[x] // den)) if not same else at + 1
        hi = np.searchsorted(sizes, den * n[x] // num, side="right")
        y = order[lo:hi][y_side[lo:hi]]
        y = y[root[y] != root[x]]
        if not len(y):
            continue
        y = y[(sig[y] != sig[x]).sum(axis=1) < DISTANCE]
        if not len(y):
            continue
        own = vocabulary[begins[x] : ends[x]]
        flag[own] = True
        for part in np.array_split(y, -(-int(n[y].sum()) // (1 << 20))):
            count = n[part]
            start = np.cumsum(count) - count
            where = np.arange(int(count.sum())) - np.repeat(start - begins[part], count)
            both = np.add.reduceat(flag[vocabulary[where]].astype(np.int64), start)
            for z in part[den * both >= num * (n[x] + count - both)].tolist():
                if root[z] != root[x]:
                    root[root == root[z]] = root[x]
                    a.append(int(rep[x]))
                    b.append(int(rep[z]))
        flag[own] = False
    return a, b


def _near(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (unit, i, j) to the links (a, b) of each pair of blocks."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> pa.RecordBatch:
        a, b = _met(pa.Table.from_batches(held).combine_chunks().to_batches()[0], num, den)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        u, i, j = (batch.column(c).to_numpy() for c in range(3))
        cuts = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(u)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            name = (int(u[lo]), int(i[lo]), int(j[lo]))
            if held and name != last:
                yield done()
                held.clear()
            last = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield done()


def _shared(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """key, rep, a of the keys that several classes have; a is the least of them."""
    keyed = classes.select("rep", F.explode(_keys("sig")).alias("key"))
    groups = written(keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1"), spark)
    out = written(spread_join(keyed, groups, "key"), spark)
    dropped(groups)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Groups of documents linked by den * |A and B| >= num * |A or B| over their shingle sets.

    Returns one row per input row: id, n_shingles, component_id (the smallest id reachable),
    kept (id = component_id). Null and wordless texts have no shingles and are linked with nothing;
    rows with a null id have a null component and stay. Ids are read as whole numbers. Repeated rows
    of an id get equal rows; rows of one id with unlike texts are one document that holds each of
    them. An empty table gives no rows. Only the two columns named are read, so others can't clash.

    Equal sets are one class before any comparison, so copies never meet pairwise. Links are written
    only where they join groups, so their number stays below that of classes times their blocks.
    """
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = written(sketches(base, "id", "text", shingle), spark)
    own = all_rows.filter("n > 0 and id is not null")
    classes = written(own.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), spark)

    # Classes that share keys, directly or through others, are a cluster; a text of a cluster meets all others of it.
    shared = _shared(spark, classes)
    clusters = components(spark, shared.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    info = classes.join(clusters.select(F.col("id").alias("rep"), F.col("component").alias("unit")), "rep").select("rep", "n", "k1", "k2", "unit")
    weight = F.sum(F.greatest((8 * F.col("n") + 2 * SYMBOLS) / UNIT, F.lit(1.0)))
    blocks = F.ceil(weight / BLOCK).cast("int").alias("blocks")
    info = written(info.join(info.groupBy("unit").agg(blocks), "unit"), spark)
    n_info = info.count()
    wanted = info.select(F.col("rep").alias("id"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "unit", "blocks")
    full = base.join(small(wanted, n_info), "id").select("id", "text", "c1", "c2", "unit", "blocks")
    members = full.mapInArrow(lambda it: _rows(shingle, True, it), "id bigint, n bigint, k1 bigint, k2 bigint, sig array<bigint>, shingles binary, unit bigint, blocks int")
    again = own.join(small(wanted.select("id", F.col("c1").alias("k1"), F.col("c2").alias("k2")), n_info), ["id", "k1", "k2"], "left_semi").groupBy("id", "k1", "k2").agg(F.count("*").alias("c")).filter("c > 1")
    if not again.isEmpty():
        members = members.dropDuplicates(["id", "k1", "k2"])
    units = members.filter(F.col("blocks") <= BLOCKS).select("unit", "blocks", F.col("id").alias("rep"), "n", "sig", "shingles")
    huge = info.filter(F.col("blocks") > BLOCKS).select("rep", "n")
    if not huge.isEmpty():
        keys = shared.join(huge, "rep").select(F.col("key").alias("unit"), "rep", "n")
        keys = keys.join(keys.groupBy("unit").agg(blocks), "unit").drop("n")
        sets = members.filter(F.col("blocks") > BLOCKS).select(F.col("id").alias("rep"), "n", "sig", "shingles")
        units = units.unionByName(sets.join(keys, "rep").select(*units.columns))
    # The pairs of a unit's blocks are dealt out, so that one of any size takes bounded memory in a task.
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = units.withColumn("block", block).withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    dealt = dealt.select("unit", "i", "j", "block", "rep", "n", "sig", "shingles").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    links = written(dealt.mapInArrow(lambda it: _near(num, den, it), "a bigint, b bigint"), spark)

    # Each row's class, and the ids that are in several classes.
    named = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    placed = written(all_rows.select("id", "n", "k1", "k2").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left").select("id", "n", "rep"), spark)
    several = placed.filter("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
    within = placed.join(several, "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    groups = components(spark, links.union(within)).select(F.col("id").alias("rep"), F.col("component").alias("g"))
    dropped(all_rows, classes, shared, clusters, info, links)
    component = F.coalesce("g", "rep", "id")
    return placed.join(groups, "rep", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
