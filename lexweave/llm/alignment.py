"""Alignment of two tokenizers' tokens by the bytes that they cover, and how common each linked pair of ids is.

Only tokenising is Python. Groups and links come from the arrays of ids and byte ends by higher-order
functions, in time that grows with the text: arrays that say of every byte which token holds it take
the place of searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._tokens import TokenPairs, kept
from lexweave.llm._work import spread_join, table, text_batches, written

#: Ids of the second tokenizer are below it.
IDS = 1 << 20


#: Columns of arrays that ``tokens`` gives.
ARRAYS = ("a", "ends_a", "at_a", "b", "ends_b", "at_b")


def tokens(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a, ends_a, at_a, b, ends_b, at_b: ids, byte ends, and by byte the number of the token that holds it, of a space and the text.

    All are empty where a tokenizer's tokens don't spell it.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = kept(f"pairs {bytes_path} {pieces_path}", lambda: TokenPairs(bytes_path, pieces_path))
        for batch in batches:
            first, size, parts = 0, 0, []
            for k, (a, ends_a, b, ends_b) in enumerate(pairs.of(batch.column(1))):
                at = [np.repeat(np.arange(len(e), dtype=np.int32), np.diff(e, prepend=0)) for e in (ends_a, ends_b)]
                parts.append((a, ends_a, at[0], b, ends_b, at[1]))
                size += len(at[0])
                if size > 1 << 20 or k + 1 == batch.num_rows:
                    offsets = (np.cumsum([0, *(len(p[c]) for p in parts)]).astype(np.int32) for c in range(len(ARRAYS)))
                    lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(np.concatenate([p[c] for p in parts]), pa.int32())) for c, o in enumerate(offsets)]
                    yield pa.record_batch([batch.column(0).slice(first, len(parts)), *lists], ["id", *ARRAYS])
                    first, size, parts = k + 1, 0, []

    text_batches(docs.sparkSession, 500)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(encoded, f"id {kind}, " + ", ".join(f"{c} array<int>" for c in ARRAYS))


def _named(ids: Column, first: Column, last: Column) -> Column:
    """The ids of the tokens from ``first`` to ``last``, joined by commas."""
    return F.when(first == last, F.get(ids, last).cast("string")).otherwise(F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(ids, i).cast("string")), ","))


def aligned(both: DataFrame) -> DataFrame:
    """The id of ``tokens``, n_a, n_b, n_groups, n_links, groups and links.

    A link is one of each tokenizer's ids as an integer, the first times ``IDS`` and the second;
    ``groups`` reads a1,a2|b1;a3|b2,b3.
    """
    a, b, at_a, at_b, common = (F.col(c) for c in ("a", "b", "at_a", "at_b", "common"))
    # As a row of its own, so that no function makes them again for each element.
    made = F.struct(F.array_intersect("ends_a", "ends_b").alias("common"), F.array_union("ends_a", "ends_b").alias("cuts"))
    met = both.select("id", "a", "at_a", "b", "at_b", F.inline(F.array(made)))

    def group(end: Column, k: Column) -> Column:
        start = F.get(common, k - 1)  # null before the first
        of_a, of_b = (_named(ids, F.coalesce(F.get(at, start), F.lit(0)), F.get(at, end - 1)) for ids, at in ((a, at_a), (b, at_b)))
        return F.concat(of_a, F.lit("|"), of_b)

    # Between two neighbouring ends of either side lies one token of each: these are the links.
    link = F.transform("cuts", lambda e: F.get(a, F.get(at_a, e - 1)) * F.lit(IDS).cast("bigint") + F.get(b, F.get(at_b, e - 1)))
    n_links = F.aggregate(F.array(F.size("a"), F.size("b"), -F.size("common")), F.lit(0), lambda n, x: n + x)
    return met.select("id", *(F.size(c).cast("bigint").alias(n) for c, n in (("a", "n_a"), ("b", "n_b"), ("common", "n_groups"))), n_links.cast("bigint").alias("n_links"), F.array_join(F.transform(common, group), ";").alias("groups"), link.alias("links"))


#: Pairs of ids that are sent to all executors, at some 40 bytes each; beyond it, the join shuffles.
SENT = 3_000_000


def linked(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row, and groups themselves if they are to be kept.

    The count of a pair of ids is the number of rows that link it; n_best counts the links whose pair
    has the highest count of its first id, ties included; count_sum adds up all links' counts. A row
    whose text is null or empty, or isn't spelt by both tokenizers' tokens, has zeros and empty strings.
    Repeated rows, and rows of a null id, count each by itself. Other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    hashed = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    shown = ["id", "n_a", "n_b", "n_groups", "n_links", hashed, *(["groups"] if keep_groups else [])]
    rows = written(aligned(tokens(docs, bytes_path, pieces_path, id_col, text_col)).select(F.monotonically_increasing_id().alias("key"), *shown, "links"), spark)
    pairs = written(rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), spark)
    most = written(pairs.groupBy(F.expr(f"pair div {IDS}").alias("of")).agg(F.max("n").alias("most")), spark)  # a row for each id of a tokenizer
    links = rows.select("key", F.explode("links").alias("pair"))
    shared = pairs.filter("n > 1")  # a pair that isn't among them stands in one row
    if shared.count() <= SENT:
        met = links.join(F.broadcast(shared), "pair", "left")
    else:
        met = spread_join(links, written(links.groupBy("pair").agg(F.count("*").alias("c")).join(pairs, "pair"), spark), "pair")
    met = met.withColumn("n", F.coalesce("n", F.lit(1))).join(F.broadcast(most), F.expr(f"pair div {IDS}") == F.col("of"))
    sums = met.groupBy("key").agg(F.count(F.when(F.col("n") == F.col("most"), 1)).alias("n_best"), F.sum("n").alias("count_sum"))
    return rows.drop("links").join(sums, "key", "left").drop("key").fillna(0, ["n_best", "count_sum"])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import public_tokenizers

    out = linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
