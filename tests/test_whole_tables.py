"""Upserts and orderings over whole tables, against plain Python."""

import __spark_entry__ as entry


def test_upsert_takes_every_row_of_both_tables(spark, tmp_path):
    customers, orders = {1: 10.0, 2: 20.0, 3: 30.0, 4: 40.0}, [(2, 5.0), (2, 7.0), (3, 1.0), (9, 2.0)]
    spark.createDataFrame(list(customers.items()), "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: (r.v, r.was_inserted) for r in entry.queries()["m1_upsert_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (10.0, 0), 2: (7.0, 0), 3: (1.0, 0), 4: (40.0, 0), 9: (2.0, 1)}


def test_order_keeps_every_row_behind_many_nulls(spark, tmp_path):
    rows = [(i % 7, i, "user" if i % 3 else ("system", "assistant")[i % 2]) for i in range(300)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in entry.queries()["o3_nulls_first"](spark, str(tmp_path)).collect()]
    kinds = (None, "system", "assistant")
    assert got == [(c, t, k) for k in kinds for c, t, r in sorted(rows) if (None if r == "user" else r) == k]


def test_briefs_of_one_path_are_told_apart(spark, tmp_path):
    """F8: a brief was taken for seen where another of the same path was."""
    spark.createDataFrame([(3, 7, "F"), (1_000_003, 7, "F"), (4, 7, "O")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in entry.queries()["s18_pending_briefs"](spark, str(tmp_path)).collect())
    assert got == [("base/2023-briefs/7/111113_Appellants.pdf", "11111-3", "Opening", 2023), ("base/2024-briefs/7/111114_Respondents_Reply.pdf", "11111-4", "Reply", 2024)]
