"""Compares queries with their DuckDB counterparts: python tests/oracle.py DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if x is None or isinstance(x, (int, str, bool)):
        return x
    return float(x) if hasattr(x, "as_integer_ratio") else str(x)


def differences(name, spark_rows, columns, duck):
    """What keeps two results apart, or an empty string."""
    names = [c[0] for c in duck.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    there = sorted(str([plain(r[i]) for i in order]) for r in duck.fetchall())
    here = sorted(str([plain(v) for v in r]) for r in spark_rows)
    if here == there:
        return ""
    only = [x for x in here if x not in set(there)][:2], [x for x in there if x not in set(here)][:2]
    return f"{len(here)} and {len(there)} rows; only here {only[0]}, only there {only[1]}"


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connection(sys.argv[1]), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sys.argv[1])
            bad = differences(name, [tuple(r) for r in df.collect()], df.columns, con.execute(sql[name]))
        except Exception as e:
            bad = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{name}: {bad or 'ok'} ({time.time() - began:.1f} s)", flush=True)
