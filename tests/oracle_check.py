"""Compare queries with their SQL: python tests/oracle_check.py <sf dir> [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from gleanmill.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def compare(spark, con, folder, name):
    """None when equal, else a short description."""
    frame = entry.queries()[name](spark, folder)
    names = sorted(frame.columns)
    got = normal(frame.select(*[f"`{n}`" for n in names]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = normal([tuple(r[i] for i in order) for r in result.fetchall()])
    if got == want:
        return None if got else "empty on both sides"
    missing = sorted(set(want) - set(got))[:2]
    extra = sorted(set(got) - set(want))[:2]
    return f"{len(got)} rows, SQL {len(want)}\n   only SQL:   {missing}\n   only Spark: {extra}"


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in chosen or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if problem is None else problem}", flush=True)
    print(f"{bad} bad")
