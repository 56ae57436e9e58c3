"""Runs every query beside its SQL oracle: python tests/oracle.py [SF_DIR [NAME...]]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


def difference(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if x != y:
        return f"{len(x)} and {len(y)} rows; first different {next(((p, q) for p, q in zip(x, y) if p != q), None)}"
    return None if x else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, q in entry.queries().items():
        if names and name not in names or not names and name.startswith(("op", "pipeline")):
            continue
        began = time.time()
        try:
            said = difference(spark, con, sf_dir, q, sql[name]) if name in sql else (None if q(spark, sf_dir).count() else "no rows")
        except Exception as e:  # noqa: BLE001
            said = str(e)[:600]
        bad += said is not None
        if said or names:
            print(name, said or "equal", f"{time.time() - began:.1f} s", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
