"""Compare every query with its SQL: python tests/verify.py [tables] [name ...]. Not collected by pytest."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from loomspark.runtime import get_spark  # noqa: E402


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join("∅" if not isinstance(v, (list,)) and pd.isna(v) else (str(int(v)) if v == int(v) else f"{v:.9g}") if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


def main(folder: str, names: list[str]) -> int:
    spark = get_spark(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    bad = 0
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = f(spark, folder).toPandas()
            sql = entry.oracle_sql().get(name)
            took = time.time() - t
            if sql is None:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            t = time.time()
            want = con.execute(sql).df()
            took2 = time.time() - t
            a, b = rows(got), rows(want)
            ok = sorted(got.columns) == sorted(want.columns) and a == b
            bad += not ok
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(a)} {len(b)} rows, {took:.1f} s, SQL {took2:.1f} s", flush=True)
            if not ok:
                print("   columns", sorted(got.columns), sorted(want.columns))
                print("   ", [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2])
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(min(1, main(args[0], args[1:])))
