"""Run registered queries against their SQL twins: ``python tests/compare.py FOLDER [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, every value as comparable text, rows sorted."""
    def text(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, bool):
            return str(value)
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        try:
            return f"{float(value) + 0.0:.9g}" if not isinstance(value, str) else value
        except (TypeError, ValueError):
            return str(value)

    frame = frame[sorted(frame.columns)].map(text).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when both hold the same rows under the same column names."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows and {len(sql_frame)} rows"
    left, right = canonical(spark_frame), canonical(sql_frame)
    unequal = (left != right).any(axis=1)
    if unequal.any():
        at = unequal.idxmax()
        return f"{int(unequal.sum())} rows differ, first {dict(left.loc[at])} and {dict(right.loc[at])}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from riskrank.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskrank-")})
    connection, twins, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, folder).toPandas()
            spent = time.time() - start
            if name not in twins:
                verdict = f"rows only ({len(got)})"
            else:
                problem = difference(got, connection.execute(twins[name]).df())
                verdict = f"equal ({len(got)})" if problem is None else f"DIFFERS: {problem}"
                bad += problem is not None
        except Exception as error:  # report every query, then fail
            spent, verdict = time.time() - start, f"ERROR: {str(error)[:600]}"
            bad += 1
        print(f"{name:32s} {spent:6.2f}s  {verdict}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
