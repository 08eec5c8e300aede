"""Runs a query and its DuckDB SQL side by side."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame


def normal(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "asDict"):
        return normal(list(v.asDict().values()))
    if isinstance(v, dict):
        return normal(list(v.values()))
    if type(v).__name__ == "Decimal":
        return normal(float(v))
    return v


def differences(got: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows (as a bag), else what differs."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(normal(r[names.index(c)]) for c in order) for r in want.fetchall())
    ours = Counter(tuple(normal(r[c]) for c in order) for r in got.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here: {list((ours - theirs).items())[:2]}; only there: {list((theirs - ours).items())[:2]}"
