"""Whether a query's rows are those that its SQL gives in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, norm(y)) for k, y in sorted(x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        return norm(x.asDict())
    return bytes(x) if isinstance(x, (bytearray, memoryview)) else x


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty, or what is different."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want_rows = found.fetchall()
    df = query(spark, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, in SQL {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in want_rows)
    got = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    if want == got:
        return ""
    more, less = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"{sum(got.values())} rows, in SQL {sum(want.values())}; only here: {str(more)[:600]}; only in SQL: {str(less)[:600]}"
