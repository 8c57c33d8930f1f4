"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


def same(spark_df, duck_rel):
    cols = sorted(spark_df.columns)
    assert cols == sorted(duck_rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())
    at = [duck_rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in duck_rel.fetchall())
    assert ours == theirs
    return len(ours)
