import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_narrowing_equals_the_built_in(spark, monkeypatch, p):
    monkeypatch.setattr(quantiles, "SORTED", 5)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=301)] + [("b", float(x)) for x in rng.integers(0, 3, 200)] + [
        ("c", 7.0), ("d", None), ("e", 1e300), ("e", -1e300), (None, 1.5), (None, 2.5), ("a", float("nan"))
    ]
    df = spark.createDataFrame(rows, "g string, v double")
    plain = {r.g: (r.q, r.n) for r in quantiles.quantile(df, ["g"], "v", p, "q").collect()}
    cut = {r.g: (r.q, r.n) for r in quantiles.quantile(df, ["g"], "v", p, "q", held=0).collect()}
    assert cut == plain
    assert plain["a"][0] == pytest.approx(np.quantile([v for g, v in rows if g == "a" and v == v], p))


def test_no_map_of_many_different_values(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quantiles, "narrowed", lambda rows, by, p, name, f=quantiles.narrowed: seen.append(name) or f(rows, by, p, name))
    df = spark.range(50_001).selectExpr("id % 1 as g", "cast(id * 7919 % 50001 as double) as v")
    assert [tuple(r) for r in quantiles.quantile(df, ["g"], "v", 0.5, "q").collect()] == [(0, 25_000.0, 50_001)] and seen == ["q"]


def test_rows_meet_their_bounds_where_they_are(spark):
    """Bounds of few groups are broadcast: a group's rows are not gathered in a task to be sorted."""
    rows = spark.range(5_000).selectExpr("id % 2 as g", "cast(id * 7 % 5003 as double) as _v")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles.narrowed(rows, ["g"], 0.5, "q")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
