"""Queries on robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates
from tessera.plans.base import Registry
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


@registry.add("""WITH b AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.5) AS med, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT l.l_linestatus, any_value(med) AS med, any_value(n) AS n, quantile_cont(abs(l_extendedprice - med), 0.5) AS mad FROM lineitem l JOIN b ON l.l_linestatus = b.l_linestatus GROUP BY 1),
r AS (SELECT l.l_linestatus, any_value(med) AS med, any_value(mad) AS mad, any_value(n) AS n, sum(l_extendedprice * l_quantity) FILTER (WHERE abs(l_extendedprice - med) <= 3 * 1.4826 * mad) / sum(l_quantity) FILTER (WHERE abs(l_extendedprice - med) <= 3 * 1.4826 * mad) AS m FROM lineitem l JOIN s ON l.l_linestatus = s.l_linestatus GROUP BY 1)
SELECT l_linestatus, n, round(med, 6) AS med, round(mad, 6) AS mad, round(CASE WHEN mad < 1e-6 OR n < 4 THEN med ELSE m END, 6) AS robust FROM r""")
def robust_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.robust_mean(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity")


@registry.add("""WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1),
s AS (SELECT l.l_returnflag, any_value(med) AS med, quantile_cont(abs(l_extendedprice - med), 0.5) AS mad FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1)
SELECT l.l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs((l_extendedprice - med) / (1.4826 * mad)) > 1.2) AS outliers, round(max((l_extendedprice - med) / (1.4826 * mad)), 6) AS top FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag GROUP BY 1""")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    z = aggregates.mad_z(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return z.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.abs("z") > 1.2).alias("outliers"), F.round(F.max("z"), 6).alias("top"))


@registry.add("""WITH i AS (SELECT l_returnflag AS kind, l_suppkey AS g, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY ALL), b AS (SELECT kind, quantile_cont(m, 0.5) AS base FROM i GROUP BY 1)
SELECT kind, g, round(m, 6) AS group_median, round(base, 6) AS baseline, round(m - base, 6) AS residual FROM i JOIN b USING (kind)""")
def nested_median_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag as kind", "l_suppkey as g", "l_extendedprice as v")
    return aggregates.nested_median_baseline(rows, "kind", "g", "v")
