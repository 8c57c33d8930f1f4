"""Queries on spectra; embeddings stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import spectra, windows
from tessera.plans.base import Registry
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

POINTS = "pts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS val, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))


@registry.add(f"WITH {POINTS} SELECT label, pos::INT AS pos, round(quantile_cont(val, 0.5), 6) AS median, count(*) AS n FROM pts GROUP BY ALL")
def array_template_median(spark: SparkSession, d: str) -> DataFrame:
    return spectra.templates(_spectra(spark, d), ["label"], "vec_id", "y").withColumn("median", F.round("median", 6))


@registry.add(f"""WITH {POINTS}, t AS (SELECT label AS tl, pos, quantile_cont(val, 0.5) AS m FROM pts GROUP BY ALL), r AS (SELECT vec_id, tl, corr(val, m) AS r FROM pts JOIN t USING (pos) GROUP BY ALL)
SELECT vec_id, arg_max(tl, r) AS best_label, round(max(r), 6) AS r FROM r GROUP BY vec_id""")
def shape_correlation(spark: SparkSession, d: str) -> DataFrame:
    s = _spectra(spark, d)
    best = spectra.shape_correlation(s, spectra.templates(s, ["label"], "vec_id", "y"), "vec_id", "y")
    return best.select("vec_id", F.col("best.t_label").alias("best_label"), F.round("r", 6).alias("r"))


@registry.add(f"""WITH {POINTS}, m AS (SELECT vec_id, quantile_cont(val, 0.5) FILTER (WHERE pos >= 20 AND pos < 40) AS band, quantile_cont(val, 0.5) FILTER (WHERE pos < 20) AS base FROM pts GROUP BY vec_id)
SELECT vec_id, CASE WHEN band IS NULL OR base IS NULL THEN NULL WHEN band < base THEN -1 ELSE 1 END AS orientation FROM m""")
def orientation_sign(spark: SparkSession, d: str) -> DataFrame:
    return spectra.orientation(_spectra(spark, d), "vec_id", "y", (20, 40), (0, 20))


@registry.add("""WITH m AS (SELECT vec_id, len(embedding) AS n, list_max(embedding)::DOUBLE AS top, list_min(embedding)::DOUBLE AS low, len(list_filter(embedding, lambda v: v = list_max(embedding))) / len(embedding) AS sat FROM embeddings),
f AS (SELECT vec_id, list_filter([CASE WHEN n < 60 THEN 'short' END, CASE WHEN sat > 0.5 THEN 'saturated' END, CASE WHEN top - low < 0.45 THEN 'flat' END], lambda x: x IS NOT NULL) AS r, list_filter([CASE WHEN top - low < 0.5 THEN 'weak' END, CASE WHEN top < 0.25 THEN 'low' END], lambda x: x IS NOT NULL) AS w FROM m)
SELECT vec_id, array_to_string(list_concat(r, w), ',') AS reasons, CASE WHEN len(r) > 0 THEN 'reject' WHEN len(w) > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM f""")
def spectrum_qc_rules(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    m = _spectra(spark, d).select(
        "vec_id", F.size(y).alias("n"), F.array_max(y).alias("top"), F.array_min(y).alias("low"), spectra.saturation_share(y).alias("sat")
    )
    span = F.col("top") - F.col("low")
    rules = [
        ("short", F.col("n") < 60, "reject"), ("saturated", F.col("sat") > 0.5, "reject"), ("flat", span < 0.45, "reject"),
        ("weak", span < 0.5, "warn"), ("low", F.col("top") < 0.25, "warn")
    ]
    return spectra.quality(m, rules).select("vec_id", F.array_join("reasons", ",").alias("reasons"), "verdict")


FITS = "fits AS (SELECT vec_id, label % 3 AS substrate, CASE label % 2 WHEN 0 THEN '1L' ELSE '2L' END AS truth, 150 + 100 * embedding[1]::DOUBLE AS split, 1 + embedding[2]::DOUBLE AS ratio FROM embeddings)"


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "vec_id", "label % 3 as substrate", "case label % 2 when 0 then '1L' else '2L' end as truth",
        "150 + 100 * cast(embedding[0] as double) as split", "1 + cast(embedding[1] as double) as ratio"
    )


@registry.add(f"""WITH {FITS}, m AS (SELECT substrate, quantile_cont(split, 0.5) FILTER (WHERE truth = '1L') AS a, quantile_cont(split, 0.5) FILTER (WHERE truth = '2L') AS b, max(split) FILTER (WHERE truth = '1L') AS am, min(split) FILTER (WHERE truth = '2L') AS bm FROM fits GROUP BY substrate)
SELECT substrate, round(a, 6) AS low_median, round(b, 6) AS high_median, round(coalesce((a + b) / 2.0, 140.0), 6) AS threshold, coalesce(bm - am >= 8, false) AS separated FROM m""")
def calibrate_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return spectra.calibrate(_fits(spark, d), ["substrate"], F.col("truth"), F.col("split"), "1L", "2L", 140.0, 8.0)


@registry.add("""SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) FILTER (WHERE quality = (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)) AS agreed, round(count(*) FILTER (WHERE quality = (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END))::DOUBLE / nullif(count(quality), 0), 6) AS rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return spectra.agreement(rows, ["lang"], F.col("guess"), F.col("quality"))


@registry.add("""WITH r AS (SELECT user_id, event_id, value, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
s AS (SELECT *, abs(value - rolling) AS residual FROM r), t AS (SELECT user_id, quantile_cont(residual, 0.5) AS typical, count(*) AS n FROM s GROUP BY 1)
SELECT user_id, event_id, value, round(rolling, 6) AS rolling FROM s JOIN t USING (user_id) WHERE n <= 25 OR residual IS NULL OR typical = 0 OR residual < 2 * typical""")
def rolling_median_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    return windows.rolling_median_clean(rows, "user_id", ["ts", "event_id"], "value", factor=2.0).select(
        "user_id", "event_id", "value", F.round("rolling", 6).alias("rolling")
    )


@registry.add("""WITH g AS (SELECT vec_id, embedding AS y FROM embeddings), x AS (SELECT vec_id, y, unnest([-1.0, 0.0, 10.25, 31.5, 62.75, 63.0, 99.0]) AS g FROM g)
SELECT vec_id, round(sum(CASE WHEN g <= 0 THEN y[1]::DOUBLE WHEN g >= 63 THEN y[64]::DOUBLE ELSE y[floor(g)::INT + 1]::DOUBLE + (g - floor(g)) * (y[floor(g)::INT + 2]::DOUBLE - y[floor(g)::INT + 1]::DOUBLE) END), 6) AS total FROM x GROUP BY vec_id""")
def interpolated_sum(spark: SparkSession, d: str) -> DataFrame:
    s = _spectra(spark, d).withColumn("x", F.expr("transform(sequence(0, size(y) - 1), i -> cast(i as double))"))
    on_grid = s.select("vec_id", spectra.interpolate([-1.0, 0.0, 10.25, 31.5, 62.75, 63.0, 99.0], "y", "x").alias("g"))
    return on_grid.select("vec_id", F.round(F.aggregate("g", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))
