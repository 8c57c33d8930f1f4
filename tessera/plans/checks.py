"""Queries on predicates, joins, aggregates and column functions that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import acquisition, aggregates, joins, raster, spectra, votes, windows
from tessera.plans.base import JOURNAL, PX, TILES, Registry, rounded
from tessera.plans.base import journal as journal_view
from tessera.plans.base import px as px_view
from tessera.plans.base import tiles as tile_view
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

#: A dense image of 64 by 48 grey values, a pixel for each ten by ten places of the label raster.
IMG = f"""{PX}, cells AS (SELECT x // 10 AS x, y // 10 AS y, floor(avg(value) * 5) AS grey, 2 * count(*) FILTER (WHERE valid) >= count(*) AS valid, floor(avg(value))::INT % 4 AS label FROM px GROUP BY 1, 2),
img AS (SELECT 'scan' AS image, a.i::INT AS x, b.j::INT AS y, coalesce(c.grey, 128.0::DOUBLE) AS grey, coalesce(c.valid, true) AS valid, coalesce(c.label, 0)::INT AS label FROM range(64) a(i) CROSS JOIN range(48) b(j) LEFT JOIN cells c ON c.x = a.i AND c.y = b.j)"""


def image(spark: SparkSession, d: str) -> DataFrame:
    cells = px_view(spark, d).groupBy(F.expr("cast(x div 10 as int)").alias("x"), F.expr("cast(y div 10 as int)").alias("y")).agg(
        F.floor(F.avg("value") * 5).cast("double").alias("g"), (2 * F.count_if("valid") >= F.count("*")).alias("v"),
        (F.floor(F.avg("value")) % 4).alias("l")
    )
    grid = spark.range(64 * 48).selectExpr("cast(id % 64 as int) as x", "cast(id div 64 as int) as y")
    return grid.join(cells, ["x", "y"], "left").selectExpr(
        "'scan' as image", "x", "y", "coalesce(g, 128.0D) as grey", "coalesce(v, true) as valid", "cast(coalesce(l, 0) as int) as label"
    )


def coloured(spark: SparkSession, d: str) -> DataFrame:
    return image(spark, d).withColumns({"r": F.col("grey"), "g": F.expr("grey * 0.9D + 20"), "b": F.expr("greatest(0, grey - 30)")})


RGB = IMG + ", rgb AS (SELECT *, grey AS r, grey * 0.9::DOUBLE + 20 AS g, greatest(0, grey - 30) AS b FROM img)"


@registry.add(f"WITH {RGB} SELECT label, count(*) AS n, count(*) FILTER (WHERE NOT (r >= 250 AND g >= 250 AND b >= 250)) AS white_valid, count(*) FILTER (WHERE NOT (r <= 5 AND g <= 5 AND b <= 5)) AS black_valid FROM (SELECT label, r * 1.4 AS r, g * 1.4 AS g, b * 1.4 AS b FROM rgb) GROUP BY label")
def valid_region(spark: SparkSession, d: str) -> DataFrame:
    px = coloured(spark, d).withColumns({c: F.expr(f"{c} * 1.4") for c in "rgb"})
    white = raster.valid_region(px, "white").withColumnRenamed("valid", "w")
    both = raster.valid_region(white, "black")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_if("w").alias("white_valid"), F.count_if("valid").alias("black_valid"))


@registry.add("""SELECT p_partkey AS id, 'defocus' AS category, false AS keep, 0.8::DOUBLE AS confidence, round(p_retailprice / 1000.0::DOUBLE, 6) AS ratio FROM part WHERE p_retailprice / 1000.0::DOUBLE < 0.95""")
def defocus_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), aggregates.defocus_verdict(F.col("p_retailprice"), F.lit(1000.0), 0.95).alias("v")
    ).where("v is not null")
    return rounded(rows.select("id", "v.*"), "ratio")


REFERENCE = """ref AS (SELECT * FROM (VALUES (0, 150.0::DOUBLE, 1.0::DOUBLE, true, false, NULL::DOUBLE, NULL::DOUBLE), (1, 145.0, 1.1, false, true, 1.86, 12.0), (2, 155.0, 1.05, false, false, NULL, NULL), (3, 150.0, NULL, false, false, NULL, NULL)) r(substrate, threshold, amplitude, amp_gap, ea_gap, ea_threshold, ea_gap_mev))"""
FITS = """fits AS (SELECT vec_id, label % 5 AS substrate, 150 + 60 * embedding[1]::DOUBLE AS split, 1 + embedding[2]::DOUBLE AS aa, 1.86 + embedding[3]::DOUBLE / 40 AS ea FROM embeddings)"""
RULES = f"""{FITS}, {REFERENCE}, j AS (SELECT f.*, coalesce(r.threshold, 150.0) AS thr, r.substrate IS NOT NULL AS calibrated, r.amplitude AS amp, coalesce(r.amp_gap, false) AS amp_gap, coalesce(r.ea_gap, false) AS ea_gap, r.ea_threshold, r.ea_gap_mev, f.aa / r.amplitude AS ratio, f.split - coalesce(r.threshold, 150.0) AS margin FROM fits f LEFT JOIN ref r USING (substrate)),
k AS (SELECT *, split >= thr AS tall, (ea - ea_threshold) * 1000 AS ea_margin, coalesce(split >= thr AND ratio < 1 AND amp_gap, false) AS veto_zone, coalesce(split < thr AND amp IS NOT NULL AND NOT amp_gap AND ea_gap, false) AS by_ea FROM j),
l AS (SELECT *, CASE WHEN tall THEN CASE WHEN veto_zone AND ratio <= 0.8 THEN '1L' ELSE '2H' END WHEN amp IS NULL THEN '3R-or-1L' WHEN by_ea THEN CASE WHEN ea_margin >= 0 THEN '1L' ELSE '3R' END WHEN aa < amp THEN '1L' ELSE '3R' END AS label,
  CASE WHEN NOT calibrated THEN 'substrate_uncalibrated' WHEN veto_zone AND ratio > 0.8 THEN 'amp_veto_ambiguous' WHEN by_ea AND abs(ea_margin) < 3 THEN 'ea_ambiguous'
    WHEN by_ea AND (CASE WHEN ea_margin >= 0 THEN '1L' ELSE '3R' END) <> (CASE WHEN aa < amp THEN '1L' ELSE '3R' END) AND NOT (ratio > 0.8 AND ratio < 1.25) THEN 'ea_amp_conflict'
    WHEN NOT tall AND amp IS NOT NULL AND NOT by_ea AND NOT amp_gap AND ratio > 0.8 AND ratio < 1.25 THEN 'amp_nogap_ambiguous' ELSE '' END AS flag,
  CASE WHEN by_ea THEN 'E_A' WHEN NOT tall AND amp IS NOT NULL THEN 'amplitude' ELSE 'splitting' END AS decided_by,
  least(1.0, abs(margin) / 15) AS base FROM k),
rules AS (SELECT *, veto_zone AND ratio <= 0.8 AS vetoed, CASE WHEN NOT calibrated THEN 0.0 WHEN veto_zone AND ratio <= 0.8 THEN least(1.0, greatest(0.0, (1 - ratio) / 0.2)) WHEN veto_zone THEN least(base, least(1.0, greatest(0.0, (1 - ratio) / 0.2))) WHEN by_ea THEN least(base, least(1.0, abs(ea_margin) / greatest(3.0, ea_gap_mev / 2))) ELSE base END AS confidence FROM l)"""


def _rules(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    fits = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") % 5).alias("substrate"), (150 + 60 * e(0)).alias("split"), (1 + e(1)).alias("aa"), (1.86 + e(2) / 40).alias("ea")
    )
    rows = [
        (0, 150.0, 1.0, True, False, None, None), (1, 145.0, 1.1, False, True, 1.86, 12.0), (2, 155.0, 1.05, False, False, None, None),
        (3, 150.0, None, False, False, None, None)
    ]
    reference = spark.createDataFrame(
        rows, "substrate long, threshold double, amplitude double, amp_gap boolean, ea_gap boolean, ea_threshold double, ea_gap_mev double"
    )
    return spectra.assign(spectra.with_reference(fits, reference, "substrate"))


@registry.add(f"WITH {RULES} SELECT vec_id, label, CASE WHEN tall THEN '2H' ELSE '3R-or-1L' END AS stacking, flag, decided_by, coalesce(vetoed, false) AS vetoed, round(margin, 6) AS margin_mev, round(ratio, 6) AS amp_ratio, round(confidence, 6) AS confidence, CASE WHEN by_ea THEN round(ea_margin, 6) END AS ea_margin_mev FROM rules")
def rule_assignments(spark: SparkSession, d: str) -> DataFrame:
    out = _rules(spark, d).select(
        "vec_id", F.col("rule_label").alias("label"), "stacking", F.col("rule_flag").alias("flag"), "decided_by", "vetoed", "margin_mev", "amp_ratio",
        "confidence", "ea_margin_mev"
    )
    return rounded(out, "margin_mev", "amp_ratio", "confidence", "ea_margin_mev")


@registry.add(f"""WITH {RULES}, g AS (SELECT substrate, flag, label = '3R-or-1L' OR abs(margin) < 4 OR flag = 'amp_nogap_ambiguous' AS to_model, flag IN ('amp_veto_ambiguous', 'ea_ambiguous', 'ea_amp_conflict', 'substrate_uncalibrated') OR (flag = 'amp_nogap_ambiguous' AND false) AS escalates FROM rules)
SELECT substrate, flag, count(*) AS n, count(*) FILTER (WHERE to_model) AS to_model, count(*) FILTER (WHERE escalates) AS escalated FROM g GROUP BY ALL""")
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which fits a model sees under the policy that ambiguous amplitudes go to it, and which the rule escalates."""
    g = spectra.gate(_rules(spark, d), 4.0, "model")
    return g.groupBy("substrate", F.col("rule_flag").alias("flag")).agg(
        F.count("*").alias("n"), F.count_if("to_model").alias("to_model"), F.count_if("escalates").alias("escalated")
    )


@registry.add(f"""WITH {PX}, q AS (SELECT label, x // 64 AS part, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.75) AS c FROM px GROUP BY ALL), m AS (SELECT label, part, [a * 4, a * 3.5::DOUBLE, CASE WHEN part = 3 THEN 0 ELSE c * 3 END] AS o FROM q), g AS (SELECT *, [100 / nullif(o[1], 0), 95 / nullif(o[2], 0), 100 / nullif(o[3], 0)] AS gain FROM m)
SELECT label, part, CASE WHEN list_min(o) <= 0 THEN 'black' WHEN list_min(gain) < 0.5 OR list_max(gain) > 2 THEN 'implausible' WHEN greatest(abs(gain[1] - 1), abs(gain[2] - 1), abs(gain[3] - 1)) <= 0.1 THEN 'within_tolerance' ELSE 'differs' END AS verdict FROM g""")
def reference_verdicts(spark: SparkSession, d: str) -> DataFrame:
    m = px_view(spark, d).groupBy("label", F.expr("cast(x div 64 as int)").alias("part")).agg(
        F.percentile("value", 0.5).alias("a"), F.percentile("value", 0.75).alias("c")
    )
    observed = m.withColumn("o", F.array(F.col("a") * 4, F.col("a") * 3.5, F.when(F.col("part") == 3, 0.0).otherwise(F.col("c") * 3)))
    return observed.select(
        "label", "part", acquisition.reference_verdict(F.col("o"), F.array(F.lit(100.0), F.lit(95.0), F.lit(100.0))).alias("v")
    ).select("label", "part", "v.verdict")


LUMA = "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"


@registry.add(f"""WITH {RGB}, l AS (SELECT x, y, {LUMA} AS v FROM rgb), f AS (SELECT x, y, abs(v - lag(v, 1, v) OVER r) <= 40 AND abs(v - lead(v, 1, v) OVER r) <= 40 AND abs(v - lag(v, 1, v) OVER c) <= 40 AND abs(v - lead(v, 1, v) OVER c) <= 40 AS flat FROM l WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT y, count(*) FILTER (WHERE flat) AS flat_px FROM f GROUP BY y""")
def flat_pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.flat_mask(coloured(spark, d), "image", 40.0).groupBy("y").agg(F.count_if("flat").alias("flat_px"))


@registry.add("""WITH s AS (SELECT user_id, strftime(min(ts), '%Y%m%d') AS day FROM events GROUP BY 1), d AS (SELECT min(day) AS first, max(day) AS last FROM s)
SELECT user_id, 'all' AS choice FROM s UNION ALL SELECT user_id, 'since' FROM s, d WHERE day >= d.last UNION ALL SELECT user_id, 'day' FROM s, d WHERE day = d.first UNION ALL SELECT user_id, 'named' FROM s WHERE user_id % 2 = 0""")
def session_selection(spark: SparkSession, d: str) -> DataFrame:
    days = journal_view(spark, d).groupBy("user_id").agg(F.date_format(F.timestamp_micros(F.min("us")), "yyyyMMdd").alias("day"))
    first, last = days.agg(F.min("day"), F.max("day")).head()
    parts = {
        "all": acquisition.choose(days, "user_id", "day"), "since": acquisition.choose(days, "user_id", "day", since=last),
        "day": acquisition.choose(days, "user_id", "day", on=first), "named": acquisition.select_runs(days, "user_id", days.where("user_id % 2 = 0"))
    }
    out = None
    for name, part in parts.items():
        part = part.select("user_id", F.lit(name).alias("choice"))
        out = part if out is None else out.unionByName(part)
    return out


@registry.add(f"""WITH {PX}, t AS (SELECT x // 32 AS tile, avg(5 * value) AS mean, stddev_pop(5 * value) AS std, avg((5 * value <= 2 OR 5 * value >= 240)::INT) AS rails FROM px GROUP BY 1) SELECT tile, std >= 70 AND mean BETWEEN 8 AND 247 AND rails <= 0.5 AS usable FROM t""")
def usable_samples(spark: SparkSession, d: str) -> DataFrame:
    px = px_view(spark, d).select(F.expr("cast(x div 32 as int)").alias("tile"), (F.col("value") * 5).alias("grey"))
    return raster.usable_samples(px, "tile", "grey", least_std=70.0, rails=(2.0, 240.0)).select("tile", "usable")


@registry.add("""WITH m AS (SELECT p_partkey AS id, (p_size % 10) / 10.0 AS flat, (p_partkey % 7) / 6.0 AS plateau, p_partkey % 3 AS others, p_size % 20 AS std, (p_partkey % 100) / 10000.0 AS sat, p_size * 4.0 AS lum FROM part)
SELECT id, list_filter([CASE WHEN flat < 0.5 THEN 'flat' END, CASE WHEN plateau < 0.85 THEN 'plateau' END, CASE WHEN others > 0 THEN 'other_material' END, CASE WHEN std > 12 THEN 'spread' END], lambda x: x IS NOT NULL).array_to_string(',') AS reasons, flat >= 0.5 AND plateau >= 0.85 AND others = 0 AND std <= 12 AS clean, CASE WHEN sat > 0.005 THEN 'saturated' WHEN lum < 40 THEN 'too_dark' ELSE 'ok' END AS exposure FROM m""")
def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").selectExpr(
        "p_partkey as id", "(p_size % 10) / 10.0D as flat_fraction", "(p_partkey % 7) / 6.0D as plateau_share", "p_partkey % 3 as other_plateaus",
        "p_size % 20 as std", "(p_partkey % 100) / 10000.0D as saturated", "p_size * 4.0D as luminance"
    )
    return acquisition.clean_field(m).select("id", F.array_join("reasons", ",").alias("reasons"), "clean", "exposure")


@registry.add("""SELECT event_id, (props->>'$.k') AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS "value", 2::BIGINT AS kept FROM events""")
def redacted_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads without keys that name secrets; numbers that are none become null."""
    rows = table(spark, d, "events").select(
        "event_id",
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"),
            F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string")), F.lit("api_token"), F.lit("x"),
            F.lit("Password"), F.lit("y")
        ).alias("m")
    )
    m = scalar.redact_map(F.col("m"))
    number = scalar.safe_number(m["value"], None)
    return rows.select("event_id", m["k"].alias("k"), number.alias("value"), F.size(m).cast("long").alias("kept"))


@registry.add("""WITH p AS (SELECT p_partkey AS id, p_partkey % 13 - 3 AS dxv, (p_size - 10) * 10 AS dyv, (p_partkey % 40 - 20) * 12 AS dxh, p_size % 5 AS dyh, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 8 END AS scale_div FROM part)
SELECT id, list_filter([CASE WHEN dyv <= 0 OR dxh = 0 THEN 'direction' END, CASE WHEN abs(dxv) >= 320 OR dyv >= 240 OR abs(dxh) >= 320 OR abs(dyh) >= 240 THEN 'overlap' END, CASE WHEN sign(dxh) * (dxh * dyv - dxv * dyh) <= 1e-9 THEN 'degenerate' END, CASE WHEN 320 % scale_div <> 0 OR 240 % scale_div <> 0 THEN 'divisor' END, CASE WHEN least(320 // scale_div, 240 // scale_div) < 8 THEN 'too small' END], lambda x: x IS NOT NULL).array_to_string(',') AS faults FROM p""")
def profile_faults(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(
        "p_partkey as id", "320 as width", "240 as height", "p_partkey % 13 - 3 as dx_v", "(p_size - 10) * 10 as dy_v",
        "(p_partkey % 40 - 20) * 12 as dx_h", "p_size % 5 as dy_h",
        "case p_partkey % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 8 end as scale_div"
    )
    return p.select("id", F.array_join(acquisition.profile_faults(), ",").alias("faults"))


@registry.add("""WITH p AS (SELECT p_partkey AS id, 640 * (p_size % 5) AS nw, 480 * (p_size % 5) + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS nh, p_partkey % 3 <> 0 AS confirmed, 512 AS tile, 64 + p_partkey % 4 AS overlap FROM part)
SELECT id, CASE WHEN nw <= 0 OR nh <= 0 THEN 'nonpositive_image_dimensions' WHEN NOT confirmed THEN 'same_physical_field_of_view_not_confirmed' WHEN 1280 * nh <> 960 * nw THEN 'anisotropic_dimension_ratio_requires_calibration' WHEN (tile * nw) % 1280 <> 0 OR (overlap * nw) % 1280 <> 0 THEN 'nonintegral_native_tile_or_overlap' END AS reason,
  CASE WHEN nw > 0 AND confirmed AND 1280 * nh = 960 * nw AND (tile * nw) % 1280 = 0 AND (overlap * nw) % 1280 = 0 THEN tile * nw // 1280 END::BIGINT AS native_tile, CASE WHEN nw > 0 AND confirmed AND 1280 * nh = 960 * nw AND (tile * nw) % 1280 = 0 AND (overlap * nw) % 1280 = 0 THEN overlap * nw // 1280 END::BIGINT AS native_overlap FROM p""")
def inference_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(
        "p_partkey as id", "640 * (p_size % 5) as nw", "480 * (p_size % 5) + if(p_partkey % 7 = 0, 1, 0) as nh", "p_partkey % 3 <> 0 as confirmed",
        "512 as tile", "64 + p_partkey % 4 as overlap"
    )
    plan = acquisition.inference_plan(F.col("nw"), F.col("nh"), F.lit(1280), F.lit(960), F.col("confirmed"), F.col("tile"), F.col("overlap"))
    return p.select("id", plan.alias("p")).select("id", "p.reason", "p.native_tile", "p.native_overlap")


@registry.add("""WITH l AS (SELECT source, 'd' || doc_id AS name, lang AS sha256 FROM documents WHERE source <> 'src1'), s AS (SELECT source, 'd' || doc_id AS name, CASE WHEN doc_id % 50 = 3 THEN 'x' ELSE lang END AS sha256 FROM documents)
SELECT coalesce(s.source, l.source) AS source, CASE WHEN count(l.name) = 0 THEN 'raw' WHEN bool_and(l.sha256 IS NOT DISTINCT FROM s.sha256) THEN 'already_corrected' ELSE 'invalid' END AS state, count(*) AS tiles FROM s FULL JOIN l ON s.source = l.source AND s.name = l.name GROUP BY 1""")
def colour_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("source", "concat('d', doc_id) as name", "lang as sha256", "doc_id")
    selected = docs.withColumn("sha256", F.expr("if(doc_id % 50 = 3, 'x', sha256)")).drop("doc_id")
    return joins.derived_state(selected, docs.where("source <> 'src1'").drop("doc_id"), "source", "name")


@registry.add("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'preserve' WHEN 1 THEN 'legacy' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'preserve' ELSE 'legacy' END END AS policy FROM part WHERE NOT (p_size % 3 = 0 AND p_partkey % 2 <> 0)""")
def grid_policies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(
        "p_partkey as id", "element_at(array('preserve', 'legacy', 'auto'), cast(p_size % 3 + 1 as int)) as requested",
        "if(p_partkey % 2 = 0, 'flat-physical-grid', 'zip-layout') as source"
    )
    return p.select("id", acquisition.grid_policy(F.col("requested"), F.col("source")).alias("policy")).where("policy is not null")


# ---- joins


@registry.add("""WITH t AS (SELECT o_custkey AS run, o_orderkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders), p AS (SELECT o_custkey AS run, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 5 <> 0)
SELECT run, f, round(p, 2) AS p FROM t JOIN p USING (run, n, total)""")
def files_by_position(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    points = o.where("o_custkey % 3 <> 0 or o_orderkey % 5 <> 0").selectExpr(
        "o_custkey as run", "round(o_totalprice, 2) as p", "struct(o_totalprice, o_orderkey) as place"
    )
    return acquisition.zip_by_position(o.selectExpr("o_custkey as run", "o_orderkey as f"), points, "run", "f", "place").drop("place")


@registry.add("""WITH t AS (SELECT p_partkey // 40 AS col, p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'g' || (p_partkey % 40 // 8) END AS grp FROM part), w AS (SELECT *, lag(id) OVER k AS p, lag(grp) OVER k AS pg, lead(id) OVER k AS f, lead(grp) OVER k AS fg FROM t WINDOW k AS (PARTITION BY col ORDER BY id))
SELECT col, grp, max(CASE WHEN pg IS DISTINCT FROM grp THEN p END) AS before, max(CASE WHEN fg IS DISTINCT FROM grp THEN f END) AS after FROM w WHERE grp IS NOT NULL GROUP BY col, grp""")
def conflict_neighbours(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr(
        "p_partkey div 40 as col", "p_partkey as id", "if(p_size % 4 = 0, concat('g', p_partkey % 40 div 8), null) as grp"
    )
    return acquisition.outside_neighbours(t, "col", "id", "grp", "id")


@registry.add("""SELECT source, count(*) AS tiles, bool_and(doc_id % 40 <> 7) AS bound FROM documents GROUP BY source""")
def input_binding(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: whether the fingerprint of what was prepared is that of what is there now."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", "lang")
    now = docs.withColumn("n_chars", F.expr("if(doc_id % 40 = 7, n_chars + 1, n_chars)"))
    return joins.same_fingerprint(docs, now, "source", ["doc_id", "n_chars", "lang"])


# ---- aggregates


@registry.add(f"""WITH {RGB}, l AS (SELECT *, {LUMA} AS v FROM rgb), f AS (SELECT *, abs(v - lag(v, 1, v) OVER q) <= 60 AND abs(v - lead(v, 1, v) OVER q) <= 60 AND abs(v - lag(v, 1, v) OVER c) <= 60 AND abs(v - lead(v, 1, v) OVER c) <= 60 AS flat FROM l WINDOW q AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
s AS (SELECT floor(v / 16) AS bin, r, g, b FROM f WHERE flat), n AS (SELECT bin, count(*) AS n FROM s GROUP BY 1), best AS (SELECT max(bin) FILTER (WHERE n >= 0.1 * (SELECT count(*) FROM s)) AS bin FROM n)
SELECT round(quantile_cont(r, 0.5), 6) AS r, round(quantile_cont(g, 0.5), 6) AS g, round(quantile_cont(b, 0.5), 6) AS b, count(*) AS pixels FROM s, best WHERE best.bin IS NULL OR s.bin = best.bin""")
def background_colour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.background_colour(coloured(spark, d), "image", 60.0).select("r", "g", "b", "pixels"), "r", "g", "b")


@registry.add("""WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), w AS (SELECT user_id, count(*) FILTER (WHERE n <= 3 AND value > 5) AS votes, count(DISTINCT event_type) FILTER (WHERE n <= 3 AND value > 5) AS kinds, arg_min(event_type, n) FILTER (WHERE n <= 3 AND value > 5) AS verdict, avg(value) FILTER (WHERE n <= 3 AND value > 5) AS confidence FROM a GROUP BY 1)
SELECT count(*) AS sampled, count(*) FILTER (WHERE votes > 0) AS answered, count(*) FILTER (WHERE verdict IN ('error', 'signup')) AS flagged, round(count(*) FILTER (WHERE verdict IN ('error', 'signup'))::DOUBLE / nullif(count(*) FILTER (WHERE votes > 0), 0), 6) AS flagged_frac, count(*) FILTER (WHERE kinds > 1) AS split, count(*) FILTER (WHERE kinds = 1 AND verdict = 'error') AS unanimous_systematic, sum(CASE WHEN votes > 0 THEN 3 - votes ELSE 0 END)::BIGINT AS lost_votes, round(avg(confidence), 6) AS mean_confidence FROM w""")
def audit_pilot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr(
        "user_id", "event_type", "value", "event_id", "row_number() over (partition by user_id order by event_id) as n"
    ).where("n <= 3")
    answered = F.col("value") > 5
    w = e.groupBy("user_id").agg(
        F.count_if(answered).alias("votes"), F.count_distinct(F.when(answered, F.col("event_type"))).alias("kinds"),
        F.min_by(F.when(answered, F.col("event_type")), F.when(answered, F.col("n"))).alias("verdict"),
        F.avg(F.when(answered, F.col("value"))).alias("confidence")
    )
    return rounded(votes.audit_summary(w, 3, ("error", "signup"), "error"), "flagged_frac", "mean_confidence")


@registry.add(f"""WITH {TILES}, t AS (SELECT *, size AS contrast FROM tiles), r AS (SELECT quantile_cont(metric, 0.75) AS ref, count(*) AS n FROM t WHERE contrast >= 4), k AS (SELECT id, col, CASE WHEN contrast < 4 THEN 'low_texture' WHEN metric < 920 OR (ref > 0 AND metric < 0.6 * ref) THEN 'defocused' ELSE 'ok' END AS decision FROM t, r)
SELECT col, count(*) AS frames, count(*) FILTER (WHERE decision = 'ok') AS ok, count(*) FILTER (WHERE decision = 'defocused') AS defocused, count(*) FILTER (WHERE decision = 'low_texture') AS low_texture, coalesce(sum(id) FILTER (WHERE decision = 'defocused'), 0)::BIGINT AS retake FROM k GROUP BY col""")
def focus_folders(spark: SparkSession, d: str) -> DataFrame:
    t = tile_view(spark, d).withColumn("contrast", F.col("size"))
    out = aggregates.focus_decisions(t, "metric", "contrast", 4.0, 920.0, 0.6)
    kind = lambda k: F.count_if(F.col("decision") == k).alias(k)
    return out.groupBy("col").agg(
        F.count("*").alias("frames"), kind("ok"), kind("defocused"), kind("low_texture"),
        F.coalesce(F.sum(F.when(F.col("decision") == "defocused", F.col("id"))), F.lit(0)).alias("retake")
    )


@registry.add("""SELECT event_type AS role, count(*) AS calls, count(*) FILTER (WHERE event_id % 4 = 0) AS cached, count(*) FILTER (WHERE value > 90) AS failed, count(*) FILTER (WHERE value < 2) AS truncated, sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 100 ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY 1""")
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").selectExpr(
        "event_type as role", "event_id % 4 = 0 as cached", "value > 90 as failed", "value < 2 as truncated", "event_id % 100 as tokens"
    )
    return votes.usage(calls, "role")


@registry.add(f"""WITH {IMG}, s AS (SELECT *, lag(grey) OVER r AS l, lead(grey) OVER r AS r_, lag(grey) OVER c AS u, lead(grey) OVER c AS d FROM img WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT image, round(avg(grey), 6) AS mean, round(stddev_pop(grey), 6) AS std, round(var_pop(l + r_ + u + d - 4 * grey), 5) AS focus, round(avg(pow(r_ - l, 2) + pow(d - u, 2)), 5) AS tenengrad, round(avg((grey >= 250 OR grey <= 5)::INT), 6) AS clip_frac, count(*) AS n FROM s GROUP BY image""")
def image_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(raster.tile_metrics(image(spark, d), "image"), "mean", "std", "clip_frac"), "focus", "tenengrad", places=5)


@registry.add(f"""WITH {IMG}, r AS (SELECT x, y, grey FROM img UNION ALL SELECT -1 - x, y, grey FROM img WHERE x < 3 UNION ALL SELECT 127 - x, y, grey FROM img WHERE x >= 61), p AS (SELECT * FROM r UNION ALL SELECT x, -1 - y, grey FROM r WHERE y < 3 UNION ALL SELECT x, 95 - y, grey FROM r WHERE y >= 45)
SELECT i.x, i.y, round(greatest(0, avg(p.grey * p.grey) - pow(avg(p.grey), 2)), 5) AS variance FROM img i JOIN p ON p.x BETWEEN i.x - 3 AND i.x + 3 AND p.y BETWEEN i.y - 3 AND i.y + 3 GROUP BY i.x, i.y""")
def box_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        raster.local_variance(
            raster.mirrored_border(image(spark, d), "image", 64, 48, 3), "image", 3
        ).where("x between 0 and 63 and y between 0 and 47").select("x", "y", "variance"),
        "variance", places=5
    )


def _smoothing() -> str:
    return ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, row in enumerate(windows.smoothing_weights(21, 3)) for j, w in enumerate(row))


@registry.add(f"""WITH w(i, j, w) AS (VALUES {_smoothing()}), p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), t AS (SELECT range AS pos, least(greatest(range - 10, 0), 43) AS start FROM range(64))
SELECT p.vec_id, t.pos::INT AS pos, round(sum(w.w * p.v), 6) AS smooth FROM t JOIN p ON p.pos BETWEEN t.start AND t.start + 20 JOIN w ON w.i = t.pos - t.start AND w.j = p.pos - t.start GROUP BY ALL""")
def smoothed_spectra(spark: SparkSession, d: str) -> DataFrame:
    """A cubic smoothing over 21 samples, the ends by the polynomial of the first and last 21."""
    s = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(windows.smoothed(F.col("embedding").cast("array<double>"), 64, 21, 3)).alias("pos", "smooth")
    )
    return rounded(s, "smooth")


# ---- order and sets


@registry.add("""SELECT user_id, event_id, round(value, 6) AS value, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id))::INT AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return rounded(acquisition.best_candidates(e, "user_id", "value", "event_id", 3), "value")


@registry.add("""SELECT p_partkey AS id, round(abs(p_retailprice - 950), 6) AS deviation FROM part WHERE abs(p_retailprice - 950) > 40 ORDER BY deviation DESC, id LIMIT 50""")
def worst_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The fifty tiles that lie furthest off, of those off by more than a limit; the report's length is the limit."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(F.abs(F.col("p_retailprice") - 950), 6).alias("deviation"))
    return aggregates.outliers(t, "deviation", 40.0, "id", 50)


@registry.add("""SELECT o_custkey AS tile, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, round(max(o_totalprice), 2) AS score FROM orders GROUP BY 1""")
def best_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_custkey as tile", "o_orderkey", "o_totalprice")
    return aggregates.argmax(o, ["tile"], "o_totalprice", "o_orderkey").select(
        "tile", F.col("o_orderkey").alias("best"), F.round("o_totalprice", 2).alias("score")
    )


@registry.add("""WITH a AS (SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0), b AS (SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0), c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 0)
SELECT 'differing' AS kind, id FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)) UNION ALL SELECT 'unmatched', id FROM ((FROM a UNION FROM b UNION FROM c) EXCEPT (SELECT p_partkey FROM part WHERE p_size % 6 = 0)) UNION ALL SELECT 'shared', id FROM (FROM a INTERSECT FROM c)""")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ids = lambda cond: p.where(cond).select(F.col("p_partkey").alias("id"))
    a, b, c = ids("p_size % 2 = 0"), ids("p_size % 3 = 0"), ids("p_partkey % 7 = 0")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return named(joins.symmetric_difference(a, b), "differing").unionByName(
        named(joins.unmatched([a, b, c], ids("p_size % 6 = 0")), "unmatched")
    ).unionByName(named(a.intersect(c), "shared"))


@registry.add("""SELECT p_size % 8 AS x1, p_size % 5 AS y1, min(p_partkey) AS first_id FROM part GROUP BY ALL""")
def appended_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles in the order in which they were first given; one that is there already is not added."""
    p = table(spark, d, "part").selectExpr("p_size % 8 as x1", "p_size % 5 as y1", "p_partkey as first_id")
    return joins.first_seen(p, ["x1", "y1"], "first_id")


@registry.add(f"""WITH {TILES}, f AS (SELECT id, ['mine', 'other'] AS had, list_filter([CASE WHEN metric < 950 THEN 'mine' END, CASE WHEN size > 40 THEN 'large' END], lambda x: x IS NOT NULL) AS own FROM tiles) SELECT id, list_sort(list_concat(['other'], own)).array_to_string(',') AS flags FROM f""")
def replaced_flags(spark: SparkSession, d: str) -> DataFrame:
    t = tile_view(spark, d).withColumn("flags", F.array(F.lit("mine"), F.lit("other")))
    own = F.array_compact(F.array(F.when(F.col("metric") < 950, F.lit("mine")), F.when(F.col("size") > 40, F.lit("large"))))
    return t.select("id", F.array_join(F.array_sort(aggregates.with_flags(F.col("flags"), own, ("mine", "large"))), ",").alias("flags"))


@registry.add("""SELECT source, bool_and(doc_id % 30 <> 4) AS same, count(*) FILTER (WHERE doc_id % 30 = 4) AS unplanned_or_missing FROM documents GROUP BY source""")
def rendered_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    return joins.equal_sets(docs, docs.where("doc_id % 30 <> 4"), "source", "doc_id").withColumnRenamed("differing", "unplanned_or_missing")


# ---- column functions


@registry.add("""SELECT doc_id, nfc_normalize(left(text, 50) || 'é' || chr(101) || chr(769)) AS normal FROM documents""")
def normal_form(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.expr("left(text, 50)"), F.lit("é"), F.lit("é")).alias("t"))
    return docs.select("doc_id", scalar.nfc(F.col("t")).alias("normal"))


@registry.add("""SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 3 = 1 THEN 7200000000 ELSE 0 END AS us, strftime(date_trunc('second', ts), '%Y-%m-%d') AS day, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS stamp FROM events""")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text: without a zone they count as UTC, with an offset by it; and stamps of folders."""
    e = table(spark, d, "events")
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    )
    stamp = F.when(F.col("event_id") % 3 == 2, "no stamp").otherwise(F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd_HHmmss")))
    return e.select(
        "event_id", F.unix_micros(scalar.parse_utc(text)).alias("us"), scalar.local_date(text).alias("day"),
        F.unix_micros(scalar.parse_stamp(stamp)).alias("stamp")
    )


@registry.add("SELECT true AS now_is_utc, true AS not_before_data FROM (SELECT max(ts) FROM events)")
def clock(spark: SparkSession, d: str) -> DataFrame:
    latest = journal_view(spark, d).agg(F.max("us").alias("us"))
    now = scalar.now_utc()
    return latest.select(now.endswith("Z").alias("now_is_utc"), (F.unix_micros(scalar.parse_utc(now)) >= F.col("us")).alias("not_before_data"))


ANSWER = "CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN '0.7' WHEN 2 THEN 'nan' WHEN 3 THEN NULL WHEN 4 THEN '1.5' ELSE '-2' END"


@registry.add(f"""WITH a AS (SELECT event_id, {ANSWER} AS c, CASE event_id % 4 WHEN 0 THEN 'Yes ' WHEN 1 THEN '否' WHEN 2 THEN 'maybe' END AS d FROM events)
SELECT event_id, CASE c WHEN '0.7' THEN 0.7 WHEN '1.5' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, event_id % 4 IN (0, 1) AS countable, c IN ('0.7', '1.5', '-2') AND c IS NOT NULL AS finite, CASE c WHEN '0.7' THEN 0 WHEN '1.5' THEN 1 WHEN '-2' THEN -2 ELSE 9 END::BIGINT AS whole, CASE c WHEN '0.7' THEN 0.7 WHEN '1.5' THEN 1.5 WHEN '-2' THEN -2.0 ELSE 0.5 END::DOUBLE AS number, CASE c WHEN '0.7' THEN 1 WHEN '1.5' THEN 1 WHEN '-2' THEN -1 ELSE 0 END::INT AS direction FROM a""")
def answer_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr(
        "event_id", f"{ANSWER} as c", "case event_id % 4 when 0 then 'Yes ' when 1 then '否' when 2 then 'maybe' end as d"
    )
    number = F.col("c").try_cast("double")
    finite = F.coalesce(aggregates.finite(number), F.lit(False))
    return e.select(
        "event_id", scalar.confidence(F.col("c")).alias("confidence"), scalar.countable(F.col("d")).alias("countable"), finite.alias("finite"),
        scalar.safe_int(F.col("c"), 9).alias("whole"), scalar.safe_number(F.col("c"), 0.5).alias("number"),
        scalar.direction(scalar.safe_number(F.col("c"), 0.0)).alias("direction")
    )


@registry.add("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || ' KB' ELSE printf('%.1f', b / 1048576.0) || ' MB' END AS size, printf('%.2f', 100.0 * (doc_id % 8) / 8) || ' %' AS share, CASE WHEN doc_id % 3 = 0 THEN 'unavailable' ELSE (doc_id % 100) || ' (ok)' END AS readback FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("b"))
    value = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise((F.col("doc_id") % 100).cast("string"))
    status = F.when(F.col("doc_id") % 3 == 0, "unavailable").otherwise("ok")
    return docs.select(
        "doc_id", scalar.human_bytes(F.col("b")).alias("size"), scalar.format_share((F.col("doc_id") % 8) / 8).alias("share"),
        scalar.readback(value, status).alias("readback")
    )


@registry.add("""WITH v AS (SELECT event_id, value, 30.0 AS period FROM events), c AS (SELECT event_id, unnest([value - period, value, value + period]) AS candidate FROM v) SELECT event_id, round(candidate, 6) AS candidate FROM c WHERE abs(candidate) <= 60 AND abs(candidate - 20) <= 40""")
def congruent_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_id", "value", F.lit(30.0).alias("period"))
    return rounded(acquisition.congruent("value", "period", v, 60.0, 20.0, 40.0).select("event_id", "candidate"), "candidate")


@registry.add("""SELECT vec_id, round((1 + embedding[1]) * exp(-pow(1.85 - embedding[2]::DOUBLE / 10 - 1.8, 2) / (2 * 0.04 * 0.04)) + 0.5 * exp(-pow(1.85 - embedding[2]::DOUBLE / 10 - 2.0, 2) / (2 * 0.05 * 0.05)) + 0.1 + 0.2 * (1.85 - embedding[2]::DOUBLE / 10), 6) AS signal FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)""")
def two_peaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    x = 1.85 - F.col("e")[1] / 10
    lit = F.lit
    out = scalar.two_peaks(x, (lit(1.8), lit(0.04), 1 + F.col("e")[0]), (lit(2.0), lit(0.05), lit(0.5)), (lit(0.1), lit(0.2), lit(0.0)))
    return e.select("vec_id", F.round(out, 6).alias("signal"))


@registry.add("""SELECT p_partkey AS id, 's' || (p_partkey % 3) AS sample, round((p_size + 2 * p_size + 1) / 2.0, 1) AS x, round((p_size + p_size + 7) / 2.0, 1) AS y, (p_size * 100)::BIGINT AS area, (round_even(1000 - p_size * 1.5, 0))::BIGINT AS dx, round(p_size * 0.5::DOUBLE, 6) AS um, round(p_size * 2.25::DOUBLE, 6) AS px FROM part""")
def keys_and_steps(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = scalar.box_key(
        F.concat(F.lit("s"), F.col("p_partkey") % 3), F.col("p_size"), 2 * F.col("p_size") + 1, F.col("p_size"), F.col("p_size") + 7,
        F.col("p_size") * 100
    )
    return p.select(
        F.col("p_partkey").alias("id"), key.alias("k"), scalar.grid_step(F.lit(1000), F.col("p_size") * 1.5).alias("dx"),
        F.round(F.col("p_size") * 0.5, 6).alias("um"), F.round(F.col("p_size") * 2.25, 6).alias("px")
    ).select("id", "k.sample", "k.x", "k.y", "k.area", "dx", "um", "px")


@registry.add("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean_of_unrounded, sum(round_even(l_extendedprice / 1000, 0))::BIGINT AS half_even FROM lineitem GROUP BY 1")
def rounding_policy(spark: SparkSession, d: str) -> DataFrame:
    """Values stay unrounded until the last step; whole numbers are rounded half to even."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("mean_of_unrounded"),
        F.sum(F.rint(F.col("l_extendedprice") / 1000)).cast("long").alias("half_even")
    )


@registry.add(f"WITH {RGB} SELECT x // 4 AS x, y // 4 AS y, round(avg({LUMA}), 9) AS grey FROM rgb WHERE x < 64 AND y < 48 GROUP BY ALL")
def reduced_image(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        raster.downsample(coloured(spark, d), "image", 64, 48, 16).select(
            F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "grey"
        ),
        "grey", places=9
    )


@registry.add(f"""WITH {TILES}, p AS (SELECT id, col * 95.5::DOUBLE + "row" * 1.25 AS x, col * -2.0::DOUBLE + "row" * 71.0 AS y FROM tiles) SELECT id, round(x - (SELECT min(x) FROM p), 6) AS x, round(y - (SELECT min(y) FROM p), 6) AS y FROM p""")
def nominal_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(acquisition.nominal_positions(tile_view(spark, d), (1.25, 71.0), (95.5, -2.0)).select("id", "x", "y"), "x", "y")


@registry.add("""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 3 THEN NULL ELSE 'runs/' || page_id || '/a.json' END AS path FROM pages""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths below a folder in plain form; those that leave it are null."""
    raw = F.expr("case page_id % 4 when 0 then concat('runs/./', page_id, '//a.json') when 1 then concat('runs/../../', page_id) when 2 then concat('runs/x/../', page_id, '/a.json') else concat('/etc/', page_id) end")
    return table(spark, d, "pages").select("page_id", scalar.inside(raw).alias("path"))


@registry.add("""SELECT source, 'container ' || source || ': ' || count(*) || ' files, ' || count(*) FILTER (WHERE lang = 'en') || ' matched (' || printf('%.1f', 100.0 * count(*) FILTER (WHERE lang = 'en') / count(*)) || ' %)' AS line FROM documents GROUP BY source""")
def layout_report(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("matched"))
    return n.select("source", scalar.report_line("source", "n", "matched").alias("line"))


@registry.add(f"""WITH {JOURNAL}, s AS (SELECT user_id, sequence, event_id FROM journal WHERE sequence <= 5 + user_id % 3), r AS (SELECT j.user_id, bool_and(s.event_id IS NULL OR s.event_id = j.event_id) AS is_prefix, count(s.event_id) AS copied, count(*) AS total FROM journal j LEFT JOIN s USING (user_id, sequence) GROUP BY 1) SELECT user_id, copied, total, is_prefix, total - copied AS to_append FROM r""")
def prefix_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Journals whose live copy is an exact prefix, and how many events the copy lacks."""
    from tessera.operators import journal as journals

    j = journal_view(spark, d)
    return journals.prefix_of(j.where("sequence <= 5 + user_id % 3"), j, "user_id")


@registry.add(f"""WITH {RULES}, t AS (SELECT substrate, flag, label, CASE vec_id % 3 WHEN 0 THEN '2H' WHEN 1 THEN '1L' ELSE '3R' END AS truth FROM rules)
SELECT substrate, flag AS rule_flag, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE truth = label OR (truth IN ('1L', '3R') AND label = '3R-or-1L')) AS agreed, round(count(*) FILTER (WHERE truth = label OR (truth IN ('1L', '3R') AND label = '3R-or-1L'))::DOUBLE / count(label), 6) AS rate FROM t GROUP BY ALL""")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    truth = F.element_at(F.array(F.lit("2H"), F.lit("1L"), F.lit("3R")), (F.col("vec_id") % 3 + 1).cast("int"))
    return spectra.agreement(_rules(spark, d), ["substrate", "rule_flag"], truth, F.col("rule_label"), (("1L", "3R-or-1L"), ("3R", "3R-or-1L")))


@registry.add("""SELECT event_id, event_id % 4 = 0 AS cached, CASE WHEN event_id % 4 = 0 THEN 'seen ' || event_type END AS answer FROM events""")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("role"), (F.col("event_id") % 1000).alias("part"))
    payload = ["event_id", "role", "part"]
    store = e.where("event_id % 4 = 0").select(
        F.sha2(F.to_json(F.struct(*payload)), 256).alias("request"), F.concat(F.lit("seen "), F.col("role")).alias("answer")
    )
    return joins.cached_answers(e, store, payload).select("event_id", "cached", "answer")


NEAR = "pos AS (SELECT p_partkey AS id, (p_partkey * 37 % 400)::DOUBLE AS x, (p_size * 8)::DOUBLE AS y FROM part), pr AS (SELECT a.id AS a, b.id AS b FROM pos a JOIN pos b ON a.id < b.id AND abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 12)"


@registry.add(f"""WITH RECURSIVE {NEAR}, nb AS (SELECT b AS id, list(a) AS smaller FROM pr GROUP BY 1), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT a AS id FROM pr UNION SELECT b FROM pr)), seq AS (SELECT n, ids.id, coalesce(smaller, []) AS smaller FROM ids LEFT JOIN nb USING (id)),
r(n, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.n + 1, CASE WHEN list_has_any(r.leaders, s.smaller) THEN r.leaders ELSE list_append(r.leaders, s.id) END FROM r JOIN seq s ON s.n = r.n + 1), last AS (SELECT unnest(arg_max(leaders, n)) AS id FROM r)
SELECT min(a) AS leader, b AS member FROM pr WHERE a IN (SELECT id FROM last) AND b NOT IN (SELECT id FROM last) GROUP BY b""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tiles at nearly one place, grouped greedily in the order of their ids."""
    pos = table(spark, d, "part").selectExpr("p_partkey as id", "cast(p_partkey * 37 % 400 as double) as x", "cast(p_size * 8 as double) as y")
    return joins.band_groups(pos, 8.0, 12.0, "id")
