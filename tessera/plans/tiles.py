"""Queries on the grid of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, joins, windows
from tessera.plans.base import TILES, Registry, tiles
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


@registry.add(f"""WITH {TILES}, o AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY id) - 1 AS "order", count(*) OVER (PARTITION BY col) AS n FROM tiles)
SELECT id, col, "order", (CASE WHEN col % 2 = 1 THEN n - 1 - "order" ELSE "order" END)::INT AS nominal_row FROM o""")
def tile_order_serpentine(spark: SparkSession, d: str) -> DataFrame:
    return windows.serpentine_order(tiles(spark, d), "col", "id", F.col("col") % 2 == 1).select(
        "id", "col", F.col("order").cast("long").alias("order"), "nominal_row"
    )


@registry.add(f"""WITH {TILES}, p AS (SELECT *, dense_rank() OVER (ORDER BY row) AS ri, dense_rank() OVER (ORDER BY col) AS ci FROM tiles)
SELECT 'v' AS kind, a.row, a.col, b.row AS row2, b.col AS col2, a.metric AS "value", b.metric AS value2 FROM p a JOIN p b ON b.ri = a.ri + 1 AND b.ci = a.ci
UNION ALL SELECT 'h', a.row, a.col, b.row, b.col, a.metric, b.metric FROM p a JOIN p b ON b.ri = a.ri AND b.ci = a.ci + 1""")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.neighbour_pairs(tiles(spark, d))


@registry.add(f"""WITH {TILES}, s AS (SELECT id, row, col, id % 3 AS run FROM tiles)
SELECT 'right' AS side, count(*) AS seams FROM s a JOIN s b ON b.row = a.row AND b.col = a.col + 1 WHERE a.run <> b.run
UNION ALL SELECT 'below', count(*) FROM s a JOIN s b ON b.row = a.row + 1 AND b.col = a.col WHERE a.run <> b.run""")
def cross_run_seams(spark: SparkSession, d: str) -> DataFrame:
    runs = tiles(spark, d).withColumn("run", F.expr("id % 3"))
    pairs = joins.neighbour_pairs(runs, "run").where("value <> value2")
    return pairs.groupBy(F.when(F.col("kind") == "h", "right").otherwise("below").alias("side")).agg(F.count("*").alias("seams"))


@registry.add(f"""WITH {TILES}, o AS (SELECT a.col, a.row, off AS "offset", 1 - abs(a.metric - b.metric) / 1000 AS s FROM tiles a CROSS JOIN (SELECT unnest(range(-3, 4)) AS off) JOIN tiles b ON b.col = a.col + 1 AND b.row = a.row + off),
v AS (SELECT col, "offset", count(*) AS edges, avg(s) AS mean_score FROM o WHERE s >= 0.9 GROUP BY ALL HAVING count(*) > 1 OR avg(s) >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY edges DESC, round(mean_score, 9) DESC, abs("offset"), "offset") AS rn FROM v)
SELECT r.col, (CASE WHEN r."offset" = 0 OR z.col IS NULL OR r.edges > z.edges OR r.mean_score > z.mean_score + 0.1 THEN r."offset" ELSE 0 END)::INT AS "offset", r.edges, round(r.mean_score, 6) AS mean_score
FROM r LEFT JOIN v z ON z.col = r.col AND z."offset" = 0 WHERE rn = 1""")
def offset_votes(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.offset_candidates(tiles(spark, d), 3)
    return joins.vote_offsets(pairs, 1 - F.abs(F.col("value") - F.col("value2")) / 1000, 0.9)


@registry.add(f"""WITH {TILES}, l AS (SELECT col, row, id FROM tiles WHERE size <= 10), r AS (SELECT col, row AS row2, metric FROM tiles WHERE size > 40),
m AS (SELECT l.*, row2, metric, row_number() OVER (PARTITION BY id ORDER BY abs(row2 - row), row2) AS rn FROM l LEFT JOIN r USING (col))
SELECT id, col, row, row2 AS near_row, metric AS near_metric FROM m WHERE rn = 1""")
def nearest_bridge(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    left, right = t.where("size <= 10").select("col", "row", "id"), t.where("size > 40").selectExpr("col", "row as row2", "metric")
    return joins.nearest_by_key(left, right, "col", "row", "row2").select(
        "id", "col", "row", F.col("nearest.row2").alias("near_row"), F.col("nearest.metric").alias("near_metric")
    )


@registry.add(f"""WITH {TILES}, p AS (SELECT row, col FROM tiles WHERE size > 5), g AS (SELECT r.row, c.col FROM (SELECT DISTINCT row FROM p) r CROSS JOIN (SELECT DISTINCT col FROM p) c)
SELECT row, col FROM g ANTI JOIN p USING (row, col)""")
def missing_grid_positions(spark: SparkSession, d: str) -> DataFrame:
    return joins.missing_positions(tiles(spark, d).where("size > 5"))


@registry.add(f"""WITH {TILES}, p AS (SELECT id, col * 90 AS x, row * 70 AS y, size < 13 AS dropped FROM tiles),
c AS (SELECT id, dropped, cx, unnest(range(y // 10, (y + 99) // 10 + 1)) AS cy FROM (SELECT id, dropped, y, unnest(range(x // 10, (x + 119) // 10 + 1)) AS cx FROM p)),
k AS (SELECT DISTINCT cx, cy, 1 AS hit FROM c WHERE NOT dropped)
SELECT id, count(*) AS cells, count(hit) AS covered, count(hit) / count(*) < 0.55 AS rescued FROM c LEFT JOIN k USING (cx, cy) WHERE dropped GROUP BY id""")
def coverage_rescue(spark: SparkSession, d: str) -> DataFrame:
    placed = tiles(spark, d).selectExpr("id", "col * 90 as x", "row * 70 as y", "size")
    return joins.coverage_rescue(placed, "size < 13", 120, 100, 10)


PLACED = "p AS (SELECT id, metric * 3 AS x, row * 40.0::DOUBLE AS y FROM tiles)"


@registry.add(f"WITH {TILES}, {PLACED} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) < 3.0 AND abs(a.y - b.y) < 50")
def spatial_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return joins.band_pairs(tiles(spark, d).selectExpr("id", "metric * 3 as x", "row * 40.0D as y"), 3.0, 50.0, "id")


@registry.add(f"""WITH RECURSIVE {TILES}, {PLACED}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) < 3.0 AND abs(a.y - b.y) < 50),
w(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.seen)
SELECT component, count(*) AS members FROM (SELECT node, min(seen) AS component FROM w GROUP BY node) GROUP BY component""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return joins.band_components(tiles(spark, d).selectExpr("id", "metric * 3 as x", "row * 40.0D as y"), 3.0, 50.0, "id")


@registry.add(f"""WITH {TILES}, l AS (SELECT col, round(quantile_cont(metric, 0.5), 6) AS level FROM tiles GROUP BY col),
j AS (SELECT *, coalesce((abs(level - lag(level) OVER (ORDER BY col)) > 20)::INT, 0) AS jump FROM l),
s AS (SELECT *, (sum(jump) OVER (ORDER BY col))::INT AS segment FROM j), z AS (SELECT *, count(*) OVER (PARTITION BY segment) AS size FROM s)
SELECT col, level, jump, segment, size, segment = (SELECT segment FROM z ORDER BY size DESC, segment LIMIT 1) AS is_reference FROM z""")
def column_steps(spark: SparkSession, d: str) -> DataFrame:
    levels = tiles(spark, d).groupBy("col").agg(F.round(F.percentile("metric", 0.5), 6).alias("level"))
    return windows.column_steps(levels, "col", "level", 20.0)


@registry.add(f"""WITH {TILES}, m AS (SELECT quantile_cont(metric, 0.5) AS med FROM tiles), q AS (SELECT quantile_cont(metric, 0.75) AS p75, count(*) AS n FROM tiles WHERE size >= 10),
r AS (SELECT CASE WHEN n >= 3 AND p75 > 0 THEN p75 END AS reference FROM q),
f AS (SELECT CASE WHEN size < 10 THEN 'low_texture' WHEN metric < 950 OR (reference > 0 AND metric < 0.75 * reference) THEN 'defocused' ELSE 'ok' END AS decision,
  CASE WHEN size < 10 THEN 'contrast' WHEN metric < 950 THEN 'floor' WHEN reference > 0 AND metric < 0.75 * reference THEN 'ratio' END AS reason FROM tiles, r)
SELECT decision, reason, count(*) AS n FROM f GROUP BY ALL""")
def focus_gate(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.focus_decisions(tiles(spark, d), "metric", "size", 10, 950, 0.75).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@registry.add(f"""WITH {TILES}, a AS (SELECT id, metric, size, metric * size AS bytes, (size % 10) / 10.0::DOUBLE AS clip, id / 2.0::DOUBLE AS k FROM tiles),
m AS (SELECT quantile_cont(metric, 0.5) AS ms, quantile_cont(bytes, 0.5) AS mb FROM a),
d AS (SELECT quantile_cont(abs(metric - ms), 0.5) AS ds, quantile_cont(abs(bytes - mb), 0.5) AS db FROM a, m), q AS (SELECT quantile_cont(metric, 0.75) AS ref FROM a WHERE size >= 4),
f AS (SELECT id, list_filter([CASE WHEN size < 4 THEN 'low_texture' END, CASE WHEN size >= 4 AND metric / ref < 0.4 THEN 'defocus' END, CASE WHEN size >= 4 AND metric / ref >= 0.4 AND metric / ref < 0.6 THEN 'focus_band' END,
  CASE WHEN (metric - ms) / (1.4826 * ds) < -3 THEN 'low_contrast' END, CASE WHEN (bytes - mb) / (1.4826 * db) < -3 THEN 'small_file' END, CASE WHEN clip > 0.35 THEN 'clipped' END, CASE WHEN k <> floor(k) THEN 'irregular_index' END], lambda x: x IS NOT NULL) AS flags FROM a, m, d, q)
SELECT array_to_string(flags, ',') AS flags, count(*) AS n FROM f GROUP BY 1""")
def tile_flags(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d).selectExpr("id", "metric", "size", "metric * size as bytes", "(size % 10) / 10.0D as clip", "id / 2.0D as k")
    return aggregates.flag_tiles(
        t, "metric", "size", "metric", "bytes", "clip", "k"
    ).groupBy(F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@registry.add(f"""WITH {TILES}, m AS (SELECT avg(col::DOUBLE) AS mx, avg(row::DOUBLE) AS my, avg(v) AS mv, count(*) AS n, covar_pop(col, col) AS sxx, covar_pop(row, row) AS syy, covar_pop(col, row) AS sxy, covar_pop(col, v) AS sxv, covar_pop(row, v) AS syv FROM (SELECT *, metric + 3.5 * col - 2.0 * row AS v FROM tiles)),
c AS (SELECT n, mx, my, mv, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS cx, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS cy FROM m),
f AS (SELECT n, cx, cy, mv - cx * mx - cy * my AS c0 FROM c), r AS (SELECT f.*, abs(metric + 3.5 * col - 2.0 * row - c0 - cx * col - cy * row) AS r FROM tiles, f)
SELECT n, count(*) FILTER (WHERE r > 100) AS outliers, round(c0, 6) AS c0, round(cx, 6) AS cx, round(cy, 6) AS cy, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(max(r), 6) AS worst FROM r GROUP BY n, c0, cx, cy""")
def affine_grid_fit(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.placement_check(tiles(spark, d), F.col("col"), F.col("row"), F.expr("metric + 3.5 * col - 2.0 * row"), 400)


@registry.add(f"WITH {TILES} SELECT col, count(*) AS n, min(id) AS first_key, max(id) AS last_key, round(quantile_cont(metric, 0.5), 6) AS median_score FROM tiles GROUP BY col")
def column_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.column_summary(tiles(spark, d), "col", "id", "metric")


@registry.add("""SELECT i::INT AS sequence, (i // 6)::INT AS col, (CASE WHEN (i // 6) % 2 = 0 THEN i % 6 ELSE 5 - i % 6 END)::INT AS row, (i // 6) * 12.5::DOUBLE AS target_x, (CASE WHEN (i // 6) % 2 = 0 THEN i % 6 ELSE 5 - i % 6 END) * 8.0::DOUBLE AS target_y FROM (SELECT range AS i FROM range(42))""")
def snake_path(spark: SparkSession, d: str) -> DataFrame:
    return windows.snake_path(spark, 7, 6, 12.5, 8.0)


@registry.add("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS sample, o_totalprice AS area, o_orderstatus AS st FROM orders), r AS (SELECT * FROM o WHERE st = 'F'), p AS (SELECT * FROM o WHERE st <> 'F')
SELECT p.id, p.sample, p.area, min(r.id) AS match_order, arg_min(r.area, r.id) AS match_area FROM p LEFT JOIN r ON r.sample = p.sample AND abs(p.area - r.area) <= greatest(500.0, abs(p.area) * 0.15) GROUP BY ALL""")
def tolerant_match(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as sample", "o_totalprice as area", "o_orderstatus as st")
    records = o.where("st = 'F'").withColumnRenamed("id", "ord")
    return joins.tolerant_match(records, o.where("st <> 'F'").drop("st"), "sample", [("area", 500.0, 0.15)], "ord")


@registry.add("""WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), t AS (SELECT sum(size) AS total FROM c)
SELECT o_custkey, size, round(100.0::DOUBLE * size / total, 6) AS pct FROM c, t WHERE size >= 0.0001 * total ORDER BY size DESC, o_custkey LIMIT 8""")
def topk_components_like(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.largest_groups(table(spark, d, "orders"), "o_custkey", 0.0001)


@registry.add("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT quantile_cont(n, 0.5) AS typical FROM c)
SELECT o_custkey, n, typical FROM c, t WHERE abs(n - typical) > greatest(2.0, 0.1 * typical)""")
def count_outlier_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_outliers(table(spark, d, "orders"), "o_custkey")


@registry.add("""WITH c AS (SELECT n_nationkey, n_name, s_acctbal FROM nation LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey)
SELECT n_nationkey, n_name, coalesce(s_acctbal, 140.0) AS threshold, s_acctbal IS NOT NULL AS calibrated FROM c""")
def nation_supplier_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(
        F.col("s_nationkey").alias("n_nationkey")
    ).agg(F.max("s_acctbal").alias("threshold"))
    return joins.lookup_with_fallback(table(spark, d, "nation").select("n_nationkey", "n_name"), known, "n_nationkey", "threshold", F.lit(140.0))
