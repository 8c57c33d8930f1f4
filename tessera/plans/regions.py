"""Queries on regions of a label raster, mosaics and registration; twins find components by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.plans.base import PX, Registry, rounded
from tessera.plans.base import px as px_view
from tessera.plans.checks import IMG, coloured, image

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
WIDE, HIGH = 64, 48


def _parts(name: str, mask: str) -> str:
    """WITH parts: the four-connected components of ``mask`` (a table of x and y), named by their least pixel."""
    return f"""{name}_r(x, y, root) AS (SELECT x, y, y::BIGINT * 1000003 + x FROM {mask} UNION SELECT n.x, n.y, c.root FROM {name}_r c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy), {mask} n WHERE n.x = c.x + o.dx AND n.y = c.y + o.dy AND c.root < n.y::BIGINT * 1000003 + n.x),
{name} AS (SELECT x, y, min(root) AS component FROM {name}_r GROUP BY x, y)"""


def _closed(name: str, mask: str, reach: int) -> str:
    """WITH parts: ``mask`` (a table of x, y and a boolean m over the whole image) closed by a box."""
    w = f"ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING"
    return f"""{name}_a AS (SELECT x, y, bool_or(m) OVER (PARTITION BY y ORDER BY x {w}) AS m FROM {mask}), {name}_b AS (SELECT x, y, bool_or(m) OVER (PARTITION BY x ORDER BY y {w}) AS m FROM {name}_a),
{name}_c AS (SELECT x, y, bool_and(m) OVER (PARTITION BY y ORDER BY x {w}) AS m FROM {name}_b), {name}_d AS (SELECT x, y, bool_and(m) OVER (PARTITION BY x ORDER BY y {w}) AS m FROM {name}_c),
{name} AS (SELECT x, y, m AND x BETWEEN {reach} AND {WIDE - 1 - reach} AND y BETWEEN {reach} AND {HIGH - 1 - reach} AS m FROM {name}_d)"""


VARIANCE = """mr AS (SELECT x, y, grey FROM img UNION ALL SELECT -1 - x, y, grey FROM img WHERE x < 2 UNION ALL SELECT 127 - x, y, grey FROM img WHERE x >= 62), mp AS (SELECT * FROM mr UNION ALL SELECT x, -1 - y, grey FROM mr WHERE y < 2 UNION ALL SELECT x, 95 - y, grey FROM mr WHERE y >= 46),
va AS (SELECT i.x, i.y, any_value(i.grey) AS grey, any_value(i.label) AS label, any_value(i.valid) AS valid, greatest(0, avg(p.grey * p.grey) - pow(avg(p.grey), 2)) AS variance FROM img i JOIN mp p ON p.x BETWEEN i.x - 2 AND i.x + 2 AND p.y BETWEEN i.y - 2 AND i.y + 2 GROUP BY i.x, i.y)"""


@registry.add(f"""WITH RECURSIVE {IMG}, {VARIANCE}, hit AS (SELECT x, y FROM va WHERE (variance < 150 OR grey < 90) AND label > 0 AND valid), {_parts("comp", "hit")},
m AS (SELECT component, va.* FROM comp JOIN va USING (x, y)), k AS (SELECT component, label, count(*) AS n FROM m GROUP BY ALL), top AS (SELECT component, arg_max(label, (n, -label)) AS dominant, max(n) AS n FROM k GROUP BY 1), cls AS (SELECT label, count(*) AS total FROM va WHERE label > 0 AND valid GROUP BY 1),
g AS (SELECT component, count(*) AS area_px, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, round(avg(grey), 6) AS mean_grey, round(avg(variance), 4) AS mean_var FROM m GROUP BY 1 HAVING count(*) >= 2)
SELECT g.*, dominant, round(100.0::DOUBLE * n / total, 6) AS pct_of_class FROM g JOIN top USING (component) JOIN cls ON label = dominant""")
def low_variance_regions(spark: SparkSession, d: str) -> DataFrame:
    out = raster.alarms(image(spark, d), "image", WIDE, HIGH, 2, 150.0, 90.0, 2)
    return rounded(rounded(out.drop("image"), "mean_grey", "pct_of_class"), "mean_var", places=4)


SELECTED = f"sel AS (SELECT x, y, label = 3 AND valid AS m FROM img), {_closed('shut', 'sel', 2)}, inner_ AS (SELECT x, y FROM shut WHERE m), {_parts('comp', 'inner_')}"
PROPOSED = f"""{SELECTED}, box AS (SELECT component, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM comp GROUP BY 1), held AS (SELECT component, count(*) AS area_px, avg(grey) AS mean_grey FROM comp JOIN img USING (x, y) WHERE label = 3 AND valid GROUP BY 1),
tot AS (SELECT count(*) FILTER (WHERE label = 3 AND valid) AS c, count(*) FILTER (WHERE label > 0 AND valid) AS k FROM img),
cand AS (SELECT component, area_px, mean_grey, x0, x1, y0, y1, 100.0::DOUBLE * area_px / c AS pct_of_class, 100.0::DOUBLE * area_px / k AS pct_of_crystal, area_px::DOUBLE / ((x1 - x0) * (y1 - y0)) AS bbox_fill, (row_number() OVER (ORDER BY area_px DESC, component))::INT AS rank FROM held JOIN box USING (component), tot WHERE 100.0 * area_px / c >= 1.0 QUALIFY row_number() OVER (ORDER BY area_px DESC, component) <= 8)"""


#: Pieces of what isn't of a proposed region inside its box, and the pieces that don't reach the box's rim.
FILLED = """mine AS (SELECT component AS k, x, y FROM comp JOIN img USING (x, y) WHERE label = 3 AND valid), inbox AS (SELECT c.component AS k, i.x, i.y, i.x IN (c.x0, c.x1 - 1) OR i.y IN (c.y0, c.y1 - 1) AS rim, i.grey, m.k IS NOT NULL AS own FROM cand c JOIN img i ON i.x >= c.x0 AND i.x < c.x1 AND i.y >= c.y0 AND i.y < c.y1 LEFT JOIN mine m ON m.k = c.component AND m.x = i.x AND m.y = i.y),
gap AS (SELECT * FROM inbox WHERE NOT own), outer_(k, x, y) AS (SELECT k, x, y FROM gap WHERE rim UNION SELECT n.k, n.x, n.y FROM outer_ c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy), gap n WHERE n.k = c.k AND n.x = c.x + o.dx AND n.y = c.y + o.dy),
full_ AS (SELECT k AS component, count(*) AS filled, avg(grey) AS r, avg(grey * 0.9::DOUBLE + 20) AS g, avg(greatest(0, grey - 30)) AS b FROM inbox LEFT JOIN (SELECT *, true AS out_ FROM outer_) q USING (k, x, y) WHERE own OR out_ IS NULL GROUP BY k)"""


@registry.add(f"WITH RECURSIVE {IMG}, {PROPOSED}, {FILLED} SELECT component, area_px, x0, x1, y0, y1, rank, round(mean_grey, 6) AS mean_grey, round(pct_of_class, 6) AS pct_of_class, round(pct_of_crystal, 6) AS pct_of_crystal, round(bbox_fill, 6) AS bbox_fill, round(area_px / filled::DOUBLE, 6) AS solidity, round(r, 6) AS mean_r, round(g, 6) AS mean_g, round(b, 6) AS mean_b FROM cand JOIN full_ USING (component)")
def region_proposals(spark: SparkSession, d: str) -> DataFrame:
    px = coloured(spark, d)
    out = raster.candidates(px, "image", 3, raster.closed_parts(px, "image", 3, WIDE, HIGH), filled=True).drop("image")
    return rounded(out, "mean_grey", "pct_of_class", "pct_of_crystal", "bbox_fill", "solidity", "mean_r", "mean_g", "mean_b")


MASKED = f"""{SELECTED}, gone AS (SELECT img.x, img.y, comp.x IS NOT NULL AS m FROM img LEFT JOIN comp ON comp.x = img.x AND comp.y = img.y AND comp.component % 3 <> 0), {_closed('rim', 'gone', 4)}, open_ AS (SELECT x, y FROM rim WHERE NOT m), {_parts('back', 'open_')},
hole AS (SELECT component FROM back GROUP BY 1 HAVING min(x) > 0 AND max(x) < {WIDE - 1} AND min(y) > 0 AND max(y) < {HIGH - 1}), mask AS (SELECT rim.x, rim.y, rim.m OR hole.component IS NOT NULL AS out_ FROM rim LEFT JOIN back USING (x, y) LEFT JOIN hole USING (component))"""


@registry.add(f"WITH RECURSIVE {IMG}, {MASKED} SELECT label, count(*) AS n, count(*) FILTER (WHERE out_) AS excluded_px FROM img JOIN mask USING (x, y) GROUP BY label")
def region_mask(spark: SparkSession, d: str) -> DataFrame:
    px = image(spark, d)
    parts = raster.closed_parts(px, "image", 3, WIDE, HIGH)
    gone = parts.where("component % 3 <> 0").select("image", "component").distinct()
    return raster.exclusion_mask(px, "image", parts, gone, WIDE, HIGH).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("_out").alias("excluded_px")
    )


@registry.add(f"""WITH RECURSIVE {IMG}, {PROPOSED}, own AS (SELECT x, y FROM sel WHERE m), {_parts('raw', 'own')}, edge AS (SELECT component FROM raw GROUP BY 1 HAVING min(x) = 0 OR max(x) = {WIDE - 1} OR min(y) = 0 OR max(y) = {HIGH - 1}), bound AS (SELECT DISTINCT comp.component FROM comp JOIN raw USING (x, y) JOIN edge ON edge.component = raw.component),
f AS (SELECT c.*, list_filter([CASE WHEN NOT (x0 <= 32 AND x1 > 32 AND y0 <= 24 AND y1 > 24) THEN 'off_centre' END, CASE WHEN area_px < 30.72 THEN 'too_small' END, CASE WHEN (x1 - x0) * (y1 - y0) > 1228.8 THEN 'box_too_large' END, CASE WHEN x0 < 2 OR y0 < 1 OR x1 > 62 OR y1 > 47 THEN 'not_interior' END, CASE WHEN b.component IS NOT NULL THEN 'connected_to_edge' END], lambda x: x IS NOT NULL) AS reasons FROM cand c LEFT JOIN bound b USING (component))
SELECT component, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AND count(*) FILTER (WHERE len(reasons) = 0) OVER () = 1 AS selected, greatest(0, x0 - ceil((x1 - x0) * 0.08))::BIGINT AS rx1, least(64, x1 + ceil((x1 - x0) * 0.08))::BIGINT AS rx2, greatest(0, y0 - ceil((y1 - y0) * 0.08))::BIGINT AS ry1, least(48, y1 + ceil((y1 - y0) * 0.08))::BIGINT AS ry2 FROM f""")
def central_rectangles(spark: SparkSession, d: str) -> DataFrame:
    out = raster.central_rectangle(image(spark, d), "image", 3, WIDE, HIGH)
    return out.select(
        "component", F.array_join("reasons", ",").alias("reasons"), "selected",
        *(F.col(c).cast("long").alias(c) for c in ("rx1", "rx2", "ry1", "ry2"))
    )


@registry.add(f"""WITH RECURSIVE {IMG}, seed AS (SELECT grey AS s FROM img WHERE x = 30 AND y = 20), near AS (SELECT x, y FROM img, seed WHERE sqrt(pow(grey - s, 2) + pow(grey * 0.9 - s * 0.9, 2) + pow(greatest(0, grey - 30) - greatest(0, s - 30), 2)) <= 45), {_parts('comp', 'near')}
SELECT x, y FROM comp WHERE component = (SELECT component FROM comp WHERE x = 30 AND y = 20)""")
def grown_region(spark: SparkSession, d: str) -> DataFrame:
    return raster.grow_region(coloured(spark, d), "image", (30, 20), 45.0).select("x", "y")


@registry.add(f"""WITH RECURSIVE {IMG}, own AS (SELECT x, y FROM img WHERE label = 3 AND valid), {_parts('comp', 'own')}, main AS (SELECT arg_max(component, (n, -component)) AS c FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)),
near AS (SELECT DISTINCT a.component FROM comp a JOIN comp b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16, main WHERE b.component = main.c AND a.component <> main.c), sz AS (SELECT component, count(*) AS size FROM comp WHERE component IN (SELECT component FROM near) GROUP BY 1)
SELECT component, size, (row_number() OVER (ORDER BY size DESC, component))::INT AS rank FROM sz QUALIFY row_number() OVER (ORDER BY size DESC, component) <= 6""")
def near_satellites(spark: SparkSession, d: str) -> DataFrame:
    parts = raster.label_components(image(spark, d), "image", F.expr("label = 3 and valid"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    main = sizes.orderBy(F.desc("n"), "component").limit(1).head()
    return raster.satellites(parts, "image", main.component if main else -1, 4).select("component", "size", "rank")


@registry.add(f"""WITH {PX}, t AS (SELECT (x // 80)::INT AS tile, (x % 80 // 8)::INT AS x, (y // 24)::INT AS y, avg(value) * 5 AS grey FROM px GROUP BY ALL), p AS (SELECT tile * 7 + x AS x, tile % 2 * 3 + y AS y, grey, greatest(least(x + 1, 10 - x) * least(y + 1, 20 - y) / 50.0::DOUBLE, 1e-4::DOUBLE) AS w FROM t)
SELECT x, y, count(*) AS tiles, greatest(0, least(255, floor(round(sum(grey * w) / sum(w), 9) + 0.5)))::INT AS grey FROM p GROUP BY x, y""")
def mosaic_render(spark: SparkSession, d: str) -> DataFrame:
    tiles = px_view(spark, d).groupBy(
        F.expr("cast(x div 80 as int)").alias("tile"), F.expr("cast(x % 80 div 8 as int)").alias("x"), F.expr("cast(y div 24 as int)").alias("y")
    ).agg((F.avg("value") * 5).alias("grey"))
    places = spark.range(8).selectExpr("cast(id as int) as tile", "cast(id * 7 as int) as left", "cast(id % 2 * 3 as int) as top")
    return raster.render(tiles, places, 10, 20)


@registry.add(f"WITH {PX}, p AS (SELECT x // 8 AS x, y // 8 AS y, label, (x + y) % 5 AS tile_order FROM px) SELECT x, y, arg_min(label, (tile_order, label)) AS label FROM p GROUP BY ALL")
def first_written(spark: SparkSession, d: str) -> DataFrame:
    preds = px_view(spark, d).selectExpr(
        "cast(x div 8 as int) as x", "cast(y div 8 as int) as y", "label", "struct((x + y) % 5 as o, label as l) as tile_order"
    )
    return raster.merge_first(preds)
