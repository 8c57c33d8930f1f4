"""Queries on where images lie against each other, on images that grow in number with the suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lines, raster, registration
from tessera.plans.base import Registry, rounded
from tessera.session import shuffle_partitions, table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

#: Dense images of 64 by 48 pixels: ten, and ten more for each further hundred suppliers.
IMAGES = """cells AS (SELECT l_suppkey % 10 + 10 * (l_suppkey // 100) AS image, (l_orderkey % 64)::INT AS x, (l_partkey % 48)::INT AS y, floor(avg(l_quantity) * 5) AS grey, 2 * count(*) FILTER (WHERE l_returnflag <> 'A') >= count(*) AS valid FROM lineitem GROUP BY ALL),
names AS (SELECT DISTINCT image FROM cells),
imgs AS (SELECT n.image, a.i::INT AS x, b.j::INT AS y, coalesce(c.grey, 128.0::DOUBLE) AS grey, coalesce(c.valid, true) AS valid FROM names n CROSS JOIN range(64) a(i) CROSS JOIN range(48) b(j) LEFT JOIN cells c ON c.image = n.image AND c.x = a.i AND c.y = b.j)"""
COLOURS = IMAGES + ", rgb AS (SELECT *, grey AS r, grey * 0.9::DOUBLE + 20 AS g, greatest(0, grey - 30) AS b FROM imgs)"
LUMA = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


def images(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").groupBy(
        F.expr("l_suppkey % 10 + 10 * (l_suppkey div 100)").alias("image"), F.expr("cast(l_orderkey % 64 as int)").alias("x"), F.expr("cast(l_partkey % 48 as int)").alias("y")
    ).agg(F.floor(F.avg("l_quantity") * 5).cast("double").alias("_g"), (2 * F.count_if(F.col("l_returnflag") != "A") >= F.count("*")).alias("_v"))
    frame = cells.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("y"))
    # shuffled whatever the sizes say: a name becomes some three thousand places, which estimates don't see
    return frame.hint("merge").join(cells, ["image", "x", "y"], "left").selectExpr("image", "x", "y", "coalesce(_g, 128.0D) as grey", "coalesce(_v, true) as valid")


def coloured(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).withColumns({"r": F.col("grey"), "g": F.expr("grey * 0.9D + 20"), "b": F.expr("greatest(0, grey - 30)")})


#: Each image and the next one; some overlaps are too narrow to say anything.
EDGES = "edges AS (SELECT a.image AS edge, a.image AS src, b.image AS dst, ((a.image * 13) % 60 - 8)::INT AS dx, ((a.image * 7) % 15 - 7)::INT AS dy FROM names a JOIN names b ON b.image = a.image + 1)"


def image_edges(px: DataFrame) -> DataFrame:
    names = px.select("image").distinct()
    nexts = names.select((F.col("image") - 1).alias("image"), F.col("image").alias("dst"))
    return names.join(nexts, "image").selectExpr("image as edge", "image as src", "dst", "cast((image * 13) % 60 - 8 as int) as dx", "cast((image * 7) % 15 - 7 as int) as dy")


MET = """box AS (SELECT *, greatest(0, dx) AS x0, least(64, 64 + dx) AS x1, greatest(0, dy) AS y0, least(48, 48 + dy) AS y1 FROM edges)"""


@registry.add(f"""WITH {COLOURS}, {EDGES}, {MET}, bx AS (SELECT image, x, y, avg(r) OVER w AS r, avg(g) OVER w AS g, avg(b) OVER w AS b FROM rgb WINDOW w AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), soft AS (SELECT image, x, y, avg(r) OVER w AS r, avg(g) OVER w AS g, avg(b) OVER w AS b FROM bx WINDOW w AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
met AS (SELECT edge, p.r, p.g, p.b, q.r AS r2, q.g AS g2, q.b AS b2 FROM box JOIN soft p ON p.image = src AND p.x >= x0 + 3 AND p.x < x1 - 3 AND p.y >= y0 + 3 AND p.y < y1 - 3 JOIN soft q ON q.image = dst AND q.x = p.x - dx AND q.y = p.y - dy WHERE x1 - x0 >= 24 AND y1 - y0 >= 24 AND least(p.r, p.g, p.b, q.r, q.g, q.b) > 20 AND greatest(p.r, p.g, p.b, q.r, q.g, q.b) < 245),
l AS (SELECT *, {LUMA} AS lum FROM met), s AS (SELECT l.*, med FROM l JOIN (SELECT edge, quantile_cont(lum, 0.5) AS med FROM l GROUP BY edge) USING (edge)),
st AS (SELECT edge, count(*) AS pixels, quantile_cont(r, 0.5) / quantile_cont(r2, 0.5) AS ratio_r, quantile_cont(g, 0.5) / quantile_cont(g2, 0.5) AS ratio_g, quantile_cont(b, 0.5) / quantile_cont(b2, 0.5) AS ratio_b, quantile_cont(g, 0.5) FILTER (WHERE lum >= med - 1e-9) / quantile_cont(g2, 0.5) FILTER (WHERE lum >= med - 1e-9) AS bright_g, avg((abs(lum - med) <= 0.1 * med)::INT) AS flat_fraction FROM s GROUP BY edge)
SELECT edge, src, dst, dx, dy, coalesce(pixels, 0) AS pixels, (x1 - x0)::INT AS overlap_w, (y1 - y0)::INT AS overlap_h, CASE WHEN pixels >= 500 THEN round(ratio_r, 6) END AS ratio_r, CASE WHEN pixels >= 500 THEN round(ratio_g, 6) END AS ratio_g, CASE WHEN pixels >= 500 THEN round(ratio_b, 6) END AS ratio_b, CASE WHEN pixels >= 500 THEN round(bright_g, 6) END AS bright_g, CASE WHEN pixels >= 500 THEN round(flat_fraction, 6) END AS flat_fraction FROM box LEFT JOIN st USING (edge)""")
def overlap_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Colour ratios of all images' overlaps, in one plan."""
    px = coloured(spark, d)
    out = registration.overlap_ratios(image_edges(px), px).drop("bright_r", "bright_b")
    return rounded(out, "ratio_r", "ratio_g", "ratio_b", "bright_g", "flat_fraction")


@registry.add(f"""WITH {IMAGES}, {EDGES}, {MET}, met AS (SELECT edge, count(*) AS pixels, corr(p.grey, q.grey) AS r FROM box JOIN imgs p ON p.image = src AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 JOIN imgs q ON q.image = dst AND q.x = p.x - dx AND q.y = p.y - dy WHERE x1 - x0 >= 24 GROUP BY edge)
SELECT edge, coalesce(pixels, 0) AS pixels, round(coalesce(r, -1), 6) AS ncc FROM box LEFT JOIN met USING (edge)""")
def overlap_correlation(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d)
    return rounded(registration.overlap_correlations(image_edges(px), px, least_side=24), "ncc")


WIDE, HIGH = 56, 40
#: Shifts of up to 40 of 56 columns and 22 of 40 rows, from the images' numbers.
SHIFT_X, SHIFT_Y = "(image * 17) % 81 - 40", "(image * 29) % 45 - 22"


@registry.add(f"WITH {IMAGES} SELECT image AS pair, ({SHIFT_X})::BIGINT AS dx, ({SHIFT_Y})::BIGINT AS dy, true AS good FROM names")
def registered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two views of each image with its grain, shifted by more than half a view in many cases and both darker to the
    rim, found again: every second pair has a prior that is a little off and its box, the others have none."""
    px = images(spark, d).withColumn("grey", F.col("grey") + F.expr("pmod(xxhash64(image, x, y), 100)"))
    shifts = px.select("image").distinct().selectExpr("image", f"cast({SHIFT_X} as int) as dx", f"cast({SHIFT_Y} as int) as dy")
    places = shifts.select("*", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(HIGH - 1))).alias("y"))
    dark = f"(1 - 0.4D * (pow((x - {WIDE // 2}) / {WIDE / 2}D, 2) + pow((y - {HIGH // 2}) / {HIGH / 2}D, 2)) / 2)"
    views = None
    # a view shows the scene that repeats the image, with a grain that doesn't repeat
    for n, (sx, sy) in enumerate((("x", "y"), ("x + dx", "y + dy"))):
        at = places.selectExpr("image", "x", "y", f"{sx} as sx", f"{sy} as sy").withColumns({"_x": F.expr("pmod(sx, 64)"), "_y": F.expr("pmod(sy, 48)")})
        met = at.hint("merge").join(px.select("image", F.col("x").alias("_x"), F.col("y").alias("_y"), "grey"), ["image", "_x", "_y"])
        view = met.selectExpr(f"2 * image + {n} as image", "x", "y", f"(grey + pmod(xxhash64(image, sx, sy, 7), 200)) * {dark} as grey")
        views = view if views is None else views.unionByName(view)
    prior = F.expr("image % 2 = 0")
    edges = shifts.select(
        (2 * F.col("image")).alias("src"), (2 * F.col("image") + 1).alias("dst"), F.when(prior, F.expr("dx + image % 3 - 1")).alias("ex"),
        F.when(prior, F.expr("dy - image % 3 + 1")).alias("ey"), F.when(prior, F.lit(6)).alias("tolerance")
    )
    found = registration.register_edges(edges, registration.images_of(views, "image"))
    return found.select(F.expr("src div 2").alias("pair"), F.rint("dx").cast("long").alias("dx"), F.rint("dy").cast("long").alias("dy"), (F.col("ncc") > 0.6).alias("good"))


#: Tiles of 96 by 80 pixels, five to a row, a step of 60 columns and 50 rows apart with some jitter; every ninth is blank.
PLACED = """placed AS (SELECT s_suppkey AS image, (s_suppkey - 1) % 5 AS col, (s_suppkey - 1) // 5 AS row, (60 * ((s_suppkey - 1) % 5) + (s_suppkey * 7) % 5)::INT AS lx, (50 * ((s_suppkey - 1) // 5) + (s_suppkey * 11) % 5)::INT AS ly, s_suppkey % 9 = 4 AS blank, (1 + (s_suppkey % 4) * 0.05::DOUBLE) AS gain FROM supplier)"""


@registry.add(f"""WITH {PLACED}, pairs AS (SELECT 'h' AS kind, a.image AS src, b.image AS dst FROM placed a JOIN placed b ON b.row = a.row AND b.col = a.col + 1 UNION ALL SELECT 'v', a.image, b.image FROM placed a JOIN placed b ON b.col = a.col AND b.row = a.row + 1),
m AS (SELECT kind, src, dst, b.lx - a.lx AS dx, b.ly - a.ly AS dy, a.blank OR b.blank AS bad, a.gain / b.gain AS ratio FROM pairs JOIN placed a ON a.image = src JOIN placed b ON b.image = dst)
SELECT kind, src, dst, CASE kind WHEN 'h' THEN 'right' ELSE 'below' END AS side, CASE WHEN NOT bad THEN dx END AS dx, CASE WHEN NOT bad THEN dy END AS dy, CASE WHEN bad THEN 'registration' END AS rejected, CASE WHEN bad THEN 0 ELSE (90 - abs(dx)) * (74 - abs(dy)) END::BIGINT AS pixels, CASE WHEN NOT bad THEN round(ratio, 6) END AS ratio_r FROM m""")
def measured_edges(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of one scene with gains of their own: sides, displacements and gains are found from their pixels."""
    placed = table(spark, d, "supplier").selectExpr(
        "s_suppkey as image", "(s_suppkey - 1) % 5 as col", "(s_suppkey - 1) div 5 as row", "cast(60 * ((s_suppkey - 1) % 5) + (s_suppkey * 7) % 5 as int) as lx",
        "cast(50 * ((s_suppkey - 1) div 5) + (s_suppkey * 11) % 5 as int) as ly", "s_suppkey % 9 = 4 as blank", "1 + (s_suppkey % 4) * 0.05D as gain"
    )
    # a tile becomes thousands of pixels: dealt out before, however few files there are
    dealt = placed.repartition(max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism), "image")
    px = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("y"))
    value = F.expr("if(blank, 128, 60 + pmod(xxhash64(lx + x, ly + y), 100)) * gain")
    px = px.select("image", "x", "y", value.alias("r"), (value * 0.9).alias("g"), (value * 0.8).alias("b"))
    out = registration.measured_edges(placed.select("image", "row", "col"), px)
    kept = F.col("rejected").isNull()
    return out.select(
        "kind", "src", "dst", "side", F.when(kept, F.col("dx")).alias("dx"), F.when(kept, F.col("dy")).alias("dy"), "rejected", F.coalesce("pixels", F.lit(0)).alias("pixels"),
        F.round("ratio_r", 6).alias("ratio_r")
    )


@registry.add(f"""WITH {IMAGES}, bad AS (SELECT image, x, y FROM imgs WHERE NOT valid AND x % 5 = 0 AND y % 4 = 0), n AS (SELECT i.image, i.x, i.y, min((b.x - i.x) * (b.x - i.x) + (b.y - i.y) * (b.y - i.y)) AS d2 FROM imgs i JOIN bad b USING (image) GROUP BY ALL)
SELECT image, y, sum(d2)::BIGINT AS total, max(d2)::BIGINT AS farthest, count(*) FILTER (WHERE d2 >= 49) AS kept FROM n GROUP BY ALL""")
def border_distance(spark: SparkSession, d: str) -> DataFrame:
    """Exact squared distances to the nearest invalid pixel, summed by line, and what a trim of 7 pixels leaves."""
    px = images(spark, d).withColumn("valid", F.expr("valid or x % 5 <> 0 or y % 4 <> 0"))
    far = lines.squared_distance(px, "image", "not valid").where("d2 is not null")
    return far.groupBy("image", "y").agg(F.sum("d2").alias("total"), F.max("d2").alias("farthest"), F.count_if(F.col("d2") >= 49).alias("kept"))


@registry.add(f"""WITH {IMAGES}, bad AS (SELECT image, x, y FROM imgs WHERE NOT valid AND x % 3 = 0 AND y % 4 = 0), k AS (SELECT i.image, i.y FROM imgs i WHERE i.valid AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.image = i.image AND (b.x - i.x) * (b.x - i.x) + (b.y - i.y) * (b.y - i.y) < 25)) SELECT image, y, count(*) AS kept FROM k GROUP BY ALL""")
def trimmed_border(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d).withColumn("_own", F.col("valid")).withColumn("valid", F.expr("valid or x % 3 <> 0 or y % 4 <> 0"))
    return raster.trim_border(px, "image", 64, 48, 5).where("valid and _own").groupBy("image", "y").agg(F.count("*").alias("kept"))


def _kernel(sigma: float) -> str:
    weights = lines.kernel(sigma)
    return ", ".join(f"({i - len(weights) // 2}, {float(w)!r}::DOUBLE)" for i, w in enumerate(weights))


def _blurred(value: str, source: str, sigma: float) -> str:
    """WITH parts: ``soft``, the table ``source`` of x, y and the value over 64 by 48 places, blurred along x, then y."""
    return f"""k(o, w) AS (VALUES {_kernel(sigma)}), across AS (SELECT a.i AS x, y, sum(w * {value}) AS v FROM range(64) a(i) CROSS JOIN k JOIN {source} ON x = least(63, greatest(0, a.i + o)) GROUP BY 1, 2),
soft AS (SELECT x::INT AS x, b.j::INT AS y, sum(w * v) AS v FROM range(48) b(j) CROSS JOIN k JOIN across ON y = least(47, greatest(0, b.j + o)) GROUP BY 1, 2)"""


@registry.add(f"""WITH {IMAGES}, m AS (SELECT image, avg(grey) AS m FROM imgs GROUP BY 1), ratio AS (SELECT x, y, quantile_cont(grey / m, 0.5) AS gain FROM imgs JOIN m USING (image) GROUP BY ALL), {_blurred("gain", "ratio", 8.0)}, top AS (SELECT max(v) * 1e-3 AS t FROM soft), kept AS (SELECT x, y, greatest(v, t) AS v FROM soft, top)
SELECT x, y, round(v / (SELECT avg(v) FROM kept), 6) AS gain FROM kept""")
def flat_field(spark: SparkSession, d: str) -> DataFrame:
    """The shade that all images share, blurred by an eighth of their width."""
    return rounded(raster.flat_field(images(spark, d).withColumnRenamed("image", "tile")), "gain")


@registry.add(f"""WITH {IMAGES}, one AS (SELECT x, y, grey FROM imgs WHERE image = 3), {_blurred("grey", "one", 12.0)}, all_ AS (SELECT image, sum(grey) AS before FROM imgs GROUP BY 1) SELECT y, round(sum(v), 5) AS total, round(max(v), 6) AS top, (SELECT count(*) FROM all_) AS images FROM soft GROUP BY y""")
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    """All images blurred by 12 pixels; lines of image 3, and how many images there are."""
    soft = lines.gaussian(images(spark, d), "image", "grey", 12.0)
    whole = soft.agg(F.count_distinct("image").alias("images"))
    rows = soft.where("image = 3").groupBy("y").agg(F.round(F.sum("grey"), 5).alias("total"), F.round(F.max("grey"), 6).alias("top"))
    return rows.join(F.broadcast(whole))
