"""More queries: samples, overlaps, lookups, set operations and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import joins, journal, raster, sampling
from tessera.plans.base import PX, TILES, Registry, px, tiles
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

UNIT = "(('0x' || substr(md5({seed} || {ident}::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


@registry.add(f"SELECT p_partkey, p_name FROM part ORDER BY {UNIT.format(seed=chr(39) + '7:' + chr(39), ident='p_partkey')}, p_partkey LIMIT 40")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: forty tiles by their hash."""
    return sampling.seeded_sample(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 40, "7")


@registry.add(f"""WITH {PX}, c AS (SELECT x // 16 AS cx, y // 16 AS cy, count(*) AS n, count(*) FILTER (WHERE valid) AS v, count(*) FILTER (WHERE label > 0) AS k FROM px GROUP BY ALL),
e AS (SELECT *, cy * 40 + cx AS id, cx // 10 AS sx, cy // 10 AS sy FROM c WHERE v >= 0.5 * n),
r AS (SELECT *, row_number() OVER (PARTITION BY sx, sy ORDER BY -ln({UNIT.format(seed=chr(39) + '3:' + chr(39), ident='id')}) / (0.05::DOUBLE + k / n), id) AS round FROM e)
SELECT id, sx, sy, round FROM r WHERE round <= 3""")
def stratified_windows(spark: SparkSession, d: str) -> DataFrame:
    cells = px(spark, d).groupBy(F.expr("cast(x div 16 as int)").alias("cx"), F.expr("cast(y div 16 as int)").alias("cy")).agg(
        F.count("*").alias("n"), F.count_if("valid").alias("v"), F.count_if(F.col("label") > 0).alias("k")
    )
    windows = cells.where("v >= 0.5 * n").selectExpr(
        "cy * 40 + cx as id", "cast(cx div 10 as int) as sx", "cast(cy div 10 as int) as sy", "k / n as share"
    )
    return sampling.stratified_windows(windows, ["sx", "sy"], "id", 0.05 + F.col("share"), 3, "3").select(
        "id", "sx", "sy", F.col("round").cast("long").alias("round")
    )


@registry.add(f"""WITH {TILES}, i AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY row) - 1 AS i, count(*) OVER (PARTITION BY col) AS n FROM tiles)
SELECT col, row, id FROM i WHERE i IN (SELECT floor(k * (n - 1) / 4 + 0.5) FROM (SELECT unnest(range(5)) AS k))""")
def evenly_spread(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: five tiles per column."""
    return sampling.spread(tiles(spark, d).select("col", "row", "id"), ["col"], ["row"], 5)


BOXES = "b AS (SELECT p_partkey AS id, (p_partkey * 37 % 900)::BIGINT AS x1, (p_partkey * 53 % 700)::BIGINT AS y1, p_size, p_brand FROM part)"


@registry.add(f"""WITH {BOXES}, a AS (SELECT id AS alarm, x1, y1, x1 + p_size AS x2, y1 + p_size AS y2 FROM b WHERE p_size > 25), w AS (SELECT id AS "window", x1, y1, x1 + 20 AS x2, y1 + 20 AS y2 FROM b WHERE p_size <= 25)
SELECT alarm, "window" FROM a, w WHERE a.x1 < w.x2 AND w.x1 < a.x2 AND a.y1 < w.y2 AND w.y1 < a.y2""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey * 37 % 900 as x1", "p_partkey * 53 % 700 as y1", "p_size")
    alarms = b.where("p_size > 25").selectExpr("id as alarm", "x1", "y1", "x1 + p_size as x2", "y1 + p_size as y2")
    windows = b.where("p_size <= 25").selectExpr("id as window", "x1", "y1", "x1 + 20 as x2", "y1 + 20 as y2")
    return joins.box_overlaps(alarms, windows, 32)


@registry.add("""SELECT doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN labels a USING (doc_id) LEFT JOIN (SELECT doc_id AS k, quality FROM labels) b ON b.k = d.n_chars""")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return joins.first_label(
        rows, table(spark, d, "labels").withColumnRenamed("doc_id", "key"), ["doc_id", "n_chars"], "key", "quality"
    ).drop("n_chars")


@registry.add("""WITH l AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '^(\\w+)', 1), '') END AS m FROM conversations)
SELECT conv_id, turn, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l""".replace("\\w+", "[A-Za-z]+"))
def line_attribution(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("line"))
    return joins.attribute_lines(lines, "conv_id", "turn", "^([A-Za-z]+)", "line").select("conv_id", "turn", "run")


@registry.add("""WITH a AS (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 2000), b AS (SELECT DISTINCT lang, source FROM documents WHERE n_chars < 300)
SELECT lang, source, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT lang, source, 'right' FROM (FROM b EXCEPT FROM a)""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return joins.symmetric_difference(
        docs.where("n_chars > 2000").select("lang", "source").distinct(), docs.where("n_chars < 300").select("lang", "source").distinct()
    )


@registry.add("""WITH t AS (SELECT p_partkey AS id, p_partkey // 50 AS col, (p_partkey % 50) / 2.0 AS k, p_retailprice AS m FROM part), e AS (SELECT a.id AS src, b.id AS dst, 1 - abs(a.m - b.m) / 1000 AS score FROM t a JOIN t b ON b.id = a.id + 1 AND b.col = a.col),
n AS (SELECT src AS id, score FROM e UNION ALL SELECT dst, score FROM e), s AS (SELECT id, col, floor(k)::BIGINT AS bucket, count(*) OVER (PARTITION BY col, floor(k)) - 1 AS siblings FROM t)
SELECT s.id, col, bucket, siblings, count(score) AS edges, round(avg(score), 6) AS mean_score, min(score) AS least_score FROM s LEFT JOIN n ON n.id = s.id WHERE siblings > 0 GROUP BY ALL""")
def conflict_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey div 50 as col", "(p_partkey % 50) / 2.0D as key", "p_retailprice as m")
    nxt = t.selectExpr("id - 1 as src", "id as dst", "col as col2", "m as m2")
    edges = t.join(nxt, (F.col("id") == F.col("src")) & (F.col("col") == F.col("col2"))).select(
        "src", "dst", (1 - F.abs(F.col("m") - F.col("m2")) / 1000).alias("score")
    )
    return joins.conflict_scores(edges, t)


@registry.add("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_quantity AS dx, l_tax * 100 AS dy, l_discount * 10 AS ncc FROM lineitem),
w AS (SELECT *, CASE WHEN ncc < 0.3 THEN 'correlation' WHEN sqrt((dx - 25) * (dx - 25) + (dy - 4) * (dy - 4)) > 15 THEN 'deviation' END AS why FROM e)
SELECT why, count(*) AS n, round(sum(CASE WHEN why IS NULL THEN dx ELSE 25 END), 4) AS dx, round(sum(CASE WHEN why IS NULL THEN ncc ELSE 0.001 END), 4) AS w FROM w GROUP BY why""")
def edge_acceptance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as src", "l_partkey as dst", "l_quantity as dx", "l_tax * 100 as dy", "l_discount * 10 as ncc"
    )
    out = raster.accept_edges(e, 25.0, 4.0, 0.3, 15.0)
    return out.groupBy("why").agg(F.count("*").alias("n"), F.round(F.sum("dx"), 4).alias("dx"), F.round(F.sum("w"), 4).alias("w"))


@registry.add("""SELECT count(DISTINCT o_orderpriority) AS configs, count(DISTINCT o_orderstatus) AS rules, count(*) FILTER (WHERE o_totalprice > 300000) % greatest(count(*), 1) = 0 AS even_exclusions, count(*) FILTER (WHERE o_orderstatus = 'P') AS open_escalations, count(*) FILTER (WHERE o_totalprice < 2000) AS overrides FROM orders""")
def sample_consistency(spark: SparkSession, d: str) -> DataFrame:
    return journal.consistency(
        table(spark, d, "orders").selectExpr(
            "o_custkey as sample", "o_orderpriority as config_hash", "o_orderstatus as rule", "o_totalprice > 300000 as excluded",
            "o_orderstatus = 'P' as open_escalation", "o_totalprice < 2000 as override"
        )
    )


@registry.add("""SELECT event_id, round(1239.842::DOUBLE / nullif(value, 0), 6) AS energy, value * 0.25 / 1e6 AS mm2, CASE WHEN value >= 1024 THEN NULL ELSE value::BIGINT::VARCHAR || ' B' END AS size FROM (SELECT event_id, floor(value) AS value FROM events)""")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor("value")
    return table(spark, d, "events").select(
        "event_id", F.round(scalar.wavelength_to_energy(v.cast("double")), 6).alias("energy"), scalar.area_mm2(v.cast("double"), 0.5).alias("mm2"),
        F.when(v < 1024, scalar.human_bytes(v)).alias("size")
    )


@registry.add("""WITH s AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(CASE WHEN abs(a - 2 * value + b) < 1e-12 THEN 0 ELSE 0.5 * (a - b) / (a - 2 * value + b) END, 6) + 0.0 AS top FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND value > a AND value > b""")
def local_tops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr(
        "user_id", "event_id", "value", "lag(value) over (partition by user_id order by ts, event_id) as a",
        "lead(value) over (partition by user_id order by ts, event_id) as b"
    )
    return rows.where("value > a and value > b").select(
        "user_id", "event_id", (F.round(scalar.vertex(F.col("a"), F.col("value"), F.col("b")), 6) + 0.0).alias("top")
    )


@registry.add("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS stamp FROM orders), r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'P')
SELECT count(*) AS n, min(o_orderkey) AS first_key FROM d, r WHERE stamp BETWEEN a - 1 AND b + 1""")
def companion_logs(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources import layouts

    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    runs = o.where("o_totalprice > 400000 and o_orderstatus = 'P'").selectExpr("day as first_day", "day as last_day")
    return layouts.companions(o.selectExpr("o_orderkey", "day as stamp"), runs).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
