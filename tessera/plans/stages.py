"""Queries on the stages that put operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import grid, raster, stages, votes
from tessera.plans import memo
from tessera.plans.base import JOURNAL, PX, TILES, Registry, journal, px, rounded, tiles
from tessera.plans.checks import IMG, image
from tessera.plans.regions import HIGH, MASKED, VARIANCE, WIDE, _parts
from tessera.session import new_folder, table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


@registry.add("SELECT event_id, event_id % 4 = 0 AS adaptive, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN event_id % 5 + 1 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS n FROM events")
def vote_settings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        "event_id",
        F.expr("case event_id % 4 when 0 then ' Adaptive' when 1 then cast(event_id % 5 + 1 as string) when 2 then 'x' else '-4' end").alias("t")
    )
    return e.select("event_id", stages.votes_setting(F.col("t")).alias("v")).select("event_id", "v.adaptive", "v.n")


@registry.add("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 4 END::DOUBLE AS scale_div, 32.0::DOUBLE AS \"window\", CASE WHEN p_size % 3 = 0 THEN 9.5 ELSE 3.0 END::DOUBLE AS var_thr, 3::BIGINT AS known FROM part")
def audit_parameters(spark: SparkSession, d: str) -> DataFrame:
    given = F.map_from_entries(
        F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("scale_div"), F.col("p_size").cast("double"))), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("var_thr"), F.lit(9.5))), F.struct(F.lit("unheard_of"), F.lit(1.0))))
    )
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), stages.parameters(given, {"scale_div": 4, "window": 32, "var_thr": 3}).alias("m")
    )
    return p.select("id", *(F.col("m")[k].alias(k) for k in ("scale_div", "window", "var_thr")), F.size("m").cast("long").alias("known"))


@registry.add("""WITH k AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, left(sha256('{"lang":"' || lang || '","n":' || n || ',"version":"2"}'), 16) AS key FROM k""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return k.select("lang", "source", stages.cache_key(["lang", "n"], "2").alias("key"))


@registry.add("SELECT p_size % 6 AS mask, bool_and(p_partkey % 3 < 2 OR p_size % 6 > 2) AS \"binary\", count(*) FILTER (WHERE p_partkey % 3 = 2 AND p_size % 6 <= 2) AS odd FROM part GROUP BY 1")
def binary_masks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_size % 6 as mask", "if(p_size % 6 <= 2, p_partkey % 3, p_partkey % 2) as v")
    return stages.binary_mask(rows, "v", "mask")


@registry.add("SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 3 THEN (p_partkey // 40)::INT END AS container, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE (p_partkey % 40)::INT END AS tile FROM part")
def layout_matches(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").selectExpr(
        "p_partkey as id", "concat(if(p_size % 4 = 3, 'x', 'a_L'), p_partkey div 40, if(p_size % 2 = 0, '.zip', '')) as container",
        "concat('in/', if(p_partkey % 3 = 1, 'sub/', ''), p_partkey % 40, if(p_partkey % 3 = 2, 'b', ''), '.png') as path"
    )
    return names.select(
        "id", stages.matched_container(F.col("container"), r"_L(\d+)$|_L(\d+)\.zip$").alias("c0"),
        stages.matched_container(F.col("container"), r"_L(\d+)").alias("container"), stages.matched_tile(F.col("path"), r"(\d+)\.png").alias("tile")
    ).drop("c0")


@registry.add("SELECT source AS scan, CASE WHEN bool_or(doc_id % 10 = 0) THEN 'file' WHEN bool_or(doc_id % 10 = 1) THEN 'cached' ELSE 'planner' END AS source, CASE WHEN bool_or(doc_id % 10 = 0) THEN CASE WHEN bool_and(doc_id % 20 <> 0) FILTER (WHERE doc_id % 10 = 0) THEN 'accepted' ELSE 'refused' END WHEN bool_or(doc_id % 10 = 1) THEN 'accepted' ELSE 'refused' END AS state FROM documents GROUP BY source")
def resolved_layouts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").selectExpr(
        "source as scan", "case doc_id % 10 when 0 then 'file' when 1 then 'cached' else 'planner' end as source",
        "case doc_id % 10 when 0 then doc_id % 20 <> 0 when 1 then true else false end as valid"
    )
    return stages.resolved_layout(s, "scan")


@registry.add("SELECT p_partkey AS tid, p_size AS index, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN p_partkey * 1.0 WHEN p_partkey % 2 <> 0 AND p_size <= 20 THEN p_size * 10.0 END::DOUBLE AS x, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 1.0 WHEN p_partkey % 2 <> 0 AND p_size <= 20 THEN 2.0 END::DOUBLE AS y FROM part")
def resolved_positions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey as tid", "p_size as index")
    named = p.where("tid % 2 = 0").selectExpr("tid", "if(tid % 5 = 0, double('NaN'), double(tid)) as x", "1.0D as y")
    numbered = p.where("index <= 20").select("index").distinct().selectExpr("index", "index * 10.0D as x", "2.0D as y")
    return stages.resolved_positions(p, named, numbered)


@registry.add("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'off' WHEN p_size % 4 = 1 THEN 'already_corrected' WHEN p_partkey % 3 = 0 THEN 'failed' WHEN p_partkey % 5 <> 0 THEN 'corrected' ELSE 'unverified' END AS state FROM part")
def colour_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("disabled"), F.lit("already_corrected"), F.lit("raw"), F.lit("raw")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), stages.colour_state(state, F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 5 != 0).alias("state")
    )


@registry.add("SELECT conv_id, count(*) AS documents, concat_ws(',', CASE WHEN count(DISTINCT role) > 1 THEN 'role' END, CASE WHEN count(DISTINCT turn % 1) > 1 THEN 'kind' END) AS differing, count(*) = 3 AND count(DISTINCT role) = 1 AS agrees FROM conversations WHERE turn < 3 GROUP BY conv_id")
def layer_contracts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").where("turn < 3").selectExpr("conv_id", "role", "turn % 1 as kind")
    return stages.agreeing(docs, "conv_id", ["role", "kind"], 3).withColumn("differing", F.array_join("differing", ","))


@registry.add("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'black' ELSE 'white' END AS filler, CASE event_id % 4 WHEN 1 THEN greatest(128, 2 * (event_id % 100)) ELSE event_id % 100 END::BIGINT AS overlap, CASE event_id % 4 WHEN 2 THEN 5 ELSE 3 END AS votes FROM events")
def repaired_parameters(spark: SparkSession, d: str) -> DataFrame:
    why = F.element_at(F.array(F.lit("wrong filler"), F.lit("seam step"), F.lit("split votes"), F.lit("other")), (F.col("event_id") % 4 + 1).cast("int"))
    fixed = stages.repaired({"filler": F.lit("white"), "overlap": F.col("event_id") % 100, "votes": F.lit(3)}, why)
    return table(spark, d, "events").select("event_id", fixed.alias("p")).select("event_id", "p.*")


@registry.add("""WITH o AS (SELECT c_custkey AS region, 'old' AS note, true AS keep, false AS exclude FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS region, 'new' AS note, false AS keep, true AS exclude FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE region NOT IN (SELECT region FROM n)""")
def region_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").selectExpr("c_custkey as region", "'old' as note", "true as keep", "false as exclude")
    new = c.where("c_custkey % 3 = 0").selectExpr(
        "c_custkey as region", "if(c_custkey % 5 = 0, ' ', 'new') as note", "c_custkey % 7 = 0 as keep", "true as exclude"
    )
    return stages.decided(old, new, ["region"])


@registry.add("SELECT vec_id, embedding[1] > -0.1 AS ok, round(abs(embedding[2])::DOUBLE, 6) AS confidence, NOT embedding[1] > -0.1 OR abs(embedding[2])::DOUBLE < 0.5 AS escalate, CASE WHEN NOT embedding[1] > -0.1 OR abs(embedding[2])::DOUBLE < 0.5 THEN CASE WHEN embedding[1] > -0.1 THEN 'unsure' ELSE 'no fit' END END AS escalate_reason FROM embeddings")
def stage_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    ok, sure = F.col("embedding")[0] > F.lit(-0.1).cast("float"), F.abs(F.col("embedding")[1]).cast("double")
    out = e.select("vec_id", stages.as_result(ok, sure, F.when(~ok, F.lit("no fit"))).alias("r")).select("vec_id", "r.*")
    return rounded(out, "confidence")


RUNS = """cap AS (SELECT event_id AS capture, user_id AS run, (event_id % 6)::INT AS "row", (event_id // 7 % 5)::INT AS col, event_type AS sha256 FROM events), runs AS (SELECT user_id AS run, max(event_id) AS started, 7 AS "rows", CASE WHEN user_id % 2 = 0 THEN 6 ELSE 5 END AS cols, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS sample FROM events GROUP BY 1),
sz AS (SELECT run, count(*) AS n FROM cap GROUP BY 1), g AS (SELECT sample, "rows", cols, sum(n) AS t, min(started) AS s FROM runs JOIN sz USING (run) GROUP BY ALL ORDER BY t DESC, s LIMIT 1), chosen AS (SELECT r.run, r.started, g."rows", g.cols FROM runs r JOIN g ON r.sample IS NOT DISTINCT FROM g.sample AND r."rows" = g."rows" AND r.cols = g.cols),
k AS (SELECT cap.*, started FROM cap JOIN chosen USING (run))"""


@registry.add(f"""WITH {RUNS}, one AS (SELECT "row", col, run, started, capture, sha256 FROM k) SELECT "row", col, arg_max(run, (started, run)) AS run, count(*) AS captures FROM one GROUP BY ALL""")
def assembled_grid(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)[0].select("row", "col", "run", "captures")


@registry.add(f"""WITH {RUNS}, t AS (SELECT "row", col, count(*) AS captures, count(DISTINCT sha256) = 1 AS identical FROM k GROUP BY ALL HAVING count(*) > 1), p AS (SELECT a.i::INT AS "row", b.j::INT AS col FROM (SELECT max("rows") AS r, max(cols) AS c FROM chosen) m, range(7) a(i), range(6) b(j) WHERE a.i < m.r AND b.j < m.c)
SELECT 'duplicate' AS kind, "row", col, captures, identical FROM t UNION ALL SELECT 'missing', p."row", p.col, 0, false FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k."row" = p."row" AND k.col = p.col)""")
def assembly_report(spark: SparkSession, d: str) -> DataFrame:
    _, twice, missing = _assembled(spark, d)
    return twice.select(F.lit("duplicate").alias("kind"), "row", "col", "captures", "identical").unionByName(
        missing.select(F.lit("missing").alias("kind"), "row", "col", F.lit(0).cast("long").alias("captures"), F.lit(False).alias("identical"))
    )


def _assembled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events")
    captures = e.selectExpr(
        "event_id as capture", "user_id as run", "cast(event_id % 6 as int) as row", "cast(event_id div 7 % 5 as int) as col", "event_type as sha256"
    )
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("started")).selectExpr(
        "run", "started", "7 as rows", "if(run % 2 = 0, 6, 5) as cols", "if(run % 3 = 0, null, run % 3) as sample"
    )
    return stages.assemble(captures, runs, ["sample"])


@registry.add("""WITH f AS (SELECT 'f' || doc_id AS path, doc_id FROM documents) SELECT 'file missing' AS "check", path AS name FROM f WHERE doc_id % 9 = 0 UNION ALL SELECT 'file mismatch', path FROM f WHERE doc_id % 9 <> 0 AND doc_id % 11 = 0 UNION ALL SELECT 'runtime differs', 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'capture without file', path FROM f WHERE doc_id % 9 = 0 AND doc_id % 2 = 0""")
def handover_findings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").selectExpr("concat('f', doc_id) as path", "cast(n_chars as bigint) as bytes", "lang as sha256", "doc_id")
    there = f.where("doc_id % 9 <> 0").withColumn("sha256", F.expr("if(doc_id % 11 = 0, 'x', sha256)")).drop("doc_id")
    n = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as path", "n_name as sha256", "n_nationkey")
    return stages.verified(
        f.drop("doc_id"), there, n.drop("n_nationkey"), n.withColumn("sha256", F.expr("if(n_nationkey % 4 = 0, 'x', sha256)")).drop("n_nationkey"),
        f.where("doc_id % 2 = 0").select("path")
    )


@registry.add("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unreadable' WHEN page_id % 5 = 1 THEN 'size differs' END AS fault FROM pages")
def frame_contracts(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "pages").selectExpr("page_id", "if(page_id % 5 = 0, null, if(page_id % 5 = 1, 1280, 1920)) as width", "1080 as height")
    return stages.frame_contract(frames, F.lit(1920), F.lit(1080)).select("page_id", "fault")


@registry.add("""WITH t AS (SELECT p_size % 4 AS scan, p_partkey % 3 AS col, 640 AS width, CASE WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 481 ELSE 480 END AS height, CASE WHEN p_size % 4 = 2 AND p_partkey % 2 = 0 THEN 'zip' ELSE 'folder' END AS kind FROM part), c AS (SELECT scan, col, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT scan, count(*) AS columns, min(n) AS fewest FROM c GROUP BY 1), z AS (SELECT scan, count(DISTINCT (width, height)) AS sizes, count(DISTINCT kind) AS kinds FROM t GROUP BY 1)
SELECT scan, columns, fewest, sizes, kinds, '1,2,4,8,16' AS divisors, columns >= 2 AND fewest >= 2 AND sizes = 1 AND kinds = 1 AS ready FROM f JOIN z USING (scan)""")
def stitch_inspection(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr(
        "p_size % 4 as scan", "p_partkey % 3 as col", "640 as width", "if(p_size % 4 = 1 and p_partkey % 2 = 0, 481, 480) as height",
        "if(p_size % 4 = 2 and p_partkey % 2 = 0, 'zip', 'folder') as kind"
    )
    return stages.inspected(t, "scan").withColumn("divisors", F.array_join("divisors", ","))


@registry.add("""WITH f AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), k AS (SELECT run, count(*) FILTER (WHERE run % 4 <> 0 AND n > 2) AS frames, count(*) FILTER (WHERE run % 4 <> 0 AND n > 2 AND value < 3) AS retake, count(*) FILTER (WHERE n > 2 OR run % 5 = 0) AS points FROM f GROUP BY 1)
SELECT *, CASE WHEN frames = 0 THEN 'no new frames' WHEN frames <> points THEN 'cannot be placed' WHEN retake > 0 THEN 'retake' ELSE 'ok' END AS state FROM k""")
def focus_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr(
        "user_id as run", "event_id", "value as score", "row_number() over (partition by user_id order by event_id) as n"
    )
    files = e.selectExpr("run", "concat('t', event_id, '.png') as name", "if(run % 4 <> 0 and n > 2, 100.0D, 0.0D) as at", "score")
    points = e.where("n > 2 or run % 5 = 0").select("run", F.col("event_id").alias("place"))
    return stages.focus_check(files, points, "run", 100.0, 3.0).select("run", "frames", "retake", "points", "state")


@registry.add("""WITH b AS (SELECT p_size % 5 AS sample, p_partkey % 4 AS x1, p_size % 3 AS y1, p_partkey % 4 + 10 AS x2, p_size % 3 + 10 AS y2, p_partkey % 7 = 0 AS proposed FROM part) SELECT sample, x1, y1, x2, y2, CASE WHEN bool_or(proposed) THEN 'proposal' ELSE 'person' END AS source FROM b GROUP BY ALL""")
def review_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").selectExpr(
        "p_size % 5 as sample", "p_partkey % 4 as x1", "p_size % 3 as y1", "p_partkey % 4 + 10 as x2", "p_size % 3 + 10 as y2",
        "p_partkey % 7 = 0 as proposed"
    )
    return stages.review_boxes(b.where("proposed"), b.where("not proposed"), "sample")


@registry.add(f"WITH {TILES} SELECT id, 'index' AS kind, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM tiles WHERE id = 7 UNION ALL SELECT id, 'places', col * 10.0::DOUBLE, \"row\" * 1.0::DOUBLE FROM tiles WHERE id % 9 = 0")
def anchor_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    places = t.where("id % 9 = 0").selectExpr("id", "col * 10.0D as x", "row * 1.0D as y").unionByName(
        spark.range(1).selectExpr("-1L as id", "0.0D as x", "0.0D as y")
    )
    named = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), "x", "y")
    return named(stages.anchors(t), "none").unionByName(named(stages.anchors(t, 7), "index")).unionByName(
        named(stages.anchors(t, places=places), "places")
    )


@registry.add("SELECT user_id, concat_ws(',', CASE WHEN bool_or(event_type = 'view') THEN 'view' END, CASE WHEN bool_or(event_type = 'error') THEN 'error' END, CASE WHEN bool_or(event_type = 'signup') THEN 'signup' END) AS answered, concat_ws(',', CASE WHEN NOT bool_or(event_type = 'view') THEN 'view' END, CASE WHEN NOT bool_or(event_type = 'error') THEN 'error' END, CASE WHEN NOT bool_or(event_type = 'signup') THEN 'signup' END) AS silent FROM events GROUP BY user_id")
def answered_roles(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "events").selectExpr("user_id", "event_type as role")
    out = stages.ranked_roles(answers, "user_id", ["view", "error", "signup"])
    return out.select("user_id", F.array_join("answered", ",").alias("answered"), F.array_join("silent", ",").alias("silent"))


@registry.add(f"WITH {JOURNAL} SELECT event AS step, arg_max(user_id, (us, event_id)) AS user_id, arg_max(event_id, (us, event_id)) AS event_id FROM journal GROUP BY 1")
def workflow_state(spark: SparkSession, d: str) -> DataFrame:
    j = journal(spark, d).withColumn("place", F.struct("us", "event_id"))
    return stages.latest_by(j.withColumnRenamed("event", "step"), "step", "place", ["user_id", "event_id"])


@registry.add(f"""WITH RECURSIVE {IMG}, {VARIANCE}, hit AS (SELECT x, y FROM va WHERE (variance < 150 OR grey < 90) AND label > 0 AND valid), {_parts("comp", "hit")}, a AS (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT user_id, count(*) AS votes, count(DISTINCT event_type) AS kinds, min(event_type) AS verdict FROM events WHERE event_id % 8 = 0 GROUP BY 1), p AS (SELECT count(*) FILTER (WHERE verdict = 'error') AS flagged, count(*) AS answered, count(*) FILTER (WHERE kinds = 1 AND verdict = 'error') AS systematic FROM w)
SELECT (SELECT count(*) FROM a) AS alarms, flagged, answered, systematic, (SELECT count(*) FROM a) > 0 OR flagged > 0.2 * answered OR systematic > 0 AS escalate FROM p""")
def stage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Alarms of the raster beside a sample's votes: any alarm, many flagged windows or one unanimous systematic fault
    ask for a person; split votes alone do not, and the mask is not touched."""
    found = raster.alarms(image(spark, d), "image", WIDE, HIGH, 2, 150.0, 90.0, 2).agg(F.count("*").alias("alarms"))
    answers = table(spark, d, "events").where("event_id % 8 = 0").groupBy("user_id").agg(
        F.count("*").alias("votes"), F.count_distinct("event_type").alias("kinds"), F.min("event_type").alias("verdict"),
        F.lit(1.0).alias("confidence")
    )
    pilot = votes.audit_summary(answers, 3, ("error",), "error").select("flagged", "answered", F.col("unanimous_systematic").alias("systematic"))
    both = found.join(F.broadcast(pilot))  # a row each
    return both.withColumn("escalate", (F.col("alarms") > 0) | (F.col("flagged") > 0.2 * F.col("answered")) | (F.col("systematic") > 0))


@registry.add(f"""WITH RECURSIVE {IMG}, {MASKED} SELECT count(*) FILTER (WHERE valid AND label > 0) AS crystal_px, count(*) FILTER (WHERE valid AND label > 0 AND NOT out_) AS counted_px, count(*) FILTER (WHERE valid AND out_) AS excluded_px FROM img JOIN mask USING (x, y)""")
def stage_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions proposed, voted on, overridden and painted: what is left to count. Two of three votes exclude; a person
    keeps every third region."""
    px_ = image(spark, d)
    parts = raster.closed_parts(px_, "image", 3, WIDE, HIGH)
    regions = parts.select("image", "component").distinct()
    answers = regions.withColumn("voter", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "image", "component", F.lit("pool").alias("category"), F.lit(0.9).alias("confidence"), F.lit(True).alias("exclude")
    )
    voted = votes.keep_or_exclude(votes.tally(answers, "component", "category", "confidence", "exclude"))
    verdicts = voted.select("component", F.when(F.col("exclude"), "exclude").otherwise("keep").alias("verdict"))
    human = regions.where("component % 3 = 0").select("component", F.lit("keep").alias("verdict"))
    final = votes.apply_overrides(verdicts, human, "component", "verdict").where("verdict = 'exclude'").select(
        F.lit("scan").alias("image"), "component"
    )
    masked = raster.exclusion_mask(px_, "image", parts, final, WIDE, HIGH)
    crystal = F.col("valid") & (F.col("label") > 0)
    return masked.agg(
        F.count_if(crystal).alias("crystal_px"), F.count_if(crystal & ~F.col("_out")).alias("counted_px"),
        F.count_if(F.col("valid") & F.col("_out")).alias("excluded_px")
    )


@registry.add(f"""WITH {PX}, g AS (SELECT count(*) FILTER (WHERE valid AND label > 0) AS b, count(*) FILTER (WHERE valid AND NOT excluded AND label > 0) AS a FROM px), l AS (SELECT label, 100.0::DOUBLE * count(*) FILTER (WHERE valid AND NOT excluded) / a - 100.0::DOUBLE * count(*) FILTER (WHERE valid) / b AS delta FROM px, g WHERE label > 0 GROUP BY label, a, b)
SELECT round(max(abs(delta)), 6) AS largest_shift, max(abs(delta)) > 0.05 AS escalate, (SELECT count(*) FROM px WHERE valid AND NOT excluded AND label > 0) AS counted_px FROM l""")
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Composition with and without exclusions: a large shift of any layer asks for a person."""
    s = grid.exclusion_sensitivity(px(spark, d), 0.05, 0.5)
    return s.agg(F.round(F.max(F.abs("delta_pp")), 6).alias("largest_shift"), F.bool_or("alarm").alias("escalate"), F.sum("after_px").alias("counted_px"))


@registry.add("SELECT 'counts' AS stage, 'reused' AS decision, 1::BIGINT AS attempts, (SELECT count(DISTINCT lang) FROM documents) AS \"rows\"")
def reused_stage(spark: SparkSession, d: str) -> DataFrame:
    """A stage whose inputs and parameters are as before is not run again."""
    docs = table(spark, d, "documents")
    stage = memo.Stage("counts", lambda s, i, p: i["documents"].groupBy("lang").agg(F.count("*").alias("n")), ("documents",))
    folder, done = new_folder(spark, "stages"), []
    for _ in range(2):
        done = []
        memo.run_all(spark, folder, [stage], {"documents": docs}, {"documents": d}, records=done)
    return memo.publish_records(spark, done, new_folder(spark, "manifest")).select("stage", "decision", "attempts", "rows")


@registry.add("SELECT o_orderkey AS run, left(sha256('{\"sample\":' || o_custkey || ',\"nx\":' || (o_orderkey % 7) || '}'), 64) AS binding FROM orders")
def run_bindings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("run"),
        scalar.canonical_hash([F.col("o_custkey").alias("sample"), (F.col("o_orderkey") % 7).alias("nx")]).alias("binding")
    )

