"""Queries on operators that SQL can't express: solvers, fits, images and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fitting, joins, solve
from tessera.plans.base import JOURNAL, Registry, journal, rounded, tiles
from tessera.session import new_folder, table
from tessera.streaming import journal as streams

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d).withColumnRenamed("metric", "value")
    pairs = joins.neighbour_pairs(t.select("row", "col", "id", "value"), "id")
    metric = t.select(F.col("id"), F.col("value").alias("m"))
    a, b = metric.toDF("value", "ma"), metric.toDF("value2", "mb")
    return pairs.join(a.hint("merge"), "value").join(b.hint("merge"), "value2").select(
        F.col("value").alias("src"), F.col("value2").alias("dst"), F.col("col").alias("src_col"), F.col("col2").alias("dst_col"),
        ((F.col("col2") - F.col("col")) * 100 + F.col("ma") % 7 / 10).alias("dx"),
        ((F.col("row2") - F.col("row")) * 80 + F.col("mb") % 5 / 10).alias("dy"), F.lit(1.0).alias("w"),
        (1.0 + (F.col("mb") - F.col("ma")) / 20000).alias("ratio")
    )


@registry.add()
def position_solve(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return solve.residuals(e, solve.solve_positions(e)).select("src", "dst", F.round("residual", 4).alias("residual"))


@registry.add()
def gain_solve(spark: SparkSession, d: str) -> DataFrame:
    return solve.solve_gains(_edges(spark, d)).select("id", F.round("gain", 6).alias("gain"))


@registry.add()
def spectrum_fits(spark: SparkSession, d: str) -> DataFrame:
    y = "transform(sequence(0, 299), i -> 0.2D + exp(-pow(1.6D + i * 0.002D - 1.85D - embedding[0] / 20, 2) / 0.0032D) + 0.6D * exp(-pow(1.6D + i * 0.002D - 2.0D, 2) / 0.0032D) + embedding[cast(i % 64 as int)] / 100)"
    s = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("transform(sequence(0, 299), i -> 1.6D + i * 0.002D)").alias("x"), F.expr(y).alias("y")
    )
    return fitting.fit_spectra(s)


def _in_two(spark: SparkSession, rows: DataFrame, first: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A stream run over the rows that come first, stopped, and started again when the others are there."""
    folder, out, state = (new_folder(spark, f"{name}-{n}") for n in ("in", "out", "state"))
    for part in (rows.where(first), rows.where(f"not ({first})")):
        part.write.mode("append").parquet(folder)
        found = streams.run_available(spark, make(spark.readStream.schema(rows.schema).parquet(folder)), name, out, state)
    return found


@registry.add(f"""WITH {JOURNAL}, k AS (SELECT user_id, sequence, event_id, coalesce(lag(sequence) OVER (PARTITION BY user_id ORDER BY sequence), 0) + 1 AS upcoming FROM journal WHERE event <> 'view')
SELECT user_id::VARCHAR AS stream_id, sequence, event_id::VARCHAR AS event_id, 'gap' AS fault FROM k WHERE sequence > upcoming UNION ALL SELECT user_id::VARCHAR, sequence, event_id::VARCHAR, 'no start' FROM k WHERE sequence = 1""")
def journal_stream(spark: SparkSession, d: str) -> DataFrame:
    """Faults that the streaming check finds in the journals without their view events."""
    j = journal(spark, d).where("event <> 'view'").selectExpr(
        "cast(user_id as string) as stream_id", "sequence", "cast(event_id as string) as event_id", "event"
    )
    return _in_two(spark, j, "sequence <= 25", streams.validate_stream, "faults")


@registry.add(f"""WITH RECURSIVE {JOURNAL}, r(user_id, sequence, recent, reference, accepted) AS (SELECT DISTINCT user_id, 0::BIGINT, []::DOUBLE[], NULL::DOUBLE, true FROM journal
UNION ALL SELECT j.user_id, j.sequence, CASE WHEN m.ok THEN list_slice(list_append(r.recent, j.value), greatest(1, len(r.recent) - 13), len(r.recent) + 1) ELSE r.recent END, m.ref, m.ok
FROM r JOIN journal j ON j.user_id = r.user_id AND j.sequence = r.sequence + 1, LATERAL (SELECT CASE WHEN len(r.recent) >= 3 THEN list_median(r.recent) END AS ref, len(r.recent) < 3 OR j.value >= 0.6 * list_median(r.recent) AS ok) m)
SELECT user_id::VARCHAR AS stream_id, sequence, round(reference, 6) AS reference, accepted FROM r WHERE sequence > 0""")
def running_focus(spark: SparkSession, d: str) -> DataFrame:
    frames = journal(spark, d).selectExpr("cast(user_id as string) as stream_id", "sequence", "value as score")
    return rounded(_in_two(spark, frames, "sequence <= 25", streams.running_focus, "focus"), "reference")


@registry.add("SELECT event_type AS event, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def mirrored_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that come twice, in later batches too, mirrored once by their id."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    folder, target, state = (new_folder(spark, n) for n in ("mirror", "mirrored", "mirrored-state"))
    for part in (e.where("event_id % 2 = 0"), e.unionByName(e.where("event_id % 3 = 0"))):
        part.write.mode("append").parquet(folder)
        out = streams.mirror(spark, spark.readStream.schema(e.schema).parquet(folder), target, state)
    return out.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
