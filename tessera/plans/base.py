"""Registration of queries and their twins, and the views that stand in for imaging records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

WIDTH, HEIGHT, COLUMNS, ROWS = 640, 480, 15, 8

# Each view twice: as a DataFrame, and as the WITH clause of a twin.
PX = "px AS (SELECT (l_orderkey % 640)::INT AS x, (l_partkey % 480)::INT AS y, (l_linenumber % 4)::INT AS label, l_returnflag <> 'A' AS valid, l_discount >= 0.08 AS excluded, l_quantity AS value, l_extendedprice AS price FROM lineitem)"
TILES = "tiles AS (SELECT p_partkey AS id, (p_partkey % 50)::INT AS row, p_partkey // 50 AS col, p_retailprice AS metric, p_size AS size FROM part)"
JOURNAL = "journal AS (SELECT user_id, event_id, event_type AS event, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


def px(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey % 640 as int) as x", "cast(l_partkey % 480 as int) as y", "l_linenumber % 4 as label", "l_returnflag <> 'A' as valid",
        "l_discount >= 0.08 as excluded", "l_quantity as value", "l_extendedprice as price"
    )


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_partkey as id", "cast(p_partkey % 50 as int) as row", "p_partkey div 50 as col", "p_retailprice as metric", "p_size as size"
    )


def micros(column: str) -> str:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"


def journal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id", "event_id", "event_type as event", "value", f"{micros('ts')} as us",
        "cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as sequence"
    )


class Registry:
    """Queries by name; ``add(sql)`` registers the function that follows, with its twin if it has one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
