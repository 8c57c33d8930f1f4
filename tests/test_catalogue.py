import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue, tiles
from tests.compare import same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
MAY_BE_EMPTY = {"low_variance_regions", "count_outlier_groups", "console_line_scan", "spatial_duplicates", "components"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    n = same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_a_twin_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["stride_sample_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[-1]


def test_tiles_with_large_ids(spark, sf_dir, tmp_path):
    """Every query on the grid of tiles runs where ids are far beyond 32 bits."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey <= 150")
    part.withColumn("p_partkey", part["p_partkey"] + 10_000_000_000_000_000).write.parquet(str(tmp_path / "part.parquet"))
    names = [n for n in tiles.QUERIES if "tiles AS (" in SQL.get(n, "")] + ["position_solve", "gain_solve", "anchor_tiles", "csv_sharpness", "mirrored_dataset"]
    assert len(names) > 15
    for name in names:
        QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
