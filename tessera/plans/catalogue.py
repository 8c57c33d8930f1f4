"""All queries of the imaging operators, with their SQL twins.

The driver's tables stand in for imaging records: line items are pixel observations of a 640 by 480 label raster, parts
are tiles of a grid of 50 rows, events are a journal per user, embeddings are spectra.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import alignments, checks, journals, models, numerics, rasters, records, regions, scans, spectra, stages, tiles

PARTS = (rasters, tiles, journals, spectra, numerics, records, scans, checks, regions, alignments, stages, models)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
