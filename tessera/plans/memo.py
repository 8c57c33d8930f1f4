"""Stages with remembered results: a stage runs again only if its inputs, parameters or version changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import sinks


@dataclass(frozen=True)
class Stage:
    """``run(spark, inputs, params)`` gives a DataFrame; ``retry`` may change the parameters after a failed check."""

    name: str
    run: Callable[[SparkSession, Mapping[str, DataFrame], Mapping], DataFrame]
    inputs: tuple[str, ...] = ()
    params: Mapping = field(default_factory=dict)
    version: str = "1"
    check: Callable[[DataFrame], str | None] | None = None
    retry: Callable[[Mapping, str], Mapping | None] | None = None


def fingerprint(stage: Stage, upstream: Mapping[str, str], params: Mapping) -> str:
    said = json.dumps([stage.name, stage.version, dict(params), [upstream[i] for i in stage.inputs]], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def run_all(spark: SparkSession, folder: str, stages: list[Stage], sources: Mapping[str, DataFrame], source_keys: Mapping[str, str], attempts: int = 3, records: list[dict] | None = None) -> dict[str, DataFrame]:
    """Run stages in order; each result is written to a folder named by its fingerprint and read back. A result that is
    there with its success mark is taken as it is. A failed check lets ``retry`` change the parameters, a bounded
    number of times, and raises after that. What was done is added to ``records``, a line per stage."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tables, keys = dict(sources), dict(source_keys)
    for stage in stages:
        params, ran = dict(stage.params), False
        for attempt in range(1, attempts + 1):
            key = fingerprint(stage, keys, params)
            path = f"{folder.rstrip('/')}/{stage.name}-{key}"
            mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not mark.getFileSystem(conf).exists(mark):
                ran = True
                stage.run(spark, {i: tables[i] for i in stage.inputs}, params).write.mode("overwrite").parquet(path)
            result = spark.read.parquet(path)
            why = stage.check(result) if stage.check else None
            changed = stage.retry(params, why) if why and stage.retry else None
            if why is None or changed is None:
                break
            params = dict(changed)
        if why:
            raise RuntimeError(f"{stage.name}: {why}")
        tables[stage.name], keys[stage.name] = result, key
        if records is not None:
            decision = "reused" if not ran else "retried" if attempt > 1 else "done"
            records.append({"stage": stage.name, "key": key, "decision": decision, "attempts": attempt, "rows": result.count()})
    return {s.name: tables[s.name] for s in stages}


def publish_records(spark: SparkSession, records: list[dict], target: str) -> DataFrame:
    """The records of a run written as JSON beside their target and renamed, and read back."""
    schema = "stage string, key string, decision string, attempts long, rows long"
    path = sinks.publish(spark.createDataFrame(records, schema).coalesce(1), target, "json")
    return spark.read.schema(schema).json(path)
