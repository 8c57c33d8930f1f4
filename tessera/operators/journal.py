"""Event journals: validation, summaries, snapshots, and the state of the last session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(events: DataFrame, stream: str = "stream_id", first: str = "history_started", last: str = "history_closed") -> DataFrame:
    """One row per stream: whether the sequence is contiguous from 1, ids are unique, the start is the first event and
    the only one, and nothing follows the close."""
    w = Window.partitionBy(stream).orderBy("sequence")
    rows = events.withColumn("_n", F.row_number().over(w))
    out = rows.groupBy(stream).agg(
        F.count("*").alias("events"),
        F.bool_and(F.col("_n") == F.col("sequence")).alias("contiguous"),
        (F.count_distinct("event_id") == F.count("*")).alias("unique_ids"),
        (F.min_by("event", "sequence") == first).alias("starts"),
        (F.count_if(F.col("event") == first) == 1).alias("one_start"),
        F.coalesce(F.min(F.when(F.col("event") == last, F.col("sequence"))) == F.max("sequence"), F.lit(True)).alias("nothing_after_close"),
        (F.count_if(F.col("event") == last) > 0).alias("closed"),
    )
    return out.withColumn("valid", F.col("contiguous") & F.col("unique_ids") & F.col("starts") & F.col("one_start") & F.col("nothing_after_close"))


def summary(events: DataFrame, by: str, at: str, order: Column, event: str = "event", incident: Column | None = None, capture: Column | None = None) -> DataFrame:
    """Per run: events by kind, first and last event in journal order, captures, incidents."""
    inc, cap = (c if c is not None else F.lit(False) for c in (incident, capture))
    return events.groupBy(by).agg(
        F.count("*").alias("events"),
        F.count_distinct(event).alias("kinds"),
        F.min_by(event, order).alias("first_event"),
        F.max_by(event, order).alias("last_event"),
        F.min(at).alias("started"),
        F.max(at).alias("ended"),
        F.count_if(cap).alias("captures"),
        F.count_if(inc).alias("incidents"),
    )


def event_counts(events: DataFrame, by: str, event: str = "event") -> DataFrame:
    """A map from event to count per run; it holds as many entries as there are kinds of events."""
    counts = events.groupBy(by, event).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(event, "n")))).alias("event_counts"))


def snapshot_lag(events: DataFrame, snapshots: DataFrame, stream: str = "stream_id") -> DataFrame:
    """How many events each snapshot is behind its journal, and whether it is a prefix of it."""
    lengths = events.groupBy(stream).agg(F.max("sequence").alias("journal_sequence"))
    seen = snapshots.groupBy(stream).agg(F.max("sequence").alias("snapshot_sequence"), F.count("*").alias("n"))
    right = events.select(F.col(stream).alias("_s"), F.col("sequence").alias("_q"), F.col("event_id").alias("_e"))
    same = snapshots.join(
        right, (F.col(stream) == F.col("_s")) & (F.col("sequence") == F.col("_q")) & (F.col("event_id") == F.col("_e")), "left_semi"
    ).groupBy(stream).agg(F.count("*").alias("same"))
    out = lengths.join(seen, stream, "left").join(same, stream, "left")
    return out.select(
        stream, "journal_sequence", F.coalesce("snapshot_sequence", F.lit(0)).alias("snapshot_sequence"),
        (F.col("journal_sequence") - F.coalesce("snapshot_sequence", F.lit(0))).alias("lag"),
        (F.coalesce("same", F.lit(0)) == F.coalesce("n", F.lit(0))).alias("is_prefix")
    )


def note_references(notes: DataFrame, events: DataFrame) -> DataFrame:
    """Notes ``(note_id, snapshot_sequence, related_ids)``: valid if all ids are known and none is newer than the
    note's snapshot."""
    ids = notes.select("note_id", "snapshot_sequence", F.explode_outer("related_ids").alias("event_id"))
    known = events.select(F.col("event_id").alias("_e"), "sequence")
    out = ids.join(known, F.col("event_id") == F.col("_e"), "left")
    ok = F.col("event_id").isNull() | (F.col("sequence").isNotNull() & (F.col("sequence") <= F.col("snapshot_sequence")))
    return out.groupBy("note_id").agg(F.bool_and(ok).alias("valid"), F.count("event_id").alias("references"))


def consistency(results: DataFrame) -> DataFrame:
    """Across samples ``(sample, config_hash, rule, excluded, open_escalation, override)``: how many configurations and
    rules there are, whether exclusions are even, and what is open."""
    return results.agg(
        F.count_distinct("config_hash").alias("configs"), F.count_distinct("rule").alias("rules"),
        (F.count_if("excluded") % F.greatest(F.count("*"), F.lit(1)) == 0).alias("even_exclusions"),
        F.count_if("open_escalation").alias("open_escalations"), F.count_if("override").alias("overrides")
    )


def history_summary(events: DataFrame, by: str, order: str, event: str, marks: Mapping[str, Column]) -> DataFrame:
    """Per history: its events, how many of them each mark holds for, and the last event in journal order."""
    return events.groupBy(by).agg(
        F.count("*").alias("events"), *(F.count_if(c).alias(name) for name, c in marks.items()), F.max_by(event, order).alias("last_event")
    )


def note_checks(notes: DataFrame, events: DataFrame, note: str = "note_id", related: str = "related_ids", event: str = "event_id") -> DataFrame:
    """Per note: its references, how many of them are unknown, and whether it may be written: only if none is."""
    refs = notes.select(note, F.explode(related).alias("_e"))
    known = events.select(F.col(event).alias("_k")).distinct()
    met = refs.join(known, F.col("_e") == F.col("_k"), "left")
    return met.groupBy(note).agg(
        F.count("*").alias("refs"), F.count_if(F.col("_k").isNull()).alias("unknown"), F.bool_and(F.col("_k").isNotNull()).alias("written")
    )


def prefix_of(copy: DataFrame, journal: DataFrame, stream: str, sequence: str = "sequence", ident: str = "event_id") -> DataFrame:
    """Per journal: whether a copy is an exact prefix of it, how many events the copy has, and how many are to be
    appended. A copy that is none is not repaired."""
    held = copy.select(F.col(stream).alias("_t"), F.col(sequence).alias("_q"), F.col(ident).alias("_i"))
    met = journal.join(held, (F.col(stream) == F.col("_t")) & (F.col(sequence) == F.col("_q")), "left")
    out = met.groupBy(stream).agg(
        F.bool_and(F.col("_i").isNull() | (F.col("_i") == F.col(ident))).alias("is_prefix"), F.count("_i").alias("copied"),
        F.count("*").alias("total")
    )
    return out.withColumn("to_append", F.col("total") - F.col("copied"))
