"""Stages of a scan's analysis: each puts operators together and says whether a person is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import acquisition, joins, votes, windows


def votes_setting(text: Column, default: int = 3) -> Column:
    """``(adaptive, n)``: a whole number of votes, one at least, or ``adaptive`` with three to start from."""
    adaptive = F.lower(F.trim(text)) == "adaptive"
    n = F.when(adaptive, 3).otherwise(F.greatest(F.lit(1), scalar.safe_int(text, default)))
    return F.struct(F.coalesce(adaptive, F.lit(False)).alias("adaptive"), n.cast("long").alias("n"))


def parameters(given: Column, defaults: Mapping[str, float]) -> Column:
    """Given parameters over the defaults; names that have no default are left out."""
    names = list(defaults)
    known = F.map_filter(given, lambda k, v: k.isin(*names) & v.isNotNull())
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in (pair[0], float(pair[1]))))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(known, k), F.lit(False))), known)


def cache_key(columns: Sequence[Column | str], version: str) -> Column:
    """The key of a result: its inputs and options and the version of what makes it."""
    return F.substring(scalar.canonical_hash([*columns, F.lit(version).alias("version")]), 1, 16)


def binary_mask(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Per mask whether all its values are 0 or 1, and how many are not; a mask with others is refused, not rounded."""
    fine = F.coalesce(F.col(value).isin(0, 1), F.lit(False))
    return rows.groupBy(by).agg(F.bool_and(fine).alias("binary"), F.count_if(~fine).alias("odd"))


def matched_container(name: Column, pattern: str) -> Column:
    """A container's index by a pattern that may lie anywhere in its name, with or without ``.zip``."""
    bare = F.regexp_replace(name, r"\.zip$", "")
    found = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(found(name), found(bare)).try_cast("int")


def matched_tile(path: Column, pattern: str) -> Column:
    """A tile's number by a pattern for its whole file name, else for its whole path."""
    last = F.regexp_extract(path, r"([^/]+)$", 1)
    found = lambda c: F.nullif(F.regexp_extract(c, f"^(?:{pattern})$", 1), F.lit(""))
    return F.coalesce(found(last), found(path)).try_cast("int")


def resolved_layout(sources: DataFrame, by: str) -> DataFrame:
    """The layout to use of ``(by, source, valid)``: a file's before a cached one before a planned one. The first that is
    there counts, and if it is not valid there is none: no silent fall-back."""
    rank = F.element_at(F.create_map(F.lit("file"), F.lit(0), F.lit("cached"), F.lit(1), F.lit("planner"), F.lit(2)), F.col("source"))
    first = sources.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), "source", "valid")).alias("f"))
    return first.select(by, F.col("f.source").alias("source"), F.when(F.col("f.valid"), "accepted").otherwise("refused").alias("state"))


def resolved_positions(tiles: DataFrame, named: DataFrame, numbered: DataFrame) -> DataFrame:
    """Positions of tiles ``(tid, index)`` by name, else by index; those that are not finite are missing."""
    a = named.select(F.col("tid").alias("_t"), F.struct("x", "y").alias("_a"))
    b = numbered.select(F.col("index").alias("_i"), F.struct("x", "y").alias("_b"))
    met = tiles.join(a, F.col("tid") == F.col("_t"), "left").join(b, F.col("index") == F.col("_i"), "left")
    at = F.coalesce("_a", "_b")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = finite(at["x"]) & finite(at["y"])
    return met.select("tid", "index", F.when(fine, at["x"]).alias("x"), F.when(fine, at["y"]).alias("y"))


def colour_state(state: Column, measured: Column, rendered: Column) -> Column:
    """What became of the colour step: off, already corrected, or measured and verified by what was rendered; a step
    that failed stops the run."""
    return F.when(state == "disabled", "off").when(
        state == "already_corrected", "already_corrected"
    ).when(~measured, "failed").when(rendered, "corrected").otherwise("unverified")


def agreeing(documents: DataFrame, by: str, columns: Sequence[str], n: int) -> DataFrame:
    """Per contract whether all its n documents are there and agree in the columns, and in which they do not."""
    differ = [F.when(F.count_distinct(F.struct(c)) > 1, F.lit(c)) for c in columns]
    out = documents.groupBy(by).agg(F.count("*").alias("documents"), F.array_compact(F.array(*differ)).alias("differing"))
    return out.withColumn("agrees", (F.col("documents") == n) & (F.size("differing") == 0))


def repaired(parameter: Mapping[str, Column], why: Column) -> Column:
    """The parameters of a retry: another filler, a wider overlap, or two votes more, by the reason of the failure."""
    filler = F.when(why.contains("filler"), F.when(parameter["filler"] == "white", "black").otherwise("white")).otherwise(parameter["filler"])
    overlap = F.when(why.contains("seam"), F.greatest(F.lit(128), 2 * parameter["overlap"])).otherwise(parameter["overlap"])
    more = F.when(why.contains("split"), parameter["votes"] + 2).otherwise(parameter["votes"])
    return F.struct(filler.alias("filler"), overlap.alias("overlap"), more.alias("votes"))


def decided(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """A person's decisions with new ones in place of earlier ones on the same region. A decision without a note, or that
    does not say just one of keep and exclude, is not taken."""
    fine = new.where((F.trim("note") != "") & (F.col("keep") != F.col("exclude")))
    return votes.upsert(old, fine, list(key))


def as_result(ok: Column, confidence: Column, reason: Column) -> Column:
    """A stage's result: it escalates where it is not well, or not sure enough."""
    escalate = ~ok | (confidence < 0.5)
    return F.struct(
        ok.alias("ok"), confidence.alias("confidence"), escalate.alias("escalate"),
        F.when(escalate, F.coalesce(reason, F.lit("unsure"))).alias("escalate_reason")
    )


def assemble(captures: DataFrame, runs: DataFrame, identity: Sequence[str], prefer: str = "latest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One grid from several runs: ``(selected, duplicates, missing)``.

    Runs ``(run, started, rows, cols, *identity)`` of the identity with the most captures count, null like null; of a
    place ``(row, col)`` that several of them took, the latest run's capture (or the earliest) is selected, and the
    place is reported with whether all were the same. Missing are the places of the grid that no run took.
    """
    sizes = captures.groupBy("run").agg(F.count("*").alias("_n"))
    # a row per run
    known = runs.join(sizes, "run")
    groups = known.groupBy(*identity, "rows", "cols").agg(F.sum("_n").alias("_t"), F.min("started").alias("_s"))
    best = groups.orderBy(F.desc("_t"), "_s", *identity).limit(1).select(*(F.col(c).alias(f"_{c}") for c in (*identity, "rows", "cols")))
    same = F.lit(True)
    for c in (*identity, "rows", "cols"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    chosen = known.join(F.broadcast(best), same).select("run", "started", "rows", "cols")
    taken = captures.join(chosen, "run")
    order = [F.col("started"), F.col("run")] if prefer == "latest" else [-F.col("started"), -F.col("run")]
    rows = taken.select("row", "col", "run", "started", "capture", "sha256")
    selected = windows.last_wins(rows, ["row", "col"], order)
    twice = rows.groupBy("row", "col").agg(F.count("*").alias("captures"), (F.count_distinct("sha256") == 1).alias("identical")).where("captures > 1")
    places = chosen.agg(F.max("rows").alias("r"), F.max("cols").alias("c")).select(F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("row"), "c").select(
        "row", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("col")
    )
    return selected, twice, places.join(rows, ["row", "col"], "left_anti")


def verified(manifest: DataFrame, files: DataFrame, runtime: DataFrame, current: DataFrame, captures: DataFrame) -> DataFrame:
    """What is wrong with a handover, a line per finding ``(check, name)``: files missing or changed, parts of the program
    that differ, captures without a file."""
    lines = joins.manifest_check(manifest, files, "path").where("state <> 'ok'").select(
        F.concat(F.lit("file "), F.col("state")).alias("check"), F.col("path").alias("name")
    )
    differing = joins.manifest_diff(runtime, current, "path").select(F.lit("runtime differs").alias("check"), F.col("path").alias("name"))
    absent = captures.select(F.col("path").alias("name")).join(
        files.select(F.col("path").alias("name")), "name", "left_anti"
    ).select(F.lit("capture without file").alias("check"), "name")
    return lines.unionByName(differing).unionByName(absent)


def frame_contract(frames: DataFrame, width: Column, height: Column) -> DataFrame:
    """Frames with why they do not keep the contract: unreadable, or of another size than was agreed."""
    why = F.when(F.col("width").isNull() | F.col("height").isNull(), "unreadable").when(
        (F.col("width") != width) | (F.col("height") != height), "size differs"
    )
    return frames.withColumn("fault", why)


def inspected(tiles: DataFrame, by: str) -> DataFrame:
    """Per dataset what a stitch needs to know: columns, fewest tiles of a column, sizes, containers of several kinds, and
    the divisors that leave no rest."""
    columns = tiles.groupBy(by, "col").agg(F.count("*").alias("n"))
    fewest = columns.groupBy(by).agg(F.count("*").alias("columns"), F.min("n").alias("fewest"))
    rest = [F.when((F.min("width") % d == 0) & (F.min("height") % d == 0), F.lit(d)) for d in (1, 2, 4, 8, 16)]
    sizes = tiles.groupBy(by).agg(
        F.count_distinct("width", "height").alias("sizes"), F.count_distinct("kind").alias("kinds"), F.array_compact(F.array(*rest)).alias("divisors")
    )
    out = fewest.join(sizes, by)
    return out.withColumn("ready", (F.col("columns") >= 2) & (F.col("fewest") >= 2) & (F.col("sizes") == 1) & (F.col("kinds") == 1))


def focus_check(files: DataFrame, points: DataFrame, by: str, since: float, least: float) -> DataFrame:
    """Per run: its new frames, whether they fit the scan's points, and those to take again; no new frame is a problem of
    its own. ``files`` has ``(by, name, at, score)``, ``points`` ``(by, place)``."""
    new = acquisition.recent(files, "name", "at", since)
    counts = points.groupBy(by).agg(F.count("*").alias("points")).join(
        new.groupBy(by).agg(F.count("*").alias("frames"), F.count_if(F.col("score") < least).alias("retake")), by, "left"
    ).fillna(0, ["frames", "retake"])
    state = F.when(F.col("frames") == 0, "no new frames").when(
        F.col("frames") != F.col("points"), "cannot be placed"
    ).when(F.col("retake") > 0, "retake").otherwise("ok")
    return counts.withColumn("state", state)


def review_boxes(proposed: DataFrame, given: DataFrame, by: str) -> DataFrame:
    """The rectangles of a review: those proposed and those that a person drew, each once, and who named it first."""
    box = ["x1", "y1", "x2", "y2"]
    both = proposed.select(by, *box, F.lit(0).alias("_o")).unionByName(given.select(by, *box, F.lit(1).alias("_o")))
    return both.groupBy(by, *box).agg(F.when(F.min("_o") == 0, "proposal").otherwise("person").alias("source"))


def anchors(tiles: DataFrame, index: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """Where tiles are held fast: nowhere, one of them at 0, or where ``places`` ``(id, x, y)`` says."""
    if places is not None:
        return places.join(tiles.select("id"), "id", "left_semi")
    none = F.lit(0.0)
    rows = tiles.where(F.col("id") == index) if index is not None else tiles.limit(0)
    return rows.select("id", none.alias("x"), none.alias("y"))


def ranked_roles(answers: DataFrame, by: str, roles: Sequence[str]) -> DataFrame:
    """Which of the known roles answered, in their order, and which did not."""
    listed = F.array(*map(F.lit, roles))
    return answers.groupBy(by).agg(F.collect_set("role").alias("_r")).select(
        by, F.array_intersect(listed, "_r").alias("answered"), F.array_except(listed, "_r").alias("silent")
    )


def latest_by(rows: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The newest state of each step."""
    w = F.max_by(F.struct(*columns), order)
    return rows.groupBy(by).agg(w.alias("_l")).select(by, "_l.*")
