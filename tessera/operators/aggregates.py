"""Robust statistics, thresholds and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantile
from tessera.session import settle, small

#: Median absolute deviation to standard deviation of a normal distribution.
TO_SIGMA = 1.4826


def median(c: Column | str) -> Column:
    return F.percentile(c, 0.5)


def _deviation(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group the median, the median absolute deviation and the number of values; exact at any size of a group."""
    base = settle(quantile(df, by, value, 0.5, "med"))  # stored: both steps below use it
    off = _beside(df, base.select(*by, "med"), by).select(*by, F.abs(F.col(value) - F.col("med")).alias("_off"))
    return settle(_beside(base, quantile(off, by, "_off", 0.5, "mad").select(*by, "mad"), by))


def _beside(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what is known of their group, which has a row in ``groups``: broadcast where these have been counted to
    be few, so that a hot group's rows stay where they are. Without keys there is one group, and one row."""
    return df.join(small(groups), list(by)) if by else df.join(F.broadcast(groups))


def robust_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, z: float = 3.0) -> DataFrame:
    """The median where fewer than four values or no spread are there; else the weighted mean of what lies within z
    deviations of it. Rows with a null group stay out."""
    spread = _deviation(df, by, value)
    near = F.abs(F.col(value) - F.col("med")) <= z * TO_SIGMA * F.col("mad")
    out = _beside(df, spread, by).groupBy(*by).agg(
        F.first("med").alias("med"), F.first("mad").alias("mad"), F.first("n").alias("n"),
        F.sum(F.when(near, F.col(value) * F.col(weight))).alias("s"), F.sum(F.when(near, F.col(weight))).alias("w")
    )
    robust = F.when((F.col("mad") < 1e-6) | (F.col("n") < 4), F.col("med")).otherwise(F.try_divide("s", "w"))
    return out.select(*by, "n", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.round(robust, 6).alias("robust"))


def mad_z(df: DataFrame, by: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Deviations from the group's median in scaled median absolute deviations; a spread of 0 counts as 1e-9."""
    spread = _deviation(df, by, value).select(*by, F.col("med").alias("_med"), F.col("mad").alias("_mad"))
    scale = TO_SIGMA * F.when(F.col("_mad") == 0, 1e-9).otherwise(F.col("_mad"))
    return _beside(df, spread, by).withColumn(name, (F.col(value) - F.col("_med")) / scale).drop("_med", "_mad")


def focus_reference(df: DataFrame, score: str, contrast: str, least_contrast: float, least: int = 3) -> DataFrame:
    """One row: the upper quartile of the textured scores, null with fewer than three or if it is not positive."""
    out = quantile(df.where(F.col(contrast) >= least_contrast), [], score, 0.75, "p75")
    return out.select(F.when((F.col("n") >= least) & (F.col("p75") > 0), F.col("p75")).alias("reference"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def focus_decisions(df: DataFrame, score: str, contrast: str, least_contrast: float, floor: float, ratio: float) -> DataFrame:
    """``decision`` and ``reason`` of each frame against the reference of all of them."""
    reference = focus_reference(df, score, contrast, least_contrast)
    # an aggregate without groups: one row
    rows = df.join(F.broadcast(reference))
    s, r = F.col(score), F.col("reference")
    low = F.coalesce(F.col(contrast) < least_contrast, F.lit(True))
    under = ~finite(s) | (s < floor)
    behind = r.isNotNull() & (r > 0) & (s < ratio * r)
    return rows.withColumn(
        "decision", F.when(low, "low_texture").when(under | behind, "defocused").otherwise("ok")
    ).withColumn("reason", F.when(low, "contrast").when(under, "floor").when(behind, "ratio"))


def flag_tiles(df: DataFrame, score: str, contrast: str, std: str, size: str, clip: str, key: str) -> DataFrame:
    """An array of flags per tile, set anew on each call: flags of other makers are kept."""
    own = ["low_texture", "defocus", "focus_band", "low_contrast", "small_file", "clipped", "irregular_index"]
    scored = mad_z(mad_z(df, [], std, "_zs"), [], size, "_zb")
    rows = scored.join(F.broadcast(focus_reference(df, score, contrast, 4.0)))
    ratio = F.try_divide(F.col(score), F.col("reference"))
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.col(contrast) < 4, own[0]), flag((F.col(contrast) >= 4) & (ratio < 0.4), own[1]),
            flag((F.col(contrast) >= 4) & (ratio >= 0.4) & (ratio < 0.6), own[2]), flag(F.col("_zs") < -3, own[3]), flag(F.col("_zb") < -3, own[4]),
            flag(F.col(clip) > 0.35, own[5]), flag(F.col(key) != F.floor(F.col(key)), own[6])
        )
    )
    before = F.array_except(
        F.coalesce("flags", F.array().cast("array<string>")), F.array(*map(F.lit, own))
    ) if "flags" in df.columns else F.array().cast("array<string>")
    return rows.withColumn("flags", F.array_union(before, flags)).drop("_zs", "_zb", "reference")


def nested_median_baseline(df: DataFrame, kind: str, group: str, value: str) -> DataFrame:
    """Per kind the median over groups of the groups' medians, and what is left of the groups' medians without it."""
    inner = df.groupBy(kind, group).agg(median(value).alias("group_median"))
    base = inner.groupBy(kind).agg(median("group_median").alias("baseline"))
    return inner.join(base, kind).select(
        kind, group, F.round("group_median", 6).alias("group_median"), F.round("baseline", 6).alias("baseline"),
        F.round(F.col("group_median") - F.col("baseline"), 6).alias("residual")
    )


def count_outliers(df: DataFrame, by: str, share: float = 0.1, least: float = 2.0) -> DataFrame:
    """Groups whose row count is off the median count by more than the share of it, and more than ``least``."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    typical = counts.agg(median("n").alias("typical"))
    return counts.join(F.broadcast(typical)).where(F.abs(F.col("n") - F.col("typical")) > F.greatest(F.lit(least), share * F.col("typical")))


def largest_groups(df: DataFrame, by: str, least_share: float, most: int = 8) -> DataFrame:
    """The largest groups above a share of all rows, by size, then key; the sort keeps only what is asked for."""
    sizes = df.groupBy(by).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    out = sizes.join(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("size") / F.col("total"), 6))
    return out.where(F.col("size") >= least_share * F.col("total")).orderBy(F.desc("size"), by).limit(most).select(by, "size", "pct")


def edge_diagnostics(df: DataFrame, residual: Column, weight: Column, strong: float = 1e-2) -> DataFrame:
    """Weighted RMS, the RMS of strong edges alone, 95th percentile and maximum of the residuals, log-RMS of ratios."""
    e = df.select(residual.alias("r"), weight.alias("w"))
    rms = lambda cond: F.sqrt(F.sum(F.when(cond, F.col("w") * F.col("r") * F.col("r"))) / F.sum(F.when(cond, F.col("w"))))
    sums = e.agg(
        F.count("*").alias("edges"), F.round(rms(F.lit(True)), 6).alias("rms"), F.round(rms(F.col("w") > strong), 6).alias("strong_rms"),
        F.round(F.max(F.abs("r")), 6).alias("worst")
    )
    p95 = quantile(e.select(F.abs("r").alias("a")), [], "a", 0.95, "p95").select(F.round("p95", 6).alias("p95"))
    return sums.join(F.broadcast(p95)).select("edges", "rms", "strong_rms", "p95", "worst")  # a row each


def log_rms(df: DataFrame, by: Sequence[str], ratio: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.log(ratio), 2))), 6).alias("log_rms"))


def affine_fit(df: DataFrame, x: Column, y: Column, value: Column) -> DataFrame:
    """Least squares ``value ~ c0 + cx * x + cy * y`` by its normal equations: one row, from one pass of sums about the
    means of the first pass, which keeps large values well conditioned."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), value.cast("double").alias("v"))
    m = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"), F.count("*").alias("n"))
    s = rows.agg(
        F.covar_pop("x", "x").alias("sxx"), F.covar_pop("y", "y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
        F.covar_pop("x", "v").alias("sxv"), F.covar_pop("y", "v").alias("syv")
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    out = m.join(F.broadcast(s)).withColumn("det", det)
    cx = F.try_divide(F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy"), F.col("det"))
    cy = F.try_divide(F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy"), F.col("det"))
    out = out.withColumn("cx", cx).withColumn("cy", cy).withColumn("c0", F.col("mv") - F.col("cx") * F.col("mx") - F.col("cy") * F.col("my"))
    return out.select("n", "c0", "cx", "cy")


def placement_check(df: DataFrame, x: Column, y: Column, value: Column, short_side: float) -> DataFrame:
    """The fit, its residuals' median, 95th percentile and maximum, and how many exceed a quarter of the short side."""
    fit = affine_fit(df, x, y, value)
    rows = df.select(x.alias("x"), y.alias("y"), value.alias("v")).join(F.broadcast(fit))
    r = F.abs(F.col("v") - F.col("c0") - F.col("cx") * F.col("x") - F.col("cy") * F.col("y"))
    rows = rows.withColumn("r", r)
    out = rows.groupBy("n", "c0", "cx", "cy").agg(F.max("r").alias("worst"), F.count_if(F.col("r") > 0.25 * short_side).alias("outliers"))
    for p, name in ((0.5, "p50"), (0.95, "p95")):
        out = out.join(F.broadcast(quantile(rows, [], "r", p, name).select(name)))  # a row
    return out.select("n", "outliers", *(F.round(c, 6).alias(c) for c in ("c0", "cx", "cy", "p50", "p95", "worst")))


def histogram(df: DataFrame, bin_: Column, bins: int) -> DataFrame:
    """Counts of all bins from 0, empty ones too."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(
        df.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n")), "bin", "left"
    ).select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def plateaus(df: DataFrame, bin_: Column, bins: int, reach: int = 3, around: int = 12, least: float = 0.1) -> DataFrame:
    """Local maxima of the smoothed histogram around which a share of all rows lies; ``plateau`` numbers runs of maxima
    that are no more than 1.5 times ``around`` apart. Windows run over the bins, whose number is fixed."""
    every = Window.partitionBy()
    order = Window.orderBy("bin")
    span = lambda n: order.rowsBetween(-n, n)
    h = histogram(df, bin_, bins).withColumn("smooth", F.sum("n").over(span(reach)) / (2.0 * reach + 1.0)).withColumn(
        "share", F.try_divide(F.sum("n").over(span(around)).cast("double"), F.sum("n").over(every))
    )
    peaks = h.withColumn("top", F.max("smooth").over(span(reach))).where(
        (F.col("smooth") == F.col("top")) & (F.col("n") > 0) & (F.col("share") >= least)
    )
    gap = F.coalesce((F.col("bin") - F.lag("bin").over(order) > 1.5 * around).cast("int"), F.lit(0))
    return peaks.withColumn("gap", gap).withColumn("plateau", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(
        "bin", "n", F.round("smooth", 6).alias("smooth"), F.round("share", 6).alias("share"), "plateau"
    )


def column_summary(df: DataFrame, by: str, key: str, score: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.round(median(score), 6).alias("median_score")
    )


def worst_of(df: DataFrame, by: Sequence[str], verdict: str, order: Sequence[str]) -> DataFrame:
    """The worst verdict by a fixed precedence, worst first; unknown verdicts come last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i)))), F.col(verdict)), F.lit(len(order)))
    return df.groupBy(*by).agg(F.min_by(verdict, F.struct(rank, F.col(verdict))).alias("worst"), F.count("*").alias("n"))


def split_gain(df: DataFrame, by: Sequence[str], red: str, green: str, blue: str) -> DataFrame:
    """Median gain of three channels as one brightness (geometric mean), the balance of each, and its largest deviation."""
    m = df.groupBy(*by).agg(median(red).alias("r"), median(green).alias("g"), median(blue).alias("b"))
    bright = F.exp((F.log("r") + F.log("g") + F.log("b")) / 3.0)
    m = m.withColumn("brightness", bright)
    off = F.greatest(*(F.abs(F.col(c) / F.col("brightness") - 1.0) for c in "rgb"))
    return m.select(
        *by, F.round("brightness", 6).alias("brightness"), *(F.round(F.col(c) / F.col("brightness"), 6).alias(f"balance_{c}") for c in "rgb"),
        F.round(off, 6).alias("max_deviation")
    )


def defocus_verdict(score: Column, reference: Column, ratio: float = 0.4, confidence: float = 0.8) -> Column:
    """The verdict of a closed rule, that asks nobody: a frame whose score is below the ratio of the reference goes.
    Null for other frames."""
    share = F.try_divide(score, reference)
    return F.when(
        share < ratio,
        F.struct(F.lit("defocus").alias("category"), F.lit(False).alias("keep"), F.lit(confidence).alias("confidence"), share.alias("ratio"))
    )


def outliers(rows: DataFrame, deviation: str, limit: float, tie: str, n: int) -> DataFrame:
    """The n rows that lie furthest off, of those beyond the limit: a report of bounded length."""
    return rows.where(F.col(deviation) > limit).orderBy(F.desc(deviation), tie).limit(n)


def argmax(rows: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """Per group the row of the largest score, of equals the smallest ``tie``."""
    return rows.groupBy(*by).agg(F.max_by(tie, F.struct(F.col(score), -F.col(tie))).alias(tie), F.max(score).alias(score))


def with_flags(flags: Column, own: Column, names: Sequence[str]) -> Column:
    """Flags with those that this maker may set replaced by the ones it sets now; others stay."""
    return F.array_union(F.array_except(flags, F.array(*map(F.lit, names))), own)
