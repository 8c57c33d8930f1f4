"""Spectra in parallel arrays ``x`` and ``y``: cleaning, orientation, quality rules, calibration, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import small


def points(spectra: DataFrame, ident: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per sample of each spectrum: position from 0 and value."""
    return spectra.select(ident, *by, F.posexplode(y).alias("pos", "val"))


def templates(spectra: DataFrame, by: Sequence[str], ident: str, y: str) -> DataFrame:
    """The element-wise median of a class's spectra: one row per class and position."""
    return points(spectra, ident, y, by).groupBy(*by, "pos").agg(F.percentile("val", 0.5).alias("median"), F.count("*").alias("n"))


def shape_correlation(spectra: DataFrame, template: DataFrame, ident: str, y: str, on: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each spectrum with each template (of its own class where ``on`` names one), and the best."""
    keys = [c for c in template.columns if c not in ("pos", "median", "n")]
    t = template.select(*(F.col(k).alias(f"t_{k}") for k in keys), F.col("pos").alias("_p"), "median")
    cond = F.col("pos") == F.col("_p")
    for k in on:
        cond = cond & (F.col(k) == F.col(f"t_{k}"))
    met = points(spectra, ident, y, on).join(small(t, 100_000), cond)
    r = met.groupBy(ident, *(f"t_{k}" for k in keys)).agg(F.corr("val", "median").alias("r"))
    return r.groupBy(ident).agg(
        F.max_by(F.struct(*(f"t_{k}" for k in keys)), F.struct("r", *(-F.col(f"t_{k}") for k in keys))).alias("best"), F.max("r").alias("r")
    )


def orientation(spectra: DataFrame, ident: str, y: str, band: tuple[int, int], base: tuple[int, int]) -> DataFrame:
    """+1 or -1: whether the band's median lies above the baseline's (0 counts as +1); null if a window is empty."""
    window = lambda w: F.when((F.col("pos") >= w[0]) & (F.col("pos") < w[1]), F.col("val"))
    m = points(spectra, ident, y).groupBy(ident).agg(F.percentile(window(band), 0.5).alias("band"), F.percentile(window(base), 0.5).alias("base"))
    sign = F.when(F.col("band").isNull() | F.col("base").isNull(), None).when(F.col("band") < F.col("base"), -1).otherwise(1)
    return m.select(ident, sign.alias("orientation"))


def quality(metrics: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """``reasons`` and ``verdict`` from rules ``(name, condition, reject|warn)``: the worst of those that hold."""
    named = lambda level: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c, v in rules if v == level)))
    out = metrics.withColumn("_r", named("reject")).withColumn("_w", named("warn"))
    verdict = F.when(F.size("_r") > 0, "reject").when(F.size("_w") > 0, "warn").otherwise("pass")
    return out.withColumn("reasons", F.concat("_r", "_w")).withColumn("verdict", verdict).drop("_r", "_w")


def saturation_share(y: Column) -> Column:
    """The share of the samples that equal the largest one."""
    return F.try_divide(F.size(F.filter(y, lambda v: v == F.array_max(y))).cast("double"), F.size(y))


def calibrate(fits: DataFrame, by: Sequence[str], klass: Column, value: Column, low: str, high: str, default: float, gap: float) -> DataFrame:
    """A threshold per group halfway between two classes' medians (the default if one is missing), and whether the
    classes are apart by the gap."""
    pick = lambda k: F.when(klass == k, value)
    m = fits.groupBy(*by).agg(
        F.percentile(pick(low), 0.5).alias("low_median"), F.percentile(pick(high), 0.5).alias("high_median"), F.max(pick(low)).alias("low_max"),
        F.min(pick(high)).alias("high_min")
    )
    threshold = F.coalesce((F.col("low_median") + F.col("high_median")) / 2.0, F.lit(float(default)))
    return m.select(
        *by, F.round("low_median", 6).alias("low_median"), F.round("high_median", 6).alias("high_median"), F.round(threshold, 6).alias("threshold"),
        F.coalesce(F.col("high_min") - F.col("low_max") >= gap, F.lit(False)).alias("separated")
    )


#: An amplitude ratio above this is too weak to overrule the splitting; between these bounds amplitudes decide nothing
#: where classes have no gap; an energy gap must be this wide (meV), and a decision this far from its threshold.
VETO_CLEAR, NO_GAP, EA_GAP, EA_CLEAR = 0.8, (0.8, 1.25), 8.0, 3.0


def with_reference(fits: DataFrame, reference: DataFrame, substrate: str, threshold: float = 150.0) -> DataFrame:
    """Fits with what is calibrated for their substrate: ``threshold`` (else the default, and ``calibrated`` is false),
    ``amplitude`` between one layer and two (null: not decided by it), ``amp_gap`` and ``ea_gap`` whether amplitude or
    energy separate the classes, ``ea_threshold`` and ``ea_gap_mev``."""
    known = small(reference.withColumnRenamed(substrate, "_s"))
    out = fits.join(known, F.col(substrate) == F.col("_s"), "left").withColumn("calibrated", F.col("_s").isNotNull())
    return out.withColumns(
        {
            "threshold": F.coalesce("threshold", F.lit(threshold)), "amp_gap": F.coalesce("amp_gap", F.lit(False)),
            "ea_gap": F.coalesce("ea_gap", F.lit(False))
        }
    ).drop("_s")


def assign(fits: DataFrame, split: str = "split", amplitude: str = "aa", energy: str = "ea") -> DataFrame:
    """Labels by rule of fits with their reference (``with_reference``).

    A splitting from the threshold on says 2H; where amplitudes have a gap, one of a single layer overrules it (1L), and
    one that is low but not clearly so leaves the label and flags it. Below the threshold the amplitude decides between
    1L and 3R, where it is calibrated (else ``3R-or-1L``); where amplitudes have no gap but energies do, the energy
    does, flagged if it is near its threshold or a clear amplitude says otherwise. Without either, an amplitude near
    its threshold is flagged. On a substrate that was not calibrated all is flagged and the confidence is 0. A missing
    splitting gives no label and the flag ``no_fit``.
    """
    s, a, e = F.col(split), F.col(amplitude), F.col(energy)
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = fits.withColumns({"margin_mev": s - F.col("threshold"), "amp_ratio": F.try_divide(a, F.col("amplitude")), "_tall": s >= F.col("threshold")})
    tall, ratio, margin = F.col("_tall"), F.col("amp_ratio"), F.col("margin_mev")
    out = out.withColumns({"_low": yes(tall & F.col("amp_gap") & (ratio < 1)), "_by_ea": yes(~tall & F.col("amplitude").isNotNull() & ~F.col("amp_gap") & F.col("ea_gap")), "ea_margin_mev": (e - F.col("ea_threshold")) * 1000})
    low, by_ea, away = F.col("_low"), F.col("_by_ea"), F.col("ea_margin_mev")
    vetoed = low & (ratio <= VETO_CLEAR)
    by_amplitude, by_energy = F.when(a < F.col("amplitude"), "1L").otherwise("3R"), F.when(away >= 0, "1L").otherwise("3R")
    undecided = (ratio > NO_GAP[0]) & (ratio < NO_GAP[1])
    label = F.when(
        tall, F.when(vetoed, "1L").otherwise("2H")
    ).when(F.col("amplitude").isNull(), "3R-or-1L").when(by_ea, by_energy).otherwise(by_amplitude)
    flag = F.when(s.isNull(), "no_fit").when(~F.col("calibrated"), "substrate_uncalibrated").when(low & ~vetoed, "amp_veto_ambiguous").when(by_ea & (F.abs(away) < EA_CLEAR), "ea_ambiguous").when(
        by_ea & (by_energy != by_amplitude) & ~undecided, "ea_amp_conflict"
    )
    flag = flag.when(yes(~tall & F.col("amplitude").isNotNull() & ~by_ea & ~F.col("amp_gap") & undecided), "amp_nogap_ambiguous").otherwise("")
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    base, weak = within(F.abs(margin) / 15.0), within((1 - ratio) / (1 - VETO_CLEAR))
    sure = F.when(~F.col("calibrated"), 0.0).when(vetoed, weak).when(low, F.least(base, weak)).when(
        by_ea, F.least(base, within(F.abs(away) / F.greatest(F.lit(EA_CLEAR), F.col("ea_gap_mev") / 2)))
    ).otherwise(base)
    decided = F.when(by_ea, "E_A").when(~tall & F.col("amplitude").isNotNull(), "amplitude").otherwise("splitting")
    out = out.withColumns({"rule_label": F.when(s.isNotNull(), label), "stacking": F.when(tall, "2H").otherwise("3R-or-1L"), "rule_flag": flag, "vetoed": vetoed, "decided_by": decided, "confidence": sure})
    return out.withColumn("ea_margin_mev", F.when(by_ea, away)).drop("_tall", "_low", "_by_ea")


def gate(rules: DataFrame, near: float = 4.0, no_gap: str = "escalate") -> DataFrame:
    """``to_model``: labels that the rule leaves open, splittings nearer to the threshold than ``near``, and, under the
    policy ``model``, ambiguous amplitudes. ``escalates``: what the rule itself hands to a person."""
    open_ = (F.col("rule_label") == "3R-or-1L") | (F.abs("margin_mev") < near)
    ambiguous = F.col("rule_flag") == "amp_nogap_ambiguous"
    to_model = F.coalesce(open_ | (ambiguous & F.lit(no_gap == "model")), F.lit(False))
    out = rules.withColumn("to_model", to_model)
    said = F.col("rule_flag").isin("amp_veto_ambiguous", "ea_ambiguous", "ea_amp_conflict", "substrate_uncalibrated")
    return out.withColumn("escalates", said | (ambiguous & ~(F.col("to_model") & F.lit(no_gap == "model"))))


def agreement(rows: DataFrame, by: Sequence[str], truth: Column, label: Column, also: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Per group: rows, labelled rows, agreeing ones (pairs in ``also`` count), and their share."""
    same = truth == label
    for a, b in also:
        same = same | ((truth == a) & (label == b))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(same).alias("agreed"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("agreed").cast("double"), F.col("labelled")), 6))


def interpolate(x: Sequence[float], y: str, at: str) -> Column:
    """Linear interpolation of the array column ``at`` on a fixed axis, ends clamped, as an array of the axis's length.

    ``at`` holds ascending positions, ``y`` their values; both stay in the JVM.
    """
    return F.expr(f"""transform(array({",".join(f"{v}D" for v in x)}), g ->
        case when g <= {at}[0] then {y}[0] when g >= element_at({at}, -1) then element_at({y}, -1)
        else aggregate(sequence(0, size({at}) - 2), cast(null as double), (acc, i) ->
            coalesce(acc, if(g >= {at}[i] and g < {at}[i + 1], {y}[i] + (g - {at}[i]) / ({at}[i + 1] - {at}[i]) * ({y}[i + 1] - {y}[i]), null))) end)""")


def clean(samples: DataFrame, by: str, low: float, high: float) -> DataFrame:
    """Points ``(by, x, y)`` that are finite and inside the window, without those far off the rolling median."""
    from tessera.operators.aggregates import finite
    from tessera.operators.windows import rolling_median_clean

    inside = samples.where(finite(F.col("x")) & finite(F.col("y")) & F.col("x").between(low, high))
    return rolling_median_clean(inside, by, ["x"], "y")
