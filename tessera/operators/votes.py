"""Votes: tallies in which a tie is undecided, adaptive rounds, and human overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(answers: DataFrame, item: str, category: str, confidence: str, decision: str | None = None) -> DataFrame:
    """``(item, votes, label, decision, split)`` per item; answers without a category do not count.

    Without a decision column the label is the most frequent category, null on a tie. With one, its majority decides
    (null on a tie, and then no label): the label is the commonest on the winning side, ties to the higher confidence,
    then the name. ``split`` says that there was no majority or not all agreed.
    """
    given = answers.where(F.col(category).isNotNull())
    if decision is None:
        counts = given.groupBy(item, category).agg(F.count("*").alias("n"))
        ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("n"), category))).withColumn(
            "runner_up", F.lead("n").over(Window.partitionBy(item).orderBy(F.desc("n"), category))
        ).withColumn("votes", F.sum("n").over(Window.partitionBy(item)))
        top = ranked.where("rn = 1")
        label = F.when(F.col("runner_up").isNull() | (F.col("runner_up") < F.col("n")), F.col(category))
        return top.select(
            item, "votes", label.alias("label"), F.lit(None).cast("boolean").alias("decision"),
            (label.isNull() | (F.col("n") < F.col("votes"))).alias("split")
        )
    known = given.where(F.col(decision).isNotNull()).select(item, category, confidence, F.col(decision).alias("_own"))
    sides = known.groupBy(item).agg(F.count("*").alias("votes"), F.count_if("_own").alias("yes"))
    sides = sides.withColumn("decision", F.when(2 * F.col("yes") > F.col("votes"), True).when(2 * F.col("yes") < F.col("votes"), False))
    counts = known.join(sides, item).where(F.col("_own") == F.col("decision")).groupBy(item, category).agg(
        F.count("*").alias("n"), F.max(confidence).alias("c")
    )
    best = counts.groupBy(item).agg(F.min_by(category, F.struct(-F.col("n"), -F.col("c"), F.col(category))).alias("label"))
    out = sides.join(best, item, "left")
    return out.select(item, "votes", "label", "decision", (F.col("decision").isNull() | ((F.col("yes") > 0) & (F.col("yes") < F.col("votes")))).alias("split"))


def keep_or_exclude(votes: DataFrame) -> DataFrame:
    """A split or missing decision keeps the region and asks a person; only an agreed exclusion excludes."""
    return votes.withColumn(
        "exclude", F.coalesce(F.col("decision") & ~F.col("split"), F.lit(False))
    ).withColumn("needs_human", F.col("split") | F.col("decision").isNull())


def adaptive_rounds(answers: DataFrame, item: str, order: Sequence[str], category: str, rounds: Sequence[int] = (1, 3, 5), confident: Column | None = None) -> DataFrame:
    """How many answers an item needs: after the first, if it is confident; else after the first round in which all
    agree or one category has more than half; all of the last round otherwise."""
    w = Window.partitionBy(item).orderBy(*order)
    n = F.row_number().over(w)
    # within a round's last answer: the count of each answer's own category so far is enough to know the largest
    numbered = answers.withColumn("n", n).where(F.col("n") <= rounds[-1])
    sure = confident if confident is not None else F.lit(False)
    states = None
    for size in rounds:
        part = numbered.where(F.col("n") <= size).groupBy(item, category).agg(
            F.count("*").alias("k"), F.max(F.when(F.col("n") == 1, sure)).alias("first_sure")
        )
        one = part.groupBy(item).agg(
            F.sum("k").alias("used"), F.max("k").alias("most"), F.max("first_sure").alias("first_sure"),
            F.min_by(category, F.struct(-F.col("k"), F.col(category))).alias("leader")
        )
        one = one.where(F.col("used") == size) if size > rounds[0] else one
        done = F.coalesce("first_sure", F.lit(False)) if size == rounds[0] else F.col("most") * 2 > F.col("used")
        one = one.select(item, F.lit(size).alias("round"), "used", "leader", (done | F.lit(size == rounds[-1])).alias("done"))
        states = one if states is None else states.unionByName(one)
    last = states.groupBy(item).agg(
        F.min(F.when(F.col("done"), F.struct("round", "used", "leader"))).alias("a"), F.max(F.struct("round", "used", "leader")).alias("b")
    )
    return last.select(item, F.coalesce("a.used", "b.used").alias("used"), F.coalesce("a.leader", "b.leader").alias("label"), F.col("a").isNotNull().alias("settled"))


def apply_overrides(verdicts: DataFrame, human: DataFrame, key: str, value: str) -> DataFrame:
    """A person's verdict overwrites the agent's, which is kept beside it; items without any are kept and flagged."""
    right = human.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = verdicts.withColumnRenamed(value, "agent_value").join(right, F.col(key) == F.col("_k"), "left")
    return out.withColumn(value, F.coalesce("_v", "agent_value")).withColumn(
        "overridden", F.coalesce(F.col("_v") != F.col("agent_value"), F.lit(False))
    ).withColumn("unmatched", F.col("_k").isNull()).drop("_k", "_v")


def plan_against_actual(plan: DataFrame, actual: DataFrame, key: Sequence[str], planned: str, done: str) -> DataFrame:
    """Where plan and doing differ: not done, not planned, or done otherwise."""
    a, b = plan.select(*key, planned), actual.select(*(F.col(k).alias(f"_{k}") for k in key), done)
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    out = a.join(b, cond, "full_outer")
    state = F.when(F.col(f"_{key[0]}").isNull(), "not done").when(F.col(key[0]).isNull(), "not planned").when(
        ~F.col(planned).eqNullSafe(F.col(done)), "differs"
    ).otherwise("as planned")
    return out.select(*(F.coalesce(k, f"_{k}").alias(k) for k in key), planned, done, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keyed replacement: new rows, and old ones whose key is not among them."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def audit_summary(windows: DataFrame, votes: int, flagged: Sequence[str], systematic: str) -> DataFrame:
    """One row over sampled windows ``(votes, kinds, verdict, confidence)``: how many were answered, flagged, split, of
    one mind about a systematic fault, and how many votes were lost. A lost vote is no dissent."""
    answered, flag = F.col("votes") > 0, F.col("verdict").isin(*flagged)
    out = windows.agg(
        F.count("*").alias("sampled"),
        F.count_if(answered).alias("answered"),
        F.count_if(flag).alias("flagged"),
        F.count_if(F.col("kinds") > 1).alias("split"),
        F.count_if((F.col("kinds") == 1) & (F.col("verdict") == systematic)).alias("unanimous_systematic"),
        F.sum(F.when(answered, votes - F.col("votes")).otherwise(0)).alias("lost_votes"),
        F.avg("confidence").alias("mean_confidence"),
    )
    return out.withColumn("flagged_frac", F.try_divide(F.col("flagged").cast("double"), F.col("answered")))


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Per role: calls, those answered from the store, failed and cut off, and the tokens of those that were made."""
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), *(F.count_if(c).alias(c) for c in ("cached", "failed", "truncated")),
        F.sum(F.when(~F.col("cached"), F.col("tokens")).otherwise(0)).alias("tokens")
    )
