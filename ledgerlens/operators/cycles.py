"""Cycle yields, low-yield streaks, saturation, backlog, health and feedback scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.values import age_days, bounded_score, capped, ratio


def newest(events: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest rows of each group, with their rank ``rn`` (a partial top-k runs before the shuffle)."""
    window = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def family_counts(families: dict[str, DataFrame], event: str = "event_key", state: str = "review_state", accepted: Sequence[str] = tuple(vocab.ESTABLISHED), reviewable: Sequence[str] = tuple(vocab.SATURATION_REVIEWABLE)) -> DataFrame:
    """One row per event: a count for each family, and accepted and reviewable totals.

    All families are one union of narrow rows that one aggregation counts, map-side first.
    """
    rows = reduce(DataFrame.unionByName, (df.select(F.col(event).alias("event_key"), F.col(state).alias("state"), F.lit(name).alias("family")) for name, df in families.items()))
    counts = [F.count_if(F.col("family") == name).alias(name) for name in families]
    return rows.groupBy("event_key").agg(*counts, F.count_if(F.col("state").isin(*accepted)).alias("accepted_record"), F.count_if(F.col("state").isin(*reviewable)).alias("reviewable_record"))


def useful_yield(counts: DataFrame, families: Sequence[str], weights: dict[str, float] | None = None) -> Column:
    weights = weights or vocab.FAMILY_WEIGHTS
    names = [*families, "accepted_record", "reviewable_record"]
    return F.round(reduce(lambda a, b: a + b, (F.lit(float(weights[n])) * F.col(n) for n in names)), 4)


def low_yield(accepted: Column, reviewable: Column, useful: Column, mode: str = "mixed", min_accepted: int = 1, min_reviewable: int = 1, min_useful: float = 1.0) -> Column:
    """Whether a cycle brought too little, by the policy's mode."""
    few_accepted, few_reviewable = accepted < min_accepted, reviewable < min_reviewable
    if mode == "accepted_only":
        return few_accepted
    if mode == "reviewable_yield":
        return few_reviewable
    return few_accepted & few_reviewable & (useful < min_useful)


def streaks(ranked: DataFrame, by: Sequence[str], low: str = "low_yield", rank: str = "rn") -> DataFrame:
    """Per group: cycles, low cycles, and the run of low cycles from the newest on."""
    first_good = F.min(F.when(~F.col(low), F.col(rank)))
    return ranked.groupBy(*by).agg(F.count("*").alias("cycles"), F.count_if(low).alias("low_cycles"), F.coalesce(first_good - 1, F.count("*")).cast("long").alias("streak"))


def saturation(groups: DataFrame, lookback: int = 3, max_streak: int = 2, backlog_limit: int = 25, action: str = "deprioritize") -> DataFrame:
    """State, scheduler action and reasons from cycles, streak and backlog.

    With too few cycles a group is in bootstrap, and its backlog is shown only if it has no cycle at all.
    """
    enough = F.col("cycles") >= lookback
    tired = enough & (F.col("streak") >= max_streak)
    pressed = enough & (F.col("backlog") >= backlog_limit)
    reasons = F.array_compact(
        F.array(F.when(~enough, "insufficient_history"), F.when(pressed, "review_backlog_pressure"), F.when(tired, "consecutive_low_yield"), F.when(enough & ~tired, "recent_useful_yield"))
    )
    state = F.when(~enough, "active_bootstrap").when(tired, "cooldown" if action == "cooldown" else "saturated").otherwise("active")
    return groups.select(
        *[c for c in groups.columns if c != "backlog"],
        F.when(enough | (F.col("cycles") == 0), F.col("backlog")).otherwise(0).alias("backlog"),
        state.alias("state"),
        F.when(tired, action).otherwise("run").alias("scheduler_action"),
        F.array_join(reasons, ",").alias("reason_codes"),
    )


def pending_ages(rows: DataFrame, now: Column, then: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: pending rows, least age, median and 90th percentile in days.

    The percentile is the row of rank round((n - 1) * 0.9) + 1.  Rows are first
    counted by whole days, which are few; the days that hold the wanted ranks
    are found there, and only their rows are sorted, so neither a whole table
    nor a whole group meets in one task.
    """
    group = [*by, "day"]
    aged = rows.select(*by, age_days(now, F.col(then)).alias("age")).withColumn("day", F.floor("age"))
    days = aged.groupBy(*group).agg(F.count("*").alias("n"), F.min("age").alias("least"))
    until = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("upto", F.sum("n").over(until)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    total = F.col("total")
    ranks = F.array(F.floor((total + 1) / 2), F.floor((total + 2) / 2), F.floor((total - 1) * 0.9 + 0.5) + 1)
    wanted = days.select(*group, "upto", "n", F.posexplode(ranks).alias("which", "rank")).filter((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
    wanted = wanted.select(*group, "which", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("nth"))
    near = aged.join(wanted.select(*group).distinct(), group, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("age")))
    found = wanted.join(near, [*group, "nth"])
    at = lambda which: F.min(F.when(F.col("which") == which, F.col("age")))
    picked = found.groupBy(*by).agg(((at(0) + at(1)) / 2).alias("median_age_days"), at(2).alias("p90_age_days"))
    heads = days.groupBy(*by).agg(F.max("total").alias("pending"), F.min("least").alias("least_age_days"))
    return heads.join(picked, list(by)) if by else heads.crossJoin(picked)  # one row each


def yield_trend(cycles: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """rising, flat or declining: the sign of the mean step, which is last less first."""
    ends = cycles.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    step = F.col("last") - F.col("first")
    return ends.select(*by, F.when(F.col("n") < 2, "insufficient_data").when(step > 0, "rising").when(step < 0, "declining").otherwise("flat").alias("trend"))


def contradiction_rates(total: Column, unresolved: Column, cycles: Column, claims: Column) -> list[Column]:
    return [total.alias("contradictions"), unresolved.alias("unresolved"), ratio(total, cycles).alias("per_cycle"), ratio(total, claims).alias("per_claim")]


FACET_SIGNALS = ["productive_runs", "zero_yield_runs", "open_leads", "works", "claims", "entities", "relationships", "successful_extractions", "failed_extractions"]


def facet_scores(signals: DataFrame, facet_order: Sequence[str], no_history: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """Score and rank of each facet from its signals (``FACET_SIGNALS``, distinct_runs, last_run_zero)."""
    w = weights or vocab.SCORING_WEIGHTS
    cap = lambda name: capped(F.col(name), 5)
    place = F.array_position(F.array(*map(F.lit, facet_order)), F.col("facet"))
    tired = F.col("last_run_zero") & (F.col("productive_runs") == 0) & (F.col("open_leads") == 0)
    score = (
        w["productive_run"] * cap("productive_runs")
        + w["open_lead"] * cap("open_leads")
        + w["work_yield"] * cap("works")
        + w["claim_yield"] * cap("claims")
        + w["entity_yield"] * cap("entities")
        + w["relationship_yield"] * cap("relationships")
        + w["successful_extraction"] * cap("successful_extractions")
        - w["failed_extraction_penalty"] * cap("failed_extractions")
        - w["zero_yield_penalty"] * cap("zero_yield_runs")
        - F.when(tired, w["recent_low_yield_penalty"]).otherwise(0.0)
        + 0.25 * F.least(F.greatest(F.col("distinct_runs") - 1, F.lit(0)), F.lit(4))
    )
    if no_history:
        score = score + w["bootstrap_bias"] * (len(facet_order) - place + 1)
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(no_history), "bootstrap_no_prior_productivity"),
            F.when(F.col("productive_runs") > 0, "productive_history"),
            F.when(F.col("open_leads") > 0, "open_lead_yield"),
            F.when(F.col("zero_yield_runs") > 0, "repeated_zero_yield"),
            F.when(tired, "recent_low_yield_penalty"),
        )
    )
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("fallback_facet"))).otherwise(reasons)
    scored = signals.filter(F.col("facet").isin(*facet_order)).select("facet", bounded_score(score).alias("score"), F.array_join(reasons, ",").alias("reason_codes"), place.alias("place"))
    # a row for each enabled facet: the one partition of this window has a fixed bound
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "place", "facet"))).drop("place")


def lead_score(base: float, successes: Column, failures: Column, claims: Column, entities: Column, runs: Column, weights: dict[str, float] | None = None) -> Column:
    """The linear score of a source lead; every signal is capped at three."""
    w = weights or vocab.SCORING_WEIGHTS
    return bounded_score(
        base
        + w["successful_extraction"] * capped(successes, 3)
        - w["failed_extraction_penalty"] * capped(failures, 3)
        + w["claim_yield"] * capped(claims, 3)
        + w["entity_yield"] * capped(entities, 3)
        + 0.25 * F.least(F.greatest(runs - 1, F.lit(0)), F.lit(4))
    )


def deferred(ranked: DataFrame, keep: int, rank: str = "rank") -> DataFrame:
    """The rows past the limit with why they wait and whether they come again."""
    cut = F.col(rank) > keep
    reason = F.when(F.col("streak") >= 2, "repeated_low_yield").when(cut, "rank_below_limit")
    return ranked.filter(cut).withColumn("reason_code", reason).withColumn("retryable", reason != "repeated_low_yield")
