"""Harvest gates, review queues, promotion decisions, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first check that fails, in order; null if none does."""
    out = F.when(checks[0][1], checks[0][0])
    for name, failed in checks[1:]:
        out = out.when(failed, name)
    return out


def harvest_reason(c: dict[str, Column], *, diagnostics: int = 0, editability: float = 0.0, fragmentation: float = 1.0, l1: float = 1.0, edge: float = 1.0) -> Column:
    """Why a run gives no labels. Missing values: editability 1, errors and penalties 0."""
    nvl = lambda x, v: F.coalesce(x, F.lit(v))
    return first_reason([
        ("too_many_run_diagnostics", nvl(c["diagnostics"], 0) > diagnostics),
        ("editability_score_too_low", nvl(c["editability"], 1.0) < editability),
        ("fragmentation_penalty_too_high", nvl(c["fragmentation"], 0.0) > fragmentation),
        ("raster_l1_error_too_high", nvl(c["l1"], 0.0) > l1),
        ("raster_edge_error_too_high", nvl(c["edge"], 0.0) > edge),
    ])


def review_queue(items: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """items with ordinal (from 1, per keys) and the decision pending."""
    return items.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("decision", F.lit("pending"))


def apply_review(queue: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """queue with the reviewers' decision (accept, reject, else pending) and corrected_kind over kind."""
    d = decisions.select(*keys, F.col("decision").alias("__d"), F.col("corrected_kind").alias("__k"))
    out = queue.drop("decision").join(d, [*keys], "left")
    decision = F.when(F.col("__d").isin("accept", "reject"), F.col("__d")).otherwise("pending")
    return out.withColumn("decision", decision).withColumn("kind", F.when(decision == "accept", F.coalesce("__k", "kind")).otherwise(F.col("kind"))).drop("__d", "__k")


def issue_counts(items: DataFrame, issues: str = "issues", *keys: str) -> DataFrame:
    return items.select(*keys, F.explode(issues).alias("issue")).groupBy(*keys, "issue").agg(F.count("*").alias("n"))


def promotion_decision(gates: DataFrame, *keys: str) -> DataFrame:
    """Per case: red and yellow failures and the state rejected > deferred > promoted; a case without a source is deferred."""
    failed = lambda s: F.count_if(~F.col("ok") & (F.col("severity") == s))
    out = gates.groupBy(*keys).agg(F.count("*").alias("gates"), failed("red").alias("red"), failed("yellow").alias("yellow"), F.max(F.col("gate_type") == "missing_source").alias("missing"))
    state = F.when(F.col("missing"), "deferred").when(F.col("red") > 0, "rejected").when(F.col("yellow") > 0, "deferred").otherwise("promoted")
    order = F.when(F.col("red") > 0, 0).when(F.col("yellow") > 0, 1).otherwise(2)
    return out.withColumn("state", state).withColumn("sort_key", order).drop("missing")


#: Fixed value: which state of an anchor wins over which.
STATE_ORDER = ("promoted", "rejected", "deferred", "fallback")


def anchor_state(states: DataFrame, *keys: str) -> DataFrame:
    """One state per anchor of its conflicting ones; an unknown state counts as fallback."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("state")), F.lit(0))
    rank = F.when(rank == 0, len(STATE_ORDER)).otherwise(rank)
    return states.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, STATE_ORDER)), F.min(rank).cast("int")).alias("state"))


def cumulative_minimum(expectations: DataFrame, *keys: str, selector: str, ordinal: str = "ord") -> DataFrame:
    """Repeated expectations of one selector add up: needed is the running sum of their least counts."""
    w = Window.partitionBy(*keys, selector).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return expectations.withColumn("needed", F.sum("min_count").over(w))


def check_counts(expected: DataFrame, actual: DataFrame, *on: str) -> DataFrame:
    """expected (on, needed, max_count) against actual (on, n): ok and the reason (shortfall, excess)."""
    out = expected.join(actual, [*on], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") < F.col("needed"), "shortfall").when(F.col("max_count").isNotNull() & (F.col("n") > F.col("max_count")), "excess")
    return out.withColumn("reason", reason).withColumn("ok", reason.isNull())


def region_gates(regions: DataFrame, anchors: DataFrame, iou: Column, *keys: str, min_iou: float = 0.1, min_count: int = 1) -> DataFrame:
    """Per region: how many anchors overlap it by min_iou, and whether that is enough. Both hold keys, on which they are joined."""
    hits = regions.join(anchors, [*keys]).groupBy(*keys, "region_id").agg(F.count_if(iou >= min_iou).alias("matched"), F.max(iou).alias("best_iou"))
    out = regions.select(*keys, "region_id").join(hits, [*keys, "region_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("ok", F.col("matched") >= min_count)
