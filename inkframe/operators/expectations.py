"""What a scene is expected to hold: shapes by kind and place, groups, and metrics within limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.gates import BOUNDS, region_matches


def _has_area() -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in BOUNDS)
    return F.coalesce((x0 < x1) & (y0 < y1), F.lit(False))


def _shape_counts(expectations: DataFrame, anchors: DataFrame, groups: DataFrame, keys: tuple[str, ...], cell: float) -> DataFrame:
    """(keys, expectation_id, hits) in rows that add up; anchors and groups are counted per kind before they meet expectations."""
    ident = [*keys, "expectation_id"]
    shapes = expectations.filter(F.col("metric").isNull() & F.col("kinds").isNotNull()).withColumn("boxed", _has_area())
    placed = F.col("boxed") & (F.coalesce("min_iou", F.lit(0.0)) > 0)
    per_kind = anchors.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.count_if(_has_area()).alias("n_boxed"))
    anywhere = shapes.filter(~placed).select(*ident, "boxed", F.explode(F.array_distinct("kinds")).alias("kind")).join(per_kind, [*keys, "kind"])
    anywhere = anywhere.select(*ident, F.when(F.col("boxed"), F.col("n_boxed")).otherwise(F.col("n")).alias("hits"))
    regions = shapes.filter(placed).select(*keys, F.col("expectation_id").alias("region_id"), *BOUNDS, F.col("kinds").alias("expected_kinds"), F.lit(None).cast("array<string>").alias("forbidden_kinds"), "min_iou", F.lit(None).cast("double").alias("min_coverage"))
    there = region_matches(regions, anchors, *keys, cell=cell).filter(F.array_contains("expected_kinds", F.col("kind")))
    there = there.select(*keys, F.col("region_id").alias("expectation_id"), F.lit(1).cast("long").alias("hits"))
    per_group = groups.groupBy(*keys, F.col("kind").alias("group_kind")).agg(F.count("*").alias("hits"))
    grouped = expectations.filter(F.col("metric").isNull() & F.col("kinds").isNull()).select(*ident, "group_kind").join(per_group, [*keys, "group_kind"])
    return anywhere.unionByName(there).unionByName(grouped.select(*ident, "hits"))


def expectation_results(expectations: DataFrame, anchors: DataFrame, groups: DataFrame, metrics: DataFrame, *keys: str, cell: float = 64.0) -> DataFrame:
    """expectations with actual_value, actual_count, required, ok, reason, and how far off they are (missing_count, excess_count, shortfall, excess).

    expectations: (keys, expectation_id, ord, metric, min_value, max_value, kinds, group_kind, bounds, min_iou, min_count,
    max_count), one row per id; anchors: (keys, kind, bounds); groups: (keys, kind); metrics: (keys, name, value), one row per
    name. An expectation with a metric is of that metric, with kinds of anchors, otherwise of groups. Bounds without an area count as none, and
    then every anchor of the kinds matches; with bounds, anchors without an area do not, the others by min_iou (null: 0). A null
    min_count is 1. Expectations of anchors or groups that ask for the same add up in the order of ord: each needs the sum of the least
    counts so far. A null limit does not hold; a metric that is missing or null fails. Empty tables give no rows or no matches.
    """
    ident = [*keys, "expectation_id"]
    hits = _shape_counts(expectations, anchors, groups, keys, cell).withColumn("actual_value", F.lit(None).cast("double"))
    # the expectations of metrics find their values by their ids alone, so that whole rows are joined once
    values = metrics.select(*keys, F.col("name").alias("metric"), F.lit(None).cast("long").alias("hits"), F.col("value").cast("double").alias("actual_value"))
    measured = expectations.filter("metric is not null").select(*ident, "metric").join(values, [*keys, "metric"]).drop("metric")
    actual = hits.unionByName(measured).groupBy(*ident).agg(F.sum("hits").alias("actual_count"), F.max("actual_value").alias("actual_value"))
    # what the arrays and boxes are needed for is settled before rows are shuffled: callers that do not read them carry neither further
    told = expectations.withColumns({"__metric": F.col("metric").isNotNull(), "__grouped": F.col("kinds").isNull(), "__kinds": F.array_sort(F.array_distinct("kinds")), "__group": F.when(F.col("kinds").isNull(), F.col("group_kind")), "__box": F.when(_has_area(), F.struct(*BOUNDS)), "__iou": F.coalesce("min_iou", F.lit(0.0))})
    is_metric = F.col("__metric")
    alike = Window.partitionBy(*keys, "__metric", "__kinds", "__group", "__box", "__iou").orderBy("ord", "expectation_id").rowsBetween(Window.unboundedPreceding, 0)
    least = F.coalesce("min_count", F.lit(1)).cast("long")
    out = told.withColumn("required", F.when(~is_metric, F.sum(least).over(alike))).drop("__kinds", "__group", "__box", "__iou")
    out = out.join(actual, ident, "left").withColumn("actual_count", F.when(~is_metric, F.coalesce("actual_count", F.lit(0))))
    value, n, needed = F.col("actual_value"), F.col("actual_count"), F.col("required")
    low, high = value < F.col("min_value"), value > F.col("max_value")
    few, many = n < needed, n > F.col("max_count")
    of_metric = F.when(value.isNull(), "missing_metric").when(low, "metric_below_min").when(high, "metric_above_max")
    too_few = F.when(F.col("__grouped"), "insufficient_groups").when(needed > least, "insufficient_distinct_anchors").otherwise("insufficient_anchors")
    too_many = F.when((F.col("max_count") == 0) & (least == 0), "forbidden_matches").otherwise("too_many_matches")
    reason = F.when(is_metric, of_metric).otherwise(F.when(few, too_few).when(many, too_many))
    return out.withColumns({
        "reason": reason, "ok": reason.isNull(), "missing_count": F.when(few, needed - n), "excess_count": F.when(many & ~few, n - F.col("max_count")),
        "shortfall": F.when(low, F.col("min_value") - value), "excess": F.when(high & ~F.coalesce(low, F.lit(False)), value - F.col("max_value")),
    }).drop("__metric", "__grouped")
