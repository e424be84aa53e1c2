"""Segment proposals, classifier features of anchors, quality cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators.scene import cluster_axis

#: The classifier's features in order, and the group kinds of the last ones.
GROUP_KINDS = ("perspective_grid", "parallel_stroke_group", "same_color_fragment_group", "text_like_fragment_group", "primitive_anchor_reservation")
FEATURE_NAMES = (
    "node_count", "parameter_count", "has_circle", "circle_radius", "has_stroke", "stroke_width", "stroke_length", "has_quad", "quad_width", "quad_height", "quad_subtype_code", "group_count",
    "in_perspective_grid", "in_parallel_stroke_group", "in_same_color_fragment_group", "in_text_like_fragment_group", "in_primitive_anchor_reservation",
)


def anchor_features(anchors: DataFrame, groups: str = "group_kinds") -> DataFrame:
    """anchors (as in scenes.explode_anchors, with an array of the kinds of their groups) with features, one array in the order of FEATURE_NAMES."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    has = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    widths, line, corners = F.col("stroke.width_samples"), F.col("stroke.centerline"), F.col("quad.corners")
    mean_width = F.when(F.size(widths) > 0, F.aggregate(widths, F.lit(0.0), lambda a, x: a + x) / F.size(widths))
    first, last = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    length = F.when(F.size(line) >= 2, F.hypot(last["x"] - first["x"], last["y"] - first["y"]))
    side = lambda k: F.when(F.size(corners) == 4, F.array_max(F.transform(corners, lambda p: p[k])) - F.array_min(F.transform(corners, lambda p: p[k])))
    kinds = F.coalesce(F.col(groups), F.array().cast("array<string>"))
    return anchors.withColumn("features", F.array(
        number(F.col("node_count")), number(F.col("parameter_count")), has("circle"), number(F.col("circle.r")), has("stroke"), number(mean_width), number(length), has("quad"), number(side("x")), number(side("y")),
        number(F.try_element_at("metrics", F.lit("quad_subtype_code"))), F.size(kinds).cast("double"), *[F.array_contains(kinds, k).cast("double") for k in GROUP_KINDS],
    ))


def gate_proposals(proposals: DataFrame, most_error: float | None = None, need_reserved: bool = False) -> DataFrame:
    """Pending proposals become accepted or rejected, with anchor_quality_error and the reason; others stay as they are.

    proposals: area-capped status, downstream_status, anchor_kind, anchor_metrics (map), anchor_reserved.
    """
    error = S.metric_error(F.col("anchor_metrics"))
    missing = F.col("anchor_kind").isNull() | F.col("anchor_metrics").isNull()
    checks = [("missing_anchor_summary", missing)]
    if most_error is not None:
        checks.append(("anchor_quality_error_too_high", error > most_error))
    if need_reserved:
        checks.append(("anchor_not_reserved", ~F.coalesce("anchor_reserved", F.lit(False))))
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    pending = F.col("downstream_status") == "pending"
    out = proposals.withColumn("__reason", F.when(pending, F.coalesce(reason, F.lit("geometry_gate_passed")))).withColumn("anchor_quality_error", F.when(pending & ~missing, error))
    status = F.when(F.col("__reason").isNull(), F.col("downstream_status")).when(F.col("__reason") == "geometry_gate_passed", "accepted").otherwise("rejected")
    return out.withColumn("downstream_status", status).withColumnRenamed("__reason", "downstream_decision_reason")


def initial_status(area: Column, most_area: int | None) -> Column:
    """(status, downstream_status): too large proposals are deferred, and rejected downstream."""
    late = F.lit(False) if most_area is None else area > most_area
    return F.struct(F.when(late, "deferred").otherwise("proposed").alias("status"), F.when(late, "rejected").otherwise("pending").alias("downstream_status"))


def tile_grid(tiles: DataFrame, *keys: str, least: int = 4, occupancy: float = 0.6, share: float = 0.75) -> DataFrame:
    """Groups of rectangular tiles (keys, x, y, w, h) that fill a grid: at least `least` tiles in two rows and columns, with the occupancy.

    Rows and columns are clusters of centres by running mean, within share of the mean tile (at least 2).
    """
    size = Window.partitionBy(*keys)
    t = tiles.withColumns({"tx": F.greatest(F.lit(2.0), F.avg("w").over(size) * share), "ty": F.greatest(F.lit(2.0), F.avg("h").over(size) * share)})
    count = t.groupBy(*keys).agg(F.count("*").alias("tiles"), F.first("tx").alias("tx"), F.first("ty").alias("ty")).filter(F.col("tiles") >= least)
    scaled = t.join(count.select(*keys), [*keys], "left_semi").select(*keys, (F.col("x") / F.col("tx")).alias("x"), (F.col("y") / F.col("ty")).alias("y"))
    lines = lambda axis, name: cluster_axis(scaled.select(*keys, axis), *keys, value=axis, tolerance=1.0).groupBy(*keys).agg((F.max("cluster") + 1).alias(name))
    out = count.join(lines("y", "rows"), [*keys]).join(lines("x", "columns"), [*keys])
    filled = F.col("tiles") / (F.col("rows") * F.col("columns"))
    return out.withColumn("occupancy", filled).filter((F.col("rows") >= 2) & (F.col("columns") >= 2) & (filled >= occupancy)).select(*keys, "tiles", "rows", "columns", "occupancy")


def case_failures(cases: DataFrame) -> DataFrame:
    """Every failure of a quality case, not only the first: (case_id, category, metric). Missing errors count as 1.

    cases: case_id, size_match, the three raster errors and their max_ thresholds, fallback_count, allow_cubic_path, bbox_iou, min_bbox_iou.
    """
    over = lambda m: F.when(F.coalesce(m, F.lit(1.0)) > F.col(f"max_{m}"), F.struct(F.lit("visual_drift").alias("category"), F.lit(m).alias("metric")))
    found = [
        F.when((F.col("fallback_count") > 0) & ~F.col("allow_cubic_path"), F.struct(F.lit("fallback_path").alias("category"), F.lit("kind").alias("metric"))),
        F.when(~F.coalesce("size_match", F.lit(False)), F.struct(F.lit("visual_drift").alias("category"), F.lit("size").alias("metric"))),
        *[over(m) for m in ("raster_l1_error", "raster_edge_error", "raster_alpha_error")],
        F.when(F.coalesce("bbox_iou", F.lit(0.0)) < F.col("min_bbox_iou"), F.struct(F.lit("geometry_drift").alias("category"), F.lit("bbox_iou").alias("metric"))),
    ]
    return cases.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("case_id", "f.*")
