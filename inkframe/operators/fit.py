"""Closed-form fits per component as aggregates, candidate scoring and the best-candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S


def kasa_circle(points: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares circle per group from eight power sums: cx, cy, r; null if the points lie on a line."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    zz = px * px + py * py
    sums = points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(px).alias("sx"), F.sum(py).alias("sy"), F.sum(px * px).alias("sxx"), F.sum(py * py).alias("syy"), F.sum(px * py).alias("sxy"), F.sum(px * zz).alias("sxz"), F.sum(py * zz).alias("syz"))
    return circle_of_sums(sums).select(*keys, "n", "cx", "cy", "r")


def circle_of_sums(sums: DataFrame) -> DataFrame:
    """sums (n, sx, sy, sxx, syy, sxy, sxz, syz) with the least-squares circle: cx, cy, r."""
    n, sx, sy, sxx, syy, sxy, sxz, syz = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "sxz", "syz"))
    sz = sxx + syy
    # moments about the mean make the normal equations 2 x 2
    a, b, c = n * sxx - sx * sx, n * sxy - sx * sy, n * syy - sy * sy
    d, e = (n * sxz - sx * sz) / 2, (n * syz - sy * sz) / 2
    det = a * c - b * b
    out = sums.withColumn("cx", F.when(F.abs(det) > 1e-9, F.try_divide(d * c - b * e, det))).withColumn("cy", F.when(F.abs(det) > 1e-9, F.try_divide(a * e - b * d, det)))
    cx, cy = F.col("cx"), F.col("cy")
    return out.withColumn("r", F.sqrt((sz - 2 * cx * sx - 2 * cy * sy) / n + cx * cx + cy * cy))


def circle_residual(points: DataFrame, circles: DataFrame, *keys: str) -> DataFrame:
    """Mean and largest distance of the points from their circle, over its radius."""
    d = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))
    return points.join(circles.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg((F.avg(d) / F.first("r")).alias("mean_residual"), (F.max(d) / F.first("r")).alias("max_residual"))


def principal_axis(points: DataFrame, *keys: str) -> DataFrame:
    """Centre, unit axis of the largest variance, and the extents along and across it: two aggregates."""
    center = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "x").alias("sxx"), F.covar_pop("y", "y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    angle = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    axes = center.withColumn("angle", angle).withColumns({"ax": F.cos("angle"), "ay": F.sin("angle")})
    along = (F.col("x") - F.col("cx")) * F.col("ax") + (F.col("y") - F.col("cy")) * F.col("ay")
    across = (F.col("y") - F.col("cy")) * F.col("ax") - (F.col("x") - F.col("cx")) * F.col("ay")
    extent = points.join(axes.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg((F.max(along) - F.min(along)).alias("length"), (F.max(across) - F.min(across)).alias("width"))
    return axes.join(extent.hint("shuffle_hash"), [*keys]).select(*keys, "n", "cx", "cy", "ax", "ay", "length", "width")


#: The detectors' thresholds.
RECT_FILL, ROUNDED_FILL, DISC_ASPECT, DISC_AREA, RING_INNER, RING_AREA, STROKE_RATIO, STROKE_LENGTH, QUAD_FILL, QUAD_ERROR = 0.08, 0.30, 0.22, 0.35, 0.25, 0.45, 3.0, 4.0, 0.35, 0.28
FALLBACK_PENALTY, FALLBACK_NODES = 0.35, 16


def rect_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Bounds and fill_error (the share of the box that is not ink) per group."""
    box = pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    size = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return box.withColumn("fill_error", 1 - F.col("area") / size)


def extreme_quad(pixels: DataFrame, *keys: str) -> DataFrame:
    """The four extreme corners by x + y and x - y, ties by explicit order, with the shoelace area; null corners if fewer than four are distinct."""
    p = F.struct("x", "y")
    far = lambda value, *ties: F.min_by(p, F.struct(value, *ties))
    x, y = F.col("x"), F.col("y")
    q = pixels.groupBy(*keys).agg(far((x + y).alias("k"), y.alias("t")).alias("p0"), far((y - x).alias("k"), y.alias("t")).alias("p1"), far((-x - y).alias("k"), (-y).alias("t")).alias("p2"), far((x - y).alias("k"), (-y).alias("t")).alias("p3"), F.count("*").alias("area"))
    corners = F.array("p0", "p1", "p2", "p3")
    doubled = F.transform(corners, lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y")))
    q = q.withColumn("corners", F.when(F.size(F.array_distinct(corners)) == 4, doubled))
    return q.select(*keys, "area", "corners", S.quad_area(F.col("corners")).alias("quad_area"), S.quad_corner_error(F.col("corners")).alias("corner_error"))


def candidates(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, kind, raster_error, node_count, parameter_count): for each component, the primitives whose gates it passes
    and the generic path, which always stands, in a fixed order."""
    box = rect_fit(pixels, *keys)
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    area = F.col("area").cast("double")
    longer, shorter = F.greatest(w, h), F.least(w, h)
    aspect = 1 - shorter / longer
    r = (w + h) / 4.0
    disc = F.abs(area - F.lit(3.141592653589793) * r * r) / (F.lit(3.141592653589793) * r * r)
    oval = F.abs(area - F.lit(0.7853981633974483) * w * h) / (F.lit(0.7853981633974483) * w * h)
    fill = F.col("fill_error")
    rows = [
        (0, "circle", (longer >= 3) & (aspect <= DISC_ASPECT) & (disc <= DISC_AREA), disc, 1, 3),
        (1, "ellipse", (shorter >= 3) & (oval <= DISC_AREA), oval, 1, 4),
        (2, "stroke_polyline", (longer >= STROKE_LENGTH) & (longer >= STROKE_RATIO * shorter), fill, 2, 5),
        (3, "rect", fill <= RECT_FILL, fill, 4, 4),
        (4, "rounded_rect", (fill > 0) & (fill <= ROUNDED_FILL) & (shorter >= 3), fill, 4, 5),
        (5, "cubic_path", F.lit(True), F.lit(FALLBACK_PENALTY), FALLBACK_NODES, 2 * FALLBACK_NODES),
    ]
    each = [F.when(ok, F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.round(error, 9).alias("raster_error"), F.lit(nodes).alias("node_count"), F.lit(parameters).alias("parameter_count"))) for i, kind, ok, error, nodes, parameters in rows]
    return box.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("c")).select(*keys, "c.*")


def choose_best(scored: DataFrame, *keys: str, score: str = "score", ordinal: str = "ord") -> DataFrame:
    """The row of the least score per group; of equal ones, the first. An aggregate: no sort of a group, and partial in each task."""
    row = F.struct(*[c for c in scored.columns if c not in keys])
    best = scored.groupBy(*keys).agg(F.min_by(row, F.struct(score, ordinal)).alias("__b"))
    return best.select(*keys, "__b.*")


def with_semantic_score(df: DataFrame, quality: Column | None = None) -> DataFrame:
    return df.withColumn("score", S.semantic_score(F.col("raster_error"), F.lit(0.0) if quality is None else quality, F.col("node_count"), F.col("parameter_count"), F.col("kind")))


def with_classifier_prior(scored: DataFrame, predictions: DataFrame, *keys: str, penalty: float = 0.35) -> DataFrame:
    """Adds the penalty to candidates whose kind is not the predicted label; without a prediction nothing changes."""
    joined = scored.join(predictions.select(*keys, F.col("label").alias("__label")), [*keys], "left")
    prior = F.when(F.col("__label").isNull() | (F.col("__label") == F.col("kind")), 0.0).otherwise(penalty)
    return joined.withColumn("classifier_prior_error", prior).withColumn("score", F.col("score") + prior).drop("__label")


def top_k(df: DataFrame, *keys: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group by order, with rank from 1; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: The ring's largest aspect, the arc's least and largest span in radians and its densest box.
RING_ASPECT, ARC_LEAST, ARC_MOST, ARC_DENSITY = 0.18, 0.3, 5.9, 0.55


def ring_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Ring about the centroid per group: radius, width, area error, and whether the ring's gates hold."""
    box = pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    far = pixels.join(box.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg((F.max(d) + 0.5).alias("outer"), F.greatest(F.min(d) - 0.5, F.lit(0.0)).alias("inner"))
    full = F.lit(3.141592653589793) * (F.col("outer") * F.col("outer") - F.col("inner") * F.col("inner"))
    out = box.join(far.hint("shuffle_hash"), [*keys]).withColumn("area_error", F.abs(F.col("area") - full) / full)
    aspect = 1 - F.least("w", "h") / F.greatest("w", "h")
    ok = (F.greatest("w", "h") >= 6) & (aspect <= RING_ASPECT) & (F.col("inner") / F.col("outer") >= RING_INNER) & (F.col("area_error") <= RING_AREA)
    return out.select(*keys, "cx", "cy", ((F.col("inner") + F.col("outer")) / 2).alias("r"), (F.col("outer") - F.col("inner")).alias("width"), "area_error", ok.alias("is_ring"))


def arc_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Least-squares circle with the arc's span: the full turn less the widest gap between the pixels' angles."""
    circle = kasa_circle(pixels, *keys).filter("r > 0")
    at = pixels.join(circle.hint("shuffle_hash"), [*keys]).select(*keys, "cx", "cy", "r", "x", "y", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")).alias("a"))
    turn = 6.283185307179586
    w = Window.partitionBy(*keys).orderBy("a")
    step = at.withColumn("gap", F.col("a") - F.lag("a").over(w))
    g = step.groupBy(*keys).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("r").alias("r"), F.count("*").alias("n"), F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(turn) - (F.max("a") - F.min("a"))).alias("gap"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("box"))
    span, density = F.lit(turn) - F.col("gap"), F.col("n") / F.col("box")
    return g.select(*keys, "cx", "cy", "r", span.alias("span"), density.alias("density"), ((density <= ARC_DENSITY) & (span >= ARC_LEAST) & (span <= ARC_MOST)).alias("is_arc"))


def stroke_profile(pixels: DataFrame, *keys: str) -> DataFrame:
    """A stroke read column by column: mean width, its variation, and the bow of the centreline from its chord over its length."""
    columns = pixels.groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count("*").alias("width"))
    ends = columns.groupBy(*keys).agg(F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    off = F.abs(F.col("y") - (F.col("y0") + F.coalesce(F.try_divide((F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")), F.col("x1") - F.col("x0")), F.lit(0.0))))
    length = F.greatest(F.hypot(F.first("x1") - F.first("x0"), F.first("y1") - F.first("y0")), F.lit(1.0))
    return columns.join(ends.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg(F.avg("width").alias("mean_width"), (F.stddev_pop("width") / F.avg("width")).alias("stroke_width_variance"), (F.max(off) / length).alias("bow"))
