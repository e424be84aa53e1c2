"""Column expressions: geometry, colour, diagnostics, quality metrics. All run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = tuple[Column, Column, Column, Column]


# geometry -----------------------------------------------------------------------------------------------------------


def point_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def wrapped_angle(angle: Column) -> Column:
    """The angle in (-pi, pi]."""
    turned = F.pmod(angle, F.lit(2 * math.pi))
    return F.when(turned > math.pi, turned - 2 * math.pi).otherwise(turned)


def arc_point(cx: Column, cy: Column, r: Column, angle: Column) -> Column:
    return F.struct((cx + r * F.cos(angle)).alias("x"), (cy + r * F.sin(angle)).alias("y"))


def signed_line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p from the line through a and b, positive on its left; from a if both are one point."""
    length = F.hypot(bx - ax, by - ay)
    return F.when(length > 0, ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / length).otherwise(F.hypot(px - ax, py - ay))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    squared = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), squared), F.lit(0.0))))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def bounds_area(b: Bounds) -> Column:
    """Continuous: width is max - min."""
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def bounds_intersection(a: Bounds, b: Bounds) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def bounds_iou(a: Bounds, b: Bounds) -> Column:
    inter = bounds_intersection(a, b)
    return F.coalesce(F.try_divide(inter, bounds_area(a) + bounds_area(b) - inter), F.lit(0.0))


def bounds_gap(a: Bounds, b: Bounds) -> Column:
    """Distance between two boxes; 0 if they touch or overlap."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.hypot(dx, dy)


def pixel_bounds_iou(a: Bounds, b: Bounds) -> Column:
    """Of inclusive integer bounds: width is max - min + 1."""
    one = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0))
    area = lambda x: one(x[0], x[2]) * one(x[1], x[3])
    inter = one(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * one(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    return F.coalesce(F.try_divide(inter.cast("double"), area(a) + area(b) - inter), F.lit(0.0))


# colour -------------------------------------------------------------------------------------------------------------


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def hex_to_rgb(text: Column) -> Column:
    """(r, g, b) of #rrggbb; anything else is black."""
    ok = F.coalesce(text.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))
    part = lambda i: F.when(ok, F.conv(F.substring(text, i, 2), 16, 10).cast("int")).otherwise(0)
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def color_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def is_neutral(r: Column, g: Column, b: Column, spread: int = 8) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) <= spread


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def over_background(channel: Column, alpha: Column, background: Column) -> Column:
    """A channel composited over an opaque background, rounded to an integer."""
    return F.floor((channel * alpha + background * (255 - alpha)) / 255 + F.lit(0.5)).cast("int")


# diagnostics --------------------------------------------------------------------------------------------------------

#: The canonical stages, and the codes that belong to a stage by name, by prefix or by suffix.
STAGES = ("preprocessing", "palette", "segmentation", "fitting", "cleanup", "scoring", "export", "runtime", "unknown")
STAGE_CODES = {
    "preprocessing": ("transparent_pixels_ignored", "partial_alpha_flattened", "image_resized_for_analysis"),
    "palette": ("palette_quantized",),
    "segmentation": ("color_mask_split_for_components", "component_deferred"),
    "runtime": ("timeout_reached",),
}
STAGE_PREFIXES = {"fitting": ("fit_",), "cleanup": ("cleanup_", "merge_"), "scoring": ("score_", "gate_"), "export": ("export_",)}
STAGE_SUFFIXES = {"fitting": ("_fit_failed",), "export": ("_export_failed",)}


def stage_of_code(code: Column) -> Column:
    code = F.lower(F.trim(code))
    out = None
    for stage in STAGES[:-1]:
        tests = [code.isin(*STAGE_CODES[stage])] if stage in STAGE_CODES else []
        tests += [code.startswith(p) for p in STAGE_PREFIXES.get(stage, ())] + [code.endswith(s) for s in STAGE_SUFFIXES.get(stage, ())]
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        out = F.when(test, stage) if out is None else out.when(test, stage)
    return out.otherwise("unknown")


def diagnostic_stage(stage: Column, code: Column) -> Column:
    """An explicit stage, normalised, wins over the code's."""
    named = F.replace(F.lower(F.trim(stage)), F.lit("-"), F.lit("_"))
    return F.when(stage.isNull(), stage_of_code(F.coalesce(code, F.lit("unknown")))).when(named.isin(*STAGES), named).otherwise("unknown")


# quality metrics ----------------------------------------------------------------------------------------------------


def _let(value: Column, fn) -> Column:
    """fn of value, with value computed once: a lambda's argument is not computed again where it is used."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def array_spread(values: Column) -> Column:
    """Population standard deviation of an array."""

    def spread(v: Column) -> Column:
        return _let(_mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))

    return _let(values, spread)


def variation(values: Column, empty: float = 0.0) -> Column:
    """Standard deviation over mean: empty for no values, 1 if the mean is not positive."""

    def ratio(v: Column) -> Column:
        return _let(F.when(F.size(v) > 0, _mean(v)), lambda m: F.when(F.size(v) <= 0, F.lit(empty)).when(m <= 0, F.lit(1.0)).otherwise(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)) / m))

    return _let(values, ratio)


def _pairs(points: Column) -> Column:
    """Each element with the next one."""
    return F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))


def line_smoothness_error(points: Column) -> Column:
    """Spread of the segments' slopes dy / length; 0 for fewer than three points or two segments."""
    slopes = F.transform(F.filter(_pairs(points), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]) > 0), lambda p: (p["b"]["y"] - p["a"]["y"]) / F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(_let(slopes, lambda v: F.when(F.size(v) < 2, F.lit(0.0)).otherwise(array_spread(v))))


def spacing_error(midpoints: Column) -> Column:
    """Variation of the distances between consecutive midpoints; 0 for fewer than two."""
    steps = F.transform(_pairs(midpoints), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))
    return F.when(F.size(midpoints) < 2, F.lit(0.0)).otherwise(variation(steps))


def roundness_error(samples: Column, cx: Column, cy: Column, r: Column) -> Column:
    distances = F.transform(samples, lambda p: F.hypot(p["x"] - cx, p["y"] - cy))
    return F.when(r <= 0, F.lit(1.0)).when(F.size(samples) <= 0, F.lit(0.0)).otherwise(array_spread(distances) / r)


def quad_corner_error(corners: Column) -> Column:
    """Variation of a quad's four edges, at most 1."""
    closed = F.concat(corners, F.slice(corners, 1, 1))
    edges = F.transform(_pairs(closed), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))
    return F.least(variation(edges), F.lit(1.0))


def quad_area(corners: Column) -> Column:
    closed = F.concat(corners, F.slice(corners, 1, 1))
    return F.abs(F.aggregate(F.transform(_pairs(closed), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]), F.lit(0.0), lambda a, x: a + x)) / 2


def quad_straightness_error(corners: Column) -> Column:
    return F.when(quad_area(corners) > 0, F.lit(0.0)).otherwise(1.0)


def perspective_error(quads: Column) -> Column:
    """quads: array of corner arrays. Variation of top width over bottom width; 0 for fewer than two usable quads."""
    ratio = lambda q: F.try_divide(F.hypot(q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]), F.hypot(q[2]["x"] - q[3]["x"], q[2]["y"] - q[3]["y"]))
    ratios = F.filter(F.transform(quads, ratio), lambda x: x.isNotNull())
    return _let(ratios, lambda v: F.when(F.size(v) < 2, F.lit(0.0)).otherwise(variation(v)))


def cutout_error(is_cutout: Column, smoothness: Column, width_variance: Column) -> Column:
    return F.when(is_cutout, (smoothness + width_variance) / 2).otherwise(0.0)


#: Metrics besides *_error that count as errors; the kinds of simple shapes and their bonuses.
ERROR_METRICS = ("stroke_width_variance", "classifier_prior_error")
ROUND_KINDS = ("circle", "stroke_circle")
SIMPLE_KINDS = ("ellipse", "stroke_ellipse", "stroke_path", "stroke_polyline", "rect", "rounded_rect", "arc", "quad", "perspective_grid")


def metric_error(metrics: Column, without: tuple[str, ...] = ()) -> Column:
    """Sum of the values of a metrics map that are errors by name."""
    kept = F.map_filter(metrics, lambda k, _: (k.endswith("_error") | k.isin(*ERROR_METRICS)) & ~k.isin(*without) if without else k.endswith("_error") | k.isin(*ERROR_METRICS))
    return F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + x)


def shape_bonus(kind: Column) -> Column:
    return F.when(kind.isin(*ROUND_KINDS), 0.35).when(kind.isin(*SIMPLE_KINDS), 0.25).otherwise(0.0)


def semantic_score(raster_error: Column, quality: Column, nodes: Column, parameters: Column, kind: Column, *, raster: float = 1.0, weight: float = 1.0, node: float = 0.015, parameter: float = 0.01, bonus: float = 1.0) -> Column:
    """Lower is better."""
    return raster * raster_error + weight * quality + node * nodes + parameter * parameters - bonus * shape_bonus(kind)


def orientation(dx: Column, dy: Column) -> Column:
    """Bucket of a stroke by its end points; null if they coincide."""
    return F.when((F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6), F.lit(None).cast("string")).when(F.abs(dx) >= 2 * F.abs(dy), "horizontal").when(F.abs(dy) >= 2 * F.abs(dx), "vertical").when(dx * dy >= 0, "diagonal_pos").otherwise("diagonal_neg")


def confidence(raster_error: Column, quality: Column, is_generic: Column) -> Column:
    raw = 1 - F.least(raster_error + 0.1 * quality, F.lit(1.0)) - F.when(is_generic, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


# curves -------------------------------------------------------------------------------------------------------------


def catmull_rom(points: Column, closed: bool = False) -> Column:
    """Cubic segments (start, c1, c2, end) through the points; tangents are a sixth of the neighbours' difference."""
    n = F.size(points)
    at = (lambda i: F.get(points, F.pmod(i, n))) if closed else (lambda i: F.get(points, F.greatest(F.lit(0), F.least(i, n - 1))))
    mix = lambda p, a, b, sign: F.struct(*[(p[k] + sign * (b[k] - a[k]) / 6).alias(k) for k in ("x", "y")])
    segment = lambda i: F.struct(at(i).alias("start"), mix(at(i), at(i - 1), at(i + 1), 1).alias("c1"), mix(at(i + 1), at(i), at(i + 2), -1).alias("c2"), at(i + 1).alias("end"))
    last = n - (1 if closed else 2)
    return F.when(last < 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), last), segment))


def cubic_samples(segment: Column, steps: int = 8) -> Column:
    """Points of a cubic at steps + 1 even parameters."""

    def point(i: Column) -> Column:
        t = i / steps
        weights = ((1 - t) * (1 - t) * (1 - t), 3 * (1 - t) * (1 - t) * t, 3 * (1 - t) * t * t, t * t * t)
        return F.struct(*[sum((w * segment[p][k] for w, p in zip(weights, ("start", "c1", "c2", "end"), strict=True)), F.lit(0.0)).alias(k) for k in ("x", "y")])

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def arc_samples(cx: Column, cy: Column, r: Column, start: Column, end: Column, steps: int = 16) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: arc_point(cx, cy, r, start + (end - start) * i / steps))


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point (x, y) in which the lines through a, b and c, d meet; null for parallel lines, and if a point is null."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    turn = ux * vy - uy * vx
    along = ((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx) / turn
    return F.when(F.abs(turn) >= 1e-9, F.struct((a["x"] + along * ux).alias("x"), (a["y"] + along * uy).alias("y")))


def drawn_bounds(kind: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of an anchor as it is drawn, from its columns path, ellipse, circle, stroke and quad: of the
    first of them, in this order, that is there and has points; zeros if none is. Outlined circles and ellipses are wider by
    half the mean of the stroke's width samples (1 without any), strokes on all sides, but those of two points with butt caps
    across only. Paths count by their points. Null points and samples are passed over."""
    samples = F.filter("stroke.width_samples", lambda w: w.isNotNull())
    half = F.when(F.size(samples) > 0, F.aggregate(samples, F.lit(0.0), lambda total, w: total + w) / F.size(samples)).otherwise(1.0) / 2
    rim = lambda outlined: F.when(kind == outlined, half).otherwise(0.0)

    def box(x0: Column, y0: Column, x1: Column, y1: Column, dx: Column, dy: Column) -> Column:
        return F.struct((x0 - dx).alias("min_x"), (y0 - dy).alias("min_y"), (x1 + dx).alias("max_x"), (y1 + dy).alias("max_y"))

    def around(points: Column, dx: Column, dy: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), dx, dy)

    zero = F.lit(0.0)
    line, corners, path = (F.filter(c, lambda p: p.isNotNull()) for c in ("stroke.centerline", "quad.corners", "path.points"))
    ends = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    wide, high = F.abs(ends[1]["x"] - ends[0]["x"]), F.abs(ends[1]["y"] - ends[0]["y"])
    length = F.sqrt(wide * wide + high * high)
    flat = (F.col("stroke.cap_style") == "butt") & (F.size(line) == 2) & (length > 0)
    turn = F.coalesce("ellipse.rotation", zero)
    rx, ry = F.col("ellipse.rx") + rim("stroke_ellipse"), F.col("ellipse.ry") + rim("stroke_ellipse")
    reach = lambda a, b: F.sqrt(F.pow(rx * a, F.lit(2.0)) + F.pow(ry * b, F.lit(2.0)))
    r = F.col("circle.r") + rim("stroke_circle")
    centre = lambda c: tuple(F.col(f"{c}.{k}") for k in ("cx", "cy", "cx", "cy"))
    return (
        F.when(F.size(path) > 0, around(path, zero, zero))
        .when(F.col("ellipse").isNotNull(), box(*centre("ellipse"), reach(F.cos(turn), F.sin(turn)), reach(F.sin(turn), F.cos(turn))))
        .when(F.col("circle").isNotNull(), box(*centre("circle"), r, r))
        .when(F.size(line) > 0, around(line, F.when(flat, half * high / length).otherwise(half), F.when(flat, half * wide / length).otherwise(half)))
        .when(F.size(corners) > 0, around(corners, zero, zero))
        .otherwise(box(zero, zero, zero, zero, zero, zero))
    )
