"""Scene operators over anchors (run_id, anchor_index, kind, color, ...): layers, palettes, metrics, merges, groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators.gates import BOUNDS, over_cells


def value_counts(df: DataFrame, *keys: str, value: str | Column, name: str = "value") -> DataFrame:
    """Counts per value, null as the string None."""
    column = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, F.coalesce(column.cast("string"), F.lit("None")).alias(name)).agg(F.count("*").alias("n"))


def layer_index(anchors: DataFrame, layer: Column, *keys: str) -> DataFrame:
    """Per layer: its anchors' indexes in order, and their count."""
    return anchors.groupBy(*keys, layer.alias("layer")).agg(F.sort_array(F.collect_list("anchor_index")).alias("anchor_indexes"), F.count("*").alias("anchor_count"))


def palette_summary(anchors: DataFrame, *keys: str) -> DataFrame:
    """Per colour and kind: anchors, and the colour's total; null colours are left out."""
    counts = anchors.filter(F.col("color").isNotNull()).groupBy(*keys, "color", "kind").agg(F.count("*").alias("kind_count"))
    return counts.withColumn("color_count", F.sum("kind_count").over(Window.partitionBy(*keys, "color")))


def fragmentation(anchors: DataFrame, *keys: str) -> DataFrame:
    """Extra anchors per colour over all anchors, at most 0.5."""
    per_color = anchors.groupBy(*keys, "color").agg(F.count("*").alias("n"))
    extra = F.sum(F.when(F.col("color").isNotNull(), F.col("n") - 1).otherwise(0))
    return per_color.groupBy(*keys).agg(F.sum("n").alias("anchors"), extra.alias("extra")).withColumn("fragmentation_penalty", F.least(F.coalesce(F.try_divide("extra", "anchors"), F.lit(0.0)), F.lit(0.5)))


#: Fixed value: kinds that are not editable primitives.
GENERIC_KINDS = ("cubic_path",)


def scene_metrics(anchors: DataFrame, warnings: DataFrame | None = None, *keys: str) -> DataFrame:
    """Per scene: anchor counts, structured share, mean and largest raster error, parameters, fragmentation, and the
    editability score: share - fragmentation - 0.05 per warning (at most 0.5) - 0.04 per generic anchor (at most 0.4), in 0 to 1."""
    generic = F.col("kind").isin(*GENERIC_KINDS)
    one = anchors.groupBy(*keys).agg(F.count("*").alias("anchor_count"), F.count_if(generic).alias("generic_count"), F.count_if(~generic).alias("structured_count"), F.avg("raster_error").alias("mean_raster_error"), F.max("raster_error").alias("max_raster_error"), F.sum("parameter_count").alias("parameters"))
    out = one.join(fragmentation(anchors, *keys).select(*keys, "fragmentation_penalty"), [*keys])
    if warnings is not None:
        out = out.join(warnings.groupBy(*keys).agg(F.count("*").alias("warning_count")), [*keys], "left")
    out = out.withColumn("warning_count", F.coalesce(F.col("warning_count"), F.lit(0)) if warnings is not None else F.lit(0))
    share = F.col("structured_count") / F.col("anchor_count")
    score = share - F.col("fragmentation_penalty") - F.least(0.05 * F.col("warning_count"), F.lit(0.5)) - F.least(0.04 * F.col("generic_count"), F.lit(0.4))
    return out.withColumn("structured_share", share).withColumn("editability_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def economy_score(value: Column, scale: float) -> Column:
    """1 - value / scale in 0 to 1; a missing value counts as 1."""
    return F.when(value.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - value / scale)))


def metric_summary(anchors: DataFrame, *keys: str, metrics: str = "metrics") -> DataFrame:
    """Per metric of the map column: count, mean, max."""
    return anchors.select(*keys, F.explode(metrics).alias("metric", "value")).groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))


def merge_plan(anchors: DataFrame, *keys: str, allowed: float = 0.55) -> DataFrame:
    """Per group of same-coloured fragments (at least two): union bounds, areas, fill ratio, whether they may merge."""
    b = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    out = anchors.groupBy(*keys).agg(F.count("*").alias("fragments"), *[F.min(c).alias(c) for c in ("min_x", "min_y")], *[F.max(c).alias(c) for c in ("max_x", "max_y")], F.sum(S.bounds_area(b)).alias("fragment_area")).filter("fragments > 1")
    out = out.withColumn("combined_area", S.bounds_area(b))
    ratio = F.when(F.col("combined_area") > 0, F.least(F.col("fragment_area") / F.col("combined_area"), F.lit(1.0))).otherwise(0.0)
    return out.withColumn("fill_ratio", ratio).withColumn("auto_merge_allowed", F.col("fill_ratio") >= allowed)


def merge_exact_rects(rects: DataFrame, *keys: str, tolerance: float = 1e-6) -> DataFrame:
    """Same-coloured rectangles whose areas add up to that of their union's bounds become one; all others stay. Distinct rectangles
    that do not overlap tile it then; overlaps that make up for a hole are not told apart."""
    b = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    plan = merge_plan(rects, *keys, allowed=0.0).filter(F.abs(F.col("fragment_area") - F.col("combined_area")) <= tolerance)
    merged = plan.select(*keys, "min_x", "min_y", "max_x", "max_y", F.col("fragments").alias("merged_from"))
    rest = rects.join(plan.select(*keys), [*keys], "left_anti").select(*keys, *b, F.lit(1).cast("long").alias("merged_from"))
    return merged.unionByName(rest)


def first_of_each(df: DataFrame, key: Column, *keys: str, ordinal: str = "anchor_index") -> DataFrame:
    """Keeps the first row per equivalence key; a null key is its own, and such rows are spread by their ordinal, not sorted in one task."""
    keyed = df.withColumn("__key", key)
    w = Window.partitionBy(*keys, "__key", F.when(F.col("__key").isNull(), F.col(ordinal))).orderBy(ordinal)
    return keyed.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | F.col("__key").isNull()).drop("__key", "__n")


def parallel_groups(strokes: DataFrame, *keys: str) -> DataFrame:
    """strokes: (keys, anchor_index, color, x0, y0, x1, y1). Groups of two or more of one colour and orientation, with the
    variation of the distances between consecutive midpoints."""
    bucket = S.orientation(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    s = strokes.withColumns({"orientation": bucket, "mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2}).filter("orientation is not null")
    w = Window.partitionBy(*keys, "color", "orientation").orderBy("anchor_index")
    s = s.withColumn("step", F.hypot(F.col("mx") - F.lag("mx").over(w), F.col("my") - F.lag("my").over(w)))
    out = s.groupBy(*keys, "color", "orientation").agg(F.count("*").alias("members"), F.avg("step").alias("mean_step"), F.stddev_pop("step").alias("spread")).filter("members >= 2")
    error = F.when(F.col("mean_step") <= 0, 1.0).otherwise(F.col("spread") / F.col("mean_step"))
    return out.withColumn("parallel_spacing_error", error).drop("mean_step", "spread")


def contact_pairs(anchors: DataFrame, *keys: str, gap: float = 1.0, cell: float = 64.0) -> DataFrame:
    """Pairs i < j of different colours whose boxes overlap or are at most gap apart.

    Boxes, grown by gap, are spread over a grid; only boxes of one cell meet, and a pair counts in the cell that holds the
    lower corner of their overlap, so no pair comes twice and no cross product is formed.
    """
    cols = ("min_x", "min_y", "max_x", "max_y")
    at = lambda v, pad: F.floor((v + pad) / cell)
    g = anchors.select(*keys, "anchor_index", "color", *cols).filter(F.col("color").isNotNull())
    g = g.withColumn("cell_x", F.explode(F.sequence(at(F.col("min_x"), -gap), at(F.col("max_x"), gap)))).withColumn("cell_y", F.explode(F.sequence(at(F.col("min_y"), -gap), at(F.col("max_y"), gap))))
    on = [*keys, "cell_x", "cell_y"]
    b = g.select(*on, *[F.col(c).alias(f"{c}_2") for c in ("anchor_index", "color", *cols)])
    first, second = tuple(F.col(c) for c in cols), tuple(F.col(f"{c}_2") for c in cols)
    pairs = g.join(b, on).filter((F.col("anchor_index") < F.col("anchor_index_2")) & (F.col("color") != F.col("color_2")))
    owner = (F.col("cell_x") == at(F.greatest(first[0], second[0]), -gap)) & (F.col("cell_y") == at(F.greatest(first[1], second[1]), -gap))
    inter, apart = S.bounds_intersection(first, second), S.bounds_gap(first, second)
    near = pairs.filter(owner & ((apart <= gap) | (inter > 0)))
    return near.select(*keys, "anchor_index", "anchor_index_2", F.when(inter > 0, "overlapping").otherwise("touching").alias("relation"), apart.alias("bounds_gap"), S.bounds_iou(first, second).alias("bounds_iou"))


def _occluders(plan: DataFrame, anchors: DataFrame, *keys: str, cell: float = 64.0) -> DataFrame:
    """plan (keys, color, bounds, ...) with the anchors of other colours whose boxes (o_ bounds) overlap its box; found by grid cell."""
    theirs = tuple(f"o_{c}" for c in BOUNDS)
    other = anchors.select(*keys, F.col("color").alias("other_color"), *[F.col(c).alias(f"o_{c}") for c in BOUNDS])
    met = over_cells(plan, BOUNDS, cell).join(over_cells(other, theirs, cell), [*keys, "cell_x", "cell_y"])
    owner = (F.col("cell_x") == F.floor(F.greatest(BOUNDS[0], theirs[0]) / cell)) & (F.col("cell_y") == F.floor(F.greatest(BOUNDS[1], theirs[1]) / cell))
    inter = S.bounds_intersection(tuple(F.col(c) for c in BOUNDS), tuple(F.col(c) for c in theirs))
    return met.filter(owner & (F.col("color") != F.col("other_color"))).withColumn("cover", inter).filter("cover > 0").drop("cell_x", "cell_y")


def occluded_groups(anchors: DataFrame, *keys: str) -> DataFrame:
    """Mergeable same-colour fragments with anchors of another colour over their union: fragment and occluder counts, hidden area."""
    plan = merge_plan(anchors, *keys, "color").filter(F.col("auto_merge_allowed") & (F.col("fragment_area") < F.col("combined_area")))
    over = _occluders(plan, anchors, *keys)
    return over.groupBy(*keys, "color").agg(F.first("fragments").alias("fragments"), F.count("*").alias("occluders"), F.first(F.col("combined_area") - F.col("fragment_area")).alias("hidden_area"))


def text_like_groups(fragments: DataFrame, *keys: str, least: int = 20, generic: int = 8, fill: float = 0.25, aspect: float = 4.0) -> DataFrame:
    """Groups of many small fragments along a line: count, generic count, fill of the union box and its aspect pass the limits."""
    b = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    g = fragments.groupBy(*keys).agg(F.count("*").alias("fragments"), F.count_if(F.col("kind").isin(*GENERIC_KINDS)).alias("generic"), F.sum(S.bounds_area(b)).alias("area"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return g.filter((F.col("fragments") >= least) & (F.col("generic") >= generic) & (F.coalesce(F.try_divide("area", w * h), F.lit(0.0)) <= fill) & (F.coalesce(F.try_divide(w, h), F.lit(0.0)) >= aspect))


def cluster_axis(df: DataFrame, *keys: str, value: str, tolerance: float) -> DataFrame:
    """value with cluster (from 0): sorted values join the last cluster while within tolerance of its running mean.

    The mean drifts, so this is a fold, not gaps and islands; a group's distinct values are what is folded.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out = group.sort_values(value).reset_index(drop=True)
        number, mean, n, numbers = -1, 0.0, 0, []
        for v, times in out[[value, "n"]].itertuples(index=False):
            for _ in range(int(times)):
                if n and abs(v - mean) <= tolerance:
                    mean, n = mean + (v - mean) / (n + 1), n + 1
                else:
                    number, mean, n = number + 1, float(v), 1
            numbers.append(number)
        out["cluster"] = numbers
        return out[[*keys, value, "n", "cluster"]]

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in counts.columns)
    return counts.groupBy(*keys).applyInPandas(fold, f"{kinds}, cluster int")


def group_context(anchors: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Each anchor with the groups that hold its index and its position there; groups: (keys, group_id, group_kind, anchor_indexes)."""
    members = groups.select(*keys, "group_id", "group_kind", F.posexplode("anchor_indexes").alias("anchor_position", "anchor_index"))
    return anchors.join(members, [*keys, "anchor_index"])


def circular_smoothing(df: DataFrame, *keys: str, value: str, ordinal: str, size: int, window: int = 2, pinned: Column | None = None) -> DataFrame:
    """Centred moving average around a closed row of size values; pinned rows keep theirs."""
    raw = df.select(*keys, F.col(ordinal).alias("__o"), F.col(value).alias("__v"), (F.lit(False) if pinned is None else pinned).alias("__p"))
    wrapped = raw.withColumn("__shift", F.explode(F.array(*[F.lit(s) for s in (-size, 0, size)]))).withColumn("__o", F.col("__o") + F.col("__shift")).filter((F.col("__o") >= -window) & (F.col("__o") < size + window))
    w = Window.partitionBy(*keys).orderBy("__o").rowsBetween(-window, window)
    out = wrapped.withColumn("smoothed", F.when(F.col("__p"), F.col("__v")).otherwise(F.avg("__v").over(w))).filter(F.col("__shift") == 0)
    return out.select(*keys, F.col("__o").alias(ordinal), F.col("__v").alias(value), "smoothed")


def promote_occluded(anchors: DataFrame, *keys: str, covered: float = 0.6, box_share: float = 0.04) -> DataFrame:
    """Mergeable same-colour rectangular fragments become one rectangle if what hides the rest of it is there: anchors of other
    colours that cover at least `covered` of the hidden area, or `box_share` of the box if nothing is hidden.

    Returns (keys, color, fragments, hidden_area, cover_area, promoted) per group of fragments; cover areas of several occluders add up.
    """
    rects = anchors.groupBy(*keys, "color").agg(F.min(F.col("kind").isin("rect", "quad")).alias("__rects"))
    plan = merge_plan(anchors, *keys, "color").filter("auto_merge_allowed").join(rects, [*keys, "color"]).filter("__rects")
    over = _occluders(plan, anchors, *keys)
    out = over.groupBy(*keys, "color").agg(F.first("fragments").alias("fragments"), F.first("combined_area").alias("__box"), F.first(F.greatest(F.col("combined_area") - F.col("fragment_area"), F.lit(0.0))).alias("hidden_area"), F.sum("cover").alias("cover_area"))
    enough = F.when(F.col("hidden_area") > 0, F.col("cover_area") >= covered * F.col("hidden_area")).otherwise(F.col("cover_area") >= box_share * F.col("__box"))
    return out.select(*keys, "color", "fragments", "hidden_area", "cover_area", enough.alias("promoted"))
