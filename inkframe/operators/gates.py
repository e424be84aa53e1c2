"""Gates over regions and groups of a scene, regressions against a baseline, and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S

BOUNDS = ("min_x", "min_y", "max_x", "max_y")
#: The least IoU of an anchor and a region without a coverage limit; how far a component score may fall.
LEAST_REGION_IOU, MOST_REGRESSION = 0.1, 0.05
#: Fixed value: the review decisions that accept or refuse a reviewed run.
ACCEPTING, REFUSING = ("accepted", "corrected"), ("rejected", "deferred")


def over_cells(df: DataFrame, box: tuple[str, ...], cell: float) -> DataFrame:
    """A row per cell (cell_x, cell_y) of a grid that the box of a row reaches into."""
    at = lambda c: F.floor(F.col(c) / cell)
    return df.withColumn("cell_x", F.explode(F.sequence(at(box[0]), at(box[2])))).withColumn("cell_y", F.explode(F.sequence(at(box[1]), at(box[3]))))


def _valid_box() -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in BOUNDS)
    return F.coalesce((x0 <= x1) & (y0 <= y1), F.lit(False))


def region_matches(regions: DataFrame, anchors: DataFrame, *keys: str, carry: tuple[str, ...] = (), cell: float = 64.0) -> DataFrame:
    """(keys, region_id, expected_kinds, forbidden_kinds, kind, iou, carry): the anchors that each region selects, as in region_checks()."""
    r, a = tuple(F.col(c) for c in BOUNDS), tuple(F.col(f"a_{c}") for c in BOUNDS)
    mine = over_cells(regions.filter(_valid_box()).select(*keys, "region_id", *BOUNDS, "expected_kinds", "forbidden_kinds", "min_iou", "min_coverage"), BOUNDS, cell)
    other = over_cells(anchors.filter(_valid_box()).select(*keys, "kind", *carry, *[F.col(c).alias(f"a_{c}") for c in BOUNDS]), tuple(f"a_{c}" for c in BOUNDS), cell)
    owner = (F.col("cell_x") == F.floor(F.greatest(r[0], a[0]) / cell)) & (F.col("cell_y") == F.floor(F.greatest(r[1], a[1]) / cell))
    iou, inter = S.bounds_iou(r, a), S.bounds_intersection(r, a)
    least = F.coalesce("min_iou", F.when(F.col("min_coverage").isNull(), LEAST_REGION_IOU).otherwise(0.0))
    covered = F.col("min_coverage").isNull() | (F.coalesce(F.try_divide(inter, S.bounds_area(a)), F.lit(0.0)) >= F.col("min_coverage"))
    # named, as Spark takes boxes in cells for no larger than the rows they come from and would send them through the driver
    met = mine.join(other.hint("merge"), [*keys, "cell_x", "cell_y"]).filter(owner & (inter > 0) & (iou >= least) & covered)
    return met.select(*keys, "region_id", "expected_kinds", "forbidden_kinds", "kind", iou.alias("iou"), *carry)


def region_checks(regions: DataFrame, anchors: DataFrame, *keys: str, cell: float = 64.0) -> DataFrame:
    """regions with selected, matching and forbidden anchor counts, best_iou, ok and reason.

    regions: (keys, region_id, bounds, expected_kinds, forbidden_kinds, min_iou, min_coverage, min_count, max_count); anchors:
    (keys, kind, bounds). An anchor is selected if its box overlaps the region's by min_iou and by min_coverage of its own
    area (null: no limit; min_iou null: 0.1, or 0 with a coverage). No expected kinds: all match. Bounds that are null or turned around
    select nothing; a null min_count is 1. Regions and anchors meet in the cells of a grid, a pair counts in the cell of its overlap's lower corner.
    """
    met, valid = region_matches(regions, anchors, *keys, cell=cell), _valid_box()
    fits = (F.coalesce(F.size("expected_kinds"), F.lit(0)) <= 0) | F.array_contains("expected_kinds", F.col("kind"))
    bad = F.coalesce(F.array_contains("forbidden_kinds", F.col("kind")), F.lit(False))
    hits = met.groupBy(*keys, "region_id").agg(F.count("*").alias("selected"), F.count_if(fits).alias("matching"), F.count_if(bad).alias("forbidden"), F.max("iou").alias("best_iou"))
    out = regions.join(hits, [*keys, "region_id"], "left").fillna(0, ["selected", "matching", "forbidden"])
    few, many = F.col("matching") < F.coalesce("min_count", F.lit(1)), F.coalesce(F.col("matching") > F.col("max_count"), F.lit(False))
    text = lambda sign, limit: F.concat(F.lit("matching anchors in region: "), F.col("matching").cast("string"), F.lit(sign), F.coalesce(limit, F.lit(1)).cast("string"))
    reason = F.when(~valid, "region bounds are invalid").when(F.col("forbidden") > 0, F.concat(F.lit("forbidden anchors in region: "), F.col("forbidden").cast("string"))).when(few, text(" < ", "min_count")).when(many, text(" > ", "max_count")).otherwise("passed")
    return out.withColumn("reason", reason).withColumn("ok", reason == "passed")


#: The kinds that are closed whatever they say, and each limit of a region's topology with what it is held against.
CLOSED_KINDS = ("circle", "ellipse", "rect", "rounded_rect", "quad", "stroke_circle")
TOPOLOGY_LIMITS = (
    ("min_closed_anchors", "closed_anchor_count"), ("max_closed_anchors", "closed_anchor_count"), ("min_open_anchors", "open_anchor_count"), ("max_open_anchors", "open_anchor_count"),
    ("max_hole_count", "hole_count"), ("max_cutout_count", "cutout_count"), ("min_nested_contours", "nested_contour_count"), ("max_nested_contours", "nested_contour_count"), ("max_disconnected_components", "disconnected_component_count"),
)


def region_topology(regions: DataFrame, anchors: DataFrame, *keys: str, cell: float = 64.0) -> DataFrame:
    """regions with the contour counts of the anchors that they select, descriptors, and topology_failures in the limits' order.

    anchors: as in region_checks(), with closed (null: open, unless the kind is always closed), hole_count (null or below 0: none) and
    has_cutout. Limits that regions do not have as columns, or that are null, hold. required_descriptors and forbidden_descriptors
    are lists of descriptors; null lists ask for nothing.
    """
    met = region_matches(regions, anchors, *keys, carry=("closed", "hole_count", "has_cutout"), cell=cell)
    shut = F.col("kind").isin(*CLOSED_KINDS) | F.coalesce("closed", F.lit(False))
    holes, cut = F.greatest(F.coalesce(F.col("hole_count").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")), F.coalesce("has_cutout", F.lit(False))
    n = met.groupBy(*keys, "region_id").agg(F.count("*").alias("selected_anchor_count"), F.count_if(F.coalesce(shut, F.lit(False))).alias("closed_anchor_count"), F.sum(holes).alias("hole_count"), F.count_if(cut).alias("cutout_count"))
    counts = ("selected_anchor_count", "closed_anchor_count", "hole_count", "cutout_count")
    out = regions.join(n, [*keys, "region_id"], "left").fillna(0, [*counts])
    out = out.withColumns({"open_anchor_count": F.col("selected_anchor_count") - F.col("closed_anchor_count"), "disconnected_component_count": F.col("selected_anchor_count"), "nested_contour_count": F.col("hole_count") + F.col("cutout_count")})
    all_of, some = F.col("selected_anchor_count"), lambda c: F.col(c) > 0
    form = F.when(all_of == 0, "empty").when(F.col("closed_anchor_count") == all_of, "closed").when(F.col("closed_anchor_count") == 0, "open").otherwise("mixed_open_closed")
    parts = F.when(all_of > 1, "multi_component").when(all_of == 1, "single_component")
    descriptors = F.array_compact(F.array(form, parts, F.when(some("hole_count"), "holes"), F.when(some("cutout_count"), "cutouts"), F.when(some("nested_contour_count"), "nested_contours")))
    out = out.withColumn("descriptors", descriptors)

    def limit(name: str, count: str) -> Column:
        sign = "<" if name.startswith("min") else ">"
        broken = F.col(count) < F.col(name) if sign == "<" else F.col(count) > F.col(name)
        return F.when(broken, F.concat(F.lit(f"{count} "), F.col(count).cast("string"), F.lit(f" {sign} "), F.col(name).cast("string")))

    failures = F.array_compact(F.array(*[limit(name, count) for name, count in TOPOLOGY_LIMITS if name in regions.columns], F.lit(None).cast("string")))

    def said(name: str, text: str, held: Column) -> Column:
        wrong = F.filter(name, lambda x: F.array_contains("descriptors", x) == held)
        return F.coalesce(F.transform(wrong, lambda x: F.concat(F.lit(f"{text} topology descriptor: "), x)), F.array().cast("array<string>"))

    for name, text, held in (("required_descriptors", "missing", F.lit(False)), ("forbidden_descriptors", "forbidden", F.lit(True))):
        if name in regions.columns:
            failures = F.concat(failures, said(name, text, held))
    return out.withColumn("topology_failures", failures)


def region_results(regions: DataFrame, anchors: DataFrame, *keys: str, visual_failures: DataFrame | None = None, cell: float = 64.0) -> DataFrame:
    """region_checks() with topology, and with the failures (keys, region_id, visual_failures) of regions' rasters: what a region fails by its
    anchors comes first, then its topology, then its raster."""
    checked = region_checks(regions, anchors, *keys, cell=cell)
    more = region_topology(regions, anchors, *keys, cell=cell).select(*keys, "region_id", "descriptors", "topology_failures", "closed_anchor_count", "open_anchor_count", "hole_count", "cutout_count", "nested_contour_count")
    out = checked.join(more, [*keys, "region_id"])
    visual = F.lit(None).cast("array<string>")
    if visual_failures is not None:
        out, visual = out.join(visual_failures, [*keys, "region_id"], "left"), F.col("visual_failures")
    first = F.col("reason") == "passed"
    reason = F.when(first & (F.size("topology_failures") > 0), F.concat(F.lit("topology constraints failed: "), F.array_join("topology_failures", ", "))).when(first & (F.coalesce(F.size(visual), F.lit(0)) > 0), F.concat(F.lit("region visual thresholds failed: "), F.array_join(visual, ", "))).otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason") == "passed")


def group_checks(gates: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """gates (keys, gate_id, kinds, min_count, max_count, min_members, max_members) with selected, best_members and failures, in order.

    groups: (keys, kind, members). A gate without kinds selects all groups; null limits do not hold. Groups are counted per kind
    before they meet the gates.
    """
    per_kind = groups.groupBy(*keys, "kind").agg(F.count("*").alias("__n"), F.max("members").alias("__most"))
    chosen = (F.coalesce(F.size("kinds"), F.lit(0)) <= 0) | F.array_contains("kinds", F.col("kind"))
    hits = gates.select(*keys, "gate_id", "kinds").join(per_kind, [*keys]).filter(chosen).groupBy(*keys, "gate_id").agg(F.sum("__n").alias("selected"), F.max("__most").alias("best_members"))
    out = gates.join(hits, [*keys, "gate_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("selected", "best_members")})
    short = lambda c, limit, name: F.when(F.col(c) < F.col(limit), F.concat(F.lit(f"{name} "), F.col(c).cast("string"), F.lit(" < "), F.col(limit).cast("string")))
    over = lambda c, limit, name: F.when(F.col(c) > F.col(limit), F.concat(F.lit(f"{name} "), F.col(c).cast("string"), F.lit(" > "), F.col(limit).cast("string")))
    checks = [short("selected", "min_count", "group_count"), over("selected", "max_count", "group_count"), short("best_members", "min_members", "best_member_count"), over("best_members", "max_members", "worst_member_count")]
    return out.withColumn("failures", F.array_compact(F.array(*checks))).withColumn("ok", F.size("failures") == 0)


def review_status(decision: Column) -> Column:
    """(ok, reason) of a run's applied review; null: none was applied."""
    reason = F.when(decision.isNull(), "missing_applied_review").when(decision.isin(*ACCEPTING), "accepted_applied_review").when(decision.isin(*REFUSING), "applied_review_not_accepted").otherwise("invalid_applied_review_decision")
    return F.struct((reason == "accepted_applied_review").alias("ok"), reason.alias("reason"))


def component_regressions(current: DataFrame, baseline: DataFrame, key: str, most: float = MOST_REGRESSION) -> DataFrame:
    """Per case of current (key, component, score): compared components, those that fell by more than most, and the status.

    Statuses: missing_baseline_case, missing_baseline_scores (all null), missing_comparable_scores, failed, passed.
    """
    base = baseline.select(key, "component", F.col("score").alias("base"))
    cases = baseline.groupBy(key).agg(F.count("score").alias("scores"))
    delta = F.round(F.col("score") - F.col("base"), 6)
    met = current.join(base, [key, "component"], "left").withColumn("delta", delta)
    out = met.groupBy(key).agg(F.count("delta").alias("compared"), F.sort_array(F.collect_list(F.when(F.col("delta") < -most, F.col("component")))).alias("regressed"), F.min("delta").alias("worst_delta"))
    status = F.when(F.col("scores").isNull(), "missing_baseline_case").when(F.col("scores") == 0, "missing_baseline_scores").when(F.col("compared") == 0, "missing_comparable_scores").when(F.size("regressed") > 0, "failed").otherwise("passed")
    return out.join(cases, key, "left").withColumn("status", status).drop("scores")


def region_deltas(before: DataFrame, after: DataFrame, fields: list[str], item: str = "item_id", region: str = "region_id") -> DataFrame:
    """(item, region, status, changed_fields) of regions added, removed or changed in the items that both sides have."""
    both = before.select(item).distinct().join(after.select(item).distinct(), item)
    side = lambda df, p: df.select(item, region, F.struct(*fields).alias(p))
    met = side(before, "b").join(side(after, "a"), [item, region], "full").join(both, item, "left_semi")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return met.select(item, region, status.alias("status"), changed.alias("changed_fields")).filter((F.col("status") != "changed") | (F.size("changed_fields") > 0))


def match_summary(matches: DataFrame, *keys: str, score: str = "bbox_iou") -> DataFrame:
    """Per keys: matches and their mean, least and largest overlap; missing overlaps count as 0."""
    value = F.coalesce(score, F.lit(0.0))
    return matches.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean_iou"), F.min(value).alias("min_iou"), F.max(value).alias("max_iou"))


def transition_counts(matches: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """How often 'before -> after' occurs; null and empty values are n/a."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("n/a"))
    return matches.groupBy(*keys, F.concat(name(before), F.lit(" -> "), name(after)).alias("transition")).agg(F.count("*").alias("n"))


def accuracy_deltas(baseline: DataFrame, augmented: DataFrame, label: str = "label") -> DataFrame:
    """(label, baseline, augmented, delta, outcome) for the labels of either side (label, accuracy)."""
    met = baseline.select(label, F.col("accuracy").alias("baseline")).join(augmented.select(label, F.col("accuracy").alias("augmented")), label, "full")
    delta = F.col("augmented") - F.col("baseline")
    return met.withColumn("delta", delta).withColumn("outcome", F.when(delta.isNull(), "insufficient").when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("held"))


def passing_cases(cases: DataFrame, preferred: DataFrame, *keys: str, limit: int, ordinal: str = "ord") -> DataFrame:
    """Per keys, up to limit cases that are ok: those of preferred (keys, case_id, place) first, by place, then by ordinal. The limit is what is asked for."""
    out = cases.filter("ok").join(preferred.select(*keys, "case_id", "place"), [*keys, "case_id"], "left")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("place"), ordinal))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("place")


def family_summary(cases: DataFrame, *keys: str, case: str = "case_id", family: str = "family") -> DataFrame:
    """Cases, passed and failed ones per family; a case without a family is its own."""
    own = F.coalesce(F.col(family), F.col(case).cast("string")).alias("family")
    failed = F.count_if(~F.coalesce("ok", F.lit(False)))
    return cases.groupBy(*keys, own).agg(F.count("*").alias("cases"), (F.count("*") - failed).alias("passed"), failed.alias("failed"), (failed == 0).alias("ok"))


def readiness(templates: DataFrame, case: str = "case_id") -> DataFrame:
    """One row over decision templates (case, missing_fields): cases and templates in all, ready, and in need of evidence."""
    ready = F.coalesce(F.size("missing_fields"), F.lit(0)) <= 0
    per_case = templates.groupBy(case).agg(F.count("*").alias("t"), F.count_if(ready).alias("r"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    got = per_case.agg(F.count("*").alias("cases"), F.count_if(F.col("r") > 0).alias("ready_cases"), n("t").alias("templates"), n("r").alias("ready_templates"))
    return got.withColumn("waiting_cases", F.col("cases") - F.col("ready_cases")).withColumn("waiting_templates", F.col("templates") - F.col("ready_templates"))


def missing_fields(templates: DataFrame) -> DataFrame:
    return templates.select(F.explode("missing_fields").alias("field")).filter("field <> ''").groupBy("field").agg(F.count("*").alias("n"))


def axis_clusters(values: Column, tolerance: Column) -> Column:
    """How many clusters sorted values make: one joins the last cluster while within tolerance of its centre, which then moves halfway to it."""
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("n"))
    near = lambda s, v: F.coalesce(F.abs(v - s["at"]) <= tolerance, F.lit(False))
    step = lambda s, v: F.struct(F.when(near(s, v), (s["at"] + v) / 2).otherwise(v).alias("at"), F.when(near(s, v), s["n"]).otherwise(s["n"] + 1).alias("n"))
    return F.aggregate(F.array_sort(values), start, step, lambda s: s["n"])


def quad_grid_summary(quads: DataFrame, *keys: str, share: float = 0.6) -> DataFrame:
    """Rows and columns that the quads (keys, center_x, center_y, width, height) of a group make. Centres within share of the mean size,
    1 at least, are of one row or column. A group is one grid; its centres are folded in one array."""
    g = quads.groupBy(*keys).agg(F.count("*").alias("quads"), F.collect_list("center_x").alias("xs"), F.collect_list("center_y").alias("ys"), F.avg("width").alias("w"), F.avg("height").alias("h"))
    limit = lambda c: F.greatest(F.lit(1.0), F.col(c) * share)
    return g.select(*keys, "quads", axis_clusters(F.col("ys"), limit("h")).alias("row_count"), axis_clusters(F.col("xs"), limit("w")).alias("column_count"))


def vanishing_points(quads: DataFrame, *keys: str) -> DataFrame:
    """(keys, horizontal, vertical): where the upper and lower edges of each quad meet, and its left and right edges; null for
    parallel ones. corners go round from the upper left; quads without four corners are left out."""
    corner = [F.get("corners", F.lit(k)) for k in range(4)]
    meet = lambda a, b, c, d: S.line_intersection(corner[a], corner[b], corner[c], corner[d])
    return quads.filter(F.size("corners") == 4).select(*keys, meet(0, 1, 3, 2).alias("horizontal"), meet(0, 3, 1, 2).alias("vertical"))


def vanishing_lines(quads: DataFrame, *keys: str) -> DataFrame:
    """Per scene: pairs of horizontal and of vertical edges, and how many of these pairs meet. Scenes without quads of four
    corners have no row."""
    found = vanishing_points(quads, *keys)
    met = F.count("horizontal") + F.count("vertical")
    return found.groupBy(*keys).agg(F.count("*").alias("horizontal_pairs"), F.count("*").alias("vertical_pairs"), met.alias("finite_intersections"))


def scene_scoring(anchors: DataFrame, *keys: str, canvas: Column) -> DataFrame:
    """Per scene: simple shapes, the area of their boxes and its share of the canvas (at most 1), sum and mean of the shape
    bonus, and mean, least and largest semantic score (column score)."""
    bonus = S.shape_bonus(F.col("kind"))
    simple, area = bonus > 0, S.bounds_area(tuple(F.col(c) for c in BOUNDS))
    one = anchors.groupBy(*keys).agg(
        F.count_if(simple).alias("reserved"), F.coalesce(F.sum(F.when(simple, area)), F.lit(0.0)).alias("reserved_area"),
        F.sum(bonus).alias("bonus_total"), F.avg(bonus).alias("bonus_mean"),
        F.avg("score").alias("score_mean"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.first(canvas).alias("__canvas"),
    )
    share = F.when(F.col("__canvas") > 0, F.least(F.col("reserved_area") / F.col("__canvas"), F.lit(1.0))).otherwise(0.0)
    return one.withColumn("reserved_share", share).drop("__canvas")


def target_centroids(examples: DataFrame, targets: str = "targets", vector: str = "features") -> DataFrame:
    """(target, positive, negative): the mean vectors of the examples with and without each target; negative is null if all have it."""
    tall = examples.select(F.posexplode(vector).alias("pos", "v"), targets)
    every = tall.groupBy("pos").agg(F.sum(F.col("v").cast("double")).alias("all"), F.count("*").alias("n"))
    with_it = tall.select("pos", "v", F.explode(targets).alias("target")).groupBy("target", "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("k"))
    met = with_it.join(every, "pos").select("target", "pos", (F.col("s") / F.col("k")).alias("p"), F.try_divide(F.col("all") - F.col("s"), F.col("n") - F.col("k")).alias("q"))
    rows = met.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "p", "q"))).alias("c"))
    negative = F.transform("c", lambda x: x["q"])
    return rows.select("target", F.transform("c", lambda x: x["p"]).alias("positive"), F.when(~F.exists(negative, lambda x: x.isNull()), negative).alias("negative"))


def predict_targets(examples: DataFrame, centroids: DataFrame, vector: str = "features", most: int = 1000) -> DataFrame:
    """examples with predicted: the targets whose positive mean is at most as far as the negative one, or that have none.

    The centroids are sent to all tasks as one row; more than most targets are an error.
    """
    if (n := centroids.limit(most + 1).count()) > most:
        raise ValueError(f"{n} or more targets, at most {most} are allowed")
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("target", "positive", "negative"))).alias("__targets"))
    apart = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    near = F.filter("__targets", lambda t: t["negative"].isNull() | (apart(t["positive"]) <= apart(t["negative"])))
    return examples.crossJoin(F.broadcast(table)).withColumn("predicted", F.coalesce(F.transform(near, lambda t: t["target"]), F.array().cast("array<string>"))).drop("__targets")
