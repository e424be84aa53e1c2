"""Gate, regression and summary queries over the host tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import diff, expectations, gates, learn
from inkframe.plans.table_oracles import _A, _ACC
from inkframe.plans.table_queries import _examples, _predictions, _round, anchors
from inkframe.sources.tables import table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """An order is a quality case of its customer's suite; finished ones pass, some have no family."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("suite"), F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("ok"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("family"), (F.col("o_totalprice") / 1_000_000).alias("score"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def region_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first anchor's box of each scene is a region for the others; its colour says which kinds are forbidden, its nodes the limits."""
    a = anchors(spark, d)
    key = F.col("anchor_index")
    r = a.filter("line = 1").select(
        "run_id", key.alias("region_id"), F.when(F.col("parameter_count") == 50, F.col("max_x") + 1).otherwise(F.col("min_x")).alias("min_x"), "min_y", "max_x", "max_y",
        F.when(F.col("color") == "F", F.array(F.lit("rect"), F.lit("circle"))).alias("expected_kinds"), F.when(F.col("parameter_count") < 10, F.array(F.lit("cubic_path"))).alias("forbidden_kinds"),
        F.when(F.col("parameter_count") > 40, 0.02).alias("min_iou"), F.when(F.col("parameter_count") % 2 == 0, 0.3).alias("min_coverage"), F.when(F.col("color") == "O", 0).otherwise(1).alias("min_count"), F.when(F.col("parameter_count") > 25, 1).alias("max_count"),
    )
    return _round(gates.region_checks(r, a.filter("line > 1"), "run_id").select("run_id", "region_id", "selected", "matching", "forbidden", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"), "ok", "reason"), "best_iou")


def region_results(spark: SparkSession, d: str) -> DataFrame:
    """The same regions with limits on contours; an anchor's parameters say whether it is closed and how many holes it has."""
    a = anchors(spark, d).withColumns({"closed": F.when(F.col("parameter_count") % 3 != 1, F.col("parameter_count") % 3 == 0), "hole_count": F.col("parameter_count") % 4 - 1, "has_cutout": F.col("color") == "F"})
    q = F.col("parameter_count")
    r = a.filter("line = 1").select(
        "run_id", F.col("anchor_index").alias("region_id"), *gates.BOUNDS, F.lit(None).cast("array<string>").alias("expected_kinds"), F.lit(None).cast("array<string>").alias("forbidden_kinds"), F.lit(0.02).alias("min_iou"), F.lit(None).cast("double").alias("min_coverage"),
        F.when(q % 2 == 0, 0).alias("min_count"), F.lit(None).cast("int").alias("max_count"), F.when(q > 20, 1).alias("max_closed_anchors"), F.when(q % 2 == 0, 1).alias("min_open_anchors"), F.lit(2).alias("max_hole_count"), F.lit(1).alias("max_cutout_count"),
        F.when(q % 5 == 0, 1).alias("min_nested_contours"), F.when(q % 7 == 0, F.array(F.lit("closed"), F.lit("holes"))).alias("required_descriptors"), F.when(q % 3 == 0, F.array(F.lit("cutouts"))).alias("forbidden_descriptors"),
    )
    visual = r.filter(F.col("region_id") % 4 == 0).select("run_id", "region_id", F.array(F.lit("l1 too large")).alias("visual_failures"))
    out = gates.region_results(r, a.filter("line > 1"), "run_id", visual_failures=visual)
    return out.select("run_id", "region_id", "selected", "closed_anchor_count", "open_anchor_count", "hole_count", "cutout_count", "nested_contour_count", F.array_join("descriptors", ",").alias("descriptors"), "ok", "reason")


def ordered_matches(spark: SparkSession, d: str) -> DataFrame:
    """The anchors of a scene, in order, as expectations of the next scene's; another kind, another colour and a small IoU are failures."""
    cols = gates.BOUNDS
    a = anchors(spark, d).withColumns({c: F.col(c).cast("int") for c in cols})
    b = a.select((F.col("run_id") - 1).alias("run_id"), F.col("anchor_index").alias("actual"), F.col("kind").alias("b_kind"), *[F.col(c).alias(f"b_{c}") for c in cols])
    iou = F.round(S.pixel_bounds_iou(tuple(F.col(c) for c in cols), tuple(F.col(f"b_{c}") for c in cols)), 6)
    met = diff.box_pairs(a.select("run_id", F.col("anchor_index").alias("expected"), "kind", *cols), b, "run_id")
    pairs = met.select("run_id", "expected", F.col("expected").alias("place"), "actual", iou.alias("iou"), (F.when(F.col("kind") != F.col("b_kind"), 1).otherwise(0) + F.when(iou < 0.2, 1).otherwise(0)).alias("failures"))
    out = diff.ordered_matches(pairs, "run_id", expected="expected", order="place", actual="actual", failures="failures", score="iou")
    return out.drop("place").fillna({"actual": -1, "failures": -1, "iou": -1.0})


def expectation_results(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor is an expectation of its scene: by its parameters of a metric, of its kind at its place, of two kinds, or of groups (a line item is one, its status the kind)."""
    a, q = anchors(spark, d), F.col("parameter_count")
    o = table(spark, d, "orders")
    metrics = o.select(F.col("o_orderkey").alias("run_id"), F.lit("price").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("value"))
    groups = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("kind"))
    placed = lambda c: F.when((q % 4 == 1) & (q % 5 != 0), F.col(c))
    e = a.select(
        "run_id", F.col("anchor_index").alias("expectation_id"), F.col("line").alias("ord"), F.when(q % 4 == 0, F.when(q % 3 == 0, "depth").otherwise("price")).alias("metric"), F.when(q % 8 == 0, 100.0).alias("min_value"), F.lit(200.0).alias("max_value"),
        F.when(q % 4 == 1, F.array("kind")).when(q % 4 == 2, F.array(F.lit("circle"), F.lit("rect"), F.lit("circle"))).alias("kinds"), F.when(q % 4 == 3, F.col("color")).alias("group_kind"), *[placed(c).alias(c) for c in gates.BOUNDS],
        F.when(q % 3 != 0, 0.05).alias("min_iou"), F.when(q % 7 == 0, 0).when(q % 7 != 1, 2).alias("min_count"), F.when(q % 14 == 0, 0).when(q % 3 == 0, 3).alias("max_count"),
    )
    out = expectations.expectation_results(e, a, groups, metrics, "run_id").select("run_id", "expectation_id", "actual_value", "actual_count", "required", "ok", "reason", "missing_count", "excess_count", F.round("shortfall", 6).alias("shortfall"), F.round("excess", 6).alias("excess"))
    return out.fillna(-1).fillna("")


def group_checks(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of one kind and colour are a group; each scene has two gates."""
    groups = anchors(spark, d).groupBy("run_id", "kind", "color").agg(F.count("*").alias("members"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    one = o.select("run_id", F.lit("any").alias("gate_id"), F.lit(None).cast("array<string>").alias("kinds"), F.lit(1).alias("min_count"), F.lit(3).alias("max_count"), F.lit(2).alias("min_members"), F.lit(None).cast("int").alias("max_members"))
    two = o.select("run_id", F.lit("shapes").alias("gate_id"), F.array(F.lit("circle"), F.lit("rect")).alias("kinds"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("min_count"), F.lit(None).cast("int").alias("max_count"), F.lit(1).alias("min_members"), F.lit(2).alias("max_members"))
    out = gates.group_checks(one.unionByName(two), groups, "run_id")
    return out.select("run_id", "gate_id", "selected", "best_members", F.array_join("failures", ", ").alias("failures"), "ok")


def applied_review_status(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("case_id")
    decision = F.when(c % 5 == 0, "accepted").when(c % 5 == 1, "corrected").when(c % 5 == 2, "deferred").when(c % 5 == 3, F.col("status"))
    return _cases(spark, d).select(gates.review_status(decision).alias("s")).groupBy("s.ok", "s.reason").agg(F.count("*").alias("n"))


def component_regressions(spark: SparkSession, d: str) -> DataFrame:
    """A suite's mean score per priority is a component; the baseline leaves out some suites, and has no scores for others."""
    c = _cases(spark, d).groupBy("suite", F.col("priority").alias("component")).agg(F.avg("score").alias("score"))
    low = F.when(F.col("component") == "1-URGENT", 0.06).when(F.col("component") == "5-LOW", -0.06).otherwise(0.01)
    base = c.filter("suite % 7 <> 0").select("suite", F.when(F.col("suite") % 11 == 0, "other").otherwise(F.col("component")).alias("component"), F.when(F.col("suite") % 5 != 0, F.col("score") + low).alias("score")).groupBy("suite", "component").agg(F.max("score").alias("score"))
    out = gates.component_regressions(c, base, "suite")
    return out.select("suite", "compared", F.array_join("regressed", ",").alias("regressed"), F.coalesce("worst_delta", F.lit(0.0)).alias("worst_delta"), "status")


def region_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Line items as an order's regions: some lines are gone afterwards, some new, some changed."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("region_id"), F.col("l_returnflag").alias("state"), F.when(F.col("l_quantity") > 5, F.col("l_linestatus")).alias("gate"), F.col("l_quantity").cast("int").alias("q")).groupBy("item_id", "region_id").agg(F.max("state").alias("state"), F.max("gate").alias("gate"), F.max("q").alias("q"))
    after = x.withColumns({"state": F.when(F.col("q") % 5 == 0, "Z").otherwise(F.col("state")), "gate": F.when(F.col("q") % 7 == 0, F.lit(None)).otherwise(F.col("gate"))})
    out = gates.region_deltas(x.filter("q % 9 <> 0"), after.filter("q % 8 <> 0"), ["state", "gate"])
    return out.select("item_id", "region_id", "status", F.array_join("changed_fields", ",").alias("changed_fields"))


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per suite and side, orders as matches whose score is their overlap, null for some."""
    m = _cases(spark, d).withColumn("bbox_iou", F.when(F.col("case_id") % 4 != 0, F.col("score")))
    return _round(gates.match_summary(m, "suite"), "mean_iou", "min_iou", "max_iou")


def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    m = _cases(spark, d).withColumn("after", F.when(F.col("case_id") % 3 == 0, "").when(F.col("case_id") % 3 == 1, F.col("priority")))
    return gates.transition_counts(m, "status", "after")


def accuracy_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per label over all vectors against that over the even ones; two labels are missing on a side."""
    p = _predictions(spark, d)
    side = lambda rows: learn.label_accuracy(learn.confusion(rows))
    return _round(gates.accuracy_deltas(side(p.filter("vec_id % 2 = 0 and label <> 3")), side(p.filter("label <> 4"))), "baseline", "augmented", "delta")


def passing_cases(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    preferred = c.filter("case_id % 6 = 0").select("suite", "case_id", (-F.col("case_id")).alias("place"))
    return gates.passing_cases(c, preferred, "suite", limit=4).select("suite", "case_id", "rank")


def case_family_summary(spark: SparkSession, d: str) -> DataFrame:
    return gates.family_summary(_cases(spark, d))


def _templates(spark: SparkSession, d: str) -> DataFrame:
    need = lambda c, name: F.when(c, F.lit(name))
    return _cases(spark, d).select(F.col("suite").alias("case_id"), F.array_compact(F.array(need(F.col("status") != "F", "reviewer"), need(F.col("score") > 0.1, "evidence"), need(F.col("family").isNull(), ""))).alias("missing_fields"))


def template_readiness(spark: SparkSession, d: str) -> DataFrame:
    return gates.readiness(_templates(spark, d))


def missing_review_fields(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing_fields(_templates(spark, d))


def quad_grid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's anchors as quads."""
    a = anchors(spark, d)
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return gates.quad_grid_summary(a.select("run_id", ((F.col("min_x") + F.col("max_x")) / 2).alias("center_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("center_y"), w.alias("width"), h.alias("height")), "run_id")


def scene_scoring(spark: SparkSession, d: str) -> DataFrame:
    score = S.semantic_score(F.col("raster_error"), F.col("quality_error"), F.col("node_count"), F.col("parameter_count"), F.col("kind"))
    out = gates.scene_scoring(anchors(spark, d).withColumn("score", score), "run_id", canvas=F.lit(2000.0))
    return _round(out, "reserved_area", "reserved_share", "bonus_total", "bonus_mean", "score_mean", "score_min", "score_max")


def multi_targets(spark: SparkSession, d: str) -> DataFrame:
    """Predicted targets per vector; its label gives the true ones, and all have one."""
    label = F.col("label")
    e = _examples(spark, d).withColumn("targets", F.array_compact(F.array(F.when(label < 3, "small"), F.when(label % 2 == 0, "even"), F.lit("every"))))
    out = gates.predict_targets(e, gates.target_centroids(e))
    return out.select("vec_id", F.array_join("predicted", ",").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    region_checks, region_results, ordered_matches, expectation_results, group_checks, applied_review_status, component_regressions, region_deltas, match_summary, transition_counts, accuracy_deltas, passing_cases,
    case_family_summary, template_readiness, missing_review_fields, quad_grid_summary, scene_scoring, multi_targets,
)}

_C = "c AS (SELECT o_custkey AS suite, o_orderkey AS case_id, o_orderstatus = 'F' AS ok, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS family, o_totalprice / 1000000 AS score, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"
_T = f"{_C}, t AS (SELECT suite, list_filter([CASE WHEN status <> 'F' THEN 'reviewer' END, CASE WHEN score > 0.1 THEN 'evidence' END, CASE WHEN family IS NULL THEN '' END], lambda x: x IS NOT NULL) AS missing FROM c)"
_FOLD = "list_reduce(list_transform(list_sort({xs}), lambda v: {{'at': v, 'n': 1}}), lambda a, b: CASE WHEN abs(b.at - a.at) > {tol} THEN {{'at': b.at, 'n': a.n + 1}} ELSE {{'at': (a.at + b.at) / 2, 'n': a.n}} END).n"

ORACLE = {
    "region_checks": f"""WITH {_A}, r AS (SELECT run_id, anchor_index AS region_id, CASE WHEN parameter_count = 50 THEN x1 + 1 ELSE x0 END AS x0, y0, x1, y1, color, parameter_count AS q FROM a WHERE line = 1),
        p AS (SELECT r.*, b.kind, greatest(least(r.x1, b.x1) - greatest(r.x0, b.x0), 0) * greatest(least(r.y1, b.y1) - greatest(r.y0, b.y0), 0) AS i, (r.x1 - r.x0) * (r.y1 - r.y0) AS ra, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba
            FROM r JOIN a b ON b.run_id = r.run_id AND b.line > 1 WHERE r.x0 <= r.x1),
        s AS (SELECT *, i / (ra + ba - i) AS iou FROM p WHERE i > 0),
        h AS (SELECT run_id, region_id, count(*) AS selected, count(*) FILTER (color <> 'F' OR kind IN ('rect', 'circle')) AS matching, count(*) FILTER (q < 10 AND kind = 'cubic_path') AS forbidden, max(iou) AS best
            FROM s WHERE iou >= CASE WHEN q > 40 THEN 0.02 WHEN q % 2 = 0 THEN 0 ELSE 0.1 END AND (q % 2 <> 0 OR i / ba >= 0.3) GROUP BY ALL),
        o AS (SELECT r.*, coalesce(selected, 0) AS selected, coalesce(matching, 0) AS matching, coalesce(forbidden, 0) AS forbidden, round(coalesce(best, 0), 6) AS best_iou, CASE WHEN color = 'O' THEN 0 ELSE 1 END AS least FROM r LEFT JOIN h USING (run_id, region_id)),
        z AS (SELECT *, CASE WHEN x0 > x1 THEN 'region bounds are invalid' WHEN forbidden > 0 THEN 'forbidden anchors in region: ' || forbidden WHEN matching < least THEN 'matching anchors in region: ' || matching || ' < ' || least
            WHEN q > 25 AND matching > 1 THEN 'matching anchors in region: ' || matching || ' > 1' ELSE 'passed' END AS reason FROM o)
        SELECT run_id, region_id, selected, matching, forbidden, best_iou, reason = 'passed' AS ok, reason FROM z""",
    "region_results": f"""WITH {_A}, r AS (SELECT run_id, anchor_index AS region_id, x0, y0, x1, y1, parameter_count AS q FROM a WHERE line = 1),
        p AS (SELECT r.*, b.kind, b.parameter_count AS bq, b.color AS bc, greatest(least(r.x1, b.x1) - greatest(r.x0, b.x0), 0) * greatest(least(r.y1, b.y1) - greatest(r.y0, b.y0), 0) AS i, (r.x1 - r.x0) * (r.y1 - r.y0) AS ra, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba
            FROM r JOIN a b ON b.run_id = r.run_id AND b.line > 1 WHERE r.x0 <= r.x1),
        s AS (SELECT run_id, region_id, count(*) AS n, count(*) FILTER (kind IN ('circle', 'ellipse', 'rect', 'rounded_rect', 'quad', 'stroke_circle') OR bq % 3 = 0) AS c, sum(greatest(bq % 4 - 1, 0))::BIGINT AS h, count(*) FILTER (bc = 'F') AS cut FROM p WHERE i > 0 AND i / (ra + ba - i) >= 0.02 GROUP BY ALL),
        o AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(h, 0)::BIGINT AS h, coalesce(cut, 0) AS cut FROM r LEFT JOIN s USING (run_id, region_id)),
        e AS (SELECT *, list_filter([CASE WHEN n = 0 THEN 'empty' WHEN c = n THEN 'closed' WHEN c = 0 THEN 'open' ELSE 'mixed_open_closed' END, CASE WHEN n > 1 THEN 'multi_component' WHEN n = 1 THEN 'single_component' END,
            CASE WHEN h > 0 THEN 'holes' END, CASE WHEN cut > 0 THEN 'cutouts' END, CASE WHEN h + cut > 0 THEN 'nested_contours' END], lambda z: z IS NOT NULL) AS ds FROM o),
        f AS (SELECT *, list_filter([CASE WHEN q > 20 AND c > 1 THEN 'closed_anchor_count ' || c || ' > 1' END, CASE WHEN q % 2 = 0 AND n - c < 1 THEN 'open_anchor_count ' || (n - c) || ' < 1' END, CASE WHEN h > 2 THEN 'hole_count ' || h || ' > 2' END,
            CASE WHEN cut > 1 THEN 'cutout_count ' || cut || ' > 1' END, CASE WHEN q % 5 = 0 AND h + cut < 1 THEN 'nested_contour_count ' || (h + cut) || ' < 1' END, CASE WHEN q % 7 = 0 AND NOT list_contains(ds, 'closed') THEN 'missing topology descriptor: closed' END,
            CASE WHEN q % 7 = 0 AND NOT list_contains(ds, 'holes') THEN 'missing topology descriptor: holes' END, CASE WHEN q % 3 = 0 AND list_contains(ds, 'cutouts') THEN 'forbidden topology descriptor: cutouts' END], lambda z: z IS NOT NULL) AS fs FROM e),
        z AS (SELECT *, CASE WHEN x0 > x1 OR y0 > y1 THEN 'region bounds are invalid' WHEN q % 2 = 1 AND n < 1 THEN 'matching anchors in region: ' || n || ' < 1' WHEN len(fs) > 0 THEN 'topology constraints failed: ' || array_to_string(fs, ', ')
            WHEN region_id % 4 = 0 THEN 'region visual thresholds failed: l1 too large' ELSE 'passed' END AS reason FROM f)
        SELECT run_id, region_id, n AS selected, c AS closed_anchor_count, n - c AS open_anchor_count, h AS hole_count, cut AS cutout_count, h + cut AS nested_contour_count, array_to_string(ds, ',') AS descriptors, reason = 'passed' AS ok, reason FROM z""",
    "ordered_matches": f"""WITH RECURSIVE {_A}, i AS (SELECT run_id, anchor_index, kind, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1 FROM a),
        t AS (SELECT a.run_id, a.anchor_index AS expected, b.anchor_index AS actual, a.kind <> b.kind AS other, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1, 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1, 0) AS inter,
            (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) + (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS total FROM i a JOIN i b ON b.run_id = a.run_id + 1),
        p AS (SELECT run_id, expected, actual, round(inter / (total - inter), 6) AS iou, other::INT + (round(inter / (total - inter), 6) < 0.2)::INT AS failures FROM t WHERE inter > 0),
        e AS (SELECT run_id, expected, row_number() OVER (PARTITION BY run_id ORDER BY expected) AS k, list(actual ORDER BY iou DESC, actual) FILTER (failures = 0) AS choices FROM p GROUP BY run_id, expected),
        r AS (SELECT DISTINCT run_id, 0::BIGINT AS k, []::BIGINT[] AS taken FROM e
              UNION ALL SELECT e.run_id, e.k, list_append(taken, coalesce(list_filter(coalesce(choices, []), lambda c: NOT list_contains(taken, c))[1], -1)) FROM r JOIN e ON e.run_id = r.run_id AND e.k = r.k + 1),
        m AS (SELECT e.run_id, e.expected, r.taken[-1] AS actual, r.taken[:-2] AS earlier FROM e JOIN r USING (run_id, k)),
        left_over AS (SELECT m.run_id, m.expected, arg_min({{'a': p.actual, 'f': p.failures, 's': p.iou}}, {{'f': p.failures, 's': -p.iou, 'a': p.actual}}) AS b FROM m JOIN p ON p.run_id = m.run_id AND p.expected = m.expected AND NOT list_contains(earlier, p.actual) WHERE m.actual = -1 GROUP BY ALL)
        SELECT m.run_id, m.expected, CASE WHEN m.actual <> -1 THEN 'matched' WHEN b IS NULL THEN 'missing' ELSE 'failed' END AS status, coalesce(CASE WHEN m.actual <> -1 THEN m.actual ELSE b.a END, -1) AS actual,
               coalesce(CASE WHEN m.actual <> -1 THEN 0 ELSE b.f END, -1) AS failures, coalesce(CASE WHEN m.actual <> -1 THEN p.iou ELSE b.s END, -1) AS iou
        FROM m LEFT JOIN left_over USING (run_id, expected) LEFT JOIN p ON p.run_id = m.run_id AND p.expected = m.expected AND p.actual = m.actual""",
    "expectation_results": f"""WITH {_A}, e AS (SELECT *, anchor_index AS id, parameter_count AS q, q % 4 = 1 AND q % 5 <> 0 AS boxed, CASE WHEN q % 3 <> 0 THEN 0.05 ELSE 0 END AS iou, CASE WHEN q % 7 = 0 THEN 0 WHEN q % 7 <> 1 THEN 2 ELSE 1 END AS least,
            CASE WHEN q % 14 = 0 THEN 0 WHEN q % 3 = 0 THEN 3 END AS most, CASE q % 4 WHEN 1 THEN kind WHEN 2 THEN 'circle, rect' WHEN 3 THEN color END AS what FROM a),
        h AS (SELECT e.run_id, e.id, count(*) AS n FROM e JOIN a b USING (run_id) WHERE CASE e.q % 4 WHEN 1 THEN b.kind = e.kind AND (NOT boxed OR (b.x0 < b.x1 AND b.y0 < b.y1 AND
            greatest(least(e.x1, b.x1) - greatest(e.x0, b.x0), 0) * greatest(least(e.y1, b.y1) - greatest(e.y0, b.y0), 0) >= iou * ((e.x1 - e.x0) * (e.y1 - e.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(e.x1, b.x1) - greatest(e.x0, b.x0), 0) * greatest(least(e.y1, b.y1) - greatest(e.y0, b.y0), 0))))
            WHEN 2 THEN b.kind IN ('circle', 'rect') WHEN 3 THEN b.color = e.color ELSE false END GROUP BY ALL),
        s AS (SELECT e.*, coalesce(h.n, 0) AS n, sum(least) OVER (PARTITION BY e.run_id, e.q % 4, what, iou, CASE WHEN boxed THEN [e.x0, e.y0, e.x1, e.y1] END ORDER BY line, e.id ROWS UNBOUNDED PRECEDING)::BIGINT AS required,
            CASE WHEN q % 3 <> 0 AND o_orderstatus <> 'P' THEN (o_totalprice / 1000)::DOUBLE END AS v, CASE WHEN q % 8 = 0 THEN 100 END AS lo FROM e LEFT JOIN h USING (run_id, id) JOIN orders ON o_orderkey = e.run_id),
        r AS (SELECT *, CASE WHEN q % 4 = 0 THEN CASE WHEN v IS NULL THEN 'missing_metric' WHEN v < lo THEN 'metric_below_min' WHEN v > 200 THEN 'metric_above_max' ELSE '' END
            WHEN n < required THEN CASE WHEN q % 4 = 3 THEN 'insufficient_groups' WHEN required > least THEN 'insufficient_distinct_anchors' ELSE 'insufficient_anchors' END
            WHEN n > most THEN CASE WHEN most = 0 AND least = 0 THEN 'forbidden_matches' ELSE 'too_many_matches' END ELSE '' END AS reason FROM s)
        SELECT run_id, id AS expectation_id, CASE WHEN q % 4 = 0 THEN coalesce(v, -1) ELSE -1 END AS actual_value, CASE WHEN q % 4 = 0 THEN -1 ELSE n END AS actual_count, CASE WHEN q % 4 = 0 THEN -1 ELSE required END AS required, reason = '' AS ok, reason,
            CASE WHEN reason LIKE 'insufficient%' THEN required - n ELSE -1 END AS missing_count, CASE WHEN reason IN ('forbidden_matches', 'too_many_matches') THEN n - most ELSE -1 END AS excess_count,
            CASE WHEN reason = 'metric_below_min' THEN round(lo - v, 6) ELSE -1 END AS shortfall, CASE WHEN reason = 'metric_above_max' THEN round(v - 200, 6) ELSE -1 END AS excess FROM r""",
    "group_checks": f"""WITH {_A}, g AS (SELECT run_id, kind, color, count(*) AS members FROM a GROUP BY ALL),
        w AS (SELECT o_orderkey AS run_id, 'any' AS gate_id, 1 AS lo, 3 AS hi, 2 AS mlo, NULL::INT AS mhi FROM orders UNION ALL SELECT o_orderkey, 'shapes', CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END, NULL, 1, 2 FROM orders),
        h AS (SELECT w.*, count(g.run_id) AS selected, coalesce(max(members), 0) AS best FROM w LEFT JOIN g ON g.run_id = w.run_id AND (gate_id = 'any' OR kind IN ('circle', 'rect')) GROUP BY ALL),
        f AS (SELECT *, concat_ws(', ', CASE WHEN selected < lo THEN 'group_count ' || selected || ' < ' || lo END, CASE WHEN selected > hi THEN 'group_count ' || selected || ' > ' || hi END,
            CASE WHEN best < mlo THEN 'best_member_count ' || best || ' < ' || mlo END, CASE WHEN best > mhi THEN 'worst_member_count ' || best || ' > ' || mhi END) AS failures FROM h)
        SELECT run_id, gate_id, selected, best AS best_members, failures, failures = '' AS ok FROM f""",
    "applied_review_status": """SELECT m < 2 AS ok, CASE m WHEN 0 THEN 'accepted_applied_review' WHEN 1 THEN 'accepted_applied_review' WHEN 2 THEN 'applied_review_not_accepted' WHEN 3 THEN 'invalid_applied_review_decision' ELSE 'missing_applied_review' END AS reason, count(*) AS n
        FROM (SELECT o_orderkey % 5 AS m FROM orders) GROUP BY 1, 2""",
    "component_regressions": f"""WITH {_C}, k AS (SELECT suite, priority AS component, avg(score) AS score FROM c GROUP BY ALL),
        b AS (SELECT suite, CASE WHEN suite % 11 = 0 THEN 'other' ELSE component END AS component, max(CASE WHEN suite % 5 <> 0 THEN score + CASE component WHEN '1-URGENT' THEN 0.06 WHEN '5-LOW' THEN -0.06 ELSE 0.01 END END) AS base FROM k WHERE suite % 7 <> 0 GROUP BY 1, 2),
        s AS (SELECT suite, count(base) AS scores FROM b GROUP BY suite),
        m AS (SELECT k.suite, k.component, round(score - base, 6) AS delta FROM k LEFT JOIN b USING (suite, component)),
        o AS (SELECT suite, count(delta) AS compared, coalesce(string_agg(component, ',' ORDER BY component) FILTER (delta < -0.05), '') AS regressed, coalesce(min(delta), 0)::DOUBLE AS worst_delta FROM m GROUP BY suite)
        SELECT suite, compared, regressed, worst_delta, CASE WHEN scores IS NULL THEN 'missing_baseline_case' WHEN scores = 0 THEN 'missing_baseline_scores' WHEN compared = 0 THEN 'missing_comparable_scores' WHEN regressed <> '' THEN 'failed' ELSE 'passed' END AS status FROM o LEFT JOIN s USING (suite)""",
    "region_deltas": """WITH x AS (SELECT l_orderkey AS item_id, l_linenumber AS region_id, max(l_returnflag) AS state, max(CASE WHEN l_quantity > 5 THEN l_linestatus END) AS gate, max(l_quantity::INT) AS q FROM lineitem GROUP BY ALL),
        b AS (SELECT *, true AS here FROM x WHERE q % 9 <> 0), n AS (SELECT item_id, region_id, CASE WHEN q % 5 = 0 THEN 'Z' ELSE state END AS state, CASE WHEN q % 7 <> 0 THEN gate END AS gate, true AS here FROM x WHERE q % 8 <> 0),
        m AS (SELECT coalesce(b.item_id, n.item_id) AS item_id, coalesce(b.region_id, n.region_id) AS region_id, CASE WHEN b.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed' ELSE 'changed' END AS status,
            concat_ws(',', CASE WHEN b.state IS DISTINCT FROM n.state THEN 'state' END, CASE WHEN b.gate IS DISTINCT FROM n.gate THEN 'gate' END) AS changed_fields
            FROM b FULL JOIN n ON b.item_id = n.item_id AND b.region_id = n.region_id)
        SELECT * FROM m WHERE (status <> 'changed' OR changed_fields <> '') AND item_id IN (SELECT item_id FROM b) AND item_id IN (SELECT item_id FROM n)""",
    "match_summary": f"WITH {_C}, m AS (SELECT suite, CASE WHEN case_id % 4 <> 0 THEN score ELSE 0 END AS v FROM c) SELECT suite, count(*) AS n, round(avg(v), 6) AS mean_iou, round(min(v), 6) AS min_iou, round(max(v), 6) AS max_iou FROM m GROUP BY suite",
    "transition_counts": f"WITH {_C} SELECT status || ' -> ' || CASE WHEN case_id % 3 = 1 THEN priority ELSE 'n/a' END AS transition, count(*) AS n FROM c GROUP BY 1",
    "accuracy_deltas": f"""WITH {_ACC}, b AS (SELECT label, count(*) FILTER (label = predicted) / count(*) AS v FROM p WHERE vec_id % 2 = 0 AND label <> 3 GROUP BY label), g AS (SELECT label, accuracy AS v FROM acc WHERE label <> 4)
        SELECT coalesce(b.label, g.label) AS label, round(b.v, 6) AS baseline, round(g.v, 6) AS augmented, round(g.v - b.v, 6) AS delta, CASE WHEN g.v - b.v IS NULL THEN 'insufficient' WHEN g.v > b.v THEN 'improved' WHEN g.v < b.v THEN 'regressed' ELSE 'held' END AS outcome
        FROM b FULL JOIN g ON b.label = g.label""",
    "passing_cases": f"WITH {_C} SELECT suite, case_id, row_number() OVER (PARTITION BY suite ORDER BY CASE WHEN case_id % 6 = 0 THEN -case_id END NULLS LAST, case_id) AS rank FROM c WHERE ok QUALIFY rank <= 4",
    "case_family_summary": f"WITH {_C} SELECT coalesce(family, case_id::VARCHAR) AS family, count(*) AS cases, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS ok FROM c GROUP BY 1",
    "template_readiness": f"""WITH {_T}, k AS (SELECT suite, count(*) AS t, count(*) FILTER (len(missing) = 0) AS r FROM t GROUP BY suite)
        SELECT count(*) AS cases, count(*) FILTER (r > 0) AS ready_cases, sum(t)::BIGINT AS templates, sum(r)::BIGINT AS ready_templates, count(*) FILTER (r = 0) AS waiting_cases, sum(t - r)::BIGINT AS waiting_templates FROM k""",
    "missing_review_fields": f"WITH {_T} SELECT field, count(*) AS n FROM (SELECT unnest(missing) AS field FROM t) WHERE field <> '' GROUP BY field",
    "quad_grid_summary": f"""WITH {_A}, g AS (SELECT run_id, count(*) AS quads, list((x0 + x1) / 2) AS xs, list((y0 + y1) / 2) AS ys, greatest(1, avg(x1 - x0) * 0.6) AS w, greatest(1, avg(y1 - y0) * 0.6) AS h FROM a GROUP BY run_id)
        SELECT run_id, quads, {_FOLD.format(xs="ys", tol="h")} AS row_count, {_FOLD.format(xs="xs", tol="w")} AS column_count FROM g""",
    "scene_scoring": f"""WITH {_A}, s AS (SELECT *, CASE kind WHEN 'circle' THEN 0.35 WHEN 'rect' THEN 0.25 ELSE 0 END AS bonus FROM a), t AS (SELECT *, (raster_error + quality_error + 0.015 * node_count + 0.01 * parameter_count - bonus)::DOUBLE AS score FROM s)
        SELECT run_id, count(*) FILTER (bonus > 0) AS reserved, round(coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (bonus > 0), 0), 6) AS reserved_area, round(least(coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (bonus > 0), 0) / 2000, 1), 6) AS reserved_share,
            round(sum(bonus), 6)::DOUBLE AS bonus_total, round(avg(bonus), 6)::DOUBLE AS bonus_mean, round(avg(score), 6) AS score_mean, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM t GROUP BY run_id""",
    "multi_targets": """WITH v AS (SELECT vec_id, label, i AS pos, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
        t AS (SELECT 'small' AS target UNION ALL SELECT 'even'),
        h AS (SELECT vec_id, pos, v, target, CASE target WHEN 'small' THEN label < 3 ELSE label % 2 = 0 END AS has FROM v, t),
        c AS (SELECT target, pos, avg(v) FILTER (has) AS p, avg(v) FILTER (NOT has) AS q FROM h GROUP BY ALL),
        k AS (SELECT vec_id, target FROM h JOIN c USING (target, pos) GROUP BY ALL HAVING sum((v - p) ** 2) <= sum((v - q) ** 2))
        SELECT e.vec_id, concat_ws(',', max(CASE WHEN target = 'even' THEN 'even' END), 'every', max(CASE WHEN target = 'small' THEN 'small' END)) AS predicted FROM embeddings e LEFT JOIN k USING (vec_id) GROUP BY e.vec_id""",
}
