"""Operators on small literals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import diff, fit, gates, learn, raster, review, scene
from inkframe.sources import scenes


def mask(spark, rows, name="m"):
    return raster.pixels_from_rows(spark.createDataFrame([(name, y, r) for y, r in enumerate(rows)], "mask_id string, y int, row string"))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_step_mask(spark):
    m = mask(spark, ["##.", ".##", "..."])
    g = raster.component_geometry(raster.connected_components(m, "image_id"), "image_id", "component_id").collect()
    assert [(r.area, r.min_x, r.min_y, r.max_x, r.max_y, r.centroid_x, r.centroid_y) for r in g] == [(4, 0, 0, 2, 1, 1.0, 0.5)]
    assert {(r.y, r.span_start, r.span_end) for r in raster.spans(m, "image_id").collect()} == {(0, 0, 1), (1, 1, 2)}
    assert {(r.x, r.y) for r in raster.boundary_pixels(m, "image_id").collect()} == {(0, 0), (1, 0), (1, 1), (2, 1)}


def test_two_parts_and_deferred(spark):
    m = mask(spark, ["##..", ".#..", "...#"])
    kept, deferred = raster.bounded_components(m, "image_id", max_area=3)
    assert kept.select("component_id").distinct().count() == 2 and deferred.count() == 0
    assert [r.area for r in raster.bounded_components(mask(spark, ["###", "###"]), "image_id", max_area=3)[1].collect()] == [6]


def test_ragged_mask_fails(spark):
    with pytest.raises(Exception, match="equally wide"):
        mask(spark, ["##", "#"]).collect()


def test_wide_components_agree(spark):
    m = mask(spark, ["#.#.#", ".#...", "....#", "###.#"])
    wide = raster.connected_components_wide(m, "image_id").groupBy("root").count().collect()
    narrow = raster.connected_components(m, "image_id").groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in wide) == sorted(r["count"] for r in narrow)


def test_boundary_of_solid(spark):
    assert raster.boundary_pixels(mask(spark, ["###", "###", "###"]), "image_id").count() == 8


def test_gap_components(spark):
    sealed = {r.area: r.sealed for r in raster.gap_components(mask(spark, ["#####", "#.#.#", "###.."]), "image_id").collect()}
    assert sealed == {1: True, 3: False}


def test_circle_fit_is_exact(spark):
    rows = [(0, 10 * math.cos(t) + 3, 10 * math.sin(t) - 2) for t in range(7)]
    r = fit.kasa_circle(spark.createDataFrame(rows, "k int, x double, y double"), "k").first()
    assert (r.cx, r.cy, r.r) == pytest.approx((3, -2, 10))
    line = fit.kasa_circle(spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 1.0), (0, 2.0, 2.0)], "k int, x double, y double"), "k").first()
    assert line.cx is None


def test_metric_literals(spark):
    perfect, egg = points((10, 0), (0, 10), (-10, 0), (0, -10)), points((12, 0), (0, 8), (-11, 0), (0, -9))
    r = one(spark, S.roundness_error(perfect, F.lit(0.0), F.lit(0.0), F.lit(10.0)).alias("p"), S.roundness_error(egg, F.lit(0.0), F.lit(0.0), F.lit(10.0)).alias("e"))
    assert r.p == 0 and r.e > 0
    widths = lambda *v: S.variation(F.array(*map(F.lit, map(float, v))))
    r = one(spark, widths(4, 4, 4, 4).alias("a"), widths(2, 4, 7, 3).alias("b"), S.spacing_error(points((0, 0), (0, 5), (0, 10))).alias("c"), S.spacing_error(points((0, 0), (0, 4), (0, 13))).alias("d"))
    assert r.a == 0 and r.b > 0 and r.c < r.d
    r = one(spark, S.quad_corner_error(points((0, 0), (10, 0), (10, 8), (0, 8))).alias("a"), S.quad_corner_error(points((0, 0), (10, 0), (25, 8), (0, 1))).alias("b"), S.quad_area(points((0, 0), (10, 0), (10, 8), (0, 8))).alias("area"), S.line_smoothness_error(points((0, 0), (1, 0), (2, 0))).alias("s"))
    assert r.a < r.b and r.area == 80 and r.s == 0


def test_scalars(spark):
    r = one(spark, S.hex_color(F.lit(255), F.lit(0), F.lit(16)).alias("h"), S.hex_to_rgb(F.lit("#ff0010")).alias("c"), S.hex_to_rgb(F.lit("zz")).alias("k"), S.wrapped_angle(F.lit(3 * math.pi / 2)).alias("w"), S.segment_distance(*map(F.lit, (5.0, 1.0, 0.0, 0.0, 2.0, 0.0))).alias("d"), S.orientation(F.lit(4.0), F.lit(1.0)).alias("o"))
    assert r.h == "#ff0010" and tuple(r.c) == (255, 0, 16) and tuple(r.k) == (0, 0, 0)
    assert r.w == pytest.approx(-math.pi / 2) and r.d == pytest.approx(math.hypot(3, 1)) and r.o == "horizontal"


def test_stage_codes(spark):
    codes = {"palette_quantized": "palette", "fit_x": "fitting", "a_fit_failed": "fitting", "merge_y": "cleanup", "gate_z": "scoring", "a_export_failed": "export", "timeout_reached": "runtime", "?": "unknown"}
    df = spark.createDataFrame([(c,) for c in codes], "code string").select("code", S.diagnostic_stage(F.lit(None).cast("string"), F.col("code")).alias("s"))
    assert {r.code: r.s for r in df.collect()} == codes


def test_curves(spark):
    seg = S.catmull_rom(points((0, 0), (1, 1), (2, 0)))
    r = one(spark, F.size(seg).alias("n"), F.size(S.catmull_rom(points((0, 0), (1, 1), (2, 0)), closed=True)).alias("c"), S.cubic_samples(F.get(seg, F.lit(0)), 4).alias("s"))
    assert (r.n, r.c, len(r.s)) == (2, 3, 5) and (r.s[-1].x, r.s[-1].y) == pytest.approx((1, 1))


def test_palette_and_modal(spark):
    p = spark.createDataFrame([(0, i, *c) for i, c in enumerate([(250, 0, 0)] * 40 + [(0, 0, 250)] * 30 + [(252, 0, 0)] * 5 + [(255, 255, 255)] * 25)], "image_id int, idx int, r int, g int, b int")
    found = [(r.r, r.g, r.b) for r in raster.dominant_palette(p, (255, 255, 255), 4).orderBy("ord").collect()]
    assert found == [(250, 0, 0), (0, 0, 250)]
    buckets = raster.tolerant_buckets(p, 5.0, (255, 255, 255)).groupBy("bucket").count().collect()
    assert sorted(r["count"] for r in buckets) == [30, 45]


def test_resize(spark):
    p = mask(spark, ["#.", ".#"])
    assert raster.resize_nearest(p, (2, 2), (4, 4)).count() == 8


def test_choose_best_ties(spark):
    df = spark.createDataFrame([(1, 1, "b", 0.5), (1, 0, "a", 0.5), (2, 0, "c", 0.1)], "k int, ord int, kind string, score double")
    assert {r.k: r.kind for r in fit.choose_best(df, "k").collect()} == {1: "a", 2: "c"}
    predictions = spark.createDataFrame([(1, "b")], "k int, label string")
    assert {r.k: r.kind for r in fit.choose_best(fit.with_classifier_prior(df, predictions, "k"), "k").collect()} == {1: "b", 2: "c"}


def test_sweep_zero_is_missing(spark):
    df = spark.createDataFrame([(0, "a", 0.5, 0.0), (0, "b", 0.5, 0.4), (0, "c", 0.5, None)], "g int, id string, editability_score double, raster_l1_error double")
    assert [r.id for r in diff.sweep_rank(df, "g").orderBy("semantic_rank").collect()] == ["b", "a", "c"]


def test_baseline_findings(spark):
    base = spark.createDataFrame([("a", 0.01, 0.95), ("b", 0.01, 0.95), ("d", 0.1, 0.5)], "id string, l1 double, bbox_iou double")
    now = spark.createDataFrame([("a", 0.02, 0.90), ("b", 0.0115, 0.95), ("c", 0.0, 1.0)], "id string, l1 double, bbox_iou double")
    found = {(r.id, r.metric): r.finding for r in diff.baseline_drift(base, now, "id", ["l1", "bbox_iou"], rising=("bbox_iou",)).collect()}
    assert found == {("a", "l1"): "regression", ("a", "bbox_iou"): "regression", ("c", ""): "added", ("d", ""): "removed"}


def test_greedy_matches(spark):
    df = spark.createDataFrame([(0, "a", "x", 0.9), (0, "a", "y", 0.8), (0, "b", "x", 0.7), (0, "b", "y", 0.6)], "k int, l string, r string, iou double")
    assert {(r.l, r.r) for r in diff.greedy_matches(df, "k", left="l", right="r", score="iou").collect()} == {("a", "x"), ("b", "y")}


def test_states_and_decisions(spark):
    s = spark.createDataFrame([(1, "fallback"), (1, "rejected"), (1, "promoted"), (2, "deferred"), (2, "rejected"), (3, "odd")], "k int, state string")
    assert {r.k: r.state for r in review.anchor_state(s, "k").collect()} == {1: "promoted", 2: "rejected", 3: "fallback"}
    g = spark.createDataFrame([(1, True, "red", "x"), (2, False, "yellow", "x"), (3, False, "red", "x"), (3, False, "red", "missing_source")], "k int, ok boolean, severity string, gate_type string")
    assert {r.k: r.state for r in review.promotion_decision(g, "k").collect()} == {1: "promoted", 2: "deferred", 3: "deferred"}


def test_cluster_axis_follows_the_mean(spark):
    df = spark.createDataFrame([(0, v) for v in (0, 3, 6, 9)], "k int, v int")
    assert [r.cluster for r in scene.cluster_axis(df, "k", value="v", tolerance=3.5).orderBy("v").collect()] == [0, 0, 1, 1]


def test_exact_rect_merge(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (0, 1.0, 0.0, 2.0, 1.0), (1, 0.0, 0.0, 1.0, 1.0), (1, 2.0, 0.0, 3.0, 1.0)], "k int, min_x double, min_y double, max_x double, max_y double")
    assert sorted((r.k, r.merged_from) for r in scene.merge_exact_rects(df, "k").collect()) == [(0, 2), (1, 1), (1, 1)]


def test_softmax_learns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, features array<double>")
    w = [[0.0, 0.0], [0.0, 0.0]]
    for _ in range(3):
        w = learn.softmax_step(df, w, [0, 1], 1.0)
    assert w[0][0] > 0 > w[0][1] and w[1][1] > 0 > w[1][0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "image_id int, x int, y int")
    for df in (raster.component_geometry(empty, "image_id"), raster.boundary_pixels(empty, "image_id"), raster.connected_components(empty, "image_id"), fit.kasa_circle(empty, "image_id"), raster.interior_gaps(empty, "image_id")):
        assert df.count() == 0


def test_manifest_to_svg(spark, tmp_path):
    run = tmp_path / "run-1"
    run.mkdir()
    (run / "manifest.json").write_text('{"width": 4, "height": 4, "anchors": [{"kind": "circle", "color": "#ff0000", "circle": {"cx": 2.0, "cy": 2.5, "r": 1.0}}, {"kind": "quad", "quad": {"corners": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}, {"x": 0, "y": 1}]}}], "diagnostics": [{"code": "x", "level": "warning"}], "metrics": {"editability_score": 0.75}}')
    docs = scenes.read_manifests(spark, f"file://{tmp_path}")
    summary = scenes.run_summaries(docs).first()
    assert (summary.run, summary.anchors, summary.warnings, summary.editability_score) == ("run-1", 2, 1, 0.75)
    svg = scenes.to_svg(scenes.explode_anchors(docs)).first().svg
    assert '<circle cx="2" cy="2.5" r="1" fill="#ff0000"/>' in svg and '<polygon points="0,0 1,0 1,1 0,1"' in svg


def test_stream_matches_batch(spark, tmp_path, data):
    from inkframe.streaming.stage_counts import read_events, windowed_stage_counts

    events = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = windowed_stage_counts(read_events(spark, folder, events.schema))
    query = stream.writeStream.format("memory").queryName("stages").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("stages").collect()} == {tuple(r) for r in windowed_stage_counts(events).collect()}


def test_outline_and_render(spark):
    from inkframe.operators import render

    m = mask(spark, ["###", "###", "###"])
    walk = [(r.x, r.y) for r in render.trace_outline(m, "image_id").orderBy("ord").collect()]
    assert walk[0] == (0, 0) and sorted(walk) == sorted({(x, y) for x in range(3) for y in range(3)} - {(1, 1)})
    assert [(r.x, r.y) for r in render.trace_outline(mask(spark, ["#"]), "image_id").collect()] == [(0, 0)]
    shapes = spark.createDataFrame([("m", 0, "rect", "#111111", 0.0, 0.0, 2.0, 2.0), ("m", 1, "rect", "#222222", 2.0, 2.0, 9.0, 9.0)], "image_id string, anchor_index int, kind string, color string, min_x double, min_y double, max_x double, max_y double")
    shapes = shapes.withColumns({c: F.lit(1.0) for c in ("cx", "cy", "rx", "ry", "width")})
    drawn = {(r.x, r.y): r.color for r in render.render(shapes, "image_id", width=4, height=4).collect()}
    assert drawn[2, 2] == "#222222" and drawn[0, 0] == "#111111" and len(drawn) == 9 + 4 - 1


def test_refinement_never_gets_worse(spark):
    from inkframe.operators import render

    ink = spark.createDataFrame([(0, x, y) for x in range(9) for y in range(9) if math.hypot(x - 4, y - 4) <= 3], "k int, x int, y int")
    start = spark.createDataFrame([(0, 5.0, 4.0, 2.0)], "k int, cx double, cy double, r double")
    one_round, more = (render.refine_circles(ink, start, "k", rounds=n).first() for n in (1, 6))
    assert more.error <= one_round.error and abs(more.cx - 4) <= 0.5


def test_gates_and_features(spark):
    from inkframe.operators import proposals

    p = spark.createDataFrame([("pending", None, None, True), ("pending", "rect", {"a_error": 0.5}, True), ("pending", "rect", {"x": 9.0}, False), ("pending", "rect", {"x": 9.0}, True), ("rejected", None, None, True)], "downstream_status string, anchor_kind string, anchor_metrics map<string,double>, anchor_reserved boolean")
    got = [(r.downstream_status, r.downstream_decision_reason) for r in proposals.gate_proposals(p, 0.1, True).collect()]
    assert got == [("rejected", "missing_anchor_summary"), ("rejected", "anchor_quality_error_too_high"), ("rejected", "anchor_not_reserved"), ("accepted", "geometry_gate_passed"), ("rejected", None)]
    schema = "node_count int, parameter_count int, circle struct<cx:double,cy:double,r:double>, stroke struct<centerline:array<struct<x:double,y:double>>,width_samples:array<double>>, quad struct<corners:array<struct<x:double,y:double>>>, metrics map<string,double>, group_kinds array<string>"
    a = spark.createDataFrame([(1, 3, (0.0, 0.0, 7.0), None, None, {"quad_subtype_code": 2.0}, ["perspective_grid", "other"]), (2, 5, None, ([(0.0, 0.0), (3.0, 4.0)], [2.0, 4.0]), None, None, None)], schema)
    first, second = (r.features for r in proposals.anchor_features(a).collect())
    assert len(first) == len(proposals.FEATURE_NAMES) and first[:4] == [1, 3, 1, 7] and first[10:13] == [2, 2, 1]
    assert second[4:7] == [1, 3, 5] and second[11] == 0


def test_promotion_of_occluded_rects(spark):
    rows = [(1, "rect", "red", 0, 0, 4, 10), (1, "rect", "red", 6, 0, 10, 10), (1, "circle", "blue", 4, 0, 6, 9), (2, "rect", "red", 0, 0, 4, 10), (2, "rect", "red", 6, 0, 10, 10), (2, "rect", "blue", 4, 0, 5, 1), (3, "cubic_path", "red", 0, 0, 4, 10), (3, "rect", "red", 6, 0, 10, 10), (3, "rect", "blue", 4, 0, 6, 10)]
    df = spark.createDataFrame([(k, n, c, *map(float, b)) for k, n, c, *b in rows], "run int, kind string, color string, min_x double, min_y double, max_x double, max_y double")
    assert {r.run: (r.hidden_area, r.promoted) for r in scene.promote_occluded(df, "run").collect()} == {1: (20.0, True), 2: (20.0, False)}


def test_long_line_is_one_wide_component(spark):
    line = [(0, i, 0) for i in range(400)] + [(0, 399, i) for i in range(400)] + [(0, 0, 5), (0, 1, 6), (1, 0, 0), (1, 2, 0)]
    out = raster.connected_components_wide(spark.createDataFrame(line, "image_id int, x int, y int"), "image_id")
    sizes = sorted((r["image_id"], r["count"]) for r in out.groupBy("image_id", "root").count().collect())
    assert sizes == [(0, 2), (0, 799), (1, 1), (1, 1)]
    assert raster.connected_components_wide(spark.createDataFrame([], "image_id int, x int, y int"), "image_id").count() == 0


def test_labels_match_a_walk():
    draw = np.random.default_rng(2)
    for share in (0.2, 0.4, 0.6):
        ys, xs = np.nonzero(draw.random((23, 31)) < share)
        turn = draw.permutation(len(xs))
        xs, ys = xs[turn], ys[turn]
        todo, parts = set(zip(xs.tolist(), ys.tolist(), strict=True)), []
        for first in sorted(todo, key=lambda p: (p[1], p[0])):
            if first in todo:
                part, stack = set(), [first]
                while stack:
                    p = stack.pop()
                    if p in todo:
                        todo.discard(p)
                        part.add(p)
                        stack += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                parts.append(part)
        want = {p: k for k, part in enumerate(parts) for p in part}
        assert raster._label8(xs, ys).tolist() == [want[p] for p in zip(xs.tolist(), ys.tolist(), strict=True)]


def test_json_numbers_at_any_depth(spark):
    texts = ['{"a": {"b": {"c": 1}}, "s": "5", "t": true, "n": null}', '{"a": [1, {"id": "x", "v": 2.5}, {"v": [3]}]}', "not json", None, "{}", "[4]"]
    out = diff.flatten_json(spark.createDataFrame(list(enumerate(texts)), "id int, doc string"), "id", "doc")
    assert sorted((r.id, r.path, r.value) for r in out.collect()) == [(0, "a.b.c", 1.0), (1, "a.0", 1.0), (1, "a.2.v.0", 3.0), (1, "a.x.v", 2.5), (5, "0", 4.0)]


def test_split_counts_hold_with_ties(spark):
    rows = [(i // 2, f"r{i}") for i in range(10)] + [(None, "none")]
    out = learn.positional_split(spark.createDataFrame(rows, "o int, name string"), "o", 1, 1)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 9, "val": 1, "test": 1}
    top = {r.split: r.o for r in out.filter("split <> 'train'").collect()}
    assert top == {"val": 4, "test": 4}


# gates and summaries ------------------------------------------------------------------------------------------------


def test_region_checks_edges(spark):
    schema = "s int, region_id int, min_x double, min_y double, max_x double, max_y double, expected_kinds array<string>, forbidden_kinds array<string>, min_iou double, min_coverage double, min_count int, max_count int"
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 200.0, 200.0, None, None, None, 0.5, 1, None), (1, 2, None, 0.0, 1.0, 1.0, None, None, None, None, 0, None), (1, 3, 0.0, 0.0, 10.0, 10.0, ["rect"], ["arc"], None, None, 1, 1), (2, 4, 0.0, 0.0, 1.0, 1.0, [], None, None, None, 1, None)], schema)
    anchors = spark.createDataFrame([(1, "rect", 0.0, 0.0, 10.0, 10.0), (1, "arc", 150.0, 150.0, 260.0, 260.0), (1, None, 1.0, 1.0, 9.0, 9.0), (1, "rect", None, 0.0, 1.0, 1.0), (3, "rect", 0.0, 0.0, 1.0, 1.0)], "s int, kind string, min_x double, min_y double, max_x double, max_y double")
    out = {r.region_id: r for r in gates.region_checks(regions, anchors, "s").collect()}
    assert (out[1].selected, out[1].ok) == (2, True) and out[2].reason == "region bounds are invalid"
    assert (out[3].selected, out[3].matching, out[3].ok) == (2, 1, True) and out[4].reason == "matching anchors in region: 0 < 1"
    assert gates.region_checks(regions.limit(0), anchors, "s").count() == 0
    assert gates.region_checks(regions, anchors.limit(0), "s").count() == 4


def test_regressions_and_deltas_edges(spark):
    s = "k int, component string, score double"
    current = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (2, "a", 0.1), (3, "a", 0.9), (4, "a", 0.0)], s)
    baseline = spark.createDataFrame([(1, "a", 0.56), (1, "b", 0.1), (2, "a", None), (3, "a", 0.95), (4, "z", 0.5)], s)
    out = {r.k: (r.status, r.regressed) for r in gates.component_regressions(current, baseline, "k").collect()}
    assert out == {1: ("failed", ["a"]), 2: ("missing_baseline_scores", []), 3: ("passed", []), 4: ("missing_comparable_scores", [])}
    r = "item_id int, region_id int, v int"
    deltas = gates.region_deltas(spark.createDataFrame([(1, 1, 5), (1, 2, None), (2, 1, 1)], r), spark.createDataFrame([(1, 2, None), (1, 3, 1), (3, 1, 1)], r), ["v"])
    assert sorted((x.region_id, x.status) for x in deltas.collect()) == [(1, "removed"), (3, "added")]
    t = gates.readiness(spark.createDataFrame([], "case_id int, missing_fields array<string>")).first()
    assert (t.cases, t.templates, t.waiting_templates) == (0, 0, 0)


def test_axis_clusters_and_targets(spark):
    count = lambda values, tolerance: spark.range(1).select(gates.axis_clusters(F.array(*map(F.lit, values)).cast("array<double>"), F.lit(tolerance))).first()[0]
    assert count([], 1.0) == 0 and count([3.0], 1.0) == 1 and count([0.0, 1.0, 2.0, 9.0], 1.0) == 3 and count([5.0, 5.0, 0.0], 1.0) == 2
    e = spark.createDataFrame([([0.0, 0.0], ["a", "all"]), ([1.0, 1.0], ["all"]), ([4.0, 4.0], ["all"])], "features array<double>, targets array<string>")
    c = gates.target_centroids(e)
    assert {r.target: r.negative for r in c.collect()} == {"a": [2.5, 2.5], "all": None}
    assert [r.predicted for r in gates.predict_targets(e, c).orderBy("features").collect()] == [["a", "all"], ["a", "all"], ["all"]]
    with pytest.raises(ValueError, match="at most 1"):
        gates.predict_targets(e, c, most=1)


def test_greedy_rounds_against_one_by_one(spark):
    """Many ties, a hot end, nulls and repeated pairs: the rounds take what going through the sorted pairs takes."""
    draw = np.random.default_rng(3)
    rows = [(int(k), int(0 if hot else l), int(r), float(s) / 4) for k, l, r, s, hot in zip(draw.integers(0, 3, 600), draw.integers(0, 25, 600), draw.integers(0, 25, 600), draw.integers(0, 5, 600), draw.random(600) < 0.3, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 2, 1.0), (1, 3, None, 1.0), (1, 90, 90, None)], "k int, l int, r int, iou double")
    taken = set()
    for k, l, r, s in sorted(set(rows), key=lambda x: (x[0], -x[3], x[1], x[2])):
        if not any(t[0] == k and (t[1] == l or t[2] == r) for t in taken):
            taken.add((k, l, r, s))
    out = [tuple(x) for x in diff.greedy_matches(df, "k", left="l", right="r", score="iou").collect()]
    assert len(out) == len(taken) and set(out) == taken
    assert diff.greedy_matches(df.limit(0), "k", left="l", right="r", score="iou").count() == 0
