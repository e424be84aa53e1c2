"""Joins of exploded pixels: none may be sent through the driver, however small Spark takes them for."""

import numpy as np
import pytest

from inkframe.operators import diff, fit, raster, render, shapes
from inkframe.plans import gate_queries, shape_queries

NAMES = ("arc_candidates", "circle_fits", "cutout_strokes", "ellipse_fits", "quad_fill_error", "smooth_strokes")


@pytest.mark.parametrize("name", NAMES)
def test_no_broadcast(spark, data, name):
    plan = shape_queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_masks_of_one_batch_stay_apart(spark):
    rows = [(k, x, y) for k, cells in ((1, [(0, 0), (1, 1), (5, 5)]), (2, [(0, 0), (2, 0), (2, 1)]), (3, [(-4, 7)])) for x, y in cells]
    found = raster.connected_components(spark.createDataFrame(rows, "image_id long, x int, y int").coalesce(1), "image_id").collect()
    assert {tuple(r) for r in found} == {(1, 0, 0, 0), (1, 1, 1, 0), (1, 5, 5, 1), (2, 2, 0, 0), (2, 2, 1, 0), (2, 0, 0, 1), (3, -4, 7, 0)}


def test_rows_without_pixels_are_gaps(spark):
    rows = [(1, 0, 0), (1, 2, 0), (1, 1, 3)]
    found = raster.interior_gaps(spark.createDataFrame(rows, "image_id long, x int, y int"), "image_id").collect()
    assert {tuple(r) for r in found} == {(1, 1, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 0, 2), (1, 1, 2), (1, 2, 2), (1, 0, 3), (1, 2, 3)}


def test_quad_rows_without_ink_are_missing(spark):
    rows = [(1, x, y) for y in (0, 1, 4) for x in range(5)]
    ink = spark.createDataFrame(rows, "image_id long, x int, y int")
    got = shapes.quad_fill_error(ink, fit.extreme_quad(ink, "image_id"), "image_id").first()
    assert (got["expected"], got["missing"], got["extra"]) == (25, 10, 0)


def test_candidates_are_planned_one_fit_at_a_time(spark, tmp_path, monkeypatch):
    """All fits as one plan would be the driver's largest: its final step reads settled candidates only, and does not draw or fit."""
    monkeypatch.setattr(raster, "_settled", lambda df: df.localCheckpoint(eager=False))
    rows = [(1, x, y) for x in range(4) for y in range(6)]
    ink = spark.createDataFrame(rows, "image_id long, x int, y int")
    plan = shapes.primitive_candidates(ink, "image_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Generate") == 0 and plan.count("Aggregate") <= 1


def test_shapes_are_dealt_out_before_they_become_pixels(spark):
    """Few small rows become many pixels: one task would hold the pixels of all shapes."""
    rows = [(k, "rect", 0, "#000000", 0.0, 0.0, 1.0, 1.0, 1.0, 0, 0, 7, 7) for k in range(400)]
    shapes_ = spark.createDataFrame(rows, "image_id long, kind string, anchor_index int, color string, cx double, cy double, rx double, ry double, width double, min_x int, min_y int, max_x int, max_y int").coalesce(1)
    drawn = render.render(shapes_, "image_id", width=8, height=8)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.rindex("Generate explode") :]
    assert drawn.count() == 400 * 64


def test_pairs_are_computed_once(spark, monkeypatch):
    """The boxes' join is dear: what becomes of the expectations is told from settled pairs."""
    monkeypatch.setattr(diff, "_settled", lambda df: df.localCheckpoint())
    pairs = spark.range(60).selectExpr("id % 3 AS g", "id % 5 AS e", "id % 5 AS place", "if(id % 7 = 0, null, id) AS a", "id % 2 AS f", "if(id = 9, double('nan'), id / 60) AS s")
    out = diff.ordered_matches(pairs, "g", expected="e", order="place", actual="a", failures="f", score="s")
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 15 and out.filter("status = 'matched' and (a is null or s is null or isnan(s))").count() == 0


def test_boxes_in_cells_are_not_broadcast(spark):
    boxes = spark.range(1).selectExpr("id AS g", "0D AS min_x", "0D AS min_y", "90D AS max_x", "90D AS max_y")  # known to be small
    other = boxes.toDF("g", *(f"b_{c}" for c in boxes.columns[1:]))
    met = diff.box_pairs(boxes, other, "g")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1


def test_regions_in_cells_are_not_broadcast_and_kinds_stay_behind(spark, data):
    plan = gate_queries.QUERIES["expectation_results"](spark, data)._jdf.queryExecution().executedPlan().toString()
    cells = [line for line in plan.splitlines() if "Join" in line and "cell_x" in line]
    assert cells and all("SortMergeJoin" in line for line in cells)
    # rows after the window are shuffled without their arrays of kinds: the operator's last columns need a flag only
    after = plan[: plan.index("Window ")]
    assert "kinds#" not in after


def test_pixels_are_read_once(spark):
    """Pixels are dear to make and many: all fits read the bitmaps that one reading leaves."""
    cells = [(k, x, y) for k in range(3) for x in range(12) for y in range(9 + k) if k != 1 or (x - 5) ** 2 + (y - 5) ** 2 <= 25]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pixels = spark.createDataFrame(cells, "image_id long, x int, y int").mapInArrow(counted, "image_id long, x int, y int")
    assert shapes.primitive_candidates(pixels, "image_id").count() > 3
    assert read.value == len(cells)


def test_bitmaps_hold_their_pixels(spark):
    """Over several words, on both sides of zero: pixels, boundary, gaps, sums and corners as from the pixels themselves."""
    draw = np.random.default_rng(5)
    cells = {(k, int(x), int(y)) for k in range(6) for x, y in zip(draw.integers(-70, -70 + 40 * (k + 1), 300 * (k + 1)), draw.integers(-6, 7, 300 * (k + 1)), strict=True)}
    cells |= {(9, x, y) for x in range(-130, 140) for y in range(5) if not (x % 63 in (1, 2) and y == 2)} | {(8, 63, 1)}
    df = spark.createDataFrame(sorted(cells), "k int, x int, y int")
    ink = raster.bitmaps(df, "k")
    rows = lambda found: sorted(tuple(r) for r in found.select("k", "x", "y").collect())
    assert rows(raster.bitmap_pixels(ink, "k")) == sorted(cells)
    assert rows(raster.bitmap_pixels(ink, "k", bits="edges")) == rows(raster.boundary_pixels(df, "k"))
    assert rows(raster.bitmap_gaps(ink, "k")) == rows(raster.interior_gaps(df, "k"))
    for r in ink.collect():
        mine = [(x, y) for k, x, y in cells if k == r.k]
        ends = {y: (min(x for x, v in mine if v == y), max(x for x, v in mine if v == y)) for _, y in mine}
        assert (r.area, r.min_x, r.max_y, r.sxy, r.syz) == (len(mine), min(mine)[0], max(y for _, y in mine), sum(x * y for x, y in mine), sum(y * (x * x + y * y) for x, y in mine))
        assert r.between == sum(b - a + 1 for a, b in ends.values()) - len(mine)
    corners = lambda found: {r.k: r.corners for r in found.collect()}
    assert corners(shapes._corners(ink, "k")) == corners(fit.extreme_quad(df, "k"))
