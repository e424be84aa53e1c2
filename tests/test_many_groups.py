"""Folds over many small groups: a task takes many of them by one call, with the results of one after the other."""

import numpy as np
import pytest

from inkframe.operators import raster, render


def one_by_one(rgb, tolerance):
    """The nearest bucket within the tolerance (ties: the earliest), else a new one, colour by colour."""
    palette, out = [], []
    for color in rgb.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(color, p, strict=True)) ** 0.5 for p in palette]
        if not d or min(d) > tolerance:
            palette.append(color)
            d.append(-1.0)
        out.append(palette[d.index(min(d))])
    return np.array(out)


def test_buckets_of_many_images_at_once():
    draw = np.random.default_rng(7)
    sizes = [1, 40, 3, 3, 90, 17, 1, 64]
    rgb, image = draw.integers(0, 256, (sum(sizes), 3)).astype(float), np.repeat(np.arange(len(sizes)), sizes)
    for tolerance in (1.0, 24.0, 90.0, 500.0):
        got = raster._first_buckets(rgb, image, tolerance)
        assert np.array_equal(got, np.concatenate([one_by_one(rgb[image == i], tolerance) for i in range(len(sizes))]))
    assert raster._first_buckets(np.empty((0, 3)), np.empty(0, int), 24.0).shape == (0, 3)


@pytest.mark.parametrize("step", [lambda px: raster.tolerant_buckets(px, 24.0, (128, 128, 128)), lambda px: render.trace_outline(px, "image_id")])
def test_no_call_per_group(spark, step):
    px = spark.createDataFrame([(1, 0, 0, 0, 9, 9, 9)], "image_id long, idx int, x int, y int, r int, g int, b int")
    assert "FlatMapGroupsInPandas" not in step(px)._jdf.queryExecution().optimizedPlan().toString()


def test_outlines_of_many_components_at_once(spark):
    cells = {1: [(0, 0)], 2: [(0, 0), (1, 0), (0, 1), (1, 1)], 3: [(5, 1), (4, 2), (5, 2), (6, 2), (5, 3)]}
    px = spark.createDataFrame([(k, x, y) for k, c in cells.items() for x, y in c], "image_id long, x int, y int").coalesce(1)
    got = {}
    for r in sorted(render.trace_outline(px, "image_id").collect()):
        got.setdefault(r.image_id, {})[r.ord] = (r.x, r.y)
    assert {k: [w[i] for i in range(len(w))] for k, w in got.items()} == {1: [(0, 0)], 2: [(0, 0), (1, 0), (1, 1), (0, 1)], 3: [(5, 1), (6, 2), (5, 3), (4, 2)]}
