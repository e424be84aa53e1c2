"""Bounds of anchors as they are drawn."""

import math

from pyspark.sql import functions as F

from inkframe.functions import scalars as S

_POINTS = "array<struct<x:double,y:double>>"
SCHEMA = f"""name string, kind string, circle struct<cx:double,cy:double,r:double>, ellipse struct<cx:double,cy:double,rx:double,ry:double,rotation:double>,
stroke struct<centerline:{_POINTS},width_samples:array<double>,cap_style:string>, quad struct<corners:{_POINTS}>, path struct<points:{_POINTS}>"""


def bounds(spark, anchors):
    rows = [tuple(a.get(k) for k in ("name", "kind", "circle", "ellipse", "stroke", "quad", "path")) for a in anchors]
    out = spark.createDataFrame(rows, SCHEMA).select("name", S.drawn_bounds(F.col("kind")).alias("b"))
    return {r["name"]: tuple(None if v is None else round(v, 9) for v in r["b"]) for r in out.collect()}


def test_forms(spark):
    line, thick = [(0.0, 0.0), (3.0, 4.0)], [2.0, None, 4.0]
    found = bounds(spark, [
        {"name": "disc", "kind": "circle", "circle": (5.0, 6.0, 2.0), "stroke": (line, thick, None)},
        {"name": "ring", "kind": "stroke_circle", "circle": (5.0, 6.0, 2.0), "stroke": (None, thick, None)},
        {"name": "thin ring", "kind": "stroke_circle", "circle": (5.0, 6.0, 2.0)},
        {"name": "upright", "kind": "ellipse", "ellipse": (0.0, 0.0, 4.0, 1.0, math.pi / 2)},
        {"name": "outlined", "kind": "stroke_ellipse", "ellipse": (0.0, 0.0, 4.0, 1.0, None), "stroke": (None, [2.0], None)},
        {"name": "butt", "kind": "stroke", "stroke": (line, [10.0], "butt")},
        {"name": "round", "kind": "stroke", "stroke": (line, [10.0], "round")},
        {"name": "bent", "kind": "stroke", "stroke": ([*line, (9.0, 1.0)], [10.0], "butt")},
        {"name": "dot", "kind": "stroke", "stroke": ([(1.0, 1.0), (1.0, 1.0)], [], "butt")},
        {"name": "quad", "kind": "quad", "quad": ([(0.0, 1.0), None, (7.0, 0.0), (3.0, 9.0)],)},
        {"name": "path first", "kind": "cubic_path", "path": ([(1.0, 2.0), (3.0, -1.0)],), "circle": (0.0, 0.0, 50.0)},
    ])
    assert found == {
        "disc": (3.0, 4.0, 7.0, 8.0), "ring": (1.5, 2.5, 8.5, 9.5), "thin ring": (2.5, 3.5, 7.5, 8.5), "upright": (-1.0, -4.0, 1.0, 4.0), "outlined": (-5.0, -2.0, 5.0, 2.0),
        "butt": (-4.0, -3.0, 7.0, 7.0), "round": (-5.0, -5.0, 8.0, 9.0), "bent": (-5.0, -5.0, 14.0, 9.0), "dot": (0.5, 0.5, 1.5, 1.5), "quad": (0.0, 0.0, 7.0, 9.0), "path first": (1.0, -1.0, 3.0, 2.0),
    }


def test_nothing_to_draw(spark):
    zero = (0.0, 0.0, 0.0, 0.0)
    assert bounds(spark, [{"name": "none"}, {"name": "no points", "kind": "stroke", "stroke": ([], [3.0], "butt"), "path": ([],)}, {"name": "null points", "quad": ([None],)}]) == {"none": zero, "no points": zero, "null points": zero}
    assert bounds(spark, [{"name": "no radius", "kind": "circle", "circle": (1.0, 1.0, None)}]) == {"no radius": (None,) * 4}
    assert bounds(spark, []) == {}
