"""Vanishing points and lines of quads."""

from inkframe.operators import gates

SCHEMA = "scene string, name string, corners array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)]
#: Its sides, x = 3 - y / 10 and x = 7 + y / 10, meet at (5, -20), its upper and lower edges are parallel.
TAPERED = [(3.0, 0.0), (7.0, 0.0), (9.0, 20.0), (1.0, 20.0)]
#: Neither pair is parallel.
FREE = [(0.0, 0.0), (4.0, -2.0), (8.0, 14.0), (0.0, 10.0)]


def frame(spark, quads):
    return spark.createDataFrame(quads, SCHEMA)


def meeting(points):
    """By Cramer's rule on the two line equations."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = points
    a, b, c, d = y2 - y1, x1 - x2, y4 - y3, x3 - x4
    p, q, det = a * x1 + b * y1, c * x3 + d * y3, a * d - b * c
    return None if det == 0 else ((p * d - b * q) / det, (a * q - p * c) / det)


def near(point, want):
    return (point is None and want is None) or (abs(point.x - want[0]) < 1e-9 and abs(point.y - want[1]) < 1e-9)


def test_points_against_line_equations(spark):
    quads = {"square": SQUARE, "tapered": TAPERED, "free": FREE, "one point": [(1.0, 1.0)] * 4}
    found = {r["name"]: r for r in gates.vanishing_points(frame(spark, [("s", k, q) for k, q in quads.items()]), "name").collect()}
    assert set(found) == set(quads)
    for name, (a, b, c, d) in quads.items():
        assert near(found[name]["horizontal"], meeting((a, b, d, c))), name
        assert near(found[name]["vertical"], meeting((a, d, b, c))), name
    assert found["square"]["horizontal"] is None and found["square"]["vertical"] is None
    assert (found["tapered"]["vertical"].x, found["tapered"]["vertical"].y) == (5.0, -20.0)


def test_scenes_with_repeats_nulls_and_short_quads(spark):
    quads = [("a", "1", SQUARE), ("a", "2", TAPERED), ("a", "2", TAPERED), ("a", "3", None), ("b", "4", SQUARE[:3]), ("b", "5", []), (None, "6", FREE), ("c", "7", [None, *SQUARE[1:]])]
    found = {r["scene"]: (r["horizontal_pairs"], r["vertical_pairs"], r["finite_intersections"]) for r in gates.vanishing_lines(frame(spark, quads), "scene").collect()}
    assert found == {"a": (3, 3, 2), None: (1, 1, 2), "c": (1, 1, 0)}
    assert gates.vanishing_lines(frame(spark, []), "scene").count() == 0
