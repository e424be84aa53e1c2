"""Outlines, drawn shapes and their fits on small literals."""

import math

import numpy as np
import pytest

from inkframe.operators import curves, diff, fit, gates, shapes

OUTLINE = "name string, ord int, x double, y double"


def outline(spark, **shapes):
    return spark.createDataFrame([(n, i, float(x), float(y)) for n, pts in shapes.items() for i, (x, y) in enumerate(pts)], OUTLINE)


def circle(n=80, r=30.0):
    return [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def square(side=24):
    edge = range(side)
    return [*((k, 0) for k in edge), *((side, k) for k in edge), *((side - k, side) for k in edge), *((0, side - k) for k in edge)]


def curve(s, u):
    v = 1 - u
    return tuple(v**3 * s[f"a{c}"] + 3 * v * v * u * s[f"c{c}"] + 3 * v * u * u * s[f"d{c}"] + u**3 * s[f"b{c}"] for c in "xy")


def test_corners(spark):
    got = {r.name: r.corners for r in curves.outline_corners(outline(spark, square=square(), circle=circle(), short=circle(12)), "name").collect()}
    assert got == {"square": [0, 24, 48, 72], "circle": [], "short": []}


@pytest.mark.parametrize("retries", [0, 1, 2])
def test_segments_cover_their_outline(spark, retries):
    draw = np.random.default_rng(3)
    jagged = [((20 + 3 * e) * math.cos(2 * math.pi * k / 90), (20 + 3 * e) * math.sin(2 * math.pi * k / 90)) for k, e in enumerate(draw.standard_normal(90))]
    drop = [(x + 0.4 * abs(y), y) for x, y in circle(100, 25)]
    shapes = {"square": square(), "circle": circle(), "jagged": jagged, "drop": drop, "three": [(0, 0), (5, 0), (0, 5)], "still": [(1, 1)] * 6}
    df = outline(spark, **shapes)
    segments = [r.asDict() for r in curves.fit_segments(curves.outline_pieces(df, "name"), "name", retries=retries).collect()]
    for name, pts in shapes.items():
        mine = sorted((s for s in segments if s["name"] == name), key=lambda s: s["lo"])
        n = len(pts)
        assert [s["hi"] for s in mine[:-1]] == [s["lo"] for s in mine[1:]] and mine[-1]["hi"] == mine[0]["lo"] + n
        for s in mine:
            assert (s["ax"], s["ay"]) == pts[s["lo"] % n] and (s["bx"], s["by"]) == pts[s["hi"] % n]
            line = [curve(s, k / 400) for k in range(401)]
            for p in range(s["lo"], s["hi"] + 1):
                assert min(math.dist(pts[p % n], q) for q in line) < curves.TOLERANCE + 0.02
    count = lambda name: sum(s["name"] == name for s in segments)
    assert count("square") == 4 and count("circle") <= 6 < count("jagged")


def test_smooth_joints_share_a_tangent(spark):
    segments = sorted((r.asDict() for r in curves.fit_segments(curves.outline_pieces(outline(spark, c=circle()), "name"), "name").collect()), key=lambda s: s["lo"])
    for s, t in zip(segments, segments[1:] + segments[:1], strict=True):
        a, b = (s["bx"] - s["dx"], s["by"] - s["dy"]), (t["cx"] - t["ax"], t["cy"] - t["ay"])
        assert abs(a[0] * b[1] - a[1] * b[0]) < 1e-6 * math.hypot(*a) * math.hypot(*b)


def test_path_candidates(spark):
    df = outline(spark, c=circle(), s=square(240))
    got = {r.name: r for r in curves.path_candidates(curves.fit_segments(curves.outline_pieces(df, "name"), "name"), df, "name").collect()}
    assert got["c"].budget == 16 and got["s"].budget == 36 and got["s"].node_count == 4
    assert got["s"].raster_error == pytest.approx(0.35 + 32 * 0.035)
    assert curves.fit_segments(curves.outline_pieces(df.limit(0), "name"), "name").count() == 0


def ink(spark, **shapes):
    """Shapes as predicates over a 60 x 60 canvas."""
    rows = [(n, x, y) for n, f in shapes.items() for x in range(60) for y in range(60) if f(x, y)]
    return spark.createDataFrame(rows, "name string, x int, y int")


def disc(r, cx=30, cy=30):
    return lambda x, y: (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def oval(rx, ry, degrees=0.0):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return lambda x, y: (((x - 30) * c + (y - 30) * s) / rx) ** 2 + (((y - 30) * c - (x - 30) * s) / ry) ** 2 <= 1


def capsule(half, r, degrees=0.0):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def inside(x, y):
        u, v = (x - 30) * c + (y - 30) * s, (y - 30) * c - (x - 30) * s
        return math.hypot(max(abs(u) - half, 0), v) <= r

    return inside


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_ellipses(spark):
    tilted = {f"tilt{a}": oval(22, 11, a) for a in (20, 45, 70, 110, 160)}
    df = ink(spark, flat=oval(22.5, 12.5), small=oval(4, 3), disc=disc(20), bar=capsule(14, 8), tilted_bar=capsule(14, 8, 30), box=lambda x, y: 10 <= x < 50 and 20 <= y < 40, ring=lambda x, y: oval(24, 14)(x, y) and not oval(20, 10)(x, y), dot=lambda x, y: (x, y) == (3, 4), **tilted)
    got = by_name(shapes.ellipse_fits(df, "name"))
    assert {n for n, r in got.items() if r.fits} == {"flat", "ring", *tilted} and got["flat"].form == "aligned" and got["ring"].form == "ring"
    for n in tilted:
        a = float(n[4:])
        assert got[n].form == "tilted" and abs(got[n].rx - 22) < 1 and abs(got[n].ry - 11) < 1
        assert min(abs(math.degrees(got[n].rotation) - a + k) for k in (0, 180, -180)) < 2
    assert 3 < got["ring"].stroke_width < 7


def test_circles_and_their_gaps(spark):
    lens = lambda x, y: disc(26, 14, 30)(x, y) and disc(26, 46, 30)(x, y)
    cut = lambda x, y: disc(20)(x, y) and not (29 <= y <= 31 and 16 <= x <= 44)
    df = ink(spark, disc=disc(20), cut=cut, lens=lens, box=lambda x, y: 15 <= x < 45 and 15 <= y < 45, open_cut=lambda x, y: disc(20)(x, y) and not (29 <= y <= 31 and x >= 30), dot=lambda x, y: (x, y) == (3, 4))
    got = by_name(shapes.circle_fits(df, "name"))
    assert got["disc"].fits and not got["disc"].refitted and got["cut"].fits and got["cut"].refitted
    assert abs(got["cut"].r - 20) < 0.5 and (got["cut"].cx, got["cut"].cy) == (30, 30) and got["cut"].gap_area == 3 * 29
    assert not got["lens"].fits and not got["box"].fits and not got["dot"].fits
    edges = shapes.boundary_without_gaps(df.filter("name = 'cut'"), "name").collect()
    assert all(r.gap_edge == (28 <= r.y <= 32 and 15 <= r.x <= 45) for r in edges)


def test_quad_scan_lines(spark):
    slanted = lambda x, y: 10 <= y <= 30 and 10 + (y - 10) / 2 <= x <= 40 + (y - 10) / 2
    df = ink(spark, slanted=slanted, notched=lambda x, y: slanted(x, y) and not (20 <= y <= 24 and 25 <= x <= 29), line=lambda x, y: y == 3 and 3 <= x <= 20)
    quads = fit.extreme_quad(df, "name")
    got = by_name(shapes.quad_fill_error(df, quads, "name"))
    assert got["slanted"].fill_error < 0.02 and got["notched"].missing - got["slanted"].missing == 25
    assert got["line"].fill_error == 1.0 and got["line"].expected == 0
    wide = [("slanted", [(0.0, 10.0), (59.0, 10.0), (59.0, 30.0), (0.0, 30.0)]), ("notched", [(0.0, 10.0), (59.0, 10.0), (0.0, 10.0), (59.0, 10.0)])]
    own = spark.createDataFrame(wide, "name string, corners array<struct<x: double, y: double>>")
    got = by_name(shapes.quad_fill_error(df, own, "name"))
    area = sum(slanted(x, y) for x in range(60) for y in range(60))
    assert (got["slanted"].expected, got["slanted"].missing, got["slanted"].extra) == (60 * 21, 60 * 21 - area, 0)
    assert got["notched"].fill_error == 1.0  # no height


def test_smooth_strokes(spark):
    wave = lambda x, y: 4 <= x <= 56 and abs(y - 30 - 8 * math.sin(x / 9)) <= 1.6
    df = ink(spark, wave=wave, bow=lambda x, y: 4 <= x <= 56 and abs(y - 10 - (x - 30) ** 2 / 40) <= 1.6, line=lambda x, y: 4 <= x <= 56 and 29 <= y <= 31, steep=lambda x, y: wave(y, x), disc=disc(20), bent=lambda x, y: disc(20)(x, y) and not disc(16)(x, y), dot=lambda x, y: (x, y) == (3, 4))
    got = by_name(shapes.smooth_strokes(df, "name"))
    assert {n for n, r in got.items() if r.fits} == {"wave", "bow", "steep"}
    assert len(got["wave"].controls) == 7 and got["bow"].jitter < got["wave"].jitter and got["bow"].residual < 0.5
    assert [(round(p.y), round(p.x)) for p in got["steep"].controls] == [(round(p.x), round(p.y)) for p in got["wave"].controls]


def test_cutout_strokes(spark):
    host = lambda x, y: 2 <= x <= 57 and 2 <= y <= 57
    slits = {
        "straight": lambda x, y: 20 <= y <= 21 and 10 <= x <= 45, "diagonal": lambda x, y: abs(x - y) <= 1 and 10 <= x <= 45, "bowed": lambda x, y: abs(y - 20 - (x - 30) ** 2 / 30) <= 1 and 12 <= x <= 48,
        "winding": lambda x, y: abs(y - 30 - 6 * math.sin((x - 30) / 5)) <= 1.2 and 14 <= x <= 46, "hole": lambda x, y: disc(12)(x, y), "open": lambda x, y: 20 <= y <= 21 and x >= 30, "short": lambda x, y: (x, y) in ((30, 30), (31, 30)), "none": lambda x, y: False,
    }
    df = ink(spark, **{n: (lambda x, y, f=f: host(x, y) and not f(x, y)) for n, f in slits.items()})
    got = by_name(shapes.cutout_strokes(df, "name"))
    assert {n: r.form for n, r in got.items()} == {"straight": "straight", "diagonal": "straight", "bowed": "bowed", "winding": "winding"}
    assert len(got["winding"].centerline) == 7 and got["straight"].stroke_width == 2.0
    two = ink(spark, both=lambda x, y: host(x, y) and not slits["straight"](x, y) and not slits["hole"](x, y + 8) and not (50 <= y <= 51 and 10 <= x <= 40))
    assert shapes.cutout_strokes(two, "name").count() == 2 - (1 if slits["hole"](30, 21 + 8) else 0)


def test_no_pixels(spark):
    none = ink(spark, dot=disc(1)).limit(0)
    assert shapes.ellipse_fits(none, "name").count() == shapes.circle_fits(none, "name").count() == shapes.smooth_strokes(none, "name").count() == shapes.cutout_strokes(none, "name").count() == 0
    assert shapes.quad_fill_error(none, fit.extreme_quad(none, "name"), "name").count() == 0


def test_arcs(spark):
    def band(r, half, at, width=3.0, cy=30):
        return lambda x, y: abs(math.hypot(x - 30, y - cy) - r) <= width / 2 and abs((math.degrees(math.atan2(y - cy, x - 30)) - at + 180) % 360 - 180) <= half

    df = ink(spark, quarter=band(22, 45, -90, cy=40), half=band(20, 90, 90, cy=20), most=band(20, 140, 0), shallow=band(48, 25, -90, cy=60), ring=band(20, 180, 0), line=lambda x, y: 5 <= x <= 50 and 29 <= y <= 31, disc=disc(20), parabola=lambda x, y: 4 <= x <= 56 and abs(y - 50 + (x - 30) ** 2 / 18) <= 1.8, dot=lambda x, y: (x, y) == (3, 4))
    got = by_name(shapes.arc_candidates(df, "name"))
    assert {n for n, r in got.items() if r.fits} == {"quarter", "half", "most", "shallow"}
    for n, r, cy, half in (("quarter", 22, 40, 45), ("half", 20, 20, 90), ("most", 20, 30, 140), ("shallow", 48, 60, 25)):
        # the bins at an open band's ends draw the circle in: by up to 6 % of the radius on these bands
        assert abs(got[n].r - r) < 0.07 * r and abs(got[n].cy - cy) < 0.07 * r and abs(math.degrees(got[n].span) - 2 * half) < 12
        assert 2 <= got[n].stroke_width <= 4.5


def test_best_of_all_candidates(spark):
    arc = lambda x, y: abs(math.hypot(x - 30, y - 40) - 22) <= 1.5 and y <= 24
    df = ink(
        spark, circle=disc(20), stroke_circle=lambda x, y: disc(20)(x, y) and not disc(15)(x, y), ellipse=oval(22, 11, 30), stroke_ellipse=lambda x, y: oval(24, 14)(x, y) and not oval(20, 10)(x, y), rect=lambda x, y: 10 <= x < 50 and 20 <= y < 40,
        stroke_polyline=lambda x, y: 5 <= x <= 50 and 29 <= y <= 31, arc=arc, stroke_path=lambda x, y: 4 <= x <= 56 and abs(y - 30 - 8 * math.sin(x / 9)) <= 1.6, quad=lambda x, y: 10 <= y <= 30 and 10 + (y - 10) / 2 <= x <= 40 + (y - 10) / 2, cubic_path=lambda x, y: 10 <= x <= 50 and 5 <= y <= 55 and (x <= 16 or y <= 11 or y >= 49 or (27 <= y <= 33 and x <= 35)),
    )
    best = fit.choose_best(fit.with_semantic_score(shapes.primitive_candidates(df, "name")), "name")
    assert {r.name: r.kind for r in best.collect()} == {n: n for n in ("circle", "stroke_circle", "ellipse", "stroke_ellipse", "rect", "stroke_polyline", "arc", "stroke_path", "quad", "cubic_path")}
    paths = spark.createDataFrame([("cubic_path", 0.7, 9, 18)], "name string, raster_error double, node_count int, parameter_count int")
    own = shapes.primitive_candidates(df.filter("name in ('cubic_path', 'rect')"), "name", paths=paths).filter("kind = 'cubic_path'")
    assert {r.name: (r.raster_error, r.node_count) for r in own.collect()} == {"cubic_path": (0.7, 9), "rect": (0.35, 16)}


def ordered_fold(pairs):
    """One expectation after the other."""
    out, taken = {}, set()
    for e in sorted({p[0] for p in pairs}):
        left = sorted((f, -s, a) for x, a, f, s in pairs if x == e and a not in taken)
        if not left:
            out[e] = ("missing", None)
        elif left[0][0] == 0:
            out[e] = ("matched", left[0][2])
            taken.add(left[0][2])
        else:
            out[e] = ("failed", left[0][2])
    return out


def test_ordered_matches(spark):
    draw = np.random.default_rng(9)
    groups = {g: list({(int(e), int(a)): (int(e), int(a), int(draw.integers(3)) // 2, round(float(draw.random()), 1)) for e, a in draw.integers(0, 6, (18, 2))}.values()) for g in range(40)}
    groups[99] = [(e, a, 0, 1 - a / 10) for e in range(12) for a in range(12)]  # all want the same, in turn
    rows = [(g, e, e, a, f, s) for g, pairs in groups.items() for e, a, f, s in pairs]
    df = spark.createDataFrame([*rows, rows[0], (0, None, None, 1, 0, 0.5)], "g int, e int, place int, a int, f int, s double")
    got = {}
    for r in diff.ordered_matches(df, "g", expected="e", order="place", actual="a", failures="f", score="s").collect():
        got.setdefault(r.g, {})[r.e] = (r.status, r.a)
    assert got == {g: ordered_fold(pairs) for g, pairs in groups.items()}
    assert diff.ordered_matches(df.limit(0), "g", expected="e", order="place", actual="a", failures="f", score="s").count() == 0


REGION = "s int, region_id string, min_x double, min_y double, max_x double, max_y double, expected_kinds array<string>, forbidden_kinds array<string>, min_iou double, min_coverage double, min_count int, max_count int, max_closed_anchors int, max_hole_count int, required_descriptors array<string>"
ANCHOR = "s int, kind string, min_x double, min_y double, max_x double, max_y double, closed boolean, hole_count int, has_cutout boolean"


def test_region_topology(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    regions = spark.createDataFrame([
        (1, "all", *box, None, None, 0.01, None, None, None, 1, 1, ["open", "closed"]), (1, "far", 90.0, 90.0, 99.0, 99.0, None, None, None, None, None, None, None, None, None), (1, "none wanted", 90.0, 90.0, 99.0, 99.0, None, None, None, None, 0, None, None, None, ["empty"]),
        (1, "turned", 5.0, 0.0, 1.0, 9.0, None, None, None, None, 0, None, None, None, None), (2, "one", *box, ["circle"], None, 0.01, None, None, None, None, None, ["single_component", "closed"]),
    ], REGION)
    anchors = spark.createDataFrame([
        (1, "circle", 1.0, 1.0, 5.0, 5.0, None, None, None), (1, "cubic_path", 1.0, 1.0, 6.0, 6.0, True, 2, False), (1, "stroke_path", 2.0, 2.0, 8.0, 8.0, None, -3, True), (2, "circle", 0.0, 0.0, 9.0, 9.0, False, 0, False),
    ], ANCHOR)
    visual = spark.createDataFrame([(2, "one", ["l1 0.5 > 0.2"])], "s int, region_id string, visual_failures array<string>")
    got = {r.region_id: r for r in gates.region_results(regions, anchors, "s", visual_failures=visual).collect()}
    assert got["all"].descriptors == ["mixed_open_closed", "multi_component", "holes", "cutouts", "nested_contours"]
    assert got["all"].topology_failures == ["closed_anchor_count 2 > 1", "hole_count 2 > 1", "missing topology descriptor: open", "missing topology descriptor: closed"]
    assert got["all"].reason.startswith("topology constraints failed: closed_anchor_count 2 > 1, ")
    assert got["far"].reason == "matching anchors in region: 0 < 1" and not got["far"].ok  # a null min_count is 1
    assert got["none wanted"].ok and got["turned"].reason == "region bounds are invalid"
    assert got["one"].reason == "region visual thresholds failed: l1 0.5 > 0.2" and got["one"].descriptors == ["closed", "single_component"]


@pytest.mark.parametrize("key", ["key", "pos", "v", "id"])
def test_json_keys_of_clashing_names(spark, key):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"id": "x", "n": 2}]}}')], f"{key} int, doc string")
    assert {(r[0], r.path, r.value) for r in diff.flatten_json(df, key, "doc").collect()} == {(1, "a.b.0", 1.0), (1, "a.b.x.n", 2.0)}
    with pytest.raises(ValueError):
        diff.flatten_json(df.withColumnRenamed(key, "value"), "value", "doc")
