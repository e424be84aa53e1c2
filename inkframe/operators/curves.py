"""Closed outlines as cubic Bézier segments: least squares over chord-length parameters, split in rounds over a table of open segments.

An outline is (keys, ord, x, y), ord from 0 without gaps; it closes from its last point to its first. Positions go on
past the last point (position p is point p mod n), so that a segment is a range of positions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.raster import _settled

#: Chord of a turn in points, the least turn of a corner in radians, and how much more a doubled chord may turn.
TURN_SPAN, LEAST_TURN, TURN_GROWTH, MOST_CORNERS = 4, 0.65, 0.35, 16
#: The first tolerance in pixels, how many times it the error may be for another try, and contour pixels per node.
TOLERANCE, RETRY, NODE_PIXELS, LEAST_NODES, MOST_NODES = 0.45, 4.0, 12, 16, 36
#: A split leaves each side this share of the segment at least, so rounds grow with the logarithm of an outline.
LEAST_SHARE = 0.25
MOST_ROUNDS = 60


def chord_turns(outline: DataFrame, *keys: str, span: int) -> DataFrame:
    """outline with n (its points) and turn: the angle between the chords of span points before and after each point, 0 where a
    chord has no length."""
    w = Window.partitionBy(*keys).orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("x", "y")
    # what lies past an end is at the other end of the outline
    ring = outline.withColumn("n", F.count("*").over(whole)).withColumns({"__head": F.slice(F.collect_list(p).over(whole), 1, 2 * span), "__tail": F.slice(F.collect_list(p).over(whole), F.greatest(F.col("n") - 2 * span + 1, F.lit(1)), 2 * span)})
    at = lambda k: F.coalesce(F.lag(p, k).over(w), F.get("__tail", F.size("__tail") + F.col("ord") - k)) if k > 0 else F.coalesce(F.lead(p, -k).over(w), F.get("__head", F.col("ord") - k - F.col("n")))
    both = ring.withColumns({"__a": at(span), "__b": at(-span)})
    ax, ay, bx, by = F.col("x") - F.col("__a.x"), F.col("y") - F.col("__a.y"), F.col("__b.x") - F.col("x"), F.col("__b.y") - F.col("y")
    turn = F.when((F.hypot(ax, ay) > 0) & (F.hypot(bx, by) > 0), F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))).otherwise(0.0)
    return both.withColumn("turn", turn).drop("__head", "__tail", "__a", "__b")


def outline_corners(outline: DataFrame, *keys: str, span: int = TURN_SPAN, least: float = LEAST_TURN, most: int = MOST_CORNERS) -> DataFrame:
    """(keys, n, corners): per outline the sorted places where the direction breaks: a turn of at least `least` that grows little as the
    chord doubles. The sharpest go first (ties by place), none within two chords of one that is kept. Outlines too short
    for that have none."""
    small = chord_turns(outline, *keys, span=span)
    both = chord_turns(small.withColumnRenamed("turn", "small").drop("n"), *keys, span=2 * span)
    near = (F.col("n") >= 4 * span + 4) & (F.col("small") >= least) & (F.col("turn") <= F.col("small") + TURN_GROWTH)
    held = both.groupBy(*keys).agg(F.max("n").cast("int").alias("n"), F.sort_array(F.collect_list(F.when(near, F.struct((-F.round("small", 9)).alias("s"), F.col("ord").cast("int").alias("at"))))).alias("found"))
    apart = lambda a, b: F.least(F.abs(a - b), F.col("n") - F.abs(a - b))
    keep = lambda kept, c: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: apart(k, c["at"]) <= 2 * span), kept).otherwise(F.concat(kept, F.array(c["at"])))
    return held.select(*keys, "n", F.array_sort(F.aggregate("found", F.array().cast("array<int>"), keep)).alias("corners"))


def _unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    d = F.hypot(dx, dy)
    return F.when(d > 0, dx / d).otherwise(1.0), F.when(d > 0, dy / d).otherwise(0.0)


def outline_pieces(outline: DataFrame, *keys: str, corners: DataFrame | None = None) -> DataFrame:
    """(keys, lo, hi, pos, x, y, lx, ly, rx, ry): the points of each piece between corners, with the tangents at its ends. An outline
    without corners is cut at its first and middle points, one with a single corner there and half-way round; the
    tangent at such a cut is shared, at a corner each piece has its own."""
    found = outline_corners(outline, *keys) if corners is None else corners
    half, first = F.floor(F.col("n") / 2).cast("int"), F.get("corners", F.lit(0))
    two = F.when(F.size("corners") == 0, F.array(F.lit(0), half)).when(F.size("corners") == 1, F.array(first, first + half)).otherwise(F.col("corners"))
    cuts = found.withColumn("cuts", two).withColumn("ends", F.concat(F.slice("cuts", 2, F.size("cuts")), F.array(F.get("cuts", F.lit(0)) + F.col("n"))))
    pieces = cuts.select(*keys, "n", "corners", F.explode(F.arrays_zip("cuts", "ends")).alias("c")).select(*keys, "n", "corners", F.col("c.cuts").alias("lo"), F.col("c.ends").alias("hi")).filter("hi > lo")
    # a point beyond each end, for the shared tangents
    rows = pieces.withColumn("pos", F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1))).withColumn("ord", F.pmod("pos", "n"))
    rows = rows.join(outline.select(*keys, "ord", "x", "y"), [*keys, "ord"])
    whole = Window.partitionBy(*keys, "lo").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda p: F.max_by(F.struct("x", "y"), F.when(F.col("pos") == p, 1)).over(whole)
    lo, hi, in_hi, in_lo = F.col("lo"), F.col("hi"), F.greatest(F.col("hi") - 2, F.col("lo")), F.least(F.col("lo") + 2, F.col("hi"))
    rows = rows.withColumns({"__a": at(lo), "__b": at(hi), "__a1": at(lo + 1), "__a0": at(lo - 1), "__b1": at(hi + 1), "__b0": at(hi - 1), "__a2": at(in_lo), "__b2": at(in_hi)})
    d = lambda to, of: _unit(F.col(f"{to}.x") - F.col(f"{of}.x"), F.col(f"{to}.y") - F.col(f"{of}.y"))
    sharp = lambda p: F.array_contains("corners", F.pmod(p, F.col("n")).cast("int"))
    tangents = {}
    for k, axis in enumerate("xy"):
        tangents[f"l{axis}"] = F.when(sharp(lo), d("__a2", "__a")[k]).otherwise(d("__a1", "__a0")[k])
        tangents[f"r{axis}"] = F.when(sharp(hi), d("__b2", "__b")[k]).otherwise(d("__b0", "__b1")[k])
    return rows.filter("pos between lo and hi").select(*keys, "lo", "hi", "pos", "x", "y", *[v.alias(k) for k, v in tangents.items()])


def _point(u: Column, axis: str) -> Column:
    v = 1 - u
    return v * v * v * F.col(f"a{axis}") + 3 * v * v * u * F.col(f"c{axis}") + 3 * v * u * u * F.col(f"d{axis}") + u * u * u * F.col(f"b{axis}")


def _fitted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with a parameter u: the ends a and b, the controls c and d of the least-squares segment, off (a point's distance at
    its parameter), error and worst (the largest of those within the segment, and its place; ties: the first)."""
    whole = Window.partitionBy(*keys, "lo")
    u, v = F.col("u"), 1 - F.col("u")
    b0, b1, b2, b3 = v * v * v, 3 * u * v * v, 3 * u * u * v, u * u * u
    end = lambda p, axis: F.max(F.when(F.col("pos") == F.col(p), F.col(axis))).over(whole)
    rows = rows.withColumns({"ax": end("lo", "x"), "ay": end("lo", "y"), "bx": end("hi", "x"), "by": end("hi", "y")})
    t = {axis: F.col(axis) - (b0 + b1) * F.col(f"a{axis}") - (b2 + b3) * F.col(f"b{axis}") for axis in "xy"}
    dot = F.col("lx") * F.col("rx") + F.col("ly") * F.col("ry")
    sums = {"c00": b1 * b1, "c01": b1 * b2 * dot, "c11": b2 * b2, "x0": b1 * (F.col("lx") * t["x"] + F.col("ly") * t["y"]), "x1": b2 * (F.col("rx") * t["x"] + F.col("ry") * t["y"])}
    rows = rows.withColumns({k: F.sum(s).over(whole) for k, s in sums.items()})
    det = F.col("c00") * F.col("c11") - F.col("c01") * F.col("c01")
    solve = lambda e: F.when(F.abs(det) > 1e-9, F.try_divide(e, det)).otherwise(0.0)
    rows = rows.withColumns({"la": solve(F.col("x0") * F.col("c11") - F.col("x1") * F.col("c01")), "ra": solve(F.col("c00") * F.col("x1") - F.col("c01") * F.col("x0")), "chord": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))})
    # controls that would turn back lie a third of the chord off
    back = (F.least("la", "ra") < 1e-6 * F.col("chord")) | (F.col("hi") - F.col("lo") < 2)
    reach = lambda c: F.when(back, F.col("chord") / 3).otherwise(F.col(c))
    rows = rows.withColumns({f"{c}{axis}": F.col(f"{e}{axis}") + F.col(f"{s}{axis}") * reach(f"{s}a") for c, e, s in (("c", "a", "l"), ("d", "b", "r")) for axis in "xy"})
    inner = (F.col("pos") > F.col("lo")) & (F.col("pos") < F.col("hi"))
    rows = rows.withColumn("off", F.when(inner, F.hypot(F.col("x") - _point(u, "x"), F.col("y") - _point(u, "y"))).otherwise(0.0))
    worst = F.max(F.when(inner, F.struct(F.round("off", 9).alias("e"), (-F.col("pos")).alias("p")))).over(whole)
    rows = rows.withColumn("__w", worst)
    return rows.withColumns({"error": F.coalesce("__w.e", F.lit(0.0)), "worst": -F.col("__w.p")}).drop("__w", *sums, "la", "ra", "chord")


def _nearer(rows: DataFrame) -> DataFrame:
    """rows whose u is moved by a Newton step towards the nearest point of the curve."""
    u = F.col("u")
    v, of = 1 - u, lambda p, axis: F.col(f"{p}{axis}")
    top, bottom = F.lit(0.0), F.lit(0.0)
    for axis in "xy":
        first = 3 * (v * v * (of("c", axis) - of("a", axis)) + 2 * v * u * (of("d", axis) - of("c", axis)) + u * u * (of("b", axis) - of("d", axis)))
        second = 6 * (v * (of("d", axis) - 2 * of("c", axis) + of("a", axis)) + u * (of("b", axis) - 2 * of("d", axis) + of("c", axis)))
        gap = _point(u, axis) - F.col(axis)
        top, bottom = top + gap * first, bottom + first * first + gap * second
    moved = F.when(F.abs(bottom) < 1e-9, u).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u - F.try_divide(top, bottom))))
    return rows.withColumn("u", moved)


SEGMENT = ("lo", "hi", "ax", "ay", "cx", "cy", "dx", "dy", "bx", "by", "error")


def fit_segments(pieces: DataFrame, *keys: str, tolerance: float = TOLERANCE, retries: int = 1) -> DataFrame:
    """(keys, lo, hi, ax, ay, cx, cy, dx, dy, bx, by, error): cubic segments that join the pieces' ends, each within the tolerance of
    its points.

    A round fits all open segments at once, with one shuffle. One that is far off by up to RETRY tolerances has its
    parameters moved and is fitted again, `retries` times; one that stays off is split where it is worst, but not near an end, with
    one tangent for both parts. Segments of two points always hold. Raises if MOST_ROUNDS do not do.
    """
    names = [*keys, "lo", "hi", "pos", "x", "y", "lx", "ly", "rx", "ry"]
    now, done = _settled(pieces.select(names)), []
    for _ in range(MOST_ROUNDS):
        w = Window.partitionBy(*keys, "lo").orderBy("pos")
        step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
        rows = now.withColumn("__step", step).withColumn("u", F.sum("__step").over(w))
        total = F.max("u").over(Window.partitionBy(*keys, "lo"))
        rows = rows.withColumn("u", F.coalesce(F.try_divide(F.col("u"), total), F.lit(0.0))).drop("__step")
        fitted = _fitted(rows, *keys)
        for _ in range(retries):
            again = (F.col("error") >= tolerance) & (F.col("error") < RETRY * tolerance)
            kept = fitted.withColumn("__old", F.col("u"))
            moved = _nearer(kept).withColumn("u", F.when(again, F.col("u")).otherwise(F.col("__old"))).drop("__old")
            fitted = _fitted(moved.select(*names, "u"), *keys)
        fitted = _settled(fitted.select(*names, *SEGMENT[2:], "worst"))
        holds = (F.col("error") < tolerance) | (F.col("hi") - F.col("lo") < 2)
        done.append(fitted.filter(holds & (F.col("pos") == F.col("lo"))).select(*keys, *SEGMENT))
        left = fitted.filter(~holds)
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        margin = F.ceil((F.col("hi") - F.col("lo")) * LEAST_SHARE)
        cut = F.greatest(F.least(F.col("worst"), F.col("hi") - margin), F.col("lo") + margin).cast("int")
        left = left.withColumn("cut", cut)
        whole = Window.partitionBy(*keys, "lo")
        at = lambda k: F.max(F.when(F.col("pos") == F.col("cut") + k, F.struct("x", "y"))).over(whole)
        left = left.withColumns({"__p": at(-1), "__q": at(1)})
        tx, ty = _unit(F.col("__p.x") - F.col("__q.x"), F.col("__p.y") - F.col("__q.y"))
        before = left.filter("pos <= cut").select(*keys, "lo", F.col("cut").alias("hi"), "pos", "x", "y", "lx", "ly", tx.alias("rx"), ty.alias("ry"))
        after = left.filter("pos >= cut").select(*keys, F.col("cut").alias("lo"), "hi", "pos", "x", "y", (-tx).alias("lx"), (-ty).alias("ly"), "rx", "ry")
        now = _settled(before.unionByName(after))
    raise RuntimeError(f"segments still open after {MOST_ROUNDS} rounds")


def path_candidates(segments: DataFrame, outline: DataFrame, *keys: str, penalty: float = 0.35, per_node: float = 0.035) -> DataFrame:
    """(keys, node_count, parameter_count, max_error, budget, raster_error): the generic path of each outline. It ranks as if it used
    all of its budget of nodes, so a compact path is no cheaper than a named shape."""
    w = Window.partitionBy(*keys).orderBy("ord")
    first = F.first(F.struct("x", "y")).over(w)
    step = F.hypot(F.coalesce(F.lead("x").over(w), first["x"]) - F.col("x"), F.coalesce(F.lead("y").over(w), first["y"]) - F.col("y"))
    length = outline.withColumn("__d", step).groupBy(*keys).agg(F.sum("__d").alias("perimeter"))
    nodes = segments.groupBy(*keys).agg(F.count("*").alias("node_count"), F.max("error").alias("max_error"))
    budget = F.least(F.lit(MOST_NODES), F.greatest(F.lit(LEAST_NODES), F.round(F.col("perimeter") / NODE_PIXELS).cast("int")))
    out = nodes.join(length, [*keys]).withColumn("budget", budget)
    return out.select(*keys, "node_count", (2 * F.col("node_count")).alias("parameter_count"), "max_error", "budget", (F.lit(penalty) + F.greatest(F.lit(0), F.col("budget") - F.col("node_count")) * F.lit(per_node)).alias("raster_error"))
