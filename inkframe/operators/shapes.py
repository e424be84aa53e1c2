"""Fits per component beyond box statistics: ellipses, circles with cut-outs, quads by scan lines, smooth strokes, cut-out strokes,
arcs; and all of them as candidates of one choice.

Every fit is a chain of aggregates, so components may share a key space of any size. Pixels are read once: raster.bitmaps() makes of
them a settled row per component, its sums and its rows as words of bits, ink and boundary. A fit takes the gates that box
and sums can decide first, and unfolds the bits of what is left. A component without a fit has a row whose `fits` is false.

Joins name their method: Spark takes exploded pixels for no larger than the rows they come from and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import fit, raster

PI = 3.141592653589793
#: Least side, area error and boundary residual in pixels of an ellipse; aspect from which it is no circle.
ELLIPSE_SIDE, ELLIPSE_AREA, ELLIPSE_RESIDUAL, ELLIPSE_ASPECT = 9, 0.12, 0.75, 0.1
#: The same for tilted ones, with the largest 95th percentile, and the least tilt in degrees.
TILTED_RADIUS, TILTED_RESIDUAL, TILTED_TAIL, LEAST_TILT = 4.5, 1.1, 1.7, 4.0
#: The elliptic ring's side, aspect, inner and outer reach, widest stroke and largest area error.
RING_SIDE, RING_OVAL, RING_REACH, RING_STROKE, RING_ERROR = 8, 0.18, (0.3, 1.2), 0.8, 0.45
#: The circle's least diameter, aspect, area error, residual, spread, share of boundary that must be left, and area balance.
DISC_DIAMETER, DISC_ASPECT, DISC_AREA, DISC_RESIDUAL, DISC_SPREAD, DISC_SHARE, DISC_BALANCE = 3, 0.22, 0.35, 0.06, 0.12, 0.6, 0.12
LEAST_GAP = 4


def _box(pixels: DataFrame, *keys: str) -> DataFrame:
    return _sides(raster.component_geometry(pixels, *keys))


def _sides(box: DataFrame) -> DataFrame:
    return box.withColumns({"w": F.col("max_x") - F.col("min_x") + 1, "h": F.col("max_y") - F.col("min_y") + 1})


def _met(ink: DataFrame, rows: DataFrame, *keys: str, bits: str = "bits") -> DataFrame:
    """The pixels of the components of rows, with the columns of rows."""
    held = ink.select(*keys, *raster.BITMAP).join(rows.hint("shuffle_hash"), [*keys])
    return raster.bitmap_pixels(held, *rows.columns, bits=bits)


def _firsts(*names: str) -> list[Column]:
    return [F.first(c).alias(c) for c in names]


def _ink_at(x: Column, y: Column) -> Column:
    """Whether the pixel next to a place is ink."""
    column, row = F.round(x).cast("long"), F.round(y).cast("long")
    return F.exists(F.arrays_zip(F.col("ys").alias("y"), F.col("words").alias("word"), F.col("bits").alias("bits")), lambda r: (r["y"] == row) & (r["word"] == F.floor(column / raster.WORD)) & (F.call_function("getbit", r["bits"], F.pmod(column, F.lit(raster.WORD)).cast("int")) == 1))


def _packed(pixels: DataFrame, *keys: str, scalars: tuple[str, ...] = (), lists: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One settled row per component: its scalars, and its pixels as lists. A step that many others read costs a few bytes a pixel so."""
    held = pixels.groupBy(*keys).agg(*(F.first(c).alias(c) for c in scalars), F.collect_list(F.struct(*lists)).alias("__cells"))
    return raster._settled(held.select(*keys, *scalars, *(F.col(f"__cells.{c}").alias(c) for c in lists)))


def _unpacked(packed: DataFrame, *lists: str) -> DataFrame:
    rest = [c for c in packed.columns if c not in lists]
    return packed.select(*rest, F.explode(F.arrays_zip(*lists)).alias("__p")).select(*rest, *(f"__p.{c}" for c in lists))


def _ray_offset() -> Column:
    """How far a boundary pixel (x, y) is from the ellipse (cx, cy, rx, ry, ct, st) along its ray from the centre; null at the centre.
    ct and st are the cosine and sine of the ellipse's rotation."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    u, v = dx * F.col("ct") + dy * F.col("st"), dy * F.col("ct") - dx * F.col("st")
    d = F.sqrt(u * u + v * v)
    across = F.sqrt(F.col("ry") * u * F.col("ry") * u + F.col("rx") * v * F.col("rx") * v)
    return F.when(d > 0, F.abs(d - F.col("rx") * F.col("ry") * d / across))


def ellipse_fits(pixels: DataFrame, *keys: str, ink: DataFrame | None = None) -> DataFrame:
    """(keys, form, fits, cx, cy, rx, ry, rotation, stroke_width, residual, area_error, raster_error): the filled ellipse of each
    component, axis-aligned, or else tilted along the principal axis, or else an elliptic ring (form aligned, tilted, ring).

    Ovals of under 9 pixels and near-circles are left to other fits. A tilted one must keep its 95th percentile, by rank, which
    tells leaves and rounded bars from ellipses of the same mean residual. ink: raster.bitmaps() of the pixels, if at hand.
    """
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    upright = _sides(ink)
    longer, shorter = F.greatest("w", "h"), F.least("w", "h")
    aspect = 1 - shorter / longer
    area = F.col("area").cast("double")
    middle = {"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2, "rx": F.col("w") / 2, "ry": F.col("h") / 2}
    may = (shorter >= ELLIPSE_SIDE) & ~((longer <= 12) & (aspect < 0.15))
    upright = upright.withColumns(middle).withColumn("area_error", F.abs(area - PI * F.col("rx") * F.col("ry")) / (PI * F.col("rx") * F.col("ry")))
    oval = ("cx", "cy", "rx", "ry", "area_error")
    held = upright.filter(may & (aspect >= ELLIPSE_ASPECT) & (F.col("area_error") <= ELLIPSE_AREA)).withColumns({"ct": F.lit(1.0), "st": F.lit(0.0)})
    held = raster.bitmap_pixels(held, *keys, *oval, "ct", "st", bits="edges").groupBy(*keys).agg(F.coalesce(F.avg(_ray_offset()), F.lit(0.0)).alias("residual"), *_firsts(*oval))
    aligned = raster._settled(held.filter(F.col("residual") <= ELLIPSE_RESIDUAL))

    n, sx, sy = F.col("area"), F.col("sx"), F.col("sy")
    angle = F.atan2(2 * (n * F.col("sxy") - sx * sy), n * F.col("sxx") - sx * sx - (n * F.col("syy") - sy * sy)) / 2
    folded = F.when(angle <= -PI / 2, angle + PI).when(angle > PI / 2, angle - PI).otherwise(angle)
    left = upright.filter(may).join(aligned.select(*keys).hint("shuffle_hash"), [*keys], "left_anti").withColumns({"rotation": folded, "mx": sx / n, "my": sy / n})
    turned = F.least(F.abs("rotation"), F.abs(F.abs("rotation") - PI / 2)) >= LEAST_TILT * PI / 180
    left = left.filter(turned).withColumns({"ct": F.cos("rotation"), "st": F.sin("rotation")})
    along = (F.col("x") - F.col("mx")) * F.col("ct") + (F.col("y") - F.col("my")) * F.col("st")
    across = (F.col("y") - F.col("my")) * F.col("ct") - (F.col("x") - F.col("mx")) * F.col("st")
    # the farthest pixels of a component are on its boundary
    axis = ("area", "rotation", "mx", "my", "ct", "st")
    reach = raster.bitmap_pixels(left, *keys, *axis, bits="edges").groupBy(*keys).agg(*(f(e).alias(n) for n, f, e in (("u0", F.min, along), ("u1", F.max, along), ("v0", F.min, across), ("v1", F.max, across))), *_firsts(*axis))
    u, v = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    tilted = reach.withColumns({"rx": (F.col("u1") - F.col("u0")) / 2 + 0.5, "ry": (F.col("v1") - F.col("v0")) / 2 + 0.5, "cx": F.col("mx") + u * F.col("ct") - v * F.col("st"), "cy": F.col("my") + u * F.col("st") + v * F.col("ct")})
    tilted = tilted.withColumn("area_error", F.abs(area - PI * F.col("rx") * F.col("ry")) / (PI * F.col("rx") * F.col("ry")))
    slim = (F.least("rx", "ry") >= TILTED_RADIUS) & (1 - F.least("rx", "ry") / F.greatest("rx", "ry") >= ELLIPSE_ASPECT)
    tilted = tilted.filter(slim & (F.col("area_error") <= ELLIPSE_AREA)).select(*keys, *oval, "rotation", "ct", "st")
    tilted = _met(ink, tilted, *keys, bits="edges").withColumn("off", _ray_offset()).groupBy(*keys).agg(F.avg("off").alias("residual"), F.sort_array(F.collect_list("off")).alias("offs"), *_firsts(*oval, "rotation"))
    tail = F.get("offs", F.least(F.size("offs") - 1, F.floor(F.size("offs") * 0.95)).cast("int"))
    tilted = tilted.filter((F.col("residual") <= TILTED_RESIDUAL) & (tail <= TILTED_TAIL)).drop("offs")

    # with ink at its centre a component reaches inwards to 0.18 at most
    reachable = upright.filter((shorter >= RING_SIDE) & (aspect >= RING_OVAL) & ~_ink_at(F.col("cx"), F.col("cy")))
    d = F.sqrt(F.pow((F.col("x") - F.col("cx")) / F.col("rx"), 2) + F.pow((F.col("y") - F.col("cy")) / F.col("ry"), 2))
    axes = ("area", "cx", "cy", "rx", "ry")
    ring = raster.bitmap_pixels(reachable, *keys, *axes).groupBy(*keys).agg(F.min(d).alias("inner"), F.max(d).alias("outer"), *_firsts(*axes))
    mean, mid = (F.col("rx") + F.col("ry")) / 2, (F.col("inner") + F.col("outer")) / 2
    ring = ring.withColumn("stroke_width", F.greatest((F.col("outer") - F.col("inner")) * mean, F.lit(1.0)))
    full = PI * (F.col("rx") * F.col("ry") - (F.col("rx") - F.col("stroke_width")) * (F.col("ry") - F.col("stroke_width")))
    ring = ring.withColumn("area_error", F.when(full > 0, F.abs(area - full) / full))
    ring = ring.filter((F.col("inner") >= RING_REACH[0]) & (F.col("outer") <= RING_REACH[1]) & (F.col("stroke_width") <= RING_STROKE * mean) & (F.col("area_error") <= RING_ERROR)).drop("area")
    ring = _met(ink, ring, *keys).groupBy(*keys).agg(F.avg(F.abs(d - mid)).alias("band"), *_firsts(*(c for c in ring.columns if c not in keys)))
    ring = ring.filter(F.col("band") * mean <= F.col("stroke_width") * 0.5 + 0.5)

    row = lambda df, place, form, rx, ry, rotation, width, residual, error: df.select(*keys, F.struct(F.lit(place).alias("place"), F.lit(form).alias("form"), "cx", "cy", rx.alias("rx"), ry.alias("ry"), rotation.alias("rotation"), width.alias("stroke_width"), residual.alias("residual"), F.col("area_error"), error.alias("raster_error")).alias("f"))
    filled = F.col("area_error") + F.col("residual") * 0.05
    found = row(aligned, 0, "aligned", F.col("rx"), F.col("ry"), F.lit(0.0), F.lit(0.0), F.col("residual"), filled)
    found = found.unionByName(row(tilted, 1, "tilted", F.col("rx"), F.col("ry"), F.col("rotation"), F.lit(0.0), F.col("residual"), filled))
    found = found.unionByName(row(ring, 2, "ring", F.col("rx") * mid, F.col("ry") * mid, F.lit(0.0), F.col("stroke_width"), F.col("band"), F.col("area_error") * 0.2 + F.col("band")))
    best = found.groupBy(*keys).agg(F.min("f").alias("f"))
    return ink.select(*keys).join(best.hint("shuffle_hash"), [*keys], "left").select(*keys, "f.form", F.col("f").isNotNull().alias("fits"), *[f"f.{c}" for c in ("cx", "cy", "rx", "ry", "rotation", "stroke_width", "residual", "area_error", "raster_error")])


def sealed_gaps(pixels: DataFrame, *keys: str, least: int = LEAST_GAP, ink: DataFrame | None = None) -> DataFrame:
    """(keys, gap_id, x, y): the cells of each component's enclosed gaps of at least `least` cells; a gap that reaches the bounds is open."""
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    # an enclosed gap lies between the first and the last pixel of its rows
    gaps = raster.bitmap_gaps(ink.filter(F.col("between") >= least), *keys)
    gaps = raster.connected_components(gaps, *keys, min_area=least).withColumnRenamed("component_id", "gap_id")
    box = ink.select(*keys, "min_x", "min_y", "max_x", "max_y")
    edge = (F.col("x") == F.col("min_x")) | (F.col("x") == F.col("max_x")) | (F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y"))
    is_open = F.max(edge).over(Window.partitionBy(*keys, "gap_id"))
    return gaps.join(box.hint("shuffle_hash"), [*keys]).withColumn("open", is_open).filter("not open").select(gaps.columns)


def boundary_without_gaps(pixels: DataFrame, *keys: str, gaps: DataFrame | None = None, ink: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, gap_edge): boundary pixels, and whether one of the eight cells around is in an enclosed gap."""
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    held = sealed_gaps(pixels, *keys, ink=ink) if gaps is None else gaps
    # the cells around gaps as words: across from each cell, up and down from each word
    wide = held.select(*keys, "y", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("x"))
    words = wide.groupBy(*keys, "y", F.shiftright("x", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("near"))
    words = words.withColumn("y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1))).groupBy(*keys, "y", "word").agg(F.bit_or("near").alias("near"))
    rows = _unpacked(ink.select(*keys, F.col("ys").alias("y"), F.col("words").alias("word"), F.col("edges").alias("edge")), "y", "word", "edge").filter("edge <> 0")
    rows = rows.join(words.hint("shuffle_hash"), [*keys, "y", "word"], "left").fillna(0, ["near"])
    cells = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(raster.WORD - 1)))).filter("shiftrightunsigned(edge, __i) & 1L = 1L")
    return cells.select(*keys, (F.col("word") * raster.WORD + F.col("__i")).alias("x"), "y", F.expr("shiftrightunsigned(near, __i) & 1L = 1L").alias("gap_edge"))


def circle_fits(pixels: DataFrame, *keys: str, ink: DataFrame | None = None) -> DataFrame:
    """(keys, fits, refitted, cx, cy, r, residual, spread, gap_area, raster_error): the filled circle of each component.

    Enclosed gaps add inner boundary that spoils a fit: a circle that fits badly is fitted again to the boundary away
    from its gaps, if most of it is, and then its area less the gaps' must match the ink. The circle of the bounds is taken
    where it fits nearly as well. Large circles must have a small residual and an even distance from the centre.
    ink: raster.bitmaps() of the pixels, if at hand.
    """
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    diameter = F.greatest("w", "h")
    aspect, full = F.abs(F.col("w") - F.col("h")) / diameter, PI * F.pow(diameter / 2, 2)
    box = _sides(ink).withColumns({"diameter": diameter, "aspect_error": aspect, "area_error": F.abs(F.col("area") - full) / full})
    round_box = box.filter((F.col("diameter") >= DISC_DIAMETER) & (F.col("aspect_error") <= DISC_ASPECT) & (F.col("area_error") <= DISC_AREA))
    spare = {"spare_x": F.col("sx") / F.col("area"), "spare_y": F.col("sy") / F.col("area"), "spare_r": F.sqrt(F.col("area") / PI)}
    bounds = {"box_x": (F.col("min_x") + F.col("max_x")) / 2, "box_y": (F.col("min_y") + F.col("max_y")) / 2, "box_r": F.greatest((F.col("diameter") - 1) / 2, F.lit(0.5))}
    kept = round_box.withColumns(spare | bounds).select(*keys, "area", "between", "diameter", "aspect_error", "area_error", *spare, *bounds)

    def fitted(points: DataFrame, rows: DataFrame, again: DataFrame | None = None) -> DataFrame:
        """rows with free and box, the circle fitted to the points, or one of the ink's area about its centroid, and that of the bounds,
        both with residual (mean distance from the circle over its radius) and spread (deviation of the distances from the centre)."""
        kasa = fit.kasa_circle(points, *keys).join(rows.hint("shuffle_hash"), [*keys])
        bad = F.coalesce(F.col("r").isNull() | F.isnan("r") | (F.col("r") <= 0) | (F.col("n") < 3), F.lit(True))
        free = kasa.select(*rows.columns, "n", *(F.when(bad, F.col(s)).otherwise(F.col(c)).alias(c) for c, s in (("cx", "spare_x"), ("cy", "spare_y"), ("r", "spare_r"))), bad.alias("bad"))
        free = raster._settled(free)
        met = _met(ink, free, *keys, bits="edges") if again is None else again.join(free.hint("shuffle_hash"), [*keys])
        near = lambda x, y, r: (F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y)), F.first(r))
        parts = []
        for name, (d, r), at in (("free", near("cx", "cy", "r"), "r"), ("box", near("box_x", "box_y", "box_r"), "box_r")):
            parts += [(F.avg(F.abs(d - F.col(at))) / r).alias(f"{name}_residual"), (F.stddev_pop(d) / r).alias(f"{name}_spread")]
        sums = met.groupBy(*keys).agg(*parts, *_firsts(*(c for c in free.columns if c not in keys)))
        circle = lambda x, y, r, residual, spread: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"), F.col(r).alias("r"), residual.alias("residual"), F.col(spread).alias("spread"))
        return sums.withColumns({"free": circle("cx", "cy", "r", F.when(F.col("bad"), 0.0).otherwise(F.col("free_residual")), "free_spread"), "box": circle("box_x", "box_y", "box_r", F.col("box_residual"), "box_spread")}).select(*rows.columns, "n", "free", "box")

    once = raster._settled(fitted(raster.bitmap_pixels(round_box, *keys, bits="edges"), kept).withColumnRenamed("n", "n_edge"))
    hollow = ink.join(once.filter(F.col("between") >= LEAST_GAP).select(*keys).hint("shuffle_hash"), [*keys], "left_semi")
    gaps = _packed(sealed_gaps(pixels, *keys, ink=hollow), *keys)
    once = once.join(gaps.select(*keys, F.size("x").cast("long").alias("gap_area")).hint("shuffle_hash"), [*keys], "left").fillna(0, ["gap_area"])
    # only those that fit badly and have gaps are fitted again
    spoilt = raster._settled(once.filter((F.col("free.residual") > DISC_RESIDUAL) & (F.col("gap_area") > 0)))
    named = spoilt.select(*keys)
    edge = boundary_without_gaps(pixels, *keys, gaps=_unpacked(gaps.join(named.hint("shuffle_hash"), [*keys], "left_semi"), "x", "y"), ink=ink.join(named.hint("shuffle_hash"), [*keys], "left_semi"))
    outer = _unpacked(_packed(edge.filter("not gap_edge"), *keys), "x", "y")
    out = fitted(outer, spoilt.select(*kept.columns), outer).select(*keys, F.col("n").alias("n_outer"), F.col("free").alias("out_free"), F.col("box").alias("out_box"))
    both = once.join(out.hint("shuffle_hash"), [*keys], "left")
    again = (F.col("free.residual") > DISC_RESIDUAL) & (F.col("gap_area") > 0) & (F.col("n_outer") >= 8) & (F.col("n_outer") >= DISC_SHARE * F.col("n_edge"))
    both = both.withColumn("refitted", F.coalesce(again, F.lit(False)))
    both = both.withColumns({n: F.when(F.col("refitted"), F.col(f"out_{n}")).otherwise(F.col(n)) for n in ("free", "box")})
    left = PI * F.col("free.r") * F.col("free.r") - F.col("gap_area")
    balanced = ~F.col("refitted") | F.coalesce((left > 0) & (F.abs(F.col("area") - left) / left <= DISC_BALANCE), F.lit(False))
    of_box = F.col("box.residual") <= F.greatest(F.lit(DISC_RESIDUAL), F.col("free.residual") + 0.02)
    both = both.withColumn("c", F.when(of_box, F.col("box")).otherwise(F.col("free")))
    even = (F.col("diameter") < 12) | ((F.col("c.residual") <= DISC_RESIDUAL) & (F.col("c.spread") <= DISC_SPREAD))
    found = both.filter(balanced & even).select(*keys, "refitted", "c.*", "gap_area", (F.col("area_error") + F.col("aspect_error") + F.col("c.residual")).alias("raster_error"))
    return ink.select(*keys).join(found.hint("shuffle_hash"), [*keys], "left").select(*keys, F.col("r").isNotNull().alias("fits"), F.coalesce("refitted", F.lit(False)).alias("refitted"), "cx", "cy", "r", "residual", "spread", "gap_area", "raster_error")


def _corners(ink: DataFrame, *keys: str) -> DataFrame:
    """(keys, corners) as fit.extreme_quad() finds them. A corner is a least or largest number, of place and tie, so that no rows are sorted for it."""
    dx, dy = ((F.col(c) - F.col(f"min_{c}")).cast("long") for c in "xy")
    along, against = (k * (1 << 32) + dy for k in (dx + dy, dy - dx))
    found = raster.bitmap_pixels(ink, *keys, "min_x", "min_y", bits="edges").groupBy(*keys).agg(*_firsts("min_x", "min_y"), F.min(along).alias("p0"), F.min(against).alias("p1"), F.max(along).alias("p2"), F.max(against).alias("p3"))

    def corner(name: str, sign: int) -> Column:
        y = F.col(name).bitwiseAND((1 << 32) - 1)
        x = sign * (F.shiftright(name, 32) - y)
        return F.struct((F.col("min_x") + x).cast("double").alias("x"), (F.col("min_y") + y).cast("double").alias("y"))

    corners = F.array(corner("p0", 1), corner("p1", -1), corner("p2", 1), corner("p3", -1))
    return found.select(*keys, corners.alias("corners")).select(*keys, F.when(F.size(F.array_distinct("corners")) == 4, F.col("corners")).alias("corners"))


def quad_fill_error(pixels: DataFrame, quads: DataFrame, *keys: str, ink: DataFrame | None = None) -> DataFrame:
    """(keys, expected, missing, extra, fill_error): scan lines of each quad against the ink of their rows.

    quads: (keys, corners), four structs (x, y), in order. A row reaches from its least to its largest crossing, each rounded half
    to even. fill_error is (missing + extra) / expected; 1 where the quad has no height or no corners. Ink in rows above or
    below the quad counts for nothing. ink: raster.bitmaps() of the pixels, if at hand.
    """
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    ends = [f"{c}{i}" for i in range(4) for c in "xy"]
    quad = quads.filter("corners is not null").select(*keys, *(F.col("corners")[int(e[1])][e[0]].cast("double").alias(e) for e in ends))

    def crossings() -> tuple[Column, Column]:
        """Where row y enters and leaves the quad; null where it does not meet it."""
        low, high = [], []
        for i in range(4):
            ax, ay, bx, by = (F.col(f"{c}{k}") for k in (i, (i + 1) % 4) for c in "xy")
            at = ax + (bx - ax) * F.try_divide(F.col("y") - ay, by - ay)
            met = F.col("y").between(F.least(ay, by), F.greatest(ay, by))
            low.append(F.when(met, F.when(ay == by, F.least(ax, bx)).otherwise(at)))
            high.append(F.when(met, F.when(ay == by, F.greatest(ax, bx)).otherwise(at)))
        return F.bround(F.least(*low), 0).cast("int"), F.bround(F.greatest(*high), 0).cast("int")

    left, right = crossings()
    top, bottom = F.ceil(F.least("y0", "y1", "y2", "y3")).cast("int"), F.floor(F.greatest("y0", "y1", "y2", "y3")).cast("int")
    rows = quad.withColumn("y", F.explode(F.sequence(top, F.greatest(top, bottom)))).select(*keys, "y", left.alias("left"), right.alias("right")).filter("left is not null")
    listed = rows.groupBy(*keys).agg(F.sum(F.col("right") - F.col("left") + 1).alias("expected"), (F.max("y") > F.min("y")).alias("tall"))
    # a row of ink finds its own of the quad by the same crossings, and is joined by component alone
    met = _unpacked(ink.select(*keys, F.col("ys").alias("y"), F.col("words").alias("word"), "bits").join(quad.hint("shuffle_hash"), [*keys]), "y", "word", "bits")
    start = F.col("word") * raster.WORD
    met = met.select(*keys, "bits", "word", left.alias("left"), right.alias("right")).filter("left is not null")
    met = met.select(*keys, "bits", F.greatest(F.col("left") - start, F.lit(0)).cast("int").alias("low"), F.least(F.col("right") - start, F.lit(raster.WORD - 1)).cast("int").alias("high"))
    inside = F.when(F.col("low") <= F.col("high"), F.expr("bit_count(bits & shiftleft(-1L, low) & shiftrightunsigned(-1L, 63 - high))")).otherwise(0)
    hits = met.groupBy(*keys).agg(F.sum(inside).alias("hit"), F.sum(F.bit_count("bits") - inside).alias("extra"))
    sums = listed.join(hits.hint("shuffle_hash"), [*keys], "left").select(*keys, "tall", "expected", (F.col("expected") - F.coalesce("hit", F.lit(0))).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))
    error = F.when(F.col("tall"), F.try_divide(F.col("missing") + F.col("extra"), F.col("expected")))
    return quads.select(*keys).join(sums.hint("shuffle_hash"), [*keys], "left").select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("expected", "missing", "extra")), F.coalesce(error, F.lit(1.0)).alias("fill_error"))


#: Of strokes the least columns, columns of a fold, least length, densest box, length over width, bow over chord and variation of the width.
STROKE_COLUMNS, FOLD_SHARE, STROKE_LENGTH, STROKE_DENSITY, STROKE_RATIO, STROKE_BOW, STROKE_VARIATION, CONTROLS = 5, 0.1, 4.0, 0.55, 3.0, 0.03, 0.35, 7


def centerlines(pixels: DataFrame, *keys: str, ink: DataFrame | None = None) -> DataFrame:
    """(keys, w, h, area, functional, line): each component read along its longer side. line has the mean of each column,
    smoothed over three, as structs (x, y, n); it is functional with five columns or more of which few are folds, far wider than
    the typical one. A component's line is as long as its side."""
    wide = F.col("w") >= F.col("h")
    at, other = F.when(wide, F.col("x")).otherwise(F.col("y")), F.when(wide, F.col("y")).otherwise(F.col("x"))
    if ink is None:
        sized = pixels.select(*keys, "x", "y").join(_box(pixels, *keys).select(*keys, "w", "h", "area").hint("shuffle_hash"), [*keys])
    else:
        sized = raster.bitmap_pixels(_sides(ink), *keys, "w", "h", "area")
    columns = sized.groupBy(*keys, "w", "h", "area", at.alias("k")).agg(F.avg(other).alias("v"), (F.max(other) - F.min(other) + 1).alias("span"), F.count("*").alias("n"))
    near = Window.partitionBy(*keys).orderBy("k").rowsBetween(-1, 1)
    columns = columns.withColumn("v", F.avg("v").over(near))
    point = F.struct("k", F.when(wide, F.col("k").cast("double")).otherwise(F.col("v")).alias("x"), F.when(wide, F.col("v")).otherwise(F.col("k").cast("double")).alias("y"), "n")
    held = columns.groupBy(*keys, "w", "h", "area").agg(F.array_sort(F.collect_list(point)).alias("line"), F.sort_array(F.collect_list("span")).alias("spans"))
    typical = F.get("spans", F.floor(F.size("spans") / 2).cast("int"))
    folds = F.size(F.filter("spans", lambda s: s > 2 * typical + 2))
    functional = (F.size("spans") >= STROKE_COLUMNS) & (folds <= FOLD_SHARE * F.size("spans"))
    return held.select(*keys, "w", "h", "area", functional.alias("functional"), F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["n"].alias("n"))).alias("line"))


def _pairs(points: Column) -> Column:
    """Neighbouring points as structs (a, b)."""
    return F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _length(points: Column) -> Column:
    return _sum(F.transform(_pairs(points), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])))


def _from_chord(point: Column, a: Column, b: Column) -> Column:
    """Signed distance of a point from the line through a and b; from a where they are one point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    d = F.hypot(dx, dy)
    return F.when(d > 0, ((point["x"] - a["x"]) * dy - (point["y"] - a["y"]) * dx) / d).otherwise(F.hypot(point["x"] - a["x"], point["y"] - a["y"]))


def curvature_jitter(points: Column) -> Column:
    """Mean change of the turn from one point to the next, of structs (x, y); 0 for under four points."""
    heading = F.transform(_pairs(points), lambda p: F.atan2(p["b"]["y"] - p["a"]["y"], p["b"]["x"] - p["a"]["x"]))
    turns = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.pmod(b - a + PI, F.lit(2 * PI)) - PI)
    jumps = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.abs(b - a))
    mean = F.transform(F.array(heading), lambda h: F.transform(F.array(turns(h)), lambda t: F.transform(F.array(jumps(t)), lambda j: F.try_divide(_sum(j), F.size(j)))[0])[0])[0]
    return F.when(F.size(points) >= 4, mean).otherwise(0.0)


def _may_be_stroke() -> Column:
    """What the box tells of a smooth stroke: long enough, and sparse."""
    return (F.greatest("w", "h") >= 2 * STROKE_LENGTH) & (F.col("area") <= STROKE_DENSITY * F.col("w") * F.col("h"))


def smooth_strokes(pixels: DataFrame, *keys: str, most: int = CONTROLS, ink: DataFrame | None = None) -> DataFrame:
    """(keys, fits, path_length, stroke_width, bow, residual, jitter, width_variance, controls): thin curved bands as a centreline
    through at most seven evenly taken points.

    It fits if the box is sparse, the band long for its width, the line bows, and the width, read at the points across the
    line, varies little. residual is the mean distance of the line from the polyline of the points. ink: raster.bitmaps() of
    the pixels, if at hand; then only strokes that fit have a row.
    """
    lines = centerlines(pixels, *keys, ink=None if ink is None else _sides(ink).filter(_may_be_stroke()))
    if ink is not None:
        lines = lines.filter("functional")
    lines = raster._settled(lines)
    last = F.size("line") - 1
    picked = F.when(F.size("line") <= most, F.col("line")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("line", F.bround(last * i / (most - 1), 0).cast("int"))))
    df = lines.withColumns({"controls": picked, "path_length": _length(F.col("line"))})
    df = df.withColumn("stroke_width", F.greatest(F.col("area") / F.greatest("path_length", F.lit(1.0)), F.lit(1.0)))
    a, b = F.get("controls", F.lit(0)), F.get("controls", F.size("controls") - 1)
    chord = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    bows = F.array_max(F.transform(F.slice("controls", 2, F.greatest(F.size("controls") - 2, F.lit(0))), lambda p: F.abs(_from_chord(p, a, b))))
    df = df.withColumn("bow", F.coalesce(bows, F.lit(0.0)) / F.greatest(chord, F.lit(1.0))).withColumn("chord", chord)
    wide = F.col("w") >= F.col("h")
    slope = lambda p: F.coalesce(F.when(wide, F.try_divide(p["b"]["y"] - p["a"]["y"], p["b"]["x"] - p["a"]["x"])).otherwise(F.try_divide(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])), F.lit(0.0))
    around = F.transform("controls", lambda p, i: F.struct(p["n"].alias("n"), F.get("controls", F.greatest(i - 1, F.lit(0))).alias("a"), F.get("controls", F.least(i + 1, F.size("controls") - 1)).alias("b")))
    widths = F.transform(around, lambda p: F.greatest(p["n"] / F.sqrt(1 + slope(p) * slope(p)), F.lit(1.0)))
    df = df.withColumn("widths", widths).withColumn("mean_width", _sum(F.col("widths")) / F.size("widths"))
    df = df.withColumn("width_variance", F.sqrt(_sum(F.transform("widths", lambda x: F.pow(x - F.col("mean_width"), 2))) / F.size("widths")) / F.col("mean_width"))
    thin = (F.col("stroke_width") <= 0.8 * F.least("w", "h")) & (F.col("path_length") >= STROKE_RATIO * F.col("stroke_width"))
    fits = F.col("functional") & _may_be_stroke() & (F.col("path_length") >= 2 * STROKE_LENGTH) & thin & (F.col("chord") > 0) & (F.col("bow") >= STROKE_BOW) & (F.col("width_variance") <= STROKE_VARIATION)
    # settled: a filter by fits would repeat all steps of each gate, and what only strokes that fit need comes after
    df = raster._settled(df.select(*keys, fits.alias("fits"), "line", "controls", "path_length", "stroke_width", "bow", "width_variance"))
    df = df if ink is None else df.filter("fits")
    to_part = lambda p, s: F.transform(F.array(F.struct((s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"))), lambda d: F.transform(F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((p["x"] - s["a"]["x"]) * d["dx"] + (p["y"] - s["a"]["y"]) * d["dy"], d["dx"] * d["dx"] + d["dy"] * d["dy"]), F.lit(0.0))))), lambda t: F.hypot(p["x"] - s["a"]["x"] - d["dx"] * t, p["y"] - s["a"]["y"] - d["dy"] * t))[0])[0]
    residual = F.transform(F.array(_pairs(F.col("controls"))), lambda parts: _sum(F.transform("line", lambda p: F.array_min(F.transform(parts, lambda s: to_part(p, s))))))[0] / F.size("line")
    df = df.withColumn("residual", F.coalesce(residual, F.lit(0.0))).withColumn("jitter", curvature_jitter(F.col("controls")))
    return df.select(*keys, "fits", "path_length", "stroke_width", "bow", "residual", "jitter", "width_variance", F.transform("controls", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("controls"))


def cutout_strokes(pixels: DataFrame, *keys: str, least_length: float = STROKE_LENGTH, most_width: float | None = None) -> DataFrame:
    """(keys, gap_id, form, path_length, stroke_width, centerline): thin enclosed gaps of a component as overlay strokes.

    form is straight, bowed (through the place farthest from the chord) or winding (up to seven points; it leaves the chord on
    both sides). A gap is a stroke if its line is functional, long enough, and no wider than most_width; without that, than a twentieth
    of the host's shorter side, within 3 and 8. Other gaps, such as the inside of a ring, and open ones are no strokes.
    """
    host = _box(pixels, *keys).select(*keys, F.greatest(F.lit(3.0), F.least(F.lit(8.0), F.bround(F.least("w", "h") * 0.05, 0))).alias("host_width"), (F.col("max_x") - F.col("min_x")).alias("dx"), (F.col("max_y") - F.col("min_y")).alias("dy"))
    lines = centerlines(sealed_gaps(pixels, *keys, least=int(least_length)), *keys, "gap_id").filter("functional").join(host.filter((F.col("dx") >= least_length) & (F.col("dy") >= 3)).hint("shuffle_hash"), [*keys])
    df = lines.withColumn("path_length", F.greatest(_length(F.col("line")), F.size("line").cast("double"))).withColumn("stroke_width", F.greatest(F.col("area") / F.col("path_length"), F.lit(1.0)))
    limit = F.col("host_width") if most_width is None else F.lit(float(most_width))
    df = df.filter((F.col("path_length") >= least_length) & (F.col("stroke_width") <= limit))
    a, b = F.get("line", F.lit(0)), F.get("line", F.size("line") - 1)
    df = df.withColumn("off", F.transform("line", lambda p: F.round(_from_chord(p, a, b), 9)))
    bend = F.greatest(F.lit(1.0), F.col("stroke_width") * 0.6)
    winding = (F.array_max("off") >= bend) & (-F.array_min("off") >= bend)
    farthest = F.array_max(F.transform("off", lambda d, i: F.struct(F.abs(d).alias("d"), (-i).alias("i"))))
    bowed = farthest["d"] >= F.greatest(F.lit(1.0), F.col("stroke_width") * 0.75)
    last = F.size("line") - 1
    seven = F.when(F.size("line") <= CONTROLS, F.col("line")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(CONTROLS - 1)), lambda i: F.get("line", F.bround(last * i / (CONTROLS - 1), 0).cast("int"))))
    line = F.when(winding, seven).when(bowed, F.array(a, F.get("line", -farthest["i"]), b)).otherwise(F.array(a, b))
    form = F.when(winding, "winding").when(bowed, "bowed").otherwise("straight")
    return df.select(*keys, "gap_id", form.alias("form"), "path_length", "stroke_width", F.transform(line, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("centerline"))


#: An arc's least and largest span, densest box, widest band over the radius, largest midpoint residual, and least bow.
ARC_SPAN, ARC_DENSITY, ARC_BAND, ARC_RESIDUAL, ARC_BOW, ARC_TAPER, TAPER_BAND = (0.3, 5.9), 0.55, 0.9, 0.42, 0.1, 1.8, 4.0


def _turned(angle: Column) -> Column:
    """The angle within -pi and pi."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def arc_candidates(pixels: DataFrame, *keys: str, ink: DataFrame | None = None) -> DataFrame:
    """(keys, fits, cx, cy, r, span, stroke_width, midpoint_residual, taper, bow, raster_error): thin open bands along a circle.

    A circle is fitted to all pixels, and its band is cut into bins by angle; on shallow arcs that circle is too small, so a second
    one is fitted to the bins' middles, which lie on the stroke's centreline. Bands that leave it (parabolas), that taper
    (crescents), that have a wide gap, or that hardly bow are no arcs. The width is the mean of two estimates, one too small
    and one too large: area over length, and the spread of the distances. Round caps are taken off the span.
    ink: raster.bitmaps() of the pixels, if at hand.
    """
    ink = raster.bitmaps(pixels, *keys) if ink is None else ink
    may = (F.greatest("w", "h") - 1 >= STROKE_LENGTH) & (F.least("w", "h") >= 3) & (F.col("area") <= ARC_DENSITY * F.col("w") * F.col("h")) & (F.col("area") >= 8)
    first = fit.circle_of_sums(_sides(ink).filter(may).withColumnRenamed("area", "n"))
    first = first.filter((F.col("r") >= 2) & (F.col("r") <= 4 * F.greatest("w", "h"))).withColumnRenamed("n", "area")

    # distance and angle from the circle's centre; angles are taken against their mean
    d, t = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    mean = F.atan2(F.sum(F.sin(t)), F.sum(F.cos(t)))
    circle = ("w", "h", "area", "cx", "cy", "r")
    # gate by gate, what is one row per component is settled, and pixels are unfolded for what is left
    held = raster.bitmap_pixels(first, *keys, *circle).groupBy(*keys).agg(mean.alias("mean"), F.min(d).alias("inner"), F.max(d).alias("outer"), *_firsts(*circle))
    held = raster._settled(held.withColumn("band", F.greatest(F.col("outer") - F.col("inner"), F.lit(1.0))).filter(F.col("band") <= ARC_BAND * F.col("r")))
    a, span = _turned(t - F.col("mean")), F.col("a1") - F.col("a0")
    off = F.avg(F.abs(d - (F.col("inner") + F.col("outer")) / 2))
    circle = (*circle, "mean", "band")
    held = _met(ink, held, *keys).groupBy(*keys).agg(F.min(a).alias("a0"), F.max(a).alias("a1"), off.alias("band_residual"), *_firsts(*circle))
    held = raster._settled(held.filter((F.col("band_residual") <= F.col("band") * 0.5 + 0.5) & span.between(*ARC_SPAN)))
    bins = F.greatest(F.lit(8), F.least(F.lit(48), F.floor(F.col("area") / 4)))
    at = _met(ink, held, *keys).withColumn("a", a).withColumn("bin", F.floor(F.round((F.col("a") - F.col("a0")) / span * (bins - 1) + 0.5, 9)).cast("int"))
    held = at.groupBy(*keys).agg(*_firsts("w", "h", "area", "band", "band_residual", "a0", "a1"), F.sort_array(F.collect_list(F.struct("a", "x", "y", "bin"))).alias("cells"))
    angles = F.col("cells.a")
    gap = F.coalesce(F.array_max(F.zip_with(F.slice(angles, 2, F.size(angles)), F.slice(angles, 1, F.size(angles) - 1), lambda b, a: b - a)), F.lit(0.0))
    held = held.withColumn("gap", gap).filter(F.col("gap") <= F.greatest(F.lit(0.35), span * 0.2))
    held = raster._settled(held.select(*keys, "w", "h", "area", "band", "band_residual", *(F.col(f"cells.{c}").alias(c) for c in ("x", "y", "bin"))))
    cells = _unpacked(held, "x", "y", "bin")
    held = held.drop("x", "y", "bin")
    middles = cells.groupBy(*keys, "bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    second = raster._settled(fit.kasa_circle(middles, *keys).filter((F.col("n") >= 5) & (F.col("r") >= 2)).drop("n"))
    leaves = middles.join(second.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg(F.avg(F.abs(d - F.col("r"))).alias("midpoint_residual"))

    around = cells.join(second.hint("shuffle_hash"), [*keys]).groupBy(*keys).agg(mean.alias("mean"), F.collect_list(F.struct(d.alias("d"), t.alias("t"))).alias("cells"))
    turned = F.transform("cells", lambda c: F.struct(c["d"].alias("d"), _turned(c["t"] - F.col("mean")).alias("a")))
    around = around.select(*keys, turned.alias("cells")).select(*keys, "cells", F.array_min(F.col("cells.a")).alias("a0"), F.array_max(F.col("cells.a")).alias("a1"), F.array_sort(F.col("cells.d")).alias("ds"))
    around = raster._settled(around.filter(span > 0))
    tenth = lambda values, share: F.get(values, F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int"))
    part = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.round((F.col("c.a") - F.col("a0")) / span * 8, 9))))
    eighths = around.select(*keys, "a0", "a1", F.explode("cells").alias("c")).groupBy(*keys, part.alias("part")).agg(F.sort_array(F.collect_list("c.d")).alias("ds")).filter(F.size("ds") >= 6)
    wide = F.greatest(tenth(F.col("ds"), 0.9) - tenth(F.col("ds"), 0.1), F.lit(0.5))
    taper = eighths.withColumn("wide", wide).groupBy(*keys).agg(F.when(F.count("*") >= 3, F.max("wide") / F.min("wide")).otherwise(1.0).alias("taper"))
    around = around.select(*keys, "a0", "a1", F.col("cells.a").alias("angles"), tenth(F.col("ds"), 0.1).alias("low"), tenth(F.col("ds"), 0.9).alias("high"))
    df = held.join(second.hint("shuffle_hash"), [*keys]).join(leaves.hint("shuffle_hash"), [*keys]).join(around.hint("shuffle_hash"), [*keys]).join(taper.hint("shuffle_hash"), [*keys], "left").withColumn("taper", F.coalesce("taper", F.lit(1.0)))
    long = span.between(*ARC_SPAN)
    df = df.withColumn("stroke_width", F.greatest((F.col("area") / F.greatest(span * F.col("r"), F.lit(1.0)) + (F.col("high") - F.col("low")) / 0.8 + 1) / 2, F.lit(1.0)))
    df = df.withColumn("cap", F.asin(F.least(F.lit(0.95), F.col("stroke_width") / 2 / F.greatest("r", F.lit(1.0)))))
    count = lambda ok: F.size(F.filter("angles", ok))
    df = raster._settled(df.withColumns({"at_start": count(lambda v: v < F.col("a0") + F.col("cap")), "at_end": count(lambda v: v > F.col("a1") - F.col("cap"))}).drop("angles"))
    full = F.greatest(F.col("cap") * F.col("r") * F.col("stroke_width"), F.lit(1.0))
    capped = (F.col("cap") > 0.01) & (F.col("stroke_width") >= 4)
    cut = lambda c: F.when(capped & (F.col(c) / full < 0.9), F.col("cap")).otherwise(0.0)
    df = df.withColumn("long", long).withColumns({"a0": F.col("a0") + cut("at_start"), "a1": F.col("a1") - cut("at_end")}).withColumn("span", span)
    chord = 2 * F.col("r") * F.sin(F.col("span") / 2)
    sagitta = F.col("r") * (1 - F.cos(F.col("span") / 2))
    df = df.withColumns({"chord": chord, "sagitta": sagitta}).withColumn("bow", F.col("sagitta") / F.greatest("chord", F.lit(1.0)))
    even = (F.col("band") < TAPER_BAND) | (F.col("taper") <= ARC_TAPER)
    df = df.filter(F.col("long") & (F.col("span") >= ARC_SPAN[0]) & (F.col("midpoint_residual") <= ARC_RESIDUAL) & even & (F.col("chord") >= STROKE_LENGTH) & (F.col("sagitta") >= 1) & (F.col("bow") >= ARC_BOW))
    names = ("cx", "cy", "r", "span", "stroke_width", "midpoint_residual", "taper", "bow")
    df = df.select(*keys, *names, (F.col("band_residual") / F.greatest("band", F.lit(1.0)) * 0.1).alias("raster_error"))
    return ink.select(*keys).join(df.hint("shuffle_hash"), [*keys], "left").select(*keys, F.col("r").isNotNull().alias("fits"), *names, "raster_error")


def primitive_candidates(pixels: DataFrame, *keys: str, paths: DataFrame | None = None) -> DataFrame:
    """(keys, ord, kind, raster_error, node_count, parameter_count): for each component, every primitive that fits it, in a fixed
    order, and the generic path, which always stands.

    Pixels are read once, and all fits read their settled bitmaps. The fits' own gates decide; box statistics are left for rectangles and straight strokes. paths: (keys, raster_error, node_count,
    parameter_count) of the outlines, as curves.path_candidates() makes them; without it the path has the fixed penalty and nodes.
    """
    ink = raster.bitmaps(pixels, *keys)
    box = _sides(ink).withColumn("fill_error", 1 - F.col("area") / (F.col("w") * F.col("h")))
    longer, shorter, fill = F.greatest("w", "h"), F.least("w", "h"), F.col("fill_error")
    row = lambda place, kind, error, nodes, parameters: F.struct(F.lit(place).alias("ord"), kind.alias("kind"), F.round(error, 9).alias("raster_error"), F.lit(nodes).alias("node_count"), parameters.alias("parameter_count"))
    # with ink at its centroid a component reaches inwards to 0.21 at most, and a ring's outer radius is 3 at least
    open_ = box.filter((longer >= 6) & (1 - shorter / longer <= fit.RING_ASPECT) & ~_ink_at(F.col("sx") / F.col("area"), F.col("sy") / F.col("area")))
    ring = fit.ring_fit(raster.bitmap_pixels(open_, *keys), *keys).filter("is_ring").select(*keys, row(0, F.lit("stroke_circle"), F.col("area_error"), 1, F.lit(4)).alias("c"))
    discs = circle_fits(pixels, *keys, ink=ink).filter("fits").select(*keys, row(1, F.lit("circle"), F.col("raster_error"), 1, F.lit(3)).alias("c"))
    form = F.col("form")
    ovals = ellipse_fits(pixels, *keys, ink=ink).filter("fits").select(*keys, row(2, F.when(form == "ring", "stroke_ellipse").otherwise("ellipse"), F.col("raster_error"), 1, F.when(form == "aligned", 4).otherwise(5)).alias("c"))
    straight = box.filter((longer >= STROKE_LENGTH) & (longer >= STROKE_RATIO * shorter)).select(*keys, row(3, F.lit("stroke_polyline"), fill, 2, F.lit(5)).alias("c"))
    arcs = arc_candidates(pixels, *keys, ink=ink).filter("fits").select(*keys, row(4, F.lit("arc"), F.col("raster_error"), 3, F.lit(7)).alias("c"))
    smooth = smooth_strokes(pixels, *keys, ink=ink).filter("fits").select(*keys, F.struct(F.lit(5).alias("ord"), F.lit("stroke_path").alias("kind"), F.round(F.col("residual") * 0.1, 9).alias("raster_error"), F.size("controls").alias("node_count"), (3 * F.size("controls")).alias("parameter_count")).alias("c"))
    rects = box.filter(fill <= fit.RECT_FILL).select(*keys, row(6, F.lit("rect"), fill, 4, F.lit(4)).alias("c"))
    rounded = box.filter((fill > 0) & (fill <= fit.ROUNDED_FILL) & (shorter >= 3)).select(*keys, row(7, F.lit("rounded_rect"), fill, 4, F.lit(5)).alias("c"))
    # a component's extreme corners are on its boundary
    dense = box.filter((shorter >= 3) & (fill <= 1 - fit.QUAD_FILL))
    corners = _corners(dense, *keys).filter("corners is not null")
    quads = quad_fill_error(pixels, corners, *keys, ink=ink).filter(F.col("fill_error") <= fit.QUAD_ERROR).select(*keys, row(8, F.lit("quad"), F.col("fill_error"), 4, F.lit(8)).alias("c"))
    spare = box.select(*keys, row(9, F.lit("cubic_path"), F.lit(fit.FALLBACK_PENALTY), fit.FALLBACK_NODES, F.lit(2 * fit.FALLBACK_NODES)).alias("c"))
    if paths is not None:
        own = paths.select(*keys, F.struct(F.lit(9).alias("ord"), F.lit("cubic_path").alias("kind"), F.round("raster_error", 9).alias("raster_error"), F.col("node_count").cast("int").alias("node_count"), F.col("parameter_count").cast("int").alias("parameter_count")).alias("o"))
        spare = spare.join(own.hint("shuffle_hash"), [*keys], "left").select(*keys, F.coalesce("o", "c").alias("c"))
    out = spare
    # a settled row per candidate: the driver then plans one fit at a time, and never all of them as one plan
    for df in (ring, discs, ovals, straight, arcs, smooth, rects, rounded, quads):
        out = out.unionByName(raster._settled(df))
    return out.select(*keys, "c.*")
