"""Queries over outlines and drawn shapes: each embedding is also a closed outline, each supplier also a shape on a canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import curves, fit, shapes
from inkframe.plans.raster_queries import _rounded
from inkframe.sources.tables import table

POINTS = 64


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """Blobs of three harmonics for even vec_id, jagged rings for odd ones."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("ord", "v"), "embedding")
    angle = F.lit(6.283185307179586) * F.col("ord") / POINTS
    blob = F.lit(24.0)
    for h in (1, 2, 3):
        blob = blob + F.lit(3.0) / h * (F.get("embedding", F.lit(2 * h - 1)).cast("double") * F.cos(angle * h) + F.get("embedding", F.lit(2 * h)).cast("double") * F.sin(angle * h))
    r = F.when(F.col("image_id") % 2 == 0, blob).otherwise(F.lit(20.0) + 2 * F.col("v").cast("double"))
    return e.select("image_id", "ord", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


_OUTLINES = f"""
    e AS (SELECT vec_id AS image_id, unnest(range({POINTS})) AS ord, embedding FROM embeddings),
    a AS (SELECT *, 6.283185307179586 * ord / {POINTS} AS angle FROM e),
    rad AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN 24.0::DOUBLE {"".join(f" + 3.0::DOUBLE / {h} * (embedding[{2 * h}]::DOUBLE * cos(angle * {h}) + embedding[{2 * h + 1}]::DOUBLE * sin(angle * {h}))" for h in (1, 2, 3))}
                      ELSE 20.0::DOUBLE + 2 * embedding[ord + 1]::DOUBLE END AS r FROM a),
    outline AS MATERIALIZED (SELECT image_id, ord::INT AS ord, r * cos(angle) AS x, r * sin(angle) AS y FROM rad)"""


def outline_corners(spark: SparkSession, d: str) -> DataFrame:
    """The corners of each outline."""
    found = curves.outline_corners(outlines(spark, d), "image_id")
    return found.select("image_id", F.size("corners").alias("n_corners"), F.concat_ws(",", F.col("corners").cast("array<string>")).alias("corners"))


def bezier_outline(spark: SparkSession, d: str) -> DataFrame:
    """Each outline's cubic segments."""
    held = outlines(spark, d)
    out = curves.fit_segments(curves.outline_pieces(held, "image_id"), "image_id", retries=1)
    return _rounded(out, *curves.SEGMENT[2:], digits=4)


def path_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each outline's generic path as a candidate."""
    held = outlines(spark, d)
    out = curves.path_candidates(curves.fit_segments(curves.outline_pieces(held, "image_id"), "image_id", retries=1), held, "image_id")
    return _rounded(out, "max_error", "raster_error", digits=4)


def _turn(span: int) -> str:
    here, before, after = (lambda c, k=k: f"{c}s[(ord + {k}) % {POINTS} + 1]" for k in (0, POINTS - span, span))
    a, b, ay, by = f"({here('x')} - {before('x')})", f"({after('x')} - {here('x')})", f"({here('y')} - {before('y')})", f"({after('y')} - {here('y')})"
    return f"CASE WHEN sqrt({a}^2 + {ay}^2) > 0 AND sqrt({b}^2 + {by}^2) > 0 THEN abs(atan2({a} * {by} - {ay} * {b}, {a} * {b} + {ay} * {by})) ELSE 0 END"


_CORNERS = f"""{_OUTLINES},
    rings AS (SELECT image_id, list(x ORDER BY ord) AS xs, list(y ORDER BY ord) AS ys FROM outline GROUP BY image_id),
    turns AS (SELECT image_id, ord, {_turn(4)} AS small, {_turn(8)} AS large FROM (SELECT *, unnest(range({POINTS}))::INT AS ord FROM rings)),
    found AS (
        SELECT image_id, list([ord] ORDER BY -round(small, 9), ord) FILTER (small >= 0.65 AND large <= small + 0.35) AS f FROM turns GROUP BY image_id),
    corners AS (
        SELECT image_id, list_sort(list_reduce(list_prepend([]::INT[], coalesce(f, []::INT[][])), lambda k, c: CASE WHEN len(k) >= 16
               OR len(list_filter(k, lambda q: least(abs(q - c[1]), {POINTS} - abs(q - c[1])) <= 8)) > 0 THEN k ELSE list_concat(k, c) END)) AS corners FROM found)"""


def _fit_sql(source: str, out: str) -> str:
    """CTEs that fit the rows of source (with u) as `out`: controls, off, error and worst."""
    b = "power(1 - u, 3)", "(3 * u * (1 - u) * (1 - u))", "(3 * u * u * (1 - u))", "power(u, 3)"
    t = {x: f"({x} - ({b[0]} + {b[1]}) * a{x} - ({b[2]} + {b[3]}) * \"b{x}\")" for x in "xy"}
    w = "OVER (PARTITION BY image_id, lo)"
    at = lambda x: f"power(1 - u, 3) * a{x} + 3 * (1 - u) * (1 - u) * u * c{x} + 3 * (1 - u) * u * u * d{x} + power(u, 3) * \"b{x}\""
    return f"""
        {out}_1 AS (SELECT *, {", ".join(f"max(CASE WHEN pos = {p} THEN {x} END) {w} AS \"{e}{x}\"" for e, p in (("a", "lo"), ("b", "hi")) for x in "xy")} FROM {source}),
        {out}_2 AS (SELECT *, sum({b[1]} * {b[1]}) {w} AS c00, sum({b[1]} * {b[2]} * (lx * rx + ly * ry)) {w} AS c01, sum({b[2]} * {b[2]}) {w} AS c11,
                    sum({b[1]} * (lx * {t["x"]} + ly * {t["y"]})) {w} AS x0, sum({b[2]} * (rx * {t["x"]} + ry * {t["y"]})) {w} AS x1, sqrt((bx - ax)^2 + ("by" - ay)^2) AS chord FROM {out}_1),
        {out}_3 AS (SELECT *, CASE WHEN abs(c00 * c11 - c01 * c01) > 1e-9 THEN (x0 * c11 - x1 * c01) / (c00 * c11 - c01 * c01) ELSE 0 END AS la,
                    CASE WHEN abs(c00 * c11 - c01 * c01) > 1e-9 THEN (c00 * x1 - c01 * x0) / (c00 * c11 - c01 * c01) ELSE 0 END AS ra FROM {out}_2),
        {out}_4 AS (SELECT *, CASE WHEN least(la, ra) < 1e-6 * chord OR hi - lo < 2 THEN chord / 3 ELSE la END AS l1, CASE WHEN least(la, ra) < 1e-6 * chord OR hi - lo < 2 THEN chord / 3 ELSE ra END AS r1 FROM {out}_3),
        {out}_5 AS (SELECT *, ax + lx * l1 AS cx, ay + ly * l1 AS cy, bx + rx * r1 AS dx, "by" + ry * r1 AS dy FROM {out}_4),
        {out}_6 AS (SELECT *, CASE WHEN pos > lo AND pos < hi THEN sqrt((x - ({at("x")}))^2 + (y - ({at("y")}))^2) ELSE 0 END AS off FROM {out}_5),
        {out} AS (SELECT *, coalesce(max(CASE WHEN pos > lo AND pos < hi THEN round(off, 9) END) {w}, 0) AS error,
                  first(CASE WHEN pos > lo AND pos < hi THEN pos END) OVER (PARTITION BY image_id, lo ORDER BY CASE WHEN pos > lo AND pos < hi THEN round(off, 9) ELSE -1 END DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS worst FROM {out}_6)"""


def _newton() -> str:
    d1 = lambda x: f"(3 * ((1 - u) * (1 - u) * (c{x} - a{x}) + 2 * (1 - u) * u * (d{x} - c{x}) + u * u * (\"b{x}\" - d{x})))"
    d2 = lambda x: f"(6 * ((1 - u) * (d{x} - 2 * c{x} + a{x}) + u * (\"b{x}\" - 2 * d{x} + c{x})))"
    gap = lambda x: f"(power(1 - u, 3) * a{x} + 3 * (1 - u) * (1 - u) * u * c{x} + 3 * (1 - u) * u * u * d{x} + power(u, 3) * \"b{x}\" - {x})"
    top = " + ".join(f"{gap(x)} * {d1(x)}" for x in "xy")
    bottom = " + ".join(f"{d1(x)} * {d1(x)} + {gap(x)} * {d2(x)}" for x in "xy")
    return f"CASE WHEN error < 0.45 OR error >= 1.8 OR abs({bottom}) < 1e-9 THEN u ELSE greatest(0, least(1, u - ({top}) / ({bottom}))) END"


_STATE = "image_id, lo, hi, pos, x, y, lx, ly, rx, ry"
_UNIT = lambda x, y, k: f"CASE WHEN sqrt(({x})^2 + ({y})^2) > 0 THEN ({(x, y)[k]}) / sqrt(({x})^2 + ({y})^2) ELSE {1 - k} END"
_AT = lambda p, x: f"max(CASE WHEN pos = {p} THEN {x} END) OVER (PARTITION BY image_id, lo)"
_SEGMENTS = f"""{_CORNERS},
    cuts AS (SELECT image_id, corners, CASE len(corners) WHEN 0 THEN [0, {POINTS // 2}] WHEN 1 THEN [corners[1], corners[1] + {POINTS // 2}] ELSE corners END AS cuts FROM corners),
    spans AS (SELECT image_id, corners, unnest(cuts) AS lo, unnest(list_append(cuts[2:], cuts[1] + {POINTS})) AS hi FROM cuts),
    wide AS (SELECT s.image_id, corners, lo, hi, unnest(range(lo - 1, hi + 2)) AS pos FROM spans s WHERE hi > lo),
    placed AS (SELECT w.image_id, corners, lo, hi, pos::INT AS pos, o.x, o.y FROM wide w JOIN outline o ON o.image_id = w.image_id AND o.ord = (w.pos + {POINTS}) % {POINTS}),
    ends AS (SELECT *, {", ".join(f"{_AT(p, x)} AS {n}{x}" for n, p in (("e0", "lo - 1"), ("e1", "lo"), ("e2", "lo + 1"), ("e3", "least(lo + 2, hi)"), ("f0", "hi - 1"), ("f1", "hi"), ("f2", "hi + 1"), ("f3", "greatest(hi - 2, lo)")) for x in "xy")} FROM placed),
    pieces AS MATERIALIZED (SELECT image_id, lo::INT AS lo, hi::INT AS hi, pos, x, y,
        {", ".join(f"CASE WHEN list_contains(corners, (lo % {POINTS})::INT) THEN {_UNIT('e3x - e1x', 'e3y - e1y', k)} ELSE {_UNIT('e2x - e0x', 'e2y - e0y', k)} END AS l{x}" for k, x in enumerate("xy"))},
        {", ".join(f"CASE WHEN list_contains(corners, (hi % {POINTS})::INT) THEN {_UNIT('f3x - f1x', 'f3y - f1y', k)} ELSE {_UNIT('f0x - f2x', 'f0y - f2y', k)} END AS r{x}" for k, x in enumerate("xy"))}
        FROM ends WHERE pos BETWEEN lo AND hi),
    rounds AS (
        SELECT {_STATE}, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::DOUBLE AS dx, NULL::DOUBLE AS dy, NULL::DOUBLE AS bx, NULL::DOUBLE AS "by", NULL::DOUBLE AS error, false AS done FROM pieces
        UNION ALL
        SELECT * FROM (
            WITH s0 AS (SELECT {_STATE}, coalesce(sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2), 0) AS step FROM rounds WHERE NOT done WINDOW w AS (PARTITION BY image_id, lo ORDER BY pos)),
            s1 AS (SELECT *, sum(step) OVER (PARTITION BY image_id, lo ORDER BY pos) AS s, sum(step) OVER (PARTITION BY image_id, lo) AS total FROM s0),
            s2 AS (SELECT {_STATE}, CASE WHEN total > 0 THEN s / total ELSE 0 END AS u FROM s1),
            {_fit_sql("s2", "f")},
            s3 AS (SELECT {_STATE}, {_newton()} AS u FROM f),
            {_fit_sql("s3", "g")},
            h AS (SELECT *, error < 0.45 OR hi - lo < 2 AS holds, greatest(least(worst, hi - ceil((hi - lo) * 0.25)::INT), lo + ceil((hi - lo) * 0.25)::INT)::INT AS cut FROM g),
            k AS (SELECT *, {", ".join(f"{_AT(f'cut {s} 1', x)} AS {n}{x}" for n, s in (("p", "-"), ("q", "+")) for x in "xy")} FROM h)
            SELECT {_STATE}, ax, ay, cx, cy, dx, dy, bx, "by", error, true FROM k WHERE holds AND pos = lo
            UNION ALL SELECT image_id, lo, cut, pos, x, y, lx, ly, {_UNIT("px - qx", "py - qy", 0)}, {_UNIT("px - qx", "py - qy", 1)}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM k WHERE NOT holds AND pos <= cut
            UNION ALL SELECT image_id, cut, hi, pos, x, y, -({_UNIT("px - qx", "py - qy", 0)}), -({_UNIT("px - qx", "py - qy", 1)}), rx, ry, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM k WHERE NOT holds AND pos >= cut)),
    segments AS (SELECT image_id, lo, hi, ax, ay, cx, cy, dx, dy, bx, "by", error FROM rounds WHERE done)"""

#: Which cells (x, y) of a 40 x 40 canvas are ink, by k (the shape) and p (its size), as SQL of both engines: a disc, an upright and a tilted
#: ellipse, an elliptic ring, a disc with a slit, a slanted quad, a parabola's band, an arc, a box, a ring, a bar, and a disc with a bent slit.
DRAWN = """CASE k
    WHEN 0 THEN (x - 20) * (x - 20) + (y - 20) * (y - 20) <= (10 + p) * (10 + p)
    WHEN 1 THEN (x - 20) * (x - 20) / 27225e-2 + (y - 20) * (y - 20) / ((95e-1 + p) * (95e-1 + p)) <= 1
    WHEN 2 THEN ((x - 20) * 8e-1 + (y - 20) * 6e-1) * ((x - 20) * 8e-1 + (y - 20) * 6e-1) / 256e0 + ((y - 20) * 8e-1 - (x - 20) * 6e-1) * ((y - 20) * 8e-1 - (x - 20) * 6e-1) / ((7e0 + p / 2e0) * (7e0 + p / 2e0)) <= 1
    WHEN 3 THEN (x - 20) * (x - 20) / 289e0 + (y - 20) * (y - 20) / ((10e0 + p / 2e0) * (10e0 + p / 2e0)) <= 1 AND (x - 20) * (x - 20) / 169e0 + (y - 20) * (y - 20) / ((6e0 + p / 2e0) * (6e0 + p / 2e0)) >= 1
    WHEN 4 THEN (x - 20) * (x - 20) + (y - 20) * (y - 20) <= (12 + p) * (12 + p) AND NOT (y BETWEEN 19 AND 21 AND x BETWEEN 12 - p AND 28 + p)
    WHEN 5 THEN y BETWEEN 8 AND 28 AND x >= 6 + (y - 8) * p / 4e0 AND x <= 24 + (y - 8) * p / 8e0
    WHEN 6 THEN x BETWEEN 4 AND 36 AND y - (32e0 - (x - 20) * (x - 20) / (20e0 + 8 * p)) BETWEEN -15e-1 AND 15e-1
    WHEN 8 THEN y <= 22 AND (x - 20) * (x - 20) + (y - 26) * (y - 26) BETWEEN (125e-1 + p / 2e0) * (125e-1 + p / 2e0) AND (155e-1 + p / 2e0) * (155e-1 + p / 2e0)
    WHEN 9 THEN x BETWEEN 5 AND 34 AND y BETWEEN 5 AND 30 + p
    WHEN 10 THEN (x - 20) * (x - 20) + (y - 20) * (y - 20) BETWEEN (8 + p) * (8 + p) AND (13 + p) * (13 + p)
    WHEN 11 THEN x BETWEEN 3 AND 36 AND y BETWEEN 18 AND 20 + p
    ELSE (x - 20) * (x - 20) + (y - 20) * (y - 20) <= 17 * 17 AND NOT (x BETWEEN 10 AND 30 AND y - (24e0 - (x - 20) * (x - 20) / (10e0 + 4 * p)) BETWEEN -1e0 AND 1e0)
    END"""


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """The ink of a shape for each customer."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.expr("cast(c_custkey % 12 AS int)").alias("k"), F.expr("cast(c_custkey div 12 % 5 AS int)").alias("p"))
    # dealt out before they are drawn: a shape's pixels then are in one task, and steps by image need no shuffle of pixels
    ids = ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    cells = ids.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return cells.filter(F.expr(DRAWN)).select("image_id", "x", "y")


_INK = f"""ink AS MATERIALIZED (
        SELECT image_id, x, y FROM (SELECT c_custkey AS image_id, (c_custkey % 12)::INT AS k, (c_custkey // 12 % 5)::INT AS p, x::INT AS x, y::INT AS y FROM customer, range(40) a(x), range(40) b(y)) WHERE {DRAWN})"""


def ellipse_fits(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(shapes.ellipse_fits(drawn(spark, d), "image_id"), "cx", "cy", "rx", "ry", "rotation", "stroke_width", "residual", "area_error", "raster_error")


def circle_fits(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(shapes.circle_fits(drawn(spark, d), "image_id"), "cx", "cy", "r", "residual", "spread", "raster_error")


def quad_fill_error(spark: SparkSession, d: str) -> DataFrame:
    """Each shape's extreme quad against its scan lines."""
    ink = drawn(spark, d)
    return _rounded(shapes.quad_fill_error(ink, fit.extreme_quad(ink, "image_id"), "image_id"), "fill_error")


def smooth_strokes(spark: SparkSession, d: str) -> DataFrame:
    out = shapes.smooth_strokes(drawn(spark, d), "image_id")
    return _rounded(out.withColumn("n_controls", F.size("controls")).drop("controls"), "path_length", "stroke_width", "bow", "residual", "jitter", "width_variance")


def cutout_strokes(spark: SparkSession, d: str) -> DataFrame:
    """The slits of each shape."""
    out = shapes.cutout_strokes(drawn(spark, d), "image_id")
    flat = [F.round(F.get("centerline", F.lit(i) if i >= 0 else F.size("centerline") - 1)[c], 6).alias(f"{n}_{c}") for n, i in (("first", 0), ("second", 1), ("last", -1)) for c in "xy"]
    return _rounded(out.select("image_id", "form", "path_length", "stroke_width", F.size("centerline").alias("n_points"), *flat), "path_length", "stroke_width")


def arc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(shapes.arc_candidates(drawn(spark, d), "image_id"), "cx", "cy", "r", "span", "stroke_width", "midpoint_residual", "taper", "bow", "raster_error")


def best_primitive(spark: SparkSession, d: str) -> DataFrame:
    """The best of all primitives that fit each drawn shape, by semantic score."""
    scored = fit.with_semantic_score(shapes.primitive_candidates(drawn(spark, d), "image_id"))
    counted = scored.withColumn("n_candidates", F.count("*").over(Window.partitionBy("image_id")))
    return _rounded(fit.choose_best(counted, "image_id").select("image_id", "kind", "score", "n_candidates"), "score")


QUERIES = {"outline_corners": outline_corners, "bezier_outline": bezier_outline, "path_candidates": path_candidates, "ellipse_fits": ellipse_fits, "circle_fits": circle_fits, "quad_fill_error": quad_fill_error, "smooth_strokes": smooth_strokes, "cutout_strokes": cutout_strokes, "arc_candidates": arc_candidates, "best_primitive": best_primitive}

_BOX = "box AS (SELECT image_id, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS mx, avg(y) AS my FROM ink GROUP BY image_id)"
_EDGE = """edge AS MATERIALIZED (
        SELECT image_id, x, y FROM (SELECT image_id, x, y, lag(x) OVER r = x - 1 AND lead(x) OVER r = x + 1 AND lag(y) OVER c = y - 1 AND lead(y) OVER c = y + 1 AS inner_cell FROM ink
              WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)) WHERE NOT coalesce(inner_cell, false))"""
#: Cells within the bounds that are not ink; those that reach the bounds are open, and what is left is labelled by its first cell.
_GAPS = f"""{_BOX}, {_EDGE},
    steps AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy)),
    gap AS MATERIALIZED (SELECT b.image_id, gx.x::INT AS x, gy.y::INT AS y, gx.x IN (x0, x1) OR gy.y IN (y0, y1) AS rim FROM box b, range(40) gx(x), range(40) gy(y) WHERE gx.x BETWEEN x0 AND x1 AND gy.y BETWEEN y0 AND y1
            AND NOT EXISTS (SELECT 1 FROM ink i WHERE i.image_id = b.image_id AND i.x = gx.x AND i.y = gy.y)),
    outside AS (SELECT image_id, x, y FROM gap WHERE rim UNION SELECT g.image_id, g.x, g.y FROM (SELECT image_id, x + dx AS x, y + dy AS y FROM outside, steps) o JOIN gap g ON g.image_id = o.image_id AND g.x = o.x AND g.y = o.y),
    enclosed AS MATERIALIZED (SELECT image_id, x, y FROM gap EXCEPT SELECT * FROM outside),
    labels AS (SELECT image_id, x, y, y * 40 + x AS root FROM enclosed UNION SELECT g.image_id, g.x, g.y, l.root FROM (SELECT image_id, x + dx AS x, y + dy AS y, root FROM labels, steps) l JOIN enclosed g ON g.image_id = l.image_id AND g.x = l.x AND g.y = l.y AND g.y * 40 + g.x > l.root),
    sealed AS MATERIALIZED (SELECT image_id, root, x, y FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM (SELECT image_id, x, y, min(root) AS root FROM labels GROUP BY ALL)) WHERE n >= 4)"""


def _rays(ovals: str, out: str) -> str:
    """CTE: residual and tail of the edge about the ellipses of `ovals` (cx, cy, rx, ry, ct, st)."""
    return f"""
    {out}_1 AS (SELECT image_id, rx, ry, (x - cx) * ct + (y - cy) * st AS u, (y - cy) * ct - (x - cx) * st AS v FROM edge JOIN {ovals} USING (image_id)),
    {out}_2 AS (SELECT image_id, abs(sqrt(u * u + v * v) - rx * ry * sqrt(u * u + v * v) / sqrt(ry * u * ry * u + rx * v * rx * v)) AS gap FROM {out}_1 WHERE u * u + v * v > 0),
    {out}_3 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM {out}_2),
    {out} AS (SELECT image_id, avg(gap) AS residual, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN gap END) AS tail FROM {out}_3 GROUP BY image_id)"""


_PI = 3.141592653589793
_ELLIPSES = f"""WITH {_INK}, {_BOX}, {_EDGE},
    up AS (SELECT *, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, w / 2.0::DOUBLE AS rx, h / 2.0::DOUBLE AS ry, 1.0::DOUBLE AS ct, 0.0::DOUBLE AS st, 1 - least(w, h) / greatest(w, h)::DOUBLE AS aspect FROM box),
    upright AS (SELECT *, abs(area - {_PI} * rx * ry) / ({_PI} * rx * ry) AS area_error, least(w, h) >= 9 AND NOT (greatest(w, h) <= 12 AND aspect < 0.15) AS may FROM up),
    {_rays("upright", "r0")},
    aligned AS (SELECT u.*, coalesce(residual, 0) AS residual, may AND aspect >= 0.1 AND area_error <= 0.12 AND coalesce(residual, 0) <= 0.75 AS ok FROM upright u LEFT JOIN r0 USING (image_id)),
    axis0 AS (SELECT image_id, any_value(area) AS area, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) / 2 AS angle FROM ink JOIN (SELECT image_id, area FROM aligned WHERE may AND NOT ok) USING (image_id) GROUP BY image_id),
    axis1 AS (SELECT *, atan2(sin(angle), cos(angle)) AS tilt FROM axis0),
    axis2 AS (SELECT *, CASE WHEN tilt <= -{_PI} / 2 THEN tilt + {_PI} WHEN tilt > {_PI} / 2 THEN tilt - {_PI} ELSE tilt END AS rotation FROM axis1),
    axis AS (SELECT *, cos(rotation) AS ct, sin(rotation) AS st FROM axis2),
    ext AS (SELECT image_id, min((x - mx) * ct + (y - my) * st) AS u0, max((x - mx) * ct + (y - my) * st) AS u1, min((y - my) * ct - (x - mx) * st) AS v0, max((y - my) * ct - (x - mx) * st) AS v1 FROM ink JOIN axis USING (image_id) GROUP BY image_id),
    tilted0 AS (SELECT a.*, (u1 - u0) / 2 + 0.5 AS rx, (v1 - v0) / 2 + 0.5 AS ry, mx + (u0 + u1) / 2 * ct - (v0 + v1) / 2 * st AS cx, my + (u0 + u1) / 2 * st + (v0 + v1) / 2 * ct AS cy FROM axis a JOIN ext USING (image_id)),
    {_rays("tilted0", "r1")},
    tilted AS (SELECT *, abs(area - {_PI} * rx * ry) / ({_PI} * rx * ry) AS area_error FROM tilted0 JOIN r1 USING (image_id)),
    met AS (SELECT image_id, sqrt(power((x - cx) / rx, 2) + power((y - cy) / ry, 2)) AS d FROM ink JOIN (SELECT * FROM upright WHERE least(w, h) >= 8 AND aspect >= 0.18) USING (image_id)),
    lim AS (SELECT image_id, min(d) AS i, max(d) AS o FROM met GROUP BY image_id),
    band AS (SELECT image_id, any_value(i) AS i, any_value(o) AS o, avg(abs(d - (i + o) / 2)) AS band FROM met JOIN lim USING (image_id) GROUP BY image_id),
    ring0 AS (SELECT u.*, i, o, band, greatest((o - i) * ((rx + ry) / 2), 1) AS sw, (rx + ry) / 2 AS mean FROM upright u JOIN band USING (image_id)),
    ring AS (SELECT * EXCLUDE (area_error), abs(area - {_PI} * (rx * ry - (rx - sw) * (ry - sw))) / ({_PI} * (rx * ry - (rx - sw) * (ry - sw))) AS area_error FROM ring0 WHERE i >= 0.3 AND o <= 1.2 AND sw <= 0.8 * mean AND band * mean <= sw * 0.5 + 0.5 AND rx * ry - (rx - sw) * (ry - sw) > 0),
    found AS (
        SELECT 0 AS place, image_id, 'aligned' AS form, cx, cy, rx, ry, 0.0 AS rotation, 0.0 AS stroke_width, residual, area_error, area_error + residual * 0.05 AS raster_error FROM aligned WHERE ok
        UNION ALL SELECT 1, image_id, 'tilted', cx, cy, rx, ry, rotation, 0, residual, area_error, area_error + residual * 0.05 FROM tilted
            WHERE least(abs(rotation), abs(abs(rotation) - {_PI} / 2)) >= 4.0 * {_PI} / 180 AND least(rx, ry) >= 4.5 AND 1 - least(rx, ry) / greatest(rx, ry) >= 0.1 AND area_error <= 0.12 AND residual <= 1.1 AND tail <= 1.7
        UNION ALL SELECT 2, image_id, 'ring', cx, cy, rx * ((i + o) / 2), ry * ((i + o) / 2), 0, sw, band, area_error, area_error * 0.2 + band FROM ring WHERE area_error <= 0.45),
    best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY place) = 1)
    SELECT b.image_id, form, form IS NOT NULL AS fits, {", ".join(f"round({c}, 6) AS {c}" for c in ("f.cx", "f.cy", "f.rx", "f.ry", "rotation", "stroke_width", "residual", "area_error", "raster_error")).replace("AS f.", "AS ")} FROM box b LEFT JOIN best f USING (image_id)"""


def _circles(points: str, out: str) -> str:
    """CTEs: the circle fitted to the points and that of the bounds, each with residual and spread."""
    near = lambda source, to: f"{to} AS (SELECT p.image_id, any_value(c.cx) AS cx, any_value(c.cy) AS cy, any_value(c.r) AS r, avg(abs(sqrt((x - c.cx)^2 + (y - c.cy)^2) - c.r)) / any_value(c.r) AS residual, stddev_pop(sqrt((x - c.cx)^2 + (y - c.cy)^2)) / any_value(c.r) AS spread FROM {points} p JOIN {source} c USING (image_id) GROUP BY p.image_id)"
    return f"""
    {out}_s AS (SELECT image_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy, sum(x * (x * x + y * y))::DOUBLE AS sxz, sum(y * (x * x + y * y))::DOUBLE AS syz FROM {points} GROUP BY image_id),
    {out}_m AS (SELECT *, n * sxx - sx * sx AS a, n * sxy - sx * sy AS b, n * syy - sy * sy AS c, (n * sxz - sx * (sxx + syy)) / 2 AS d, (n * syz - sy * (sxx + syy)) / 2 AS e FROM {out}_s),
    {out}_k AS (SELECT image_id, n, sx, sy, sxx, syy, CASE WHEN abs(a * c - b * b) > 1e-9 THEN (d * c - b * e) / (a * c - b * b) END AS cx, CASE WHEN abs(a * c - b * b) > 1e-9 THEN (a * e - b * d) / (a * c - b * b) END AS cy FROM {out}_m),
    {out}_c AS (SELECT k.image_id, coalesce(cx, mx) AS cx, coalesce(cy, my) AS cy, coalesce(sqrt((sxx + syy - 2 * cx * sx - 2 * cy * sy) / n + cx * cx + cy * cy), sqrt(area / {_PI})) AS r FROM {out}_k k JOIN rb USING (image_id)),
    {out}_b AS (SELECT image_id, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, greatest((diameter - 1) / 2.0::DOUBLE, 0.5) AS r FROM rb),
    {near(f"{out}_c", f"{out}_free")}, {near(f"{out}_b", f"{out}_box")}"""


_CIRCLES = f"""WITH RECURSIVE {_INK}, {_GAPS},
    sized AS (SELECT *, greatest(w, h) AS diameter, abs(w - h) / greatest(w, h)::DOUBLE AS aspect_error, {_PI} * power(greatest(w, h) / 2.0::DOUBLE, 2) AS disc FROM box),
    rb AS MATERIALIZED (SELECT *, abs(area - disc) / disc AS area_error FROM sized WHERE diameter >= 3 AND aspect_error <= 0.22 AND abs(area - disc) / disc <= 0.35),
    around AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM sealed, steps),
    pts AS MATERIALIZED (SELECT e.image_id, e.x, e.y, a.x IS NOT NULL AS gap_edge FROM edge e JOIN rb USING (image_id) LEFT JOIN around a ON a.image_id = e.image_id AND a.x = e.x AND a.y = e.y),
    outer_pts AS (SELECT * FROM pts WHERE NOT gap_edge),
    n AS (SELECT image_id, count(*) AS n_edge, count(*) FILTER (NOT gap_edge) AS n_outer FROM pts GROUP BY image_id),
    g AS (SELECT image_id, count(*) AS gap_area FROM sealed GROUP BY image_id),
    {_circles("pts", "a")}, {_circles("outer_pts", "o")},
    pick AS (SELECT rb.*, coalesce(gap_area, 0) AS gap_area, coalesce(af.residual > 0.06 AND coalesce(gap_area, 0) > 0 AND n_outer >= 8 AND n_outer >= 0.6 * n_edge, false) AS refitted, af, ab, f_o, b_o
             FROM rb JOIN n USING (image_id) LEFT JOIN g USING (image_id) JOIN a_free af USING (image_id) JOIN a_box ab USING (image_id) LEFT JOIN o_free f_o USING (image_id) LEFT JOIN o_box b_o USING (image_id)),
    free AS (SELECT *, CASE WHEN refitted THEN f_o ELSE af END AS fr, CASE WHEN refitted THEN b_o ELSE ab END AS bx FROM pick),
    chosen AS (SELECT *, CASE WHEN bx.residual <= greatest(0.06, fr.residual + 0.02) THEN bx ELSE fr END AS c, NOT refitted OR ({_PI} * fr.r * fr.r - gap_area > 0 AND abs(area - ({_PI} * fr.r * fr.r - gap_area)) / ({_PI} * fr.r * fr.r - gap_area) <= 0.12) AS balanced FROM free),
    good AS (SELECT * FROM chosen WHERE balanced AND (diameter < 12 OR (c.residual <= 0.06 AND c.spread <= 0.12)))
    SELECT b.image_id, q.image_id IS NOT NULL AS fits, coalesce(refitted, false) AS refitted, round(c.cx, 6) AS cx, round(c.cy, 6) AS cy, round(c.r, 6) AS r, round(c.residual, 6) AS residual, round(c.spread, 6) AS spread,
           gap_area, round(area_error + aspect_error + c.residual, 6) AS raster_error FROM box b LEFT JOIN good q USING (image_id)"""

_QUADS = f"""WITH {_INK},
    q AS (SELECT image_id, [arg_min({{'x': x, 'y': y}}, (x + y) * 100 + y), arg_min({{'x': x, 'y': y}}, (y - x) * 100 + y), arg_min({{'x': x, 'y': y}}, (-x - y) * 100 - y), arg_min({{'x': x, 'y': y}}, (x - y) * 100 - y)] AS c FROM ink GROUP BY image_id),
    e AS (SELECT image_id, c[i] AS a, c[i % 4 + 1] AS b FROM q, range(1, 5) r(i) WHERE len(list_distinct(c)) = 4),
    hit AS (SELECT image_id, y, CASE WHEN a.y = b.y THEN least(a.x, b.x) ELSE a.x + (b.x - a.x) * ((y - a.y) / (b.y - a.y)) END AS lo, CASE WHEN a.y = b.y THEN greatest(a.x, b.x) ELSE a.x + (b.x - a.x) * ((y - a.y) / (b.y - a.y)) END AS hi
            FROM e, range(40) r(y) WHERE y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)),
    rows AS (SELECT image_id, y, round_even(min(lo), 0)::INT AS l, round_even(max(hi), 0)::INT AS r FROM hit GROUP BY ALL),
    per_row AS (SELECT r.image_id, r.y, any_value(r.r - r.l + 1) AS wide, count(*) FILTER (i.x BETWEEN r.l AND r.r) AS inside, count(*) FILTER (i.x < r.l OR i.x > r.r) AS extra FROM rows r LEFT JOIN ink i ON i.image_id = r.image_id AND i.y = r.y GROUP BY ALL),
    s AS (SELECT image_id, sum(wide)::BIGINT AS expected, (sum(wide) - sum(inside))::BIGINT AS missing, sum(extra)::BIGINT AS extra, max(y) > min(y) AS tall FROM per_row GROUP BY image_id)
    SELECT q.image_id, coalesce(expected, 0) AS expected, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, round(CASE WHEN tall THEN (missing + extra) / expected ELSE 1 END, 6) AS fill_error FROM q LEFT JOIN s USING (image_id)"""


def _lines(cells: str, keys: str) -> str:
    """CTEs: line (keys, i, x, y, n), the smoothed means of the columns along the longer side, and head (keys, w, h, area, functional, m)."""
    return f"""
    side AS (SELECT {keys}, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM {cells} GROUP BY ALL),
    col AS (SELECT {keys}, w, h, area, CASE WHEN w >= h THEN x ELSE y END AS k, avg(CASE WHEN w >= h THEN y ELSE x END) AS v, max(CASE WHEN w >= h THEN y ELSE x END) - min(CASE WHEN w >= h THEN y ELSE x END) + 1 AS span, count(*) AS n FROM {cells} JOIN side USING ({keys}) GROUP BY ALL),
    flat AS (SELECT *, avg(v) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS i FROM col),
    line AS MATERIALIZED (SELECT {keys}, i, CASE WHEN w >= h THEN k::DOUBLE ELSE s END AS x, CASE WHEN w >= h THEN s ELSE k::DOUBLE END AS y, n FROM flat),
    spans AS (SELECT {keys}, w, h, area, list(span ORDER BY span) AS spans FROM col GROUP BY ALL),
    head AS (SELECT {keys}, w, h, area, len(spans) AS m, len(spans) >= 5 AND len(list_filter(spans, lambda z: z > 2 * spans[len(spans) // 2 + 1] + 2)) <= 0.1 * len(spans) AS functional FROM spans),
    len AS (SELECT {keys}, coalesce(sum(d), 0) AS path FROM (SELECT {keys}, sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2) AS d FROM line WINDOW w AS (PARTITION BY {keys} ORDER BY i)) GROUP BY ALL)"""


_STROKES = f"""WITH {_INK}, {_lines("ink", "image_id")},
    body AS (SELECT *, greatest(area / greatest(path, 1), 1) AS sw FROM head JOIN len USING (image_id)),
    ctl AS (SELECT b.image_id, j, l.x, l.y, l.n, least(m, 7) AS c FROM body b, range(7) r(j) JOIN line l ON l.image_id = b.image_id AND l.i = CASE WHEN m <= 7 THEN j ELSE round_even((m - 1) * j / 6, 0) END WHERE j < least(m, 7)),
    seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(x) OVER w AS xp, lag(y) OVER w AS yp, first(x) OVER w AS xa, first(y) OVER w AS ya, last(x) OVER v AS xb, last(y) OVER v AS yb FROM ctl
            WINDOW w AS (PARTITION BY image_id ORDER BY j), v AS (PARTITION BY image_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    bows AS (SELECT image_id, sqrt((any_value(xb) - any_value(xa))^2 + (any_value(yb) - any_value(ya))^2) AS chord,
                    max(CASE WHEN j > 0 AND j < c - 1 THEN CASE WHEN (xb - xa)^2 + (yb - ya)^2 > 0 THEN abs((x - xa) * (yb - ya) - (y - ya) * (xb - xa)) / sqrt((xb - xa)^2 + (yb - ya)^2) ELSE sqrt((x - xa)^2 + (y - ya)^2) END END) AS off FROM seg GROUP BY image_id),
    widths AS (SELECT image_id, greatest(n / sqrt(1 + slope * slope), 1) AS wd FROM (SELECT s.image_id, n, coalesce(CASE WHEN w >= h THEN CASE WHEN coalesce(x2, s.x) <> coalesce(xp, s.x) THEN (coalesce(y2, s.y) - coalesce(yp, s.y)) / (coalesce(x2, s.x) - coalesce(xp, s.x)) END
                    ELSE CASE WHEN coalesce(y2, s.y) <> coalesce(yp, s.y) THEN (coalesce(x2, s.x) - coalesce(xp, s.x)) / (coalesce(y2, s.y) - coalesce(yp, s.y)) END END, 0) AS slope FROM seg s JOIN body USING (image_id))),
    wv AS (SELECT image_id, stddev_pop(wd) / avg(wd) AS width_variance FROM widths GROUP BY image_id),
    near AS (SELECT l.image_id, l.i, min(sqrt((l.x - s.x - (s.x2 - s.x) * t)^2 + (l.y - s.y - (s.y2 - s.y) * t)^2)) AS d FROM line l JOIN seg s ON s.image_id = l.image_id AND s.x2 IS NOT NULL,
                 LATERAL (SELECT greatest(0, least(1, CASE WHEN (s.x2 - s.x)^2 + (s.y2 - s.y)^2 > 0 THEN ((l.x - s.x) * (s.x2 - s.x) + (l.y - s.y) * (s.y2 - s.y)) / ((s.x2 - s.x)^2 + (s.y2 - s.y)^2) ELSE 0 END)) AS t) GROUP BY ALL),
    res AS (SELECT image_id, avg(d) AS residual FROM near GROUP BY image_id),
    turn AS (SELECT image_id, j, a2 - lag(a2) OVER (PARTITION BY image_id ORDER BY j) AS raw FROM (SELECT image_id, j, atan2(y2 - y, x2 - x) AS a2 FROM seg WHERE x2 IS NOT NULL)),
    wrapped AS (SELECT image_id, j, raw - 2 * {_PI} * floor((raw + {_PI}) / (2 * {_PI})) AS t FROM turn WHERE raw IS NOT NULL),
    jit AS (SELECT image_id, avg(abs(t - p)) AS jitter FROM (SELECT image_id, t, lag(t) OVER (PARTITION BY image_id ORDER BY j) AS p FROM wrapped) WHERE p IS NOT NULL GROUP BY image_id)
    SELECT b.image_id, functional AND greatest(w, h) >= 8 AND area <= 0.55 * w * h AND path >= 8 AND sw <= 0.8 * least(w, h) AND path >= 3 * sw AND chord > 0 AND coalesce(off, 0) / greatest(chord, 1) >= 0.03 AND width_variance <= 0.35 AS fits,
           round(path, 6) AS path_length, round(sw, 6) AS stroke_width, round(coalesce(off, 0) / greatest(chord, 1), 6) AS bow, round(coalesce(residual, 0), 6) AS residual, round(coalesce(jitter, 0), 6) AS jitter, round(width_variance, 6) AS width_variance, least(m, 7)::INT AS n_controls
    FROM body b JOIN bows USING (image_id) JOIN wv USING (image_id) LEFT JOIN res USING (image_id) LEFT JOIN jit USING (image_id)"""

_CUTOUTS = f"""WITH RECURSIVE {_INK}, {_GAPS}, {_lines("sealed", "image_id, root")},
    host AS (SELECT image_id, greatest(3, least(8, round_even(least(w, h) * 0.05, 0))) AS most FROM box WHERE x1 - x0 >= 4 AND y1 - y0 >= 3),
    body AS (SELECT *, greatest(path, m) AS pl, greatest(area / greatest(path, m), 1) AS sw FROM head JOIN len USING (image_id, root) JOIN host USING (image_id) WHERE functional),
    slit AS (SELECT * FROM body WHERE pl >= 4 AND sw <= most),
    ends AS (SELECT *, first(x) OVER v AS xa, first(y) OVER v AS ya, last(x) OVER v AS xb, last(y) OVER v AS yb FROM line JOIN slit USING (image_id, root) WINDOW v AS (PARTITION BY image_id, root ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    off AS (SELECT *, round(CASE WHEN (xb - xa)^2 + (yb - ya)^2 > 0 THEN ((x - xa) * (yb - ya) - (y - ya) * (xb - xa)) / sqrt((xb - xa)^2 + (yb - ya)^2) ELSE sqrt((x - xa)^2 + (y - ya)^2) END, 9) AS o FROM ends),
    way AS (SELECT image_id, root, any_value(pl) AS pl, any_value(sw) AS sw, any_value(m) AS m, max(o) AS up, -min(o) AS down, max(abs(o)) AS far, arg_min(i, -abs(o) * 1e9 + i) AS far_i, any_value(xa) AS xa, any_value(ya) AS ya, any_value(xb) AS xb, any_value(yb) AS yb FROM off GROUP BY ALL),
    formed AS (SELECT *, CASE WHEN up >= greatest(1, sw * 0.6) AND down >= greatest(1, sw * 0.6) THEN 'winding' WHEN far >= greatest(1, sw * 0.75) THEN 'bowed' ELSE 'straight' END AS form FROM way)
    SELECT f.image_id, form, round(pl, 6) AS path_length, round(sw, 6) AS stroke_width, (CASE form WHEN 'winding' THEN least(m, 7) WHEN 'bowed' THEN 3 ELSE 2 END)::INT AS n_points, round(xa, 6) AS first_x, round(ya, 6) AS first_y,
           round(CASE form WHEN 'straight' THEN xb ELSE l.x END, 6) AS second_x, round(CASE form WHEN 'straight' THEN yb ELSE l.y END, 6) AS second_y, round(xb, 6) AS last_x, round(yb, 6) AS last_y
    FROM formed f JOIN line l ON l.image_id = f.image_id AND l.root = f.root AND l.i = CASE WHEN form <> 'winding' THEN far_i WHEN m <= 7 THEN 1 ELSE round_even((m - 1) / 6, 0) END"""

def _kasa(points: str, out: str, most: str = "true") -> str:
    """CTE: the least-squares circle of each image's points, and their number."""
    return f"""
    {out}_s AS (SELECT image_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy, sum(x * (x * x + y * y))::DOUBLE AS sxz, sum(y * (x * x + y * y))::DOUBLE AS syz FROM {points} GROUP BY image_id),
    {out}_m AS (SELECT *, n * sxx - sx * sx AS a, n * sxy - sx * sy AS b, n * syy - sy * sy AS c, (n * sxz - sx * (sxx + syy)) / 2 AS d, (n * syz - sy * (sxx + syy)) / 2 AS e FROM {out}_s),
    {out}_k AS (SELECT *, (d * c - b * e) / (a * c - b * b) AS cx, (a * e - b * d) / (a * c - b * b) AS cy FROM {out}_m WHERE abs(a * c - b * b) > 1e-9),
    {out} AS MATERIALIZED (SELECT * FROM (SELECT image_id, n, cx, cy, sqrt((sxx + syy - 2 * cx * sx - 2 * cy * sy) / n + cx * cx + cy * cy) AS r FROM {out}_k) WHERE {most})"""


def _around(circles: str, out: str) -> str:
    """CTE: the ink with distance d and angle a from the circle's centre, a against the mean angle."""
    return f"""
    {out}_t AS (SELECT i.*, c.* EXCLUDE (image_id), sqrt((x - cx)^2 + (y - cy)^2) AS d, atan2(y - cy, x - cx) AS t FROM ink i JOIN {circles} c USING (image_id)),
    {out}_m AS (SELECT image_id, atan2(sum(sin(t)), sum(cos(t))) AS mean FROM {out}_t GROUP BY image_id),
    {out} AS MATERIALIZED (SELECT *, t - mean + {_PI} - 2 * {_PI} * floor((t - mean + {_PI}) / (2 * {_PI})) - {_PI} AS a FROM {out}_t JOIN {out}_m USING (image_id))"""


_ARCS = f"""WITH {_INK}, {_BOX}, {_kasa("ink", "k1")},
    c1 AS MATERIALIZED (SELECT image_id, cx, cy, r, w, h, area FROM k1 JOIN box USING (image_id) WHERE greatest(w, h) - 1 >= 4 AND least(w, h) >= 3 AND area <= 0.55 * w * h AND area >= 8 AND r >= 2 AND r <= 4 * greatest(w, h)),
    {_around("c1", "p1")},
    l1 AS (SELECT image_id, min(d) AS inner_d, max(d) AS outer_d, min(a) AS a0, max(a) AS a1, coalesce(max(g), 0) AS gap FROM (SELECT *, a - lag(a) OVER (PARTITION BY image_id ORDER BY a) AS g FROM p1) GROUP BY image_id),
    o1 AS (SELECT image_id, avg(abs(d - (inner_d + outer_d) / 2)) AS band_residual FROM p1 JOIN l1 USING (image_id) GROUP BY image_id),
    held AS MATERIALIZED (SELECT * FROM (SELECT c1.image_id, area, r, a0, a1, gap, band_residual, greatest(outer_d - inner_d, 1) AS band FROM c1 JOIN l1 USING (image_id) JOIN o1 USING (image_id))
             WHERE band <= 0.9 * r AND band_residual <= band * 0.5 + 0.5 AND a1 - a0 BETWEEN 0.3 AND 5.9 AND gap <= greatest(0.35, (a1 - a0) * 0.2)),
    mids AS (SELECT image_id, floor(round((p.a - h.a0) / (h.a1 - h.a0) * (greatest(8, least(48, h.area // 4)) - 1) + 0.5, 9)) AS bin, avg(x) AS x, avg(y) AS y FROM p1 p JOIN held h USING (image_id) GROUP BY ALL),
    {_kasa("mids", "c2", "n >= 5 AND r >= 2")},
    leave AS (SELECT image_id, avg(abs(sqrt((x - cx)^2 + (y - cy)^2) - r)) AS midpoint_residual FROM mids JOIN c2 USING (image_id) GROUP BY image_id),
    {_around("c2", "p2")},
    l2 AS (SELECT image_id, min(a) AS a0, max(a) AS a1 FROM p2 GROUP BY image_id),
    q2 AS MATERIALIZED (SELECT p.image_id, p.a, p.d, a0, a1, least(7, greatest(0, floor(round((p.a - a0) / (a1 - a0) * 8, 9)))) AS part FROM p2 p JOIN l2 USING (image_id) WHERE a1 > a0),
    ten AS (SELECT image_id, max(CASE WHEN k = least(floor(n * 0.1), n - 1) THEN d END) AS low, max(CASE WHEN k = least(floor(n * 0.9), n - 1) THEN d END) AS high FROM (SELECT image_id, d, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM q2) GROUP BY image_id),
    eighth AS (SELECT image_id, part, any_value(n) AS n, max(CASE WHEN k = least(floor(n * 0.1), n - 1) THEN d END) AS low, max(CASE WHEN k = least(floor(n * 0.9), n - 1) THEN d END) AS high FROM (SELECT image_id, part, d, row_number() OVER (PARTITION BY image_id, part ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY image_id, part) AS n FROM q2) GROUP BY ALL HAVING any_value(n) >= 6),
    tap AS (SELECT image_id, CASE WHEN count(*) >= 3 THEN max(greatest(high - low, 0.5)) / min(greatest(high - low, 0.5)) ELSE 1 END AS taper FROM eighth GROUP BY image_id),
    j AS (SELECT h.image_id, h.area, h.band, h.band_residual, c2.cx, c2.cy, c2.r, midpoint_residual, l2.a0, l2.a1, coalesce(taper, 1) AS taper, greatest((h.area / greatest((l2.a1 - l2.a0) * c2.r, 1) + (high - low) / 0.8 + 1) / 2, 1) AS stroke_width
          FROM held h JOIN c2 USING (image_id) JOIN leave USING (image_id) JOIN l2 USING (image_id) JOIN ten USING (image_id) LEFT JOIN tap USING (image_id)),
    cap AS (SELECT *, asin(least(0.95, stroke_width / 2 / greatest(r, 1))) AS cap FROM j),
    tips AS (SELECT c.image_id, count(*) FILTER (q.a < c.a0 + cap) AS at_start, count(*) FILTER (q.a > c.a1 - cap) AS at_end FROM q2 q JOIN cap c USING (image_id) GROUP BY c.image_id),
    cut AS (SELECT *, a1 - a0 BETWEEN 0.3 AND 5.9 AS long, a1 - a0 - CASE WHEN cap > 0.01 AND stroke_width >= 4 AND at_start / greatest(cap * r * stroke_width, 1) < 0.9 THEN cap ELSE 0 END
                       - CASE WHEN cap > 0.01 AND stroke_width >= 4 AND at_end / greatest(cap * r * stroke_width, 1) < 0.9 THEN cap ELSE 0 END AS span FROM cap JOIN tips USING (image_id)),
    z AS (SELECT *, abs(2 * r * sin(span / 2)) AS chord, r * (1 - cos(span / 2)) AS sagitta FROM cut),
    good AS (SELECT *, sagitta / greatest(chord, 1) AS bow FROM z WHERE long AND span >= 0.3 AND midpoint_residual <= 0.42 AND (band < 4 OR taper <= 1.8) AND chord >= 4 AND sagitta >= 1 AND sagitta / greatest(chord, 1) >= 0.1)
    SELECT b.image_id, g.image_id IS NOT NULL AS fits, {", ".join(f"round({c}, 6) AS {c}" for c in ("cx", "cy", "r", "span", "stroke_width", "midpoint_residual", "taper", "bow"))}, round(band_residual / greatest(band, 1) * 0.1, 6) AS raster_error FROM box b LEFT JOIN good g USING (image_id)"""

_BEST = f"""WITH RECURSIVE {_INK}, {_BOX},
    fill AS (SELECT *, 1 - area / (w * h) AS fill_error, greatest(w, h) AS longer, least(w, h) AS shorter FROM box),
    reach AS (SELECT image_id, max(sqrt((x - mx)^2 + (y - my)^2)) + 0.5 AS o, greatest(min(sqrt((x - mx)^2 + (y - my)^2)) - 0.5, 0) AS i FROM ink JOIN box USING (image_id) GROUP BY image_id),
    rings AS (SELECT *, abs(area - {_PI} * (o * o - i * i)) / ({_PI} * (o * o - i * i)) AS e FROM fill JOIN reach USING (image_id)),
    c AS (SELECT image_id, 0 AS ord, 'stroke_circle' AS kind, e::DOUBLE AS e, 1 AS nodes, 4 AS parameters FROM rings WHERE longer >= 6 AND 1 - shorter / longer <= 0.18 AND i / o >= 0.25 AND e <= 0.45
        UNION ALL SELECT image_id, 1, 'circle', raster_error, 1, 3 FROM ({_CIRCLES}) WHERE fits
        UNION ALL SELECT image_id, 2, CASE form WHEN 'ring' THEN 'stroke_ellipse' ELSE 'ellipse' END, raster_error, 1, CASE form WHEN 'aligned' THEN 4 ELSE 5 END FROM ({_ELLIPSES}) WHERE fits
        UNION ALL SELECT image_id, 3, 'stroke_polyline', fill_error, 2, 5 FROM fill WHERE longer >= 4 AND longer >= 3 * shorter
        UNION ALL SELECT image_id, 4, 'arc', raster_error, 3, 7 FROM ({_ARCS}) WHERE fits
        UNION ALL SELECT image_id, 5, 'stroke_path', residual * 0.1, n_controls, 3 * n_controls FROM ({_STROKES.replace("round(coalesce(residual, 0), 6)", "coalesce(residual, 0)")}) WHERE fits
        UNION ALL SELECT image_id, 6, 'rect', fill_error, 4, 4 FROM fill WHERE fill_error <= 0.08
        UNION ALL SELECT image_id, 7, 'rounded_rect', fill_error, 4, 5 FROM fill WHERE fill_error > 0 AND fill_error <= 0.30 AND shorter >= 3
        UNION ALL SELECT q.image_id, 8, 'quad', q.fill_error, 4, 8 FROM ({_QUADS}) q JOIN fill USING (image_id) WHERE shorter >= 3 AND fill.fill_error <= 0.65 AND q.fill_error <= 0.28 AND expected > 0
        UNION ALL SELECT image_id, 9, 'cubic_path', 0.35, 16, 32 FROM fill),
    s AS (SELECT *, e + 0.015 * nodes + 0.01 * parameters - CASE WHEN kind IN (@ROUND) THEN 0.35 WHEN kind IN (@SIMPLE) THEN 0.25 ELSE 0 END AS score, count(*) OVER (PARTITION BY image_id) AS n_candidates FROM c)
    SELECT image_id, kind, round(score, 6) AS score, n_candidates FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score, ord) = 1"""
for _name, _kinds in (("@ROUND", S.ROUND_KINDS), ("@SIMPLE", S.SIMPLE_KINDS)):
    _BEST = _BEST.replace(_name, ", ".join(f"'{k}'" for k in _kinds))

ORACLE = {
    "outline_corners": f"WITH {_CORNERS} SELECT image_id, len(corners)::INT AS n_corners, array_to_string(corners, ',') AS corners FROM corners",
    "bezier_outline": f"WITH RECURSIVE {_SEGMENTS} SELECT image_id, lo, hi, {', '.join(f'round("{c}", 4) AS "{c}"' for c in ('ax', 'ay', 'cx', 'cy', 'dx', 'dy', 'bx', 'by', 'error'))} FROM segments",
    "path_candidates": f"""WITH RECURSIVE {_SEGMENTS},
        l AS (SELECT o.image_id, sum(sqrt((n.x - o.x)^2 + (n.y - o.y)^2)) AS perimeter FROM outline o JOIN outline n ON n.image_id = o.image_id AND n.ord = (o.ord + 1) % {POINTS} GROUP BY 1),
        c AS (SELECT image_id, count(*) AS node_count, max(error) AS max_error FROM segments GROUP BY 1)
        SELECT image_id, node_count, 2 * node_count AS parameter_count, round(max_error, 4) AS max_error, least(36, greatest(16, round(perimeter / 12)::INT))::INT AS budget,
               round(0.35 + greatest(0, least(36, greatest(16, round(perimeter / 12)::INT)) - node_count) * 0.035, 4) AS raster_error FROM c JOIN l USING (image_id)""",
    "ellipse_fits": _ELLIPSES,
    "circle_fits": _CIRCLES,
    "quad_fill_error": _QUADS,
    "smooth_strokes": _STROKES,
    "cutout_strokes": _CUTOUTS,
    "arc_candidates": _ARCS,
    "best_primitive": _BEST,
}
