"""Raster and fitting queries: each 64-float embedding is an 8 x 8 raster whose positive values are ink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import fit, gates, raster, render, scene
from inkframe.sources.tables import table

SIDE = 8


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels_from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", SIDE)


def ink(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).filter("value > 0").select("image_id", "idx", "x", "y")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def component_geometry(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(raster.component_geometry(ink(spark, d), "image_id"), "centroid_x", "centroid_y")


def row_spans(spark: SparkSession, d: str) -> DataFrame:
    return raster.spans(ink(spark, d), "image_id")


def boundary_pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.boundary_pixels(ink(spark, d), "image_id").select("image_id", "x", "y")


def projection_bands(spark: SparkSession, d: str) -> DataFrame:
    return raster.dense_bands(ink(spark, d), "image_id", share=0.5, extent=SIDE)


def connected_components_8(spark: SparkSession, d: str) -> DataFrame:
    labelled = raster.connected_components(ink(spark, d), "image_id")
    return raster.component_geometry(labelled, "image_id", "component_id").select("image_id", "component_id", "area", "min_x", "min_y", "max_x", "max_y")


def interior_gaps(spark: SparkSession, d: str) -> DataFrame:
    return raster.interior_gaps(ink(spark, d), "image_id").groupBy("image_id").agg(F.count("*").alias("gap_cells"))


def gap_components(spark: SparkSession, d: str) -> DataFrame:
    return raster.gap_components(ink(spark, d), "image_id")


def kasa_circle_fit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.kasa_circle(ink(spark, d), "image_id"), "cx", "cy", "r")


def principal_axis(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.principal_axis(ink(spark, d), "image_id").select("image_id", "n", "cx", "cy", "length", "width"), "cx", "cy", "length", "width")


def rect_fill_error(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.rect_fit(ink(spark, d), "image_id").select("image_id", "area", "fill_error"), "fill_error")


def extreme_quad(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.extreme_quad(ink(spark, d), "image_id").select("image_id", "area", "quad_area"), "quad_area")


def vanishing_lines(spark: SparkSession, d: str) -> DataFrame:
    """The images of one label are a scene, the extreme corners of each image a quad in it."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return gates.vanishing_lines(fit.extreme_quad(ink(spark, d), "image_id").join(labels, "image_id"), "label")


def drawn_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding is a drawn anchor, of one of eight forms by its id; its first numbers are the form's."""
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    points = [F.struct(v(k).alias("x"), v(k + 1).alias("y")) for k in (0, 2, 4, 6)]
    form = F.col("vec_id") % 8
    round_one = lambda *fields: F.struct(v(0).alias("cx"), v(1).alias("cy"), *fields)
    a = table(spark, d, "embeddings").select(
        "vec_id", F.get(F.array(*map(F.lit, ("ellipse", "stroke_ellipse", "circle", "stroke_circle", "stroke", "stroke", "quad", "cubic_path"))), form.cast("int")).alias("kind"),
        F.when(form < 2, round_one(F.abs(v(2)).alias("rx"), F.abs(v(3)).alias("ry"), v(4).alias("rotation"))).alias("ellipse"),
        F.when(form.isin(2, 3), round_one(F.abs(v(2)).alias("r"))).alias("circle"),
        F.when(form.isin(1, 3, 4, 5), F.struct(F.when(form == 5, F.array(*points[:3])).otherwise(F.array(*points[:2])).alias("centerline"), F.array(F.abs(v(6)), F.abs(v(7))).alias("width_samples"), F.when(form == 4, "butt").otherwise("round").alias("cap_style"))).alias("stroke"),
        F.when(form == 6, F.struct(F.array(*points).alias("corners"))).alias("quad"),
        F.when(form == 7, F.struct(F.array(*points[:3]).alias("points"))).alias("path"),
    )
    return _rounded(a.select("vec_id", "kind", S.drawn_bounds(F.col("kind")).alias("b")).select("vec_id", "kind", "b.*"), "min_x", "min_y", "max_x", "max_y")


def ink_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(raster.ink_features(pixels(spark, d), F.col("value") > 0, SIDE, SIDE), "value")


def _gray(spark: SparkSession, d: str, shift: int) -> DataFrame:
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("value") * 64 + 128))).cast("int")
    return pixels(spark, d).select((F.col("image_id") + shift).alias("image_id"), "x", "y", *[level.alias(c) for c in "rgb"], F.when(F.col("value") > -1.0, 255).otherwise(0).alias("a"))


def raster_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Each raster against the next vector's."""
    return _rounded(raster.raster_fidelity(_gray(spark, d, 0), _gray(spark, d, -1)), "raster_l1_error", "raster_alpha_error", "raster_edge_error")


def nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    """The parts' prices and sizes as colours, each with its nearest of eight fixed palette colours."""
    colors = table(spark, d, "part").select("p_partkey", F.array((F.col("p_partkey") % 256).cast("double"), (F.col("p_size") * 5).cast("double"), (F.floor("p_retailprice") % 256).cast("double")).alias("rgb"))
    palette = spark.range(8).select(F.col("id").alias("color_id"), F.array(F.when(F.col("id") % 2 == 1, 255.0).otherwise(0.0), F.when(F.floor(F.col("id") / 2) % 2 == 1, 255.0).otherwise(0.0), F.when(F.floor(F.col("id") / 4) == 1, 255.0).otherwise(0.0)).alias("v"))
    out = raster.nearest_of(colors, palette, "p_partkey", "rgb", "color_id", "v")
    return out.select("p_partkey", F.col("nearest_key").alias("color_id"), F.round("distance", 6).alias("distance"))


def modal_color(spark: SparkSession, d: str) -> DataFrame:
    """The most common quantised value of each raster, first seen of equally common ones."""
    return raster.modal_color(pixels(spark, d).withColumn("color", F.floor("value").cast("int")), "image_id")


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Every component's best primitive by semantic score."""
    labelled = raster.connected_components(ink(spark, d), "image_id")
    scored = fit.with_semantic_score(fit.candidates(labelled, "image_id", "component_id"))
    return _rounded(fit.choose_best(scored, "image_id", "component_id").select("image_id", "component_id", "kind", "score"), "score")


def image_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The same with all ink of a raster as one component."""
    scored = fit.with_semantic_score(fit.candidates(ink(spark, d), "image_id"))
    return _rounded(fit.choose_best(scored, "image_id").select("image_id", "kind", "score"), "score")


def circular_smoothing(spark: SparkSession, d: str) -> DataFrame:
    out = scene.circular_smoothing(pixels(spark, d), "image_id", value="value", ordinal="idx", size=64)
    return _rounded(out.select("image_id", "idx", "smoothed"), "smoothed")


def tolerant_palette(spark: SparkSession, d: str) -> DataFrame:
    """Pixels per tolerant colour bucket of each raster."""
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("value") * k + 128))).cast("int")
    p = pixels(spark, d).select("image_id", "idx", level(48).alias("r"), level(64).alias("g"), level(24).alias("b"))
    return raster.tolerant_buckets(p, 24.0, (128, 128, 128)).groupBy("image_id", F.col("bucket.r").alias("r"), F.col("bucket.g").alias("g"), F.col("bucket.b").alias("b")).agg(F.count("*").alias("pixels"))


def dominant_palette(spark: SparkSession, d: str) -> DataFrame:
    """Dominant colours of each label's rasters taken as one image."""
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("value") * k + 128))).cast("int")
    e = table(spark, d, "embeddings").select(F.col("label").alias("image_id"), "vec_id", F.posexplode("embedding").alias("i", "value"))
    p = e.select("image_id", (F.col("vec_id") * 64 + F.col("i")).alias("idx"), level(48).alias("r"), level(64).alias("g"), level(24).alias("b"))
    return raster.dominant_palette(p, (128, 128, 128), 8)


def contact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Components of a raster that touch or overlap; alternating components have different colours."""
    c = raster.component_geometry(raster.connected_components(ink(spark, d), "image_id"), "image_id", "component_id")
    a = c.select("image_id", F.col("component_id").alias("anchor_index"), F.when(F.col("component_id") % 2 == 0, "#000000").otherwise("#ffffff").alias("color"), *[F.col(k).cast("double").alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])
    return _rounded(scene.contact_pairs(a, "image_id"), "bounds_gap", "bounds_iou")


def svg_elements(spark: SparkSession, d: str) -> DataFrame:
    """Counts of markup elements in the pages."""
    tags = table(spark, d, "pages").select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("element"))
    return tags.groupBy("element").agg(F.count("*").alias("n"))


def boundary_roundness(spark: SparkSession, d: str) -> DataFrame:
    """Roundness error of each raster's boundary about its centroid, and the smoothness of its column means."""
    edge = raster.boundary_pixels(ink(spark, d), "image_id")
    circles = fit.kasa_circle(ink(spark, d), "image_id").select("image_id", "cx", "cy", "r").filter("r > 0")
    both = edge.join(circles, "image_id")
    dist = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    out = both.groupBy("image_id").agg((F.stddev_pop(dist) / F.first("r")).alias("roundness_error"), (F.avg(F.abs(dist - F.col("r"))) / F.first("r")).alias("mean_residual"))
    return _rounded(out, "roundness_error", "mean_residual")


def column_mean_smoothness(spark: SparkSession, d: str) -> DataFrame:
    means = ink(spark, d).groupBy("image_id", "x").agg(F.avg("y").alias("y"))
    lines = means.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "y"))).alias("points"))
    return lines.select("image_id", F.round(S.line_smoothness_error(F.col("points")), 6).alias("line_smoothness_error"))


def _disc(spark: SparkSession, d: str) -> DataFrame:
    """Each raster's ink as the disc of its bounds."""
    box = raster.component_geometry(ink(spark, d), "image_id")
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return box.select("image_id", F.lit("ellipse").alias("kind"), F.lit(0).alias("anchor_index"), F.lit("#000000").alias("color"), "area", ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"), (w / 2).alias("rx"), (h / 2).alias("ry"), F.lit(1.0).alias("width"), "min_x", "min_y", "max_x", "max_y")


def render_error(spark: SparkSession, d: str) -> DataFrame:
    """The ellipse of the bounds against the ink: pixels of one side over those of either."""
    drawn = render.render(_disc(spark, d), "image_id", width=SIDE, height=SIDE)
    return _rounded(render.coverage_error(ink(spark, d), drawn, "image_id"), "coverage_error")


def outline_lengths(spark: SparkSession, d: str) -> DataFrame:
    labelled = raster.connected_components(ink(spark, d), "image_id")
    return render.trace_outline(labelled, "image_id", "component_id").groupBy("image_id", "component_id").agg(F.count("*").alias("steps"))


def refined_circles(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares circles after four rounds of coordinate descent."""
    p = ink(spark, d)
    start = fit.kasa_circle(p, "image_id").filter("r > 0")
    return _rounded(render.refine_circles(p, start, "image_id"), "cx", "cy", "r", "error")


def ring_fit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.ring_fit(ink(spark, d), "image_id"), "cx", "cy", "r", "width", "area_error")


def arc_fit(spark: SparkSession, d: str) -> DataFrame:
    out = fit.arc_fit(ink(spark, d), "image_id")
    return _rounded(out.select("image_id", "span", "density", "is_arc"), "span", "density", digits=5)


def stroke_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fit.stroke_profile(ink(spark, d), "image_id"), "mean_width", "stroke_width_variance", "bow")


QUERIES = {f.__name__: f for f in (
    component_geometry, row_spans, boundary_pixels, projection_bands, connected_components_8, interior_gaps, gap_components, kasa_circle_fit, principal_axis,
    rect_fill_error, extreme_quad, vanishing_lines, drawn_bounds, ink_features, raster_fidelity, nearest_palette, modal_color, best_candidate, image_best_candidate, circular_smoothing,
    tolerant_palette, dominant_palette, contact_pairs, svg_elements, boundary_roundness, column_mean_smoothness, render_error, outline_lengths, refined_circles, ring_fit, arc_fit, stroke_profile,
)}

_PX = "px AS (SELECT vec_id AS image_id, i::INT AS idx, (i % 8)::INT AS x, (i // 8)::INT AS y, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)), ink AS (SELECT image_id, idx, x, y FROM px WHERE v > 0)"
_CC = f"""RECURSIVE {_PX},
    reach AS (SELECT image_id, x, y, idx AS root FROM ink
              UNION SELECT n.image_id, n.x, n.y, r.root FROM reach r JOIN ink n ON n.image_id = r.image_id AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND n.idx > r.root),
    lab AS (SELECT image_id, x, y, min(root) AS root FROM reach GROUP BY ALL),
    comp AS (SELECT image_id, root, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM lab GROUP BY ALL),
    numbered AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) - 1)::INT AS component_id FROM comp)"""
_KASA = """s AS (SELECT image_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x*x)::DOUBLE AS sxx, sum(y*y)::DOUBLE AS syy, sum(x*y)::DOUBLE AS sxy,
            sum(x*(x*x+y*y))::DOUBLE AS sxz, sum(y*(x*x+y*y))::DOUBLE AS syz FROM ink GROUP BY image_id),
        m AS (SELECT *, n*sxx - sx*sx AS a, n*sxy - sx*sy AS b, n*syy - sy*sy AS c, (n*sxz - sx*(sxx+syy))/2 AS d, (n*syz - sy*(sxx+syy))/2 AS e FROM s),
        q AS (SELECT *, CASE WHEN abs(a*c-b*b) > 1e-9 THEN (d*c-b*e)/(a*c-b*b) END AS cx, CASE WHEN abs(a*c-b*b) > 1e-9 THEN (a*e-b*d)/(a*c-b*b) END AS cy FROM m)"""
_CANDIDATES = """
    boxes AS (SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h FROM src),
    g AS (SELECT *, 1 - area / (w * h) AS fill, greatest(w, h) AS lo, least(w, h) AS sh, pi() * ((w + h) / 4) ** 2 AS disc, pi() / 4 * w * h AS oval FROM boxes),
    c AS (
        SELECT *, 0 AS ord, 'circle' AS kind, abs(area - disc) / disc AS e, 1 AS nodes, 3 AS params, 0.35 AS bonus FROM g WHERE lo >= 3 AND 1 - sh / lo <= 0.22 AND abs(area - disc) / disc <= 0.35
        UNION ALL SELECT *, 1, 'ellipse', abs(area - oval) / oval, 1, 4, 0.25 FROM g WHERE sh >= 3 AND abs(area - oval) / oval <= 0.35
        UNION ALL SELECT *, 2, 'stroke_polyline', fill, 2, 5, 0.25 FROM g WHERE lo >= 4 AND lo >= 3 * sh
        UNION ALL SELECT *, 3, 'rect', fill, 4, 4, 0.25 FROM g WHERE fill <= 0.08
        UNION ALL SELECT *, 4, 'rounded_rect', fill, 4, 5, 0.25 FROM g WHERE fill > 0 AND fill <= 0.30 AND sh >= 3
        UNION ALL SELECT *, 5, 'cubic_path', 0.35, 16, 32, 0.0 FROM g),
    s AS (SELECT *, round(e, 9) + 0.015 * nodes + 0.01 * params - bonus AS score FROM c)"""

ORACLE = {
    "component_geometry": f"WITH {_PX} SELECT image_id, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y FROM ink GROUP BY image_id",
    "row_spans": f"WITH {_PX} SELECT image_id, y, min(x) AS span_start, max(x) AS span_end, count(*) AS n FROM ink GROUP BY image_id, y",
    "boundary_pixels": f"""WITH {_PX} SELECT image_id, x, y FROM ink a WHERE (SELECT count(*) FROM ink b WHERE b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1) < 4""",
    "projection_bands": f"""WITH {_PX}, c AS (SELECT image_id, y, count(*) AS n FROM ink GROUP BY ALL),
        i AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y) - row_number() OVER (PARTITION BY image_id, n >= 4 ORDER BY y) AS k FROM c)
        SELECT image_id, min(y) AS band_start, max(y) AS band_end, sum(n)::BIGINT AS pixels FROM i WHERE n >= 4 GROUP BY image_id, k HAVING max(y) - min(y) + 1 >= 2""",
    "connected_components_8": f"WITH {_CC} SELECT image_id, component_id, area, min_x, min_y, max_x, max_y FROM numbered",
    "interior_gaps": f"""WITH {_PX}, b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ink GROUP BY image_id)
        SELECT px.image_id, count(*) AS gap_cells FROM px JOIN b ON px.image_id = b.image_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE v <= 0 GROUP BY px.image_id""",
    "gap_components": f"""WITH RECURSIVE {_PX}, b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ink GROUP BY image_id),
        gap AS (SELECT px.image_id, idx, x, y, x IN (x0, x1) OR y IN (y0, y1) AS edge FROM px JOIN b ON px.image_id = b.image_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE v <= 0),
        reach AS (SELECT image_id, x, y, edge, idx AS root FROM gap
              UNION SELECT n.image_id, n.x, n.y, n.edge, r.root FROM reach r JOIN gap n ON n.image_id = r.image_id AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND n.idx > r.root),
        lab AS (SELECT image_id, x, y, edge, min(root) AS root FROM reach GROUP BY ALL),
        comp AS (SELECT image_id, root, count(*) AS area, NOT bool_or(edge) AS sealed FROM lab GROUP BY ALL)
        SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) - 1)::INT AS gap_id, area, sealed FROM comp""",
    "boundary_roundness": f"""WITH {_PX}, {_KASA},
        c AS (SELECT image_id, cx, cy, sqrt((sxx+syy-2*cx*sx-2*cy*sy)/n + cx*cx + cy*cy) AS r FROM q),
        e AS (SELECT image_id, x, y FROM ink a WHERE (SELECT count(*) FROM ink b WHERE b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1) < 4),
        d AS (SELECT e.image_id, r, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS dist FROM e JOIN c ON e.image_id = c.image_id WHERE r > 0)
        SELECT image_id, round(stddev_pop(dist) / any_value(r), 6) AS roundness_error, round(avg(abs(dist - r)) / any_value(r), 6) AS mean_residual FROM d GROUP BY image_id""",
    "kasa_circle_fit": f"""WITH {_PX}, {_KASA}
        SELECT image_id, n::BIGINT AS n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((sxx+syy-2*cx*sx-2*cy*sy)/n + cx*cx + cy*cy), 6) AS r FROM q""",
    "principal_axis": f"""WITH {_PX}, c AS (SELECT image_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy FROM ink GROUP BY image_id),
        a AS (SELECT *, cos(atan2(2*sxy, sxx-syy)/2) AS ax, sin(atan2(2*sxy, sxx-syy)/2) AS ay FROM c),
        e AS (SELECT image_id, max((x-cx)*ax+(y-cy)*ay) - min((x-cx)*ax+(y-cy)*ay) AS length, max((y-cy)*ax-(x-cx)*ay) - min((y-cy)*ax-(x-cx)*ay) AS width FROM ink JOIN a USING (image_id) GROUP BY image_id)
        SELECT image_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(length, 6) AS length, round(width, 6) AS width FROM a JOIN e USING (image_id)""",
    "rect_fill_error": f"WITH {_PX} SELECT image_id, count(*) AS area, round(1 - count(*) / ((max(x)-min(x)+1)*(max(y)-min(y)+1)), 6) AS fill_error FROM ink GROUP BY image_id",
    "extreme_quad": f"""WITH {_PX}, q AS (SELECT image_id, count(*) AS area,
            arg_min({{'x': x, 'y': y}}, (x+y)*100 + y) AS a, arg_min({{'x': x, 'y': y}}, (y-x)*100 + y) AS b, arg_min({{'x': x, 'y': y}}, (-x-y)*100 - y) AS c, arg_min({{'x': x, 'y': y}}, (x-y)*100 - y) AS d FROM ink GROUP BY image_id)
        SELECT image_id, area, CASE WHEN len(list_distinct([a, b, c, d])) = 4 THEN round(abs((a.x*b.y-b.x*a.y)+(b.x*c.y-c.x*b.y)+(c.x*d.y-d.x*c.y)+(d.x*a.y-a.x*d.y))/2, 6) END AS quad_area FROM q""",
    "vanishing_lines": f"""WITH {_PX}, q AS (SELECT image_id, arg_min({{'x': x, 'y': y}}, (x+y)*100 + y) AS a, arg_min({{'x': x, 'y': y}}, (y-x)*100 + y) AS b, arg_min({{'x': x, 'y': y}}, (-x-y)*100 - y) AS c, arg_min({{'x': x, 'y': y}}, (x-y)*100 - y) AS d FROM ink GROUP BY image_id)
        SELECT label, count(*) AS horizontal_pairs, count(*) AS vertical_pairs, count(*) FILTER ((b.x-a.x)*(c.y-d.y) <> (b.y-a.y)*(c.x-d.x)) + count(*) FILTER ((d.x-a.x)*(c.y-b.y) <> (d.y-a.y)*(c.x-b.x)) AS finite_intersections
        FROM q JOIN embeddings e ON e.vec_id = image_id WHERE len(list_distinct([a, b, c, d])) = 4 GROUP BY label""",
    "drawn_bounds": f"""WITH v AS (SELECT vec_id, vec_id % 8 AS k, {", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(8))} FROM embeddings),
        h AS (SELECT *, (abs(v6) + abs(v7)) / 2 / 2 AS half, sqrt((v2 - v0) * (v2 - v0) + (v3 - v1) * (v3 - v1)) AS len FROM v),
        r AS (SELECT *, abs(v2) + CASE WHEN k IN (1, 3) THEN half ELSE 0 END AS rx, abs(v3) + CASE WHEN k = 1 THEN half ELSE 0 END AS ry FROM h),
        b AS (SELECT vec_id, k, CASE WHEN k < 4 THEN [v0] WHEN k = 4 THEN [v0, v2] WHEN k = 6 THEN [v0, v2, v4, v6] ELSE [v0, v2, v4] END AS xs, CASE WHEN k < 4 THEN [v1] WHEN k = 4 THEN [v1, v3] WHEN k = 6 THEN [v1, v3, v5, v7] ELSE [v1, v3, v5] END AS ys,
            CASE WHEN k < 2 THEN sqrt((rx * cos(v4)) ** 2 + (ry * sin(v4)) ** 2) WHEN k < 4 THEN rx WHEN k = 4 AND len > 0 THEN half * abs(v3 - v1) / len WHEN k < 6 THEN half ELSE 0 END AS dx,
            CASE WHEN k < 2 THEN sqrt((rx * sin(v4)) ** 2 + (ry * cos(v4)) ** 2) WHEN k < 4 THEN rx WHEN k = 4 AND len > 0 THEN half * abs(v2 - v0) / len WHEN k < 6 THEN half ELSE 0 END AS dy FROM r)
        SELECT vec_id, ['ellipse', 'stroke_ellipse', 'circle', 'stroke_circle', 'stroke', 'stroke', 'quad', 'cubic_path'][k + 1] AS kind, round(list_min(xs) - dx, 6) AS min_x, round(list_min(ys) - dy, 6) AS min_y, round(list_max(xs) + dx, 6) AS max_x, round(list_max(ys) + dy, 6) AS max_y FROM b""",
    "ink_features": f"""WITH {_PX}, p AS (SELECT image_id, x, y, (v > 0)::INT AS ink, (y // 2) * 4 + x // 2 AS cell FROM px),
        o AS (SELECT image_id, avg(ink) AS ink_share, coalesce(sum((x+0.5)*ink)/nullif(sum(ink)*8, 0), 0.5)::DOUBLE AS center_x, coalesce(sum((y+0.5)*ink)/nullif(sum(ink)*8, 0), 0.5)::DOUBLE AS center_y,
            coalesce((max(x) FILTER (ink > 0) - min(x) FILTER (ink > 0) + 1)/8, 0)::DOUBLE AS box_w, coalesce((max(y) FILTER (ink > 0) - min(y) FILTER (ink > 0) + 1)/8, 0)::DOUBLE AS box_h FROM p GROUP BY image_id)
        SELECT image_id, feature, round(value, 6) AS value FROM (UNPIVOT o ON ink_share, center_x, center_y, box_w, box_h INTO NAME feature VALUE value)
        UNION ALL SELECT image_id, 'cell_' || cell, round(avg(ink), 6) FROM p GROUP BY image_id, cell""",
    "raster_fidelity": f"""WITH {_PX}, l AS (SELECT image_id, x, y, greatest(0, least(255, floor(v*64+128)))::INT AS g, CASE WHEN v > -1 THEN 255 ELSE 0 END AS a FROM px),
        b AS (SELECT s.image_id, s.x, s.y, s.g AS sg, t.g AS tg, s.a AS sa, t.a AS ta FROM l s JOIN l t ON t.image_id = s.image_id + 1 AND s.x = t.x AND s.y = t.y),
        e AS (SELECT *, coalesce(abs(abs(lead(sg) OVER r - sg) - abs(lead(tg) OVER r - tg)), 0) + coalesce(abs(abs(lead(sg) OVER c - sg) - abs(lead(tg) OVER c - tg)), 0) AS edge
            FROM b WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))
        SELECT image_id, round(sum(CASE WHEN sa > 0 OR ta > 0 THEN 3 * abs(sg - tg) ELSE 0 END) / (count(*)*765), 6) AS raster_l1_error, round(sum(abs(sa - ta)) / (count(*)*255), 6) AS raster_alpha_error,
            round(sum(edge) / (count(*)*510), 6) AS raster_edge_error FROM e GROUP BY image_id""",
    "nearest_palette": """WITH c AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS r, (p_size*5)::DOUBLE AS g, (floor(p_retailprice)::BIGINT % 256)::DOUBLE AS b FROM part),
        k AS (SELECT i AS color_id, CASE WHEN i % 2 = 1 THEN 255 ELSE 0 END AS r, CASE WHEN i // 2 % 2 = 1 THEN 255 ELSE 0 END AS g, CASE WHEN i // 4 = 1 THEN 255 ELSE 0 END AS b FROM range(8) t(i)),
        x AS (SELECT p_partkey, color_id, sqrt((c.r-k.r)**2+(c.g-k.g)**2+(c.b-k.b)**2) AS distance FROM c, k)
        SELECT p_partkey, color_id, round(distance, 6) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY distance, color_id) = 1""",
    "modal_color": f"""WITH {_PX}, c AS (SELECT image_id, floor(v)::INT AS color, count(*) AS n, min(idx) AS f FROM px GROUP BY ALL)
        SELECT image_id, color, sum(n) OVER (PARTITION BY image_id)::BIGINT AS pixels FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) = 1""",
    "best_candidate": f"WITH {_CC}, src AS (SELECT * FROM numbered), {_CANDIDATES} SELECT image_id, component_id, kind, round(score, 6)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY image_id, component_id ORDER BY score, ord) = 1",
    "image_best_candidate": f"""WITH {_PX}, src AS (SELECT image_id, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ink GROUP BY image_id), {_CANDIDATES}
        SELECT image_id, kind, round(score, 6)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score, ord) = 1""",
    "circular_smoothing": f"WITH {_PX} SELECT a.image_id, a.idx, round(avg(b.v), 6) AS smoothed FROM px a JOIN px b ON a.image_id = b.image_id AND (b.idx - a.idx + 66) % 64 <= 4 GROUP BY a.image_id, a.idx",
    "contact_pairs": f"""WITH {_CC}, a AS (SELECT image_id, component_id AS i, component_id % 2 AS color, min_x::DOUBLE AS x0, min_y::DOUBLE AS y0, max_x::DOUBLE AS x1, max_y::DOUBLE AS y1 FROM numbered),
        p AS (SELECT a.image_id, a.i, b.i AS j, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter,
                sqrt(greatest(a.x0-b.x1, b.x0-a.x1, 0)**2 + greatest(a.y0-b.y1, b.y0-a.y1, 0)**2) AS gap, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) AS areas
            FROM a JOIN a b ON a.image_id = b.image_id AND a.i < b.i AND a.color <> b.color)
        SELECT image_id, i AS anchor_index, j AS anchor_index_2, CASE WHEN inter > 0 THEN 'overlapping' ELSE 'touching' END AS relation, round(gap, 6) AS bounds_gap,
            round(CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END, 6)::DOUBLE AS bounds_iou FROM p WHERE gap <= 1 OR inter > 0""",
    "ring_fit": f"""WITH {_PX}, b AS (SELECT image_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ink GROUP BY image_id),
        f AS (SELECT image_id, max(sqrt((x-cx)**2 + (y-cy)**2)) + 0.5 AS o, greatest(min(sqrt((x-cx)**2 + (y-cy)**2)) - 0.5, 0) AS i FROM ink JOIN b USING (image_id) GROUP BY image_id),
        e AS (SELECT *, abs(area - pi()*(o*o-i*i)) / (pi()*(o*o-i*i)) AS er FROM b JOIN f USING (image_id))
        SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round((i+o)/2, 6) AS r, round(o-i, 6) AS width, round(er, 6) AS area_error, greatest(w, h) >= 6 AND 1 - least(w, h)/greatest(w, h) <= 0.18 AND i/o >= 0.25 AND er <= 0.45 AS is_ring FROM e""",
    "stroke_profile": f"""WITH {_PX}, c AS (SELECT image_id, x, avg(y) AS y, count(*) AS w FROM ink GROUP BY image_id, x),
        e AS (SELECT image_id, arg_min(y, x) AS y0, arg_max(y, x) AS y1, min(x) AS x0, max(x) AS x1 FROM c GROUP BY image_id),
        o AS (SELECT image_id, w, abs(y - (y0 + coalesce((y1-y0)*(x-x0)/nullif(x1-x0, 0), 0))) AS off, greatest(sqrt((x1-x0)**2 + (y1-y0)**2), 1) AS len FROM c JOIN e USING (image_id))
        SELECT image_id, round(avg(w), 6) AS mean_width, round(stddev_pop(w)/avg(w), 6) AS stroke_width_variance, round(max(off)/any_value(len), 6) AS bow FROM o GROUP BY image_id""",
    "render_error": f"""WITH {_PX}, b AS (SELECT image_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ink GROUP BY image_id),
        s AS (SELECT px.image_id, v > 0 AS i, x BETWEEN a AND b AND y BETWEEN c AND d AND sqrt(((x - (a + b) / 2) / ((b - a + 1) / 2)) ** 2 + ((y - (c + d) / 2) / ((d - c + 1) / 2)) ** 2) <= 1 AS o FROM px JOIN b USING (image_id))
        SELECT image_id, round(count(*) FILTER (i <> o) / count(*) FILTER (i OR o), 6) AS coverage_error FROM s GROUP BY image_id""",
    "svg_elements": "SELECT element, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS element FROM pages) GROUP BY element",
    "column_mean_smoothness": f"""WITH {_PX}, m AS (SELECT image_id, x::DOUBLE AS x, avg(y) AS y FROM ink GROUP BY image_id, x),
        d AS (SELECT image_id, x, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM m WINDOW w AS (PARTITION BY image_id ORDER BY x))
        SELECT image_id, round(CASE WHEN count(*) < 3 THEN 0 ELSE stddev_pop(dy / sqrt(dx*dx+dy*dy)) END, 6)::DOUBLE AS line_smoothness_error FROM d GROUP BY image_id""",
}
