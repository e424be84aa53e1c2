"""Scene manifests and SVG: read, explode, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
#: The document that describes a scene; unknown fields are left out.
MANIFEST = f"""schema_version INT, width INT, height INT, anchor_count INT,
anchors ARRAY<STRUCT<id: STRING, kind: STRING, color: STRING, layer: STRING, confidence: DOUBLE, raster_error: DOUBLE, node_count: INT, parameter_count: INT, metrics: MAP<STRING, DOUBLE>,
  circle: STRUCT<cx: DOUBLE, cy: DOUBLE, r: DOUBLE>, ellipse: STRUCT<cx: DOUBLE, cy: DOUBLE, rx: DOUBLE, ry: DOUBLE, rotation: DOUBLE>,
  arc: STRUCT<cx: DOUBLE, cy: DOUBLE, r: DOUBLE, theta_start: DOUBLE, theta_end: DOUBLE, sweep: BOOLEAN, large_arc: BOOLEAN>,
  stroke: STRUCT<centerline: ARRAY<{_POINT}>, width_samples: ARRAY<DOUBLE>, is_cutout: BOOLEAN, cap_style: STRING, join_style: STRING, closed: BOOLEAN>,
  quad: STRUCT<corners: ARRAY<{_POINT}>>, path: STRUCT<points: ARRAY<{_POINT}>, closed: BOOLEAN, node_count: INT>, promotion_state: STRING>>,
diagnostics ARRAY<STRUCT<code: STRING, stage: STRING, level: STRING>>, metrics MAP<STRING, STRING>"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest.json under path (a folder per run), with run: the folder's name."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
    return docs.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def explode_anchors(manifests: DataFrame) -> DataFrame:
    return manifests.select("run", "width", "height", F.posexplode("anchors").alias("anchor_index", "a")).select("run", "width", "height", "anchor_index", "a.*")


def run_summaries(manifests: DataFrame) -> DataFrame:
    """Per run: anchor and warning counts, kinds, and the named metrics."""
    metric = lambda k: F.expr(f"try_cast(metrics['{k}'] AS DOUBLE)").alias(k)
    warnings = F.size(F.filter(F.coalesce("diagnostics", F.array().cast("array<struct<code:string,stage:string,level:string>>")), lambda x: x["level"] == "warning"))
    kinds = F.array_sort(F.array_distinct(F.col("anchors.kind")))
    return manifests.select("run", F.greatest(F.size("anchors"), F.lit(0)).alias("anchors"), kinds.alias("kinds"), warnings.alias("warnings"), metric("editability_score"), metric("fragmentation_penalty"), metric("raster_l1_error"), metric("raster_edge_error"))


def _number(c: Column) -> Column:
    text = F.format_string("%.3f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def _points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", _number(p["x"]), _number(p["y"]))), " ")


def svg_element(kind: Column = None) -> Column:
    """An anchor row as an SVG element; kinds without a form of their own are polylines through their points."""
    kind = F.col("kind") if kind is None else kind
    paint = F.coalesce(F.col("color"), F.lit("#000000"))
    width = _number(F.coalesce(F.get("stroke.width_samples", F.lit(0)), F.lit(1.0)))
    tag = lambda name, *attrs: F.concat(F.lit(f"<{name}"), *[F.concat(F.lit(f' {k}="'), v, F.lit('"')) for k, v in attrs], F.lit("/>"))
    n = lambda path: _number(F.col(path))
    start = F.concat_ws(" ", _number(F.col("arc.cx") + F.col("arc.r") * F.cos("arc.theta_start")), _number(F.col("arc.cy") + F.col("arc.r") * F.sin("arc.theta_start")))
    end = F.concat_ws(" ", _number(F.col("arc.cx") + F.col("arc.r") * F.cos("arc.theta_end")), _number(F.col("arc.cy") + F.col("arc.r") * F.sin("arc.theta_end")))
    arc = F.concat(F.lit("M "), start, F.lit(" A "), n("arc.r"), F.lit(" "), n("arc.r"), F.lit(" 0 "), F.col("arc.large_arc").cast("int").cast("string"), F.lit(" "), F.col("arc.sweep").cast("int").cast("string"), F.lit(" "), end)
    stroke = (("fill", F.lit("none")), ("stroke", paint), ("stroke-width", width))
    return (
        F.when((kind == "circle") & F.col("circle").isNotNull(), tag("circle", ("cx", n("circle.cx")), ("cy", n("circle.cy")), ("r", n("circle.r")), ("fill", paint)))
        .when((kind == "stroke_circle") & F.col("circle").isNotNull(), tag("circle", ("cx", n("circle.cx")), ("cy", n("circle.cy")), ("r", n("circle.r")), *stroke))
        .when(F.col("ellipse").isNotNull(), tag("ellipse", ("cx", n("ellipse.cx")), ("cy", n("ellipse.cy")), ("rx", n("ellipse.rx")), ("ry", n("ellipse.ry")), ("fill", paint)))
        .when((kind == "arc") & F.col("arc").isNotNull(), tag("path", ("d", arc), *stroke))
        .when(F.col("quad").isNotNull(), tag("polygon", ("points", _points(F.col("quad.corners"))), ("fill", paint)))
        .when(F.col("stroke").isNotNull(), tag("polyline", ("points", _points(F.col("stroke.centerline"))), *stroke))
        .otherwise(tag("polygon", ("points", _points(F.col("path.points"))), ("fill", paint)))
    )


def to_svg(anchors: DataFrame) -> DataFrame:
    """(run, svg): the elements of a run's anchors in order. A scene is one document, so it is gathered in one row."""
    parts = anchors.select("run", "width", "height", "anchor_index", svg_element().alias("e"))
    docs = parts.groupBy("run", "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("anchor_index", "e"))), lambda x: x["e"]), "\n").alias("body"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">\n', "width", "height")
    return docs.select("run", F.concat(head, F.col("body"), F.lit("\n</svg>\n")).alias("svg"))


def write_runs(manifests: DataFrame, path: str) -> None:
    """A partition directory per run."""
    manifests.write.mode("overwrite").partitionBy("run").json(path)
