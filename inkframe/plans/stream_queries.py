"""The streaming extension, run over the events table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkframe.sources.tables import table
from inkframe.streaming.stage_counts import windowed_stage_counts


def windowed_stages(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the stream: day windows of diagnostic stages."""
    e = table(spark, d, "events")
    coded = e.replace({"click": "fit_circle", "view": "palette_quantized", "error": "arc_fit_failed", "signup": "export_svg"}, subset=["event_type"])
    return windowed_stage_counts(coded).selectExpr("date_format(window_start, 'yyyy-MM-dd') AS day", "stage", "n")


QUERIES = {"windowed_stages": windowed_stages}
ORACLE = {
    "windowed_stages": """SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'fitting' WHEN 'view' THEN 'palette' WHEN 'error' THEN 'fitting' WHEN 'signup' THEN 'export' ELSE 'unknown' END AS stage, count(*) AS n
        FROM events GROUP BY ALL""",
}
