"""Rendering of primitives on a pixel grid, outline tracing, and bounded local refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.operators import raster

#: Moore neighbours clockwise, from the west.
_AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))
#: Which of them a walk looks at, by where it came from.
_FROM = tuple(tuple((k + back) % 8 for k in range(1, 9)) for back in range(8))


def inside(kind: Column, x: Column, y: Column) -> Column:
    """Whether the pixel centre (x, y) is in a shape of the columns cx, cy, rx, ry, width (strokes), min_x, min_y, max_x, max_y."""
    d = F.hypot((x - F.col("cx")) / F.col("rx"), (y - F.col("cy")) / F.col("ry"))
    r = F.hypot(x - F.col("cx"), y - F.col("cy"))
    box = (x >= F.col("min_x")) & (x <= F.col("max_x")) & (y >= F.col("min_y")) & (y <= F.col("max_y"))
    return F.coalesce(F.when(kind.isin("circle", "ellipse"), d <= 1).when(kind == "stroke_circle", F.abs(r - F.col("rx")) <= F.col("width") / 2).otherwise(box), F.lit(False))


def render(shapes: DataFrame, *keys: str, width: int, height: int) -> DataFrame:
    """(keys, x, y, color): each pixel's topmost shape (largest anchor_index). A shape gives only the pixels of its own box."""
    lo = lambda c, pad=0.0: F.greatest(F.lit(0), F.floor(c - pad)).cast("int")
    hi = lambda c, most: F.least(F.lit(most - 1), F.ceil(c)).cast("int")
    grown = shapes.withColumns({"__x0": lo(F.col("min_x")), "__x1": hi(F.col("max_x"), width), "__y0": lo(F.col("min_y")), "__y1": hi(F.col("max_y"), height)}).filter("__x0 <= __x1 AND __y0 <= __y1")
    # dealt out before they become pixels: shapes are small, and Spark would give many of them to one task
    dealt = grown.repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "anchor_index")
    cells = dealt.withColumn("x", F.explode(F.sequence("__x0", "__x1"))).withColumn("y", F.explode(F.sequence("__y0", "__y1")))
    hit = cells.filter(inside(F.col("kind"), F.col("x"), F.col("y")))
    return hit.groupBy(*keys, "x", "y").agg(F.max_by("color", "anchor_index").alias("color"))


def coverage_error(pixels: DataFrame, rendered: DataFrame, *keys: str) -> DataFrame:
    """Per group: pixels of one side only, over those of either."""
    both = pixels.select(*keys, "x", "y", F.lit(1).alias("a")).join(rendered.select(*keys, "x", "y", F.lit(1).alias("b")), [*keys, "x", "y"], "full")
    return both.groupBy(*keys).agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) / F.count("*")).alias("coverage_error"))


def trace_outline(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, x, y): the outer boundary of each component as an ordered walk over Moore neighbours, from its first pixel.
    Components come as rows with lists: many are traced by one call."""

    def walk_of(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
        ink = set(cells)
        start = min(ink, key=lambda p: (p[1], p[0]))
        at, back, walk = start, 0, [start]
        for _ in range(4 * len(ink) + 8):
            step = next((k for k in _FROM[back] if (at[0] + _AROUND[k][0], at[1] + _AROUND[k][1]) in ink), None)
            if step is None:
                break
            at = (at[0] + _AROUND[step][0], at[1] + _AROUND[step][1])
            back = (step + 5) % 8 if step % 2 else (step + 6) % 8
            if at == start and len(walk) > 1:
                break
            walk.append(at)
        return walk

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in raster.masks_of(batches):
            mask, x, y = raster.pixels_of(part)
            ends = np.searchsorted(mask, np.arange(len(part) + 1))
            cells = list(zip(x.tolist(), y.tolist(), strict=True))
            walks = [walk_of(cells[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            size = np.array([len(w) for w in walks])
            owner = pa.array(np.repeat(np.arange(len(part)), size))
            place = np.array([p for w in walks for p in w], np.int32)
            ord_ = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(owner) for k in keys), pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(ord_.astype(np.int32))], names=[*keys, "x", "y", "ord"])

    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return raster.as_masks(pixels, *keys).mapInArrow(trace, f"{kinds}, x int, y int, ord int")


def refine_circles(pixels: DataFrame, circles: DataFrame, *keys: str, rounds: int = 4, step: float = 0.5) -> DataFrame:
    """Coordinate descent on (cx, cy, r): each round tries every parameter one step up and down and takes the best if it
    covers the component better. All components go through a round at once; trials are rows, not a loop."""
    now = circles.select(*keys, "cx", "cy", "r")
    moves = [(0.0, 0.0, 0.0)] + [tuple(s * step if i == k else 0.0 for i in range(3)) for k in range(3) for s in (1, -1)]
    ink = pixels.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("ink"))
    for _ in range(rounds):
        trials = now.join(ink, [*keys]).withColumn("t", F.explode(F.array(*[F.struct(F.lit(k).alias("__trial"), (F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), (F.col("r") + dr).alias("r")) for k, (dx, dy, dr) in enumerate(moves)])))
        covered = F.size(F.filter("ink", lambda p: F.hypot(p["x"] - F.col("t.cx"), p["y"] - F.col("t.cy")) <= F.col("t.r")))
        area = F.lit(3.141592653589793) * F.col("t.r") * F.col("t.r")
        error = (F.size("ink") - covered) + F.greatest(area - covered, F.lit(0.0))
        scored = trials.filter("t.r > 0").select(*keys, "t.*", F.round(error, 9).alias("error"))
        now = scored.groupBy(*keys).agg(F.min_by(F.struct("cx", "cy", "r", "error"), F.struct("error", "__trial")).alias("b")).select(*keys, "b.cx", "b.cy", "b.r", "b.error")
    return now
