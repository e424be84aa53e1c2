"""Snapshot and baseline comparison, spatial matching."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.gates import BOUNDS, over_cells
from inkframe.operators.raster import _settled


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key: status added, removed, changed or same, and the changed fields."""
    b, a = before.select(key, F.struct(*fields).alias("b")), after.select(key, F.struct(*fields).alias("a"))
    both = b.join(a, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in fields]))
    shared = F.col("b").isNotNull() & F.col("a").isNotNull()
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(shared, F.concat_ws(",", changed)).otherwise("").alias("changed_fields"))


def numeric_deltas(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, before, after, delta) of the numbers that both snapshots have, unpivoted."""
    tall = lambda df, name: df.select(key, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(key, fields, "path", name).filter(F.col(name).isNotNull())
    return tall(before, "before").join(tall(after, "after"), [key, "path"]).withColumn("delta", F.col("after") - F.col("before"))


def flatten_json(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of the numbers in a JSON text, at any depth; the path's steps are joined by dots.

    A step of an object is the field's name, one of a list the item's id, or its place from 0 without one. Strings, even
    of digits, and booleans are no numbers; null and malformed texts give no rows. Each level is one explode, and the
    levels end where no object or list is left.
    """
    if key in ("path", "value"):
        raise ValueError(f"the key column may not be named {key}, as a column of the result is")
    kind = lambda c: F.schema_of_variant(c)
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("__v")).filter("__v is not null")
    found = None
    while True:
        nested = F.lower(kind(F.col("__v"))).rlike("^(object|array)")
        number = F.lower(kind(F.col("__v"))).rlike("^(bigint|double|float|decimal)")
        leaves = level.filter(number).select(key, "path", F.col("__v").cast("double").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = level.filter(nested)
        if inner.isEmpty():
            return found
        items = inner.select(F.col(key).alias("__key"), "path", "__v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
        step = F.coalesce(F.col("key"), F.try_variant_get("value", "$.id", "string"), F.col("pos").cast("string"))
        level = items.select(F.col("__key").alias(key), F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"), F.col("value").alias("__v"))


def baseline_drift(baseline: DataFrame, current: DataFrame, key: str, metrics: list[str], rising: tuple[str, ...] = (), tolerance: float = 0.002) -> DataFrame:
    """(key, metric, delta, finding): regression or improvement beyond the tolerance; for rising metrics more is better.
    Cases of one side only are added or removed. What lies within the tolerance gives no row."""
    tall = lambda df, name: df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", name)
    both = tall(baseline, "before").join(tall(current, "now"), [key, "metric"])
    worse = F.when(F.col("metric").isin(*rising), F.col("before") - F.col("now")).otherwise(F.col("now") - F.col("before")) if rising else F.col("now") - F.col("before")
    found = both.withColumn("delta", F.col("now") - F.col("before")).withColumn("finding", F.when(worse > tolerance, "regression").when(worse < -tolerance, "improvement")).filter("finding is not null").select(key, "metric", "delta", "finding")
    sides = baseline.select(key, F.lit(1).alias("b")).join(current.select(key, F.lit(1).alias("c")), key, "full").filter("b is null or c is null")
    return found.unionByName(sides.select(key, F.lit("").alias("metric"), F.lit(None).cast("double").alias("delta"), F.when(F.col("b").isNull(), "added").otherwise("removed").alias("finding")))


def family_status(baseline: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Per family of (keys, passed, failed) on both sides, one of eight statuses."""
    b, c = baseline.select(*keys, F.col("passed").alias("bp"), F.col("failed").alias("bf")), current.select(*keys, F.col("passed").alias("cp"), F.col("failed").alias("cf"))
    status = (
        F.when(F.col("bp").isNull(), F.when(F.col("cf") > 0, "new_regression").otherwise("new_family"))
        .when(F.col("cp").isNull(), "missing_current_family")
        .when((F.col("bf") == 0) & (F.col("cf") > 0), "new_regression")
        .when((F.col("bf") > 0) & (F.col("cf") == 0), "resolved_regression")
        .when((F.col("bf") > 0) & (F.col("cf") == F.col("bf")), "known_debt")
        .when(F.col("cf") < F.col("bf"), "improved")
        .when((F.col("cf") == F.col("bf")) & (F.col("cp") == F.col("bp")), "held")
        .otherwise("changed")
    )
    return b.join(c, [*keys], "full").select(*keys, status.alias("status"))


def box_pairs(left: DataFrame, right: DataFrame, *keys: str, cell: int = 64) -> DataFrame:
    """Rows of left (keys, bounds, ...) with those of right (keys, b_ bounds, ...) whose boxes, bounds included, overlap.

    Boxes meet in the cells of a grid, and a pair counts in the cell of its overlap's lower corner, so no scene makes all pairs.
    """
    theirs = tuple(f"b_{c}" for c in BOUNDS)
    # named, as Spark takes boxes in cells for no larger than the rows they come from and would send them through the driver
    met = over_cells(left, BOUNDS, cell).join(over_cells(right, theirs, cell).hint("merge"), [*keys, "cell_x", "cell_y"])
    low = [F.greatest(BOUNDS[k], theirs[k]) for k in (0, 1)]
    owner = (F.col("cell_x") == F.floor(low[0] / cell)) & (F.col("cell_y") == F.floor(low[1] / cell))
    overlap = (low[0] <= F.least(BOUNDS[2], theirs[2])) & (low[1] <= F.least(BOUNDS[3], theirs[3]))
    return met.filter(owner & overlap).drop("cell_x", "cell_y")


def greedy_matches(pairs: DataFrame, *keys: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one matches per group: of all pairs the best by (score descending, left, right), then the best of what it leaves, and so on.

    In rounds: a pair that is the best of both its ends is taken, and what shares an end with it goes, until no pair is left. That
    takes the same pairs as going through them one by one. Pairs with a null key, end or score match nothing; of repeated pairs the
    best counts.
    """
    on = [*keys, left, right]
    rest_of = [c for c in pairs.columns if c not in (*on, score)]
    once = pairs.dropna(subset=[*on, score]).groupBy(*on).agg(F.max(F.struct(score, *rest_of)).alias("__m")).select(*on, "__m.*")
    open_pairs, taken = _settled(once), []
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    while not open_pairs.isEmpty():
        best = lambda end: open_pairs.groupBy(*keys, end).agg(F.min(order).alias("m")).select(*keys, F.col("m.l").alias(left), F.col("m.r").alias(right))  # noqa: B023, E731
        found = _settled(best(left).join(best(right), on))
        taken.append(found)
        still = _settled(open_pairs.join(found.select(*keys, left), [*keys, left], "left_anti").join(found.select(*keys, right), [*keys, right], "left_anti"))
        still.count()
        open_pairs.unpersist()
        open_pairs = still
    if not taken:
        return pairs.limit(0)
    return once.join(functools.reduce(DataFrame.unionByName, taken), on).select(pairs.columns)


#: Rounds whose matches are kept apart before they are written together.
MOST_APART = 16


def ordered_matches(pairs: DataFrame, *keys: str, expected: str, order: str, actual: str, failures: str, score: str) -> DataFrame:
    """(keys, expected, order, status, actual, failures, score): each group's expectations, in order, take the best actual that is left.

    An expectation takes the actual without failures of the largest score (ties: the smallest actual) that no earlier one
    took: status matched. Otherwise nothing is taken; actual is then the one with the fewest failures among those that no
    earlier one took: status failed, or missing if there is none. Orders are unique in a group. Rows with a null among the
    columns named match nothing.

    In rounds: an expectation takes its best actual once no earlier open one could want it, which the first open one
    of each group always may, so there are at most as many rounds as a group has expectations. Pairs are computed once, a
    round reads only what the one before left open, and one aggregate tells what became of each expectation.
    """
    found_of = (actual, failures, score)
    real = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if pairs.schema[c].dataType.typeName() in ("float", "double") else F.lit(True))
    whole = functools.reduce(Column.__and__, [real(c) for c in found_of])
    # a row that matches nothing still names its expectation
    held = pairs.select(*keys, expected, order, *(F.when(whole, F.col(c)).alias(c) for c in found_of)).dropna(subset=[*keys, expected, order])
    held = _settled(held.dropDuplicates([*keys, expected, actual]))
    open_pairs, taken = held.filter(F.col(failures) == 0), []
    rank = F.struct((-F.col(score)).alias("s"), F.col(actual).alias("a"), F.struct(*found_of).alias("found"))
    while not open_pairs.isEmpty():
        best = open_pairs.groupBy(*keys, expected, order).agg(F.min(rank)["found"].alias("__f")).select(*keys, expected, order, "__f.*")
        first = open_pairs.groupBy(*keys, actual).agg(F.min(order).alias(order))
        found = _settled(best.join(first, [*keys, actual, order]).select(*keys, expected, order, *found_of))
        taken.append(found)
        if len(taken) == MOST_APART:
            taken = [_settled(functools.reduce(DataFrame.unionByName, taken))]
        open_pairs = _settled(open_pairs.join(found.select(*keys, expected), [*keys, expected], "left_anti").join(found.select(*keys, actual), [*keys, actual], "left_anti"))
    matched = functools.reduce(DataFrame.unionByName, taken) if taken else held.limit(0)
    before = matched.select(*keys, actual, F.col(order).alias("__by"))
    free = F.col(actual).isNotNull() & (F.col("__by").isNull() | (F.col("__by") > F.col(order)))
    as_found = lambda place: F.struct(F.lit(place).alias("place"), F.col(failures).alias("f"), (-F.col(score)).alias("s"), F.col(actual).alias("a"))
    near = held.join(before, [*keys, actual], "left").select(*keys, expected, order, F.when(free, as_found(1)).alias("__m"))
    out = near.unionByName(matched.select(*keys, expected, order, as_found(0).alias("__m"))).groupBy(*keys, expected, order).agg(F.min("__m").alias("__m"))
    status = F.when(F.col("__m.place") == 0, "matched").when(F.col("__m.place") == 1, "failed").otherwise("missing")
    return out.select(*keys, expected, order, status.alias("status"), F.col("__m.a").alias(actual), F.col("__m.f").alias(failures), (-F.col("__m.s")).alias(score))


def sweep_rank(runs: DataFrame, *keys: str, editability: str = "editability_score", l1: str = "raster_l1_error", id_col: str = "id") -> DataFrame:
    """Runs ranked by (editability descending, error, id); a missing or zero error counts as 1, a missing score as 0."""
    or_else = lambda c, v: F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(v)).otherwise(F.col(c))
    order: list[Column] = [F.desc(F.coalesce(F.col(editability), F.lit(0.0))), or_else(l1, 1.0), F.col(id_col).cast("string")]
    return runs.withColumn("semantic_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
