"""Learning operators: centroids, evaluation, normalisation, gradient steps, training comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from inkframe.operators.raster import nearest_of


def class_centroids(examples: DataFrame, label: str = "label", vector: str = "features") -> DataFrame:
    """(label, pos, value): the element-wise mean of each class."""
    return examples.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def centroid_vectors(centroids: DataFrame, label: str = "label") -> DataFrame:
    return centroids.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centroid"))


def feature_importance(centroids: DataFrame) -> DataFrame:
    """Per feature: the spread of the class means, with its rank (largest first, then position)."""
    spread = centroids.groupBy("pos").agg((F.max("value") - F.min("value")).alias("importance"))
    return spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "pos")))


def predict(examples: DataFrame, centroids: DataFrame, key: str, vector: str = "features", label: str = "label") -> DataFrame:
    """examples with predicted (the nearest class mean; the smallest label of equally near ones) and distance."""
    out = nearest_of(examples, centroid_vectors(centroids, label), key, vector, label, "centroid")
    return out.withColumnRenamed("nearest_key", "predicted")


def confusion(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.groupBy(label, "predicted").agg(F.count("*").alias("n"))


def label_accuracy(confused: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy per label, null without examples."""
    right = F.sum(F.when(F.col(label) == F.col("predicted"), F.col("n")).otherwise(0))
    return confused.groupBy(label).agg(F.sum("n").alias("n"), right.alias("correct")).withColumn("accuracy", F.try_divide("correct", "n"))


def ranking_eval(candidates: DataFrame, key: str, heuristic: str, assisted: str, label: str, ordinal: str = "ord") -> DataFrame:
    """One row: how often the best candidate by either score has its group's label, and how often the choice differs."""
    best = candidates.groupBy(key).agg(F.min_by("kind", F.struct(heuristic, ordinal)).alias("h"), F.min_by("kind", F.struct(assisted, ordinal)).alias("a"), F.first(label).alias("label"))
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("h") == F.col("label")).alias("heuristic_correct"), F.count_if(F.col("a") == F.col("label")).alias("assisted_correct"), F.count_if(F.col("h") != F.col("a")).alias("changed"))


def standardize(tall: DataFrame, by: str = "pos", value: str = "value", floor: float = 1e-6) -> DataFrame:
    """tall with z: value less the column's mean, over its population deviation (at least floor). One partial aggregate; the
    statistics, a row per feature, are joined back."""
    stats = tall.groupBy(by).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("scale"))
    return tall.join(stats, by).withColumn("z", (F.col(value) - F.col("mean")) / F.col("scale"))


def multilabel_scores(rows: DataFrame, expected: str, predicted: str, known: Column | None = None) -> DataFrame:
    """One row: exact matches, target accuracy (share of expected targets that are predicted), targets not in known."""
    hit = F.size(F.array_intersect(expected, predicted))
    same = F.array_sort(expected) == F.array_sort(predicted)
    unknown = F.lit(0) if known is None else F.size(F.array_except(expected, known))
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("exact_matches"), F.coalesce(F.try_divide(F.sum(hit), F.sum(F.size(expected))), F.lit(0.0)).alias("target_accuracy"), F.sum(unknown).alias("unknown_targets"))


def softmax_step(examples: DataFrame, weights: list[list[float]], labels: list, rate: float, label: str = "label", vector: str = "features") -> list[list[float]]:
    """One step of full-batch gradient descent on softmax regression: the gradient is one aggregate over all examples,
    labels x features numbers; the weights are as few."""
    x = F.transform(vector, lambda v: v.cast("double"))
    dots = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in weights]
    e = examples.withColumn("__x", x).withColumns({f"__e{k}": F.exp(d - F.greatest(*dots)) if len(dots) > 1 else F.lit(1.0) for k, d in enumerate(dots)})
    total = sum((F.col(f"__e{k}") for k in range(len(dots))), F.lit(0.0))
    errors = [(F.col(f"__e{k}") / total - (F.col(label) == F.lit(v)).cast("double")).alias(f"g{k}") for k, v in enumerate(labels)]
    tall = e.select(F.posexplode("__x").alias("pos", "v"), *errors)
    grads = {r["pos"]: r for r in tall.groupBy("pos").agg(*[F.avg(F.col("v") * F.col(f"g{k}")).alias(f"g{k}") for k in range(len(labels))]).collect()}
    return [[w - rate * grads[i][f"g{k}"] for i, w in enumerate(row)] for k, row in enumerate(weights)]


def positional_split(df: DataFrame, order: str, val: int, test: int) -> DataFrame:
    """split by position in order: first train, then val rows, then test rows at the end. Of rows with equal order, which
    are next to each other, those of the smaller row hash come first, so that the counts hold with ties; null comes first.

    Only the two rows at which a part begins come to the driver, found by a top-k over two numbers a row.
    """
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    place = F.struct(F.col(order).isNotNull().alias("some"), F.col(order).alias("o"), tie.alias("t"), F.monotonically_increasing_id().alias("n"))
    numbered = df.withColumn("__place", place)
    tail = numbered.select("__place").orderBy(F.desc("__place")).limit(val + test)
    edges = tail.agg(F.count("*").alias("n"), F.min("__place").alias("val")).first()
    split = F.lit("train")
    if edges["n"]:
        split = F.when(F.col("__place") >= _place(edges["val"], df, order), "val").otherwise(split) if val else split
        if test:
            first = numbered.select("__place").orderBy(F.desc("__place")).limit(test).agg(F.min("__place").alias("p")).first()["p"]
            split = F.when(F.col("__place") >= _place(first, df, order), "test").otherwise(split)
    return numbered.withColumn("split", split).drop("__place")


def _place(row: Row, df: DataFrame, order: str) -> Column:
    return F.struct(F.lit(row["some"]).alias("some"), F.lit(row["o"]).cast(df.schema[order].dataType).alias("o"), F.lit(row["t"]).alias("t"), F.lit(row["n"]).alias("n"))


def training_gate(deltas: DataFrame, train_delta: Column, *, least_train: int = 1, least_best: float = 0.0, most_drop: float = 0.0, allow_unchanged: bool = False) -> DataFrame:
    """deltas (metric, delta) and train_delta (a number): best, worst, status, decision reject > manual_review > accept, reasons.

    The status is improved, regressed, mixed or unchanged; insufficient without deltas.
    """
    one = deltas.agg(F.max("delta").alias("best"), F.min("delta").alias("worst"))
    best, worst = F.col("best"), F.col("worst")
    status = F.when(best.isNull(), "insufficient").when((best > 0) & (worst < 0), "mixed").when(best > 0, "improved").when(worst < 0, "regressed").otherwise("unchanged")
    rejects = [("train_examples_delta_below_min", train_delta.isNull() | (train_delta < least_train)), ("best_accuracy_delta_below_min", best < least_best), ("worst_accuracy_delta_below_tolerance", worst < -most_drop), ("comparison_status_regressed", status == "regressed")]
    reviews = [("missing_best_accuracy_delta", best.isNull()), ("missing_worst_accuracy_delta", worst.isNull()), ("comparison_status_mixed", status == "mixed"), ("comparison_status_unchanged", (status == "unchanged") & F.lit(not allow_unchanged)), ("comparison_status_insufficient", status == "insufficient")]
    named = lambda checks: F.array_compact(F.array(*[F.when(test, name) for name, test in checks]))
    decision = F.when(F.size(named(rejects)) > 0, "reject").when(F.size(named(reviews)) > 0, "manual_review").otherwise("accept")
    return one.select("best", "worst", status.alias("status"), decision.alias("decision"), F.array_join(F.concat(named(rejects), named(reviews)), ",").alias("reasons"))
