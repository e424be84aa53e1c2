"""Scene, learning, review and comparison queries over the host tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import scalars as S
from inkframe.operators import diff, fit, learn, proposals, raster, review, scene
from inkframe.sources.tables import table


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """A line item is an anchor of its order's scene: return flag gives the kind, line status the colour."""
    kind = F.when(F.col("l_returnflag") == "A", "circle").when(F.col("l_returnflag") == "N", "rect").otherwise("cubic_path")
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber").cast("long") * 10**17 + F.col("l_partkey") * 10**10 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("anchor_index"), F.col("l_linenumber").alias("line"), kind.alias("kind"), F.col("l_linestatus").alias("color"), F.col("l_discount").alias("raster_error"), F.col("l_tax").alias("quality_error"),
        F.col("l_quantity").cast("int").alias("parameter_count"), (F.col("l_linenumber") % 4 + 1).alias("node_count"), F.col("l_extendedprice").alias("weight"),
        x.cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + F.col("l_quantity")).cast("double").alias("max_x"), (y + F.col("l_quantity") / 2).cast("double").alias("max_y"),
    )


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


# scenes -------------------------------------------------------------------------------------------------------------


def diagnostic_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Event types play diagnostic codes; some carry an explicit stage."""
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "click", "fit_circle").when(F.col("event_type") == "view", "palette_quantized").when(F.col("event_type") == "error", "arc_fit_failed").when(F.col("event_type") == "signup", "export_svg").otherwise("other")
    stage = F.when(F.col("event_id") % 10 == 0, " Pre-Processing ").when(F.col("event_id") % 10 == 1, "Scoring").when(F.col("event_id") % 10 == 2, "no such")
    return scene.value_counts(e, value=S.diagnostic_stage(stage, code), name="stage")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per run (user): diagnostics, codes and the mean and largest value."""
    e = table(spark, d, "events")
    out = e.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("diagnostics"), F.count_distinct("event_type").alias("codes"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return _round(out, "mean_value", "max_value", digits=4)


def json_path_values(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the numbers in the events' JSON, per path."""
    flat = diff.flatten_json(table(spark, d, "events"), "event_id", "props")
    return flat.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def palette_summary(spark: SparkSession, d: str) -> DataFrame:
    return scene.palette_summary(anchors(spark, d)).select("color", "kind", "kind_count", "color_count")


def layer_index(spark: SparkSession, d: str) -> DataFrame:
    return scene.layer_index(anchors(spark, d), F.when(F.col("kind") == "cubic_path", "fallback").otherwise("primitives"), "run_id")


def scene_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    out = scene.scene_metrics(a, a.filter("raster_error > 0.08").select("run_id"), "run_id")
    return _round(out.select("run_id", "anchor_count", "generic_count", "warning_count", "mean_raster_error", "max_raster_error", "parameters", "fragmentation_penalty", "editability_score"), "mean_raster_error", "fragmentation_penalty", "editability_score")


def editability_components(spark: SparkSession, d: str) -> DataFrame:
    """Economy scores of a scene's mean parameters (of 16) and nodes (of 24)."""
    g = anchors(spark, d).groupBy("run_id").agg(F.avg("parameter_count").alias("p"), F.avg("node_count").alias("n"))
    return g.select("run_id", F.round(scene.economy_score(F.col("p"), 16.0), 6).alias("parameter_economy"), F.round(scene.economy_score(F.col("n"), 24.0), 6).alias("node_economy"))


def quality_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("raster_error"), F.col("raster_error"), F.lit("quality_error"), F.col("quality_error"), F.lit("weight"), F.col("weight"))
    return _round(scene.metric_summary(anchors(spark, d).withColumn("metrics", m)), "mean", "max", digits=4)


def metric_error_sums(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: the summed quality error of maps whose names end in _error or are error metrics by name."""
    m = F.create_map(F.lit("raster_error"), F.col("raster_error"), F.lit("stroke_width_variance"), F.col("quality_error"), F.lit("weight"), F.col("weight"), F.lit("classifier_prior_error"), F.lit(0.35))
    a = anchors(spark, d).withColumn("metrics", m)
    return a.groupBy("kind").agg(F.round(F.sum(S.metric_error(F.col("metrics"))), 2).alias("error"), F.round(F.sum(S.metric_error(F.col("metrics"), ("classifier_prior_error",))), 2).alias("harvest_error"))


def cv_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Variation of the quantities of each scene, as an aggregate over arrays."""
    g = anchors(spark, d).groupBy("run_id").agg(F.sort_array(F.collect_list(F.col("parameter_count").cast("double"))).alias("w"))
    return g.select("run_id", F.round(S.variation(F.col("w")), 6).alias("stroke_width_variance"))


def best_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Per scene, the anchor of the least semantic score; the first of equals."""
    a = anchors(spark, d)
    score = S.semantic_score(F.col("raster_error"), F.col("quality_error"), F.col("node_count"), F.col("parameter_count"), F.col("kind"))
    b = fit.choose_best(a.select("run_id", "anchor_index", "kind", F.round(score, 9).alias("score")), "run_id", ordinal="anchor_index")
    return _round(b, "score")


def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    return fit.top_k(anchors(spark, d).select("run_id", "anchor_index", "parameter_count"), "run_id", k=5, order=[F.desc("parameter_count"), F.col("anchor_index")])


def equivalence_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first anchor of each rounded box per colour; generic anchors are never duplicates."""
    key = F.when(F.col("kind") != "cubic_path", F.concat_ws("/", "color", F.floor(F.col("min_x") / 10), F.floor(F.col("min_y") / 10)))
    return scene.first_of_each(anchors(spark, d), key, "run_id").select("run_id", "anchor_index", "kind")


def same_color_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    out = scene.merge_plan(anchors(spark, d), "run_id", "color")
    return _round(out.select("run_id", "color", "fragments", "fragment_area", "combined_area", "fill_ratio", "auto_merge_allowed"), "fragment_area", "combined_area", "fill_ratio")


def merge_exact_rects(spark: SparkSession, d: str) -> DataFrame:
    """Parts as unit tiles of a strip per brand and size: strips without holes become one rectangle."""
    p = table(spark, d, "part")
    x = (F.col("p_partkey") % 4).cast("double")
    r = p.select("p_brand", "p_size", x.alias("min_x"), F.lit(0.0).alias("min_y"), (x + 1).alias("max_x"), F.lit(1.0).alias("max_y")).distinct()
    return scene.merge_exact_rects(r, "p_brand", "p_size")


def parallel_groups(spark: SparkSession, d: str) -> DataFrame:
    s = anchors(spark, d).select("run_id", "anchor_index", "color", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), F.col("max_x").alias("x1"), F.col("max_y").alias("y1"))
    return _round(scene.parallel_groups(s, "run_id"), "parallel_spacing_error")


def scene_contacts(spark: SparkSession, d: str) -> DataFrame:
    return _round(scene.contact_pairs(anchors(spark, d), "run_id"), "bounds_gap", "bounds_iou")


def occluded_groups(spark: SparkSession, d: str) -> DataFrame:
    return _round(scene.occluded_groups(anchors(spark, d), "run_id"), "hidden_area")


def text_like_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier: many fragments in a flat box, with looser limits than the default."""
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.when(F.col("l_returnflag") == "R", "cubic_path").otherwise("rect").alias("kind"), F.col("l_partkey").cast("double").alias("min_x"), F.lit(0.0).alias("min_y"), (F.col("l_partkey") + 0.5).alias("max_x"), F.lit(10.0).alias("max_y"))
    return scene.text_like_groups(a, "group_id").select("group_id", "fragments", "generic")


def group_context(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor in its same-colour group, with its position."""
    a = anchors(spark, d).select("run_id", "anchor_index", "color")
    g = scene.layer_index(a, F.col("color"), "run_id").select("run_id", F.col("layer").alias("group_id"), F.lit("same_color").alias("group_kind"), "anchor_indexes")
    return scene.group_context(a.drop("color"), g, "run_id").select("run_id", "anchor_index", "group_id", F.col("anchor_position").cast("int").alias("anchor_position"))


def coordinate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return raster.coordinate_clusters(table(spark, d, "part"), "p_brand", value="p_size")


def cluster_axis(spark: SparkSession, d: str) -> DataFrame:
    return scene.cluster_axis(table(spark, d, "part"), "p_brand", value="p_size", tolerance=4.0)


def spacing_error(spark: SparkSession, d: str) -> DataFrame:
    """Spacing of a user's events on the (hour, value) plane, in order of time."""
    e = table(spark, d, "events").filter("value is not null")
    p = F.struct(F.col("event_id").alias("o"), F.hour("ts").cast("double").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    return g.select("user_id", F.round(S.spacing_error(F.col("p")), 6).alias("spacing_error"))


# learning -----------------------------------------------------------------------------------------------------------


def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _round(learn.class_centroids(_examples(spark, d)), "value")


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    return _round(learn.feature_importance(learn.class_centroids(_examples(spark, d))), "importance")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    return learn.predict(e, learn.class_centroids(e), "vec_id")


def predict_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("vec_id", "label", "predicted", F.round("distance", 6).alias("distance"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return learn.confusion(_predictions(spark, d))


def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _round(learn.label_accuracy(learn.confusion(_predictions(spark, d))), "accuracy")


def standardize_features(spark: SparkSession, d: str) -> DataFrame:
    tall = _examples(spark, d).select("vec_id", F.posexplode("features").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))
    return learn.standardize(tall).select("vec_id", "pos", F.round("z", 5).alias("z"))


def ranking_eval(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d).withColumn("h", F.round(F.col("raster_error"), 9)).withColumn("s", F.round(F.col("raster_error") + F.when(F.col("kind") == "cubic_path", 0.35).otherwise(0.0), 9))
    return learn.ranking_eval(a.withColumn("label", F.lit("circle")), "run_id", "h", "s", "label", "anchor_index")


def multilabel_exact_match(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    expected = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    predicted = F.array_compact(F.array(F.when(F.col("n_chars") > 500, "quality"), F.when(F.col("n_chars") > 5000, "toxic")))
    return _round(learn.multilabel_scores(x.select(expected.alias("e"), predicted.alias("p")), "e", "p", F.array(F.lit("quality"))), "target_accuracy")


def softmax_step(spark: SparkSession, d: str) -> DataFrame:
    """The weights after one gradient step from zero, on labels 0 to 9."""
    labels = list(range(10))
    w = learn.softmax_step(_examples(spark, d), [[0.0] * 64 for _ in labels], labels, 0.001)
    return spark.createDataFrame([(k, i, round(v, 9)) for k, row in enumerate(w) for i, v in enumerate(row)], "label int, pos int, weight double")


def positional_split(spark: SparkSession, d: str) -> DataFrame:
    out = learn.positional_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 20, 30)
    return out.groupBy("split", "lang").agg(F.count("*").alias("n"))


def training_gate(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per label against a baseline from the even vectors."""
    now = learn.label_accuracy(learn.confusion(_predictions(spark, d))).select("label", "accuracy")
    deltas = now.select("label", F.round(F.col("accuracy") - 0.5, 6).alias("delta"))
    return _round(learn.training_gate(deltas, F.lit(10)), "best", "worst")


# review -------------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(lab, "doc_id").select("doc_id", "lang", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("diagnostics"), F.when(F.col("quality") == 0, F.lit(0.2)).when(F.col("doc_id") % 3 == 0, F.lit(None).cast("double")).otherwise(0.9).alias("editability"), (F.col("n_chars") % 100 / 100).alias("l1"), "quality", "toxic")


def harvest_rejections(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    reason = review.harvest_reason({"diagnostics": F.col("diagnostics"), "editability": F.col("editability"), "fragmentation": F.lit(None).cast("double"), "l1": F.col("l1"), "edge": F.lit(None).cast("double")}, editability=0.5, l1=0.6)
    return r.withColumn("reason", reason).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).filter("diagnostics = 0")
    return review.review_queue(r.select("lang", "doc_id", "l1"), "lang", order=[F.desc("l1"), F.col("doc_id")]).select("lang", "doc_id", "ordinal", "decision")


def apply_review(spark: SparkSession, d: str) -> DataFrame:
    q = review.review_queue(_runs(spark, d).select("lang", "doc_id", F.lit("rect").alias("kind")), "lang", order=[F.col("doc_id")])
    reviewed = _runs(spark, d).filter("lang <> 'de'")
    decisions = reviewed.select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("unsure").alias("decision"), F.when(F.col("l1") > 0.5, "circle").alias("corrected_kind"))
    return review.apply_review(q, decisions, "doc_id").groupBy("decision", "kind").agg(F.count("*").alias("n"))


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).withColumn("issues", F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("l1") > 0.6, "blurred"))))
    return review.issue_counts(r, "issues", "lang")


def _gates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_quantity") > 5).alias("ok"), F.when(F.col("l_returnflag") == "R", "red").otherwise("yellow").alias("severity"), F.when(F.col("l_linenumber") == 7, "missing_source").otherwise("shape").alias("gate_type"))


def promotion_decision(spark: SparkSession, d: str) -> DataFrame:
    return review.promotion_decision(_gates(spark, d), "case_id")


def anchor_state_priority(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "promoted").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_tax") > 0.04, "deferred").otherwise("other").alias("state"))
    return review.anchor_state(s, "l_orderkey").groupBy("state").agg(F.count("*").alias("n"))


def expectation_check(spark: SparkSession, d: str) -> DataFrame:
    """Repeated expectations per customer and priority add up; what the customer's orders really hold is checked."""
    o = table(spark, d, "orders")
    e = o.select("o_custkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("min_count"), F.when(F.col("o_totalprice") > 150_000, 2).alias("max_count"))
    needed = review.cumulative_minimum(e, "o_custkey", selector="kind")
    actual = o.groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    return review.check_counts(needed, actual, "o_custkey", "kind").select("o_custkey", "kind", "ord", "needed", "n", "ok", F.coalesce("reason", F.lit("")).alias("reason"))


def region_gates(spark: SparkSession, d: str) -> DataFrame:
    """The first anchor's box of each scene is a region that other anchors should overlap."""
    a = anchors(spark, d)
    cols = ("min_x", "min_y", "max_x", "max_y")
    regions = a.filter("line = 1").select("run_id", F.col("anchor_index").alias("region_id"), *[F.col(c).alias(f"r_{c}") for c in cols])
    iou = S.bounds_iou(tuple(F.col(f"r_{c}") for c in cols), tuple(F.col(c) for c in cols))
    return _round(review.region_gates(regions, a.filter("line > 1").select("run_id", *cols), iou, "run_id"), "best_iou")


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    state = proposals.initial_status(F.col("parameter_count"), 45)
    return a.select("run_id", "anchor_index", F.when(F.col("weight") > 2000, F.col("kind")).alias("anchor_kind"), F.create_map(F.lit("raster_error"), F.col("raster_error"), F.lit("width"), F.col("weight")).alias("anchor_metrics"), (F.col("node_count") > 1).alias("anchor_reserved"), state.alias("s")).select("*", "s.*").drop("s")


def proposal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Proposals by status and reason after the geometry gate."""
    out = proposals.gate_proposals(_proposals(spark, d), 0.08, True)
    return out.groupBy("status", "downstream_status", F.coalesce("downstream_decision_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def case_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of line items as quality cases, per category and metric."""
    a = anchors(spark, d)
    c = a.select(F.concat_ws("/", "run_id", "anchor_index").alias("case_id"), (F.col("node_count") < 4).alias("size_match"), F.col("raster_error").alias("raster_l1_error"), F.col("quality_error").alias("raster_edge_error"), F.when(F.col("parameter_count") > 2, 0.0).alias("raster_alpha_error"), F.lit(0.05).alias("max_raster_l1_error"), F.lit(0.04).alias("max_raster_edge_error"), F.lit(0.1).alias("max_raster_alpha_error"), (F.col("kind") == "cubic_path").cast("int").alias("fallback_count"), (F.col("color") == "O").alias("allow_cubic_path"), (F.col("parameter_count") / 50).alias("bbox_iou"), F.lit(0.5).alias("min_bbox_iou"))
    return proposals.case_failures(c).groupBy("category", "metric").agg(F.count("*").alias("n"))


def tile_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grids among the parts of a brand and type group, placed by key and size."""
    t = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 5 * 10).cast("double").alias("x"), (F.floor(F.col("p_size") / 10) * 10).cast("double").alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h")).distinct()
    return _round(proposals.tile_grid(t, "p_brand"), "occupancy")


# comparison ---------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Before: the orders that were not urgent. After: those not pending, low-priority prices raised, large finished ones renamed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    after = o.filter(status != "P").withColumns({"o_totalprice": F.when(F.col("o_orderpriority") == "5-LOW", price + 10).otherwise(price), "o_orderstatus": F.when((status == "F") & (price > 200_000), "X").otherwise(status)})
    return o.filter("o_orderpriority <> '1-URGENT'"), after


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    before, after = _snapshots(spark, d)
    return diff.snapshot_diff(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"]).groupBy("status", "changed_fields").agg(F.count("*").alias("n"))


def numeric_path_deltas(spark: SparkSession, d: str) -> DataFrame:
    before, after = _snapshots(spark, d)
    out = diff.numeric_deltas(before, after, "o_orderkey", ["o_totalprice"]).filter("delta <> 0")
    return out.select("o_orderkey", "path", F.round("delta", 4).alias("delta"))


def baseline_drift(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers are new, another's are gone; by segment, errors rise, fall or stay within the tolerance."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 10000, 4).alias("l1"), F.round(F.col("c_acctbal") / 20000, 4).alias("bbox_iou"))
    segment = F.col("c_mktsegment")
    now = c.filter("c_nationkey <> 3").withColumn("l1", F.col("l1") + F.when(segment == "BUILDING", 0.01).when(segment == "MACHINERY", -0.01).otherwise(0.001)).withColumn("bbox_iou", F.col("bbox_iou") + F.when(segment == "AUTOMOBILE", -0.05).otherwise(0.0))
    out = diff.baseline_drift(c.filter("c_nationkey <> 4"), now, "id", ["l1", "bbox_iou"], rising=("bbox_iou",))
    return out.select("id", "metric", F.round("delta", 6).alias("delta"), "finding")


def family_baseline_status(spark: SparkSession, d: str) -> DataFrame:
    side = lambda bit, keep: table(spark, d, "customer").filter(keep).groupBy("c_mktsegment", "c_nationkey").agg(F.count_if(F.col("c_custkey") % 5 != bit).alias("passed"), F.count_if(F.col("c_custkey") % 5 == bit).alias("failed"))
    return diff.family_status(side(0, "c_nationkey <> 3"), side(1, "c_nationkey <> 4"), "c_mktsegment", "c_nationkey")


def iou_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Scene boxes against the next scene's, by inclusive-bounds IoU of at least 0.2."""
    a = anchors(spark, d).withColumns({c: F.col(c).cast("int") for c in ("min_x", "min_y", "max_x", "max_y")})
    cols = ("min_x", "min_y", "max_x", "max_y")
    b = a.select((F.col("run_id") - 1).alias("run_id"), F.col("anchor_index").alias("after_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    iou = S.pixel_bounds_iou(tuple(F.col(c) for c in cols), tuple(F.col(f"b_{c}") for c in cols))
    met = diff.box_pairs(a.select("run_id", F.col("anchor_index").alias("before_id"), *cols), b, "run_id")
    pairs = met.select("run_id", "before_id", "after_id", F.round(iou, 6).alias("iou")).filter("iou >= 0.2")
    return diff.greedy_matches(pairs, "run_id", left="before_id", right="after_id", score="iou")


def sweep_rank(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 100000)).cast("double").alias("editability_score"), F.when(F.col("o_orderkey") % 4 == 0, 0.0).when(F.col("o_orderkey") % 4 == 1, F.lit(None).cast("double")).otherwise(F.col("o_orderkey") % 10 / 10).alias("raster_l1_error"))
    return diff.sweep_rank(r, "o_custkey").select("o_custkey", "id", "semantic_rank")


QUERIES = {f.__name__: f for f in (
    diagnostic_stage_counts, run_summary, json_path_values, palette_summary, layer_index, scene_metrics, editability_components, quality_metric_summary, metric_error_sums, cv_metrics, best_anchor,
    top_contributors, equivalence_dedup, same_color_merge_plan, merge_exact_rects, parallel_groups, scene_contacts, occluded_groups, text_like_groups, group_context, coordinate_clusters, cluster_axis,
    spacing_error, class_centroids, feature_importance, predict_nearest, confusion, label_accuracy, standardize_features, ranking_eval, multilabel_exact_match, softmax_step, positional_split, training_gate,
    harvest_rejections, review_queue, apply_review, issue_counts, promotion_decision, anchor_state_priority, expectation_check, region_gates, proposal_summary, case_failures, tile_grids, snapshot_diff, numeric_path_deltas, baseline_drift,
    family_baseline_status, iou_greedy_match, sweep_rank,
)}
