"""DuckDB SQL for the queries of table_queries."""

from __future__ import annotations

_A = """a AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT * 100000000000000000 + l_partkey * 10000000000 + l_suppkey * 1000 + l_quantity::BIGINT AS anchor_index, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'circle' WHEN 'N' THEN 'rect' ELSE 'cubic_path' END AS kind, l_linestatus AS color,
    l_discount AS raster_error, l_tax AS quality_error, l_quantity::INT AS parameter_count, l_linenumber % 4 + 1 AS node_count, l_extendedprice AS weight, (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 100)::DOUBLE AS y0,
    (l_partkey % 100 + l_quantity)::DOUBLE AS x1, (l_suppkey % 100 + l_quantity / 2)::DOUBLE AS y1 FROM lineitem)"""
_MERGE = """m AS (SELECT run_id, color, count(*) AS fragments, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum((x1-x0)*(y1-y0)) AS fragment_area FROM a GROUP BY run_id, color HAVING count(*) > 1),
    plan AS (SELECT *, (x1-x0)*(y1-y0) AS combined_area, CASE WHEN (x1-x0)*(y1-y0) > 0 THEN least(fragment_area / ((x1-x0)*(y1-y0)), 1) ELSE 0 END AS fill_ratio FROM m)"""
_E = "e AS (SELECT vec_id, label, i::INT AS pos, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)), cen AS (SELECT label, pos, avg(v) AS value FROM e GROUP BY label, pos)"
_P = f"{_E}, dist AS (SELECT e.vec_id, e.label, cen.label AS predicted, sqrt(sum((e.v - cen.value) ** 2)) AS distance FROM e JOIN cen USING (pos) GROUP BY ALL), p AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) = 1)"
_ACC = f"{_P}, acc AS (SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS correct, count(*) FILTER (label = predicted) / count(*) AS accuracy FROM p GROUP BY label)"
_R = """r AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS diagnostics, CASE WHEN quality = 0 THEN 0.2 WHEN doc_id % 3 = 0 THEN NULL ELSE 0.9 END AS editability, (n_chars % 100 / 100)::DOUBLE AS l1, quality, toxic
    FROM documents JOIN labels USING (doc_id))"""
_S = """b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders WHERE o_orderpriority <> '1-URGENT'),
    n AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 10 ELSE o_totalprice END AS t FROM orders WHERE o_orderstatus <> 'P')"""
_IOU = """greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"""

ORACLE = {
    "cluster_axis": """WITH g AS (SELECT p_brand, list_sort(list(p_size::DOUBLE)) AS vs FROM part GROUP BY p_brand),
        f AS (SELECT p_brand, vs, list_reduce(list_transform(vs, lambda v: {'v': v, 'mean': v, 'n': 1, 'k': 0, 'out': [0]}),
            lambda s, x: CASE WHEN abs(x.v - s.mean) <= 4 THEN {'v': x.v, 'mean': s.mean + (x.v - s.mean) / (s.n + 1), 'n': s.n + 1, 'k': s.k, 'out': list_append(s.out, s.k)}
                ELSE {'v': x.v, 'mean': x.v, 'n': 1, 'k': s.k + 1, 'out': list_append(s.out, s.k + 1)} END).out AS ks FROM g)
        SELECT p_brand, v::INT AS p_size, count(*) AS n, max(k) AS cluster FROM (SELECT p_brand, unnest(vs) AS v, unnest(ks) AS k FROM f) GROUP BY ALL""",
    "iou_greedy_match": f"""WITH {_A}, i AS (SELECT run_id, anchor_index, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1 FROM a),
        q AS (SELECT a.run_id, a.anchor_index AS before_id, b.anchor_index AS after_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1, 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1, 0) AS inter,
            (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) + (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS total FROM i a JOIN i b ON b.run_id = a.run_id + 1),
        p AS (SELECT run_id, before_id, after_id, round(inter / (total - inter), 6) AS iou FROM q WHERE round(inter / (total - inter), 6) >= 0.2),
        g AS (SELECT run_id, list({{'b': before_id, 'a': after_id, 'bs': [before_id], 'as': [after_id], 'out': [{{'b': before_id, 'a': after_id, 'iou': iou}}]}} ORDER BY iou DESC, before_id, after_id) AS ps FROM p GROUP BY run_id),
        f AS (SELECT run_id, unnest(list_reduce(ps, lambda s, x: CASE WHEN list_contains(s.bs, x.b) OR list_contains(s['as'], x.a) THEN s
            ELSE {{'b': s.b, 'a': s.a, 'bs': list_append(s.bs, x.b), 'as': list_append(s['as'], x.a), 'out': list_concat(s.out, x.out)}} END).out) AS m FROM g)
        SELECT run_id, m.b AS before_id, m.a AS after_id, m.iou AS iou FROM f""",
    "diagnostic_stage_counts": """WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'fitting' WHEN 'view' THEN 'palette' WHEN 'error' THEN 'fitting' WHEN 'signup' THEN 'export' ELSE 'unknown' END AS by_code, event_id % 10 AS m FROM events)
        SELECT CASE m WHEN 0 THEN 'unknown' WHEN 1 THEN 'scoring' WHEN 2 THEN 'unknown' ELSE by_code END AS stage, count(*) AS n FROM c GROUP BY 1""",
    "run_summary": "SELECT user_id AS run, count(*) AS diagnostics, count(DISTINCT event_type) AS codes, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value FROM events GROUP BY user_id",
    "json_path_values": "SELECT 'k' AS path, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL",
    "palette_summary": f"WITH {_A} SELECT color, kind, count(*) AS kind_count, (sum(count(*)) OVER (PARTITION BY color))::BIGINT AS color_count FROM a GROUP BY color, kind",
    "layer_index": f"WITH {_A} SELECT run_id, CASE WHEN kind = 'cubic_path' THEN 'fallback' ELSE 'primitives' END AS layer, list(anchor_index ORDER BY anchor_index) AS anchor_indexes, count(*) AS anchor_count FROM a GROUP BY 1, 2",
    "scene_metrics": f"""WITH {_A}, s AS (SELECT run_id, count(*) AS anchor_count, count(*) FILTER (kind = 'cubic_path') AS generic_count, count(*) FILTER (raster_error > 0.08) AS warning_count, avg(raster_error) AS mean_e, max(raster_error) AS max_e,
            sum(parameter_count)::BIGINT AS parameters FROM a GROUP BY run_id),
        f AS (SELECT run_id, least(sum(n - 1) / sum(n), 0.5) AS frag FROM (SELECT run_id, color, count(*) AS n FROM a GROUP BY ALL) GROUP BY run_id)
        SELECT run_id, anchor_count, generic_count, warning_count, round(mean_e, 6) AS mean_raster_error, round(max_e, 6) AS max_raster_error, parameters, round(frag, 6)::DOUBLE AS fragmentation_penalty,
            round(greatest(0, least(1, (anchor_count - generic_count) / anchor_count - frag - least(0.05 * warning_count, 0.5) - least(0.04 * generic_count, 0.4))), 6)::DOUBLE AS editability_score FROM s JOIN f USING (run_id)""",
    "editability_components": f"WITH {_A} SELECT run_id, round(greatest(0, least(1, 1 - avg(parameter_count) / 16)), 6)::DOUBLE AS parameter_economy, round(greatest(0, least(1, 1 - avg(node_count) / 24)), 6)::DOUBLE AS node_economy FROM a GROUP BY run_id",
    "quality_metric_summary": f"WITH {_A} SELECT metric, count(*) AS n, round(avg(v), 4) AS mean, round(max(v), 4) AS max FROM (SELECT 'raster_error' AS metric, raster_error AS v FROM a UNION ALL SELECT 'quality_error', quality_error FROM a UNION ALL SELECT 'weight', weight FROM a) GROUP BY metric",
    "metric_error_sums": f"WITH {_A} SELECT kind, round(sum(raster_error + quality_error + 0.35), 2)::DOUBLE AS error, round(sum(raster_error + quality_error), 2)::DOUBLE AS harvest_error FROM a GROUP BY kind",
    "cv_metrics": f"WITH {_A} SELECT run_id, round(CASE WHEN avg(parameter_count) <= 0 THEN 1 ELSE stddev_pop(parameter_count) / avg(parameter_count) END, 6)::DOUBLE AS stroke_width_variance FROM a GROUP BY run_id",
    "best_anchor": f"""WITH {_A}, s AS (SELECT run_id, anchor_index, kind, round(raster_error + quality_error + 0.015 * node_count + 0.01 * parameter_count - CASE kind WHEN 'circle' THEN 0.35 WHEN 'rect' THEN 0.25 ELSE 0 END, 9)::DOUBLE AS score FROM a)
        SELECT run_id, anchor_index, kind, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score, anchor_index) = 1""",
    "top_contributors": f"WITH {_A} SELECT run_id, anchor_index, parameter_count, row_number() OVER (PARTITION BY run_id ORDER BY parameter_count DESC, anchor_index) AS rank FROM a QUALIFY rank <= 5",
    "equivalence_dedup": f"""WITH {_A} SELECT run_id, anchor_index, kind FROM a
        QUALIFY kind = 'cubic_path' OR row_number() OVER (PARTITION BY run_id, color, floor(x0 / 10), floor(y0 / 10), kind = 'cubic_path' ORDER BY anchor_index) = 1""",
    "same_color_merge_plan": f"WITH {_A}, {_MERGE} SELECT run_id, color, fragments, round(fragment_area, 6) AS fragment_area, round(combined_area, 6) AS combined_area, round(fill_ratio, 6)::DOUBLE AS fill_ratio, fill_ratio >= 0.55 AS auto_merge_allowed FROM plan",
    "merge_exact_rects": """WITH r AS (SELECT DISTINCT p_brand, p_size, (p_partkey % 4)::DOUBLE AS x FROM part), g AS (SELECT p_brand, p_size, count(*) AS n, min(x) AS a, max(x) + 1 AS b FROM r GROUP BY ALL)
        SELECT p_brand, p_size, a AS min_x, 0.0::DOUBLE AS min_y, b AS max_x, 1.0::DOUBLE AS max_y, n AS merged_from FROM g WHERE n > 1 AND n = b - a
        UNION ALL SELECT r.p_brand, r.p_size, x, 0.0, x + 1, 1.0, 1 FROM r JOIN g ON r.p_brand = g.p_brand AND r.p_size = g.p_size WHERE NOT (n > 1 AND n = b - a)""",
    "parallel_groups": f"""WITH {_A}, s AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM a), o AS (SELECT *, CASE WHEN abs(dx) < 1e-6 AND abs(dy) < 1e-6 THEN NULL WHEN abs(dx) >= 2*abs(dy) THEN 'horizontal' WHEN abs(dy) >= 2*abs(dx) THEN 'vertical' WHEN dx*dy >= 0 THEN 'diagonal_pos' ELSE 'diagonal_neg' END AS orientation FROM s),
        w AS (SELECT *, sqrt(((x0+x1)/2 - lag((x0+x1)/2) OVER k)**2 + ((y0+y1)/2 - lag((y0+y1)/2) OVER k)**2) AS step FROM o WHERE orientation IS NOT NULL WINDOW k AS (PARTITION BY run_id, color, orientation ORDER BY anchor_index))
        SELECT run_id, color, orientation, count(*) AS members, round(CASE WHEN avg(step) <= 0 THEN 1 ELSE stddev_pop(step) / avg(step) END, 6)::DOUBLE AS parallel_spacing_error FROM w GROUP BY ALL HAVING count(*) >= 2""",
    "scene_contacts": f"""WITH {_A}, p AS (SELECT a.run_id, a.anchor_index, b.anchor_index AS anchor_index_2, {_IOU} AS inter, sqrt(greatest(a.x0-b.x1, b.x0-a.x1, 0)**2 + greatest(a.y0-b.y1, b.y0-a.y1, 0)**2) AS gap,
            (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) AS areas FROM a JOIN a b ON a.run_id = b.run_id AND a.anchor_index < b.anchor_index AND a.color <> b.color)
        SELECT run_id, anchor_index, anchor_index_2, CASE WHEN inter > 0 THEN 'overlapping' ELSE 'touching' END AS relation, round(gap, 6) AS bounds_gap, round(CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END, 6)::DOUBLE AS bounds_iou FROM p WHERE gap <= 1 OR inter > 0""",
    "occluded_groups": f"""WITH {_A}, {_MERGE}, b AS (SELECT * FROM plan WHERE fill_ratio >= 0.55 AND fragment_area < combined_area)
        SELECT a.run_id, b.color, any_value(fragments) AS fragments, count(*) AS occluders, round(any_value(combined_area - fragment_area), 6) AS hidden_area FROM b JOIN a ON a.run_id = b.run_id AND a.color <> b.color AND {_IOU} > 0 GROUP BY a.run_id, b.color""",
    "text_like_groups": """WITH g AS (SELECT l_suppkey AS group_id, count(*) AS fragments, count(*) FILTER (l_returnflag = 'R') AS generic, count(*) * 5.0 AS area, max(l_partkey) + 0.5 - min(l_partkey) AS w, 10.0 AS h FROM lineitem GROUP BY l_suppkey)
        SELECT group_id, fragments, generic FROM g WHERE fragments >= 20 AND generic >= 8 AND area / (w * h) <= 0.25 AND w / h >= 4""",
    "group_context": f"WITH {_A} SELECT run_id, anchor_index, color AS group_id, (row_number() OVER (PARTITION BY run_id, color ORDER BY anchor_index) - 1)::INT AS anchor_position FROM a",
    "coordinate_clusters": "WITH v AS (SELECT DISTINCT p_brand, p_size FROM part), i AS (SELECT *, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM v) SELECT p_brand, min(p_size) AS start, max(p_size) AS \"end\" FROM i GROUP BY p_brand, k",
    "spacing_error": """WITH p AS (SELECT user_id, event_id, hour(ts)::DOUBLE AS x, (event_id % 7)::DOUBLE AS y FROM events WHERE value IS NOT NULL), s AS (SELECT user_id, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 WHEN avg(d) <= 0 THEN 1 ELSE stddev_pop(d) / avg(d) END, 6)::DOUBLE AS spacing_error FROM s GROUP BY user_id""",
    "class_centroids": f"WITH {_E} SELECT label, pos, round(value, 6) AS value FROM cen",
    "feature_importance": f"WITH {_E}, s AS (SELECT pos, max(value) - min(value) AS importance FROM cen GROUP BY pos) SELECT pos, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, pos) AS rank FROM s",
    "predict_nearest": f"WITH {_P} SELECT vec_id, label, predicted, round(distance, 6) AS distance FROM p",
    "confusion": f"WITH {_P} SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL",
    "label_accuracy": f"WITH {_ACC} SELECT label, n, correct, round(accuracy, 6) AS accuracy FROM acc",
    "standardize_features": f"WITH {_E}, s AS (SELECT pos, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS k FROM e GROUP BY pos) SELECT vec_id, pos, round((v - m) / k, 5) AS z FROM e JOIN s USING (pos)",
    "ranking_eval": f"""WITH {_A}, x AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY round(raster_error, 9), anchor_index) AS i, row_number() OVER (PARTITION BY run_id ORDER BY round(raster_error + CASE WHEN kind = 'cubic_path' THEN 0.35 ELSE 0 END, 9), anchor_index) AS j FROM a),
        h AS (SELECT run_id, max(kind) FILTER (i = 1) AS h, max(kind) FILTER (j = 1) AS s FROM x GROUP BY run_id)
        SELECT count(*) AS n, count(*) FILTER (h = 'circle') AS heuristic_correct, count(*) FILTER (s = 'circle') AS assisted_correct, count(*) FILTER (h <> s) AS changed FROM h""",
    "multilabel_exact_match": """WITH x AS (SELECT quality = 1 AS q, toxic = 1 AS t, n_chars > 500 AS pq, n_chars > 5000 AS pt FROM labels JOIN documents USING (doc_id))
        SELECT count(*) AS n, count(*) FILTER (q = pq AND t = pt) AS exact_matches, round(coalesce(sum((q AND pq)::INT + (t AND pt)::INT) / nullif(sum(q::INT + t::INT), 0), 0), 6)::DOUBLE AS target_accuracy, sum(t::INT)::BIGINT AS unknown_targets FROM x""",
    "softmax_step": f"WITH {_E} SELECT k::INT AS label, pos, round(-0.001 * avg(v * (0.1 - (label = k)::INT)), 9) AS weight FROM e, range(10) r(k) GROUP BY k, pos",
    "positional_split": "WITH d AS (SELECT lang, row_number() OVER (ORDER BY doc_id DESC) AS k FROM documents) SELECT CASE WHEN k <= 30 THEN 'test' WHEN k <= 50 THEN 'val' ELSE 'train' END AS split, lang, count(*) AS n FROM d GROUP BY ALL",
    "training_gate": f"""WITH {_ACC}, g AS (SELECT max(round(accuracy - 0.5, 6)) AS best, min(round(accuracy - 0.5, 6)) AS worst FROM acc)
        SELECT best, worst, CASE WHEN best > 0 AND worst < 0 THEN 'mixed' WHEN best > 0 THEN 'improved' WHEN worst < 0 THEN 'regressed' ELSE 'unchanged' END AS status,
            CASE WHEN best < 0 OR worst < 0 THEN 'reject' WHEN best = 0 AND worst = 0 THEN 'manual_review' ELSE 'accept' END AS decision,
            concat_ws(',', CASE WHEN best < 0 THEN 'best_accuracy_delta_below_min' END, CASE WHEN worst < 0 THEN 'worst_accuracy_delta_below_tolerance' END, CASE WHEN worst < 0 AND best <= 0 THEN 'comparison_status_regressed' END,
                CASE WHEN best > 0 AND worst < 0 THEN 'comparison_status_mixed' END, CASE WHEN best = 0 AND worst = 0 THEN 'comparison_status_unchanged' END) AS reasons FROM g""",
    "harvest_rejections": f"WITH {_R} SELECT CASE WHEN diagnostics > 0 THEN 'too_many_run_diagnostics' WHEN coalesce(editability, 1) < 0.5 THEN 'editability_score_too_low' WHEN l1 > 0.6 THEN 'raster_l1_error_too_high' ELSE 'accepted' END AS reason, count(*) AS n FROM r GROUP BY 1",
    "review_queue": f"WITH {_R} SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY l1 DESC, doc_id) AS ordinal, 'pending' AS decision FROM r WHERE diagnostics = 0",
    "apply_review": f"""WITH {_R}, x AS (SELECT doc_id, l1, CASE WHEN lang = 'de' THEN 'pending' WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'pending' END AS decision FROM r)
        SELECT decision, CASE WHEN decision = 'accept' AND l1 > 0.5 THEN 'circle' ELSE 'rect' END AS kind, count(*) AS n FROM x GROUP BY ALL""",
    "issue_counts": f"WITH {_R} SELECT lang, issue, count(*) AS n FROM (SELECT lang, 'toxic' AS issue FROM r WHERE toxic = 1 UNION ALL SELECT lang, 'low_quality' FROM r WHERE quality = 0 UNION ALL SELECT lang, 'blurred' FROM r WHERE l1 > 0.6) GROUP BY ALL",
    "promotion_decision": """WITH g AS (SELECT l_orderkey AS case_id, l_quantity > 5 AS ok, l_returnflag = 'R' AS red, l_linenumber = 7 AS missing FROM lineitem),
        c AS (SELECT case_id, count(*) AS gates, count(*) FILTER (NOT ok AND red) AS red, count(*) FILTER (NOT ok AND NOT g.red) AS yellow, bool_or(missing) AS missing FROM g GROUP BY case_id)
        SELECT case_id, gates, red, yellow, CASE WHEN missing THEN 'deferred' WHEN red > 0 THEN 'rejected' WHEN yellow > 0 THEN 'deferred' ELSE 'promoted' END AS state, CASE WHEN red > 0 THEN 0 WHEN yellow > 0 THEN 1 ELSE 2 END AS sort_key FROM c""",
    "anchor_state_priority": """WITH s AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_tax > 0.04 THEN 3 ELSE 4 END) AS k FROM lineitem GROUP BY l_orderkey)
        SELECT ['promoted', 'rejected', 'deferred', 'fallback'][k] AS state, count(*) AS n FROM s GROUP BY k""",
    "expectation_check": """WITH e AS (SELECT o_custkey, o_orderpriority AS kind, o_orderkey AS ord, (sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey))::BIGINT AS needed, CASE WHEN o_totalprice > 150000 THEN 2 END AS mx FROM orders),
        t AS (SELECT o_custkey, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL)
        SELECT o_custkey, kind, ord, needed, n, NOT coalesce(n < needed OR n > mx, false) AS ok, CASE WHEN n < needed THEN 'shortfall' WHEN n > mx THEN 'excess' ELSE '' END AS reason FROM e JOIN t USING (o_custkey, kind)""",
    "region_gates": f"""WITH {_A}, b AS (SELECT * FROM a WHERE line = 1), h AS (SELECT b.run_id, b.anchor_index AS region_id, {_IOU} AS i, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) AS s FROM b JOIN a ON a.run_id = b.run_id AND a.line > 1),
        q AS (SELECT run_id, region_id, CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END AS iou FROM h), g AS (SELECT run_id, region_id, count(*) FILTER (iou >= 0.1) AS matched, max(iou) AS best_iou FROM q GROUP BY ALL)
        SELECT b.run_id, b.anchor_index AS region_id, coalesce(matched, 0) AS matched, round(best_iou, 6) AS best_iou, coalesce(matched, 0) >= 1 AS ok FROM b LEFT JOIN g ON b.run_id = g.run_id AND b.anchor_index = g.region_id""",
    "proposal_summary": f"""WITH {_A}, s AS (SELECT parameter_count > 45 AS late, CASE WHEN weight <= 2000 THEN 'missing_anchor_summary' WHEN raster_error > 0.08 THEN 'anchor_quality_error_too_high' WHEN node_count <= 1 THEN 'anchor_not_reserved' ELSE 'geometry_gate_passed' END AS r FROM a)
        SELECT CASE WHEN late THEN 'deferred' ELSE 'proposed' END AS status, CASE WHEN late OR r <> 'geometry_gate_passed' THEN 'rejected' ELSE 'accepted' END AS downstream_status, CASE WHEN late THEN '' ELSE r END AS reason, count(*) AS n FROM s GROUP BY ALL""",
    "case_failures": f"""WITH {_A}, f AS (SELECT 'fallback_path' AS category, 'kind' AS metric FROM a WHERE kind = 'cubic_path' AND color <> 'O' UNION ALL SELECT 'visual_drift', 'size' FROM a WHERE node_count >= 4
            UNION ALL SELECT 'visual_drift', 'raster_l1_error' FROM a WHERE raster_error > 0.05 UNION ALL SELECT 'visual_drift', 'raster_edge_error' FROM a WHERE quality_error > 0.04
            UNION ALL SELECT 'visual_drift', 'raster_alpha_error' FROM a WHERE parameter_count <= 2 UNION ALL SELECT 'geometry_drift', 'bbox_iou' FROM a WHERE parameter_count / 50 < 0.5)
        SELECT category, metric, count(*) AS n FROM f GROUP BY ALL""",
    "tile_grids": """WITH t AS (SELECT DISTINCT p_brand, p_partkey % 5 AS x, p_size // 10 AS y FROM part)
        SELECT p_brand, count(*) AS tiles, count(DISTINCT y)::INT AS rows, count(DISTINCT x)::INT AS columns, round(count(*) / (count(DISTINCT x) * count(DISTINCT y)), 6) AS occupancy FROM t GROUP BY p_brand
        HAVING count(*) >= 4 AND count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2 AND count(*) / (count(DISTINCT x) * count(DISTINCT y)) >= 0.6""",
    "snapshot_diff": f"""WITH {_S}, f AS (SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE concat_ws(',', CASE WHEN b.s IS DISTINCT FROM n.s THEN 'o_orderstatus' END, CASE WHEN b.p IS DISTINCT FROM n.p THEN 'o_orderpriority' END, CASE WHEN b.t IS DISTINCT FROM n.t THEN 'o_totalprice' END) END AS c
            FROM b FULL JOIN n ON b.k = n.k)
        SELECT CASE WHEN c IN ('added', 'removed') THEN c WHEN c = '' THEN 'same' ELSE 'changed' END AS status, CASE WHEN c IN ('added', 'removed') THEN '' ELSE c END AS changed_fields, count(*) AS n FROM f GROUP BY ALL""",
    "numeric_path_deltas": f"WITH {_S} SELECT b.k AS o_orderkey, 'o_totalprice' AS path, round(n.t - b.t, 4) AS delta FROM b JOIN n ON b.k = n.k WHERE n.t <> b.t",
    "baseline_drift": """WITH f AS (SELECT c_custkey AS id, c_nationkey AS k, c_mktsegment AS s, round(c_acctbal / 10000, 4) AS l1, round(c_acctbal / 20000, 4) AS iou FROM customer), b AS (SELECT * FROM f WHERE k <> 4),
        n AS (SELECT id, l1 + CASE s WHEN 'BUILDING' THEN 0.01 WHEN 'MACHINERY' THEN -0.01 ELSE 0.001 END AS l1, iou + CASE WHEN s = 'AUTOMOBILE' THEN -0.05 ELSE 0 END AS iou FROM f WHERE k <> 3),
        t AS (SELECT id, 'l1' AS metric, n.l1 - b.l1 AS delta, n.l1 - b.l1 AS worse FROM b JOIN n USING (id) UNION ALL SELECT id, 'bbox_iou', n.iou - b.iou, b.iou - n.iou FROM b JOIN n USING (id))
        SELECT id, metric, round(delta, 6)::DOUBLE AS delta, CASE WHEN worse > 0.002 THEN 'regression' ELSE 'improvement' END AS finding FROM t WHERE abs(worse) > 0.002
        UNION ALL SELECT coalesce(b.id, n.id), '', NULL, CASE WHEN b.id IS NULL THEN 'added' ELSE 'removed' END FROM b FULL JOIN n ON b.id = n.id WHERE b.id IS NULL OR n.id IS NULL""",
    "family_baseline_status": """WITH b AS (SELECT c_mktsegment, c_nationkey, count(*) FILTER (c_custkey % 5 <> 0) AS bp, count(*) FILTER (c_custkey % 5 = 0) AS bf FROM customer WHERE c_nationkey <> 3 GROUP BY ALL),
        c AS (SELECT c_mktsegment, c_nationkey, count(*) FILTER (c_custkey % 5 <> 1) AS cp, count(*) FILTER (c_custkey % 5 = 1) AS cf FROM customer WHERE c_nationkey <> 4 GROUP BY ALL)
        SELECT c_mktsegment, c_nationkey, CASE WHEN bp IS NULL AND cf > 0 THEN 'new_regression' WHEN bp IS NULL THEN 'new_family' WHEN cp IS NULL THEN 'missing_current_family' WHEN bf = 0 AND cf > 0 THEN 'new_regression'
            WHEN bf > 0 AND cf = 0 THEN 'resolved_regression' WHEN bf > 0 AND cf = bf THEN 'known_debt' WHEN cf < bf THEN 'improved' WHEN cf = bf AND cp = bp THEN 'held' ELSE 'changed' END AS status FROM b FULL JOIN c USING (c_mktsegment, c_nationkey)""",
    "sweep_rank": """WITH r AS (SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 100000) END AS e, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE o_orderkey % 10 / 10 END AS l FROM orders)
        SELECT o_custkey, id, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(e, 0) DESC, CASE WHEN coalesce(l, 0) = 0 THEN 1 ELSE l END, id::VARCHAR) AS semantic_rank FROM r""",
}
