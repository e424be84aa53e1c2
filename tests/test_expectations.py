"""Expectations of scenes: limits, places, sums of repeated ones, missing and empty inputs."""

from inkframe.operators.expectations import expectation_results

E = "run long, expectation_id string, ord int, metric string, min_value double, max_value double, kinds array<string>, group_kind string, min_x double, min_y double, max_x double, max_y double, min_iou double, min_count int, max_count int"
A = "run long, kind string, min_x double, min_y double, max_x double, max_y double"


def row(name, order=0, run=1, metric=None, low=None, high=None, kinds=None, group=None, box=(None,) * 4, iou=None, least=None, most=None):
    return (run, name, order, metric, low, high, kinds, group, *box, iou, least, most)


def results(spark, expected, anchors=(), groups=(), metrics=()):
    out = expectation_results(
        spark.createDataFrame(list(expected), E), spark.createDataFrame(list(anchors), A), spark.createDataFrame(list(groups), "run long, kind string"),
        spark.createDataFrame(list(metrics), "run long, name string, value double"), "run",
    )
    return {r["expectation_id"]: r for r in out.collect()}


def test_metrics(spark):
    found = results(
        spark,
        [row("in", metric="m", low=1.0, high=2.0), row("low", metric="m", low=3.0), row("high", metric="m", high=1.0), row("gone", metric="x"), row("null", metric="n", high=9.0), row("other run", run=2, metric="m")],
        metrics=[(1, "m", 1.5), (1, "n", None)],
    )
    assert {k: r["reason"] for k, r in found.items()} == {"in": None, "low": "metric_below_min", "high": "metric_above_max", "gone": "missing_metric", "null": "missing_metric", "other run": "missing_metric"}
    assert (found["low"]["shortfall"], found["high"]["excess"], found["in"]["ok"]) == (1.5, 0.5, True)


def test_places(spark):
    box, far = (0.0, 0.0, 10.0, 10.0), (500.0, 500.0, 510.0, 510.0)
    anchors = [(1, "rect", *box), (1, "rect", *far), (1, "rect", 3.0, 3.0, 3.0, 9.0), (1, "rect", None, None, None, None), (1, "circle", *box)]
    found = results(
        spark,
        [row("here", kinds=["rect"], box=box, iou=0.5), row("any place", kinds=["rect"], box=box), row("no box", kinds=["rect"]), row("turned box", 1, kinds=["rect", "circle", "rect"], box=(9.0, 0.0, 1.0, 5.0), iou=0.5), row("none", kinds=["quad"]), row("empty list", kinds=[], least=0)],
        anchors,
    )
    assert {k: r["actual_count"] for k, r in found.items()} == {"here": 1, "any place": 2, "no box": 4, "turned box": 5, "none": 0, "empty list": 0}
    assert found["none"]["reason"] == "insufficient_anchors" and found["empty list"]["ok"]


def test_repeated_ones_add_up(spark):
    expected = [row("a", 1, kinds=["rect"]), row("b", 2, kinds=["rect"], least=1), row("c", 3, kinds=["rect"]), row("elsewhere", 4, run=2, kinds=["rect"], least=0), row("forbidden", 5, kinds=["rect"], iou=0.1, least=0, most=0), row("many", 6, kinds=["rect"], iou=0.2, most=1)]
    found = results(spark, expected, [(1, "rect", 0.0, 0.0, 1.0, 1.0)] * 2)
    assert {k: (r["required"], r["reason"]) for k, r in found.items()} == {
        "a": (1, None), "b": (2, None), "c": (3, "insufficient_distinct_anchors"), "elsewhere": (0, None), "forbidden": (0, "forbidden_matches"), "many": (1, "too_many_matches"),
    }
    assert (found["c"]["missing_count"], found["forbidden"]["excess_count"], found["many"]["excess_count"]) == (1, 2, 1)


def test_groups_and_empty_tables(spark):
    found = results(spark, [row("two", group="line", least=2), row("one more", 1, group="line", least=1), row("no kind")], groups=[(1, "line"), (1, "line"), (1, None)])
    assert {k: r["reason"] for k, r in found.items()} == {"two": None, "one more": "insufficient_groups", "no kind": "insufficient_groups"}
    assert results(spark, [], groups=[(1, "line")]) == {}
