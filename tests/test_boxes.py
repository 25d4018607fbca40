"""Boxes of a page against a greedy choice row by row in plain Python."""

import random

from quillspark.operators import folds


def greedy(rows):
    """Best confidence first, then the lower number; a row is kept if it overlaps no kept one."""
    kept = []
    sure = lambda x: x[7] is not None and x[7] == x[7]  # noqa: E731, PLR0124
    for row in sorted(rows, key=lambda x: (not sure(x), -x[7] if sure(x) else 0.0, x[2] is None, x[2] or 0, x[3], x[4])):
        if all(k[:2] != row[:2] or folds.iou(k[3:7], row[3:7]) <= 0.6 for k in kept):
            kept.append(row)
    return kept


def test_boxes_of_one_number(spark):
    """A box isn't kept because another one of its number is."""
    rows = [(1, 1, 1, 0.0, 0.0, 20.0, 5.0, 0.9, "a"), (1, 1, 1, 1.0, 0.0, 20.0, 5.0, 0.5, "b"), (1, 1, 2, 60.0, 0.0, 20.0, 5.0, 0.1, "c")]
    got = folds.suppress_boxes(spark.createDataFrame(rows, folds.BOXES)).collect()
    assert sorted(x.text for x in got) == ["a", "c"]


def test_boxes_as_greedy(spark):
    r = random.Random(11)
    box = lambda d, p: (d, p, r.choice([None, *range(9)]), r.randrange(60) / 2, r.randrange(9) / 2, 20.0, 5.0, r.choice([None, float("nan"), 0.0, -0.0, *[r.random()] * 3]), str(r.random()))
    rows = [box(d, p) for d in (None, 1, 2, 3) for p in (1, 2) for _ in range(40)]
    rows = list({(x[:2], x[3:5], x[2]): x for x in rows}.values())
    df = spark.createDataFrame(rows, folds.BOXES)
    got = folds.suppress_boxes(df)
    assert got.dtypes == df.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame(greedy(rows), folds.BOXES).collect()))


def test_boxes_with_unknown_sides_overlap_nothing(spark):
    rows = [(1, 1, 1, None, 0.0, 20.0, 5.0, 0.9, "a"), (1, 1, 2, 0.0, 0.0, 20.0, float("nan"), 0.8, "b"), (1, 1, 3, 0.0, 0.0, 20.0, 5.0, 0.7, "c")]
    assert len(folds.suppress_boxes(spark.createDataFrame(rows, folds.BOXES)).collect()) == 3


def test_boxes_use_no_python_worker(spark):
    """A page in Python costs a call each, some milliseconds."""
    df = folds.suppress_boxes(spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 20.0, 5.0, 0.9, "a")], folds.BOXES))
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
