"""Scores that could not be tested."""

import datetime as dt

from eventide.operators import reshape

RULE = {"verbal": "v", "eye": "e", "motor": "m", "total": "t", "codes": ["not_testable", "intubated"], "numbers": [0.0], "bands": [(2, 4, 1), (5, 7, 3)]}


def test_totals_are_imputed_marked_or_dropped(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("s", at(1), "v", 0.0, None), ("s", at(1), "e", 2.0, None), ("s", at(1), "m", 4.0, None), ("s", at(1), "t", 15.0, None),  # imputed: 6 + 3
        ("s", at(2), "v", None, " Intubated "), ("s", at(2), "e", 2.0, None), ("s", at(2), "t", 15.0, None),  # no motor: dropped
        ("s", at(3), "v", None, "intubated"), ("s", at(3), "e", 2.0, None), ("s", at(3), "e", 3.0, None), ("s", at(3), "m", 1.0, None), ("s", at(3), "t", 15.0, None),  # two eyes: dropped
        ("s", at(4), "v", 0.0, None), ("s", at(4), "e", 9.0, None), ("s", at(4), "m", 9.0, None), ("s", at(4), "t", 15.0, None),  # no band
        ("s", at(5), "v", 5.0, None), ("s", at(5), "e", 2.0, None), ("s", at(5), "m", 4.0, None), ("s", at(5), "t", 11.0, None), ("q", at(1), "t", 7.0, None), (None, at(1), "t", 3.0, None),
    ]
    df = spark.createDataFrame(rows, "hosp_id string, dttm timestamp, concept string, value double, cat_value string")
    out = [tuple(r) for r in reshape.not_testable(df, **RULE).select("hosp_id", "dttm", "concept", "value", "cat_value").collect()]
    totals = sorted((str(h), d.hour, v) for h, d, c, v, _ in out if c == "t")
    assert totals == [("None", 1, 3.0), ("q", 1, 7.0), ("s", 1, 9.0), ("s", 5, 11.0)]
    assert [(d.hour, c, v, x) for _, d, c, v, x in out if c == "total_source"] == [(1, "total_source", None, "imputed")]
    assert sorted((d.hour, v, x) for _, d, c, v, x in out if c == "v") == [(1, None, "not_testable"), (2, None, "not_testable"), (3, None, "not_testable"), (4, None, "not_testable"), (5, 5.0, None)]
    assert reshape.not_testable(df.limit(0), **RULE).count() == 0
