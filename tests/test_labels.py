"""Labels at anchors."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq

from eventide import catalog


def brute(readings):
    by = {}
    for h, m, v in readings:
        by.setdefault(h, {}).setdefault(m, []).append(v > 2)
    want = {}
    for h, m, _ in readings:
        a = m + 600
        past = [x for x in by[h] if x <= a]
        later = [x for x in by[h] if a < x <= a + 10080]
        hits = [x for x in later if any(by[h][x])]
        status = "prevalent" if any(by[h][max(past)]) else "positive" if hits else "negative" if later else "censored"
        want[h, a] = (status, min(hits) - a if status == "positive" else None)
    return want


def test_every_reading_is_an_anchor(spark, tmp_path):
    rnd = random.Random(4)
    readings = [(f"h{rnd.randrange(12)}", rnd.randrange(0, 40_000, 200), rnd.choice([0.8, 1.9, 2.0, 2.1, 3.0])) for _ in range(240)]
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    h, m, v = zip(*readings)
    labs = {"lab_id": range(240), "hospitalization_id": h, "lab_result_dttm": pa.array([start + dt.timedelta(minutes=x) for x in m], pa.timestamp("us", "UTC")), "lab_value_numeric": v}
    labs |= {"lab_category": ["creatinine"] * 240, "reference_unit": ["mg/dL"] * 240}
    pq.write_table(pa.table({k: x if isinstance(x, pa.Array) else list(x) for k, x in labs.items()}), f"{tmp_path}/labs.parquet")
    origin = int(start.timestamp()) // 60
    got = catalog.queries()["lab_03_all_anchors"](spark, str(tmp_path)).collect()
    assert len(got) == len({(h, m) for h, m, _ in readings})
    want = brute(readings)
    assert {(r.h, r.anchor_min - origin): (r.status, r.after_min) for r in got} == want
    assert {s for s, _ in want.values()} == {"prevalent", "positive", "negative", "censored"}
