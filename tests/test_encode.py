"""The whole encoding plan against a plain Python twin, and its parts on small cases."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from eventide.operators import encode
from eventide.plans import stream
from eventide.sources import tables

UNK = 3


def category(concept, value):
    v = "_".join(str(value or "").replace("_", " ").lower().split())
    return None if not v else f"{concept}=cat_{v}" if v.lstrip("+-").isdigit() else f"{concept}={v}"


def twin(stays, events):
    """{stay: (tokens, minutes, values, hard eligible, partition)} from rows, and the segments' edges."""
    stays = {s.hosp_id: s for s in stays}
    kept = []
    for e in events:
        s = stays.get(e.hosp_id)
        if s and s.lo <= e.dttm <= s.hi:
            number = e.value is not None and math.isfinite(e.value)
            kept.append((s, int((e.dttm - s.lo).total_seconds() // 60), e, number, None if number else category(e.concept, e.cat_value)))
    fit = [k for k in kept if k[0].partition == "train"]
    values, seen = collections.defaultdict(list), collections.defaultdict(set)
    for s, _, e, number, cat in fit:
        if number:
            values[e.concept].append(e.value)
        if cat:
            seen[e.concept, cat].add(s.hosp_id)
    bins = {}  # concept: function of a value, number of bins
    for c, v in values.items():
        distinct = sorted(set(v))
        if c == "sodium":
            bins[c] = (lambda x: 0 if x < 135 else 1 if x <= 145 else 2, 3)
        elif len(v) >= 20 and len(distinct) <= 25 and all(x == round(x) for x in distinct):
            bins[c] = (lambda x, d=distinct: min(range(len(d)), key=lambda i: (abs(d[i] - x), i)), len(distinct))
        elif len(v) >= 20:
            o = sorted(v)
            edges = sorted({o[int((len(o) - 1) * k / 10 + 0.5)] for k in range(1, 10)})
            bins[c] = (lambda x, d=edges: sum(e <= x for e in d), len(edges) + 1)
    bins.setdefault("sodium", (lambda x: 0 if x < 135 else 1 if x <= 145 else 2, 3))
    vocab = {}
    for t in stream.FRAME_TOKENS:
        vocab[t] = 4 + len(vocab)
    for c in sorted({k[2].concept for k in fit} | set(bins)):
        for t in [f"{c}#{b}" for b in range(bins[c][1])] if c in bins else [c]:
            vocab[t] = 4 + len(vocab)
        for t in sorted(t for (q, t), who in seen.items() if q == c and len(who) >= 3):
            vocab[t] = 4 + len(vocab)
    out = {}
    last = lambda x: (x is None, x if x is not None else 0)
    for h, s in stays.items():
        own = sorted((k for k in kept if k[0] is s), key=lambda k: (k[1], k[2].dttm, k[2].source, k[2].concept, last(k[2].value), last(k[2].cat_value)))
        rows = []
        for _, m, e, number, cat in own:
            if number and e.concept in bins:
                t = vocab[f"{e.concept}#{bins[e.concept][0](e.value)}"]
            elif cat:
                t = vocab.get(cat, UNK)
            elif e.concept in bins:
                continue
            else:
                t = vocab.get(e.concept, UNK)
            rows.append((t, m, e.value if number and t != UNK else None, True))
        head = [(1, 0, None, False), (vocab[f"ADMISSION//{s.admission}"], 0, None, False)]
        tail = [(vocab[f"DISCHARGE//{s.disposition}"], max(s.end_min, 0), None, True), (2, max(s.end_min, 0), None, False)]
        out[h] = ([*head, *rows, *tail], s.partition, 1 + len(rows))
    return out


def test_plan_equals_its_twin(spark, sf, monkeypatch):
    monkeypatch.setattr(stream, "MAX_TOKENS", 7)
    stays = stream.stays_of(spark, sf).collect()
    assert {s.partition for s in stays} == {"train", "test"} and len({s.hosp_id for s in stays}) == len(stays)
    want = twin(stays, tables.read_events(spark, sf, stream.SOURCES).collect())
    got = collections.defaultdict(list)
    for r in stream.encoded_stays(spark, sf).collect():
        got[r.hosp_id].append(r)
    assert set(got) == set(want)
    for h, windows in got.items():
        windows.sort(key=lambda r: r.continuation_index)
        rows, partition, anchor = want[h]
        flat = [x for w in windows for x in zip(w.token, w.pos_min, w.value, w.target_eligible)]
        assert flat == rows, h
        assert [w.source_start for w in windows] == list(range(0, len(rows), 7)) and windows[-1].source_end == len(rows)
        assert {w.n_windows for w in windows} == {len(windows)} and [w.continues_to_next for w in windows] == [True] * (len(windows) - 1) + [False]
        assert {(w.partition, w.anchor_idx, w.anchor_min) for w in windows} == {(partition, anchor, 1440)}
        for w in windows:
            for t, soft, weight in zip(w.token, w.soft_token, w.soft_weight):
                assert len(soft) == len(weight) == 3 and t in soft and sum(weight) == pytest.approx(1)


def test_vocabulary_has_every_segment_and_floors_categories(spark):
    events = spark.createDataFrame([("a", "a=x", "h1"), ("a", "a=x", "h2"), ("a", "a=y", "h1"), ("b", None, "h1"), (None, "z=z", "h1")], "concept string, cat_token string, h string")
    segments = spark.createDataFrame([("b", [(None, 1.0, False, False), (1.0, None, True, False)]), ("c", [(None, None, False, False)])], f"concept string, segments array<{encode.bin_index.__globals__['SEGMENT']}>")
    got = {r.token: r.id for r in encode.segment_vocabulary(events, segments, "h", 2, ["F//1"]).collect()}
    assert got == {"F//1": 4, "a": 5, "a=x": 6, "b#0": 7, "b#1": 8, "c#0": 9}
    assert encode.segment_vocabulary(events.limit(0), segments.limit(0), "h", 2).count() == 0


def test_values_without_a_number(spark):
    segments = spark.createDataFrame([("b", [(0.0, 1.0, True, False), (1.0, 2.0, True, True)])], f"concept string, segments array<{encode.bin_index.__globals__['SEGMENT']}>")
    vocab = spark.createDataFrame([("b#0", 4), ("b#1", 5), ("c", 6), ("b=low", 7)], "token string, id bigint")
    rows = [(0, "b", 1.5, None), (1, "b", None, None), (2, "b", None, "b=low"), (3, "b", 0.5, "b=low"), (4, "c", 9.0, None), (5, "c", None, None), (6, "new", 3.0, None), (7, "b", float("nan"), "b=odd")]
    df = spark.createDataFrame(rows, "i int, concept string, value double, cat_token string")
    got = {r.i: (r.id, r.value, r.soft_token) for r in encode.encode_events(df, segments, vocab, 1).collect()}
    assert {i: x[:2] for i, x in got.items()} == {0: (5, 1.5), 2: (7, None), 3: (4, 0.5), 4: (6, 9.0), 5: (6, None), 6: (UNK, None), 7: (UNK, None)}
    assert got[0][2] == [4, 5, 5] and got[3][2] == [4, 4, 5] and got[2][2] == [7, 7, 7]


def test_windows_of_a_hot_entity_and_of_none(spark):
    events = spark.range(3000).select(F.lit("hot").alias("h"), F.expr("id * 37 % 100000").alias("m"), (F.col("id") % 5 + 4).alias("id"))
    frames = spark.createDataFrame([("hot", [1], [2], [0], [9]), ("none", [1], [2], [0], [9])], "h string, head array<bigint>, tail array<bigint>, head_m array<bigint>, tail_m array<bigint>")
    out = encode.encode_windows(events, None, "h", ["m", "id"], ["m"], 64, frames=frames).collect()
    hot = sorted((r for r in out if r.h == "hot"), key=lambda r: r.continuation_index)
    flat = [x for r in hot for x in zip(r.m, r.token)]
    assert flat == [(0, 1), *sorted((i * 37 % 100000, i % 5 + 4) for i in range(3000)), (9, 2)] and len(hot) == 47
    assert [(r.token, r.n_windows, r.continues_to_next) for r in out if r.h == "none"] == [([1, 2], 1, False)]
