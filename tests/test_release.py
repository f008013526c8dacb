"""Sinks, packing, doses and release control."""

import pytest

from eventide.operators import disclosure, doses, encode, windows
from eventide.sources import sinks, tables


def test_shards_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 3}", i * 2) for i in range(50)], "i int, p string, v int")
    sinks.write_shards(df, f"{tmp_path}/s", "p", ["i"], files=2)
    part = sinks.read_shard(spark, f"{tmp_path}/s", "p", "p1", ["i", "v"])
    assert sorted(r.i for r in part.collect()) == list(range(1, 50, 3)) and part.columns == ["i", "v"]
    df.drop("p").write.option("header", True).csv(f"{tmp_path}/c")
    assert sinks.read_csv(spark, f"{tmp_path}/c", "i int, v int").count() == 50


def test_schema_text_and_reports(tmp_path):
    ddl = "CREATE TABLE adt (hospitalization_id VARCHAR(20), in_dttm DATETIME, n INT, x DECIMAL(8,2), PRIMARY KEY (n)); create table `b` (v FLOAT);"
    s = sinks.ddl_schemas(ddl)
    assert s["adt"].simpleString() == "struct<hospitalization_id:string,in_dttm:timestamp,n:int,x:double>" and s["b"].simpleString() == "struct<v:float>"
    assert sinks.json_sha256({"a": 1, "b": 2}) == sinks.json_sha256({"b": 2, "a": 1})
    assert sinks.write_report({"n": "<10"}, f"{tmp_path}/r.json", ["P1"]) and (tmp_path / "r.json").read_text() == '{"n":"<10"}'
    with pytest.raises(ValueError):
        sinks.write_report({"id": "P1"}, f"{tmp_path}/r.json", ["P1"])
    assert sinks.guard_destination(f"{tmp_path}/x", "aggregate", {"aggregate": [str(tmp_path)]})
    with pytest.raises(PermissionError):
        sinks.guard_destination("/elsewhere", "aggregate", {"aggregate": [str(tmp_path)]})


def test_binding(spark):
    df = spark.range(3).withColumn("b", sinks.binding(vocab="1"))
    assert sinks.check_binding(df, "b", vocab="1").count() == 3
    with pytest.raises(ValueError):
        sinks.check_binding(df, "b", vocab="2")
    assert tables.manifest(df.select("id"), ["id"]) == tables.manifest(df.select("id").orderBy("id", ascending=False), ["id"])


def test_doses():
    assert doses.dose_plan("mcg/kg/min", "mcg/min") == (1.0, 1, "ok") and doses.dose_plan("mg/hr", "mcg/kg/min") == (pytest.approx(1000 / 60), -1, "ok")
    assert doses.dose_plan("units/hr", "mcg/min")[2] == "other_kind" and doses.dose_plan("mcg", "mcg/min")[2] == "other_rate" and doses.dose_plan(None, "mcg")[2] == "unknown_unit"
    assert doses.dimensions("mg / kg / hr.") == ({"mass": 1, "weight": -1, "time": -1}, pytest.approx(1000 / 60)) and doses.dimensions("Units/hr") == ({"units": 1, "time": -1}, pytest.approx(1 / 60))
    assert [doses.dimensions(x) for x in ("", "furlong", "hr", "kg/min", "mg/kg/kg", "mg/hr/min", "mg/ml", "mcg/min/furlong")] == [None] * 8


def test_pack(spark):
    df = spark.createDataFrame([(i, (i * 7) % 30 + 1) for i in range(200)] + [(999, 100)], "k int, n int")
    rows = encode.pack(df, "k", "n", 64, 3).collect()
    fill = {}
    for r in rows:
        fill.setdefault((r.group, r.pack), []).append(r.n)
    assert len(rows) == 201 and all(sum(v) <= 64 or v == [100] for v in fill.values())
    assert sum(sum(v) for v in fill.values()) / (64 * len(fill)) > 0.85


def test_encode_windows_equals_whole_sequences(spark):
    rows = [("a", i % 7, f"t{i % 5}", float(i)) for i in range(23)] + [("b", 1, "t1", 0.0), ("c", 2, "new", None)]
    ev = spark.createDataFrame(rows, "h string, at int, token string, v double")
    vocab = encode.vocabulary(ev.where("token <> 'new'"), "token", "h")
    whole = encode.encode(ev, vocab, "h", ["at", "token", "v"], ["v"])
    want = {(r.h, r.continuation_index): (r.token, r.v, r.source_start, r.source_end, r.continues_to_next) for r in encode.windows(whole, ["token", "v"], 5).collect()}
    got = {(r.h, r.continuation_index): (r.token, r.v, r.source_start, r.source_end, r.continues_to_next) for r in encode.encode_windows(ev, vocab, "h", ["at", "token", "v"], ["v"], 5).collect()}
    assert got == want and len(got) == 7
    framed = {(r.h, r.continuation_index): r.token for r in encode.encode_windows(ev, vocab, "h", ["at"], [], 9, framed=True).collect()}
    assert framed["c", 0] == [1, 3, 2] and len(framed["a", 2]) == 7
    assert encode.encode_windows(ev.limit(0), vocab, "h", ["at"], [], 5, framed=True).count() == 0


def test_suppression_and_logs(tmp_path):
    cells = {"a": 4, "b": 20, "c": 30, "t": 54}
    assert disclosure.fixpoint(cells, [("a", "b", "c", "t")]) == {"a", "b"}
    assert disclosure.fixpoint({"a": 40, "b": 20}, [("a", "b")]) == set()
    key, log = b"k", str(tmp_path / "log")
    for i in range(3):
        disclosure.append_log(log, {"i": i}, key)
    assert disclosure.verify_log(log, key) and not disclosure.verify_log(log, b"other")
    text = (tmp_path / "log").read_text()
    (tmp_path / "log").write_text(text.replace('"i": 1', '"i": 7'))
    assert not disclosure.verify_log(log, key)


def test_windows_on_empty_and_nulls(spark):
    df = spark.createDataFrame([], "k string, m bigint, v double")
    assert windows.trailing_rise(df, ["k"], "m", "v", absolute=1, absolute_minutes=5, relative=2, relative_minutes=9).count() == 0
    one = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, 2.5)], "k string, m bigint, v double")
    assert [r.risen for r in windows.trailing_rise(one, ["k"], "m", "v", absolute=1, absolute_minutes=5, relative=9, relative_minutes=9).orderBy("m").collect()] == [False, False, True]
