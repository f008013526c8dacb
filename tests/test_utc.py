"""Wall-clock times in the hours that zones repeat or skip."""

import datetime as dt
from zoneinfo import ZoneInfo

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from eventide import catalog

ZONES = {"A": "America/New_York", "B": "America/Phoenix", "C": "Australia/Lord_Howe"}


def test_every_discharge_has_a_row(spark, tmp_path):
    days = [(2024, 11, 3), (2024, 11, 5), (2024, 3, 10), (2024, 4, 7), (2024, 10, 6), (2024, 7, 1)]
    walls = [dt.datetime(*day, h, m) for day in days for h in range(4) for m in (0, 15, 45)]
    rows = [(f"h{i}{s}", s, w) for i, w in enumerate(walls) for s in ZONES] + [("none", "A", None)]
    h, s, t = zip(*rows)
    pq.write_table(pa.table({"hospitalization_id": h, "hospital_id": s, "discharge_dttm": pa.array(t, pa.timestamp("us", "UTC"))}), f"{tmp_path}/hospitalization.parquet")
    pq.write_table(pa.table({"hospital_id": list(ZONES), "timezone": list(ZONES.values())}), f"{tmp_path}/hospital_sites.parquet")
    want = {}
    for h, s, wall in rows[:-1]:
        utc = wall.replace(tzinfo=ZoneInfo(ZONES[s]), fold=0).astimezone(dt.UTC)
        want[h] = int(utc.timestamp()) * 1_000_000 if utc.astimezone(ZoneInfo(ZONES[s])).replace(tzinfo=None) == wall else None
    got = catalog.queries()["prj_12_to_utc"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.hospitalization_id: r.utc_us for r in got} == want
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in ("hospitalization", "hospital_sites"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    sql = con.execute("select hospitalization_id, utc_us from (" + catalog.oracle_sql()["prj_12_to_utc"] + ")").fetchall()
    assert len(sql) == len(want) and dict(sql) == want
