"""Walks over events in slices against plain loops, with ties, null keys and slices without events."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from pagewright.operators import schedule
from pagewright.plans import catalog


def events(seed, n=400):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(r.choice(["a", "b", None]), start + timedelta(milliseconds=r.choice([0, 500, 90_000]) * r.randint(0, 60)), k, r.choice(["heartbeat", "ok", "fail", "fail", "fail", "other"]), r.choice([True, True, False, None])) for k in range(n)]
    r.shuffle(rows)
    return rows


SCHEMA = "node string, ts timestamp, seq int, kind string, up boolean"


def alive(rows, fresh_ms):
    out, state = [], {}
    for node, ts, seq, kind, up in sorted(rows, key=lambda x: (x[1], x[2])):
        s = state.setdefault(node, {"fails": 0, "beat": None, "healthy": True})
        if kind == "heartbeat":
            s |= {"fails": 0, "beat": ts, "healthy": up is not False}
        elif kind == "ok":
            s |= {"fails": 0, "healthy": True}
        elif kind == "fail":
            s["fails"] += 1
        fresh = s["beat"] is not None and ts - s["beat"] <= timedelta(milliseconds=fresh_ms)
        if s["fails"] >= 2 and not fresh:
            s["healthy"] = False
        out.append((seq, s["fails"], s["healthy"]))
    return sorted(out)


@pytest.mark.parametrize("slice_s", [1, 60, 3600])
def test_liveness_with_fresh_heartbeats(spark, slice_s):
    rows = events(slice_s)
    got = schedule.liveness(spark.createDataFrame(rows, SCHEMA), fresh_ms=120_000, slice_s=slice_s).select("seq", "missed", "healthy")
    assert sorted(map(tuple, got.collect())) == alive(rows, 120_000)


def test_two_failures_after_a_heartbeat_leave_a_node_healthy(spark):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    rows = [("n", at(0), 1, "heartbeat", True), ("n", at(1000), 2, "fail", None), ("n", at(1001), 3, "fail", None), ("n", at(20_000), 4, "fail", None)]
    got = schedule.liveness(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r["missed"], r["healthy"]) for r in got] == [(0, True), (1, True), (2, True), (3, False)]
    assert schedule.liveness(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("slice_s, within", [(1, None), (60, 100_000), (3600, 0)])
def test_as_of(spark, slice_s, within):
    rows = events(slice_s + 7)
    probes, beats = ([x for x in rows if (x[3] == "heartbeat") == b] for b in (False, True))
    want = []
    for node, ts, seq, *_ in probes:
        before = [(b[1], b[2]) for b in beats if b[0] == node and (b[1], b[2]) <= (ts, seq)]
        best = max(before, default=None)
        want.append((seq, best[1] if best and (within is None or ts - best[0] <= timedelta(milliseconds=within)) else None))
    got = schedule.as_of(spark.createDataFrame(probes, SCHEMA), spark.createDataFrame(beats, SCHEMA), "node", within, slice_s)
    assert sorted(map(tuple, got.select("seq", "mark.seq").collect())) == sorted(want)
    assert got.columns == ["node", "ts", "seq", "kind", "up", "mark"]


def test_failures_are_counted_over_slices(spark):
    rows = events(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("node", "group_id")
    got = schedule.attempts(df, most=5, slice_s=30).select("seq", "failures", "gave_up").collect()
    n, want = {}, []
    for group, ts, seq, kind, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        n[group] = n.get(group, 0) + (kind == "fail")
        want.append((seq, n[group], n[group] >= 5))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("slice_s, within", [(1, None), (60, 100_000), (3600, 0)])
def test_as_of_by_time_alone(spark, slice_s, within):
    """A mark of a row's own moment counts though its seq is larger; a row without a time stays, and a mark without one is none."""
    rows = events(slice_s + 7) + [("a", None, k, "heartbeat" if k % 2 else "fail", True) for k in range(400, 404)]
    probes, beats = ([x for x in rows if (x[3] == "heartbeat") == b] for b in (False, True))
    want = []
    for node, ts, seq, *_ in probes:
        before = [(b[1], b[2]) for b in beats if b[0] == node and ts and b[1] and b[1] <= ts]
        best = max(before, default=None)
        want.append((seq, best[1] if best and (within is None or ts - best[0] <= timedelta(milliseconds=within)) else None))
    got = schedule.as_of(spark.createDataFrame(probes, SCHEMA), spark.createDataFrame(beats, SCHEMA), "node", within, slice_s, by_ts=True)
    assert sorted(map(tuple, got.select("seq", "mark.seq").collect())) == sorted(want)
    assert any(s < m for s, m in want if m is not None)


def test_as_of_heartbeat_equals_its_sql_where_moments_repeat(spark, tmp_path):
    """One heartbeat a moment and node, so that the SQL leaves nothing open; probes of that moment come before and after it."""
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=10 * k)
    rows = [(5 * k + j, at(k), k % 2) for k in range(40) for j in (0, 1, 3, 4)]  # of each five one heartbeat
    rows += [(1001, at(3), None), (1000, at(2), None), (1006, None, 1), (1005, None, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").selectExpr("*", "1D AS value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["as_of_heartbeat"](spark, str(tmp_path)).select("seq", "heartbeat").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.SQL["as_of_heartbeat"]).fetchall())
