"""Streams that end, expire and wait by event time."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from pagewright.streaming import leases, pages as ps, play

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def arrivals(spark, rows, schema, folder, batches):
    """rows as files in the order given; a stream of so many batches."""
    each = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * each : (k + 1) * each], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return play.table_stream(spark, f"{folder}/in", files_each=1)


def again(events, lease, until):
    """When pages are queued again, from the definition."""
    out = []
    for job, page in {(e[0], e[1]) for e in events}:
        mine = [e for e in events if e[:2] == (job, page)]
        claims = [(t, n) for _, _, n, t, k in mine if k == "claim"]
        good = [t for _, _, n, t, k in mine if k == "commit" and any(n == m and c <= t < c + lease for c, m in claims)]
        for end in {c + lease for c, _ in claims}:
            if end <= until and not any(c <= end < c + lease for c, _ in claims) and not any(t <= end for t in good):
                out.append((job, page, end))
    return sorted(out)


@pytest.mark.parametrize("order", ["in time", "backwards", "mixed"])
def test_requeues_in_any_order_of_arrival(spark, tmp_path, order):
    r = random.Random(2)
    events = [(1, r.randint(1, 12), r.randint(1, 3), r.randint(0, 280), r.choice(["claim", "claim", "commit", "fail"])) for _ in range(120)]
    events.sort(key=lambda e: e[3])
    if order == "backwards":
        events.reverse()
    elif order == "mixed":
        r.shuffle(events)
    last = [(9, 9, 9, 2000, "claim")]  # brings the watermark to 1700
    rows = [(j, p, n, at(t), k) for j, p, n, t, k in events + last]
    stream = arrivals(spark, rows, "job long, page int, node long, ts timestamp, kind string", tmp_path, 3)
    got = play.played(leases.requeues(stream, 20_000, "300 seconds"), "requeues").collect()
    base = int(START.timestamp() * 1000)
    want = again([(j, p, n, t * 1000, k) for j, p, n, t, k in events], 20_000, 1_700_000)
    assert len(want) > 10
    assert sorted((x["job"], x["page"], x["at_ms"] - base) for x in got) == want


def test_a_page_has_few_timers(spark, tmp_path):
    """Not one a claim; with claims of no node, events without a time, and a deadline that the watermark just reaches."""
    r = random.Random(3)
    events = [(1, r.randint(1, 12), r.choice([*range(1, 20), None]), r.randint(0, 1400), r.choice(["claim", "claim", "commit"])) for _ in range(600)] + [(2, 1, 1, 1680, "claim")]
    rows = [(j, p, n, at(t), k) for j, p, n, t, k in events] + [(1, 1, 1, None, "claim"), (1, 1, 1, None, "commit"), (9, 9, 9, at(2000), "claim")]  # the watermark: 1700
    r.shuffle(rows)
    stream = arrivals(spark, rows, "job long, page int, node long, ts timestamp, kind string", tmp_path, 1)
    with play.settings(spark, spark__sql__streaming__stateStore__providerClass=play.ROCKS):
        query = leases.requeues(stream, 20_000, "300 seconds").writeStream.format("memory").queryName("few_timers").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
        query.processAllAvailable()
        timers = sum(o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"])
        query.stop()
    base = int(START.timestamp() * 1000)
    named = [(j, p, n or -k, t * 1000, kind) for k, (j, p, n, t, kind) in enumerate(events, 1) if n or kind == "claim"]  # each claim of no node has its own
    want = again(named, 20_000, 1_700_000)
    assert (2, 1, 1_700_000) in want and len(want) > 10
    assert sorted((x["job"], x["page"], x["at_ms"] - base) for x in spark.sql("SELECT * FROM few_timers").collect()) == want
    assert 0 < timers <= 3 * 14  # of 14 pages


@pytest.mark.parametrize("marks", [[200], [4, 5, 30, 104, 105, 200], list(range(0, 201, 7)) + [200]])
def test_a_commit_is_forgotten(marks):
    """Whatever the steps of the watermark: a page committed at 5 is known up to 105, then its claims count again."""
    events = np.array([(0, 1, True, True), (5, 1, True, False), (50, 2, True, True), (95, 1, True, True), (96, 3, True, True), (110, 3, True, False), (130, 1, True, True)], leases.EVENT)
    done, left, ends = None, events, []
    for now in marks:
        more, done, left = leases.swept(left, done, now, 10, 100)
        ends += more.tolist()
    assert ends == [106, 140] and done is None and not len(left)


def test_a_document_ends_by_time(spark, tmp_path):
    """Gaps become blank, late pages are told, and nothing stays in state."""
    schema = "doc_id long, page int, text string, at timestamp"
    batches = [
        [(1, 2, "two", at(0)), (1, 1, "one", at(1)), (1, 5, "five", at(2)), (2, 1, "solo", at(2))],
        [(3, 1, "tick", at(100))],
        [(3, 2, "tock", at(101))],  # the seal of 1 and 2 has been told
        [(1, 3, "late", at(150))],
        [(4, 1, "far", at(9000))],
        [(4, 2, "farther", at(20_000))],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ps.sealed_groups(play.table_stream(spark, f"{tmp_path}/in", files_each=1), 2, 1000, 10_000, 500_000, "5 seconds")
    with play.settings(spark, spark__sql__streaming__stateStore__providerClass=play.ROCKS):
        query = stream.writeStream.format("memory").queryName("by_time").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
        query.processAllAvailable()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
    rows = spark.sql("SELECT * FROM by_time").collect()
    good = sorted((r["doc_id"], r["group_no"], r["pages"], r["head"]) for r in rows if r["error"] is None)
    assert good == [(1, 0, [1, 2], "five"), (1, 1, [5], None), (2, 0, [1], None), (3, 0, [1, 2], None)]
    assert [(r["doc_id"], r["pages"], r["error"]) for r in rows if r["error"]] == [(1, [3], "document is sealed")]
    assert held <= 6  # of document 4, which is open


def test_admission_equals_the_join_of_tables(spark, tmp_path):
    r = random.Random(7)
    pages = [(1, k, at(k)) for k in range(60)] + [(9, 9, at(5000))]
    classes = [(1, k, at(k + r.choice([0, 3, 30, 31])), bool(k % 2)) for k in range(60) if k % 4] + [(9, 9, at(5000), True)]
    p, c = "doc_id long, page int, at timestamp", "doc_id long, page int, at timestamp, use_layer boolean"
    r.shuffle(pages)
    r.shuffle(classes)
    whole = leases.admitted(spark.createDataFrame(pages, p), spark.createDataFrame(classes, c), "30 seconds")
    made = leases.admitted(arrivals(spark, sorted(pages, key=lambda x: x[0]), p, tmp_path / "p", 2), arrivals(spark, sorted(classes, key=lambda x: x[0]), c, tmp_path / "c", 2), "30 seconds", "10 minutes")
    got = play.played(made, "admitted").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect()))
    assert sum(x["use_layer"] is None for x in got) > 15
