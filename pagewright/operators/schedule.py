"""Leases, retries, liveness and throughput from tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .groups import folded, in_order

MOST_ATTEMPTS = 8


def _micros(at: Column) -> Column:
    """Of a timestamp with or without a zone."""
    return F.unix_micros(at.cast("timestamp"))


def _slice(width_s: int) -> Column:
    return F.floor(_micros(F.col("ts")) / (width_s * 1_000_000))


def _walked(events: DataFrame, key: str, slice_s: int, inside: dict, change: Column, carry, of_inside: bool = False, along: dict | None = None) -> DataFrame:
    """events with inside, running values by (ts, seq) within a key's slice, and __before, what carry() makes of change of its earlier slices.

    inside has functions of a window. A slice is slice_s seconds of a key, walked by one task beside the key's
    others. Rows move once, to their slice; one row a slice, summed where the rows lie, meets them there.
    With of_inside, change is of the running values; along has values of earlier changes that carry() uses.
    """
    e = raw = events.withColumns({"__of": F.struct(key), "__slice": _slice(slice_s)})  # a struct, so that null keys meet
    w = W.partitionBy("__of", "__slice").orderBy("ts", "seq")
    for name, value in inside.items():
        e = e.withColumn(name, value(w))
    per = (e if of_inside else raw).groupBy(F.col("__of").alias("__o"), F.col("__slice").alias("__s")).agg(change.alias("__change"))
    earlier = W.partitionBy("__o").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    for name, value in (along or {}).items():
        per = per.withColumn(name, value(earlier))
    per = per.select("__o", "__s", carry(earlier).alias("__before"))
    return e.join(per, (F.col("__of") == F.col("__o")) & (F.col("__slice") == F.col("__s"))).drop("__of", "__slice", "__o", "__s")


def _sum_before(w) -> Column:
    return F.coalesce(F.sum("__change").over(w), F.lit(0))


SLICE_S = 3600  # seconds of events of a key that one task walks


def lease_ms(pages: Column, per_page: Column, floor: Column, cap: Column) -> Column:
    return F.least(F.greatest(floor, pages * per_page), cap)


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(2000), (200 * F.pow(F.lit(2), F.least(attempt - 1, F.lit(4)))).cast("int"))


def retry_kind(status: Column, parsed: Column) -> Column:
    """What follows a reply: done, correct (it can't be read), disable-key, retry or fail."""
    return (
        F.when(status.isNull(), "retry").when(status == 401, "disable-key").when(status.isin(403, 408, 429) | (status >= 500), "retry")
        .when(status >= 400, "fail").when(parsed, "done").otherwise("correct")
    )


def first_commits(events: DataFrame) -> DataFrame:
    """(job, page, node, ts): the first commit of each page; later ones are refused."""
    return events.filter("kind = 'commit'").groupBy("job", "page").agg(F.min(F.struct("ts", "seq", "node")).alias("f")).select("job", "page", "f.node", "f.ts")


def commit_verdicts(events: DataFrame) -> DataFrame:
    """Commits with accepted: the page's first one by a node that had claimed it before."""
    claims = events.filter("kind = 'claim'").groupBy(F.col("job").alias("j"), F.col("page").alias("p"), F.col("node").alias("n")).agg(F.min(F.struct("ts", "seq")).alias("claimed"))
    c = events.filter("kind = 'commit'").join(claims, (F.col("job") == F.col("j")) & (F.col("page") == F.col("p")) & (F.col("node") == F.col("n")), "left")
    live = F.coalesce(F.struct("ts", "seq") > F.col("claimed"), F.lit(False))
    good = F.min(F.when(live, F.struct("ts", "seq"))).over(W.partitionBy("job", "page"))
    return c.withColumn("accepted", F.coalesce(live & (F.struct("ts", "seq") == good), F.lit(False))).drop("j", "p", "n", "claimed")


def expired(leases: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Leased pages (job, page, created, lease_ms) past their time and not done."""
    late = _micros(F.col("created")) + F.col("lease_ms") * 1000 <= _micros(now)
    return leases.filter(late).join(done.select("job", "page").distinct(), ["job", "page"], "left_anti")


def speculative(leases: DataFrame, done: DataFrame, tail: int, copies: int = 2) -> DataFrame:
    """Pages worth a second copy: not done, fewer than copies holders, the oldest tail of a job by first lease, then page."""
    held = leases.join(done.select("job", "page").distinct(), ["job", "page"], "left_anti").groupBy("job", "page").agg(F.min("created").alias("created"), F.count_distinct("node").alias("holders"))
    order = W.partitionBy("job").orderBy("created", "page")
    return held.filter(F.col("holders") < copies).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= tail)


def snapshot(pages: DataFrame) -> DataFrame:
    """(job, done, leased, pending) of page states."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return pages.groupBy("job").agg(n("done"), n("leased"), n("pending"))


def earliest_missing(totals: DataFrame, done: DataFrame) -> DataFrame:
    """(job, missing): the first page of 1..total that isn't done, null if all are.

    With page 1 done it follows the least done page whose next one isn't. Pages meet their next ones by job and
    page, so the pages of a large job are shared out.
    """
    gone = done.select(F.col("job").alias("of"), F.col("page").cast("int").alias("page")).filter("page >= 1").distinct()
    after = gone.select(F.col("of").alias("same"), (F.col("page") - 1).alias("before"))
    ends = gone.join(after, (F.col("of") == F.col("same")) & (F.col("page") == F.col("before")), "left_anti").groupBy("of").agg(F.min("page").alias("end"))
    begun = gone.filter("page = 1").select(F.col("of").alias("begun"))
    run = ends.join(begun, F.col("of") == F.col("begun"), "left_semi")
    first = (F.coalesce(F.col("end"), F.lit(0)) + 1).cast("int")
    return totals.join(run, F.col("job") == F.col("of"), "left").select("job", F.when(first <= F.col("total"), first).alias("missing"))


def node_rates(commits: DataFrame) -> DataFrame:
    """(node, pages, seconds, pages_per_s, batch): seconds from first to last; the next batch is eight seconds' work, 1 to 16, and 2 while unmeasured."""
    n = commits.groupBy("node").agg(F.count("*").alias("pages"), ((_micros(F.max("ts")) - _micros(F.min("ts"))) / 1e6).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.round(F.col("pages") / F.col("seconds"), 6))
    n = n.withColumn("pages_per_s", rate)
    return n.withColumn("batch", F.coalesce(F.least(F.greatest(F.bround(F.col("pages_per_s") * 8), F.lit(1)), F.lit(16)), F.lit(2)).cast("int"))


def node_list(commits: DataFrame) -> DataFrame:
    """(job, nodes): 'node=n' by node, comma-joined."""
    per = commits.groupBy("job", "node").agg(F.count("*").alias("n"))
    return per.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: F.concat_ws("=", x["node"], x["n"])), ", ").alias("nodes"))


def progress_bucket(done: Column, total: Column) -> Column:
    """Tenths of a job that are done, 0 to 10."""
    return F.when(total > 0, F.floor(done * 100 / total / 10)).otherwise(0).cast("int")


def progress_lines(events: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Running count of done pages with the rows where a new tenth begins. Slices of a job are counted side by side."""
    e = _walked(events, "job", slice_s, {"__nth": lambda w: F.row_number().over(w)}, F.count("*"), _sum_before)
    e = e.withColumn("done", (F.col("__before") + F.col("__nth")).cast("int")).withColumn("bucket", progress_bucket(F.col("done"), F.col("total")))
    first = F.when(F.col("done") > 1, progress_bucket(F.col("done") - 1, F.col("total"))).otherwise(0)  # the event before it has one done page fewer
    return e.filter((F.col("bucket") >= 1) & (F.col("bucket") > first) & (F.col("done") < F.col("total"))).drop("__before", "__nth")


def wall_span(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, sum_ms, wall_ms) of intervals (start_ms, stop_ms)."""
    return intervals.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("stop_ms") - F.col("start_ms")).alias("sum_ms"), (F.max("stop_ms") - F.min("start_ms")).alias("wall_ms"))


def peak_concurrency(intervals: DataFrame, *keys: str, width_ms: int = 3_600_000) -> DataFrame:
    """(keys, peak): most intervals open at once; one that ends where another begins does not overlap it.

    Changes are summed by moment, then walked within slices of width_ms side by side; each slice starts from
    the sum of the slices before it.
    """
    edge = intervals.select(*keys, F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop_ms").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    per = edge.groupBy(*keys, F.col("e.at").alias("at"), F.col("e.d").alias("d")).agg(F.sum("e.d").alias("change"))
    per = per.withColumn("slice", F.floor(F.col("at") / width_ms))
    inside = F.sum("change").over(W.partitionBy(*keys, "slice").orderBy("at", "d"))
    tops = per.withColumn("open", inside).groupBy(*keys, "slice").agg(F.max("open").alias("top"), F.sum("change").alias("change"))
    before = F.coalesce(F.sum("change").over(W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tops.withColumn("open", F.col("top") + before).groupBy(*keys).agg(F.max("open").alias("peak"))


def attempts(events: DataFrame, most: int = MOST_ATTEMPTS, slice_s: int = SLICE_S) -> DataFrame:
    """Events with failures so far in their group and gave_up once most are reached; takeovers don't count.

    Slices of a group are counted side by side, each from the sum of those before it.
    """
    failed = F.col("kind").isin("fail", "expire", "drop").cast("long")
    e = _walked(events, "group_id", slice_s, {"__within": lambda w: F.sum(failed).over(w)}, F.sum(failed), _sum_before)
    return e.withColumn("failures", (F.col("__before") + F.col("__within")).cast("long")).drop("__before", "__within").withColumn("gave_up", F.col("failures") >= most)


def same_failer(events: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Claims of a group by the node that failed it last, also in an earlier slice."""
    last = lambda w: F.last(F.when(F.col("kind") == "fail", F.col("node")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    who = F.max(F.when(F.col("kind") == "fail", F.struct("ts", "seq", "node")))
    e = _walked(events, "group_id", slice_s, {"__within": last}, who, lambda w: F.max("__change").over(w))
    return e.withColumn("failer", F.coalesce("__within", "__before.node")).drop("__before", "__within").filter("kind = 'claim' AND failer = node")


def as_of(rows: DataFrame, marks: DataFrame, key: str, within_ms: int | None = None, slice_s: int = SLICE_S, by_ts: bool = False) -> DataFrame:
    """rows (key, ts, seq, ...) with mark: the last of marks (key, ts, seq, ...) of the same key at or before them, by (ts, seq).

    null where there is none, or where it is more than within_ms older. With by_ts a mark of a row's own ts is before
    it whatever their seq, as for ASOF JOIN; of marks of one ts the last seq counts. mark is a struct of all columns of
    marks. Both sides are walked together in slices, each from the last mark before it, so that a key of any
    number of rows is shared out; null keys are one key. Rows without ts have no mark, and marks without it are none.
    """
    place = lambda row: F.struct(F.lit(row).alias("row"), F.col("seq").alias("seq")).alias("seq") if by_ts else F.col("seq")
    none = F.lit(None).cast(marks.schema).alias("mark")
    both = rows.filter("ts IS NOT NULL").select(F.struct("*").alias("row"), none, F.col(key).alias("key"), "ts", place(True))
    both = both.union(marks.filter("ts IS NOT NULL").select(F.lit(None).cast(rows.schema), F.struct("*"), key, "ts", place(False)))
    last = lambda w: F.last("mark", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    newest = F.max(F.when(F.col("mark").isNotNull(), F.struct("ts", "seq", "mark")))
    e = _walked(both, "key", slice_s, {"__within": last}, newest, lambda w: F.max("__change").over(w)).filter("row IS NOT NULL")
    mark = F.coalesce("__within", "__before.mark")
    if within_ms is not None:
        mark = F.when(_micros(F.col("ts")) - _micros(mark["ts"]) <= within_ms * 1000, mark)
    return e.select("row.*", mark.alias("mark")).union(rows.filter("ts IS NULL").select("*", none))


FRESH_MS = 15_000  # of a heartbeat


def liveness(events: DataFrame, misses: int = 2, fresh_ms: int = FRESH_MS, slice_s: int = SLICE_S) -> DataFrame:
    """Events (node, ts, seq, kind, up) with missed, failed probes since the last reset, and healthy.

    Kinds are heartbeat, ok and fail; other ones change nothing. A good probe makes a node healthy, a
    heartbeat what it says of itself in up (null: healthy); both start the count anew. misses failed probes
    make it unhealthy, but not while a heartbeat is at most fresh_ms old. A node of which nothing is known is
    healthy. Slices start from the last reset, the last heartbeat and the misses before them.
    """
    kind = F.col("kind")
    reset, beat = kind.isin("heartbeat", "ok"), kind == "heartbeat"
    up = F.when(beat, F.coalesce("up", F.lit(True))).otherwise(F.lit(True))
    first = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = {
        "__fails": lambda w: F.sum((kind == "fail").cast("long")).over(first(w)),
        "__gone": lambda w: F.max(F.when(reset, F.col("__fails"))).over(first(w)),  # failures up to the last reset
        "__beat": lambda w: F.max(F.when(beat, F.col("ts"))).over(first(w)),
        "__state": lambda w: F.last(F.when(reset, up), ignorenulls=True).over(first(w)),
    }
    change = F.struct(F.max("__fails").alias("fails"), F.max("__gone").alias("gone"), F.max("__beat").alias("beat"), F.max(F.when(reset, F.struct("ts", "seq", up.alias("up")))).alias("reset"))

    # failures up to each slice, and up to the last reset of it
    along = {"__so_far": lambda w: F.coalesce(F.sum("__change.fails").over(w), F.lit(0)), "__at_reset": lambda w: F.col("__so_far") + F.col("__change.gone")}
    before = lambda w: F.struct((F.col("__so_far") - F.coalesce(F.max("__at_reset").over(w), F.lit(0))).alias("fails"), F.max("__change.beat").over(w).alias("beat"), F.max("__change.reset").over(w).alias("reset"))
    e = _walked(events, "node", slice_s, inside, change, before, of_inside=True, along=along)
    missed = F.when(F.col("__gone").isNull(), F.col("__before.fails") + F.col("__fails")).otherwise(F.col("__fails") - F.col("__gone"))
    fresh = F.coalesce(_micros(F.col("ts")) - _micros(F.coalesce("__beat", "__before.beat")) <= fresh_ms * 1000, F.lit(False))
    was = F.coalesce("__state", "__before.reset.up", F.lit(True))
    e = e.withColumn("missed", missed.cast("long")).withColumn("healthy", was & ~((F.col("missed") >= misses) & ~fresh))
    return e.drop("__fails", "__gone", "__beat", "__state", "__before")


def room(nodes: DataFrame) -> DataFrame:
    """(job, has_room): the rest of a job is smaller than what its live nodes can take."""
    cap = F.sum(F.when(F.col("healthy"), F.greatest(F.col("capacity") - F.col("in_flight"), F.lit(0))).otherwise(0))
    return nodes.groupBy("job").agg((F.max("remaining") < cap).alias("has_room"))


def must_yield(nodes: DataFrame) -> DataFrame:
    """Nodes with yields: another active one with room has a strictly lower load; names and ties don't matter."""
    load = F.col("in_flight") / F.col("capacity")
    n = nodes.withColumn("load", load)
    open_ = F.col("active") & (F.col("in_flight") < F.col("capacity"))
    return n.withColumn("yields", F.coalesce(F.min(F.when(open_, F.col("load"))).over(W.partitionBy("job")) < F.col("load"), F.lit(False)))


def least_loaded(keys: DataFrame, cursor: Column) -> DataFrame:
    """(pool, key) that comes next: fewest in use, then the first from the cursor on."""
    n = F.count("*").over(W.partitionBy("pool"))
    order = W.partitionBy("pool").orderBy("in_use", "turn")
    k = keys.withColumn("turn", F.pmod(F.col("idx") - cursor, n))
    return k.withColumn("place", F.row_number().over(order)).filter("place = 1").select("pool", "key")


def node_compatibility(mode: tuple[Column, Column], model: tuple[Column, Column], dpi: tuple[Column, Column]) -> Column:
    """What differs between a node and its coordinator, joined by '; '; '' if nothing does."""
    return F.concat_ws("; ", F.when(F.lower(mode[0]) != F.lower(mode[1]), "mode differs"), F.when(model[0] != model[1], "model differs"), F.when(dpi[0] != dpi[1], "dpi differs"))


def dispatch(nodes: DataFrame, sessions: int = 2) -> DataFrame:
    """Nodes that get work now, in order: under the session cap, recognition first, names only where a node can and some wait."""
    kind = F.when(F.col("ocr_open"), "ocr").when(F.col("can_ner") & (F.col("ner_pending") > 0), "ner")
    n = nodes.withColumn("offer", kind).filter((F.col("sessions") < sessions) & F.col("offer").isNotNull())
    return n.withColumn("place", F.row_number().over(W.partitionBy("job").orderBy(F.when(F.col("offer") == "ocr", 0).otherwise(1), "in_flight", "node")))


def upserted(known: DataFrame, heard: DataFrame) -> DataFrame:
    """Nodes (node, pages, seen): what was heard of them replaces what was known, and the rest stays."""
    h = heard.select(F.col("node").alias("n"), F.col("pages").alias("p"), F.col("seen").alias("s"))
    j = known.join(h, F.col("node") == F.col("n"), "full")
    return j.select(F.coalesce("node", "n").alias("node"), F.coalesce("p", "pages").alias("pages"), F.greatest("s", "seen").alias("seen"))


class _Progress:
    def __init__(self, job):
        self.job, self.at, self.done, self.bucket = job, None, 0, 0

    def add(self, row):
        gap = None if self.at is None else row["ms"] - self.at
        bucket = row["done"] * 10 // row["total"] if row["total"] else 0
        new = row["done"] != self.done and row["done"] < row["total"] and (gap is None or gap >= 1000)
        if new and (gap is None or gap >= 3000 or bucket > max(self.bucket, 0)):
            self.at, self.done, self.bucket = row["ms"], row["done"], bucket
            yield {"job": self.job, "ms": row["ms"], "done": row["done"]}

    def end(self):
        return []


def progress_log(counts: DataFrame) -> DataFrame:
    """Rows of counts (job, ms, done, total) worth a line: changed, unfinished, a second after the last, and three seconds or a new tenth."""
    c = counts.select("job", F.col("ms").cast("long").alias("ms"), F.col("done").cast("int").alias("done"), F.col("total").cast("int").alias("total"))
    return folded(in_order(c, "job", "ms", "done"), _Progress, f"job {dict(counts.dtypes)['job']}, ms long, done int")
