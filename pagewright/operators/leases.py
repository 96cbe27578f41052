"""Replay of page leases: what each claim, commit, expiry and loss of a node would have led to."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from heapq import heappop, heappush

from pyspark.sql import DataFrame, functions as F

from .groups import folded, in_order

MOST_COPIES = 2
LEAST_AGE_MS = 2500
UNMEASURED_MS, SLOWEST_MS = 4000, 60_000
BATCH_SECONDS, MOST_BATCH = 8, 16


@dataclass(frozen=True)
class Policy:
    per_page_ms: int = 20_000
    floor_ms: int = 60_000
    cap_ms: int = 300_000
    tail: int = 4  # undone pages from which copies are given out
    stale_copies: bool = True
    ahead: int = 0  # pages that a full node may hold besides
    nodes: int = 1  # expected nodes, for small batches at the end
    fixed_batch: int = 0
    deferred: bool = False  # pages queue only once they are admitted


@dataclass(eq=False)
class Lease:
    batch: int
    node: object
    pages: list[int]
    created: int
    until: int
    copy: bool


@dataclass
class Book:
    """One job's pages: queued, leased and done. All times are milliseconds of the events themselves."""

    total: int
    policy: Policy = Policy()
    queue: deque = field(default_factory=deque)
    queued: set[int] = field(default_factory=set)
    leases: dict[int, Lease] = field(default_factory=dict)
    by_page: dict[int, list[Lease]] = field(default_factory=dict)  # undone pages' leases, oldest first
    by_node: dict = field(default_factory=dict)  # node -> {batch: lease}
    held: dict = field(default_factory=dict)  # node -> undone pages under lease, repeats included
    ends: list = field(default_factory=list)  # heap of (until, batch)
    done: set[int] = field(default_factory=set)
    pace: dict = field(default_factory=dict)  # node -> [pages, seconds, batch measured last]
    capacity: dict = field(default_factory=dict)
    batches: int = 0

    def __post_init__(self):
        self.unseen = set(range(1, self.total + 1))  # pages of which it isn't known yet whether they queue
        if not self.policy.deferred:
            for p in range(1, self.total + 1):
                self.admit(p)

    def _idle(self, page: int) -> bool:
        """A page of the job that is neither done nor queued nor leased."""
        return 1 <= page <= self.total and page not in self.done and page not in self.queued and not self.by_page.get(page)

    def admit(self, page: int) -> bool:
        if not self._idle(page):
            return False
        self.queue.append(page)
        self.queued.add(page)
        self.unseen.discard(page)
        return True

    def finish(self, page: int) -> bool:
        """Done without a lease, as for a page whose text layer is used."""
        if not self._idle(page):
            return False
        self.done.add(page)
        self.unseen.discard(page)
        return True

    def seal(self) -> list[int]:
        """Ends the admission; pages still unseen no longer count as work to come."""
        rest = sorted(self.unseen)
        self.unseen.clear()
        return rest

    def holders(self, page: int) -> list[Lease]:
        return self.by_page.get(page, [])

    def in_flight(self, node) -> int:
        return self.held.get(node, 0)

    def page_ms(self, node) -> float:
        pages, seconds, _ = self.pace.get(node, (0, 0, None))
        if not pages or seconds <= 0:
            return UNMEASURED_MS
        return SLOWEST_MS if pages / seconds <= 0.01 else 1000 * seconds / pages

    def batch_size(self, node, capacity: int) -> int:
        if self.policy.fixed_batch:
            return min(max(self.policy.fixed_batch, 1), 64)
        most = min(max(capacity, 1), MOST_BATCH)
        pages, seconds, _ = self.pace.get(node, (0, 0, None))
        return min(most, max(1, round(BATCH_SECONDS * pages / seconds))) if pages and seconds > 0 else min(most, 2)

    def reap(self, now: int) -> list[int]:
        """Ends leases past their time; their pages that are neither done nor leased elsewhere queue again."""
        over = []
        while self.ends and self.ends[0][0] <= now:
            batch = heappop(self.ends)[1]
            if batch in self.leases:
                over.append(batch)
        return [p for b in sorted(over) for p in self.release(b)]

    def release(self, batch: int) -> list[int]:
        lease, back = self.leases.pop(batch), []
        self.by_node[lease.node].pop(batch)
        for p in sorted(lease.pages):
            if p in self.done:
                continue
            self.by_page[p].remove(lease)
            self.held[lease.node] -= 1
            if self.admit(p):
                back.append(p)
        return back

    def drop(self, node) -> list[int]:
        return [p for b in list(self.by_node.get(node, ())) for p in self.release(b)]

    def takeover(self, node) -> list[int]:
        return [p for b in [b for b, x in self.leases.items() if x.node != node] for p in self.release(b)]

    def claim(self, node, capacity: int, now: int, most: int = 0, blocker: int | None = None) -> tuple[str, Lease | None]:
        self.reap(now)
        self.capacity[node] = capacity
        if len(self.done) == self.total:
            return "done", None
        held = self.in_flight(node)
        room = max(0, capacity - held) or (max(0, capacity + self.policy.ahead - held) if held and self.policy.ahead else 0)
        if not room:
            return "wait", None
        if blocker is not None and self._blocks(node, blocker, now):
            return "batch", self._lease(node, [blocker], True, now)
        want = min(room, self.batch_size(node, capacity), most or room)
        if self.queue:
            few = len(self.queue) + len(self.unseen)
            want = 1 if few <= self.policy.nodes else min(want, 2) if few <= 2 * self.policy.nodes else want
            return "batch", self._lease(node, [self._next() for _ in range(min(max(want, 1), len(self.queue)))], False, now)
        tail = self.total - len(self.done) <= self.policy.tail
        copies = self._copies(node, max(want, 1), now, stale_only=not tail) if tail or self.policy.stale_copies else []
        return ("batch", self._lease(node, copies, True, now)) if copies else ("wait", None)

    def _next(self) -> int:
        page = self.queue.popleft()
        self.queued.discard(page)
        return page

    def _lease(self, node, pages: list[int], copy: bool, now: int) -> Lease:
        p = self.policy
        self.batches += 1
        lease = Lease(self.batches, node, pages, now, now + min(max(p.floor_ms, len(pages) * p.per_page_ms), p.cap_ms), copy)
        self.leases[lease.batch] = lease
        self.by_node.setdefault(node, {})[lease.batch] = lease
        heappush(self.ends, (lease.until, lease.batch))
        for page in pages:
            self.by_page.setdefault(page, []).append(lease)
        self.held[node] = self.in_flight(node) + len(pages)
        return lease

    def _blocks(self, node, page: int, now: int) -> bool:
        """Whether others wait for a page that its owner has had too long."""
        held = self.holders(page)
        owner = next((x for x in held if not x.copy), None)
        if page in self.done or owner is None or len(held) >= MOST_COPIES or any(x.node == node for x in held):
            return False
        return now - owner.created >= max(LEAST_AGE_MS, 2 * self.page_ms(owner.node))

    def _stale(self, lease: Lease, now: int) -> bool:
        rest = sum(p not in self.done for p in lease.pages)
        waves = -(-rest // max(1, self.capacity.get(lease.node, 1)))
        return rest > 0 and now - lease.created >= max(LEAST_AGE_MS, 0.6 * waves * self.page_ms(lease.node))

    def _copies(self, node, want: int, now: int, stale_only: bool) -> list[int]:
        """Undone pages of others' oldest leases that have no copy yet."""
        out: list[int] = []
        for lease in sorted((x for x in self.leases.values() if not x.copy and x.node != node), key=lambda x: (x.created, x.batch)):
            if stale_only and not self._stale(lease, now):
                continue
            for p in sorted(lease.pages):
                held = self.holders(p)
                if len(out) < want and p not in self.done and p not in out and len(held) < MOST_COPIES and all(x.node != node for x in held):
                    out.append(p)
        return out

    def commit(self, node, page: int, now: int) -> bool:
        """The first commit of a page by a node whose lease holds it; later ones are refused."""
        lease = next((x for x in self.holders(page) if x.node == node), None)
        if lease is None or page in self.done:
            return False
        self.done.add(page)
        held = self.by_page.pop(page)
        for x in held:
            self.held[x.node] -= 1
        pace = self.pace.setdefault(node, [0, 0.0, None])
        pace[0] += 1
        if pace[2] != lease.batch:
            pace[1] += max(0.05, (now - lease.created) / 1000)
            pace[2] = lease.batch
        for x in held:
            if all(p in self.done for p in x.pages):
                del self.leases[x.batch], self.by_node[x.node][x.batch]
        return True


class _Replay:
    def __init__(self, job, policy: Policy):
        self.job, self.policy, self.book = job, policy, None

    def add(self, row: dict):
        if self.book is None:
            self.book = Book(row["total"], self.policy)
        book, node, now, kind = self.book, row["node"], row["ms"], row["kind"]
        out = {"job": self.job, "seq": row["seq"], "outcome": None, "batch": None, "pages": [], "lease_ms": None, "copy": None}
        if kind == "claim":
            outcome, lease = book.claim(node, row["capacity"], now, blocker=row["blocker"])
            out |= {"outcome": outcome} | ({"batch": lease.batch, "pages": sorted(lease.pages), "lease_ms": lease.until - lease.created, "copy": lease.copy} if lease else {})
        elif kind in ("admit", "finish"):
            good = book.admit(row["page"]) if kind == "admit" else book.finish(row["page"])
            out |= {"outcome": {"admit": "admitted", "finish": "finished"}[kind] if good else "refused", "pages": [row["page"]]}
        elif kind == "seal":
            out |= {"outcome": "sealed", "pages": book.seal()}
        elif kind == "commit":
            book.reap(now)
            out |= {"outcome": "accepted" if book.commit(node, row["page"], now) else "refused", "pages": [row["page"]]}
        else:
            back = {"drop": lambda: book.drop(node), "takeover": lambda: book.takeover(node)}.get(kind, lambda: book.reap(now))()
            out |= {"outcome": "returned", "pages": back}
        yield out

    def end(self):
        return []


def replay(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(job, seq, outcome, batch, pages, lease_ms, copy) per event (job, seq, ts, node, kind, page, capacity, total, blocker).

    kind is claim, commit, reap, drop, takeover, admit, finish or seal; the last three are for a policy that
    is deferred, where pages queue once they are admitted. A job's events stream through its task in order of ts
    and seq; only the job's own pages are held.
    """
    kinds = dict(events.dtypes)
    e = events.select(
        "job", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"), "node", "kind", F.col("page").cast("int").alias("page"),
        F.col("capacity").cast("int").alias("capacity"), F.col("total").cast("int").alias("total"), F.col("blocker").cast("int").alias("blocker"),
    )
    schema = f"job {kinds['job']}, seq {kinds['seq']}, outcome string, batch int, pages array<int>, lease_ms long, copy boolean"
    return folded(in_order(e, "job", "ms", "seq"), lambda job: _Replay(job, policy), schema)
