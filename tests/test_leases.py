import random

from pagewright.operators.leases import Book, Policy, replay


def test_batches_grow_with_the_pace():
    b = Book(40)
    _, first = b.claim("a", 8, 0)
    assert first.pages == [1, 2] and first.until == 60_000
    assert b.commit("a", 1, 1000) and b.commit("a", 2, 1000) and not b.commit("a", 2, 1100)
    assert len(b.claim("a", 8, 1000)[1].pages) == 8  # two pages a second


def test_expiry_gives_pages_back_and_late_commits_are_refused():
    b = Book(2, Policy(floor_ms=5000, per_page_ms=1))
    b.claim("a", 2, 0)
    assert b.claim("b", 2, 4999)[1].copy
    b2 = Book(2, Policy(floor_ms=5000, per_page_ms=1, tail=0, stale_copies=False))
    _, mine = b2.claim("a", 2, 0)
    assert b2.claim("a", 1, 10)[0] == "wait" or mine.pages == [1]
    assert b2.reap(5000) == mine.pages and not b2.commit("a", mine.pages[0], 5001)


def test_blocker_copies_and_drops():
    b = Book(3, Policy(tail=0, stale_copies=False))
    b.claim("a", 3, 0)
    assert b.claim("b", 1, 7000, blocker=1)[1].pages != [1]  # not yet twice the expected time
    assert b.claim("c", 1, 8000, blocker=1)[1].pages == [1]
    assert 1 not in b.drop("a") and b.commit("c", 1, 8100)
    assert b.takeover("nobody") and b.queue


def test_every_page_is_committed_once():
    rng = random.Random(1)
    for _ in range(30):
        book, now, accepted = Book(rng.randint(1, 30), Policy(nodes=3, floor_ms=3000, per_page_ms=500, ahead=rng.choice([0, 2]))), 0, []
        while len(book.done) < book.total:
            now += rng.randint(1, 900)
            node = rng.choice("abc")
            outcome, lease = book.claim(node, rng.randint(1, 6), now)
            assert all(len(book.holders(p)) <= 2 for p in range(1, book.total + 1))
            for held in [x for x in book.leases.values() if x.node == node]:
                for p in list(held.pages):
                    if rng.random() < 0.6 and book.commit(node, p, now):
                        accepted.append(p)
            if rng.random() < 0.05:
                book.drop(node)
        assert sorted(accepted) == list(range(1, book.total + 1)) and book.claim("a", 1, now)[0] == "done"


class Naive:
    """The same rules by looking through all leases and the whole queue each time."""

    def __init__(self, total, p):
        self.total, self.p, self.queue, self.leases, self.done, self.pace, self.cap, self.n = total, p, list(range(1, total + 1)), [], set(), {}, {}, 0

    def end(self, lease):
        self.leases.remove(lease)
        back = [x for x in sorted(lease["pages"]) if x not in self.done and x not in self.queue and not any(x in o["pages"] for o in self.leases)]
        self.queue += back
        return back

    def end_all(self, test):
        return [x for o in [o for o in self.leases if test(o)] for x in self.end(o)]

    def speed(self, node):
        pages, seconds, _ = self.pace.get(node, (0, 0, None))
        if not pages or seconds <= 0:
            return 4000
        return 60_000 if pages / seconds <= 0.01 else 1000 * seconds / pages

    def step(self, kind, node, now, page, capacity, blocker):
        if kind == "drop":
            return "returned", self.end_all(lambda o: o["node"] == node)
        if kind == "takeover":
            return "returned", self.end_all(lambda o: o["node"] != node)
        back = self.end_all(lambda o: o["until"] <= now)
        if kind == "reap":
            return "returned", back
        if kind == "commit":
            mine = [o for o in self.leases if o["node"] == node and page in o["pages"]]
            if not mine or page in self.done:
                return "refused", [page]
            self.done.add(page)
            pages, seconds, last = self.pace.get(node, (0, 0.0, None))
            seconds += max(0.05, (now - mine[0]["at"]) / 1000) if last != mine[0]["n"] else 0
            self.pace[node] = (pages + 1, seconds, mine[0]["n"])
            self.leases = [o for o in self.leases if not set(o["pages"]) <= self.done]
            return "accepted", [page]
        self.cap[node] = capacity
        if len(self.done) == self.total:
            return "done", []
        held = sum(x not in self.done for o in self.leases if o["node"] == node for x in o["pages"])
        room = max(0, capacity - held)
        if not room and held and self.p.ahead:
            room = max(0, capacity + self.p.ahead - held)
        if not room:
            return "wait", []
        of = lambda x: [o for o in self.leases if x in o["pages"]]
        if blocker is not None and blocker not in self.done:
            owner = [o for o in of(blocker) if not o["copy"]]
            if owner and len(of(blocker)) < 2 and node not in [o["node"] for o in of(blocker)] and now - owner[0]["at"] >= max(2500, 2 * self.speed(owner[0]["node"])):
                return "batch", self.give(node, [blocker], True, now)
        pages, seconds, _ = self.pace.get(node, (0, 0, None))
        size = min(max(capacity, 1), 16)
        size = min(size, max(1, round(8 * pages / seconds)) if pages and seconds > 0 else 2)
        want = min(room, size)
        if self.queue:
            few = len(self.queue)
            want = 1 if few <= self.p.nodes else min(want, 2) if few <= 2 * self.p.nodes else want
            take, self.queue = self.queue[: max(want, 1)], self.queue[max(want, 1) :]
            return "batch", self.give(node, take, False, now)
        tail, out = self.total - len(self.done) <= self.p.tail, []
        if tail or self.p.stale_copies:
            for o in sorted((o for o in self.leases if not o["copy"] and o["node"] != node), key=lambda o: (o["at"], o["n"])):
                rest = [x for x in o["pages"] if x not in self.done]
                waves = -(-len(rest) // max(1, self.cap.get(o["node"], 1)))
                if tail or (rest and now - o["at"] >= max(2500, 0.6 * waves * self.speed(o["node"]))):
                    out += [x for x in sorted(rest) if x not in out and len(of(x)) < 2 and node not in [h["node"] for h in of(x)]]
        out = out[: max(want, 1)]
        return ("batch", self.give(node, out, True, now)) if out else ("wait", [])

    def give(self, node, pages, copy, now):
        self.n += 1
        until = now + min(max(self.p.floor_ms, len(pages) * self.p.per_page_ms), self.p.cap_ms)
        self.leases.append({"n": self.n, "node": node, "pages": pages, "at": now, "until": until, "copy": copy})
        return sorted(pages)


def test_replay_matches_a_naive_book(spark):
    """Claims, commits, reaps, drops, takeovers and blockers of many jobs; each kind of outcome must come up."""
    rng, rows, want, seen = random.Random(6), [], {}, set()
    policy = Policy(per_page_ms=3000, floor_ms=6000, cap_ms=20_000, tail=3, nodes=3, ahead=1)
    for job in range(60):
        total, now = rng.randint(1, 30), 0
        book = Naive(total, policy)
        for seq in range(150):
            now += rng.choice([0, 50, 400, 1500, 4000])
            kind, node = rng.choices(["claim", "commit", "reap", "drop", "takeover"], [9, 12, 2, 0.4, 0.2])[0], rng.choice("abcd")
            held = [x for o in book.leases if o["node"] == node for x in o["pages"]]
            page = rng.choice(held) if held and rng.random() < 0.8 else rng.randint(1, total)
            capacity, blocker = rng.randint(1, 5), rng.randint(1, total) if rng.random() < 0.4 else None
            copies = sum(o["copy"] for o in book.leases)
            outcome, pages = book.step(kind, node, now, page, capacity, blocker)
            want[job, seq] = outcome, list(pages)
            seen.add((kind, outcome, bool(pages), sum(o["copy"] for o in book.leases) > copies, kind == "claim" and pages == [blocker]))
            rows.append((job, seq, now, node, kind, page, capacity, total, blocker))
    df = spark.createDataFrame(rows, "job long, seq long, ms long, node string, kind string, page int, capacity int, total int, blocker int").selectExpr("*", "timestamp_millis(ms) AS ts")
    got = {(r["job"], r["seq"]): (r["outcome"], r["pages"]) for r in replay(df.repartition(7), policy).collect()}
    assert got == want
    assert {("claim", "batch", True, True, True), ("claim", "batch", True, True, False), ("takeover", "returned", True, False, False), ("drop", "returned", True, False, False), ("reap", "returned", True, False, False), ("claim", "done", False, False, False)} <= seen


def test_replay(spark):
    e = [(1, 1, "claim", 0), (1, 2, "commit", 1), (1, 3, "commit", 1), (1, 4, "drop", 0), (2, 1, "commit", 1)]
    df = spark.createDataFrame([(j, s, f"2024-01-01 00:00:{s:02d}", "n", k, p, 2, 5, None) for j, s, k, p in e], "job long, seq long, ts string, node string, kind string, page int, capacity int, total int, blocker int")
    rows = {(r["job"], r["seq"]): (r["outcome"], r["pages"]) for r in replay(df).collect()}
    assert rows == {(1, 1): ("batch", [1, 2]), (1, 2): ("accepted", [1]), (1, 3): ("refused", [1]), (1, 4): ("returned", [2]), (2, 1): ("refused", [1])}


def test_deferred_admission():
    b = Book(6, Policy(nodes=2, deferred=True, tail=0, stale_copies=False))
    assert b.claim("a", 4, 0)[0] == "wait" and b.admit(3) and not b.admit(3) and not b.admit(7)
    assert b.finish(1) and not b.finish(1) and not b.finish(3) and not b.admit(1)
    assert b.admit(5)
    assert b.claim("a", 4, 10)[1].pages == [3, 5]  # 2, 4 and 6 may come, so not one page for each node
    assert not b.finish(3) and b.commit("a", 3, 20) and b.commit("a", 5, 30)
    assert b.admit(6) and b.seal() == [2, 4] and b.seal() == []
    assert b.claim("b", 4, 40)[1].pages == [6] and b.commit("b", 6, 50)
    assert b.admit(2) and b.finish(4) and b.claim("b", 4, 60)[1].pages == [2]
    assert b.commit("b", 2, 70) and b.claim("a", 1, 80)[0] == "done"
