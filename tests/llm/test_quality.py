import math
import random
import zlib

import numpy as np

from pagewright.llm import quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["river", "stone", "walks", "along", "quiet", "morning", "lamps", "of", "the", "and", "harbour"]
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["$$$", "%%%", "###"])) for _ in range(rng.randint(4, 400)))
        rows.append((i, text, int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, quality_score string")
    return docs, spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    rows = corpus(500)
    docs, labels = frames(spark, rows)
    net = quality.fit_quality(docs, labels, sample=200)
    got = {r["doc_id"]: r for r in quality.score_quality(docs.withColumn("held_out", quality.held_out(docs.doc_id)), net).select("row.*", "score").collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in rows)
    held = [(got[d]["score"] >= 0.5) == q for d, _, q in rows if got[d]["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_chunks_cover_a_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(i % 251 + 1 for i in range(n))
        x = quality.chunks(text)
        assert x.shape[1] == quality.CHUNK and bytes(x[0][: min(n, 512)]) == text[:512] and (n < 512 or bytes(x[-1]) == text[-512:])
        assert {bytes(x[k]) for k in range(len(x))} <= {text[a : a + 512].ljust(512, b"\0") for a in range(n + 1)}
        assert len(x) >= max(1, -(-(n - 64) // 448))


def test_scores_do_not_depend_on_neighbours():
    net = quality.Network()
    net.v += np.random.default_rng(1).normal(size=net.v.shape).astype(np.float32)
    texts = [b"", b"a", b"xyz " * 3000, b"q" * 700, b"The end."]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-5) and ((0 <= together) & (together <= 1)).all()


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x y"), (2, "z" * 200_000)], "doc_id long, text string")
    for labels, prior in (([], 0.5), ([(1, 1), (2, 1), (None, 0), (3, None)], 1.0)):
        net = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert net.prior == prior
        assert [r["score"] for r in quality.score_quality(docs, net).collect()] == [prior] * 4
    assert quality.score_quality(docs.limit(0), quality.Network()).count() == 0
    assert [0 <= r["score"] <= 1 for r in quality.score_quality(docs, quality.Network()).collect()] == [True] * 4


def test_columns_come_back_as_they_are(spark):
    rows = [(1, "some text", "a", 0.25), (1, "some text", "a", 0.25), (None, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 string, score double")
    assert sorted(map(str, (tuple(r["row"]) for r in quality.score_quality(docs, quality.Network()).collect()))) == sorted(map(str, rows))


def test_a_fit_is_the_same_again_and_reads_whole_texts(spark):
    rows = corpus(150)
    # repeated ids, and a sign of quality only at the end of long texts
    rows += [(1000 + i, "plain words " * 600 + ("!!! " * 40 if i % 2 else ""), i % 2) for i in range(60)] + [(3, "another text", 1), (3, None, 0)]
    docs, labels = frames(spark, rows)
    nets = [quality.fit_quality(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert all((a == b).all() for a, b in zip(nets[0].parameters(), nets[1].parameters()))
    got = {r["row"]["doc_id"]: r["score"] for r in quality.score_quality(docs.filter("doc_id >= 1000"), nets[0]).collect()}
    assert sum((got[d] >= 0.5) == q for d, _, q in rows if d >= 1000) >= 57


def plain_score(net, text):
    """The network's probability by plain loops."""
    raw = list(text) + [0] * max(0, 512 - len(text))
    starts = list(range(0, len(raw) - 512, 448)) + [len(raw) - 512]
    pooled = []
    for a in starts:
        x, best = raw[a : a + 512], [float("-inf")] * quality.FILTERS
        for cell in range(127):
            seen = [float(v) for byte in x[4 * cell : 4 * cell + 8] for v in net.emb[byte]]
            for f in range(quality.FILTERS):
                best[f] = max(best[f], sum(v * float(w) for v, w in zip(seen, net.w[:, f])) + float(net.b[f]))
        pooled.append([max(v, 0.0) for v in best])
    z = float(net.c[0])
    for f in range(quality.FILTERS):
        col = [p[f] for p in pooled]
        z += max(col) * float(net.v[f]) + sum(col) / len(col) * float(net.v[quality.FILTERS + f]) + min(col) * float(net.v[2 * quality.FILTERS + f])
    return 1 / (1 + math.exp(-z))


def random_net(seed):
    net, rng = quality.Network(seed), np.random.default_rng(seed)
    net.v += rng.normal(0, 0.5, net.v.shape).astype(np.float32)
    net.b += rng.normal(0, 0.2, net.b.shape).astype(np.float32)
    return net


def test_scores_match_plain_loops():
    rng, net = random.Random(2), random_net(5)
    texts = [b"", b"x", bytes(rng.randrange(1, 256) for _ in range(511)), bytes(rng.randrange(1, 256) for _ in range(513)), b"ab " * 700]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = random_net(8)
    for name in ("emb", "w", "b", "v", "c"):  # double precision, so that small differences show
        setattr(net, name, getattr(net, name).astype(np.float64))
    xs = [quality.chunks(bytes(rng.integers(1, 256, n, dtype=np.uint8))) for n in (30, 512, 1500, 700)]
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p, starts = net.pooled(np.concatenate(xs)), np.cumsum([0] + [len(x) for x in xs[:-1]])
        q = net.probability(p, starts)
        return -np.mean(np.where(y == 1, np.log(q), np.log(1 - q))) + 0.5e-4 * float(net.v @ net.v)

    for value, grad in zip(net.parameters(), net.gradients(xs, y)):
        flat, g = value.reshape(-1), grad.reshape(-1)
        for k in [int(np.abs(g).argmax()), *rng.integers(0, len(flat), 6).tolist()]:
            at, step = flat[k], 1e-5
            flat[k] = at + step
            up = loss()
            flat[k] = at - step
            down = loss()
            flat[k] = at
            assert abs((up - down) / (2 * step) - g[k]) < 2e-4 + 2e-3 * abs(g[k])
