import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    rows = packing.plan(counts, capacity)
    filled, seen = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in rows.tolist():
        seen[length].append((rank, n))
        for k in range(n):
            filled[first + k].append((offset, length))
    for at in filled.values():
        place = 0
        for offset, length in sorted(at):
            assert offset == place
            place += length
        assert place <= capacity
    for length, spans in seen.items():
        at = 0
        for rank, n in sorted(spans):
            assert rank == at
            at += n
        assert at == counts[length]
    assert sorted(filled) == list(range(len(filled)))
    return len(filled), -(-sum(lengths) // capacity)


def test_plans_are_whole_and_gapless():
    rng = random.Random(3)
    for capacity in (16, 100, 2048):
        for _ in range(5):
            check_plan([rng.randint(1, capacity) for _ in range(rng.randint(1, 800))], capacity)
        check_plan([capacity // 2] * 333, capacity)
        check_plan([capacity], capacity)
    assert len(packing.plan(np.zeros(17, int), 16)) == 0


def test_few_sequences():
    rng = np.random.default_rng(8)
    used, least = check_plan((np.minimum(2047, rng.lognormal(6, 0.9, 20000)).astype(int) + 1).tolist(), 2048)
    assert used <= 1.002 * least


TEXTS = ["", None, "one two", "one two", "<|endoftext|> inside <|endoftext|>", "naïve Straße 中文 😀 ½", "word " * 9000, "A" * 7000, " \n\n  x", "it's WE'LL 're\x1c\x85\xa0z"]


def test_pieces_and_places(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(TEXTS * 3)] + [(2, "one two", "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in filled.values():
        place = 0
        for offset, length in sorted(at):
            assert offset == place
            place += length
        assert place <= 2048


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
