import random
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "ten", "mul", "sha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts], SCHEMA).repartition(4)


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    bases = [prose(rng, 300) for _ in range(40)]
    texts = [(i, b) for i, b in enumerate(bases)]
    for i, b in enumerate(bases):
        texts.append((1000 + i, b))  # an exact copy
        words = b.split()
        for k in rng.sample(range(300), 3):  # about 0.9 of the shingles stay
            words[k] = "edited"
        texts.append((2000 + i, " ".join(words)))
    texts += [(5000 + i, prose(rng, rng.randint(5, 400))) for i in range(150)]  # unlike all others
    kept = Counter(r["doc_id"] for r in cp.near_dedup(spark, frame(spark, texts), "").collect())
    assert set(range(40)) <= set(kept) and {5000 + i for i in range(150)} <= set(kept)
    assert not set(kept) & set(range(1000, 1040)) and len(set(kept) & set(range(2000, 2040))) <= 2
    assert set(kept.values()) == {1}


def test_near_dedup_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "lonely words here"), (7, "same id"), (7, "same id"), (8, "A B"), (9, "a b")]
    kept = cp.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 7), (False, 8), (True, 0)]
    assert cp.near_dedup(spark, frame(spark, rows).limit(0), "").count() == 0


def test_near_dedup_drops_only_rows_of_one_group(spark):
    rng = random.Random(4)
    x, y, *rest = (prose(rng, 60) for _ in range(22))
    rows = [(3, x), (7, x), (7, y), *[(None, t) for t in rest], (None, rest[0]), (None, x)]
    for _ in range(3):
        rng.shuffle(rows)
        kept = cp.near_dedup(spark, frame(spark, rows), "").collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, x), (7, y), *[(None, t) for t in rest]], key=str)


def test_clashing_columns(spark):
    from pagewright.llm.similar import one_of_each

    df = spark.createDataFrame([(1, "same text", "x"), (2, "same text", "y"), (3, "other words", "z")], "doc_id long, text string, stays string")
    assert sorted(tuple(r) for r in one_of_each(df).collect()) == [(1, "same text", "x"), (3, "other words", "z")]


def test_secrets_are_replaced_and_all_documents_stay(spark):
    rows = [(1, "token=abcdef12 after"), (1, "token=abcdef12 after"), (2, "clean"), (3, None), (None, "x AKIA" + "A" * 20)]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cp.secrets(spark, frame(spark, rows), "").collect()), key=str)
    assert got == sorted([(1, "[assign] after", 14), (1, "[assign] after", 14), (2, "clean", 5), (3, None, None), (None, "x [access]", 10)], key=str)


def test_stages_in_a_row(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        made = stage(spark, docs, sf)
        if k < 4:
            assert made.columns == cp.COLUMNS
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {n: Counter(r["doc_id"] for r in rows) for n, rows in seen.items()}
    assert set(ids["near_dedup"]) < set(ids["quality"]) and ids["secrets"] == ids["near_dedup"]
    assert set(ids["mixing"]) <= set(ids["secrets"]) and max(ids["mixing"].values()) <= 3
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(seen["mixing"]) / words(seen["secrets"]) - 1) < 0.1
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in seen["packing"]) == sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    filled = Counter()
    for r in seen["packing"]:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def left(spark):
    base = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    return {p for p in base.rglob("*.parquet") if p.is_file()}


def test_run_leaves_its_result_only(spark):
    before = left(spark)
    made = cp.run(spark, "/root/testdata/sf0.001")
    rows = made.collect()
    assert rows and {p.parent.name for p in left(spark) - before} == {"packing"}
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_stages_of_odd_and_of_no_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows and ids, a clashing column; then an empty table through all stages."""
    for rows in ([(1, None), (2, ""), (None, "some words"), (None, "some words"), (7, "token=abcdefgh x"), (7, "other text here"), (7, "other text here")], []):
        df = spark.createDataFrame([(i, t, None if i == 2 else "en", f"s{(i or 0) % 2}", None if t is None else len(t), "x") for i, t in rows], SCHEMA + ", score string")
        spark.createDataFrame([(7, 1), (7, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{len(rows)}/labels.parquet")
        for name, stage in cp.STAGES:
            made = stage(spark, df, f"{tmp_path}/{len(rows)}")
            made.write.parquet(f"{tmp_path}/{len(rows)}/{name}")
            df = spark.read.schema(made.schema).parquet(f"{tmp_path}/{len(rows)}/{name}")
            if name == "secrets":
                kept = sorted(str((r["doc_id"], r["text"])) for r in df.collect())
        assert kept == sorted(map(str, [(1, None), (None, "some words"), (7, "[assign] x"), (7, "other text here")] if rows else []))
        assert df.count() >= (1 if rows else 0) and bool(df.count()) == bool(rows)
