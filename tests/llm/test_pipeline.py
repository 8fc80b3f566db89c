import random
import shutil
from pathlib import Path

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(FOLDER + "/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        now = docs.collect()
        assert {r["doc_id"] for r in now} <= before, name
        before = {r["doc_id"] for r in now}
        if name != "packing":
            assert docs.columns == columns and len(now) == len(before)
            docs = spark.createDataFrame(now, docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == before


CASES = [(1, None, "a"), (2, "", "b"), (None, "no id " * 40, "c"), (3, "word " * 30000, "d"), (4, "same text as another " * 20, "e"), (5, "same text as another " * 20, "f"), (5, "same text as another " * 20, "f")]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize("rows", [CASES, []])
def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path, rows):
    clash = ["kept_text", "score", "_lost", "_stay", "digest", "spans", "fp", "n_lines", "bucket", "h1", "owner", "_key", "a.b"]
    docs = spark.createDataFrame([(d, t, x, None, *[x] * len(clash)) for d, t, x in rows], "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"`{c}` string" for c in clash))
    shutil.copy(FOLDER + "/labels.parquet", tmp_path / "labels.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            assert sum(r["length"] for r in got) > 0 or not rows
            continue
        assert out.columns == docs.columns and all(r[c] == r["lang"] for r in got for c in clash)
        assert {r["doc_id"] for r in got} == ({1, None, 3, 4} if name == "near copies" else {r[0] for r in rows}) if rows else not got
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() <= len(rows)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    texts = {}
    for group in range(30):
        words = [rng.choice(base) for _ in range(rng.randint(6, 250))]
        for _ in range(4):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 35)):
                changed[rng.randrange(len(changed))] = rng.choice(base)
            texts[len(texts)] = " ".join(changed)
    texts |= {200: "", 201: None, 202: "one two three", 203: "ONE  two three", 204: "one two four"}

    def cut(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets, root = {d: cut(t) for d, t in texts.items()}, {d: d for d in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert len({root[d] for d in texts}) < len(texts) - 30
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string")
    stay = [r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, "").collect()]
    assert sorted(d for d in stay if d is not None) == sorted(set(root.values())) and stay.count(None) == 1


def test_large_groups_are_dealt_in_parts(spark):
    """Groups over the bound meet part by part; one fingerprint's round and the others' give the same components."""
    from arcwell.llm import near_copies

    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(150)]
    texts = []
    for _ in range(60):
        changed = list(words)
        changed[rng.randrange(150)] = "other"
        texts.append(" ".join(changed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in (near_copies.Search(), near_copies.Search(most=7)):
        got = {r["component_id"] for r in near_copies.near_components(docs, how=how).collect()}
        assert got == {0}


def test_sketches_by_brute_force():
    import numpy as np
    import xxhash

    from arcwell.llm import near_copies

    rng = random.Random(2)
    for n in (0, 1, 2, 300, 700):
        text = " ".join("".join(rng.choices("abc", k=4)) for _ in range(n))
        words = text.split()
        runs = {" ".join(words[k : k + 2]) for k in range(max(1, n - 1))}
        hashes = near_copies.hashed(text, 2)
        assert set(hashes.tolist()) == {xxhash.xxh64_intdigest(r.encode(), 42) for r in runs} and len(hashes) == len(runs)
        times = [int(x) | 1 for x in np.random.default_rng(2025).integers(0, 1 << 64, 3, dtype=np.uint64)]
        for k, code in enumerate(near_copies.sketch(hashes, 3)):
            mixed = []
            for h in hashes.tolist():
                x = h * times[k] % 2**64
                x ^= x >> 32
                x = x * 0x9E3779B97F4A7C15 % 2**64
                mixed.append((x ^ x >> 29).to_bytes(8, "little"))
            bits = [2 * sum(m[b // 8] >> 7 - b % 8 & 1 for m in mixed) > len(mixed) for b in range(64)]
            assert int(code).to_bytes(8, "little") == bytes(sum(bits[8 * j + i] << 7 - i for i in range(8)) for j in range(8))
