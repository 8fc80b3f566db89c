"""Operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arcwell.llm import bpe, chat, graph, line_dedup, mpeg_audio, packing, quality, rules, sharding, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are as with his they alpha beta gamma delta epsilon zeta eta theta".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ".\n"]) if rng.random() < 0.1 else "") for _ in range(n))


def rows():
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = fresh(60)
    long_line = "A line that repeats over documents"
    out = [(1, prose(rng, 200), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, "a", 0), (4, "x" * 5000, "de", "b", 5000), (5, " \t\n\x0b\x0c\r ", "en", "b", 7), (6, "日本語 😀 é<|endoftext|> tail  two\n\n", "xx", "b", 9)]
    out += [(7, f"{long_line}\n{fresh(30)}\n{long_line}\nshort", "en", "c", 1), (8, f"  {long_line.upper()} \n{fresh(30)}\nshort", "en", "c", 1), (9, f"{fresh(40)} {passage} {fresh(40)}", "en", "c", 1), (10, f"{fresh(33)} {passage} {fresh(20)}", "en", "c", 1)]
    out += [(k, out[0][1], "en", "c", 1) for k in (11, 12)] + [(1, out[0][1], "en", "a", 1), (None, passage, None, None, None), (13, fresh(3000), "en", "d", 1), (14, "one two", "en", "d", 1), (15, "ONE  TWO", "en", "d", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, none, tokenizer):
    got = Counter(tuple(r) for r in bpe.round_trip(docs).collect())
    want = Counter()
    for d, t, *_ in rows():
        i = ids(tokenizer, t)
        back = tokenizer.decode(i, skip_special_tokens=False)
        want[d, len(i), sha256(",".join(map(str, i)).encode()).hexdigest(), sha256(back.encode()).hexdigest()] += 1
    assert got == want and bpe.round_trip(none).count() == 0
    both = bpe.decode(bpe.encode(docs)).select("text", "ids", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") and list(r["ids"]) == ids(tokenizer, r["text"]) for r in both)


def test_bpe_random_texts(tokenizer):
    rng, coder = random.Random(1), bpe.load(bpe.vocabulary())
    holders = defaultdict(list)
    for token in coder.vocab:
        for b in set(token):
            holders[b].append(token)
    for _ in range(60):
        t = "".join(rng.choice("ab eE.'st1\n\t\r  \xa0àÀ\x85\x1cé中😀-_") for _ in range(rng.randint(0, 60)))
        want = ids(tokenizer, t)
        assert coder.encode(t).tolist() == want and coder.encode_whole(t).tolist() == want, repr(t)
        if not t:
            continue
        # every piece ends at a pretoken's end or at a pair that no token holds, and every such place is an end
        pretokens = [p.encode() for p in coder._split.findall(t)]
        data, cuts = coder._cuts(pretokens)
        ends = set(np.cumsum(list(map(len, pretokens))).tolist())
        forced = {k for k in range(1, len(data)) if not any(data[k - 1 : k + 1] in token for token in holders[data[k - 1]])}
        assert set(cuts.tolist()) == {0} | ends | forced
        assert [i for a, b in zip(cuts, cuts[1:]) for i in coder.merge(data[a:b])] == want, repr(t)
    whole = "ab" * 4000
    assert coder.merge(whole.encode()) == ids(tokenizer, whole)
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary())
    own._encode = own.merge  # without the library
    for t in ["".join(rng.choice("ab eE.'st1\n\t\r  \xa0àÀ\x85é中😀-_") for _ in range(rng.randint(0, 90))) for _ in range(200)]:
        assert own.encode(t).tolist() == ids(tokenizer, t), repr(t)


def test_bpe_cuts_inside_words(tokenizer):
    """Short words are cut at byte pairs too, and each cut is counted by its kind."""
    coder = bpe.load(bpe.vocabulary())
    text = "quick qzxj-kvq wxyz $$%% zqj\nvkq"
    found = coder.cuts(text)
    assert found["space"] == 4 and found["pair"] > 0 and found["pretoken"] > 0
    pretokens = [p.encode() for p in coder._split.findall(text)]
    assert found["space"] + found["pretoken"] == len(pretokens) - 1
    inner = {(a, b) for token in coder.vocab for a, b in zip(token, token[1:])}
    assert found["pair"] == sum((a, b) not in inner for p in pretokens for a, b in zip(p, p[1:]))
    assert coder.encode(text).tolist() == ids(tokenizer, text)


def test_packing(docs, none, tokenizer):
    found = packing.pack_documents(docs, open_bins=8).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for d, t, *_ in rows():
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        i = ids(tokenizer, t) + [0]
        copies = sum(x[0] == d for x in rows())
        for piece in {r["piece"] for r in own}:
            same = [r for r in own if r["piece"] == piece]
            r = same[0]
            part = np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert len(same) == copies and r["ids_crc32"] == zlib.crc32(part)
            assert r["length"] <= 2048 and (piece == 0 or r["length"] == 2048)
        assert sum(r["length"] for r in own) == copies * len(i)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0
    assert Counter(found) == Counter(packing.pack_documents(docs, open_bins=8).collect())


def test_best_fit_by_brute_force():
    rng = random.Random(3)
    for most in (1, 3, 50):
        bins, free, closed, n = packing.BestFit(20, most), {}, set(), 0
        for _ in range(400):
            size = rng.randint(1, 20)
            at, offset = bins.place(size)
            fitting = [f for f in free.values() if f >= size]
            if fitting:
                assert free[at] == min(fitting) and at not in closed
            else:
                if len(free) >= most:
                    fullest = min(free.values())
                    gone = [b for b in free if free[b] == fullest]
                    closed.add(gone[-1])
                    free.pop(gone[-1])
                assert at == n and offset == 0
                n += 1
                free[at] = 20
            assert offset == 20 - free[at]
            free[at] -= size
            if not free[at]:
                free.pop(at)
                closed.add(at)
            else:
                free[at] = free.pop(at)


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and sharding.shard_documents(none).count() == 0
    many = sharding.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), [1.0, 2.0, 1.0], [1.0])
    share = {r["shard"]: r["count"] for r in many.groupBy("shard").count().collect()}
    assert abs(share[1] - 10000) < 300 and abs(share[0] - 5000) < 300
    moved = many.where("grown_shard <> shard")
    assert moved.where("grown_shard <> 3").count() == 0 and abs(moved.count() - 4000) < 300
    again = {(r["doc_id"], r["size"], r["text_crc32"], r["slot"], r["shard"]) for r in sharding.shard_documents(docs.repartition(2)).collect()}
    assert again == {(r["doc_id"], r["size"], r["text_crc32"], r["slot"], r["shard"]) for r in got}


def line_key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(docs, none):
    owner = {}
    seen = defaultdict(set)
    for d, t, *_ in rows():
        for line in (t or "").split("\n"):
            if d is not None and len(line_key(line)) >= 10:
                seen[line_key(line)].add(d)
    owner = {k: min(v) for k, v in seen.items() if len(v) > 1}
    want = Counter()
    for d, t, *_ in rows():
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or owner.get(line_key(x), d) == d]
        want[d, len(lines), len(lines) - len(stay), sha256("\n".join(stay).encode()).hexdigest()] += 1
    for batches, fan_in in ((4, 3), (7, 2)):
        out = line_dedup.dedup_lines(docs, batches=batches, fan_in=fan_in).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha256(r["kept_text"].encode()).hexdigest()) for r in out) == want
    assert Counter(map(tuple, line_dedup.digests(docs).collect())) == want
    assert line_dedup.digests(none).count() == 0


def test_simhash(docs, none):
    def brute(t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", line_key(t or "")) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [(d, brute(t)) for d, t, *_ in rows()]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for g, (d, _) in zip(group, fps):
        if d is not None:
            least[g].append(d)
    want = Counter((d, f"{f:016x}", min(least[g], default=None)) for g, (d, f) in zip(group, fps))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    stay = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert {11, 12, 15}.isdisjoint(stay) and {1, 14}.issubset(stay)


@pytest.mark.parametrize("n,bases", [(0, 1), (1, 1), (1500, 150), (1500, 3)])
def test_gray_index(n, bases):
    rng = np.random.default_rng(n + bases)
    codes = rng.integers(0, 2**64, bases, dtype=np.uint64)[rng.integers(0, bases, n)]
    for _ in range(4):
        codes = np.where(rng.random(n) < 0.6, codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), codes)
    index = simhash.GrayIndex(np.unique(codes), 0)
    c = index.codes
    want = {(i, int(j)) for i in range(len(c)) for j in np.nonzero(np.bitwise_count(c ^ c[i]) <= 3)[0] if i < j}
    found = [(int(a), int(b)) for x, y in index.pairs(np.arange(len(c)), 3) for a, b in zip(x, y)]
    assert len(found) == len(set(found)) and set(found) == want
    assert (np.sort(simhash.gray_rank(c)) == simhash.gray_rank(c)).all()


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_links_over_blocks(spark, most):
    rng = np.random.default_rng(9)
    codes = np.unique(np.repeat(rng.integers(0, 2**63, 40, dtype=np.uint64), 5) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))).view(np.int64)
    # some share their first 40 bits, and so a block of any length that is tried
    codes = np.unique(np.concatenate([codes.view(np.uint64), rng.integers(0, 1 << 24, 60, dtype=np.uint64) & np.uint64(0xFF03FF) | np.uint64(0xABCD << 40)])).view(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(c),) for c in codes], "fp long"), most=most).collect()
    label = {int(c): int(c) for c in codes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    brute = dict(label)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if np.bitwise_count(np.uint64(np.int64(a ^ b).view(np.uint64))) <= 3:
                x, y = root(int(a)), root(int(b))
                label[max(x, y)] = min(x, y)
    brute = {c: root(c) for c in label}
    label = {c: c for c in label}
    for e in edges:
        x, y = root(e["u"]), root(e["v"])
        label[max(x, y)] = min(x, y)
    assert {c: root(c) for c in label} == brute and len(edges) <= 4 * len(codes) * (1 if most > 100 else 6)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(-50, 200), rng.randint(-50, 200)) for _ in range(90)] + [(k, k + 1) for k in range(300, 380)] + [(500, 500), (None, 3)]
    label = {x: x for p in pairs for x in p if p[0] != p[1] and None not in p}
    for _ in label:
        for a, b in pairs:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == label and len(got) == len(label)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substrings(docs, none):
    out = {r["doc_id"]: r for r in substrings.dedup_substrings(docs).collect() if r["doc_id"] is not None}
    texts = {d: t or "" for d, t, *_ in rows()}
    assert all(out[d]["kept_text"] == texts[d] for d in (1, 2, 3, 4, 5, 6, 9, 13, 14, 15))
    assert out[11]["kept_text"] == out[12]["kept_text"] == ""
    lost = set(texts[10].split()) - set(out[10]["kept_text"].split())
    assert lost <= set(texts[9].split()) and len(lost) > 40 and out[10]["n_lost_words"] >= 40
    for r in out.values():
        raw = texts[r["doc_id"]].encode()
        keep = bytearray(raw)
        for s in reversed(r["spans"]):
            del keep[s["start"] : s["end"]]
        assert keep.decode() == r["kept_text"]
    assert substrings.dedup_substrings(none).count() == 0


def test_gear_and_chunks():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(400))
    hashes = substrings.gear_hashes(np.frombuffer(data, np.uint8))
    h = 0
    for k, b in enumerate(data):
        h = (h * 2 + int(substrings.GEAR[b])) % (1 << 16)
        assert hashes[k] == h
    how = substrings.Chunking()
    text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(800)) + "日" * 500
    raw, ends, _ = substrings.chunks(text, how)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= how.longest and b"".join(raw[a:b] for a, b in zip([0, *ends], ends)) == raw
    for a, b in zip([0, *ends], ends):
        raw[a:b].decode()
    shifted = set(substrings.chunks("inserted words " + text, how)[2])
    assert len(set(substrings.chunks(text, how)[2]) - shifted) <= 2


def test_rules(spark, docs, none):
    for d, t, *_ in rows() + [(99, "a b c d e f g h " * 5, 0, 0, 0), (98, "# #\nx\nx\n \n\n", 0, 0, 0)]:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        found = rules.base_counts(t)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        assert found == ([w.encode() for w in words], sum(map(len, words)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
    got = rules.judged(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert rules.judged(none).count() == 0
    rng = random.Random(6)
    clean = [(k, prose(rng, 120), "en", None, None) for k in range(30)]
    noise = [(100 + k, " ".join(f"{w}$$$" if w not in ("the", "of") else w.upper() + "!!%%" for w in prose(rng, 120).split()), "en", None, None) for k in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame(clean + noise, SCHEMA)).collect()}
    assert all(kept[k] for k in range(30)) and not any(kept[100 + k] for k in range(3))


def test_js_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert rules.js_distance(p, q) == 1 and rules.js_distance(p, p) == 0
    a, b = np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.2, 0.6])
    m = (a + b) / 2
    assert rules.js_distance(a, b) == pytest.approx(np.sqrt(((a * np.log2(a / m)).sum() + (b * np.log2(b / m)).sum()) / 2))


def test_audio(docs, none):
    for n in (0, 1, 64, 1416, 1417, 1418, 30000):
        data = random.Random(n).randbytes(n)
        media = mpeg_audio.write(data)
        s = mpeg_audio.read(media)
        assert mpeg_audio.stored(media, s) == data and s.crc_failed == s.skipped == 0 and s.crc_checked == len(s.offsets) + 1
        assert s.table_frames == len(s.headers) and s.duration_us() == 36_000 * len(s.headers) and s.tags == ["id3v2.4", "id3v1"]
    junk = b"\xff\xfb\x90 no frame "
    broken = media[: s.offsets[2]] + junk + media[s.offsets[2] :]
    again = mpeg_audio.read(broken)
    assert again.skipped == len(junk) and len(again.headers) == len(s.headers)
    flipped = bytearray(media)
    flipped[s.offsets[1] + 8] ^= 1
    assert mpeg_audio.read(bytes(flipped)).crc_failed == 1
    assert s.seek(0) == s.offsets[0] and s.seek(1152 * 3 + 5) == s.offsets[3] and s.seek(10**9) is None
    assert mpeg_audio.read(media[: s.offsets[3] + 7]).headers == s.headers[:3]
    for bad in (None, b"", b"abc", b"ID3\x04\0\0\0\0", b"\xff" * 50):
        assert mpeg_audio.read(bad).headers == []
    got = Counter(tuple(r)[:5] for r in mpeg_audio.media_digests(docs).collect())
    want = Counter()
    for d, t, *_ in rows():
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want[d, len(raw), len(full), sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert got == want and mpeg_audio.media_digests(none).count() == 0
    info = mpeg_audio.probe(mpeg_audio.to_media(docs)).select("audio").collect()
    assert all(r["audio"]["frames"] == len(r["audio"]["frame_offsets"]) > 0 for r in info)


def test_other_audio_formats():
    # MPEG 2 layer III, 22.05 kHz, stereo, with a VBRI table, and layer I
    h = mpeg_audio.header(bytes((0xFF, 0xF3, 0x80, 0x00)))
    assert (h.version, h.layer, h.rate, h.channels, h.samples, h.bitrate, h.size) == (2, 3, 22050, 2, 576, 64000, 208)
    frame = bytes((0xFF, 0xF3, 0x80, 0x00)) + bytes(204)
    table = bytearray(frame)
    table[36:62] = b"VBRI" + bytes(6) + (624).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    table[62:66] = (208).to_bytes(2, "big") * 2
    s = mpeg_audio.read(bytes(table) + frame * 3)
    assert (s.table, s.table_frames, s.table_bytes, s.seek_table, len(s.headers)) == ("vbri", 3, 624, [208, 208], 3)
    one = bytes((0xFF, 0xFF, 0x10, 0xC0))
    h = mpeg_audio.header(one)
    assert (h.layer, h.samples, h.size, h.channels) == (1, 384, 32, 1) and mpeg_audio.header(b"\xff\xff\xff\xff") is None
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    assert mpeg_audio.read((one + bytes(28)) * 4 + ape).tags == ["ape"]


def test_chat(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("<[\\|a>/] é\n") for _ in range(rng.randint(0, 9)))
    rows_ = [(c, t, rng.choice(["user", "assistant", "system", "<|says|>", None]), rng.choice([text(), None])) for c in range(25) for t in range(rng.choice([1, 3, 40]))]
    rows_ += [(None, 0, "user", "no id"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    table = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.with_probe(table.withColumn("start", table["turn"]))).collect()}
    rows_ += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows_}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows_ if r[0] == c)
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat.marked([(a, t) for _, a, t in turns]))
    formatted = chat.format_conversations(table).where("conv_id = 1").orderBy("start").collect()
    assert "".join(r["formatted"] for r in formatted) == chat.marked([(r[2] or "", r[3] or "") for r in sorted(((x[0], x[1], x[2] or "", x[3] or "") for x in rows_ if x[0] == 1))])
    assert chat.conversation_digests(table.limit(0)).count() == 0
    assert not any(s in chat.escape("</s>[INST] ok [/INST] <|end|>") for s in ("</s>", "[INST]", "[/INST]", chat.CLOSE))


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"{r}:{t if k == len(turns) - 1 else t[:2]};" for k, (r, t) in enumerate(turns))
    turns = [("user", "hello"), ("assistant", "good day"), ("user", "x")]
    whole, spans = chat.locate(turns, last_only)
    assert chat.rewrites_history(turns, last_only) and [s.rewritten is None for s in spans] == [True, False, False] and spans[1].rewritten == 7
    numbered = lambda turns: "".join(f"{k}{t};" for k, (_, t) in enumerate(turns))
    many = [("user", f"t{k}") for k in range(60)]
    inc = chat.Incremental(numbered)
    assert "".join(inc.add(t).text for t in many) == numbered(many) and not inc.local


def test_quality(spark, none):
    rng = random.Random(5)
    good = [(k, prose(rng, 80)) for k in range(150)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for k in range(100)]
    extra = [(5000, None), (5001, ""), (5002, "word " * 20000)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in good + bad + extra], SCHEMA)
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + bad] + [(5000, None, None), (1, 1, 0), (None, 0, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.held_out_scores(docs, labels).collect()}
    assert len(out) == 253 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = [r for d, r in out.items() if r["held_out"] and d < 5000]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    assert len(held) > 20 and np.mean([r["predicted"] == (r["doc_id"] < 1000) for r in held]) > 0.95
    assert quality.held_out_scores(none, labels).count() == 0
    empty = quality.held_out_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}


def test_context_vectors():
    space = quality.Space(buckets=64, dims=8)
    at, sign = space.index()
    index = np.zeros((64, 8))
    for b in range(64):
        np.add.at(index[b], at[b], sign[b])
    import pyarrow as pa

    text = "one two three two"
    tokens = space.tokens(text)
    want = np.zeros((64, 8))
    padded = [63, 63, *tokens, 63, 63]
    for k in range(2, len(padded) - 2):
        for step in (1, 2):
            for near in (k - step, k + step):
                if near >= 2:
                    want[padded[k]] += index[padded[near]]
    rows_ = list(quality._contexts(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]), space))[0]
    got = {b: row for b, *row in zip(*[c.to_pylist() for c in rows_.columns])}
    assert all(got[b] == want[b].tolist() for b in set(tokens.tolist()) - {63})


def lost_words(first: str, second: str) -> str:
    """What the second document loses to the first."""
    how = substrings.Chunking()
    raw, ends, digests = substrings.chunks(second, how)
    spans = substrings.lost_spans(raw, ends, digests, set(substrings.pair_digests(substrings.chunks(first, how)[2])), 16, how)
    return b"".join(raw[a:b] for a, b in spans).decode()


@pytest.mark.parametrize("alphabet,length", [("abcdefghij", 6), ("0123456789", 2), ("abcdefghijklmnopqrstuvwxyz", 1)])
def test_passages_of_over_50_words_are_found(alphabet, length):
    rng = random.Random(length)
    fresh = lambda n: " ".join("".join(rng.choices(alphabet, k=length)) for _ in range(n))
    missed = 0
    for _ in range(400):
        passage = fresh(51 if length > 1 else 60)
        gone = lost_words(f"{fresh(40)} {passage} {fresh(40)}", f"{fresh(33)} {passage} {fresh(20)}")
        missed += len(gone.split()) < 16
    assert missed == 0


def test_passages_without_white_space(spark):
    rng = random.Random(3)
    for alphabet in ("".join(chr(0x4E00 + k) for k in range(2000)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        fresh = lambda n: "".join(rng.choices(alphabet, k=n))  # noqa: E731, B023
        passage, whole = fresh(2000), fresh(3000)
        rows_ = [(1, whole), (2, whole), (3, fresh(701) + passage + fresh(300)), (4, fresh(50) + passage), (5, fresh(3000))]
        got = {r["doc_id"]: r["kept_text"] for r in substrings.dedup_substrings(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
        assert got[2] == "" and len(got[4]) < 50 + 150
        assert all(got[d] == t for d, t in rows_ if d in (1, 3, 5))


def test_junk_of_plain_letters_is_rejected(spark):
    rng = random.Random(11)
    letters = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    text = lambda share: " ".join(rng.choice(["the", "of", "and", "to", "in", "is"]) if rng.random() < share else letters() for _ in range(150))
    clean = [(k, text(0.3), lang, None, None) for k, lang in enumerate(["en"] * 40 + [None] * 2)]
    junk = [(100 + k, text(0), lang, None, None) for k, lang in enumerate(["en"] * 5 + [None])]
    other = [(200 + k, text(0), "fi", None, None) for k in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(kept[r[0]] for r in clean) and not any(kept[r[0]] for r in junk)
    # a language whose texts have none of the words is not judged by them
    assert all(r["kept"] for r in rules.judged(spark.createDataFrame(clean + other, SCHEMA)).collect())


def test_black_box_templates_see_whole_prefixes():
    last_20 = lambda turns: "".join(f"{t};" for _, t in turns[-20:])
    late = lambda turns: ("long:" if len(turns) >= 18 else "") + "".join(f"{t};" for _, t in turns)
    many = [("user", f"t{k}") for k in range(40)]
    for template, first in ((last_20, 20), (late, 17)):
        inc = chat.Incremental(template)
        spans = [inc.add(t) for t in many]
        assert spans == chat.locate(many, template)[1]
        assert [s.rewritten is None for s in spans[: first + 1]] == [True] * first + [False]

    def strict(turns):
        if turns and turns[0][0] != "user":
            raise ValueError("a user begins")
        return "".join(f"{r}:{t};" for r, t in turns)

    inc = chat.Incremental(strict)
    turns = [(("user", "assistant")[k % 2], str(k)) for k in range(41)]
    assert "".join(inc.add(t).text for t in turns) == strict(turns)
    assert chat.Incremental().local


EDGES = (-(2**63), -5, 0, 2**62, 2**63 - 1)


def test_ids_over_the_whole_range(spark):
    """Hashed 64-bit ids."""
    line = "a line that all documents hold"
    table = spark.createDataFrame([(d, f"{line}\nown {d} and more") for d in EDGES], "doc_id long, text string")
    for batches in (1, 4):
        out = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(table, batches=batches).collect()}
        assert out == {d: ("" if d > min(EDGES) else line + "\n") + f"own {d} and more" for d in EDGES}
    assert line_dedup.digests(table).where("n_dropped = 1").count() == 4
    assert simhash.near_duplicates(table).count() == sharding.shard_documents(table).count() == substrings.dedup_substrings(table).count() == 5


CLASH = ["_id", "__id", "_key", "_lost", "_stay", "_won", "ids", "score", "predicted", "shard", "grown_shard", "audio", "media", "kept_text", "spans", "n_lines", "fp", "node", "slot", "a.b", "quality", "bucket", "h1"]


def test_clashing_columns(spark):
    """Further columns pass; one named like what an operator adds is replaced."""
    given = [(k, t, *["x"] * len(CLASH)) for k, t in ((1, "one line of text\n" * 3), (2, "one line of text\nother"), (None, None), (4, ""))]
    table = spark.createDataFrame(given, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    made = {
        "lines": (line_dedup.dedup_lines(table), {"kept_text", "n_lines", "n_dropped"}),
        "substrings": (substrings.dedup_substrings(table), {"kept_text", "spans", "n_lost_words"}),
        "simhash": (simhash.one_of_each(table), set()),
        "sharding": (sharding.assign(table, [1.0, 2.0], [1.0]), {"shard", "grown_shard"}),
        "quality": (quality.classify(table, labels), {"score", "predicted"}),
        "bpe": (bpe.encode(table), {"ids"}),
        "media": (mpeg_audio.probe(mpeg_audio.to_media(table)), {"media", "audio"}),
    }
    for name, (out, new) in made.items():
        assert set(out.columns) == set(table.columns) | new and len(out.columns) == len(set(out.columns)), name
        got = out.collect()
        assert len(got) == 4 or name == "simhash", name
        assert all(r[c] == "x" for r in got for c in set(CLASH) - new), name


def frames_of(media: bytes) -> list[tuple[int, int]]:
    """(place, length) of the frames of a mono 32 kHz MPEG 1 layer III stream behind its first tag, read bit by bit."""
    kbit = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at = 10 + sum(b << s for b, s in zip(media[6:10], (21, 14, 7, 0)))
    found = []
    while media[at : at + 3] != b"TAG" or len(media) - at != 128:
        assert media[at] == 0xFF and media[at + 1] == 0xFA and media[at + 2] & 15 == 8 and media[at + 3] == 0xC0
        n = 144 * kbit[media[at + 2] >> 4] * 1000 // 32000
        crc = 0xFFFF
        for byte in media[at + 2 : at + 4] + media[at + 6 : at + 23]:
            for k in range(7, -1, -1):
                top = crc >> 15 ^ byte >> k & 1
                crc = crc << 1 & 0xFFFF ^ 0x8005 * top
        assert crc == int.from_bytes(media[at + 4 : at + 6], "big")
        found.append((at, n))
        at += n
    return found


def test_audio_by_an_independent_walk(docs):
    made = {(r["doc_id"], r["text"]): bytes(r["media"]) for r in mpeg_audio.to_media(docs).collect()}
    got = Counter(tuple(r) for r in mpeg_audio.media_digests(docs).collect())
    want = Counter()
    for d, t, *_ in rows():
        media, raw = made[d, t], (t or "").encode()
        table, *audio = frames_of(media)
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert b"".join(media[a + 23 : a + n] for a, n in audio)[: len(full)] == full and media[table[0] + 23 : table[0] + 27] == b"Xing"
        seek = sha256(",".join(str(a) for a, _ in audio).encode()).hexdigest()[:16]
        n, mean = len(audio), sum(k * 32000 // 144 for _, k in audio) // len(audio)
        feature = f"mpeg1 layer3 32000Hz 1ch frames={n} samples={1152 * n} us={36000 * n} bitrate={mean} crc={n + 1}/{n + 1} skipped=0 tags=id3v2.4+id3v1 table=xing:{n} seek={seek}"
        want[d, len(raw), len(full), sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), sha256(media).hexdigest(), feature] += 1
    assert got == want


def test_texts_that_imitate_tags_and_frames(spark):
    room = mpeg_audio._ROOM[14]
    texts = []
    for size in (room * 15 // 64 * 64, room - room % 64, 64 * 23):
        for tail in ("APETAGEXabcd  ", "APETAGEX\xd0", "APETAGEX\x07\x00", "TAG", "ID3\x04", "Xing", "VBRI", "\xff\xfb\x90\x64"):
            for before in (0, 8, 12, 18, 20, 24, 32, 100, 128):
                end = tail + "y" * before
                texts.append("x" * max(0, size - len(end.encode())) + end)
    # a full last frame whose last 32 bytes are a valid footer, over tags that reach to any frame
    for reach in (32, 64, 1440, 1440 * 2, 1440 * 3):
        footer = b"APETAGEX" + (2000).to_bytes(4, "little") + reach.to_bytes(4, "little") + bytes(16)
        payload = bytes(room * 192 - 32) + footer
        media = mpeg_audio.write(payload)
        assert len(payload) % 64 == 0 and mpeg_audio.stored(media, mpeg_audio.read(media)) == payload
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in mpeg_audio.media_digests(table).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        assert got[k]["payload_sha256"] == sha256(raw + bytes(-len(raw) % 64)).hexdigest() and "skipped=0" in got[k]["feature"]
    # real tags at the end, each behind the other, behind frames of any kind
    one = bytes((0xFF, 0xFF, 0x10, 0xC0)) + bytes(28)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16)
    s = mpeg_audio.read(one * 4 + bytes(8) + ape + b"TAG" + bytes(125))
    assert s.tags == ["id3v1", "ape"] and len(s.headers) == 4 and s.skipped == 0
    assert mpeg_audio.read(one * 4 + b"junk" + b"TAG" + bytes(125)).skipped == 4


@pytest.mark.parametrize("version,layer,mode,rate_bits,index", [(1, 1, 0, 0, 9), (1, 1, 1, 1, 9), (1, 1, 3, 2, 5), (1, 2, 0, 0, 9), (1, 2, 1, 0, 9), (1, 2, 3, 2, 1), (1, 2, 3, 0, 2), (1, 2, 0, 1, 9), (2, 2, 0, 0, 8), (2, 2, 1, 1, 8), (2, 2, 3, 0, 8)])
def test_checksums_of_layers_one_and_two(version, layer, mode, rate_bits, index):
    """A frame of random allocations, its covered bits counted one by one."""
    rng = random.Random(version * 100 + layer * 10 + mode)
    word = bytes((0xFF, 0xE0 | {1: 3, 2: 2}[version] << 3 | (4 - layer) << 1, index << 4 | rate_bits << 2, mode << 6 | 1 << 4))
    h = mpeg_audio.header(word)
    assert h.protected and h.layer == layer
    channels, bound = (1, 32) if mode == 3 else (2, 8 if mode == 1 else 32)
    if layer == 1:
        widths = [4] * 32
    elif version == 2:
        widths = [4] * 4 + [3] * 7 + [2] * 19
    else:
        each = h.bitrate // channels // 1000
        widths = ([4, 4] + [3] * (10 if h.rate == 32000 else 6)) if each <= 48 else [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each <= 80 else 7)
    bits, scfsi = [], 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = rng.choice([0, rng.randrange(1 << width)])
            bits += [value >> k & 1 for k in range(width - 1, -1, -1)]
            scfsi += 2 * (value > 0) * (1 if band < bound else channels)
    if layer == 2:
        bits += [rng.randint(0, 1) for _ in range(scfsi)]
    crc = 0xFFFF
    for b in [word[k] >> j & 1 for k in (2, 3) for j in range(7, -1, -1)] + bits:
        crc = crc << 1 & 0xFFFF ^ 0x8005 * (crc >> 15 ^ b)
    rest = bits + [rng.randint(0, 1) for _ in range(8 * (h.size - 6) - len(bits))]
    frame = word + crc.to_bytes(2, "big") + bytes(sum(b << 7 - j for j, b in enumerate(rest[k : k + 8])) for k in range(0, len(rest), 8))
    s = mpeg_audio.read(frame * 3)
    assert (s.crc_checked, s.crc_failed, len(s.headers)) == (3, 0, 3)
    wrong = bytearray(frame)
    wrong[6] ^= 1
    assert mpeg_audio.read(bytes(wrong) * 3).crc_failed == 3


def test_substrings_by_brute_force(docs):
    """Owners, spans and what is left, from the chunks of each text alone."""
    how = substrings.Chunking()
    cut = {}
    holders = defaultdict(set)
    for d, t, *_ in rows():
        raw = (t or "").encode()
        ends = substrings.cuts(raw, how).tolist()
        parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
        cut[d, t] = parts
        if d is not None:
            for pair in zip(parts, parts[1:]) if len(parts) > 1 else [(p,) for p in parts]:
                holders[pair].add(d)
    want = Counter()
    for d, t, *_ in rows():
        parts = cut[d, t]
        n, out = len(parts), [False] * len(parts)
        for k in range(max(1, n - 1) if n else 0):
            pair = tuple(parts[k : k + 2])
            if d is not None and min(holders[pair]) < d:
                out[k : k + len(pair)] = [True] * len(pair)
        spans, at, k = [], 0, 0
        while k < n:
            j = k
            while j < n and out[j] == out[k]:
                j += 1
            piece = b"".join(parts[k:j])
            if out[k] and sum(1 if len(w) <= how.stretch else len(w) // 8 for w in piece.split()) >= 16:
                spans.append((at, at + len(piece)))
            at, k = at + len(piece), j
        raw = (t or "").encode()
        left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
        want[d, left.decode(), tuple(spans)] += 1
    got = Counter((r["doc_id"], r["kept_text"], tuple((s["start"], s["end"]) for s in r["spans"])) for r in substrings.dedup_substrings(docs).collect())
    assert got == want and any(spans for _, _, spans in want)


def test_rendezvous_by_brute_force(docs):
    import math
    import struct

    def won(key, shards):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        found = []
        for s in range(shards):
            u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 12) + 0.5) / 2**52
            found.append((-1 / math.log(u), s))
        return max(found)[1]

    got = sharding.shard_documents(docs).collect()
    assert all(r["shard"] == won(r["doc_id"], 40) and r["grown_shard"] == won(r["doc_id"], 41) for r in got)


def test_rules_by_brute_force(spark):
    """References, distances and verdicts from the texts, in plain loops."""
    import math

    rng = random.Random(13)
    odd = lambda: " ".join("".join(rng.choices("abcdxyz#$1 ", k=7)) for _ in range(60))
    given = [(k, prose(rng, rng.randint(30, 90)), "en", None, None) for k in range(25)] + [(100 + k, odd(), lang, None, None) for k, lang in enumerate(["en", "en", None, "zz", "zz", "xx", "xx", "xx"])] + [(200, "", "en", None, None), (201, None, None, None, None), (202, prose(rng, 60), "xx", None, None)]
    for how in (rules.Limits(least_docs=3), rules.Limits(least_docs=3, largest=1), rules.Limits(least_docs=1000)):
        hists, base = {}, {}
        for d, t, *_ in given:
            words, *found = rules.base_counts(t)
            chars = [0] * len(rules.CLASSES)
            for c in t or "":
                chars[rules.char_class(c)] += 1
            common = [0] * (len(rules.COMMON) + 1)
            for w in (t or "").split():
                w = re.sub("[A-Z]", lambda m: m[0].lower(), w.strip(".,;:!?\"'()[]"))
                common[rules.COMMON.index(w) if w in rules.COMMON else -1] += 1
            hists[d], base[d] = (chars, common), len(words) < 20 or 100 * found[3] > 30 * len(words)
        least = (how.least_chars, how.least_words)
        refs = {}
        for lang in {r[2] for r in given} - {None}:
            own = [hists[d] for d, _, la, *_ in given if la == lang and not base[d] and all(sum(h) >= n for h, n in zip(hists[d], least))]
            if len(own) >= how.least_docs:
                sums = [[sum(h[k][i] * 1_000_000 // sum(h[k]) for h in own) for i in range(len(own[0][k]))] for k in (0, 1)]
                refs[lang] = (len(own), [[x / sum(s) for x in s] for s in sums])
        big = sorted(refs, key=lambda x: (-refs[x][0], x))[: how.largest]

        def distance(h, q):
            p = [x / sum(h) for x in h]
            m = [(a + b) / 2 for a, b in zip(p, q)]
            return math.sqrt(max(0, sum(a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m) if b)) / 2)

        def ok(h, ref, k):
            if sum(h[k]) < least[k]:
                return True
            limit = how.most_chars if k == 0 else how.most_words
            if k and 1 - ref[1][-1] >= how.least_common:
                limit = min(limit, how.most_of_plain * distance([0] * len(rules.COMMON) + [1], ref[1]))
            return distance(h[k], ref[k]) <= limit

        want = {}
        for d, _, lang, *_ in given:
            if lang in refs:
                stay = all(ok(hists[d], refs[lang][1], k) for k in (0, 1))
            elif big:
                stay = any(ok(hists[d], refs[x][1], 0) and (lang is not None or ok(hists[d], refs[x][1], 1)) for x in big)
            else:
                stay = True
            want[d] = stay and not base[d]
        got = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame(given, SCHEMA).repartition(3), how).collect()}
        assert got == want
    # junk alone in its language has no reference of its own
    assert not want[200]
    alone = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame([(k, prose(rng, 80), "en", None, None) for k in range(30)] + [(99, "$#1& " * 3 + " ".join(f"{k}#$%{k}" for k in range(70)), "qq", None, None)], SCHEMA)).collect()}
    assert not alone[99] and all(alone[k] for k in range(30))


def test_network_by_brute_force():
    """Pooled features, the forward pass and the temperature, number by number."""
    import math

    rng = np.random.default_rng(3)
    space = quality.Space(buckets=64, dims=6)
    vectors = rng.normal(size=(64, 6))
    for text in ("One two TWO two three\n4 5", "", None, "x"):
        tokens = space.tokens(text).tolist()
        n = max(1, len(tokens))
        want = [sum(vectors[t][k] for t in tokens) / n for k in range(6)] + [tokens.count(space.caps) / n, tokens.count(space.again) / n, len(set(tokens)) / n, math.log(1 + len(tokens)) / 10]
        assert quality.pooled(text, space, vectors) == pytest.approx(want)
    x = rng.normal(size=(400, 10))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    net = quality.train(x, y)
    for row in x[:20]:
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, j])) + net.b1[j]) for j in range(len(net.b1))]
        logit = sum(a * w for a, w in zip(hidden, net.w2)) + net.b2
        assert net.probability(row[None])[0] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)))
    aside = np.arange(400) % 5 == 4

    def loss(t):
        p = 1 / (1 + np.exp(-net.logit(x[aside]) / t))
        return -np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p))

    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 80)))
    assert np.mean((net.probability(x) > 0.5) == (y == 1)) > 0.85


def test_runs_are_merged_without_shuffle_or_sort(spark):
    """A batch meets a run's buckets as they lie; compaction leaves each hash once, under its first owner."""

    def batch(low, high):
        ids = spark.range(low, high).repartition(3)
        return ids.select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), (F.col("id") + low).alias("owner")).groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"))

    runs = line_dedup.LevelledRuns(spark, 2)
    try:
        with line_dedup._ordered_scans(spark):
            runs.add(runs.met(batch(0, 400)))
            joined = runs.met(batch(300, 700))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            run_side = plan[plan.index("SortMergeJoin") :].split("FileScan")[0].splitlines()
            left = max(k for k, x in enumerate(run_side) if "Range" in x)
            assert not any("Sort" in x or "Exchange" in x for x in run_side[left + 1 :])
            written = runs.add(joined)
            assert {r["h2"]: r["known"] for r in written.collect()} == {k: k if k < 400 else None for k in range(300, 700)}
            runs.compact()
            assert [len(level) for level in runs.levels] == [0, 1]
            assert {r["h2"]: r["owner"] for r in runs._rows(runs.tables()[0]).collect()} == {k: k if k < 400 else k + 300 for k in range(700)}
    finally:
        runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("arcwell_run_")]
