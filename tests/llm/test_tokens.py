"""Packing, the store, sharding and the lattice against direct statements."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest

from corvale.llm import lattice, packing, sharding, store
from corvale.llm.registry import tokenizer_file
from corvale.llm.tokens import WordEncoder

SCHEMA = "doc_id long, text string, part string, ids string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = ["", None, "One, two. Three!", "a" * 3000, " ".join(r.choice(["tion", "The,", "élan", "it's", "9"]) for _ in range(6000)), "same text", "same text", "<|endoftext|> x<|startoftext|>y", "  é Ω"]
    return list(enumerate(texts)) + [(5, "same text"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", "q") for i, t in rows], SCHEMA).repartition(3)


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    r = random.Random(3)
    pool = "aBéÉ́Ω,.'s<|>9  ×÷tß!\n"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["<|endoftext|>.", "a<|endoftext|>!b", "ab<|startoftext|>,", "ÀÉ, it'S 123'll"]
    own = WordEncoder(tokenizer_file(), most=500)
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        ids, counts = own.encode([t.encode() for t in part], 1)
        ends = np.cumsum(counts)
        for t, a, b in zip(part, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == ids_of(t), t


def test_packing(docs, rows):
    got = packing.pack(docs, tokenizer_file(), 64, 1, with_ids=True).collect()
    by_row = collections.defaultdict(list)
    place = collections.Counter()
    for p in got:
        assert p["length"] <= 64 and p["offset"] + p["length"] <= 64 and crc(np.frombuffer(p["ids"], "<u4")) == p["ids_crc32"]
        by_row[p["doc_id"]].append((p["start"], p["ids"], p["doc_tokens"]))
        place[p["sequence_id"]] += p["length"]
    total = sum(len(ids_of(t)) for _, t in rows)
    assert [place[k] for k in sorted(place)] == [64] * (total // 64) + [total % 64] * (total % 64 > 0)
    for i in (0, 1, 2, 3, 4):
        parts = sorted(by_row[i])
        assert np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist() == ids_of(rows[i][1])
    last = packing.sequences(packing.pack(docs, tokenizer_file(), 64, 1, with_ids=True), 64).orderBy("sequence_id").collect()
    assert all(len(s["ids"]) == 64 for s in last[:-1]) and len(last) == len(place)
    assert packing.pack(docs.limit(0), tokenizer_file()).count() == 0


def test_store(spark, docs, rows, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(docs, path, tokenizer_file(), 1)
    got = sorted(map(tuple, store.read_digests(spark, path, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows if i is not None), key=lambda x: x) or got[0][0] is None
    at = 0
    want = collections.Counter((i, len(ids_of(t)), crc(ids_of(t))) for i, t in rows)
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    for r in got:
        assert r[1] == at
        at += r[2]
    chunks = spark.read.schema(store.CHUNKS).parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in store.read_documents(spark, path, 2).collect()}
    assert back[4] == ids_of(rows[4][1]) and back[3] == ids_of(rows[3][1])
    recipes = spark.read.schema(store.RECIPES).parquet(f"{path}/recipes").collect()
    spark.createDataFrame([tuple(r) for r in recipes[1:]], store.RECIPES).write.mode("overwrite").parquet(f"{path}/recipes2")
    spark.read.parquet(f"{path}/recipes2").write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.verified_recipes(spark, path)


def test_cuts_follow_content():
    ids = np.random.default_rng(0).integers(0, 40_000, 20_000).astype(np.uint32)
    a = store.cut_points(ids)
    b = [x - 777 for x in store.cut_points(np.r_[np.arange(777, dtype=np.uint32), ids])]
    assert a[-1] == len(ids) and len(set(a) & set(b)) > 0.8 * len(a)
    assert all(y - x <= store.MOST for x, y in zip([0, *a], a, strict=False)) and store.cut_points(ids[:1]) == [1]


def test_crc_shares():
    r = random.Random(5)
    raw = bytes(r.randrange(256) for _ in range(5000))
    cuts = sorted(r.sample(range(5000), 9))
    parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, 5000], strict=True)]
    tails = 5000 - np.cumsum([len(p) for p in parts])
    assert np.bitwise_xor.reduce(store.shifted_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), tails)) == zlib.crc32(raw)


def test_merkle_root():
    assert store.merkle_root([b"a", b"b", b"c"]) != store.merkle_root([b"a", b"c", b"b"])
    assert len(store.merkle_root([])) == 32


def test_sharding(spark):
    r = random.Random(6)
    rows = [(i, "x" * r.choice([0, 10, 100, 1000])) for i in range(600)] + [(1000 + i, "hot text") for i in range(300)] + [(5, None), (5, None), (None, "y")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.shard(df, 7).collect()
    assert collections.Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == collections.Counter((i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard = collections.defaultdict(list)
    for g in got:
        by_shard[g["shard"]].append(g)
    assert sorted(by_shard) == list(range(7))
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    sizes = [sum(x["size"] for x in own) for own in by_shard.values()]
    assert max(sizes) <= 1.05 * min(sizes)
    assert sharding.shard(df.limit(0), 7).count() == 0


def test_tokens_between_any_white_space_are_balanced(spark):
    """Texts of equal bytes: many tokens by newlines, tabs or in a script without spaces, or a single one."""
    rows = [(i, f"{i:04d}" + ("\nab" * 300, "\tab" * 300, "語" * 300, "x" * 900)[i % 4]) for i in range(160)]
    tokens = {i: 1 if i % 4 == 3 else 301 for i, _ in rows}
    sums = collections.Counter()
    for g in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect():
        sums[g["shard"]] += tokens[g["doc_id"]]
    assert max(sums.values()) <= 1.04 * min(sums.values())


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    where = collections.defaultdict(set)
    for g in got:
        where[g["doc_id"] // 3].add(g["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_lattice_sums_all_segmentations():
    scores = {b"a": -1.0, b"b": -1.5, b"ab": -0.7, b" ": -2.0, b" a": -0.9, b"ba": -1.1}

    def all_ways(raw):
        return 1.0 if not raw else sum(math.exp(s) * all_ways(raw[len(p) :]) for p, s in scores.items() if raw.startswith(p))

    own = lattice.Lattice(scores)
    raws = [b" ab", b" abab", b"", b" " + b"ab" * 6, b"b", b" " + b"a" * 70]
    for raw, got in zip(raws[:5], own.words(raws[:5]), strict=True):
        assert math.isclose(got, math.log(all_ways(raw)), abs_tol=1e-9)
    assert math.isclose(own.words(raws[5:])[0], own.word(raws[5]), abs_tol=1e-9)


def test_scores(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "Tion", "é", "word", "rare%d" % r.randrange(30)]) for _ in range(r.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (7, "the the"), (None, "x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, chunk int")
    path = tokenizer_file("piece_bpe_32k.model")
    got = collections.defaultdict(list)
    for g in lattice.score(df, path).collect():
        got[g["doc_id"]].append(g)
    words = {k: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for k, (_, t) in enumerate(rows)}
    train = [not lattice.held_out(i) for i, _ in rows]
    c = collections.Counter(w for k, t in enumerate(train) if t for w in words[k])
    ends = sum(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    sp = lattice.model(path)
    pieces = collections.Counter()
    for w, m in c.items():
        for p in sp.encode(w.decode()):
            pieces[p] += m
    raws = lattice.piece_bytes(path)
    usable = [i for i, x in enumerate(raws) if x is not None]
    mass = sum(pieces[i] + 1 for i in usable) + ends + 1
    p = collections.defaultdict(float)
    for i in usable:
        p[raws[i]] += (pieces[i] + 1) / mass

    def marginal(raw):
        a = [1.0]
        for i in range(1, len(raw) + 1):
            a.append(sum(a[j] * p.get(raw[j:i], 0.0) for j in range(i)))
        return math.log10(a[-1])

    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[k]) + math.log10((ends + 1) / (n + v + 1))
        full = sum(marginal(b" " + w) for w in words[k]) + math.log10((ends + 1) / mass)
        assert any(
            (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (not train[k], len(words[k]) + 1, sum(c[w] > 0 for w in words[k]) + 1, n)
            and math.isclose(g["base_score"], base, abs_tol=1e-6) and math.isclose(g["score"], full, abs_tol=1e-6) for g in got[i]
        )
    assert lattice.score(df.limit(0), path).count() == 0
