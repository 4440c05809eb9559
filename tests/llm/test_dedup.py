"""Suffix dedup, near duplicates and containment against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from corvale.llm import contain, near, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, answers string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


# --- suffixes ----------------------------------------------------------------------


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_suffix_array(kinds):
    r = random.Random(kinds)
    for n in [*range(40), 500]:
        x = np.array([r.randint(1, kinds) for _ in range(n)], np.int64)
        assert suffixes.suffix_array(x, kinds + 1).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_joint_numbers_of_large_keys():
    got = suffixes._joint([[np.array([3, 1]), np.array([2])], [np.array([5, 9]), np.array([7])]], [1 << 40, 1 << 40])
    assert [g.tolist() for g in got] == [[2, 0], [1]]


def test_packed_numbers():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 34, 5000)).astype(np.uint64)
    assert (suffixes.unpack_sorted(suffixes.pack_sorted(v)) == v).all()
    assert len(suffixes.unpack_sorted(suffixes.pack_sorted(v[:0]))) == 0


def brute(rows, length=50):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1) if i is not None else ():
            first = seen.setdefault(raw[p : p + length], i)
            if first < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abc de") for _ in range(300)) for _ in range(6)]
    piece = lambda: r.choice([base[r.randrange(6)][r.randrange(200) :][: r.randint(20, 160)], "".join(r.choice("xyzé") for _ in range(r.randint(0, 30))), "a" * r.randint(0, 90)])
    return ["".join(piece() for _ in range(r.randint(0, 5))) for _ in range(n)]


def test_removed_bytes(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.randrange(100_000), t) for t in texts(1, 80)] + [(7, ""), (8, "a" * 4000), (9, "ab" * 3000), (5, None), (None, "a" * 200), (8, "a" * 4000), (11, "é" * 60), (12, "é" * 60)]
    monkeypatch.setattr(suffixes, "SUFFIX_BYTES", 4096)
    monkeypatch.setattr(suffixes, "SAMPLE_BYTES", 4096)
    got = [tuple(x) for x in suffixes.digests(frame(spark, rows).repartition(5), 50).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_deduplicated_keeps_columns(spark):
    passage = "the same passage of more than fifty bytes in two documents "
    df = frame(spark, [(1, passage + "one"), (2, "two " + passage + "end"), (3, None), (4, passage[:-1]), (None, passage)])
    got = {r["doc_id"]: r for r in suffixes.deduplicated(df).collect()}
    assert suffixes.deduplicated(df).columns == df.columns
    assert (got[2]["text"], got[2]["n_chars"], got[2]["chunk"]) == ("two end", 7, "x")
    assert got[3]["text"] is None and 4 not in got and got[None]["text"] == passage
    assert suffixes.deduplicated(df.limit(0)).count() == 0


# --- near duplicates ---------------------------------------------------------------


def near_brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(r, w, share):
    return [x if r.random() > share else f"w{r.randrange(10**6)}" for x in w]


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    r = random.Random(4)
    rows = []
    for _ in range(8):
        w = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 40, 200]))]
        rows += [(0, " ".join(edited(r, w, r.choice([0, 0.005, 0.02, 0.05])))) for _ in range(r.randint(1, 14))]
    rows += [(0, ""), (0, "  \n"), (0, "one"), (0, "ONE"), (0, "one two"), (0, "a b a b a b"), (0, None)]
    ids = r.sample(range(10_000), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    got = near.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == near_brute(rows, 3, 85, 100)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_near_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (3, "q r s t")]
    got = near.keep_one(frame(spark, rows), 3).collect()
    assert sorted([x["doc_id"] for x in got], key=repr) == [1, 1, 3, None, None]
    assert near.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["doc"]: r["component"] for r in near.components(edges).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100}


# --- containment -------------------------------------------------------------------


def test_containment(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"k{r.randrange(4000)}" for _ in range(r.choice([3, 6, 20, 60, 300])))) for i in range(25)] + [(90, None), (91, ""), (92, "Only Four words here"), (92, "Only Four words here"), (None, "five words that have no id")]
    docs = []
    for i in range(60):
        own = [f"d{r.randrange(10**6)}" for _ in range(r.choice([0, 30, 3000]))]
        item = words(r.choice(items)[1])
        cut = edited(r, item, r.choice([0, 0.02, 0.1]))
        at = r.randrange(len(own) + 1)
        docs.append((i, " ".join(own[:at] + [x.upper() if i % 2 else x for x in cut] + own[at:])))
    docs += [(70, None), (71, ""), (None, "x Five words that have no id x")]
    want = set()
    for d, t in docs:
        s = shingles(t, 5)
        for k, item in items:
            a = shingles(item, 5)
            if a and 5 * len(a & s) >= 4 * len(a):
                want.add((d, k, len(a), len(a & s)))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contain.contained(frame(spark, docs), b, 5, 4, 5)
    assert {(x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in got.collect()} == want and len(want) > 10
    left = contain.decontaminate(frame(spark, docs), b)
    assert sorted((x["doc_id"] for x in left.collect()), key=repr) == sorted((d for d, _ in docs if d not in {w[0] for w in want}), key=repr)
    assert left.columns == frame(spark, docs).columns
    assert contain.contained(frame(spark, docs), b.limit(0)).count() == contain.contained(frame(spark, docs).limit(0), b).count() == 0
