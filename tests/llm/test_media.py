"""Pages, audio and language identification."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from corvale.llm import audio, langid, wrapper

PAGE = '<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu {i}</a></ul></nav><div id="cookie-notice">Cookies!</div><div class="ad">Buy {i}</div>{body}<aside>Side</aside><form><label>Mail</label></form><div class="comments"><p>Nice {i}</p></div><footer>&copy; {i}</footer></body></html>'


def page(i, body):
    return PAGE.format(i=i, body=body)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page(1, "<article><h1>Head &amp; tail</h1><p>One <b>bold</b>word<br>next<p>Two&nbsp; \n x</article>"), "Head & tail One boldword next Two x"),
        (page(1, "<main><p>Text</p><script>var t='</p>';</script><!-- <p>no</p> --><ul><li>a<li>b</ul></main>"), "Text a b"),
        (page(1, '<div class="post-content"><p>Body</p></div>'), "Body"),
        ("<p>Plain <i>text", "Plain text"),
        ("<article><p>Cut &am", "Cut &am"),
        ("", ""),
        (None, ""),
        ("no tags & more", "no tags & more"),
        ('<article><p title="a>b">x</p><article class="comment"><p>c</p></article></article>', "x"),
    ],
)
def test_content_of_a_page(html, want):
    assert " ".join(t for _, t in wrapper.Page(html or "").content()) == want


def test_tree_matching():
    a, b = wrapper.Page("<div><p>1<p>2<ul><li>x</ul><p>3</div>"), wrapper.Page("<div><p>9<ul><li>y<li>z</ul><p>8</div>")
    m = wrapper.Matcher()
    partner = m.align(a, m.shape(a), b, m.shape(b))
    pairs = {(a.tags[x], b.tags[y]) for x, y in enumerate(partner) if y >= 0}
    assert all(x == y for x, y in pairs) and partner.count(-1) == 1
    used = [y for y in partner if y >= 0]
    assert used == sorted(used) and len(used) == len(set(used))


def test_template_text_goes(spark):
    body = "<article><p>Subscribe to us today</p><p>Story {i} of many words</p><p>{j}</p></article>"
    rows = [(i, f"https://h.org/{i}", page(i, body.format(i=i, j="same twice" if i < 2 else f"end {i}"))) for i in range(12)]
    rows += [(100, "https://one.org/", page(1, "<article><p>Alone</p></article>")), (101, None, None), (102, "odd", ""), (3, "https://h.org/3", page(3, body.format(i=3, j="end 3")))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, nodes int")
    got = collections.defaultdict(list)
    for r in wrapper.extract(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[5] == ["Story 5 of many words end 5"] and got[0] == ["Story 0 of many words same twice"]
    assert got[3] == ["Story 3 of many words end 3"] * 2
    assert (got[100], got[101], got[102]) == (["Alone"], [""], [""])
    assert wrapper.extract(df.limit(0)).count() == 0


def test_each_host_has_a_reference(spark):
    """Ten short pages and a long one: none is of half to one mean length. Ids may be null."""
    body = "<article><p>Read our daily letter</p><p>{text}</p></article>"
    rows = [(i, f"https://skew.org/{i}", page(i, body.format(text=f"Story {i} " + "abc" * 40))) for i in range(10)]
    rows += [(10, "https://skew.org/10", page(10, body.format(text="Story 10 " + "long " * 10_000))), (11, "https://skew.org/11", "")]
    rows += [(None, f"https://null.org/{i}", page(i, body.format(text=f"Other {i} " + "xyz" * 40))) for i in range(8)]
    texts = [r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(texts) == 20 and sum("Story" in t for t in texts) == 11 and sum("Other" in t for t in texts) == 8
    assert not any("daily letter" in t for t in texts)


def test_shapes_are_forgotten_between_pairs():
    """With any bound on remembered shapes the nodes are the same."""
    import pyarrow as pa

    pages = [wrapper.Page(page(i, "<article>" + "<p>a</p><ul><li>b</ul>" * (i % 7) + f"<p>{i}</p></article>")) for i in range(30)]
    rows = []
    for i, p in enumerate(pages):
        own = {"labels": [wrapper._label(x) for x in p.labels], "parents": p.parents, "nodes": [e for e, _, _ in p.blocks], "marks": [wrapper._mark(t) for _, t, _ in p.blocks]}
        rows.append({"rid": i, "host": "h", "digest": i, "sizes": [1], "links": [0], "own": [True], **own})
    batch = pa.RecordBatch.from_pylist([r | {f"ref_{c}": rows[3][c] for c in ("labels", "parents", "nodes", "marks")} for r in rows])
    want = next(wrapper._aligned(iter([batch]))).to_pydict()
    assert max(map(max, want["at"])) > 3
    for most in (0, 10, 40, 60):
        assert next(wrapper._aligned(iter([batch]), most)).to_pydict() == want


def test_near_copies_vote_once(spark):
    """Revisions of one article, and paragraphs only few pages reach, aren't template; a line of all different pages is."""
    def rows_of(host, first, bodies):
        return [(first + i, f"https://{host}/{i}", page(i, "<article><p>Read our daily letter</p>" + "".join(f"<p>{p}</p>" for p in body) + "</article>")) for i, body in enumerate(bodies)]

    story = [f"Paragraph {k} of the one long story" for k in range(10)]
    revised = [[*story[: i % 10], f"Revision {i} of this part of the story", *story[i % 10 + 1 :]] for i in range(30)]
    others = [[f"Piece {i} on something {k} else {i * k}" for k in range(4)] for i in range(8)]
    deep = [[f"Long page {i} part {k} number {i * k}" for k in range(20)] + ["The end is near, they all say at last"] for i in range(6)]
    short = [[f"Short page {i} part {k} number {i * k}" for k in range(3)] for i in range(20)]
    rows = rows_of("copies.org", 0, revised) + rows_of("mixed.org", 100, revised + others) + rows_of("deep.org", 200, deep + short)
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, body in enumerate(revised):
        assert got[i].endswith(" ".join(body)) and got[100 + i] == " ".join(body)
    assert [got[130 + i] for i in range(8)] == [" ".join(b) for b in others]
    assert [got[200 + i] for i in range(26)] == [" ".join(b) for b in deep + short]


WORDS = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<div class="layout has-sidebar"><article><p>{WORDS}</article><div class="sidebar">Side</div></div>', WORDS),
        (f'<div class="no-sidebar"><div class="post-content"><p>{WORDS}</div><div class="comments"><p>{WORDS} {WORDS}</div></div>', WORDS),
        (f'<div class="layout has-sidebar"><p>{WORDS}</p><div class="sidebar">Side</div></div>', WORDS),
        (f'<form action="x"><nav>Menu</nav><p>{WORDS}</p><select><option>a</select></form>', WORDS),
        (f'<article><h2>One</h2><p>{WORDS}</p><section id="discussion"><h2 id="discussion-1">Two</h2><p>More</p></section></article>', f"One {WORDS} Two More"),
        (f'<article><p>{WORDS}</p><section id="related"><ul><li><a href="x">Link</a></ul></section></article><div class="related"><article>Card</article></div>', WORDS),
        (f'<div class="post-content"><p>{WORDS}</div><div class="post-content"><p>Second</div>', f"{WORDS} Second"),
        (f'<article><p>Teaser</article><div class="content"><p>{WORDS}</div>', f"Teaser {WORDS}"),
        (f'<p>{WORDS}</p><p><a href="x">A paragraph that is a link</a></p><ul><li><a href="y">Menu</a></ul>', f"{WORDS} A paragraph that is a link"),
        (f'<p>Body of the page</p><div class="related"><article>Card</article></div><div class="cookie-notice">{WORDS}</div>', "Body of the page"),
        (f'<article><p>Short</article><div class="comments"><div class="post">{WORDS}</div></div><div class="sidebar-content">{WORDS} {WORDS}</div>', "Short"),
    ],
)
def test_content_inside_wrappers(html, want):
    assert " ".join(t for _, t in wrapper.Page(f"<html><body>{html}</body></html>").content()) == want


# --- audio -------------------------------------------------------------------------


def test_expansion_tables():
    assert (audio.MU_TABLE[0], audio.MU_TABLE[255], audio.MU_TABLE[128]) == (-32124, 0, 32124)
    assert (audio.A_TABLE[0x55], audio.A_TABLE[0xD5], audio.A_TABLE[0x2A], audio.A_TABLE[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(audio.A_TABLE.tolist())) == 256 and (np.sort(audio.MU_TABLE) == -np.sort(-audio.MU_TABLE[::-1])[::-1]).all()


def test_adpcm_equals_a_loop():
    blocks = np.random.default_rng(0).integers(0, 256, (20, 64)).astype(np.uint8)

    def one(row):
        sample, index = int(np.frombuffer(row[:2].tobytes(), "<i2")[0]), min(int(row[2]), 88)
        out = [sample]
        for byte in row[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.IMA_STEPS[index])
                change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
                index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
                out.append(sample)
        return out

    assert (audio.ima_decode(blocks) == np.array([one(b) for b in blocks])).all()


@pytest.mark.parametrize("rate", [16000, 48000, 11025, 6000, 8000])
def test_resampled_tone(rate):
    tone = lambda n, r: 10000 * np.sin(2 * np.pi * 440 * np.arange(n) / r)
    got = audio.resample(tone(8000, 8000).astype(np.int16), 8000, rate)
    assert len(got) == rate and np.abs(got - tone(rate, rate))[300:-300].max() < 40
    assert len(audio.resample(np.zeros(0, np.int16), 8000, rate)) == 0


def test_wav_round_trip():
    for codec, block in ((audio.MU_LAW, 1), (audio.A_LAW, 1), (audio.IMA, 64)):
        assert audio.from_wav(audio.to_wav(b"x" * 64, 8000, codec, block)) == (codec, 8000, block, b"x" * 64)
    with pytest.raises(ValueError, match="not a WAV"):
        audio.from_wav(b"RIFX")


def test_media_columns(spark):
    rows = [(1, "text"), (2, ""), (3, None), (4, "é" * 500), (5, "text"), (5, "text"), (None, "z" * 576), (7, "long " * 5000)]
    df = spark.createDataFrame([(i, t, "m", "f") for i, t in rows], "doc_id long, text string, media string, feature string")
    media = audio.store(df)
    got = audio.describe(media).collect()
    features = collections.defaultdict(set)
    for r in got:
        options = [(t or "").encode() for i, t in rows if i == r["doc_id"]]
        payloads = [t + b"\xff" * (-len(t) % 576 if t else 576) for t in options]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) in [(len(t), len(p), hashlib.sha256(p).hexdigest()) for t, p in zip(options, payloads, strict=True)]
        assert r["tail_crc32"] in [zlib.crc32(p[-32:]) for p in payloads] and r["media_bytes"] > r["payload_bytes"]
        features[options[0]].add((r["feature"], r["media_sha256"]))
    assert len(got) == len(rows) and all(len(f) == 1 for f in features.values())
    pcm = {r["doc_id"]: r["pcm"] for r in audio.decode(media).collect()}
    assert len(pcm[1]) == 576 * 2 * 2
    assert audio.describe(audio.store(df.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [r["pcm"] for r in audio.decode(bad).collect()] == [None, None]


def test_resampled_pcm_is_stored(spark):
    import glob

    files = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/corvale-pcm-*"))
    before = files()
    media = audio.store(spark.createDataFrame([(i, "some text " * i) for i in range(6)], "doc_id long, text string"))
    got = {r["doc_id"]: r["feature"] for r in audio.describe(media).collect()}
    (path,) = files() - before
    stored = {r["doc_id"]: bytes(r["pcm"]) for r in spark.read.parquet(path).collect()}
    assert stored == {r["doc_id"]: bytes(r["pcm"]) for r in audio.decode(media).collect()}
    assert all(got[i].endswith(f";pcm16000={zlib.crc32(stored[i]):08x}") for i in range(6))


# --- language ----------------------------------------------------------------------

PARTS = {"aa": "ka ta ra na ma", "bb": "öl üb äch sch ung", "cc": "tion ing the er st"}


def sentence(r, lang, n):
    own = PARTS[lang].split()
    return " ".join("".join(r.choice(own) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_backpropagation_equals_differences():
    g = np.random.default_rng(3)
    net = langid.Network(["a", "b"], 3, 6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, target = g.integers(1, 5, (6, 4)), g.normal(size=(6, 4, 3))

    def loss():
        return float((net._run(x, "f", False)[0].astype(np.float64) * target).sum())

    _, tape = net._run(x, "f", True)
    grads = {}
    net._back(x, "f", tape, target, grads)
    for name in ("xf", "uf"):
        for at in [(1, 0), (2, 4), (2, 8), (0, 5)] if name == "uf" else [(1, 0), (2, 4), (3, 8), (4, 5)]:
            step = 1e-2
            net.w[name][at] += step
            up = loss()
            net.w[name][at] -= 2 * step
            down = loss()
            net.w[name][at] += step
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2


def test_training_lowers_loss():
    g = np.random.default_rng(3)
    net = langid.Network(["a", "b"], 3, 6)
    x, y = g.integers(1, 9, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.position_sums(x)[np.arange(4), y] / 6).mean()
    before = loss()
    net.train(x, y, 120, batch=4)
    assert loss() < 0.3 * before


def test_inference_equals_training_pass():
    net = langid.Network(["a", "b", "c"], 5, 16)
    x = np.random.default_rng(1).integers(0, 256, (7, 16)).astype(np.uint8)
    both = np.concatenate([net._run(x.T, d, False)[0] for d in "fb"], 2)
    p = np.exp(both @ net.w["o"] + net.w["c"])
    p = p / p.sum(2, keepdims=True) * (x.T != 0)[..., None]
    assert np.allclose(net.position_sums(x), p.sum(0), atol=1e-4)


def test_identify(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, lang := r.choice(list(PARTS)), r.randint(8, 60)), lang) for i in range(400)]
    odd = [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, sentence(r, "bb", 30), None), (3, rows[3][1], rows[3][2]), (903, sentence(r, "cc", 20_000), None)]
    df = spark.createDataFrame([(*x, "s") for x in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df, steps=150).collect()
    by_id = {g["doc_id"]: g for g in got}
    assert len(got) == len(rows) + len(odd)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by_id[903]["lang_pred"] == "cc" and by_id[None]["lang_pred"] == "bb"
    held = [g for g in got if g["held_out"] and g["doc_id"] is not None and g["doc_id"] < 400]
    truth = {i: lang for i, _, lang in rows}
    assert sum(g["lang_pred"] == truth[g["doc_id"]] for g in held) >= 0.95 * len(held) > 30
    assert all(0 <= g["score"] <= 1 for g in got)
    kept = langid.keep_identified(df, 0.4, steps=150)
    assert kept.columns == df.columns and not {900, 901, 902} & {k["doc_id"] for k in kept.collect()}
    assert {g["lang_pred"] for g in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_windows_read_every_byte():
    raw = bytes(range(256)) * 3
    assert b"".join(w.tobytes() for w in langid.windows(raw, 64)).replace(b"\0", b"") == raw.replace(b"\0", b" ")


def test_documents_stay_without_any_label(spark):
    rows = [(i, f"some words {i}", None, "s") for i in range(20)] + [(50, None, None, "s"), (51, "123 !!", None, "s"), (52, "", None, "s")]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 0.4)
    assert sorted(k["doc_id"] for k in kept.collect()) == list(range(20))
