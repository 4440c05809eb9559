"""The tool layer, markdown of pages, store pointers and locks, the model's lifecycle, and brute-force chunkers."""

import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvale.functions import text as T
from corvale.operators import catalog, chunking, crawl, dedup
from corvale.plans.ingest import Model, hash_embedder, process_documents, store_documents, tried
from corvale.plans.service import Service
from corvale.plans.tools import CRAWLS, SearchRequest, TaskTable, Tools, document_page, search_document, search_request, simple_search
from corvale.sources import pages as P
from corvale.sources.store import Store, listed
from corvale.streaming import tasks

SITE = {
    "https://ex.com": "<h1>Start</h1><p>Welcome to the vector search handbook</p><a href='/one'>One</a> <a href='/two'>Two</a> <a href='https://other.org/x'>Other</a>",
    "https://ex.com/one": "<h1>One</h1><p>Ranking with keywords and BM25 scores</p><a href='/three'>Three</a>",
    "https://ex.com/two": "<h1>Two</h1><p>Embeddings of chunks in a vector index</p>",
    "https://ex.com/three": "<h1>Three</h1><p>Sharding of large indexes over machines</p>",
    "https://ex.com/sitemap.xml": "<urlset><url><loc>https://ex.com/two</loc></url><url><loc>https://ex.com/three</loc></url></urlset>",
}


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    own = Service(Store(spark, str(tmp_path_factory.mktemp("tools"))), hash_embedder, dimension=64)
    own.indexes.seed()
    return Tools(own, SITE.__getitem__)


@pytest.fixture(scope="module")
def site(spark):
    return spark.createDataFrame(list(SITE.items()), "url string, html string")


def test_request_bounds():
    for bad in ({"query": ""}, {"query": "x" * 1001}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 51}, {"query": "x", "search_type": "odd"}, {"query": "x", "rerank_strategy": "odd"},
                {"query": "x", "similarity_threshold": 1.5}, {"query": "x", "vector_weight": 0.9, "keyword_weight": 0.3}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


def test_crawl_strategies(tools, site):
    assert tools.crawl_website("https://ex.com", strategy="odd", pages=site) == {"success": False, "error": f"Invalid strategy 'odd'. Must be one of: {', '.join(CRAWLS)}"}
    assert not tools.crawl_website("https://ex.com", index_name="none", pages=site)["success"]
    assert not tools.crawl_website("ftp://ex.com", pages=site)["success"]
    assert not tools.crawl_website(["https://ex.com/one"] * 101, strategy="batch", pages=site)["success"]
    urls = lambda *a: {r["url"] for r in tools.urls(*a).collect()}
    assert urls("https://ex.com", "single_page", 1, 9, site) == {"https://ex.com"}
    assert urls("https://ex.com", "recursive", 1, 9, site) == {"https://ex.com", "https://ex.com/one", "https://ex.com/two"}
    assert urls("https://ex.com", "recursive", 2, 9, None) == urls("https://ex.com", "recursive", 2, 9, site) == {f"https://ex.com{x}" for x in ("", "/one", "/two", "/three")}
    assert urls("https://ex.com", "sitemap", 1, 9, site) == {"https://ex.com/two", "https://ex.com/three"}
    dry = tools.crawl_website("https://ex.com", strategy="single_page", store_documents=False, pages=site)
    assert dry["success"] and (dry["pages_crawled"], dry["documents_stored"]) == (1, 0)


def test_tools_end_to_end(tools, site):
    empty = tools.search_documents("vector")
    assert empty["success"] and empty["total_results"] == 0 and "message" in empty
    got = tools.crawl_website(["https://ex.com", "https://ex.com/one", "https://ex.com/two", "https://ex.com/three", "https://ex.com/gone"], strategy="batch", pages=site)
    assert (got["pages_crawled"], got["documents_stored"], got["errors"]) == (4, 4, ["https://ex.com/gone: not among the pages"])
    assert tools.service.store.read("documents").where("url = 'https://ex.com/one'").first()["content"].startswith("# One")
    for kind in ("vector", "keyword", "hybrid"):
        found = tools.search_documents("vector index embeddings", search_type=kind, max_results=3)
        assert found["success"] and found["results"].first()["url"] == "https://ex.com/two" and found["total_results"] <= 3
    assert not tools.search_documents("x", search_type="odd")["success"] and not tools.search_documents("x", index_name="none")["success"]
    assert simple_search(tools.service, "sharding machines", 2).first()["url"] == "https://ex.com/three"
    with pytest.raises(LookupError):
        search_request(tools.service, SearchRequest("x", "none"))
    with pytest.raises(LookupError):
        search_document(tools.service, 999, "x")
    number = tools.service.store.read("documents").where("url = 'https://ex.com/two'").first()["id"]
    assert search_document(tools.service, number, "embeddings").count() >= 1
    every = tools.service.search_all_indexes("vector index embeddings", 3)
    ranked = tools.service.search_all_indexes("vector index embeddings", 3, use_reranking=True)
    assert every.count() == 3 and {r["index_name"] for r in every.collect()} == {"default"} and ranked.count() == 3 and "final_score" in ranked.columns
    sources = tools.get_sources(limit=2, url_pattern="ex.com")
    assert (sources["total_sources"], sources["sources"].count()) == (4, 2) and not tools.get_sources(limit=500)["success"]
    total, page = document_page(tools.service, limit=3, offset=3)
    assert (total, page.count()) == (4, 1) and page.first()["chunk_count"] == 1
    assert tools.service.keyword_statistics().first()["n"] == 4


def test_index_tools(tools):
    assert tools.create_index("extra", "Extra")["index"]["embedding_dimension"] == 64
    assert not tools.create_index("extra", "Extra")["success"] and not tools.create_index("bad name!", "Bad")["success"]
    made = tools.index_details("extra")
    assert made["success"] and made["types"].count() == 0 and tools.service.indexes.by_id(made["index"]["id"])["name"] == "extra"
    assert tools.list_indexes()["total_indexes"] == 2 and tools.refresh_index("extra")["index"]["total_documents"] == 0
    assert not tools.delete_index("default")["success"] and not tools.delete_index("none")["success"]
    assert tools.delete_index("extra")["success"] and tools.list_indexes()["total_indexes"] == 1


def test_task_table(spark, tools):
    own = TaskTable(tools.service)
    rows = [("a", "running", 1, 4, 1), ("a", "running", 2, 4, 2), ("b", "completed", 4, 4, 3), ("c", "failed", 1, 4, 90_000)]
    own.record(spark.createDataFrame(rows, "task_id string, status string, current_item long, total_items long, at long").withColumn("ts", F.timestamp_seconds("at")))
    assert own.status("a")["percent"] == 50.0 and not own.status("x")["success"]
    assert own.active()["active_crawls"] == 1 and not own.cancel("b")["success"]
    import datetime

    assert own.cleanup(24, datetime.datetime(1970, 1, 2, 2))["removed"] == 1 and not own.cleanup(0)["success"]
    assert own.cancel("a")["success"] and own.status("a")["status"] == "cancelled" and not own.cancel("a")["success"]


def test_stream_and_batch_agree_on_ties(spark, tmp_path):
    """Events of one time: the terminal one counts, then the higher number."""
    rows = [("a", "running", 5, 9, 1), ("a", "completed", 3, 9, 1), ("a", "failed", 2, 9, 1), ("a", "running", 9, 9, 2), ("b", "running", 7, 9, 4), ("b", "running", 8, 9, 4)]
    events = spark.createDataFrame(rows, "task_id string, status string, current_item long, total_items long, at long").select("task_id", "status", "current_item", "total_items", F.timestamp_seconds("at").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tasks.task_states(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("ties").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["task_id"], r["status"], r["current_item"]) for r in spark.table("ties").collect()}
    assert got == {(r["task_id"], r["status"], r["current_item"]) for r in tasks.latest_state(events).collect()} == {("a", "completed", 3), ("b", "running", 8)}


def test_pointers_and_locks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    before = store._version("documents")
    store.replace("documents", store.read("documents"))
    assert store._version("documents") != before and len(store._pointers("documents")) == 2
    with store.lock("documents"):
        with pytest.raises(TimeoutError), store.lock("documents", seconds=0.1):
            pass
    with store.lock("documents", seconds=0.1):
        pass
    for name in store.tables:
        assert not {"embedding", "doc_metadata", "config"} & set(listed(name, store.read(name)).columns)


def test_model(spark, tmp_path):
    model = Model(hash_embedder)
    assert model.info() == {"name": "hash", "loaded": False, "dimension": None} and model.dimension == 64
    model.warm_up()
    assert model.info()["loaded"]
    model.clear()
    assert not model.info()["loaded"]

    def picky():
        own = hash_embedder()

        def embed(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("too bad")
            return own(texts)

        return embed

    rows = spark.createDataFrame([(1, "fine"), (2, "poison"), (3, None)], "id long, text string")
    got = {r["id"]: (r["embedding"] is not None, r["error"]) for r in tried(rows, "id", "text", picky, 64).collect()}
    assert got == {1: (True, None), 2: (False, "RuntimeError: too bad"), 3: (True, None)}
    service = Service(Store(spark, str(tmp_path / "s")), picky, 64)
    service.indexes.seed()
    service.ingest(spark.createDataFrame([("https://ex.com/a", "Some fine content here"), ("https://ex.com/b", "Some poison content here")], "url string, content string"))
    marked = {r["url"][-1]: (r["is_processed"], r["processing_error"]) for r in service.store.read("documents").collect()}
    assert marked == {"a": (True, None), "b": (False, "RuntimeError: too bad")} and service.store.read("document_chunks").count() == service.store.read("embeddings").count() == 1
    service.load = hash_embedder
    process_documents(service.store, hash_embedder, 64)
    assert service.store.read("documents").where("is_processed AND processing_error IS NULL").count() == 2


def test_given_metadata_wins(spark, tmp_path):
    """A title in the metadata replaces the derived one, whatever the session does with repeated keys; one document of a url is stored."""
    store = Service(Store(spark, str(tmp_path / "s")), hash_embedder, 64)
    store.indexes.seed()
    rows = [("https://ex.com/a", "Some text of a page", {"title": "Given"}), ("https://ex.com/a", "Another text of it", None), ("https://ex.com/b", "Text of another page", None)]
    old = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        got = {r["url"][-1]: r["doc_metadata"] for r in store_documents(store.store, spark.createDataFrame(rows, "url string, content string, doc_metadata map<string,string>")).collect()}
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", old)
    assert set(got) == {"a", "b"} and got["b"]["title"] == "Text of another page"


# --- pages -------------------------------------------------------------------------


def test_references_and_text(spark):
    """Against the standard library, on pages of random references."""
    r = random.Random(4)
    refs = ["&amp;", "&lt;", "&copy;", "&#8217;", "&#x1F600;", "&#233;", "&eacute;", "&nope;", "&", "& b", "&amp;amp;", "&NotEqualTilde;", "&#0;x", "text", " "]
    texts = ["".join(r.choice(refs) for _ in range(r.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", P.decoded(F.col("t")).alias("d"))
    for row in df.collect():
        t = texts[row["i"]]
        want = re.sub(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", lambda m: m[0] if m[1] in ("nope", "#0") else entities.unescape(m[0]), t)
        assert row["d"] == want, t


def test_markdown(spark):
    page = "<html><head><title>T</title></head><body><script>x</script><h1>Head &amp; tail</h1><p>One <b>bold</b> and <em>soft</em> <a class='l' href='/x?a=1'>link</a>.</p><ul><li>a</li><li>b &#169;</li></ul><h3>Deep</h3><pre><code>x = 1\n  y</code></pre><p>End</p></body></html>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(P.page_markdown(F.col("h")).alias("m")).collect()
    assert got[0]["m"] == "# Head & tail\n\nOne **bold** and *soft* [link](/x?a=1).\n\n- a\n- b ©\n\n### Deep\n\n```\nx = 1\n  y\n```\n\nEnd" and got[1]["m"] == ""
    chunks = chunking.chunk_specialized(spark.createDataFrame([(1, got[0]["m"] * 9, "webpage", "u")], "doc_id long, text string, crawl_type string, url string"))
    assert chunks.first()["content"].startswith("# Head")


def test_sitemap_urls(spark):
    rows = spark.createDataFrame([("https://ex.com/sitemap.xml", "<loc> https://ex.com/a/ </loc><LOC>https://ex.com/b</LOC><loc>ftp://no</loc>"), ("x", None)], "url string, html string")
    assert {r["url"] for r in crawl.listed_urls(rows).collect()} == {"https://ex.com/a", "https://ex.com/b"}


# --- chunkers by brute force -------------------------------------------------------


def brute_cut(chunker, text, low):
    """The best cut of a window, from all matches in its own slice."""
    goal = low + chunker.size
    seen = text[low : goal + 200]
    found = {kind: [(low + m.start(), low + m.end()) for m in re.finditer(p, seen)] for kind, p in chunker.patterns.items()}
    near = lambda spans: sorted(spans, key=lambda s: abs(s[0] - goal))[:1]
    offers = [(a, 100) for a, _ in near(found["section"])]
    offers += [(a if goal - a < b - goal else b, 200) for a, b in found["code"] if a < goal < b]
    offers += [(a, 50) for a, _ in found["list"] if abs(a - goal) <= 100]
    offers += [(b, 50) for kind in ("paragraph", "sentence") for _, b in near(found[kind])]
    for at, slack in offers:
        if low < at <= goal + slack:
            return at
    spaces = [i for i in range(low + 1, goal) if text[i] == " "]
    return spaces[-1] if spaces else goal


def brute_windows(chunker, text):
    at, out = 0, []
    while at < len(text):
        last = at + chunker.size >= len(text)
        end = len(text) if last else brute_cut(chunker, text, at)
        out.append((at, end, last))
        if last:
            break
        at = max(at + 1, end - chunker.overlap)
    return out


TOKENS = ["word ", "end. ", "\n\n", "x" * 30, "ü", "\n# Head\n", "\n- item ", "\n1. ", "\n    code()\n", "...  A", "! B", "\n```py\n", "\n```\n", "<p>", "</div>", "\ndef f():", " ", "\t", "{", "\n}\n", "\nkey:\n", "Next"]
KINDS = [("advanced", None), ("semantic", None), ("code", "python"), ("code", "rust"), ("markdown", None), ("plain", None), ("html", None), ("structured", "json"), ("structured", "xml")]


@pytest.mark.parametrize(("kind", "language"), KINDS)
def test_boundary_chunkers_equal_brute_force(kind, language):
    from dataclasses import replace

    r = random.Random(11)
    for _ in range(120):
        text = "".join(r.choice(TOKENS) for _ in range(r.randint(0, 120))).strip()
        own = replace(chunking.preset(kind, language), size=r.choice([60, 100, 150]), overlap=r.choice([0, 20]), least=1, most=10**6)
        want = [(text[a:b].strip(), a, b) for a, b, _ in brute_windows(own, text) if text[a:b].strip()]
        got = [tuple(p) for p in own.chunks(text)]
        # with a least size of 1 only empty windows go; the rest, if empty, is put to the last piece
        if text and brute_windows(own, text)[-1][2] and not text[brute_windows(own, text)[-1][0] :].strip():
            got = [(c.removesuffix("\n\n"), a, b) for c, a, b in got[:-1]] + [(got[-1][0].removesuffix("\n\n"), got[-1][1], want[-1][2])]
        assert got == want


def test_small_and_large_pieces():
    """Small pieces go to the one before, large ones are cut after a stop or at a space."""
    own = chunking.Chunker(60, 0, 25, 70)
    text = "A sentence that is long enough to stay. " + "tiny. " + "y" * 100 + " and more words to end it all here. Bye"
    pieces = own.chunks(text)
    assert all(25 <= len(p) or i for i, (p, _, _) in enumerate(pieces)) and all(len(p) <= 70 for p, _, _ in pieces)
    assert "".join(re.sub(r"\s", "", p) for p, _, _ in pieces) == re.sub(r"\s", "", text)
    assert [p for p, _, _ in chunking.Chunker(10, 3, 1, 100, boundaries=False).chunks("one two three four")][:3] == ["one two", "two three", "ree four"]


@pytest.mark.parametrize(("size", "overlap"), [(12, 0), (30, 7), (1, 0), (2, 1), (40, 60)])
def test_simple_chunker_equals_brute_force(size, overlap):
    r = random.Random(size)
    for _ in range(100):
        text = "".join(r.choice(["ab", ".", " ", "c. ", "\n"]) for _ in range(r.randint(0, 60)))
        want, at = [], 0
        while at < len(text):
            end = at + size
            if end < len(text):
                stops = [i for i in range(at + 1, end) if text[i] == "."] or [i - 1 for i in range(at + 1, end) if text[i] == " "]
                end = stops[-1] + 1 if stops else end
            if text[at:end].strip():
                want.append([text[at:end].strip(), at, min(end, len(text))])
            at = max(at + 1, end - overlap)
        assert chunking.simple_chunks(text, size, overlap) == want


def test_merged_pairs():
    pieces = [["a b c", 0, 5], ["a b c", 5, 10], ["a b c", 10, 15], ["x", 15, 16], ["x", 16, 17]]
    assert chunking.merged(pieces, 100) == [["a b c\n\na b c", 0, 10], ["a b c", 10, 15], ["x\n\nx", 15, 17]]
    assert chunking.merged(pieces, 3) == [*pieces[:3], ["x\n\nx", 15, 17]] and chunking.merged([], 5) == []


def test_chunking_is_linear(spark):
    """A text of 3 MB in a few seconds, by the default chunker and by boundaries, with code and lists throughout."""
    import time

    text = ("Some words here. And more of them, to fill a line\n    code()\n- item\n\n" * 45_000)[:3_000_000]
    began = time.time()
    n = chunking.chunk_original(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=1000).count()
    assert n >= 3000 and len(chunking.Chunker().chunks(text)) > 3000
    assert time.time() - began < 60


def test_keywords_of_long_texts(monkeypatch):
    """One pass over the runs gives what scans give."""
    r = random.Random(2)
    words = ["a", "aa", "aaa", "Aaaa", "ab-ab", "Machine", "learning", "machine learning", "API", "x1", "é", "node.js", "c++", "vector", "vectors", "--", "İ"]
    texts = ["".join(r.choice(words) + r.choice([" ", "", ".", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    want = [T.keyword_choice(10)(t) for t in texts]
    monkeypatch.setattr(T, "SCANNED", -1)
    assert [T.keyword_choice(10)(t) for t in texts] == want


def test_new_documents_by_firsts(spark):
    rows = [(1, "u", "h1"), (2, "u", "h2"), (3, "v", "h1"), (4, "w", "h3"), (5, "old", "h9"), (6, "x", "oldh"), *((i, f"m{i}", "hot") for i in range(10, 60))]
    batch = spark.createDataFrame(rows, "id long, url string, content_hash string")
    stored = spark.createDataFrame([("old", "oldh")], "url string, content_hash string")
    assert sorted(r["id"] for r in dedup.new_documents(batch, stored).collect()) == [1, 4, 10]
    known = dedup.stored_chunks(batch.withColumnRenamed("id", "document_id"), stored)
    assert sorted(r["document_id"] for r in known.collect()) == [1, 2, 4, 5, 10]


def test_index_rollup(spark):
    d = spark.createDataFrame([("i", "t", "a")] * 3 + [("i", "s", "b"), ("j", None, "a")], "index_name string, crawl_type string, domain string")
    got = {tuple(r) for r in catalog.index_rollup(d, 1).collect()}
    assert got == {("i", "type", "t", 3), ("i", "type", "s", 1), ("i", "domain", "a", 3), ("j", "domain", "a", 1)}
    rates = spark.createDataFrame([(1, 10, 2.0), (2, 30, 3.0)], "batch int, n_texts long, seconds double")
    assert catalog.throughput(rates).first().asDict() == {"total": 40, "seconds": 5.0, "rate": 8.0, "last_rate": 10.0}
    assert np.isfinite(catalog.throughput(rates.withColumn("seconds", F.lit(0.0))).first()["rate"])
