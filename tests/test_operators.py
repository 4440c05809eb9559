"""Operators on small fixtures: chunkers, ranking, fusion, deduplication, crawl, tasks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvale.operators import bm25, catalog, chunking, crawl, dedup, rerank, search
from corvale.streaming import tasks


def plain_chunks(text, size):
    """The default chunker, stated independently as a loop."""
    out, at = [], 0
    while at < len(text):
        if at + size >= len(text):
            end = len(text)
        else:
            window = text[at : at + size]
            cuts = [window.rfind("```"), window.rfind("\n\n"), window.rfind(". ")]
            if cuts[0] > size * 0.3:
                end = at + cuts[0]
            elif cuts[1] >= 0:
                end = at + (cuts[1] if cuts[1] > size * 0.3 else size)
            elif cuts[2] >= 0:
                end = at + (cuts[2] + 1 if cuts[2] > size * 0.3 else size)
            else:
                end = at + size
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def test_original_chunker(spark):
    r = random.Random(5)
    texts = ["a" * 10 + "\n\n" + "b" * 68 + ". " + "c" * 68, "", "short", "é" * 250]
    texts += ["".join(r.choice(["word ", "end. ", "\n\n", "```", "x" * 30, "ü"]) for _ in range(r.randint(1, 120))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {}
    for row in chunking.chunk_original(df, size=100, least=0).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(row["doc_id"], []).append(row["content"])
    assert got == {i: c for i, t in enumerate(texts) if (c := plain_chunks(t, 100))}


@given(st.text(alphabet="ab .\n#-`A", max_size=900))
@settings(max_examples=60, deadline=None)
def test_advanced_chunker_covers_text(text):
    own = chunking.Chunker(100, 20, 10, 200)
    pieces = own.chunks(text)
    stripped = text.strip()
    assert all(piece.strip() for piece, _, _ in pieces)
    assert [a for _, a, _ in pieces] == sorted(a for _, a, _ in pieces)
    if len(stripped) >= 10 and pieces:
        assert pieces[-1][2] <= len(stripped) + 200


def test_advanced_boundaries():
    text = "Intro text here. " * 8 + "\n## Head\n" + "More text there. " * 8
    first = chunking.Chunker(120, 0, 10, 400).chunks(text)[0]
    assert first[2] == text.index("\n## Head")
    assert chunking.Chunker().chunks("x" * 49) == []
    assert [p for p, _, _ in chunking.simple_chunks("One two. Three four five", 12, 0)] == ["One two.", "Three four", "five"]


def test_merge_of_similar_neighbours():
    assert len(chunking.merged([["a b c", 0, 5], ["a b c", 5, 10], ["x y", 10, 13]], 100)) == 2


def test_specialized_choice(spark):
    df = spark.createDataFrame([(1, "def a():\n    pass\n" * 20, "text_file", "u/x.py"), (2, "# Head\n\n" + "text " * 50, "webpage", "u"), (3, "plain words. " * 20, "webpage", "u")], "doc_id long, text string, crawl_type string, url string")
    assert {r["doc_id"] for r in chunking.chunk_specialized(df).collect()} == {1, 2, 3}
    assert chunking.chunk(df, "unknown").count() == chunking.chunk_original(df).count()


def test_context_leaves_gaps_empty(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d")], "doc_id long, chunk_index int, content string")
    got = [(r["context_before"], r["context_after"]) for r in chunking.with_context(df).orderBy("chunk_index").collect()]
    assert got == [("", "b"), ("a", ""), ("", "")]


@pytest.mark.parametrize(("n", "want"), [(1, 0), (2, 0), (3, 1)])
def test_bm25_of_small_corpora(spark, n, want):
    chunks = spark.createDataFrame([(1, "zebra")] + [(i, "other") for i in range(2, n + 1)], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "zebra")], "query_id long, query_text string")
    got = bm25.keyword_search(bm25.build(chunks), q, 5).collect()
    assert len(got) == want
    if got:
        assert round(got[0]["keyword_score"], 5) == round(2 * 0.510826, 5)  # the term and its plural


def hits(spark, rows, name):
    return spark.createDataFrame([(1, c, s, i) for i, (c, s) in enumerate(rows, 1)], f"query_id long, chunk_id string, {name} double, rank int")


def test_fusion(spark):
    v, k = hits(spark, [("c1", 0.9), ("c2", 0.5), ("c3", 0.1)], "similarity"), hits(spark, [("c2", 4.0), ("c4", 2.0)], "keyword_score")
    got = [(r["chunk_id"], r["combined_score"]) for r in search.fuse(v, k).orderBy("rank").collect()]
    assert got == [("c1", 0.7), ("c2", 0.65), ("c3", 0.0), ("c4", 0.0)]
    flat = search.fuse(hits(spark, [("a", 0.5), ("b", 0.5)], "similarity"), hits(spark, [], "keyword_score")).collect()
    assert {r["combined_score"] for r in flat} == {0.7}
    with pytest.raises(ValueError, match="weights"):
        search.checked_weights(0.7, 0.7)


def test_vector_search_skips_deleted_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [1.0, 0.1], True), (3, [0.0, 0.0], False), (4, [0.0, 1.0], False)], "chunk_id long, embedding array<float>, deleted boolean")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vec array<float>")
    assert [r["chunk_id"] for r in search.vector_search(v, q, 3).orderBy("rank").collect()] == [1, 4]
    assert [r["chunk_id"] for r in search.vector_search(v, q, 3, "l2").orderBy("rank").collect()] == [1, 3, 4]
    assert [r["chunk_id"] for r in search.vector_search(v, q, 3, threshold=0.5).collect()] == [1]


def test_approximate_recall(spark, sf_dir):
    from corvale.queries import QUERIES

    exact = {(r["query_id"], r["chunk_id"]) for r in QUERIES["vector_topk_ip"](spark, sf_dir).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in QUERIES["vector_approximate"](spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_rerank_is_a_permutation(spark):
    rows = [(1, "database class", i, f"{'database ' * i}text {i}", 1.0 - i / 10, i) for i in range(1, 6)]
    c = spark.createDataFrame(rows, "query_id long, query_text string, chunk_id long, content string, combined_score double, rank int")
    for strategy in ("hybrid", "bm25", "quality", "anything"):
        got = rerank.rerank(c, strategy, 3).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and {r["chunk_id"] for r in got} <= set(range(1, 6))
    grown = rerank.expanded_queries(c).first()["query_text"].split()
    assert grown == sorted(grown) and {"database", "class", "classes"} <= set(grown)


def test_dedup(spark):
    chunks = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, "B"), (2, 0, "A"), (2, 1, "C")], "document_id long, chunk_index int, content_hash string")
    got = sorted((r["document_id"], r["content_hash"]) for r in dedup.stored_chunks(chunks).collect())
    assert got == [(1, "A"), (1, "A"), (1, "B"), (2, "C")]
    batch = spark.createDataFrame([(1, "u1", "h1"), (2, "u1", "h2"), (3, "u3", "h1"), (4, "u4", "h4"), (5, "u5", "h5")], "id long, url string, content_hash string")
    stored = spark.createDataFrame([("u4", "x"), ("y", "h5")], "url string, content_hash string")
    assert [r["id"] for r in dedup.new_documents(batch, stored).collect()] == [1]


def test_bfs(spark):
    a = "https://a.com"
    edges = [(f"{a}/", f"{a}/{i}", i) for i in range(12)] + [(f"{a}/0", f"{a}/x", 0), (f"{a}/0", "https://b.com/", 1), (f"{a}/x", f"{a}/y", 0), (f"{a}/1", f"{a}/", 0)]
    e = spark.createDataFrame(edges, "src string, dst string, position int")
    got = crawl.bfs(e, f"{a}/", max_depth=2, max_pages=50).orderBy("visit_order").collect()
    assert [r["url"] for r in got] == [f"{a}/"] + [f"{a}/{i}" for i in range(10)] + [f"{a}/x"]
    assert crawl.bfs(e, f"{a}/", 2, 4).count() == 4


def test_catalog_limits(spark):
    d = spark.createDataFrame([(1, "A%b"), (2, "axb")], "id long, url string")
    assert [r["id"] for r in catalog.by_url(d, "a_b").collect()] == [1, 2]
    with pytest.raises(ValueError, match="limit"):
        catalog.by_url(d, "a", 500)
    t = spark.createDataFrame([("x",), ("x",), ("",), (None,), ("y",)], "v string")
    assert [(r["value"], r["n"]) for r in catalog.top_by_count(t, "v").collect()] == [("x", 2), ("y", 1)]


def test_tasks(spark):
    got = spark.createDataFrame([(3, 4), (7, 0), (150, 100)], "c long, t long").select(tasks.progress(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == [75.0, 7.0, 100.0]
    e = spark.sql("select * from values ('a','running',1L,4L,timestamp'2024-01-01 00:00:00'), ('a','completed',4L,4L,timestamp'2024-01-01 01:00:00'), ('a','running',2L,4L,timestamp'2024-01-01 02:00:00'), ('b','running',1L,2L,timestamp'2024-01-01 00:00:00') as t(task_id,status,current_item,total_items,ts)")
    states = tasks.latest_state(e)
    assert {r["task_id"]: r["status"] for r in states.collect()} == {"a": "completed", "b": "running"}
    assert {r["task_id"] for r in tasks.evicted(states, F.lit("2024-01-05").cast("timestamp")).collect()} == {"b"}
    assert {r["task_id"]: r["status"] for r in tasks.cancel(states, "b").collect()}["b"] == "cancelled"


def test_streams(spark, tmp_path):
    e = spark.sql("select * from values ('a','running',1L,4L,timestamp'2024-01-01 00:00:00'), ('a','failed',3L,4L,timestamp'2024-01-01 01:00:00'), ('b','running',1L,2L,timestamp'2024-01-01 00:00:00') as t(task_id,status,current_item,total_items,ts)")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = tasks.task_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r["task_id"], r["status"], r["percent"]) for r in spark.table("states").collect()} == {("a", "failed", 75.0), ("b", "running", 50.0)}
    seen = []
    tasks.ingest_stream(stream, lambda b: seen.append(b.count()), str(tmp_path / "c2"), on_batch=lambda n: 1 / 0).awaitTermination(60)
    assert sum(seen) == 3
