"""Ingest, catalog mutations and searches over a store."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from corvale.plans import ingest
from corvale.plans.indexes import Indexes, checked_name
from corvale.plans.service import Service
from corvale.sources import pages
from corvale.sources.store import Store, to_json_rows

DIM = 32


load = partial(ingest.hash_embedder, DIM)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    s = Service(store, load, DIM)
    s.indexes.seed()
    s.indexes.create("second", embedding_dimension=DIM)
    rows = [(f"https://ex.com/{i}", f"# Doc {i}\n\nText about topic{i} and zebra{i % 3}. " * 3) for i in range(8)] + [("https://ex.com/tiny", "tiny"), ("https://ex.com/copy", "# Doc 0\n\nText about topic0 and zebra0. " * 3)]
    s.ingest(spark.createDataFrame(rows, "url string, content string"))
    return s


def test_ingest_drops_short_and_copies(service):
    d = service.store.read("documents")
    assert d.count() == 8 and d.where("is_processed").count() == 8
    chunks = service.store.read("document_chunks")
    assert sorted(r["id"] for r in chunks.collect()) == list(range(1, chunks.count() + 1))
    assert sorted(r["faiss_index"] for r in chunks.collect()) == list(range(chunks.count()))
    assert service.store.read("embeddings").count() == chunks.count()


def test_ingest_again_adds_nothing(service, spark):
    before = service.store.read("documents").count()
    service.ingest(spark.createDataFrame([("https://ex.com/1", "another text of some length")], "url string, content string"))
    assert service.store.read("documents").count() == before
    with pytest.raises(ValueError, match="does not exist"):
        service.ingest(spark.createDataFrame([("https://ex.com/z", "another text of some length")], "url string, content string"), "nowhere")


@pytest.mark.parametrize("kind", ["vector", "keyword", "hybrid"])
def test_search(service, kind):
    got = service.search(["topic3"], 3, kind).collect()
    assert got[0]["url"] == "https://ex.com/3" and got[0]["title"] == "Doc 3" and len(got) <= 3
    again = service.search(["topic3"], 2, kind, use_reranking=True).collect()
    assert again[0]["url"] == "https://ex.com/3"


def test_other_searches(service):
    assert service.search(["topic3"], 3, "keyword", index_name="second", index_scoped=True).count() == 0
    inside = service.search_in_document("topic1", 2).collect()
    ids = {r["id"] for r in service.store.read("document_chunks").where("document_id = 2").collect()}
    assert inside and {r["chunk_id"] for r in inside} <= ids
    assert service.search_all_indexes("topic5", 2).count() == 2
    assert service.sources(limit=5).count() == 5
    assert service.statistics().first()["documents"] == 8
    with pytest.raises(ValueError, match="characters"):
        service.search([""])


def test_index_catalog(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    own = Indexes(store)
    own.seed()
    own.create("extra", embedding_dimension=DIM)
    with pytest.raises(ValueError, match="exists"):
        own.create("extra")
    with pytest.raises(ValueError, match="letters"):
        checked_name("a b")
    text = spark.createDataFrame([("https://ex.com/a", "some longer content " * 3)], "url string, content string")
    ingest.store_documents(store, text, "extra")
    ingest.process_documents(store, load, DIM, index_name="extra")
    ingest.store_code_examples(store, spark.createDataFrame([(1, "x = 1", "python", "sets x")], "document_id long, code string, language string, summary string"), load, DIM, "extra")
    assert own.update_statistics("extra")["total_documents"] == 1
    assert own.statistics("extra")["types"].first()["crawl_type"] == "webpage"
    own.remove_vectors(spark.createDataFrame([(1,)], "chunk_id long"))
    assert own.vectors("extra").count() == 0 and own.vectors("extra", live=False).count() == 2
    assert ingest.rebuilt_positions(store.read("embeddings").where("kind = 'chunk'"), store.read("document_chunks")).first()["position"] == 0
    session = own.start_session("https://ex.com", "recursive", 2, 10)
    assert own.session(session)["status"] == "started"
    with pytest.raises(ValueError, match="default"):
        own.delete("default")
    assert own.delete("extra", delete_documents=True)["documents_deleted"] == 1
    assert [store.read(t).count() for t in ("documents", "document_chunks", "embeddings", "code_examples")] == [0, 0, 0, 0]
    assert [r["name"] for r in own.list().collect()] == ["default"]
    store.drop()
    assert store.read("documents").count() == 0


def test_pages(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return f"<html><head><title>t</title></head><body><h1>Head &amp; more</h1><script>x</script><p>Text of {url}</p></body></html>"

    got = pages.fetch(spark.createDataFrame([("https://ex.com/a",), ("https://ex.com/bad",)], "url string"), get, 2)
    one = pages.outcome(got).first()
    assert (one["stored"], one["failed"], one["success"]) == (1, 1, False) and one["errors"] == ["https://ex.com/bad: OSError: no route"]
    assert pages.page_documents(got.where("error is null")).first()["content"] == "Head & more\nText of https://ex.com/a"
    with pytest.raises(ValueError, match="concurrent"):
        pages.fetch(got, get, 50)


def test_json_rows(spark):
    row = spark.range(1).select(F.lit("2024-01-02 03:04:05").cast("timestamp").alias("t"), F.lit(None).cast("string").alias("n"))
    assert to_json_rows(row).first()["json"] == '{"t":"2024-01-02T03:04:05.000000","n":null}'


def test_command_line(spark, tmp_path, capsys):
    from corvale.__main__ import main

    main(["create", str(tmp_path / "s")])
    main(["stats", str(tmp_path / "s")])
    assert "vector_indexes: 1" in capsys.readouterr().out
    main(["reset", str(tmp_path / "s")])
    assert "has vector_indexes" in capsys.readouterr().out
