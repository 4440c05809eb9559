"""Queries over a store that whole tables were ingested into, and of functions that no other query calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale import oracles as O
from corvale.functions import text as T
from corvale.functions import url as U
from corvale.functions import vector as V
from corvale.operators import catalog, search
from corvale.plans.ingest import hash_embedder
from corvale.plans.service import Service
from corvale.plans.tools import Tools
from corvale.queries import both_queries, candidates, chunk_rows, documents, query, stored_index, table, task_events, units, vectors
from corvale.session import shared_folder
from corvale.sources import pages as P
from corvale.sources.store import Store, listed
from corvale.streaming import tasks

_SERVICES: dict[tuple, Service] = {}


def service(spark, sf_dir) -> Service:
    """A service over a store that all documents were ingested into, once for these input files."""
    d = documents(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(d.inputFiles()))
    if key not in _SERVICES:
        own = Service(Store(spark, f"{shared_folder(spark)}/corvale-service-{uuid.uuid4().hex}"), hash_embedder, 64)
        own.indexes.seed()
        own.ingest(d.select("url", "content", "source_id", "crawl_type"))
        own.indexes.update_statistics("default")
        _SERVICES[key] = own
    return _SERVICES[key]


#: Stored documents: enough content, of equal contents the first by url, numbered by url; and their chunks, of equal ones those of the first document.
STORED = f"""{O.chunks(5000)}, {O.DOCS.replace("d AS (", "alld AS (")},
one AS (SELECT * FROM alld WHERE len(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 10 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY url) = 1),
s AS (SELECT row_number() OVER (ORDER BY url) AS id, id AS doc_id, * EXCLUDE (id) FROM one),
sc AS (SELECT s.id AS document_id, chunk_index, ch.content, md5(ch.content) AS content_hash FROM ch JOIN s USING (doc_id) QUALIFY s.id = min(s.id) OVER (PARTITION BY md5(ch.content))),
c AS (SELECT row_number() OVER (ORDER BY document_id, chunk_index) AS id, * FROM sc)"""


@query(
    f"""WITH {STORED} SELECT id, url, title, content_hash, source_id, regexp_extract(url, '//([^/]*)', 1) AS domain, len({O.words("content")})::INTEGER AS word_count, len(content)::INTEGER AS char_count, crawl_type, TRUE AS is_processed FROM s"""
)
def stored_documents(spark, sf_dir):
    return service(spark, sf_dir).store.read("documents").select("id", "url", "title", "content_hash", "source_id", "domain", "word_count", "char_count", "crawl_type", "is_processed")


@query(f"WITH {STORED} SELECT id, document_id, chunk_index, content_hash, len(content)::INTEGER AS char_count, id - 1 AS faiss_index FROM c")
def stored_chunk_rows(spark, sf_dir):
    return service(spark, sf_dir).store.read("document_chunks").select("id", "document_id", "chunk_index", "content_hash", "char_count", "faiss_index")


@query(f"WITH {STORED} SELECT id AS chunk_id, 'chunk' AS kind, 64 AS embedding_dimension, 64 AS size, 'default' AS index_name, FALSE AS deleted FROM c")
def stored_vectors(spark, sf_dir):
    return service(spark, sf_dir).store.read("embeddings").select("chunk_id", "kind", "embedding_dimension", F.size("embedding").alias("size"), "index_name", "deleted")


@query(f"WITH {STORED} SELECT id, id - 1 AS position FROM c")
def positions_of_chunks(spark, sf_dir):
    """Positions rebuilt from the stored vectors and chunks."""
    from corvale.plans.ingest import rebuilt_positions

    own = service(spark, sf_dir).store
    return rebuilt_positions(own.read("embeddings"), own.read("document_chunks")).select(F.col("chunk_id").alias("id"), "position")


@query(f"WITH {STORED} SELECT 'default' AS name, 'IndexFlatIP' AS index_type, (SELECT count(*) FROM s) AS total_documents, (SELECT count(*) FROM c) AS total_chunks, (SELECT count(*) FROM c) AS total_vectors, TRUE AS is_active")
def index_catalog(spark, sf_dir):
    return service(spark, sf_dir).indexes.list().select("name", "index_type", "total_documents", "total_chunks", "total_vectors", "is_active")


@query(f"WITH {STORED} SELECT crawl_type, count(*) AS n FROM s GROUP BY crawl_type")
def index_types(spark, sf_dir):
    return service(spark, sf_dir).indexes.statistics("default")["types"]


@query(f"WITH {STORED} SELECT (SELECT count(*) FROM s) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c) AS embeddings, 0 AS code_examples")
def service_statistics(spark, sf_dir):
    return service(spark, sf_dir).statistics()


@query(f"WITH {STORED} SELECT id, url, title, CASE WHEN len(content) > 500 THEN left(content, 500) || '...' ELSE content END AS content, crawl_type FROM s")
def listed_documents(spark, sf_dir):
    return listed("documents", service(spark, sf_dir).store.read("documents")).select("id", "url", "title", "content", "crawl_type")


@query(f"WITH {STORED}, m AS (SELECT * FROM s WHERE url ILIKE '%src1%' AND crawl_type = 'fr') SELECT id, count(c.id) AS chunk_count, coalesce(sum(len(c.content)), 0)::BIGINT AS content_length, (SELECT count(*) FROM m) AS total FROM (SELECT id FROM m ORDER BY id LIMIT 50) LEFT JOIN c ON document_id = m.id GROUP BY m.id".replace("SELECT id, count(c.id)", "SELECT m.id AS id, count(c.id)").replace("LIMIT 50) LEFT", "LIMIT 50) m LEFT"))
def sources_with_total(spark, sf_dir):
    """The tool's page of sources, and how many there are in all."""
    got = Tools(service(spark, sf_dir)).get_sources(limit=50, url_pattern="src1", source_type="fr", index_name="default")
    return got["sources"].select("id", "chunk_count", "content_length", F.lit(got["total_sources"]).cast("long").alias("total"))


@query(f"WITH {O.chunks(1000)} SELECT d.doc_id AS id, count(ch.doc_id) AS chunk_count, coalesce(sum(len(content)), 0)::BIGINT AS content_length, (SELECT count(*) FROM documents WHERE lang = 'de') AS total FROM (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 50 OFFSET 10) d LEFT JOIN ch ON ch.doc_id = d.doc_id GROUP BY d.doc_id")
def document_page_with_total(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "content")
    total, page = catalog.document_page(documents(spark, sf_dir), c, 50, 10, crawl_type="de")
    return page.select("id", "chunk_count", "content_length", F.lit(total).cast("long").alias("total"))


@query(
    """WITH d AS (SELECT 'index_' || (doc_id % 10) AS index_name, lang, source || '.example.com' AS domain FROM documents)
SELECT index_name, 'type' AS kind, lang AS value, count(*) AS n FROM d WHERE coalesce(lang, '') <> '' GROUP BY 1, 3
UNION ALL SELECT index_name, 'domain', domain, n FROM (SELECT index_name, domain, count(*) AS n FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY count(*) DESC, domain NULLS FIRST) <= 10) WHERE coalesce(domain, '') <> ''"""
)
def index_rollup(spark, sf_dir):
    return catalog.index_rollup(documents(spark, sf_dir).withColumn("domain", U.domain(F.col("url"))))


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s.,!?\\-:;]', ' ', 'g'), '\\.{{2,}}', '.', 'g'), '[!?]{{2,}}', '!', 'g'))"


@query(f"SELECT doc_id, len({CLEAN.format('text')}) >= 50 AS valid FROM documents")
def valid_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_valid_content(F.col("text")).alias("valid"))


@query(f"SELECT page_id, coalesce(nullif({O.NETLOC.format('url')}, ''), {O.PATH.format('url')}) AS source_id, string_split(url, '.')[-1] AS extension FROM pages")
def url_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.source_id(F.col("url")).alias("source_id"), U.extension(F.col("url")).alias("extension"))


@query("SELECT vec_id, len(embedding)::INTEGER AS size, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_checked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.size("embedding")).first()[0]
    own = e.select("vec_id", V.checked(F.col("embedding"), n).alias("e"))
    return own.select("vec_id", F.size("e").alias("size"), F.round(V.norm(F.col("e")), 6).alias("norm"))


@query(
    f"""WITH {O.hybrid(10)}, {O.DOCS.replace("d AS (", "dd AS (")}
SELECT query_id, chunk_id::VARCHAR AS chunk_id, dd.id::VARCHAR AS document_id, coalesce(nullif(title, ''), 'Untitled') AS title, url, CASE WHEN len(content) > 500 THEN left(content, 500) || '...' ELSE content END AS content,
 coalesce(nullif(crawl_type, ''), 'unknown') AS source_type, rank::INTEGER AS rank FROM ranked JOIN dd ON dd.id = chunk_id WHERE rank <= 10"""
)
def hydrated_hits(spark, sf_dir):
    """Hybrid hits with their chunk and document."""
    hits = search.hybrid_search(vectors(spark, sf_dir), stored_index(spark, sf_dir), both_queries(spark, sf_dir), 10)
    chunks = units(spark, sf_dir).withColumn("document_id", F.col("chunk_id"))
    return search.hydrate(hits, chunks, documents(spark, sf_dir)).select("query_id", "chunk_id", "document_id", "title", "url", "content", "source_type", "rank")


def _get(url: str) -> str:
    if not url.startswith("https"):
        raise OSError("no secure page")
    return f"<h1>{url}</h1>"


@query("SELECT url, CASE WHEN starts_with(url, 'https') THEN '<h1>' || url || '</h1>' END AS html, CASE WHEN NOT starts_with(url, 'https') THEN 'OSError: no secure page' END AS error FROM pages")
def fetched_pages(spark, sf_dir):
    return P.fetch(table(spark, sf_dir, "pages"), _get, 4)


@query("SELECT count(*) FILTER (starts_with(url, 'https')) AS stored, count(*) FILTER (NOT starts_with(url, 'https')) AS failed, count(*) FILTER (NOT starts_with(url, 'https')) = 0 AS success, array_to_string(list_sort(coalesce(list(url || ': OSError: no secure page') FILTER (NOT starts_with(url, 'https')), [])), chr(10)) AS errors FROM pages")
def fetch_outcome(spark, sf_dir):
    return P.outcome(P.fetch(table(spark, sf_dir, "pages"), _get, 4)).withColumn("errors", F.array_join("errors", "\n"))


@query("SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '(?m)^#+\\s+.+$'), '; '), '') AS headers, len(text)::INTEGER AS char_count FROM documents")
def document_headers(spark, sf_dir):
    return T.chunk_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "headers", "char_count")


@query()
def page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.page_markdown(F.col("html")).alias("content"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, count(*) AS n FROM events GROUP BY 1")
def task_events_by_status(spark, sf_dir):
    return catalog.count_by(task_events(spark, sf_dir), "status")


@query()
def task_percent(spark, sf_dir):
    """Percent done of all running tasks."""
    return tasks.active(tasks.latest_state(task_events(spark, sf_dir))).select("task_id", F.round("percent", 6).alias("percent"))


@query()
def search_tool(spark, sf_dir):
    """The tool's answer to one question: hybrid, reranked, above its default threshold."""
    own = Tools(service(spark, sf_dir)).search_documents("machine learning model deployment best practices production", max_results=20)
    return own["results"].select("document_id", "title", "url", F.round("combined_score", 6).alias("combined_score"), "rank")


@query()
def search_everywhere(spark, sf_dir) -> DataFrame:
    return service(spark, sf_dir).search_all_indexes("vector search with embeddings", 10, use_reranking=True).select("chunk_id", "index_name", F.round("final_score", 6).alias("final_score"), "rank")


@query()
def rerank_candidates(spark, sf_dir):
    """What reranking starts from: three times the results asked for, with their contents cut."""
    return candidates(spark, sf_dir).select("query_id", "chunk_id", "combined_score", "rank")
