"""Queries over the given tables, one for each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvale import oracles as O
from corvale.functions import text as T
from corvale.functions import url as U
from corvale.operators import bm25, catalog, chunking, crawl, dedup, rerank, search
from corvale.session import shared_folder
from corvale.sources import pages as P
from corvale.streaming import tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CHUNK = 1000


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql:
            SQL[own] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), "doc_id").alias("url"), T.title(F.col("text")).alias("title"), F.col("text").alias("content"),
        F.md5("text").alias("content_hash"), F.col("source").alias("source_id"), F.col("lang").alias("crawl_type"), F.concat(F.lit("index_"), F.col("doc_id") % 10).alias("index_name"), F.timestamp_seconds("doc_id").alias("created_at"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the units of search."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_original(table(spark, sf_dir, "documents"), size=CHUNK)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


#: Stored keyword indexes by application and input files.
_STORED: dict[tuple, str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The keyword index of all documents, built and written once for these input files, then read."""
    docs = units(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(docs.inputFiles()))
    if key not in _STORED:
        path = f"{shared_folder(spark)}/corvale-bm25-{uuid.uuid4().hex}"
        built = bm25.build(docs)
        built.save(path)
        built.unpersist()
        _STORED[key] = path
    return bm25.load(spark, _STORED[key])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("index_"), "label").alias("index_name"), (F.col("vec_id") % 7 == 3).alias("deleted"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def both_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return text_queries(spark, sf_dir).join(e, "query_id")


# --- text --------------------------------------------------------------------------


@query(f"WITH {O.keywords('c', 'documents', 'doc_id', 'text', 10)} SELECT key AS doc_id, (r - 1)::INTEGER AS position, k AS keyword FROM ckw")
def keywords_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.corpus_keywords(10)(F.col("text")).alias("keywords"))
    return d.select("doc_id", F.posexplode("keywords").alias("position", "keyword"))


@query(f"WITH {O.tokens('q', 'benchmark', 'item_id', 'text', 15)} SELECT key AS item_id, term FROM qtok")
def search_terms(spark, sf_dir):
    return bm25.query_terms(text_queries(spark, sf_dir)).select(F.col("query_id").alias("item_id"), "term")


@query(
    f"""WITH {O.DOCS} SELECT id, title, len(content) AS char_count, len({O.words("content")}) AS word_count, left(content_hash, 32) AS content_hash, lower(regexp_extract(url, '//([^/]*)', 1)) AS domain FROM d"""
)
def doc_metadata(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("id", "title", F.length("content").cast("long").alias("char_count"), T.word_count(F.col("content")).cast("long").alias("word_count"), "content_hash", U.domain(F.col("url")).alias("domain"))


@query(
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}\\p{M}_\\s.,!?\\-:;]', ' ', 'g'), '\\.{2,}', '.', 'g'), '[!?]{2,}', '!', 'g')) AS cleaned FROM documents"""
)
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(
    f"""SELECT doc_id, round(CASE WHEN len(text) = 0 THEN 0.0 WHEN len(text) < 50 THEN 0.1 ELSE (least(len(text) / 1000, 1.0) + least(len({O.words("text")}) / 200, 1.0)) / 2 END, 6)::DOUBLE AS quality FROM documents"""
)
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.quality(F.col("text")), 6).alias("quality"))


@query(
    f"""WITH {O.tokens("c", "documents", "doc_id", "text", 50)}, {O.tokens("q", "benchmark", "item_id", "text", 15)}, n AS (SELECT key, count(*) AS n FROM qtok GROUP BY key)
SELECT q.key AS item_id, c.key AS doc_id, round(count(*) / any_value(n), 6) AS coverage FROM qtok q JOIN ctok c USING (term) JOIN n ON n.key = q.key GROUP BY q.key, c.key HAVING count(*) * 2 >= any_value(n)"""
)
def coverage(spark, sf_dir):
    """Documents that cover half of an item's tokens or more, by an inverted join of tokens."""
    asked = bm25.query_terms(text_queries(spark, sf_dir)).select("query_id", "term")
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    own = T.with_tokens(units(spark, sf_dir), "content", "tokens", 50, corpus=True).select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
    met = own.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("k")).join(sizes, "query_id").where(F.col("k") * 2 >= F.col("n"))
    return met.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round(F.col("k") / F.col("n"), 6).alias("coverage"))


# --- chunks ------------------------------------------------------------------------


@query(
    f"""WITH {O.chunks(CHUNK)} SELECT doc_id, chunk_index, content, md5(content) AS content_hash, len({O.words("content")})::INTEGER AS word_count, len(content)::INTEGER AS char_count FROM ch"""
)
def chunk_original(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", "content", "content_hash", "word_count", "char_count")


@query(
    f"""WITH {O.chunks(CHUNK)} SELECT doc_id, chunk_index, len(content)::INTEGER AS char_count, len({O.words("content")})::INTEGER AS word_count, len(string_split(content, chr(10)))::INTEGER AS line_count,
 contains(content, '```') AS has_code, contains(content, 'http') OR contains(content, 'www.') AS has_links FROM ch"""
)
def chunk_metadata(spark, sf_dir):
    own = T.chunk_metadata(chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", "content"), "content")
    return own.select("doc_id", "chunk_index", "char_count", "word_count", "line_count", "has_code", "has_links")


@query(
    f"""WITH {O.chunks(CHUNK)} SELECT doc_id, chunk_index, coalesce(right(lag(content) OVER w, 200), '') AS context_before, coalesce(left(lead(content) OVER w, 200), '') AS context_after FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""
)
def chunk_context(spark, sf_dir):
    return chunking.with_context(chunk_rows(spark, sf_dir), size=200).select("doc_id", "chunk_index", "context_before", "context_after")


@query(
    f"""WITH {O.chunks(CHUNK)}, ws AS (SELECT doc_id, chunk_index, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS w FROM ch)
SELECT a.doc_id, a.chunk_index, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM ws a JOIN ws b ON a.doc_id = b.doc_id AND b.chunk_index = a.chunk_index + 1 WHERE len(a.w) > 0 AND len(b.w) > 0"""
)
def chunk_jaccard(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    met = chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", "content", F.lead("content").over(order).alias("after")).where("after is not null")
    words = F.lit(r"[\p{L}\p{N}\p{M}_]")
    met = met.where(F.regexp_like("content", words) & F.regexp_like("after", words))
    return met.select("doc_id", "chunk_index", F.round(T.jaccard(F.col("content"), F.col("after")), 6).alias("similarity"))


def _chunker(kind: str, f: Callable[[DataFrame], DataFrame]) -> None:
    @query(name=f"chunk_{kind}")
    def run(spark, sf_dir):
        return f(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "content_hash", "word_count", "char_count", "start_char", "end_char")


for _kind, _language in (("advanced", None), ("semantic", None), ("code", "python"), ("markdown", None), ("plain", None), ("html", None), ("structured", "json")):
    _chunker(_kind, lambda d, k=_kind, lang=_language: chunking.chunk_advanced(d, chunker=chunking.preset(k, lang)))
_chunker("merged", lambda d: chunking.chunk_advanced(d, merge=True))
_chunker("simple", chunking.chunk_simple)
_chunker("fixed", chunking.chunk_fixed)
_chunker("specialized", lambda d: chunking.chunk_specialized(d.select("doc_id", "text", F.concat("source", F.lit(".py")).alias("url"), F.when(F.col("lang") == "en", "text_file").otherwise("webpage").alias("crawl_type")), kind="crawl_type"))

# --- keyword search ----------------------------------------------------------------


@query(f"WITH {O.BM25} SELECT any_value(n) AS n, round(any_value(m), 6) AS mean_length, count(*) AS n_terms, round(any_value(mean_idf), 6) AS mean_idf FROM cterms, cst")
def bm25_stats(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return index.terms.agg(F.count(F.lit(1)).alias("n_terms")).crossJoin(F.broadcast(index.stats)).select("n", F.round("mean_length", 6).alias("mean_length"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {O.BM25} SELECT query_id, chunk_id, keyword_score, rank::INTEGER AS rank FROM hits WHERE rank <= 10")
def keyword_search(spark, sf_dir):
    return bm25.keyword_search(stored_index(spark, sf_dir), text_queries(spark, sf_dir), 10)


# --- vectors -----------------------------------------------------------------------


@query(f"WITH {O.SIMILAR} SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM sim QUALIFY rank <= 10")
def vector_topk_ip(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "chunk_id", "similarity", "rank")


@query(
    f"""WITH {O.VECTORS}, {O.ASKED}, sim AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - qe[i]) * (e[i] - qe[i]))), 6) AS similarity FROM v, q WHERE NOT deleted)
SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity, chunk_id))::INTEGER AS rank FROM sim QUALIFY rank <= 10"""
)
def vector_topk_l2(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, "l2").select("query_id", "chunk_id", "similarity", "rank")


@query(
    f"WITH {O.SIMILAR}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM sim QUALIFY r <= 20) SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM h WHERE similarity >= 0.3 QUALIFY rank <= 10"
)
def vector_threshold(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, threshold=0.3, overfetch=2).select("query_id", "chunk_id", "similarity", "rank")


@query(
    f"WITH {O.SIMILAR} SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM sim WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= 10"
)
def vector_filtered_ids(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, allowed=allowed).select("query_id", "chunk_id", "similarity", "rank")


@query(
    f"WITH {O.SIMILAR} SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM sim WHERE index_name = 'index_3' QUALIFY rank <= 10"
)
def search_in_index(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, index_name="index_3").select("query_id", "chunk_id", "similarity", "rank")


@query(
    f"WITH {O.SIMILAR}, each AS (SELECT *, (row_number() OVER (PARTITION BY query_id, index_name ORDER BY similarity DESC, chunk_id))::INTEGER AS index_rank FROM sim QUALIFY index_rank <= 20) SELECT query_id, index_name, chunk_id, similarity, index_rank, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM each QUALIFY rank <= 10"
)
def search_all_indexes(spark, sf_dir):
    return search.search_all_indexes(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "index_name", "chunk_id", "similarity", "index_rank", "rank")


@query(
    f"WITH {O.SIMILAR} SELECT query_id, chunk_id, similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id))::INTEGER AS rank FROM sim WHERE chunk_id // 20 = 3 QUALIFY rank <= 5"
)
def search_within_document(spark, sf_dir):
    """Vectors as chunks of documents of twenty; the document restricts before the choice."""
    inside = vectors(spark, sf_dir).where(F.floor(F.col("chunk_id") / 20) == 3).select("chunk_id")
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 5, allowed=inside).select("query_id", "chunk_id", "similarity", "rank")


@query(f"WITH {O.VECTORS}, m AS (SELECT chunk_id, index_name, (row_number() OVER (ORDER BY chunk_id) - 1) AS position FROM v WHERE NOT deleted) SELECT * FROM m")
def rebuilt_positions(spark, sf_dir):
    """Positions of the live vectors in order of their chunks, from per-partition counts."""
    from corvale.plans.ingest import numbered

    live = vectors(spark, sf_dir).where(~F.col("deleted")).select("chunk_id", "index_name")
    return numbered(live, 0, ["chunk_id"], "position").select("chunk_id", "index_name", "position")


@query(f"WITH {O.ASKED} SELECT a.query_id AS a_id, b.query_id AS b_id, round(list_cosine_similarity(a.qe, b.qe), 6) AS similarity FROM q a, q b")
def similarity_matrix(spark, sf_dir):
    q = vector_queries(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("query_vec").alias("embedding"))
    return search.similarity_matrix(q, q)


@query(f"WITH {O.VECTORS}, {O.ASKED} SELECT query_id AS a_id, chunk_id AS b_id, round(list_cosine_similarity(qe, e), 6) AS similarity FROM q, v")
def similarity_matrix_all(spark, sf_dir):
    """The query set against all rows of embeddings; ``similarity_matrix`` has the query set on both sides, as its SQL."""
    a = vector_queries(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("query_vec").alias("embedding"))
    return search.similarity_matrix(a, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query()
def vector_approximate(spark, sf_dir):
    """Probed cells of a k-means model; recall against the exact scan is tested."""
    live = vectors(spark, sf_dir).where(~F.col("deleted"))
    cells, model = search.kmeans_cells(live, cells=16)
    return search.approximate_search(cells, model, vector_queries(spark, sf_dir), 10, probes=10).select("query_id", "chunk_id", "similarity", "rank")


# --- fusion and reranking ----------------------------------------------------------


def _hybrid(spark, sf_dir, k: int) -> DataFrame:
    return search.hybrid_search(vectors(spark, sf_dir), stored_index(spark, sf_dir), both_queries(spark, sf_dir), k)


@query(f"WITH {O.hybrid(10)} SELECT query_id, chunk_id, similarity, keyword_score, combined_score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def hybrid_fusion(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10)


def candidates(spark, sf_dir, k: int = 30) -> DataFrame:
    """Hybrid candidates with query text and content as results show it, cut to 500 characters."""
    content = units(spark, sf_dir).select("chunk_id", T.snippet(F.col("content")).alias("content"))
    return _hybrid(spark, sf_dir, k).join(content, "chunk_id").join(text_queries(spark, sf_dir), "query_id")


def _reranked(strategy: str) -> None:
    sql = O.reranked(strategy).replace(" AS rank FROM final QUALIFY rank <= 10", "::INTEGER AS rank FROM final QUALIFY rank <= 10")

    @query(sql, name=f"hybrid_rerank_{strategy}")
    def run(spark, sf_dir):
        return rerank.rerank(candidates(spark, sf_dir), strategy, 10)


for _strategy in ("hybrid", "bm25", "quality"):
    _reranked(_strategy)


@query()
def query_expansion(spark, sf_dir):
    return rerank.rerank_expanded(candidates(spark, sf_dir), 10)


# --- deduplication -----------------------------------------------------------------


@query(f"WITH {O.DOCS} SELECT min(id) AS id, content_hash FROM d GROUP BY content_hash")
def doc_dedup(spark, sf_dir):
    return dedup.first_of(documents(spark, sf_dir).select("id", "content_hash"), "content_hash", "id")


@query(
    f"""WITH {O.chunks(CHUNK)}, h AS (SELECT doc_id, chunk_index, md5(content) AS content_hash FROM ch) SELECT doc_id AS document_id, chunk_index, content_hash FROM h QUALIFY doc_id = min(doc_id) OVER (PARTITION BY content_hash)"""
)
def chunk_dedup(spark, sf_dir):
    own = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "chunk_index", "content_hash")
    return dedup.stored_chunks(own).select("document_id", "chunk_index", "content_hash")


@query(
    f"""WITH {O.DOCS}, old AS (SELECT * FROM d WHERE crawl_type = 'en'), new AS (SELECT * FROM d WHERE url NOT IN (SELECT url FROM old) AND content_hash NOT IN (SELECT content_hash FROM old))
SELECT id, url, content_hash FROM new QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1"""
)
def new_documents(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "url", "content_hash", "crawl_type")
    return dedup.new_documents(d, d.where("crawl_type = 'en'")).select("id", "url", "content_hash")


# --- URLs and pages ----------------------------------------------------------------


@query(f"SELECT page_id, {O.normal('url')} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))


@query(f"SELECT page_id, {O.valid('url')} AS valid FROM pages")
def url_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.is_valid(F.col("url")).alias("valid"))


@query(f"SELECT page_id, lower({O.NETLOC.format('url')}) AS domain, {O.SCHEME.format('url')} || '://' || {O.NETLOC.format('url')} AS base_url FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), U.base_url(F.col("url")).alias("base_url"))


@query(f"SELECT page_id, contains(lower({O.PATH.format('url')}), 'sitemap') OR suffix(url, 'robots.txt') AS is_sitemap, regexp_matches(lower({O.PATH.format('url')}), '\\.(txt|md|rst|csv|json|xml)$') AS is_text FROM pages")
def url_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.is_sitemap(F.col("url")).alias("is_sitemap"), U.is_text_file(F.col("url")).alias("is_text"))


@query(f"WITH {O.LINKS} SELECT page_id, dst AS link FROM links")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(U.links(F.col("html"), F.col("url"))).alias("link"))


@query(
    f"""WITH {O.LINKS}, one AS (SELECT min({O.normal("url")}) AS s FROM pages), inner_links AS (SELECT src, dst FROM (SELECT src, dst, pos FROM (SELECT src, dst, min(pos) AS pos FROM links GROUP BY src, dst)
  WHERE regexp_extract(src, '//([^/]*)', 1) = regexp_extract(dst, '//([^/]*)', 1)) QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos, dst) <= 10),
l1 AS (SELECT DISTINCT dst AS url FROM inner_links, one WHERE src = s AND dst <> s), l2 AS (SELECT DISTINCT dst AS url FROM inner_links JOIN l1 ON src = url WHERE dst NOT IN (SELECT url FROM l1) AND dst <> (SELECT s FROM one))
SELECT s AS url, 0 AS depth FROM one UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2"""
)
def crawl_bfs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    start = p.agg(F.min(U.normalize(F.col("url")))).first()[0]
    edges = crawl.page_links(p).groupBy("src", "dst").agg(F.min("position").alias("position"))
    return crawl.bfs(edges, start, max_depth=2, max_pages=500).select("url", "depth")


@query(f"WITH u AS (SELECT page_id, {O.SCHEME.format('url')} || '://' || {O.NETLOC.format('url')} AS b FROM pages) SELECT page_id, b || unnest([{O.ROBOTS}]) AS candidate FROM u")
def sitemap_candidates(spark, sf_dir):
    c = F.concat(F.array(U.robots_url(F.col("url"))), U.sitemap_urls(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(c).alias("candidate"))


@query(f"SELECT page_id, lower({O.NETLOC.format('url')}) AS domain FROM pages WHERE lower({O.NETLOC.format('url')}) IN (SELECT lower({O.NETLOC.format('url')}) FROM pages GROUP BY 1 HAVING count(*) >= 5)")
def filter_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    allowed = p.groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return crawl.in_domains(p, allowed).select("page_id", "domain")


@query()
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.page_text(F.col("html")).alias("content"))


# --- catalog -----------------------------------------------------------------------


@query(f"WITH {O.DOCS} SELECT id, title, source_id FROM d WHERE (title ILIKE '%tion%' OR content ILIKE '%tion%' OR url ILIKE '%tion%') AND crawl_type = 'en' ORDER BY id DESC LIMIT 50 OFFSET 10")
def search_documents_filter(spark, sf_dir):
    return catalog.search_documents(documents(spark, sf_dir), "tion", crawl_type="en", limit=50, offset=10).select("id", "title", "source_id")


@query(f"WITH {O.DOCS} SELECT id, url FROM d WHERE source_id = 'src3' ORDER BY id DESC LIMIT 100")
def documents_by_source(spark, sf_dir):
    return catalog.by_source(documents(spark, sf_dir), "src3").select("id", "url")


@query(f"WITH {O.DOCS} SELECT id, url FROM d WHERE url ILIKE '%SRC1_.example%' ORDER BY id LIMIT 50")
def url_pattern(spark, sf_dir):
    return catalog.by_url(documents(spark, sf_dir), "SRC1_.example").select("id", "url")


@query(f"WITH {O.DOCS} SELECT id, url, crawl_type FROM d WHERE id = 7")
def document_lookup(spark, sf_dir):
    return catalog.by_id(documents(spark, sf_dir), 7).select("id", "url", "crawl_type")


@query(f"WITH {O.chunks(CHUNK)} SELECT d.doc_id AS id, count(ch.doc_id) AS chunk_count, coalesce(sum(len(content)), 0)::BIGINT AS content_length FROM documents d LEFT JOIN ch ON ch.doc_id = d.doc_id GROUP BY d.doc_id")
def document_list_counts(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "content")
    return catalog.chunk_rollup(documents(spark, sf_dir).select("id"), c).select("id", "chunk_count", "content_length")


@query(
    f"WITH {O.chunks(CHUNK)} SELECT d.doc_id AS id, d.lang AS crawl_type, count(ch.doc_id) AS chunk_count, coalesce(sum(len(content)), 0)::BIGINT AS content_length FROM documents d LEFT JOIN ch ON ch.doc_id = d.doc_id WHERE d.lang = 'fr' AND d.source ILIKE '%src1%' GROUP BY ALL ORDER BY id LIMIT 50"
)
def sources_rollup(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "content")
    return catalog.sources(documents(spark, sf_dir).select("id", "url", "crawl_type"), c, 50, "//src1", "fr").select("id", "crawl_type", "chunk_count", "content_length")


@query("SELECT sum(len(text))::BIGINT AS total, sum(n_chars)::DOUBLE / 1000 AS seconds, round(sum(len(text)) / (sum(n_chars)::DOUBLE / 1000), 6) AS rate FROM documents")
def throughput(spark, sf_dir):
    """Characters a second, where a thousand characters stand for a second."""
    own = table(spark, sf_dir, "documents").select(F.length("text").alias("n_texts"), (F.col("n_chars") / 1000).alias("seconds"))
    return catalog.throughput(own).select("total", F.round("seconds", 3).alias("seconds"), F.round("rate", 6).alias("rate"))


@query("SELECT source AS source_id, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return catalog.count_by(documents(spark, sf_dir), "source_id")


@query("SELECT lang AS crawl_type, count(*) AS n FROM documents GROUP BY lang")
def count_by_type(spark, sf_dir):
    return catalog.count_by(documents(spark, sf_dir), "crawl_type")


@query("SELECT DISTINCT lang AS crawl_type FROM documents WHERE coalesce(lang, '') <> ''")
def distinct_types(spark, sf_dir):
    return catalog.distinct_types(documents(spark, sf_dir))


@query(f"SELECT lower({O.NETLOC.format('url')}) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_domains(spark, sf_dir):
    return catalog.top_by_count(table(spark, sf_dir, "pages"), U.domain(F.col("url")))


@query("SELECT substr(url, strpos(url, '://') + 3) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_url_suffix(spark, sf_dir):
    return catalog.top_by_count(table(spark, sf_dir, "pages"), catalog.url_suffix())


@query(
    f"""WITH {O.chunks(CHUNK)}, d AS (SELECT doc_id, 'index_' || (doc_id % 10) AS index_name FROM documents), {O.VECTORS}
SELECT index_name, total_documents, total_chunks, total_vectors, active_vectors, deleted_vectors FROM (SELECT index_name, count(*) AS total_documents FROM d GROUP BY 1)
 JOIN (SELECT index_name, count(*) AS total_chunks FROM ch JOIN d USING (doc_id) GROUP BY 1) USING (index_name)
 JOIN (SELECT index_name, count(*) AS total_vectors, count(*) FILTER (NOT deleted) AS active_vectors, count(*) FILTER (deleted) AS deleted_vectors FROM v GROUP BY 1) USING (index_name)"""
)
def index_stats(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_id"))
    return catalog.index_statistics(documents(spark, sf_dir).select("id", "index_name"), c, vectors(spark, sf_dir))


@query(f"WITH {O.chunks(CHUNK)} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings")
def storage_stats(spark, sf_dir):
    return catalog.counts(documents=table(spark, sf_dir, "documents"), chunks=chunk_rows(spark, sf_dir), embeddings=table(spark, sf_dir, "embeddings"))


@query(f"WITH {O.VECTORS} SELECT index_name, count(*) AS total_vectors, count(*) FILTER (NOT deleted) AS active_vectors, count(*) FILTER (deleted) AS deleted_vectors FROM v GROUP BY 1")
def active_vectors(spark, sf_dir):
    return catalog.vector_statistics(vectors(spark, sf_dir))


# --- tasks -------------------------------------------------------------------------


def task_events(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).cast("string").alias("task_id"), status.alias("status"), F.col("event_id").alias("current_item"), (F.col("event_id") * 3).alias("total_items"), "ts")


TASKS = """e AS (SELECT (user_id * 100 + day(ts))::VARCHAR AS task_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, event_id AS current_item, event_id * 3 AS total_items, ts FROM events),
x AS (SELECT task_id, min(ts) AS end_ts FROM e WHERE status <> 'running' GROUP BY task_id),
l AS (SELECT e.* FROM e LEFT JOIN x USING (task_id) WHERE end_ts IS NULL OR ts <= end_ts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, (status <> 'running')::INT DESC, current_item DESC) = 1)"""


@query(f"WITH {TASKS} SELECT task_id, status, current_item, total_items, round(least(100.0, CASE WHEN total_items > 0 THEN current_item / total_items * 100 ELSE current_item END), 6)::DOUBLE AS percent FROM l")
def task_latest(spark, sf_dir):
    return tasks.latest_state(task_events(spark, sf_dir)).select("task_id", "status", "current_item", "total_items", F.round("percent", 6).alias("percent"))


@query(f"WITH {TASKS} SELECT task_id, status FROM l WHERE NOT (status <> 'running' AND ts < (SELECT max(ts) FROM e) - INTERVAL 24 HOUR)")
def task_ttl(spark, sf_dir):
    e = task_events(spark, sf_dir)
    now = e.agg(F.max("ts")).first()[0]
    return tasks.evicted(tasks.latest_state(e), F.lit(now), 24).select("task_id", "status")


@query(f"WITH {TASKS} SELECT count(*) FILTER (status = 'running') AS running, count(*) AS total FROM l")
def task_active(spark, sf_dir):
    return tasks.active_counts(tasks.latest_state(task_events(spark, sf_dir)))


@query(f"SELECT count(*) FILTER ({O.valid('url')}) AS stored, count(*) FILTER (NOT {O.valid('url')}) AS failed, count(*) FILTER (NOT {O.valid('url')}) = 0 AS success FROM pages")
def batch_outcome(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", "html", F.when(~U.is_valid(F.col("url")), "invalid url").alias("error"))
    return P.outcome(p).select("stored", "failed", "success")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    own = tasks.event_windows(table(spark, sf_dir, "events"))
    return own.select("start", "event_type", "n", F.round("total", 4).alias("total"))
