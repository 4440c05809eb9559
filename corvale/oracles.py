"""DuckDB SQL for the queries that SQL can express, over the same Parquet tables."""

from __future__ import annotations

from corvale.functions.text import DROPPED
from corvale.functions.url import SITEMAPS, SKIPPED_ENDINGS, SKIPPED_PARTS
from corvale.functions.words import COMPOUNDS, PRESERVED


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DOCS = """d AS (SELECT doc_id AS id, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url, text AS content, md5(text) AS content_hash,
 source AS source_id, lang AS crawl_type, 'index_' || (doc_id % 10) AS index_name,
 CASE WHEN regexp_matches(text, '(?m)^#\\s+.+$') THEN trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)) WHEN len(text) > 0 THEN
  CASE WHEN len(trim(split_part(text, chr(10), 1))) > 100 THEN left(trim(split_part(text, chr(10), 1)), 100) || '...' ELSE trim(split_part(text, chr(10), 1)) END END AS title FROM documents)"""
VECTORS = "v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, 'index_' || label AS index_name, vec_id % 7 = 3 AS deleted FROM embeddings)"
ASKED = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0)"
BLANKS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


def words(c: str) -> str:
    return BLANKS.format(c)


def keywords(p: str, source: str, key: str, text: str, most: int) -> str:
    """CTEs {p}t (key, raw, low) and {p}kw (key, k, r)."""
    compounds = ", ".join(f"CASE WHEN regexp_matches(low, '{pat}') THEN '{term}' END" for pat, term in COMPOUNDS)
    return f"""{p}t AS (SELECT {key} AS key, {text} AS raw, lower({text}) AS low FROM {source}),
{p}f AS (SELECT key, list_concat(list_filter(regexp_extract_all(low, '[a-z0-9_-]+'), lambda x: len(x) >= 2 AND (list_contains({_list(PRESERVED)}, x) OR NOT list_contains({_list(DROPPED)}, x))),
  list_filter([{compounds}], lambda x: x IS NOT NULL)) AS ks FROM {p}t),
{p}u AS (SELECT key, k, min(pos) AS pos FROM (SELECT key, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS pos FROM {p}f) GROUP BY key, k),
{p}s AS (SELECT key, k, pos, CASE WHEN contains(raw, k) THEN 3 ELSE 0 END + CASE WHEN list_contains({_list(PRESERVED)}, k) THEN 2 ELSE 0 END + CASE WHEN len(k) > 5 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(k, '[0-9]') THEN 1 ELSE 0 END + 2 * greatest((len(low) - len(replace(low, k, ''))) // len(k) - 1, 0) AS score FROM {p}u JOIN {p}t USING (key)),
{p}kw AS (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) AS r FROM {p}s QUALIFY r <= {most})"""


def tokens(p: str, source: str, key: str, text: str, most: int) -> str:
    """CTEs as above and {p}tok (key, term, tf), {p}len (key, length)."""
    return (
        keywords(p, source, key, text, most)
        + f""",
{p}x AS (SELECT DISTINCT key, unnest([k, CASE WHEN suffix(k, 'ss') THEN k || 'es' WHEN NOT suffix(k, 's') THEN k || 's' WHEN len(k) > 3 THEN left(k, len(k) - 1) END,
  CASE WHEN suffix(k, 'ing') AND len(k) > 5 THEN left(k, len(k) - 3) END, CASE WHEN suffix(k, 'ing') AND len(k) > 5 THEN left(k, len(k) - 3) || 'e' END,
  CASE WHEN suffix(k, 'ed') AND len(k) > 4 THEN left(k, len(k) - 2) END, CASE WHEN suffix(k, 'ed') AND len(k) > 4 THEN left(k, len(k) - 2) || 'e' END]) AS term FROM {p}kw),
{p}tok AS (SELECT key, term, count(*) AS tf FROM (SELECT key, term FROM {p}x WHERE term IS NOT NULL
  UNION ALL SELECT key, unnest({words("low")}) AS term FROM {p}t WHERE key NOT IN (SELECT key FROM {p}kw)) GROUP BY key, term),
{p}len AS (SELECT t.key, coalesce(sum(tf), 0) AS length FROM {p}t t LEFT JOIN {p}tok USING (key) GROUP BY t.key)"""
    )


def index(p: str) -> str:
    """CTEs {p}st (n, m), {p}terms (term, df, idf, mean_idf)."""
    return f"""{p}st AS (SELECT count(*) AS n, avg(length) AS m FROM {p}len),
{p}raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}tok, {p}st GROUP BY term),
{p}terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf, avg(raw) OVER () AS mean_idf FROM {p}raw)"""


BM25 = (
    tokens("c", "documents", "doc_id", "text", 50) + ",\n" + index("c") + ",\n" + tokens("q", "benchmark", "item_id", "text", 15)
    + """,
score AS (SELECT q.key AS query_id, c.key AS chunk_id, round(sum(q.tf * idf * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * length / m))), 6) AS keyword_score
 FROM qtok q JOIN cterms USING (term) JOIN ctok c USING (term) JOIN clen ON clen.key = c.key, cst GROUP BY q.key, c.key),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS rank FROM score WHERE keyword_score > 0)"""
)

SIMILAR = f"""{VECTORS}, {ASKED},
sim AS (SELECT query_id, chunk_id, index_name, round(list_cosine_similarity(e, qe), 6) AS similarity FROM v, q WHERE NOT deleted)"""
#: Benchmark items with the vector of the same number, as queries of text and vector.
BOTH = """vs AS (SELECT item_id AS query_id, v.chunk_id, round(list_cosine_similarity(v.e, a.embedding::DOUBLE[]), 6) AS similarity FROM benchmark JOIN embeddings a ON a.vec_id = item_id, v WHERE NOT deleted),
vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM vs QUALIFY rank <= {two} AND similarity >= 0),
vn AS (SELECT query_id, chunk_id, similarity, rank AS v_rank, CASE WHEN max(similarity) OVER w > min(similarity) OVER w THEN (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w)
  WHEN max(similarity) OVER w > 0 THEN 1.0 ELSE 0.0 END AS vn FROM vh WINDOW w AS (PARTITION BY query_id)),
kh AS (SELECT * FROM hits WHERE rank <= {two} AND query_id IN (SELECT vec_id FROM embeddings)),
kn AS (SELECT query_id, chunk_id, keyword_score, rank AS k_rank, CASE WHEN max(keyword_score) OVER w > min(keyword_score) OVER w THEN (keyword_score - min(keyword_score) OVER w) / (max(keyword_score) OVER w - min(keyword_score) OVER w)
  WHEN max(keyword_score) OVER w > 0 THEN 1.0 ELSE 0.0 END AS kn FROM kh WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, chunk_id, coalesce(similarity, 0) AS similarity, coalesce(keyword_score, 0) AS keyword_score, round(coalesce(vn, 0) * 0.7 + coalesce(kn, 0) * 0.3, 6)::DOUBLE AS combined_score, v_rank, k_rank
  FROM vn FULL JOIN kn USING (query_id, chunk_id)),
ranked AS (SELECT query_id, chunk_id, similarity::DOUBLE AS similarity, keyword_score::DOUBLE AS keyword_score, combined_score,
  row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, v_rank NULLS LAST, k_rank NULLS LAST) AS rank FROM fused)"""


def hybrid(k: int) -> str:
    return f"{BM25}, {VECTORS}, {BOTH.format(two=2 * k)}"


def reranked(strategy: str, k: int = 10) -> str:
    blend = {"bm25": "b", "quality": "combined_score * 0.4 + cov * 0.3 + qual * 0.3", "hybrid": "combined_score * 0.4 + b * 0.3 + cov * 0.2 + qual * 0.1"}[strategy]
    norm = "CASE WHEN max(bm) OVER w > min(bm) OVER w THEN (bm - min(bm) OVER w) / (max(bm) OVER w - min(bm) OVER w) ELSE 1.0 END" if strategy != "quality" else "0.5"
    return f"""WITH {hybrid(3 * k)},
cand AS (SELECT query_id, chunk_id, combined_score, rank AS before, CASE WHEN len(d.text) > 500 THEN left(d.text, 500) || '...' ELSE d.text END AS content,
  query_id * 10000000 + chunk_id AS key FROM ranked JOIN documents d ON doc_id = chunk_id WHERE rank <= {3 * k}),
{tokens("r", "cand", "key", "content", 50)},
size AS (SELECT c.key, query_id, length, count(*) OVER w AS n, avg(length) OVER w AS m FROM cand c JOIN rlen ON rlen.key = c.key WINDOW w AS (PARTITION BY query_id)),
post AS (SELECT s.query_id, s.key, term, tf, length, n, m, ln(n - count(*) OVER w + 0.5) - ln(count(*) OVER w + 0.5) AS raw FROM rtok r JOIN size s ON s.key = r.key WINDOW w AS (PARTITION BY s.query_id, term)),
avgs AS (SELECT query_id, avg(raw) AS mean FROM (SELECT DISTINCT query_id, term, raw FROM post) GROUP BY query_id),
b0 AS (SELECT post.key, round(sum(q.tf * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * post.tf * 2.5 / (post.tf + 1.5 * (0.25 + 0.75 * length / m))), 6) AS bm
  FROM post JOIN avgs USING (query_id) JOIN qtok q ON q.key = post.query_id AND q.term = post.term GROUP BY post.key),
covered AS (SELECT c.key, count(r.term) / count(*) AS cov FROM cand c JOIN qtok q ON q.key = c.query_id LEFT JOIN rtok r ON r.key = c.key AND r.term = q.term GROUP BY c.key),
parts AS (SELECT query_id, chunk_id, combined_score, before, coalesce(bm, 0) AS bm, coalesce(cov, 0) AS cov,
  CASE WHEN len(content) = 0 THEN 0.0 WHEN len(content) < 50 THEN 0.1 ELSE (least(len(content) / 1000, 1.0) + least(len({words("content")}) / 200, 1.0)) / 2 END AS qual
  FROM cand c LEFT JOIN b0 ON b0.key = c.key LEFT JOIN covered ON covered.key = c.key),
normed AS (SELECT *, {norm} AS b FROM parts WINDOW w AS (PARTITION BY query_id)),
final AS (SELECT *, round({blend}, 6) AS final_score FROM normed)
SELECT query_id, chunk_id, round(cov, 6)::DOUBLE AS coverage, round(qual, 6)::DOUBLE AS quality, round(b, 6)::DOUBLE AS bm25, final_score::DOUBLE AS final_score,
 row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, before) AS rank FROM final QUALIFY rank <= {k}"""


def _rfind(w: str, what: str) -> str:
    return f"CASE WHEN contains({w}, {what}) THEN len({w}) - strpos(reverse({w}), reverse({what})) - len({what}) + 1 ELSE -1 END"


def chunks(size: int) -> str:
    """CTE ch (doc_id, chunk_index, content)."""
    fence, para, stop = _rfind("w", "'```'"), _rfind("w", "chr(10) || chr(10)"), _rfind("w", "'. '")
    least = size * 0.3
    return f"""RECURSIVE cut AS (
 SELECT doc_id, text, 0::BIGINT AS start, 0::BIGINT AS stop FROM documents WHERE len(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10
 UNION ALL
 SELECT doc_id, text, stop AS start, CASE WHEN stop + {size} >= len(text) THEN len(text) WHEN f >= 0 AND f > {least} THEN stop + f WHEN p >= 0 THEN stop + CASE WHEN p > {least} THEN p ELSE {size} END
  WHEN s >= 0 THEN stop + CASE WHEN s > {least} THEN s + 1 ELSE {size} END ELSE stop + {size} END AS stop
 FROM (SELECT doc_id, text, stop, {fence} AS f, {para} AS p, {stop} AS s FROM (SELECT doc_id, text, stop, substr(text, stop + 1, {size}) AS w FROM cut WHERE stop < len(text)))),
pieces AS (SELECT doc_id, start, regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS content FROM cut WHERE stop > start),
ch AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_index, content FROM pieces WHERE content <> '')"""


SCHEME = "lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
NETLOC = "regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
PATH = "regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = "regexp_extract({0}, '^[^?#]*(\\?[^#]+)', 1)"


def normal(u: str) -> str:
    whole = f"({SCHEME.format(u)} || '://' || lower({NETLOC.format(u)}) || {PATH.format(u)} || {QUERY.format(u)})"
    return f"CASE WHEN suffix({whole}, '/') AND {PATH.format(u)} <> '/' THEN rtrim({whole}, '/') ELSE {whole} END"


def valid(u: str) -> str:
    low = f"lower({PATH.format(u)})"
    ends = " OR ".join(f"suffix({low}, '{e}')" for e in SKIPPED_ENDINGS)
    parts = " OR ".join(f"contains({low}, '{x}')" for x in SKIPPED_PARTS)
    return f"({SCHEME.format(u)} IN ('http', 'https') AND {NETLOC.format(u)} <> '' AND NOT ({ends}) AND NOT ({parts}))"


HREF = "href=[" + chr(34) + chr(39) * 2 + "]([^" + chr(34) + chr(39) * 2 + "]+)[" + chr(34) + chr(39) * 2 + "]"
LINKS = f"""hs AS (SELECT page_id, url, regexp_extract_all(html, '(?i){HREF}', 1) AS l FROM pages),
raw AS (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS pos FROM hs),
joined AS (SELECT page_id, url, pos, CASE WHEN prefix(h, 'http://') OR prefix(h, 'https://') THEN h ELSE {SCHEME.format("url")} || '://' || {NETLOC.format("url")} || h END AS h FROM raw
 WHERE NOT (prefix(h, 'javascript:') OR prefix(h, 'mailto:') OR prefix(h, 'tel:') OR prefix(h, '#'))),
links AS (SELECT page_id, {normal("url")} AS src, {normal("h")} AS dst, min(pos) AS pos FROM joined WHERE {valid(normal("h"))} GROUP BY ALL)"""
ROBOTS = ", ".join(f"'{p}'" for p in ["/robots.txt", *SITEMAPS])
