"""Fixed cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from corvale.functions import text as T
from corvale.functions import url as U
from corvale.functions import vector as V


def column(spark, values, f, types="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {types}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


KEYWORDS = [
    ("machine learning model deployment best practices production", "deployment machine learning practices production model best best_practices".split(), 18),
    ("FastAPI JWT authentication with PostgreSQL database security", "authentication database security postgresql jwt fastapi".split(), 12),
    ("React hooks useState useEffect optimization performance", "optimization performance hooks react usestate useeffect".split(), 12),
    ("how to implement vector search with embeddings", "vector embeddings howto".split(), 6),
]


def test_keywords_and_terms(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(KEYWORDS)], "i int, q string")
    got = T.with_keywords(rows, "q", "k", 15).select("i", "k", T.search_terms(F.col("k")).alias("t")).orderBy("i").collect()
    for r, (_, words, terms) in zip(got, KEYWORDS, strict=True):
        assert r["k"] == words
        assert len(r["t"]) == terms


def test_term_variants(spark):
    got = column(spark, ["class", "bus", "coding", "used"], lambda c: T.search_terms(F.array(c)))
    assert got == [["class", "classes"], ["bus"], ["coding", "codings", "cod", "code"], ["used", "useds"]]


def test_tokens_fall_back_to_words(spark):
    rows = spark.createDataFrame([("für für ÄÖ", ), (None,), ("",)], "q string")
    assert [r["t"] for r in T.with_tokens(rows, "q", "t").collect()] == [["für", "für", "äö"], [], []]


def test_text(spark):
    texts = ["# A title \nbody", "one\ntwo", "", "x" * 120, None]
    assert column(spark, texts, T.title) == ["A title", "one", None, "x" * 100 + "...", None]
    assert column(spark, [" a  b c d\x1ce ", "", None], T.word_count) == [5, 0, 0]
    assert column(spark, ["a .. b!? (c) ", ""], T.clean) == ["a . b!  c", ""]
    assert column(spark, ["", "x" * 49, ("word " * 100), "abcd " * 250], lambda c: F.round(T.quality(c), 6)) == [0.0, 0.1, 0.5, 1.0]
    assert column(spark, ["a" * 501, "a" * 500], T.snippet) == ["a" * 500 + "...", "a" * 500]


def test_chunk_metadata(spark):
    rows = spark.createDataFrame([("# One\ntext http://x\n## Two\n```code```",), ("",), ("a\r\nb\n",)], "text string")
    got = T.chunk_metadata(rows).collect()
    assert (got[0]["headers"], got[0]["line_count"], got[0]["has_code"], got[0]["has_links"]) == ("# One; ## Two", 4, True, True)
    assert (got[1]["line_count"], got[1]["word_count"], got[2]["line_count"]) == (0, 0, 2)


NORMAL = [
    ("/docs/a/", "https://Ex.com/b", "https://ex.com/docs/a"), ("https://ex.com/", None, "https://ex.com/"), ("https://ex.com/?q=a/", None, "https://ex.com/?q=a/"), ("https://ex.com/p?q=a/", None, "https://ex.com/p?q=a"),
    ("https://Ex.com:8080/A//#f", None, "https://ex.com:8080/A"), ("../x", "https://ex.com/a/b/c", "https://ex.com/a/x"), ("//h.org/z", "https://ex.com/", "https://h.org/z"), ("y", "https://ex.com", "https://ex.com/y"), ("?a=1", "https://ex.com/p?b", "https://ex.com/p?a=1"),
]


@pytest.mark.parametrize(("url", "base", "want"), NORMAL)
def test_normalize(spark, url, base, want):
    b = F.lit(base) if base else None
    assert spark.range(1).select(U.normalize(F.lit(url), b)).first()[0] == want


def test_valid(spark):
    urls = ["https://ex.com/docs", "https://ex.com/docs/api/x", "https://ex.com/apiary", "https://ex.com/file.PDF", "ftp://ex.com/a", "ex.com/a", "", None]
    assert column(spark, urls, U.is_valid) == [True] + [False] * 7


def test_links(spark):
    html = """<a href="/a">x</a><A HREF='b?x#f'>y</a><a href="mailto:z">m</a><a href="/a/">again</a><a href="#top">t</a><a href="https://other.org/p.css">c</a>"""
    assert spark.range(1).select(U.links(F.lit(html), F.lit("https://ex.com/d/e"))).first()[0] == ["https://ex.com/a", "https://ex.com/d/b?x"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    got = row.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("z")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.squared_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert [round(x, 6) for x in got["u"]] == [0.6, 0.8]
    assert got["n"] is None
    assert math.isclose(got["c"], 0.96) and got["d"] == 2.0
    with pytest.raises(Exception, match="expected 3 dimensions"):
        row.select(V.checked(F.col("a"), 3)).collect()


def test_coverage_and_jaccard(spark):
    r = spark.createDataFrame([(["a", "b", "a"], ["b", "c"], "The cat", "the CAT sat")], "q array<string>, c array<string>, s string, t string")
    got = r.select(T.coverage(F.col("q"), F.col("c")), T.coverage(F.array().cast("array<string>"), F.col("c")), T.jaccard(F.col("s"), F.col("t"))).first()
    assert (got[0], got[1], round(got[2], 6)) == (0.5, 0.0, 0.666667)
