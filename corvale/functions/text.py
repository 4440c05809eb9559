"""Text functions as column expressions, so that they stay in the JVM.

Functions that look at a column more than once take a DataFrame and add
columns step by step: a projection of its own keeps an array from being built
again inside each lambda.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvale.functions.words import COMPOUNDS, PRESERVED, STOP_WORDS, TECHNICAL_STOP_WORDS

#: What Python's str.strip() and str.split() take as white space.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DROPPED = sorted(set(STOP_WORDS) | set(TECHNICAL_STOP_WORDS))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def split_words(c: Column) -> Column:
    """Runs between white space; none for blank text."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{BLANK}+"), "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def md5(c: Column) -> Column:
    return F.md5(c)


def snippet(c: Column, size: int = 500) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def title(c: Column) -> Column:
    """The first top-level heading, else the first line cut to 100 characters; null for empty text."""
    heading = F.regexp_extract(c, r"(?md)^#[\s]+(.+)$", 1)
    line = strip(F.substring_index(c, "\n", 1))
    return F.when(c.rlike(r"(?md)^#[\s]+(.+)$"), strip(heading)).when(F.length(c) > 0, F.when(F.length(line) > 100, F.concat(F.left(line, F.lit(100)), F.lit("..."))).otherwise(line))


def clean(c: Column) -> Column:
    """White space collapsed, characters but words and basic punctuation to spaces, runs of dots and of !? to one."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s.,!?\-:;]", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "."), r"[!?]{2,}", "!"))


def is_valid_content(c: Column, least: int = 50) -> Column:
    return F.length(clean(c)) >= least


def quality(c: Column) -> Column:
    """Mean of length (up to 1000) and words (up to 200), each as a share; 0 for empty, 0.1 for under 50 characters."""
    size = F.coalesce(F.length(c), F.lit(0))
    mean = (F.least(size / 1000.0, F.lit(1.0)) + F.least(word_count(c) / 200.0, F.lit(1.0))) / 2.0
    return F.when(size == 0, 0.0).when(size < 50, 0.1).otherwise(mean)


def chunk_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """Add headers, char_count, word_count, line_count, has_code and has_links of a text column."""
    c = F.col(text)
    marks, names = (F.regexp_extract_all(c, F.lit(r"(?md)^(#+)[\s]+(.+)$"), F.lit(i)) for i in (1, 2))
    breaks = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    lines = F.size(F.split(c, breaks)) - F.when(c.rlike(f"(?:{breaks})\\z"), 1).otherwise(0)
    return df.select(
        "*",
        F.array_join(F.zip_with(marks, names, lambda a, b: F.concat(a, F.lit(" "), b)), "; ").alias("headers"),
        F.length(c).alias("char_count"), word_count(c).alias("word_count"), F.when(F.length(c) == 0, 0).otherwise(lines).alias("line_count"),
        c.contains("```").alias("has_code"), (c.contains("http") | c.contains("www.")).alias("has_links"),
    )


def with_keywords(df: DataFrame, text: str, name: str = "keywords", most: int = 10, least_length: int = 2) -> DataFrame:
    """Add the ``most`` best keywords of a text column: kept tokens and compounds, by score, then first place."""
    raw, low = F.coalesce(F.col(text), F.lit("")), F.col("__low")
    tokens = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z0-9_-]+"), F.lit(0)), lambda x: (F.length(x) >= least_length) & (x.isin(PRESERVED) | ~x.isin(DROPPED)))
    compounds = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(term)) for p, term in COMPOUNDS)))

    def score(k: Column) -> Column:
        times = ((F.length(low) - F.length(F.replace(low, k, F.lit("")))) / F.length(k)).cast("int")
        return (
            F.when(F.contains(raw, k), 3).otherwise(0) + F.when(k.isin(PRESERVED), 2).otherwise(0) + F.when(F.length(k) > 5, 1).otherwise(0)
            + F.when(k.rlike("[0-9]"), 1).otherwise(0) + F.greatest(times - 1, F.lit(0)) * 2
        )

    df = df.withColumn("__low", F.lower(raw))
    df = df.withColumn("__found", F.array_distinct(F.concat(tokens, compounds)))
    ranked = F.array_sort(F.transform("__found", lambda k, i: F.struct((-score(k)).alias("s"), i.alias("i"), k.alias("k"))))
    return df.withColumn(name, F.transform(F.slice(ranked, 1, most), lambda x: x["k"])).drop("__low", "__found")


def search_terms(keywords: Column) -> Column:
    """Keywords and their variants (plural or singular, without -ing and -ed), each once."""

    def variants(k: Column) -> Column:
        plural = F.when(k.endswith("ss"), F.concat(k, F.lit("es"))).when(~k.endswith("s"), F.concat(k, F.lit("s"))).when(F.length(k) > 3, F.left(k, F.length(k) - 1))
        ing, ed = F.left(k, F.length(k) - 3), F.left(k, F.length(k) - 2)
        has_ing, has_ed = k.endswith("ing") & (F.length(k) > 5), k.endswith("ed") & (F.length(k) > 4)
        return F.array_compact(F.array(k, plural, F.when(has_ing, ing), F.when(has_ing, F.concat(ing, F.lit("e"))), F.when(has_ed, ed), F.when(has_ed, F.concat(ed, F.lit("e")))))

    return F.array_distinct(F.flatten(F.transform(keywords, variants)))


_RUN = re.compile(r"[a-z0-9_-]+")
#: Texts of so many characters are scanned once for each keyword.
SCANNED = 30_000


def _occurrences(words: list[str], runs: Iterable[str]) -> Iterator[tuple[str, str, int]]:
    """(run, word, times without overlap) for each of ``words`` in each of ``runs``; one pass over the runs finds all words."""
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    for run in runs:
        upto: dict[str, int] = {}
        times: Counter[str] = Counter()
        for last, w in automaton.iter(run):
            if last - len(w) >= upto.get(w, -1):
                upto[w] = last
                times[w] += 1
        for w, n in times.items():
            yield run, w, n


def keyword_choice(most: int, least_length: int = 2) -> Callable[[str | None], list[str]]:
    """The choice of ``with_keywords`` for one text of any length.

    A keyword is made of the characters that runs are made of, so where it lies
    in the text it lies within a run: in texts above ``SCANNED`` characters one
    pass over the distinct runs finds all keywords in them, so the time is
    linear in the text; for shorter ones a scan for each keyword is faster.
    """
    kept, dropped, compounds = frozenset(PRESERVED), frozenset(DROPPED), [(re.compile(p), term) for p, term in COMPOUNDS]

    def best(raw: str | None) -> list[str]:
        raw = raw or ""
        low = raw.lower()
        runs = Counter(_RUN.findall(low))
        found = dict.fromkeys(t for t in runs if len(t) >= least_length and (t in kept or t not in dropped))
        found.update(dict.fromkeys(term for p, term in compounds if p.search(low)))
        inner = [k for k in found if _RUN.fullmatch(k)] if len(low) > SCANNED else []
        rest = [k for k in found if not _RUN.fullmatch(k)] if inner else found  # compounds of other characters are a fixed list
        count = Counter({k: low.count(k) for k in rest})
        as_is = {k for k in rest if k in raw}
        if inner:
            for run, k, n in _occurrences(inner, runs):
                count[k] += n * runs[run]
            as_is.update(k for _, k, _ in _occurrences(inner, set(_RUN.findall(raw))))

        def score(k: str) -> int:
            return 3 * (k in as_is) + 2 * (k in kept) + (len(k) > 5) + (not k.isalpha() and any(c.isdigit() for c in k)) + 2 * max(count[k] - 1, 0)

        ranked = sorted(((-score(k), i, k) for i, k in enumerate(found)))
        return [k for _, _, k in ranked[:most]]

    return best


def corpus_keywords(most: int, least_length: int = 2):
    """The same choice as ``with_keywords`` as a vectorised function, for long texts."""
    best = keyword_choice(most, least_length)

    @F.pandas_udf("array<string>")
    def keywords(texts: pd.Series) -> pd.Series:
        return texts.map(best)

    return keywords


def with_tokens(df: DataFrame, text: str, name: str = "tokens", most: int = 50, corpus: bool = False) -> DataFrame:
    """Add the search tokens of a text column: the terms of its keywords, or its lower-cased words if it has none.

    ``corpus`` says that the texts are long and many: their keywords are then found by a vectorised function.
    """
    df = df.withColumn("__keywords", corpus_keywords(most)(F.col(text))) if corpus else with_keywords(df, text, "__keywords", most)
    return df.withColumn(name, F.when(F.size("__keywords") > 0, search_terms(F.col("__keywords"))).otherwise(split_words(F.lower(F.col(text))))).drop("__keywords")


def coverage(query: Column, content: Column) -> Column:
    """Share of the distinct query tokens that the content's tokens have; 0 for no query tokens."""
    asked = F.array_distinct(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, content)) / F.size(asked)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of lower-cased words."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
