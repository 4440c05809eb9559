"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings and path parts that aren't crawled, endings of text files, places of sitemaps.
SKIPPED_ENDINGS = ".pdf .jpg .jpeg .png .gif .svg .ico .mp4 .mov .avi .zip .tar .gz .css .js".split()
SKIPPED_PARTS = "/admin /login /api /assets /static /images /css /js /fonts /_next /__next".split()
TEXT_ENDINGS = ".txt .md .rst .csv .json .xml".split()
SITEMAPS = "/sitemap.xml /sitemap_index.xml /sitemaps/sitemap.xml /sitemap/sitemap.xml".split()

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    """Host with user and port, as written."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def domain(url: Column) -> Column:
    return F.lower(netloc(url))


def base_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def source_id(url: Column) -> Column:
    return F.coalesce(F.nullif(netloc(url), F.lit("")), path(url))


def same_domain(a: Column, b: Column) -> Column:
    return (domain(a) == domain(b)) & (domain(a) != "")


def extension(url: Column) -> Column:
    return F.element_at(F.split(url, r"\."), -1)


def _ends(c: Column, endings: list[str]) -> Column:
    return c.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def is_valid(url: Column) -> Column:
    """http(s) with a host, no skipped ending, no skipped part anywhere in the path."""
    low = F.lower(path(url))
    return scheme(url).isin("http", "https") & (netloc(url) != "") & ~_ends(low, SKIPPED_ENDINGS) & ~low.rlike("|".join(SKIPPED_PARTS))


def is_sitemap(url: Column) -> Column:
    return url.endswith("sitemap.xml") | F.contains(F.lower(path(url)), F.lit("sitemap")) | url.endswith("robots.txt")


def is_text_file(url: Column) -> Column:
    return _ends(F.lower(path(url)), TEXT_ENDINGS)


def robots_url(url: Column) -> Column:
    return F.concat(base_url(url), F.lit("/robots.txt"))


def sitemap_urls(url: Column) -> Column:
    return F.array(*(F.concat(base_url(url), F.lit(p)) for p in SITEMAPS))


def without_dots(p: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved."""
    parts = F.split(p, "/")
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.array_join(stack, "/"), F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def join(base: Column, ref: Column) -> Column:
    """``ref`` as seen from ``base``."""
    own, tail = path(ref), F.concat(_part(ref, 4), _part(ref, 5))
    here = F.regexp_replace(path(base), r"[^/]*$", "")
    here = F.when(here == "", F.lit("/")).otherwise(here)
    inner = F.when(own == "", F.concat(path(base), F.when(_part(ref, 4) == "", F.concat(_part(base, 4), _part(ref, 5))).otherwise(tail))).when(
        own.startswith("/"), F.concat(without_dots(own), tail)).otherwise(F.concat(without_dots(F.concat(here, own)), tail))
    return (
        F.when(ref == "", base).when(scheme(ref) != "", ref)
        .when(netloc(ref) != "", F.concat(scheme(base), F.lit(":"), ref)).otherwise(F.concat(base_url(base), inner))
    )


def normalize(url: Column, base: Column | None = None) -> Column:
    """Absolute, host lower-cased, no fragment, no ``/`` at the end unless the path is just that."""
    if base is not None:
        url = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(join(base, url))
    host = F.when(netloc(url) != "", F.concat(F.lit("//"), domain(url))).otherwise(F.lit(""))
    whole = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(F.lit("")), host, path(url), F.regexp_replace(_part(url, 4), r"^\?$", ""))
    return F.when(whole.endswith("/") & (path(url) != "/"), F.rtrim(whole, F.lit("/"))).otherwise(whole)


def links(html: Column, base: Column) -> Column:
    """Distinct valid links of a page, normalized against ``base``, in order of their first place."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    kept = F.filter(raw, lambda h: ~h.rlike(r"^(?:javascript:|mailto:|tel:|#)"))
    return F.array_distinct(F.filter(F.transform(kept, lambda h: normalize(h, base)), is_valid))
