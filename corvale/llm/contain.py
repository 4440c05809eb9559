"""Benchmark items inside documents: size-partitioned MinHash containment search, all by built-in functions.

An item's signature holds the shingles of least hash (bottom-k MinHash); each
of them lies in a document with the probability of the item's containment
there. Items are partitioned by their number of shingles: a partition has its
own signature size and number of matches asked for, and documents too short to
contain its items don't take part. The documents' shingle hashes meet the
signature values in one join; pairs with enough matches are candidates, and
only their documents are read again for the exact containment of shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles are of ``width``
words, or the whole sequence of fewer; whole texts are read. Null texts and
texts without words have no shingles: such items are found nowhere. Rows that
repeat an item or a document give one row for each pair of ids, null ids
included; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import fits_broadcast, join_spread, materialize, without_ids

#: Partition by number of shingles: below this bound -> (signature size, matches asked for). At a
#: containment of 0.8 the chance to have fewer matches is below 3e-5 in each.
PARTITIONS = ((16, 16, 4), (64, 16, 6), (256, 20, 8), (None, 24, 11))
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SPACES), "")


def with_words(rows: DataFrame, key: str) -> DataFrame:
    """(key, w): a projection of its own, as inside the functions below the words would be split again for each shingle."""
    return rows.select(key, words(F.col("text")).alias("w"))


def _shingles(w: Column, width: int, of) -> Column:
    """``of`` applied to each run of ``width`` words of ``w``; to all words if there are fewer, to nothing if there are none."""
    n = F.size(w)
    return F.when(n == 0, F.filter(F.array(of(w)), lambda _: F.lit(False))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: of(F.slice(w, i, F.lit(width)))))


def hashes(w: Column, width: int) -> Column:
    return _shingles(w, width, F.xxhash64)


def strings(w: Column, width: int) -> Column:
    return F.array_distinct(_shingles(w, width, lambda x: F.array_join(x, " ")))


def signatures(items: DataFrame, width: int) -> DataFrame:
    """(item_id, n_item, least_doc, asked, h): the values of each item's signature."""
    listed = with_words(items, "item_id").select("item_id", F.array_sort(F.array_distinct(hashes(F.col("w"), width))).alias("h")).distinct().withColumn("n_item", F.size("h"))
    size, asked, low = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    bound = 0
    for below, k, m in PARTITIONS:
        here = F.col("n_item") < below if below else F.lit(True)
        size, asked, low = F.coalesce(size, F.when(here, F.lit(k))), F.coalesce(asked, F.when(here, F.least(F.lit(m), F.ceil(F.col("n_item") * 0.4).cast("int")))), F.when((F.col("n_item") >= bound) & here, F.lit(bound)).otherwise(low)
        bound = below or bound
    return listed.select("item_id", "n_item", low.alias("partition_low"), asked.alias("asked"), F.explode_outer(F.slice("h", F.lit(1), size)).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, item_id): pairs with enough signature matches; written once."""
    signed = materialize(signatures(items, width), "items")
    hashed = with_words(docs, "doc_id").select("doc_id", hashes(F.col("w"), width).alias("own"))
    # explode_outer: for explode the optimizer would add a filter that splits the text once more for each shingle
    posted = hashed.select("doc_id", F.size("own").alias("n_doc"), "own").select("doc_id", "n_doc", F.explode_outer("own").alias("h"))
    if fits_broadcast(signed, 64):
        met = posted.join(F.broadcast(signed), "h")
    else:  # very many items: a shingle of any share of all postings is dealt over parts
        side = materialize(signed.where("h IS NOT NULL").groupBy("h").agg(F.collect_list(F.struct("item_id", "partition_low", "asked")).alias("items")), "posted-items")
        met = join_spread(posted.where("h IS NOT NULL"), side, ["h"], "doc_id", 128, "inner").select("doc_id", "n_doc", "h", F.explode("items").alias("i")).select("doc_id", "n_doc", "h", "i.*")
    met = met.where(F.col("n_doc") * den >= F.col("partition_low") * num)
    hits = met.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("matches"), F.max("asked").alias("asked"))
    return materialize(hits.where("matches >= asked").select("doc_id", "item_id"), "candidates")


def contained(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``items`` (item_id, text) where the document holds num / den or more of the item's distinct shingles.

    Gives doc_id, item_id, n_item, n_shared and containment.
    """
    found = candidates(docs, items, width, num, den)
    ids = found.select("doc_id").distinct().withColumnRenamed("doc_id", "own_id")
    docs = docs.select("doc_id", "text")
    docs = docs.join(F.broadcast(ids) if fits_broadcast(found, 32) else ids, docs["doc_id"].eqNullSafe(ids["own_id"]), "left_semi")
    texts = with_words(docs, "doc_id").select("doc_id", strings(F.col("w"), width).alias("own"))
    asked = with_words(items, "item_id").select("item_id", strings(F.col("w"), width).alias("asked")).where(F.size("asked") > 0).distinct()
    asked = materialize(asked, "asked")
    a, b = found.alias("a"), asked.alias("b")
    wanted = a.join(F.broadcast(b) if fits_broadcast(asked, 4096) else b, F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).select("a.doc_id", "a.item_id", "b.asked")
    t, w = texts.alias("t"), wanted.alias("w")
    met = t.join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("t.doc_id", "w.item_id", F.size("w.asked").alias("n_item"), F.size(F.array_intersect("t.own", "w.asked")).alias("n_shared"))
    kept = met.where(F.col("n_shared") * den >= F.col("n_item") * num)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_item").cast("long").alias("n_item"), F.col("m.n_shared").cast("long").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, all columns as they were."""
    return without_ids(docs, materialize(contained(docs, items, width, num, den).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "contaminated"))


def containment_sql(width: int = 5, num: int = 4, den: int = 5) -> str:
    """The same in DuckDB's SQL, by comparing all shingles."""

    def listed(name: str, key: str) -> str:
        w = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[ \\t-\\r]+'), lambda x: x <> '')"
        return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS s FROM (SELECT {key}, {w} AS w FROM {name}) WHERE len(w) > 0"

    return f"""
WITH d AS ({listed("documents", "doc_id")}), b AS ({listed("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * {den} >= any_value(n_item) * {num}"""
