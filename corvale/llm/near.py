"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Each distinct shingle set gives a signature of ``SIZE`` coordinates. Sets are
posted under each coordinate-value pair; pairs of sets that agree in at least
``least_matches`` coordinates are candidates, confirmed on the full sets:

* equal sets are one entry from the start, whatever their number;
* pairs that only one set has are dropped, and sets with too few others left
  are skipped: they can't reach the number of matches;
* of the rest a set is posted only under its rarest pairs, as many as make two
  sets with enough matches meet once (prefix filter), so frequent pairs, as of
  a common passage, are never merged;
* lists carry signatures alone. A survey of each list marks the sets that have
  a partner there, with enough matches and no earlier list in common; only
  those meet again with their texts, to be confirmed;
* a list longer than ``BLOCK`` is cut into blocks, each surveyed and confirmed
  together with some sets that all blocks of the list share, which connects
  most of a group of near copies. Then only sets outside a list's largest
  component visit its other blocks, and pairs in one component are not tried,
  so a large group costs what its rows do and no list has to fit a task;
* a pair of sets is tried in the first list that both are in, and not at all
  where the links found there connect them already. A task gives links that
  connect its sets, at most one less than it has sets.

Links become components by hooking and pointer jumping in joins. Of sets that
are equally popular in a list the one of lower place is tried first; of equal
ids in a component the smallest is kept. Texts of any length are worked on
whole, at some 60 bytes of memory for each of their own.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased. Texts
with fewer words than a shingle have the whole sequence as one shingle; null
texts and texts without words have none and are linked with nothing. Repeated
rows are in one component, as are rows without a doc_id only if their own set
links them; a component's id is its smallest doc_id. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvale.llm.common import fits_broadcast, grouped, join_bounded, join_spread, materialize, mix64, over, shingle_hashes, small_batches, text_bytes, tidied, whole_groups, without_ids

SIZE = 64
BLOCK = 512
_A = mix64(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches(num: int, den: int, size: int = SIZE, deviations: float = 4.0) -> int:
    """Matches that a pair of similarity num / den has but for chance: its mean less ``deviations`` standard deviations."""
    j = num / den
    return max(1, int(np.floor(size * j - deviations * np.sqrt(size * j * (1 - j)))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (not empty) the 32 high bits of the least value of each of ``SIZE`` mixings of its hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SIZE), np.uint32)
    for k in range(SIZE):
        v = flat * _A[k]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set; null if empty) and signature of each document; written once."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_hashes(text_bytes(batch.column(1)), width)
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full)) if full else iter(())
            keys = [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "key", "signature"],
            )

    return materialize(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_shingles long, key binary, signature binary"), "signatures")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, token) for each coordinate-value pair of a set."""
    high = np.arange(SIZE, dtype=np.int64) << 32
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, SIZE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), SIZE)), pa.array((sigs | high).ravel())], ["doc", "token"])


def _exact(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


#: Sets of a long list that all its blocks share.
SHARED = 16


def _first_shared(a: np.ndarray, b: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Whether ``token`` is the first that the rows of two arrays of prefixes (in one order, filled up with -1 and -2) have in common."""
    equal = a[:, :, None] == b[:, None, :]
    first = equal.any(2).argmax(1)
    return a[np.arange(len(a)), first] == token


def _survey(batches: Iterator[pa.RecordBatch], least: int, across: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group (token, block) those with a partner in their group: enough matches, the token the first that both share, different components.

    With ``across`` one of the two must be a visitor, the other at home.

    Rows of a whole run of groups are compared at once, each with the one
    ``shift`` places later, for all shifts up to the largest group's size.
    """
    for table in whole_groups(batches, ["token", "block"]):
        n = table.num_rows
        if n < 2:
            continue
        col = lambda name: table.column(name).to_numpy()
        token, block, comp, mover = col("token"), col("block"), col("component"), col("visits")
        sigs = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(n, SIZE)
        raw = table.column("prefix").to_pylist()
        width = max(map(len, raw))
        prefix = np.array([[*p, *[-1] * (width - len(p))] for p in raw], np.int64)
        other = np.where(prefix == -1, -2, prefix)
        start = np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])]
        group = np.cumsum(start)
        largest = int(np.bincount(group).max())
        met = np.zeros(n, bool)
        for shift in range(1, largest):
            pairs = (group[shift:] == group[:-shift]) & (comp[shift:] != comp[:-shift])
            i = np.flatnonzero(pairs & (mover[shift:] != mover[:-shift]) if across else pairs)
            for lo in range(0, len(i), 4096):
                x = i[lo : lo + 4096]
                x = x[(sigs[x] == sigs[x + shift]).sum(1) >= least]
                if len(x):
                    x = x[_first_shared(prefix[x], other[x + shift], token[x])]
                    met[x] = met[x + shift] = True
        if met.any():
            kept = table.filter(pa.array(met)).select(["token", "block", "doc", "component", "visits"])
            yield from kept.combine_chunks().to_batches()


def _links(rows: list[dict], least: int, width: int, num: int, den: int, across: bool) -> list[tuple[int, int]]:
    """Links that connect the sets of one group, beyond what their components connect."""
    n, token = len(rows), rows[0]["token"]
    place: dict[int, int] = {}
    parent = [place.setdefault(r["component"], i) for i, r in enumerate(rows)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sigs = np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(-1, SIZE)
    order = [r["prefix"] for r in rows]
    visits = np.array([r["visits"] for r in rows], bool)
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_hashes([zstandard.decompress(rows[i]["text"])], width)[0]
        return sets[i]

    popular = np.zeros(n, np.int64)  # the sets nearest to what most have in common come first: they link most others
    for k in range(SIZE):
        _, inverse, counts = np.unique(sigs[:, k], return_inverse=True, return_counts=True)
        popular += counts[inverse]
    out = []
    for i in np.argsort(-popular, kind="stable").tolist():
        others = np.arange(n)
        later = (popular < popular[i]) | ((popular == popular[i]) & (others > i))
        others = others[later & (visits != visits[i]) if across else later]
        matches = (sigs[others] == sigs[i]).sum(1)
        mine = order[i]
        for j in others[matches >= least].tolist():
            if rows[i]["doc"] == rows[j]["doc"] or root(i) == root(j):
                continue
            his = set(order[j])
            if next((t for t in mine if t in his), None) == token and _exact(shingles(i), shingles(j), num, den):
                parent[root(i)] = root(j)
                out.append((rows[i]["doc"], rows[j]["doc"]))
    return out


GROUPED = "token long, block long, doc long, component long, visits boolean"


def _confirmed(postings: DataFrame, sets: DataFrame, texts: DataFrame, least: int, width: int, num: int, den: int, across: bool) -> DataFrame:
    """(a, b): confirmed links among the rows (token, block, doc, component, visits, signature, prefix) of each group."""
    keys = [F.col("token"), F.col("block")]

    @tidied
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _survey(batches, least, across)

    @tidied
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped(batches, ["token", "block"]):
            found = _links(own.to_pylist(), least, width, num, den, across) if own.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = small_batches(postings, 1024).repartition(*keys).sortWithinPartitions(*keys, "doc")
    met = materialize(dealt.mapInArrow(survey, GROUPED), "surveyed")
    full = met.join(join_bounded(sets, met.select("doc").distinct(), "doc", "left_semi", 32), "doc").join(_texts(texts, met), "doc")
    dealt = small_batches(full, 1024).repartition(*keys).sortWithinPartitions(*keys, "doc")
    return materialize(dealt.mapInArrow(confirm, "a long, b long").distinct(), "links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text): the compressed texts of the documents that ``wanted`` (doc) names."""
    ids = wanted.select("doc").distinct()
    own = docs.join(F.broadcast(ids) if fits_broadcast(wanted, 32) else ids, "doc", "left_semi")

    @tidied
    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zstandard.compress(t, 3) for t in text_bytes(batch.column(1))], pa.binary())], ["doc", "text"])

    return small_batches(own, 1024).mapInArrow(squeezed, "doc long, text binary").groupBy("doc").agg(F.first("text").alias("text"))  # rows that repeat a doc_id: one of them


def links(docs: DataFrame, sigs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): confirmed links between the smallest doc_ids of distinct sets, enough to connect all that links connect."""
    least = least_matches(num, den)
    prefix = SIZE - least + 1
    reps = materialize(sigs.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature")).select("doc", "signature"), "sets")
    tokens = reps.mapInArrow(_tokens, "doc long, token long")
    frequent = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "frequent")
    kept = join_spread(tokens, frequent, ["token"], "doc", 32, "inner", counts=frequent.withColumnRenamed("df", "n"), total=SIZE * reps.count())
    # the pairs of a set that no other has come first in the common order (by frequency, then token) and use up its prefix
    per_set = kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own")).withColumn("room", F.lit(prefix - SIZE) + F.size("own")).where(F.col("room") > 0)
    chosen = materialize(per_set.select("doc", F.expr("slice(own, 1, room)").alias("own")).join(reps, "doc"), "prefixes")
    of_set = ("doc", "signature", F.transform("own", lambda x: x["token"]).alias("prefix"))
    sets = chosen.select(*of_set)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where(F.col("doc").isNotNull())
    listed = chosen.select(*of_set, F.explode("own").alias("at")).select("doc", "signature", "prefix", "at.token", F.ceil(F.col("at.df") / BLOCK).cast("long").alias("blocks"))
    listed = listed.withColumn("home", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    # in a long list the sets of least hash are in all blocks
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("doc", F.lit(1)), "doc"))
    long = materialize(listed.where("blocks > 1").select("token", "doc", "blocks", "home"), "long-lists")
    shared = materialize(long.withColumn("r", place).where(F.col("r") <= SHARED).drop("r"), "shared")
    away = shared.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> home").join(sets, "doc")
    cols = ("token", "block", "doc", "component", "visits", "signature", "prefix")
    plain = {"component": F.col("doc"), "visits": F.lit(False)}
    first = listed.withColumn("block", F.col("home")).withColumns(plain).select(*cols).unionByName(away.withColumns(plain).select(*cols))
    found = _confirmed(first, sets, texts, least, width, num, den, across=False)
    if not shared.limit(1).count():
        return found
    # what long lists still have to try: pairs in different blocks and components
    known = materialize(components(found), "known")
    joined = join_bounded(long, known, "doc", "left", 32).withColumn("component", F.coalesce("component", "doc"))
    sizes = joined.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("several"), (F.sum("n") - F.max("n")).alias("movers"))
    main = materialize(sizes.where("several > 1").select("token", "main", F.ceil(F.col("movers") / BLOCK).cast("long").alias("parts")), "main")
    left = join_spread(joined, main, ["token"], "doc", 32, "inner")
    part = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at")
    visit = left.where(F.col("component") != F.col("main")).select("token", "doc", "component", "parts", "home", other).where("at <> home")
    visit = visit.select("token", (F.col("at") * F.col("parts") + part).alias("block"), "doc", "component", F.lit(True).alias("visits"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    stay = left.select("token", "doc", "component", "parts", "home", each).select("token", (F.col("home") * F.col("parts") + F.col("part")).alias("block"), "doc", "component", F.lit(False).alias("visits"))
    again = stay.unionByName(visit).join(sets, "doc").select(*cols)
    return found.union(_confirmed(again, sets, texts, least, width, num, den, across=True))


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Each round hooks both ends of an edge to the smaller of their labels and
    replaces edges by those between labels, which loses none and shortens
    paths; edges whose ends agree are done. Labels met are chained at the end.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = None
    while True:
        # a round that changes nothing leaves equal numbers, sums and sums of hashes behind
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == mark:
            return edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("doc"), "component")
        mark = seen
        # large star: neighbours above an id go to its least neighbour; small star: those below too. An id may have any number of them
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = join_spread(both, low, ["u"], "v", 32, "inner").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = join_spread(large, least, ["b"], "a", 32, "inner")
        small = small.select(F.col("m").alias("a"), F.col("b")).union(small.where("a <> m").select(F.col("m"), F.col("a"))).toDF("a", "b").where("a <> b").distinct()
        edges = materialize(small, "links")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: n_shingles, component_id and whether it is the one kept, for links of similarity num / den or more."""
    sigs = signed(docs, width)
    found = components(links(docs, sigs, width, num, den))
    least = sigs.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc"))
    of_key = materialize(least.join(found, "doc", "left").select("key", F.coalesce("component", "doc").alias("of_set")), "components")
    met = join_spread(sigs.select("doc_id", "n_shingles", "key"), of_key, ["key"], "doc_id", 64)
    component = F.coalesce("of_set", "doc_id")
    return over(met.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), docs.sparkSession)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller doc_id; all columns as they were.

    Rows that repeat a doc_id are one document and stay or go together; rows without a doc_id stay.
    """
    marked = near_duplicates(docs, width, num, den).where(~F.col("kept") & F.col("doc_id").isNotNull())
    return without_ids(docs, materialize(marked.select("doc_id").distinct(), "gone"))
