"""Main text of web pages by wrapper induction over the pages of a host.

Each page is parsed once, where it lies, to the skeleton of its DOM (labels and
parents of elements) and its blocks of text. One page of each host is its
reference, the one nearest to the median length, so each host with any text has
one. Skeletons, never the html, meet the reference's; simple tree matching
(the largest matching of children in order, over equal labels) aligns them.

*Template.* A reference node whose text is the same in nearly all different
pages of the host is template, and goes wherever it is.

*Slots.* What varies is content. The host's wrapper is the deepest reference
node that holds nearly all varying text outside links, found by descent from
the root while one child has most of it and beside that child no paragraph,
heading, article or element of the same classes varies. Text outside it (varying notices, adverts, related pages) is
no content; inside it only what the markup says to be a menu, sidebar, advert,
form or reader comment goes, and, but for those in an article, lists of links.

*Few pages.* Hosts with too few different pages to vote, and pages that don't
fit their host's wrapper (it has less than half of the text that their own
markup marks as main), are settled by markup: all containers of the best kind
(article, main, content classes) are content.

Hosts of any size are split over tasks: the join with references and decisions
is broadcast if small, else hot hosts are salted. Only numbers meet by host.

Null and empty html give empty text; a null or odd url is a host of its own
name (the empty one). Copies of a page count once in the votes, and so
do the pages of a group of near copies (half of the text or more in blocks
that they share), so what only they have in common stays. Of equally near
reference pages the one with the least hash is taken, of equal children the
first; of equal matchings the one of later siblings. A long page takes memory
for its own skeleton and text, matching costs children times children of
aligned nodes, by distinct shapes. Repeated rows give a row each, an empty
table none; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvale.llm.common import join_bounded, join_spread, materialize, over, small_batches, tidied

#: A reference node is template if this share of the host's different pages, and at least so many, have its text.
SHARE, SUPPORT = 0.8, 5
#: The vote of a page that shares less than half of its text; near copies have about one together.
VOTE = 1 << 32

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph, or an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never content, by tag.
OUT_TAGS = frozenset("head script style noscript template nav footer aside button select textarea input iframe object svg canvas audio video dialog menu title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Not content, by a word of class or id, unless the element holds the main container.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies discussion disqus pagination pager widget widgets toolbar skip search".split()
)
MAIN_WORDS = frozenset("article post entry story content main".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Words beside one of ``OUT_WORDS`` that say nothing on what an element is: "ad-box" is an advert, "related-work" needn't be a list of links.
NEUTRAL_WORDS = frozenset(
    "area article articles b bar block body bottom box button buttons card cards col column container content desktop fixed float form full global grid group header icon icons inner item items js large left link links list main mobile outer page panel post posts primary right row secondary section site slot small sticky title top unit wrap wrapper x".split()
)
#: Words that take out a paragraph or a part of a line too; of the others an article may have some that are about its topic.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement adsense cookie cookies gdpr newsletter sponsored".split())
#: Words that as an id inside a main container may name a section of the article.
TOPIC_WORDS = frozenset("advertisement advertising banner consent cookies discussion navigation notice notices notification promotion recommendations recommended related search sharing sponsor subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text in their own right.
PROSE = HEADINGS | frozenset("p blockquote pre li dt dd td th figcaption".split())
#: Share of a node's varying text that its child must have to hold the wrapper.
DEEPER = 0.75


class Page:
    """Elements of a page in document order, and blocks of text."""

    def __init__(self, source: str):
        self.tags, self.labels, self.parents, self.children, self.out, self.main = ["#"], ["#"], [-1], [[]], [False], [0]
        #: (element, text, share of it in links)
        self.blocks: list[tuple[int, str, float]] = []
        self._parts: list[str] = []
        self._linked = 0
        #: Elements that are out unless they hold the main container: whether they may be a wrapper by their own tag and words, a section of the article.
        self._soft: dict[int, tuple[bool, bool]] = {}
        self._comments: set[int] = set()
        self._boxes: list[int] = []
        self._parse(source)
        if self._soft:
            self._settle()

    def _flush(self, at: int) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            if text and not self.out[at]:
                self.blocks.append((at, text, self._linked / len(text)))
            self._parts, self._linked = [], 0

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        role, tokens, of_class, hidden = "", [], set(), False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if name in ("class", "id"):
                    own = [frozenset(re.split(r"[^a-z]+", t)) - {""} for t in value.split()]
                    tokens += own
                    if name == "class":
                        of_class.update(*own)
                elif name == "role":
                    role = value
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
        words = frozenset().union(*tokens)
        number = len(self.tags)
        inside = self.main[parent]
        telling = [t for t in tokens if t & OUT_WORDS and t <= OUT_WORDS | NEUTRAL_WORDS]
        if inside and (tag in PROSE or tag in INLINE):
            telling = [t for t in telling if t & STRONG_WORDS]
        marked = bool(telling) and tag not in ("html", "body", "article", "main")
        out = self.out[parent] or hidden or tag in OUT_TAGS or role in OUT_ROLES or tag == "article" and bool(words & {"comment", "comments", "reply"})
        out = out or tag == "header" and not inside or marked and tag in INLINE
        topic = marked and bool(inside) and not of_class & OUT_WORDS and words & OUT_WORDS <= TOPIC_WORDS
        if not out and (marked or tag == "form" or role == "form"):
            plain = any(not t & OUT_WORDS for t in tokens)
            self._soft[number] = (not marked or plain, topic and tag == "section")
            if words & COMMENT_WORDS:
                self._comments.add(number)
        self.tags.append(tag)
        self.labels.append(tag + "." + " ".join(sorted(words)) if words else tag)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(number)
        self.out.append(out)
        rank = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if words & MAIN_WORDS and tag in ("div", "section", "td") else 0
        self.main.append(max(inside, rank))
        if rank and not out and not words & COMMENT_WORDS and (rank > 1 or not marked or any(t & MAIN_WORDS and not t & OUT_WORDS for t in tokens)):
            self._boxes.append(number)
        return number

    def _settle(self) -> None:
        """Take out the elements that by words or as forms are no content, but not those around the main container."""
        n, parents, soft = len(self.tags), self.parents, self._soft
        size, whole = [0.0] * n, [0] * n  # characters that are no links, and all
        for e, text, linked in self.blocks:
            size[e] += len(text) * max(0.0, 1 - linked)
            whole[e] += len(text)
        shut, talk, left = [False] * n, [False] * n, 0.0
        for e in range(1, n):
            shut[e] = shut[parents[e]] or e in soft
            talk[e] = talk[parents[e]] or e in self._comments
        left = sum(x for e, x in enumerate(size) if not shut[e])
        for e in range(n - 1, 0, -1):
            size[parents[e]] += size[e]
            whole[parents[e]] += whole[e]
        boxes = [e for e in self._boxes if size[e] > 0]
        seen = any(not shut[e] for e in boxes)
        free = [e for e in boxes if shut[e] and 2 * size[e] > size[0] and not (seen and talk[e])]
        if boxes and not seen:
            best = max(boxes, key=lambda e: (not talk[e], self.main[e], size[e], -e))
            free += [best] * (size[best] > left)
        if not boxes:
            free += [e for e, (wrapper, _) in soft.items() if wrapper and 2 * size[e] > size[0]]
        kept = {e for e, (_, topic) in soft.items() if topic and size[e] >= 0.4 * whole[e]}
        for e in free:
            while e > 0:
                kept.add(e)
                e = parents[e]
        for e in range(1, n):
            self.out[e] = self.out[e] or self.out[parents[e]] or e in soft and e not in kept
        self.blocks = [b for b in self.blocks if not self.out[b[0]]]

    def _parse(self, source: str) -> None:
        at, pos, block, in_link = 0, 0, 0, 0
        tags, parents = self.tags, self.parents
        n = len(source)
        while pos < n:
            m = _TOKEN.search(source, pos)
            stop = m.start() if m else n
            if stop > pos and not self.out[at]:
                piece = source[pos:stop]
                self._parts.append(piece)
                if in_link:
                    self._linked += len(piece)
            if not m:
                break
            pos = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                self._flush(block)
            if not m[1]:
                if tag in ENDS_P:  # an open paragraph ends
                    up = at
                    while up > 0 and tags[up] in INLINE:
                        up = parents[up]
                    if tags[up] == "p":
                        at, in_link = parents[up], 0
                elif tag in CLOSES:
                    kinds, bounds = CLOSES[tag]
                    up = at
                    while up > 0 and tags[up] not in bounds:
                        if tags[up] in kinds:
                            at = parents[up]
                        up = parents[up]
                if tag == "br":
                    continue
                own = self._add(tag, m[3], at)
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, pos)
                    pos = end.end() if end else n
                elif tag not in VOID and not m[3].endswith("/"):
                    at = own
                    in_link += tag == "a"
            else:
                up = at
                while up > 0 and tags[up] != tag:
                    up = parents[up]
                if up > 0:
                    at = parents[up]
                    if tag == "a":
                        in_link = max(0, in_link - 1)
            if tag not in INLINE or tags[at] not in INLINE:
                block = at
                while block > 0 and tags[block] in INLINE:
                    block = parents[block]
        self._flush(block)

    def choice(self) -> list[bool]:
        """Which blocks are content by the page's own markup: those in all containers of the best kind that has half of the text in containers, or of the whole page if there is none."""
        held = [0] * 4
        for e, text, _ in self.blocks:
            for rank in range(1, self.main[e] + 1):
                held[rank] += len(text)
        if held[1]:
            least = max(rank for rank in (1, 2, 3) if 2 * held[rank] >= held[1])
            return [self.main[e] >= least for e, _, _ in self.blocks]
        if all(linked <= 0.6 for _, _, linked in self.blocks):
            return [True] * len(self.blocks)
        whole, links = [0] * len(self.tags), [0.0] * len(self.tags)
        for e, text, linked in self.blocks:
            whole[e] += len(text)
            links[e] += len(text) * linked
        for e in range(len(self.tags) - 1, 0, -1):
            whole[self.parents[e]] += whole[e]
            links[self.parents[e]] += links[e]
        # a paragraph or heading that is a link stays, unless it stands among other links
        among = [tag in HEADINGS or tag in ("p", "blockquote") for tag in self.tags]
        return [linked <= 0.6 or among[e] and links[up := self.parents[e]] <= 0.6 * whole[up] for e, _, linked in self.blocks]

    def content(self) -> list[tuple[int, str]]:
        return [(e, t) for (e, t, _), own in zip(self.blocks, self.choice(), strict=True) if own]


class Skeleton:
    """Labels and order of a page's elements, as numbers."""

    def __init__(self, labels: list[int], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.tags = labels
        self.children: list[list[int]] = [[] for _ in labels]
        for e in range(1, len(labels)):
            self.children[parents[e]].append(e)


class Matcher:
    """Simple tree matching; sizes of matchings are remembered by the shapes of subtrees, up to about ``most`` shapes."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.shapes: dict[tuple, int] = {}
        self.kids: list[tuple] = []
        self.names: list[str] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def make_room(self) -> None:
        """Forget all shapes if they are too many; only to be called before both pages of a pair are numbered."""
        if len(self.kids) > self.most:
            self.__init__(self.most)

    def shape(self, page: Page | Skeleton) -> list[int]:
        """A number for the shape (labels and order) of each element's subtree; it holds until ``make_room`` is called."""
        out = [0] * len(page.tags)
        for e in range(len(page.tags) - 1, -1, -1):
            key = (page.labels[e], *(out[c] for c in page.children[e]))
            number = self.shapes.get(key)
            if number is None:
                number = self.shapes[key] = len(self.kids)
                self.kids.append(key[1:])
                self.names.append(key[0])
            out[e] = number
        return out

    def size(self, a: int, b: int) -> int:
        """Nodes in the largest matching of two shapes; 0 if their labels differ."""
        if self.names[a] != self.names[b]:
            return 0
        if not self.kids[a] or not self.kids[b]:
            return 1
        got = self.sizes.get((a, b))
        if got is None:
            got = self.sizes[a, b] = 1 + int(self.table(self.kids[a], self.kids[b])[-1, -1])
        return got

    def table(self, a, b) -> np.ndarray:
        """Sizes of the best matchings of the first i children with the first j, row by row."""
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        w = np.array([[self.size(x, y) for y in ub.tolist()] for x in ua.tolist()], np.int64)
        m = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i, row in enumerate(w[ia][:, ib], 1):
            np.maximum(m[i - 1, 1:], m[i - 1, :-1] + row, out=m[i, 1:])
            np.maximum.accumulate(m[i], out=m[i])
        return m

    def align(self, page: Page | Skeleton, shapes: list[int], ref: Page | Skeleton, ref_shapes: list[int]) -> list[int]:
        """For each element of ``page`` its partner in ``ref``, or -1."""
        out = [-1] * len(page.tags)
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            a, b = page.children[x], ref.children[y]
            lo = 0
            while lo < len(a) and lo < len(b) and shapes[a[lo]] == ref_shapes[b[lo]]:  # equal subtrees at the start match
                todo.append((a[lo], b[lo]))
                lo += 1
            a, b = a[lo:], b[lo:]
            if not a or not b:
                continue
            sa, sb = [shapes[e] for e in a], [ref_shapes[e] for e in b]
            if len(a) == 1 and len(b) == 1:
                if self.names[sa[0]] == self.names[sb[0]]:
                    todo.append((a[0], b[0]))
                continue
            m = self.table(sa, sb)
            i, j = len(a), len(b)
            while i and j:
                if m[i, j] == m[i - 1, j]:
                    i -= 1
                elif m[i, j] == m[i, j - 1]:
                    j -= 1
                else:
                    todo.append((a[i - 1], b[j - 1]))
                    i, j = i - 1, j - 1
        return out


TREE = (
    "rid long, page_id long, url string, host string, digest long, labels array<int>, parents array<int>, kinds array<byte>, "
    "nodes array<int>, texts array<string>, marks array<long>, sizes array<int>, links array<int>, own array<boolean>"
)
#: What an element is for the wrapper: text in its own right, a list or box that may hold links alone, a container that is content by name, of a class or id.
IS_PROSE, IS_BOX, IS_MAIN, IS_NAMED = 1, 2, 4, 8
BOXES = frozenset("ul ol dl div section table tbody tr details fieldset".split())


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _label(label: str) -> int:
    return zlib.crc32(label.encode()) - (1 << 31)


@tidied
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html) to skeletons and blocks; ``own`` says which blocks are content by the page's markup."""
    types = [f.split()[1] for f in TREE.split(", ")]
    simple = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_()}
    kinds = [pa.list_(simple[t[6:-1]]) if t.startswith("array") else simple[t] for t in types]
    rid = TaskContext.get().partitionId() << 33
    for batch in batches:
        rows = []
        for page_id, url, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(source or "")
            texts = [t for _, t, _ in page.blocks]
            marks = [_mark(t) for t in texts]
            kind = [IS_PROSE * (t in PROSE) | IS_BOX * (t in BOXES) | IS_MAIN * (t in ("article", "main")) | IS_NAMED * (t != x) for t, x in zip(page.tags, page.labels, strict=True)]
            rows.append(
                (rid, page_id, url, host, _mark("\n".join(texts)), [_label(x) for x in page.labels], page.parents, kind, [e for e, _, _ in page.blocks],
                 texts, marks, [len(t) for t in texts], [min(len(t), round(share * len(t))) for _, t, share in page.blocks], page.choice())
            )
            rid += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in TREE.split(", ")])


def _texts_of(nodes: list[int], marks: list[int]) -> dict[int, int]:
    """One number for all the text that an element has of its own."""
    out: dict[int, int] = {}
    for e, m in zip(nodes, marks, strict=True):
        out[e] = hash((out[e], m)) if e in out else m
    return out


def _aligned(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Skeletons with their reference's to: for each block the reference node that is its element's partner (or -1) or its nearest partnered ancestor's, and whether the text is the same there."""
    matcher = Matcher(most)
    refs: dict[str, tuple[Skeleton, dict[int, int]]] = {}
    for batch in batches:
        at, under, same = [], [], []
        c = {name: batch.column(name).to_pylist() for name in ("host", "labels", "parents", "nodes", "marks", "ref_labels", "ref_parents", "ref_nodes", "ref_marks")}
        for host, labels, parents, nodes, marks, *ref in zip(*c.values(), strict=True):
            if ref[0] is None or not nodes:
                at.append([-1] * len(nodes))
                under.append([0] * len(nodes))
                same.append([False] * len(nodes))
                continue
            if host not in refs:
                if len(refs) > 2000:
                    refs.clear()
                refs[host] = Skeleton(ref[0], ref[1]), _texts_of(ref[2], ref[3])
            page, (known, texts) = Skeleton(labels, parents), refs[host]
            matcher.make_room()
            shapes = matcher.shape(page)
            partner = matcher.align(page, shapes, known, matcher.shape(known))
            near = partner.copy()
            for e in range(1, len(near)):
                if near[e] < 0:
                    near[e] = near[parents[e]]
            mine = _texts_of(nodes, marks)
            at.append([partner[e] for e in nodes])
            under.append([near[e] for e in nodes])
            same.append([partner[e] >= 0 and texts.get(partner[e]) == mine[e] for e in nodes])
        cols = [pa.array(at, pa.list_(pa.int32())), pa.array(under, pa.list_(pa.int32())), pa.array(same, pa.list_(pa.bool_()))]
        keep = ["rid", "host", "digest", "sizes", "links", "marks", "own"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *cols], [*keep, "at", "under", "same"])


def _weights(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, digest, weight) of each different page, and (host, total) of the weights.

    Half of a page's text or more lies in blocks that at most ``c`` different
    pages of the host have; for the smallest such ``c`` its weight is VOTE / c.
    The pages of a group of near copies thus have about one vote together,
    while boilerplate of less than half of a page doesn't lower its weight.
    """
    each = blocks.select("host", "digest", F.explode(F.arrays_zip("marks", "sizes")).alias("b")).select("host", "digest", F.col("b.marks").alias("mark"), F.col("b.sizes").cast("long").alias("n"))
    own = materialize(each.groupBy("host", "digest", "mark").agg(F.max("n").alias("n")), "marks")
    shared = materialize(own.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-marks")
    counts = join_spread(own, shared, ["host", "mark"], "digest", 64).select("host", "digest", F.coalesce("c", F.lit(1)).cast("long").alias("c"), "n")
    sums = counts.groupBy("host", "digest", "c").agg(F.sum("n").alias("n")).groupBy("host", "digest").agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("parts"), F.sum("n").alias("size"))
    half = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("c")),
        lambda s, x: F.when(2 * s["upto"] >= F.col("size"), s).otherwise(F.struct((s["upto"] + x["n"]).alias("upto"), x["c"].alias("c"))),
        lambda s: s["c"],
    )
    weights = materialize(sums.select("host", "digest", half.alias("c")).select("host", "digest", F.floor(F.lit(VOTE) / F.col("c")).cast("long").alias("weight")), "weights")
    return weights, materialize(weights.groupBy("host").agg(F.sum("weight").alias("total")), "totals")


def wrapper_of(labels: list[int], parents: list[int], kinds: list[int], prose: list[float], links: list[float]) -> list[bool]:
    """Which reference nodes are open: in the wrapper, and not in a list of links.

    ``prose`` and ``links`` are the varying characters outside and inside links
    that hang on each node in all pages of the host.
    """
    n = len(parents)
    held, linked = list(prose), list(links)
    children: list[list[int]] = [[] for _ in parents]
    for e in range(n - 1, 0, -1):
        held[parents[e]] += held[e]
        linked[parents[e]] += linked[e]
        children[parents[e]].append(e)
    top = 0
    while not kinds[top] & IS_MAIN and children[top]:
        child = max(children[top], key=lambda e: (held[e], -e))
        alike = [e for e in children[top] if e != child and held[e] > 0]
        beside = any(kinds[e] & (IS_PROSE | IS_MAIN) or kinds[e] & IS_NAMED and labels[e] == labels[child] for e in alike)
        if not held[child] or held[child] < DEEPER * held[top] or beside or kinds[child] & IS_PROSE or prose[top] > (1 - DEEPER) / 5 * held[top]:
            break
        top = child
    is_open, menu, article = [False] * n, [False] * n, [False] * n
    for e in range(n):
        up = parents[e]
        article[e] = bool(kinds[e] & IS_MAIN) or e > 0 and article[up]
        menu[e] = e > 0 and menu[up] or e != top and bool(kinds[e] & IS_BOX) and linked[e] > 0.6 * (held[e] + linked[e])
        is_open[e] = (e == top or e > 0 and is_open[up]) and (article[e] or not menu[e])
    return is_open


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a host: its reference's skeleton and the varying text on its nodes, to the open nodes."""
    for batch in batches:
        out = []
        for labels, parents, kinds, mass in zip(*(batch.column(c).to_pylist() for c in ("ref_labels", "ref_parents", "ref_kinds", "mass")), strict=True):
            prose, links = [0.0] * len(parents), [0.0] * len(parents)
            for m in mass:
                prose[m["node"]], links[m["node"]] = m["prose"], m["links"]
            out.append([e for e, yes in enumerate(wrapper_of(labels, parents, kinds, prose, links)) if yes])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int32()))], ["host", "open"])


def extract(pages: DataFrame, share: float = SHARE, support: int = SUPPORT, align: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of ``pages`` (page_id, url, html); without ``align`` markup alone decides."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#]*)", 1), F.lit("")))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    trees = materialize(small_batches(given, 256).mapInArrow(_trees, TREE), "trees")
    if not align:
        return _joined(trees.withColumn("keep", F.col("own")), pages)
    # the reference: the page nearest to the median length of the host's pages that have any text, ties by a hash of it
    length = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    filled = trees.where(F.size("sizes") > 0).select("host", length.alias("n"), "digest", "rid")
    medians = materialize(filled.groupBy("host").agg(F.expr("percentile(n, 0.5)").alias("median")), "medians")
    nearest = F.min(F.struct(F.abs(F.col("n") - F.col("median")).alias("far"), "digest", "rid")).alias("ref")
    chosen = materialize(join_spread(filled, medians, ["host"], "rid", 64).groupBy("host").agg(nearest).select(F.col("ref.rid").alias("rid")), "reference-ids")
    refs = join_bounded(trees, chosen, "rid", "left_semi", 32)
    refs = materialize(refs.select("host", *(F.col(c).alias(f"ref_{c}") for c in ("labels", "parents", "kinds", "nodes", "marks"))), "references")
    rows, nodes = refs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ref_labels") + F.size("ref_nodes")), F.lit(0))).first()
    met = join_spread(trees.select("rid", "host", "digest", "labels", "parents", "nodes", "marks", "sizes", "links", "own"), refs, ["host"], "rid", 64 + 32 * nodes // max(rows, 1))
    schema = "rid long, host string, digest long, sizes array<int>, links array<int>, marks array<long>, own array<boolean>, at array<int>, under array<int>, same array<boolean>"
    aligned = materialize(met.mapInArrow(tidied(_aligned), schema), "aligned")
    weights, totals = _weights(aligned)
    # template: nodes whose text is the same in nearly all different pages
    each = aligned.select("host", "digest", F.explode(F.arrays_zip("at", "under", "same", "sizes", "links")).alias("b")).select("host", "digest", "b.*")
    different = each.where("same").groupBy("host", "at", "digest").agg(F.lit(1).alias("one"))
    light = weights.where(F.col("weight") < VOTE)
    weight = F.coalesce(F.col("weight"), F.lit(VOTE))
    counted = join_spread(different, light, ["host", "digest"], "at", 64).groupBy("host", "at").agg(F.sum(weight).alias("same"))
    enough = (F.col("same") >= support * VOTE) & (F.col("same") >= F.col("total") * share)
    template = materialize(join_bounded(counted, totals, "host", "inner", 64).where(enough).groupBy("host").agg(F.collect_set("at").alias("constant")), "template")
    # slots: varying text on each node of the reference, at most as many rows for a host as the reference has nodes
    known = totals.where(F.col("total") >= support * VOTE).select("host")
    mass = each.where(~F.col("same")).groupBy("host", F.col("under").alias("node")).agg(F.sum(F.col("sizes") - F.col("links")).cast("double").alias("prose"), F.sum("links").cast("double").alias("links"))
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("node", "prose", "links")).alias("mass"))
    decided = refs.select("host", "ref_labels", "ref_parents", "ref_kinds").join(known, "host", "left_semi").join(mass, "host").mapInArrow(_decided, "host string, open array<int>")
    decided = materialize(decided.join(template, "host", "full_outer"), "wrappers")
    rows, nodes = decided.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("open"), F.lit(0)) + F.greatest(F.size("constant"), F.lit(0))), F.lit(0))).first()
    placed = join_spread(aligned.select("rid", "host", "at", "under", "same", "sizes", "own"), decided, ["host"], "rid", 64 + 8 * nodes // max(rows, 1))
    blocks = F.arrays_zip("at", "under", "same", "sizes", "own")
    stays = lambda b: F.col("constant").isNull() | ~b["same"] | ~F.array_contains("constant", b["at"])
    inside = F.transform(blocks, lambda b: F.coalesce(F.array_contains("open", b["under"]), F.lit(False)) & stays(b))
    marked = F.transform(blocks, lambda b: b["own"] & stays(b))
    placed = placed.select("rid", "sizes", inside.alias("inside"), marked.alias("marked"))
    size = lambda c: F.aggregate(F.zip_with(c, "sizes", lambda k, n: F.when(k, n).otherwise(0)), F.lit(0), lambda a, x: a + x)
    placed = placed.select("rid", F.when(2 * size("inside") >= size("marked"), F.col("inside")).otherwise(F.col("marked")).alias("keep"))
    return _joined(join_bounded(trees, materialize(placed, "choices"), "rid", "left", 256), pages)


def _joined(trees: DataFrame, pages: DataFrame) -> DataFrame:
    kept = F.filter(F.zip_with("texts", "keep", lambda t, k: F.when(k, t)), lambda t: t.isNotNull())
    rows = trees.select("page_id", "url", F.array_join(kept, " ").alias("text"))
    return over(rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")), pages.sparkSession)
