"""HTML extraction by wrapper induction.

Pages of one host are aligned as DOM trees by simple tree matching. The tree
they share is the wrapper: text that stays the same in a node over many
differing pages is template; slots whose text varies are content, unless they
stand in a part that tag, class or role names as boilerplate. Where a page has an
article or main element, its content lies inside it; otherwise it is all of the
page's own varying text, without blocks that are mostly links.

Each task folds the pages it reads into one tree of labels per host and gives
each block of text its slot there. A host's trees are merged in two rounds (the
same matching), each task's tree is aligned with the merged one, and the texts of
a slot are then counted as DataFrame aggregations over all pages. Pages with
equal bodies count once, so copies of one page are no template. For extraction a
task reads a host's wrapper once, before that host's pages; hosts with more than
HOT bytes are dealt to several tasks by a salt.

Edge cases: a null or empty html gives empty text; a host with too few differing
pages has no template text and is judged by structure alone; broken markup is
read as browsers do (unclosed elements end with their parent, unclosed comments
and scripts at the end of the page); elements nested deeper than DEPTH count as
part of the one at that depth; pages whose url is null or names no host share one
wrapper; repeated pages each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import graph

#: Pages that must differ before text that stays is template, and the share of pages it must be in.
DIFFERENT, STAYS = 5, 0.5
#: Hosts whose trees a task holds before it passes them on; blocks of text in a batch.
HOSTS, FACTS = 500, 20_000
#: Bytes of a host's pages that one task extracts, and tasks of the first round of merging.
HOT, ROUND = 32 << 20, 64
DEPTH, LONG_TAG = 128, 8192

# HTML's own vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead div section article body nav footer header aside main select".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu dialog head".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager paywall popup promo promoted recommended related replies reply respond search share sharing shares sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

TEXT = re.compile(r"[^<]+")
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: A value opens a quotation only after its equals sign. Possessive: no backtracking.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Node:
    """A block element: items are its kids and its runs of inline text, in page order."""

    __slots__ = ("tag", "label", "items", "up", "depth", "bad", "main", "inside")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.up, self.items = tag, up, []
        self.depth = up.depth + 1 if up else 0
        # 2: boilerplate by tag or role, 1: by a word of its class or id.
        self.bad, self.main = 2 * (tag in BOILERPLATE_TAGS), tag in ("article", "main")
        self.label = tag
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                words = PARTS.findall(value)
                if m[1].lower() == "role":
                    self.bad = max(self.bad, 2 * (value in BOILERPLATE_ROLES))
                    self.main |= value in ("main", "article")
                else:
                    self.bad = max(self.bad, int(not BOILERPLATE_WORDS.isdisjoint(words) and tag not in ("body", "html", "article", "main")))
                    self.label += "." + "-".join(words)
        self.inside = self.main or (up is not None and up.inside)
        # A header inside an article holds its title.
        if tag == "header" and up is not None and up.inside:
            self.bad = 0


class Parser:
    """One pass over a page, in time that grows with its length: a tag that is not
    closed within LONG_TAG characters ends at the first > instead."""

    def __init__(self, page: str):
        self.page = page
        self.root = self.at = Node("#", "", None)
        self.run: list[str] = []
        self.links = self.linked = 0
        #: Open elements below DEPTH, which have no node.
        self.deep: list[str] = []
        self.n_deep: Counter = Counter()
        self.read()

    def close(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            if text:
                self.at.items.append((text, min(len(text), self.linked)))
            self.run.clear()
        self.linked = 0

    def text(self, text: str) -> None:
        self.run.append(text)
        if self.links:
            self.linked += len(text)

    def read(self) -> None:
        page, pos, last = self.page, 0, self.page.rfind(">")
        while pos < len(page):
            if page[pos] != "<":
                m = TEXT.match(page, pos)
                self.text(m[0])
            elif m := SKIPPED.match(page, pos):
                pass
            elif pos < last and (m := TAG.match(page, pos, pos + LONG_TAG) or SIMPLE_TAG.match(page, pos)):
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    self.run.append(" ")
                    if not m[3].endswith("/") or tag != "svg":
                        stop = END[tag].search(page, m.end())
                        pos = stop.end() if stop else len(page)
                        continue
                else:
                    self.start(tag, m[3])
            else:
                self.text("<")
                pos += 1
                continue
            pos = m.end()
        self.close()

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE:
            return
        if self.n_deep[tag]:
            self.close()
            while (gone := self.deep.pop()) != tag:
                self.n_deep[gone] -= 1
            self.n_deep[tag] -= 1
            return
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.up
        if x is not self.root:
            self.close()
            self.at, self.links = x.up, 0
            self.deep.clear()
            self.n_deep.clear()
        elif tag == "p":
            self.close()

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = 1
            elif tag in ("br", "img", "input"):
                self.run.append(" ")
            return
        self.close()
        self.links = 0
        if tag in CLOSES_P:
            self.implied("p")
        for same in SAME.get(tag, ()):
            self.implied(same)
        if self.at.depth >= DEPTH:
            if tag not in VOID and not attributes.endswith("/"):
                self.deep.append(tag)
                self.n_deep[tag] += 1
            return
        node = Node(tag, attributes, self.at)
        self.at.items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            self.at = node

    def implied(self, tag: str) -> None:
        """Ends an open element that the next tag can't stand in."""
        x = self.at
        while x is not self.root and x.tag != tag and x.tag not in SCOPE:
            x = x.up
        if x.tag == tag:
            self.at = x.up
            self.deep.clear()
            self.n_deep.clear()


def parse(page: str) -> Node:
    return Parser(page).root


def worst(bad: int, x: Node) -> int:
    """Badness below x. An article or main element inside a part that only its
    class makes look like boilerplate is content after all."""
    bad = max(bad, x.bad)
    return 0 if x.main and bad == 1 else bad


def walk(root: Node) -> Iterator[tuple[Node, int, bool]]:
    """Every node, its badness, and whether it stands in an article or main element."""
    stack = [(root, 0, False)]
    while stack:
        x, bad, inside = stack.pop()
        bad, inside = worst(bad, x), inside or x.main
        yield x, bad, inside
        stack += [(k, bad, inside) for k in reversed(x.items) if isinstance(k, Node)]


def key(text: str) -> int:
    h = xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Slot:
    """A node of a wrapper; of a page, the kids of its nodes that share a label."""

    __slots__ = ("label", "kids", "num", "nodes")

    def __init__(self, label: str, kids: list[Slot] | None = None, num: int = 0, nodes: list[Node] | None = None):
        self.label, self.kids, self.num, self.nodes = label, kids or [], num, nodes

    def all(self) -> Iterator[Slot]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack += reversed(x.kids)

    def packed(self) -> bytes:
        def plain(s: Slot) -> tuple:
            return s.label, s.num, [plain(k) for k in s.kids]

        return pickle.dumps(plain(self), 5)


def unpacked(blob: bytes) -> Slot:
    def build(label: str, num: int, kids: list) -> Slot:
        return Slot(label, [build(*k) for k in kids], num)

    return build(*pickle.loads(blob))


def page_tree(root: Node) -> Slot:
    """A page as slots: kids of one label, of all the nodes of a slot, make up one."""
    top = Slot(root.label, nodes=[root])
    todo = [top]
    while todo:
        s = todo.pop()
        by: dict[str, Slot] = {}
        for node in s.nodes:
            for k in node.items:
                if isinstance(k, Node):
                    if k.label not in by:
                        by[k.label] = Slot(k.label, nodes=[])
                    by[k.label].nodes.append(k)
        s.kids = list(by.values())
        todo += s.kids
    return top


def simple_tree_matching(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[Slot, Slot, list]]]:
    """The largest number of matched nodes of two ordered forests, and the matched
    roots, each with the matching of its kids."""
    names = [x.label for x in a]
    if names == [y.label for y in b] and len(set(names)) == len(names):
        pairs = [(x, y, *simple_tree_matching(x.kids, y.kids)) for x, y in zip(a, b, strict=True)]
        return len(a) + sum(p[2] for p in pairs), [(x, y, sub) for x, y, _, sub in pairs]
    below = {(i, j): simple_tree_matching(x.kids, y.kids) for i, x in enumerate(a) for j, y in enumerate(b) if x.label == y.label}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            w = best[i][j] + 1 + below[i, j][0] if (i, j) in below else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], w)
    i, j, pairs = len(a), len(b), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j], below[i, j][1]))
    return best[-1][-1], pairs[::-1]


def merge(a: Slot, b: Slot, count: int = 0) -> int:
    """Folds b into a. Slots of b get the numbers of theirs in a, new ones count,
    count + 1 and so on; the next number is returned."""
    b.num = a.num
    stack = [(a, b, simple_tree_matching(a.kids, b.kids)[1])]
    while stack:
        x, y, pairs = stack.pop()
        mine = {id(q): (p, sub) for p, q, sub in pairs}
        kids, at = list(x.kids), 0
        for q in y.kids:
            if id(q) in mine:
                p, sub = mine[id(q)]
                q.num = p.num
                at = next(i for i in range(at, len(kids)) if kids[i] is p) + 1
                stack.append((p, q, sub))
            else:
                p = Slot(q.label, num=count)
                q.num = count
                count += 1
                kids.insert(at, p)
                at += 1
                stack.append((p, q, []))
        x.kids = kids
    return count


def matched(a: Slot, b: Slot) -> Iterator[tuple[Slot, Slot]]:
    """The pairs of slots that simple tree matching aligns."""
    stack = [(a, b, simple_tree_matching(a.kids, b.kids)[1])]
    while stack:
        x, y, pairs = stack.pop()
        yield x, y
        stack += pairs


def blocks(root: Node, slots: dict[int, int], template: set) -> list[str]:
    """The page's content; slots: number of each node's slot, by id."""
    seen = list(walk(root))
    main = any(inside and not bad and any(isinstance(k, tuple) for k in x.items) for x, bad, inside in seen)
    out: list[str] = []
    state = {id(x): (bad, inside) for x, bad, inside in seen}
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            stack += [(k, x) if isinstance(k, tuple) else k for k in reversed(x.items)]
            continue
        (text, linked), node = x
        bad, inside = state[id(node)]
        if not bad and (inside if main else 2 * linked <= len(text)) and not (template and (slots.get(id(node), -1), key(text)) in template):
            out.append(text)
    return out


class Wrapper:
    """A host's merged tree and its template texts, as (slot, key of the text)."""

    def __init__(self, top: Slot, template: set):
        self.top, self.template = top, template

    def extract(self, root: Node) -> str:
        if not self.template:
            return "\n".join(blocks(root, {}, self.template))
        slots = {id(node): mine.num for mine, other in matched(self.top, page_tree(root)) for node in other.nodes}
        return "\n".join(blocks(root, slots, self.template))


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host one row with a tree, and (host's key, tree, slot, key of a text,
    key of the page's body) for each text of a slot, and once with text 0 for each
    slot that has texts. Of pages with equal bodies a tree tells of the first."""
    names = ["h", "tree", "slot", "text", "body", "host", "blob", "bytes"]
    first = TaskContext.get().partitionId() << 24
    tops: dict[str, list] = {}
    facts: list[tuple] = []
    done = 0

    def told() -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in zip(*facts, strict=True)]
        n = len(facts)
        facts.clear()
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)

    def trees() -> pa.RecordBatch:
        none = [pa.nulls(len(tops), pa.int64())] * 3
        t = tops.values()
        return pa.RecordBatch.from_arrays([pa.array([x[4] for x in t], pa.int64()), pa.array([x[2] for x in t], pa.int64()), *none, pa.array(list(tops), pa.string()), pa.array([x[0].packed() for x in t], pa.binary()), pa.array([x[3] for x in t], pa.int64())], names)

    for batch in batches:
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not page:
                continue
            if h not in tops:
                if len(tops) >= HOSTS:
                    yield trees()
                    tops.clear()
                tops[h] = [Slot("#"), 1, first + done, 0, key(h), set()]
                done += 1
            top = tops[h]
            root = parse(page)
            tree = page_tree(root)
            top[1] = merge(top[0], tree, top[1])
            top[3] += len(page)
            body = key("\n".join(blocks(root, {}, set())))
            if body in top[5]:
                continue
            top[5].add(body)
            here = {(s.num, key(k[0])) for s in tree.all() for node in s.nodes for k in node.items if isinstance(k, tuple)}
            here |= {(slot, 0) for slot, _ in here} | {(0, 0)}
            facts += [(top[4], top[2], *x, body) for x in here]
            if len(facts) >= FACTS:
                yield told()
    if facts:
        yield told()
    if tops:
        yield trees()


def _merge(t: pa.Table) -> pa.RecordBatch:
    top, count = Slot("#"), 1
    for blob in t.column("blob"):
        count = merge(top, unpacked(blob.as_py()), count)
    return pa.RecordBatch.from_arrays([t.column("host").combine_chunks().slice(0, 1), pa.array([top.packed()], pa.binary())], ["host", "blob"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, slot, to): the merged tree's slot of each slot of a task's tree."""
    for batch in batches:
        for tree, blob, whole in zip(*(batch.column(c) for c in ("tree", "blob", "whole")), strict=True):
            pairs = [(b.num, a.num) for a, b in matched(unpacked(whole.as_py()), unpacked(blob.as_py()))]
            slot, to = (pa.array(c, pa.int64()) for c in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), tree.as_py())), slot, to], ["tree", "slot", "to"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, blob, template, bytes) of pages (host, html): one row for each host with a page."""
    learnt = graph.cut(pages.mapInArrow(_learn, "h long, tree long, slot long, text long, body long, host string, blob binary, bytes long"))
    trees = learnt.where("blob IS NOT NULL").select("h", "host", "tree", "blob", "bytes")
    some = graph.by_table(trees.select("host", F.pmod("tree", F.lit(ROUND)).alias("part"), "blob"), ["host", "part"], _merge, "host string, blob binary")
    whole = graph.cut(graph.by_table(some, ["host"], _merge, "host string, blob binary"))
    places = trees.select("host", "tree", "blob").join(whole.withColumnRenamed("blob", "whole"), "host").select("tree", "blob", "whole").mapInArrow(_places, "tree long, slot long, to long")
    facts = learnt.where("blob IS NULL").select("h", "tree", "slot", "text", "body")
    # Of equal bodies in several trees one counts.
    copies = facts.where("slot = 0 AND text = 0").groupBy("h", "body").agg(F.min("tree").alias("owner"), F.count("*").alias("n")).where("n > 1").select("h", "body", "owner")
    facts = facts.join(copies, ["h", "body"], "left").where("owner IS NULL OR owner = tree").join(places, ["tree", "slot"])
    counts = graph.cut(facts.groupBy("h", "to", "text").agg(F.count("*").alias("n")).where(F.col("n") >= DIFFERENT))
    total = counts.where("text = 0").select("h", "to", F.col("n").alias("total"))
    # Such texts are on half of the pages, so a host has no more than twice what a page holds.
    stays = counts.where("text <> 0").join(total, ["h", "to"]).where(F.col("n") >= STAYS * F.col("total"))
    template = stays.groupBy("h").agg(F.collect_list(F.struct(F.col("to").alias("slot"), "text")).alias("template"))
    sizes = trees.groupBy("h", "host").agg(F.sum("bytes").alias("bytes"))
    return whole.join(sizes, "host").join(template, "h", "left").drop("h")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and part, the host's wrapper before its pages."""
    at, wrapper = None, None
    for batch in batches:
        keep, texts = [], []
        for i, (h, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
            if batch.column("blob")[i].is_valid:
                top, template = unpacked(batch.column("blob")[i].as_py()), batch.column("template")[i].as_py()
                at, wrapper = h, Wrapper(top, {(x["slot"], x["text"]) for x in template or ()})
                continue
            page = html.as_py()
            keep.append(i)
            texts.append((wrapper if at == h else Wrapper(Slot("#"), set())).extract(parse(page)) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(keep, pa.int64())), pa.array(texts, pa.string())], ["row", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages' columns (without html) in a struct `row`, with `text`."""
    rest = [c for c in pages.columns if c != "html"]
    d = pages.select(F.struct(*rest).alias("row"), "html", host(F.col("url")).alias("host"))
    found = graph.cut(wrappers(d.select("host", "html")))
    parts = F.ceil(F.col("bytes") / F.lit(HOT)).cast("int")
    # At most one row for each HOT bytes of the whole table.
    hot = found.where(F.col("bytes") > HOT).select("host", parts.alias("parts"))
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), "parts"), F.lit(0)).cast("int")
    dealt = d.join(F.broadcast(hot), "host", "left").select("host", part.alias("part"), "row", "html", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<struct<slot: long, text: long>>").alias("template"))
    none = F.lit(None)
    first = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    first = first.select("host", "part", none.cast(d.schema["row"].dataType).alias("row"), none.cast("string").alias("html"), "blob", F.col("template").cast("array<struct<slot: long, text: long>>").alias("template"))
    both = dealt.unionByName(first).repartition("host", "part").sortWithinPartitions("host", "part", F.col("blob").isNull())
    return both.drop("part").mapInArrow(_extract, f"row {d.schema['row'].dataType.simpleString()}, text string")


def digest(pages: DataFrame) -> DataFrame:
    x = extract(pages.select("page_id", "url", "html"))
    return x.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
