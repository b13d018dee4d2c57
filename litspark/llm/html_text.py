"""Main text of HTML pages by wrapper induction.

All different pages of a host are parsed, and their DOM trees are aligned by simple tree matching with that of one of
them, its base: the shortest page of the host's commonest layout. Nodes of the base that more than half of the pages
have, with the same text in each page that has them, are template. Each page without articles then proposes the slots
that vary in it; the wrapper of a host is its template and the slots that one in ``VOTES`` of the pages with such a node
proposes, so that a container isn't lost where many pages have most of their text in one of its paragraphs. Both are counts over all pages of the host. The wrapper is then applied to all pages. All of this is dealt by
page, and only counts are grouped by host, so a host with a third of all pages is no larger task than others.

Every article, main and div of class article that isn't a marked part is content, whatever the wrapper says, and nothing
inside of one is dropped for being constant, since copies of an article are content; only parts with the tag or class of
an advert, notice, menu, header, footer, sidebar, form or readers' comments are. A slot that holds an article gives
way to it. On a page without articles whose slots hold less than ``SHARE`` of its varying text, as when few pages have
its layout, the innermost container with that share is added. Pages on which neither is found use the body, and so do
hosts with a single page, which have no wrapper.

Defined cases: null or empty html gives an empty text and counts for no wrapper; null urls and urls without a host share
a wrapper of one "host"; broken markup is closed as browsers do; nesting may have any depth, since trees are walked
without recursion; repeated rows are pages of their own, but count once in a wrapper; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import saved

#: share of the varying text that a container must hold to be taken for all of it
SHARE = 0.8
#: a slot is proposed by one in so many of its host's pages that have it at least
VOTES = 6
#: a slot is on one in so many of its host's pages without articles at least; pages with rarer ones find their own
RARE = 100
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = set("head title script style noscript template nav footer aside form button select textarea iframe svg canvas object menu dialog".split())
#: words of class, id and role attributes that mark parts which aren't the article
PARTS = set("ad ads advert advertisement advertising banner sponsor sponsored promo cookie cookies consent notice popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead share social related comment comments disqus newsletter subscribe form login".split())
#: classes that mark parts inside of an article: adverts, notices, menus, headers, footers, sidebars and readers' comments only
INNER_PARTS = set("ad ads advert advertisement advertising banner sponsor sponsored promo cookie cookies consent notice menu nav navbar navigation sidebar footer header comment comments disqus".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: an opening tag closes an open one of these, up to the tags at which the search ends
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BARRIERS = set("article main section div body td th li table nav footer aside header form blockquote".split())


@lru_cache(1 << 14)
def marks(tag: str, names: tuple[str, ...]) -> tuple[str, bool, bool, bool]:
    """The label of an element by its class, id and role; whether these mark a part, and one inside of articles; whether it is an article."""
    words = [w for x in names for w in re.split(r"[^a-z0-9]+", x.lower()) if w]
    classes = set(names[0].lower().split())
    article = tag in ("article", "main") or (tag == "div" and "article" in classes)
    return ".".join([tag, *sorted(classes)]), any(w in PARTS for w in words), any(c in INNER_PARTS for c in classes), article


@lru_cache(1 << 16)
def path_of(above: str, label: str) -> str:
    """A hash of all labels from the root, since those of deep nodes are long."""
    return blake2b(f"{above}/{label}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Node:
    __slots__ = ("tag", "label", "kids", "boxes", "parent", "part", "path", "article", "kept", "holds", "start", "end", "shape", "size")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.parent, self.kids, self.boxes = tag, parent, [], []
        self.label, outer, inner, article = marks(tag, (attrs.get("class") or "", attrs.get("id") or "", attrs.get("role") or ""))
        kept = parent is not None and parent.kept
        named = inner if kept else outer
        outside = tag == "header" and not kept
        self.part = tag in SKIPPED or outside or (tag not in ("html", "body", "article", "main") and named) or "hidden" in attrs
        self.path = path_of(parent.path if parent else "", self.label)
        self.article = not self.part and article
        self.kept = self.article or kept
        self.holds, self.start, self.end, self.shape, self.size = False, 0, 0, -1, 1


class Builder(HTMLParser):
    """A tree of nodes and texts; end tags that are left out are added as browsers do.

    ``at`` has the places of each tag in the stack of open elements, so that closing needs no search through the stack.
    Parts have no boxes: what is in them plays no role.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", {}, None)
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, tags: set[str]) -> int:
        most = 0
        for t in tags:
            if (places := self.at.get(t)) and places[-1] > most:
                most = places[-1]
        return most

    def close_to(self, tags: set[str], barriers: set[str]) -> None:
        i = self.last(tags)
        if i and i >= self.last(barriers):
            for node in self.open[i:]:
                self.at[node.tag].pop()
            del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self.close_to({"p"}, BARRIERS)
        if tag in SIBLINGS:
            self.close_to(*SIBLINGS[tag])
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].kids.append(node)
        if not self.open[-1].part:
            self.open[-1].boxes.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.close_to({tag}, BARRIERS - {tag} if tag in INLINE or tag == "p" else set())

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_of(node: Node, drop=lambda n: False) -> str:
    """Text without the parts that are dropped; a block ends words, inline tags don't."""
    out: list[str] = []
    todo = node.kids[::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.part and not drop(k):
            edge = "" if k.tag in INLINE else " "
            out.append(edge)
            todo.append(edge)
            todo += k.kids[::-1]
    return " ".join("".join(out).split())


class Page:
    """A tree and its text, of which each node has a span: text(n) is text_of(n) without a walk."""

    def __init__(self, html: str):
        self.root = parse(html)
        out: list[str] = []
        size, space = 0, False
        todo: list = [self.root]
        while todo:
            k = todo.pop()
            if isinstance(k, tuple):
                k[0].end = size
                space = space or k[0].tag not in INLINE
            elif isinstance(k, Node):
                space = space or k.tag not in INLINE
                k.start = size
                todo.append((k,))
                todo += [x for x in reversed(k.kids) if isinstance(x, str) or not x.part]
            elif k:
                words = k.split()
                if words:
                    found = (" " if space or k[0].isspace() else "") + " ".join(words)
                    out.append(found)
                    size += len(found)
                space = k[-1].isspace() or (space and not words)
        self.whole = "".join(out)
        self.nodes = list(every(self.root))
        for n in self.nodes:
            if n.article:
                up = n.parent
                while up is not None and not up.holds:
                    up.holds, up = True, up.parent

    def text(self, node: Node) -> str:
        return self.whole[node.start : node.end].strip()

    def pair(self, node: Node) -> str:
        """A hash of path and text, so that what is kept of a constant node has a bound."""
        return blake2b(f"{node.path} {self.text(node)}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def body(self) -> Node | None:
        return next((n for n in self.nodes if n.tag == "body"), None)


def shapes(root: Node, known: dict) -> None:
    """Numbers each node by its label and the shapes below it; trees of one shape are equal but for their texts."""
    todo = [(root, False)]
    while todo:
        n, ready = todo.pop()
        if ready:
            n.shape = known.setdefault((n.label, *[k.shape for k in n.boxes]), len(known))
            n.size = 1 + sum(k.size for k in n.boxes)
        else:
            todo.append((n, True))
            todo += [(k, False) for k in n.boxes]


def score(a: Node, b: Node, memo: dict) -> int | None:
    """The most nodes that two trees share in order and level; None if that isn't in memo yet."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    return memo.get((a.shape, b.shape)) if a.boxes and b.boxes else 1


def trimmed(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many trees at the beginnings and at the ends of two lists have one shape: a best alignment matches them."""
    n = end = 0
    most = min(len(x), len(y))
    while n < most and x[n].shape == y[n].shape:
        n += 1
    while end < most - n and x[-1 - end].shape == y[-1 - end].shape:
        end += 1
    return n, end


def matching(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching, inner pairs first; pairs of one shape are matched once."""
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if score(p, q, memo) is None:
            n, end = trimmed(p.boxes, q.boxes)
            x, y = p.boxes[n : len(p.boxes) - end], q.boxes[n : len(q.boxes) - end]
            rows, columns = {s.shape: s for s in x}, {t.shape: t for t in y}
            if inner := [(s, t) for s in rows.values() for t in columns.values() if score(s, t, memo) is None]:
                todo += inner
                continue
            same = sum(s.size for s in [*p.boxes[:n], *p.boxes[len(p.boxes) - end :]])
            memo[p.shape, q.shape] = 1 + same + int(best_rows(x, y, memo)[0][-1])
        todo.pop()
    return score(a, b, memo)


def best_rows(x: list[Node], y: list[Node], memo: dict, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The last row of the alignment of two lists, a row at a time; steps gets whether a tree of x is matched (2) or left out (1)."""
    last = np.zeros(len(y) + 1, np.int64)
    by_shape: dict[int, np.ndarray] = {}
    for i, p in enumerate(x):
        if p.shape not in by_shape:
            by_shape[p.shape] = np.array([score(p, q, memo) for q in y], np.int64)
        w = by_shape[p.shape]
        hit = np.where(w > 0, last[:-1] + w, -1)
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(last[1:], hit))])
        if steps is not None:
            steps[i] = np.where(hit == row[1:], 2, np.where(last[1:] == row[1:], 1, 0))
        last = row
    return last, steps


def align(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of nodes that simple tree matching puts together; inside of articles, where nothing is dropped, none are sought."""
    pairs, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        if a.kept:
            continue
        n, end = trimmed(a.boxes, b.boxes)
        todo += zip(a.boxes[:n], b.boxes[:n], strict=True)
        todo += zip(a.boxes[len(a.boxes) - end :], b.boxes[len(b.boxes) - end :], strict=True)
        x, y = a.boxes[n : len(a.boxes) - end], b.boxes[n : len(b.boxes) - end]
        if not x or not y:
            continue
        if len(x) == len(y) == 1:
            todo += [(x[0], y[0])] if x[0].label == y[0].label else []
            continue
        rows, columns = {s.shape: s for s in x}, {t.shape: t for t in y}
        for s in rows.values():
            for t in columns.values():
                matching(s, t, memo)
        steps = best_rows(x, y, memo, np.zeros((len(x), len(y)), np.uint8))[1]
        i, j = len(x), len(y)
        while i and j:
            step = steps[i - 1, j - 1]
            if step == 2:
                todo.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif step == 1:
                i -= 1
            else:
                j -= 1
    return pairs


def every(node: Node) -> Iterator[Node]:
    """All nodes below, without parts and what is in them."""
    todo = node.boxes[::-1]
    while todo:
        if not (k := todo.pop()).part:
            yield k
            todo += k.boxes[::-1]


def innermost(page: Page, constant) -> Node | None:
    """The innermost container below the body that holds most of its varying text."""
    if slot := page.body():
        size = len(text_of(slot, constant))
        while inner := [k for k in slot.boxes if not k.part and not constant(k) and k.tag not in INLINE and k.boxes and len(text_of(k, constant)) >= SHARE * size]:
            slot = inner[0]
    return slot


class Template:
    """The base of a host, and for each of its nodes with text and not in articles the pages that have it (seen), and that with its text (same)."""

    def __init__(self, base: Page):
        self.base, self.known = base, {}
        shapes(base.root, self.known)
        self.told = [n for n in base.nodes if base.text(n) and not (n.kept and n.parent.kept)]
        self.at = {id(n): i for i, n in enumerate(self.told)}
        self.seen, self.same = [0] * len(self.told), [0] * len(self.told)

    def count(self, page: Page) -> None:
        shapes(page.root, dict(self.known))
        for a, b in align(self.base.root, page.root, {}):
            if (i := self.at.get(id(a))) is not None:
                self.seen[i] += 1
                self.same[i] += self.base.text(a) == page.text(b)

    def pairs(self) -> list[str | None]:
        """What is known of a constant node on other pages; None in articles, where nothing is dropped."""
        return [None if n.kept else self.base.pair(n) for n in self.told]


def plain(page: Page) -> bool:
    """Whether slots can be found on a page: it has no article with text, or classes that only begin like one."""
    return not any(n.article and page.text(n) for n in page.nodes) or any(n.label.startswith("div.article") and not n.kept and page.text(n) for n in page.nodes)


def proposed(page: Page, fixed: set[str]) -> set[str]:
    """Paths of the slots that a page would have: varying containers of articles, or else the innermost of most of its varying text."""
    varies = lambda n: page.pair(n) not in fixed
    found = [n for n in page.nodes if n.label.startswith("div.article") and not n.kept and page.text(n) and varies(n)]
    if not found and not any(n.article and page.text(n) for n in page.nodes):
        found = [n for n in [innermost(page, lambda n: not varies(n))] if n]
    return {n.path for n in found}


def places(page: Page) -> set[str]:
    """Paths at which a page could have a slot."""
    return {n.path for n in page.nodes if not n.holds and not n.kept}


def constant(seen, same, pages):
    return (seen == same) & (seen * 2 > pages)


def elected(chosen, seen, pages):
    """Whether a path is a slot, by the pages that propose it, those that have it and those that could have slots."""
    return (chosen * VOTES >= seen) & (seen > 1) & (seen * RARE >= pages)


def induce(pages: list[str]) -> tuple[list[str], list[str]]:
    """Paths of content slots and "path text" of constant nodes, from pages of one host, the first of which is the base.

    This is what ``wrappers`` finds on Spark, for pages in memory.
    """
    trees = [Page(p) for p in pages]
    if len(trees) < 2:
        return [], []
    template = Template(trees[0])
    for tree in trees:
        template.count(tree)
    same = [constant(*x, len(trees)) for x in zip(template.seen, template.same, strict=True)]
    fixed = set() if all(same) else {p for p, c in zip(template.pairs(), same, strict=True) if c and p}
    voters = [t for t in trees if plain(t)]
    chosen = Counter(p for t in voters for p in proposed(t, fixed))
    seen = Counter(p for t in voters for p in places(t))
    return sorted(p for p, n in chosen.items() if elected(n, seen[p], len(voters))), sorted(fixed)


def extract(html: str, slots: set[str] | None, fixed: set[str]) -> str:
    """The text by a wrapper; slots is None where the host has none."""
    page = Page(html)
    drop = (lambda n: not n.kept and page.pair(n) in fixed) if fixed else (lambda n: False)
    found = {id(n): n for n in page.nodes if n.article or (slots and n.path in slots and not n.holds)}
    if slots is not None and not any(n.article and page.text(n) for n in found.values()) and (body := page.body()):
        if sum(len(text_of(n, drop)) for n in outer(page, found)) < SHARE * len(text_of(body, drop)):
            slot = innermost(page, drop)
            found[id(slot)] = slot
    if not found:
        found = {id(n): n for n in page.nodes if n.tag == "body"} or {id(page.root): page.root}
    return " ".join(x for n in outer(page, found) if (x := text_of(n, drop)))


def outer(page: Page, found: dict[int, Node]) -> list[Node]:
    """The nodes found that aren't in another one, in order."""
    out, todo = [], [page.root]
    while todo:
        n = todo.pop()
        if id(n) in found:
            out.append(n)
        else:
            todo += [k for k in reversed(n.boxes) if not k.part]
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def small_side(table: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A written table, broadcast if what it holds has at most ``most`` bytes; a larger one is joined by shuffle."""
    held = F.lit(64)
    for c in table.columns:
        held = held + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
    return F.broadcast(table) if (table.agg(F.sum(held.cast("long"))).first()[0] or 0) <= most else table


def layout_of(html: Column) -> Column:
    """A hash of the set of a page's tags and classes; classes with digits are left out, as they often number pages."""
    found = F.regexp_extract_all(html, F.lit(r"(<[a-zA-Z][^\s/>]*|\sclass\s*=\s*[\"'][^\"'0-9]*[\"'])"), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(found)))


def by_host(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int]]]:
    """The places of each host's rows in a batch."""
    hosts = batch.column("host").to_pylist()
    for host, rows in groupby(sorted(range(len(hosts)), key=hosts.__getitem__), key=hosts.__getitem__):
        yield host, list(rows)


COMPARED = "host string, key long, node int, pair string, seen long, same long"
VOTED = "host string, path string, chosen long, seen long"


def table(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in kinds.split(", "))])
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the base's nodes, for each host of a batch; the keys of pages on which slots can be found."""
    for batch in batches:
        rows: list[tuple] = []
        for host, at in by_host(batch):
            template = Template(Page(batch.column("base")[at[0]].as_py()))
            for i in at:
                page = Page(batch.column("html")[i].as_py())
                template.count(page)
                if plain(page):
                    rows.append((host, batch.column("key")[i].as_py(), None, None, None, None))
            rows += [(host, None, i, *x) for i, x in enumerate(zip(template.pairs(), template.seen, template.same, strict=True))]
        yield table(rows, COMPARED)


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages of each host of a batch have a path at which slots can be, and propose it; as path null, how many pages there are."""
    for batch in batches:
        rows: list[tuple] = []
        for host, at in by_host(batch):
            fixed = set(batch.column("fixed")[at[0]].as_py())
            chosen, seen = Counter(), Counter()
            for i in at:
                page = Page(batch.column("html")[i].as_py())
                chosen.update(proposed(page, fixed))
                seen.update(places(page))
            rows += [(host, p, chosen[p], n) for p, n in seen.items()]
            rows.append((host, None, 0, len(at)))
        yield table(rows, VOTED)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed) of each host with two different pages or more, from all of its pages."""
    told = pages.filter(F.col("html") != "").select("host", "key", "html")
    facts = told.select("host", "key", layout_of(F.col("html")).alias("layout"), F.length("html").alias("length"))
    keys = saved(facts.groupBy("host", "key").agg(F.min("layout").alias("layout"), F.min("length").alias("length"), F.count("*").alias("rows")), "keys")
    layouts = keys.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(F.struct("length", "key")).alias("least"))
    hosts = layouts.groupBy("host").agg(F.min_by("least.key", F.struct(-F.col("n"), "layout")).alias("key"), F.sum("n").alias("pages"))
    hosts = small_side(saved(hosts.filter("pages > 1"), "hosts"))
    bases = told.join(hosts, ["host", "key"]).dropDuplicates(["host", "key"]).select("host", F.col("html").alias("base"))
    copied = small_side(saved(keys.filter("rows > 1").select("host", "key"), "copied"))
    once = told.join(copied, ["host", "key"], "left_anti").union(told.join(copied, ["host", "key"], "left_semi").dropDuplicates(["host", "key"]))

    compared = saved(once.join(small_side(saved(bases, "bases")), "host").select("host", "key", "html", "base").mapInArrow(compare, COMPARED), "compared")
    nodes = compared.filter("node is not null").groupBy("host", "node").agg(F.max("pair").alias("pair"), F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    nodes = nodes.join(hosts.select("host", "pages"), "host").withColumn("constant", constant(F.col("seen"), F.col("same"), F.col("pages")))
    fixed = nodes.groupBy("host").agg(F.bool_and("constant").alias("all"), F.collect_set(F.when(F.col("constant"), F.col("pair"))).alias("fixed"))
    fixed = hosts.select("host").join(fixed, "host", "left")
    fixed = saved(fixed.select("host", F.when(F.col("all"), F.array().cast("array<string>")).otherwise(F.coalesce("fixed", F.array().cast("array<string>"))).alias("fixed")), "fixed")

    voters = small_side(saved(compared.filter("key is not null").select("host", "key"), "voters"))
    votes = once.join(voters, ["host", "key"], "left_semi").join(small_side(fixed), "host").select("host", "html", "fixed").mapInArrow(vote, VOTED)
    votes = saved(votes.groupBy("host", "path").agg(F.sum("chosen").alias("chosen"), F.sum("seen").alias("seen")), "votes")
    voting = votes.filter("path is null").select("host", F.col("seen").alias("pages"))
    slots = votes.filter("path is not null and chosen > 0").join(voting, "host").filter(elected(F.col("chosen"), F.col("seen"), F.col("pages")))
    slots = slots.groupBy("host").agg(F.collect_set("path").alias("slots"))
    return fixed.join(slots, "host", "left").select("host", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), "fixed")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("key"))
    met = rows.join(small_side(saved(wrappers(rows), "wrappers")), "host", "left").select("page_id", "url", "html", "slots", "fixed")
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "fixed")), strict=True)
            texts = pa.array([extract(h, None if s is None else set(s), set(f or ())) if h else "" for h, s, f in args], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    out = met.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
