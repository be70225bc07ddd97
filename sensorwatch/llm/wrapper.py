"""Main text of HTML pages by wrapper induction.

Pages of a host are dealt to runs of bounded size. The page with most nodes is the run's
reference; every page's DOM tree is aligned with it by simple tree matching (runs of like siblings
count as one repeated node). A block of text at a node of the reference is a slot. A slot that
recurs through most of a run's different pages is template, inside an article as well; pages that
share most of their other text are copies of each other and count once, so the paragraphs of a
copied article are no template. A block that is most of its page's text stays, and so does a page
that would lose everything. What is left of the article or main elements is the page's text; a page
without them keeps every block that is not template.

Elements that never hold main text (menus, headers, footers, asides, forms, scripts, styles, and
whatever names itself an advert, notice, sidebar or comment section) are left out first. Comments,
teasers and the like may be marked up as articles: an article element is main text unless it or a box
around it bears such a name, or is named as boilerplate and far shorter than the page's longest. Inside an article a box goes if a whole class name or id is
boilerplate ("newsletter-box"), or if one word of it is and most of its text is links; a heading
box ("entry-header") keeps its headings.

Null html counts as empty and gives an empty text; an empty table gives an empty result, and of the
input's columns only key, url and html are read, so others may have any names. Pages of any length are
used whole. Malformed pages are closed as browsers do: a block ends an open paragraph, unmatched end
tags are ignored. A host of n pages and b bytes has max(n / 64, b / 4 MB) runs, and a seeded hash of the
page names its run: the runs follow from the data alone, whatever the partitioning, and a host of any size is many
runs. Repeated rows are in one run, held and parsed once. A run of one or two different pages has no template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorwatch.llm import common as C

# Element names by role, and names by which boilerplate calls itself.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = set("html body article main section div table ul ol dl nav aside header footer td th blockquote form".split())
NEVER = set("head title script style noscript template iframe object svg canvas nav aside footer form button select textarea dialog menu".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer share sharing social related recommended newsletter subscribe "
    "comment comments disqus replies respond login signup search widget toolbar pagination pager".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
# Of these, names of what holds texts by or about others; and words that say nothing about a box's content.
OTHERS = set("comment comments disqus reply replies respond related recommended teaser teasers sidebar".split())
SURE = set("comment comments disqus advert adverts advertisement advertisements adsense sponsored cookie cookies gdpr sidebar navbar breadcrumb breadcrumbs pagination".split())
PLAIN = set(
    "site page post posts entry article articles story block box section area bar list item items body content text inner outer wrapper wrap container slot unit row col column "
    "link links button buttons icon icons form thread group panel left right top bottom main primary secondary global js id the and in of new all more".split()
)
LAYOUT = {"has", "with", "no", "without"}  # "has-sidebar" tells of a layout and names no sidebar
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUN_PAGES = 64
RUN_BYTES = 4 << 20


def _words(name: str) -> list[str]:
    return [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x]


class Node:
    """``kind``: main, drop, header, named (one word of a name is boilerplate's) or none; ``sure``: a whole name is; ``others``: it names comments, teasers or a sidebar."""

    __slots__ = ("children", "form", "kind", "label", "others", "sure", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.children = tag, []
        named = (attrs.get("class", "") + " " + attrs.get("id", "")).strip()
        self.label = f"{tag}.{named.split()[0]}" if named else tag
        self.kind = ""
        self.sure = self.others = False
        self.form = tag == "form" or attrs.get("role") == "form"
        if tag in ("html", "body"):
            return
        role = attrs.get("role", "")
        classes, own = [ws for x in attrs.get("class", "").split() if (ws := _words(x)) and ws[0] not in LAYOUT], _words(attrs.get("id", ""))
        telling = [told for told in ([x for x in ws if x not in PLAIN] for ws in [*classes, own]) if told]
        whole = [told for told in telling if NAMES.issuperset(told)]
        self.others = any(not OTHERS.isdisjoint(told) for told in whole) or any(ws and ws[0] in OTHERS for ws in classes)
        self.sure = bool(whole) or any(not SURE.isdisjoint(ws) for ws in classes)
        if tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody":
            self.kind = "main"
        elif tag in NEVER or role in ROLES or "hidden" in attrs:
            self.kind = "drop"
        elif tag == "header" or telling and all(told == ["header"] for told in telling):
            self.kind = "header"
        elif not all(NAMES.isdisjoint(ws) for ws in [*classes, own]):
            self.kind = "named"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]

    def _close(self, tags: set[str]) -> None:
        """End the nearest open element of these, unless a scope boundary lies between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close({"p"})
        elif tag in CLOSES:
            self._close(CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag == "svg":
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _lengths(root: Node) -> dict[int, tuple[int, int]]:
    """By element: characters of text below it but white space, scripts and the like, and those of them inside links."""
    out: dict[int, tuple[int, int]] = {}
    stack = [(root, False, False)]
    while stack:
        n, linked, done = stack.pop()
        linked = linked or n.tag == "a"
        if not done:
            stack.append((n, linked, True))
            stack += [(c, linked, False) for c in n.children if not isinstance(c, str) and c.tag not in NEVER]
            continue
        whole = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        links = whole * linked
        for c in n.children:
            if not isinstance(c, str) and c.tag not in NEVER:
                whole, links = whole + out[id(c)][0], links + out[id(c)][1]
        out[id(n)] = whole, links
    return out


def holders(root: Node, lengths: dict[int, tuple[int, int]]) -> set[int]:
    """Elements that are or hold main text: the article or main elements that are half as long as the page's longest
    innermost one or longer, and all around them. Those that bear or stand in a name of comments, teasers or
    sidebars count only on a page without others."""
    above: dict[int, Node] = {}
    mains: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        n, others = stack.pop()
        others = others or n.others and (n.kind == "main" or n.sure and n.tag != "body")
        if n.kind == "main":
            mains.append((n, others))
        for c in n.children:
            if not isinstance(c, str):
                above[id(c)] = n
                stack.append((c, others))
    own = [n for n, others in mains if not others] or [n for n, _ in mains]
    around: set[int] = set()  # main elements with main elements in them
    for n in own:
        up = above.get(id(n))
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = above.get(id(up))
    longest = max((lengths.get(id(n), (0, 0))[0] for n in own if id(n) not in around), default=0)
    held: set[int] = set()
    for n in own:
        up = n if 2 * lengths.get(id(n), (0, 0))[0] >= longest else None
        while up is not None and id(up) not in held:
            held.add(id(up))
            up = above.get(id(up))
    return held


def _length(node: Node) -> int:
    return sum(len(text) for _, text in blocks(node))


def holds_page(form: Node, root: Node, held: set[int]) -> bool:
    """Whether a form wraps the page: the article is in it, or prose and most of the page's text."""
    if id(form) in held:
        return True
    stack = [form]
    while stack:
        n = stack.pop()
        if n.tag == "p" or n.tag in HEADINGS:
            return 2 * _length(form) > sum(_length(c) for c in root.children if not isinstance(c, str) and c.tag != "head")
        stack += [c for c in n.children if not isinstance(c, str) and c.kind != "drop"]
    return False


def headings(box: Node) -> list[Node]:
    """Heading elements anywhere in a box."""
    out, stack = [], [box]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS or n.tag == "hgroup":
            out.append(n)
        else:
            stack += [c for c in reversed(n.children) if not isinstance(c, str) and c.kind != "drop"]
    return out


def prune(root: Node) -> Node:
    """Drop what is never main text. A named box or a form that holds the article itself stays."""
    lengths = _lengths(root)
    held = holders(root, lengths)

    def goes(c: Node, inside: bool) -> bool:
        if id(c) in held:
            return c.kind == "drop" and not c.form
        if c.kind == "drop":
            return not (c.form and holds_page(c, root, held))
        if c.kind == "named" and inside and not c.sure:
            whole, links = lengths.get(id(c), (0, 0))
            return 2 * links > whole
        return c.kind == "named" or c.kind == "main" and c.sure

    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for c in node.children:
            if not isinstance(c, str):
                if goes(c, inside):
                    kept.append(" ")
                    continue
                if c.kind == "header" and id(c) not in held:
                    if not inside:
                        kept.append(" ")
                        continue
                    c.children = headings(c)
                stack.append((c, inside or c.kind == "main"))
            kept.append(c)
        node.children = kept
    return root


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(block element, text) in page order, white space as one space, empty ones left out."""
    out: list[tuple[Node, list[str]]] = [(node, [])]
    stack: list = [(node, iter(node.children))]
    owner = [node]
    while stack:
        top, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if top.tag not in INLINE:
                owner.pop()
                if owner:
                    out.append((owner[-1], []))
            continue
        if isinstance(child, str):
            out[-1][1].append(child)
        elif child.tag == "br":
            out[-1][1].append(" ")
        else:
            if child.tag not in INLINE:
                owner.append(child)
                out.append((child, []))
            stack.append((child, iter(child.children)))
    told = ((n, " ".join("".join(parts).split())) for n, parts in out)
    return [(n, text) for n, text in told if text]


class Shape:
    """A tree of labels in which a run of like siblings is one node; ``nodes`` lists the elements it stands for."""

    __slots__ = ("children", "key", "label", "nodes", "number")

    def __init__(self, nodes: list[Node], depth: int = 0):
        self.label, self.nodes, self.children, self.number = nodes[0].label, nodes, [], -1
        run: list[Node] = []
        if depth < 40:
            for n in nodes:
                for c in n.children:
                    if isinstance(c, str) or c.tag in INLINE or c.tag in VOID:
                        continue
                    if run and run[-1].label != c.label:
                        self._add(run, depth)
                        run = []
                    run.append(c)
            if run:
                self._add(run, depth)
        self.key = self.label + "(" + ",".join(c.key for c in self.children) + ")"

    def _add(self, run: list[Node], depth: int) -> None:
        self.children.append(Shape(run, depth + 1))

    def walk(self) -> Iterator[Shape]:
        yield self
        for c in self.children:
            yield from c.walk()


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees, and its pairs."""
    if a.label != b.label:
        return 0, []
    if a.key == b.key:
        out = list(zip(a.walk(), b.walk(), strict=True))
        return len(out), out
    out, total = [(a, b)], 1
    left, right = a.children, b.children
    low, m, n = 0, len(left), len(right)
    ends = []  # equal children at either end belong together in a largest match
    while low < min(m, n) and left[low].key == right[low].key:
        ends.append((left[low], right[low]))
        low += 1
    while low < min(m, n) and left[m - 1].key == right[n - 1].key:
        m, n = m - 1, n - 1
        ends.append((left[m], right[n]))
    for x, y in ends:
        score, pairs = match(x, y)
        total += score
        out += pairs
    left, right = left[low:m], right[low:n]
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    found: dict[tuple[int, int], list] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            score = 0
            if left[i - 1].label == right[j - 1].label:
                score, found[i, j] = match(left[i - 1], right[j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score)
    i, j = m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out += found[i, j]
            i, j = i - 1, j - 1
    return best[m][n] + total, out


def body(root: Node) -> list[tuple[Node, str]]:
    """Blocks of the article or main elements, or of the whole page if these have no text."""
    mains = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.kind == "main":
            mains.append(n)
        else:
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return [b for n in mains for b in blocks(n)] or blocks(root)


def _link_text(n: Node) -> int:
    """Characters inside links directly below a block."""
    return sum(len(text) for c in n.children if not isinstance(c, str) and c.tag == "a" for _, text in blocks(c))


def _groups(alike: np.ndarray) -> np.ndarray:
    """Group number of every page: those that are alike, directly or over others."""
    group = np.full(len(alike), -1)
    for number, start in enumerate(range(len(alike))):
        if group[start] < 0:
            new = np.arange(len(alike)) == start
            while new.any():
                group[new] = number
                new = alike[new].any(axis=0) & (group < 0)
    return group


def templates(roots: list[Node], own: list[list[tuple[Node, str]]]) -> list[set[int]]:
    """Of every page of a run, the places in its list of blocks that are template."""
    fixed: list[set[int]] = [set() for _ in roots]
    full = [i for i, page in enumerate(own) if page]
    if len(full) < 3:  # a template shows itself in three pages or more
        return fixed
    shapes = {i: Shape([roots[i]]) for i in full}
    reference = max(shapes.values(), key=lambda s: (s.key.count("("), s.key))
    for number, s in enumerate(reference.walk()):
        s.number = number
    slots: dict[tuple[int, str], dict[int, list[int]]] = {}  # pages of a slot and the places of its blocks there
    weights: dict[str, int] = {}  # characters outside links, by text
    texts: list[set[str]] = []
    for i in full:
        place = {id(n): a.number for a, b in match(reference, shapes[i])[1] for n in b.nodes}
        for k, (n, text) in enumerate(own[i]):
            weights[text] = max(weights.get(text, 0), len(text) - _link_text(n))
            if id(n) in place:
                slots.setdefault((place[id(n)], text), {}).setdefault(i, []).append(k)
        texts.append({text for _, text in own[i]})
    column = {x: c for c, x in enumerate(x for x, n in Counter(x for page in texts for x in page).items() if n > 1)}
    has = np.zeros((len(full), len(column)), bool)
    for row, page in enumerate(texts):
        has[row, [column[x] for x in page if x in column]] = True
    weight = np.array([weights[x] for x in column], np.int64)
    total = np.array([sum(weights[x] for x in page) for page in texts])
    common = (has * weight) @ has.T.astype(np.int64)
    for (_, text), pages in slots.items():
        if len(pages) < 3:
            continue
        holds, w = has[:, column[text]], weights[text]
        rest = total - w * holds
        alike = 2 * (common - w * np.outer(holds, holds)) >= np.maximum.outer(rest, rest)
        group = _groups(alike)
        held = [row for row, i in enumerate(full) if i in pages]
        if len(set(group[held])) >= max(3, 0.6 * len(set(group))):
            for row in held:
                if 2 * w <= total[row]:
                    fixed[full[row]].update(pages[full[row]])
    return [set() if len(f) == len(page) else f for f, page in zip(fixed, own, strict=True)]


def extract(pages: list[str]) -> list[str]:
    """Main texts of a run of pages of one host."""
    roots = [prune(parse(x)) for x in pages]
    own = [body(r) for r in roots]
    return [" ".join(text for k, (_, text) in enumerate(page) if k not in f) for page, f in zip(own, templates(roots, own), strict=True)]


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), text.alias("html"), host.alias("host"), F.xxhash64(F.lit("run"), key, url, text).alias("h"))
    sizes = rows.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html").cast("long")).alias("b"))
    sizes = sizes.select("of", F.greatest(F.ceil(F.col("n") / RUN_PAGES), F.ceil(F.col("b") / RUN_BYTES), F.lit(1)).cast("long").alias("runs")).where("runs > 1")
    # a small table for most inputs, which Spark broadcasts by the size of its files; past that a join that splits hot hosts
    rows = rows.join(C.written(sizes, "hosts"), F.col("host") == F.col("of"), "left")
    rows = rows.select("page_id", "url", "html", "host", F.pmod("h", F.coalesce("runs", F.lit(1))).alias("run"), "h")
    rows = rows.repartition("host", "run").sortWithinPartitions("host", "run", "h", "html", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # page_id, url, place of its html
        different: list[str] = []
        at, kind = None, None

        def told() -> Iterator[pa.RecordBatch]:
            texts = extract(different)
            for low in range(0, len(held), 512):
                part = held[low : low + 512]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array([r[1] for r in part], pa.string()), pa.array([texts[r[2]] for r in part], pa.string())], names=["page_id", "url", "text"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for page_id, address, content, *own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != at:
                    yield from told()
                    held, different, at = [], [], own
                if not different or different[-1] != content:  # sorted: equal rows follow each other
                    different.append(content)
                held.append((page_id, address, len(different) - 1))
        yield from told()

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
