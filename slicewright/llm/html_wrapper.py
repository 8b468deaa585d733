"""Main text of web pages by wrapper inference.

Each page's token stream becomes a tree of elements; runs of siblings of one shape fold into repeated groups and
text becomes slots, so a page is already a union-free regular expression. All distinct expressions of a host, counted over all of its
pages, are then aligned one after the other: what only one side has becomes optional, repeats become groups, and a text that is not
the same everywhere becomes a slot. From the host's wrapper comes where the article is and which of its texts, by their places, are
fixed template: those that stay while the rest of the article differs between ``FIXED_FROM`` pages, so copies of a page or an article count once; pages that do not follow the wrapper are read by the same rules from their own tree.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.session import materialize

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|title|select|object|canvas"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div body main".split())
AWAY = frozenset("nav footer aside form button menu dialog head input select".split())
#: Names, in classes, ids and roles, of what is not the article.
AWAY_NAMES = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|header|footer|sidebar|aside|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|popup|modal|"
    r"newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|disqus|widgets?|toolbar|pagination|pager|complementary|contentinfo|search)(?![a-z])"
)
SKIPPED = frozenset(("br", "wbr", "img"))
#: In a label, that the element's whole values have such a name.
AWAY_SIGN = " !"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Pages on which the rest of the article differs, from which on a text that never changes is template.
FIXED_FROM = 5


class Node:
    """An element: its label, its children (elements and texts), and what alignment has learnt."""

    __slots__ = ("label", "kids", "often", "chars", "fixed", "seen")

    def __init__(self, label: str):
        #: ``seen``: digests of what elements hold on different pages, the ``FIXED_FROM`` least ones.
        self.label, self.kids, self.often, self.chars, self.fixed, self.seen = label, [], "1", 0, None, []


def parse(page: str | None) -> Node:
    """The tree of one page; scripts, styles and comments are left out and what is not closed is mended."""
    root = Node("#root")
    stack, names = [root], ["#root"]
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are

    def close(at: int) -> None:
        for name in names[at:]:
            opened[name].pop()
        del stack[at:], names[at:]

    def last(kinds: frozenset[str] | set[str]) -> int:
        return max([opened[x][-1] for x in kinds if opened.get(x)], default=0)

    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            stack[-1].kids.append(text)
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag not in INLINE and tag in BLOCKS and opened.get("p") and last(FENCES) < opened["p"][-1]:
            close(opened["p"][-1])
        if tag in CLOSES:
            fence = last(FENCES - CLOSES[tag])
            after = [places[k] for x in CLOSES[tag] if (places := opened.get(x)) and (k := bisect_right(places, fence)) < len(places)]
            if after:
                close(min(after))
        found = sorted((k.lower(), re.sub(r"\d+", "", a or b or c).lower().strip()) for k, a, b, c in _NAMES.findall(m["attrs"])) if m["attrs"] else ()
        # the label's values are shortened for alignment, its verdict is of the whole ones
        sign = AWAY_SIGN if found and AWAY_NAMES.search("".join(f" {k}={v}" for k, v in found)) else ""
        node = Node(tag + sign + "".join(f" {k}={v[:60]}" for k, v in found))
        stack[-1].kids.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            opened[tag].append(len(stack))
            stack.append(node)
            names.append(tag)
    return root


BLOCKS = frozenset("p div article section main header footer nav aside ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre form hr figure address fieldset details".split())


def away(label: str, inside: bool) -> bool:
    """Whether an element is none of the article's; a header inside the article is its own."""
    tag, _, rest = label.partition(" ")
    return tag in AWAY or tag == "header" and not inside or rest.startswith(AWAY_SIGN.strip())


# ---- inference ----
# The functions below call themselves once for each level of a tree. Such calls take no room on the machine's stack, so the depth of a page needs no limit;
# what does take room there (generators in sum() or max(), nested JSON) is not between a call and the next.


def unlimited() -> None:
    """Lift the interpreter's own limit on nested calls."""
    sys.setrecursionlimit(1 << 30)


def generalise(node: Node) -> Node:
    """A page's tree as an expression: text to slots, runs of siblings of one label to repeated groups."""
    out = Node(node.label)
    for kid in node.kids:
        if isinstance(kid, str):
            text = _SPACE.sub(" ", kid).strip()
            if not text:
                continue
            new = Node("#text")
            new.chars, new.fixed = len(text), checksum(text)
            new.seen = [new.fixed]
        elif kid.label.partition(" ")[0] in SKIPPED:
            continue
        else:
            new = generalise(kid)
        last = out.kids[-1] if out.kids else None
        if last is not None and last.label == new.label:
            out.kids[-1] = merge(last, new)
            out.kids[-1].often = "+"
            out.kids[-1].seen = [hash((last.seen[0], new.seen[0]))]  # one page has one content
        else:
            out.kids.append(new)
    out.chars = sum([k.chars for k in out.kids])
    out.seen = [hash(tuple([k.seen[0] for k in out.kids if not away(k.label, True)]))]  # of whole numbers, so alike in all processes
    return out


def merge(a: Node, b: Node) -> Node:
    """The least expression here that covers both: aligned children merge, others become optional."""
    out = Node(a.label)
    out.often = a.often if a.often == b.often else "*" if {"*", "?"} & {a.often, b.often} else "+"
    out.chars = a.chars + b.chars
    if a.label == "#text":
        out.fixed = a.fixed if a.fixed == b.fixed else None
        return out
    out.seen = a.seen if a.seen == b.seen else sorted({*a.seen, *b.seen})[:FIXED_FROM]
    x, y = a.kids, b.kids
    if [k.label for k in x] == [k.label for k in y]:
        out.kids = [merge(p, q) for p, q in zip(x, y, strict=True)]
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].label == y[j].label:
            new = merge(x[i], y[j])
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            new, i = _optional(x[i]), i + 1
        else:
            new, j = _optional(y[j]), j + 1
        if out.kids and out.kids[-1].label == new.label:
            new = merge(out.kids[-1], new)
            new.often = "*"
            out.kids[-1] = new
        else:
            out.kids.append(new)
    return out


def _optional(node: Node) -> Node:
    node.often = {"1": "?", "+": "*"}.get(node.often, node.often)
    return node


def checksum(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def at_place(place: tuple, fixed: int) -> int:
    """The checksum of a text together with the labels above it, and which run of that label each is among its siblings."""
    return checksum(json.dumps([*place, fixed]))


def dump(node: Node) -> list:
    """The nodes in the order of the page, each with the number of its children."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append([n.label, n.often, n.chars, n.fixed, n.seen, len(n.kids)])
        stack.extend(reversed(n.kids))
    return out


def load(rows: list) -> Node:
    top = Node("")
    open_: list[list] = [[top, 1]]
    for label, often, chars, fixed, seen, kids in rows:
        while not open_[-1][1]:
            open_.pop()
        node = Node(label)
        node.often, node.chars, node.fixed, node.seen = often, chars, fixed, seen
        open_[-1][0].kids.append(node)
        open_[-1][1] -= 1
        open_.append([node, kids])
    return top.kids[0]


def expression(node: Node) -> str:
    """The wrapper as text: elements, ``#PCDATA`` slots, and groups with ?, + or *."""
    if node.label == "#text":
        return "#PCDATA" if node.fixed is None else f"'{node.fixed & (1 << 64) - 1:016x}'"
    inner = f"<{node.label}>" + " ".join([expression(k) for k in node.kids]) + f"</{node.label.partition(' ')[0]}>"
    return inner if node.often == "1" else f"({inner}){node.often}"


def article_path(root: Node) -> list[str]:
    """Labels from the root to the article: an article or main element, else down to where most of the text is."""
    found: list[tuple[int, int, list[str]]] = []
    sizes: dict[int, int] = {}
    size(root, sizes)
    path: list[str] = []

    def look(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str) or kid.label == "#text" or away(kid.label, False):
                continue
            tag, _, rest = kid.label.partition(" ")
            path.append(kid.label)
            if tag in ("article", "main") or "role=main" in rest or "role=article" in rest:
                found.append((tag == "article" and kid.often in ("1", "?"), sizes.get(id(kid), 0), list(path)))
            look(kid)
            path.pop()

    look(root)
    largest = max([f[1] for f in found], default=0)
    if largest and (best := max(found, key=lambda f: (f[1] * 2 >= largest, f[0], f[1])))[1]:
        return best[2]
    node = root
    while True:
        kids = [k for k in node.kids if not isinstance(k, str) and k.label != "#text" and not away(k.label, False)]
        top = max(kids, key=lambda k: sizes.get(id(k), 0), default=None)
        if top is None or top.label.partition(" ")[0] in ("p", *INLINE) or sizes.get(id(top), 0) < 0.7 * sizes[id(node)] or top.often in ("+", "*"):
            return path
        path.append(top.label)
        node = top


def size(node: Node | str, sizes: dict[int, int] | None = None) -> int:
    """Characters of text that are not in elements of other kinds; ``sizes`` gets those of all nodes on the way."""
    if isinstance(node, str):
        return len(node.strip())
    if node.label == "#text":
        return node.chars
    n = sum([size(k, sizes) for k in node.kids if isinstance(k, str) or not away(k.label, True)])
    if sizes is not None:
        sizes[id(node)] = n
    return n


def template_texts(root: Node, path: list[str]) -> list[int]:
    """Checksums, with their places in the article, of the texts that are the same on all of the host's pages.

    Where the article is in a group, or occurs in several places, there are none. If they are half of the article's text or more, the pages are versions of one article.
    """
    nodes = [root]
    for k, label in enumerate(path):
        nodes = [k for n in nodes for k in n.kids if k.label == label]
        if len(nodes) != 1 or k < len(path) - 1 and nodes[0].often not in ("1", "?"):
            return []
    article = nodes[0]
    if len(article.seen) < FIXED_FROM or article.often == "*":
        return []
    fixed: list[int] = []
    chars = 0

    def look(node: Node, place: tuple) -> None:
        nonlocal chars
        ranks: dict[str, int] = {}
        for kid in node.kids:
            rank = ranks.setdefault(kid.label, 0)
            if rank < 0 or kid.often != "1":
                ranks[kid.label] = -1  # those of this label that follow have no sure rank
                continue
            ranks[kid.label] = rank + 1
            at = (*place, kid.label, rank)
            if kid.label != "#text":
                look(kid, at)
            elif kid.fixed is not None:
                fixed.append(at_place(at, kid.fixed))
                chars += kid.chars if not any(away(x, True) for x in at[:-2:2]) else 0

    look(article, ())
    return fixed if 2 * chars < size(article) else []


# ---- reading ----


def extract(page: str | None, path: list[str], fixed: frozenset[int] = frozenset()) -> str:
    """The article's text: a line for each block, white space inside a block made one space."""
    unlimited()
    root = parse(page)
    nodes = [root]
    for label in path:
        nodes = [k for n in nodes for k in n.kids if not isinstance(k, str) and k.label == label]
    if not path or not nodes:
        nodes = [root]
        fixed = frozenset()
        for label in article_path(root):
            nodes = [k for n in nodes for k in n.kids if not isinstance(k, str) and k.label == label]
    inside = nodes != [root]
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    def read(node: Node, place: tuple = ()) -> None:
        ranks: dict[str, int] = {}
        last = None
        for kid in node.kids:
            at = place
            if fixed:  # siblings count as in an expression: in runs, without blank texts and breaks
                label, text = ("#text", _SPACE.sub(" ", kid).strip()) if isinstance(kid, str) else (kid.label, "")
                if (text if label == "#text" else label.partition(" ")[0] not in SKIPPED) and label != last:
                    ranks[label] = ranks.get(label, -1) + 1
                    last = label
                at = (*place, label, ranks.get(label, -1))
            if isinstance(kid, str):
                if not fixed or not text or at_place(at, checksum(text)) not in fixed:
                    run.append(kid)
            elif not away(kid.label, inside):
                tag = kid.label.partition(" ")[0]
                if tag == "br":
                    run.append(" ")
                elif tag in INLINE:
                    read(kid, at)
                else:
                    close()
                    read(kid, at)
                    close()

    for node in nodes:
        read(node)
        close()
    return "\n".join(blocks)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, expression and count of distinct shapes in this task; one shape's pages are merged here already."""
    unlimited()
    shapes: dict[tuple[str, str], Node] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, f"{checksum(s) & (1 << 64) - 1:016x}", json.dumps(dump(n))) for (h, s), n in shapes.items()]
        shapes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["host", "shape", "tree"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = generalise(parse(page))
            key = (host, shape_of(tree))
            shapes[key] = merge(shapes[key], tree) if key in shapes else tree
            if len(shapes) >= 2000:
                yield out()
    if shapes:
        yield out()


def shape_of(node: Node) -> str:
    return node.label + "(" + ",".join([shape_of(k) for k in node.kids]) + ")" if node.kids else node.label


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One expression for each group (host, part) of the sorted rows, aligned as they stream in, those of one shape with each other first."""
    unlimited()
    key = shape = wrapper = same = None
    out: list[tuple] = []

    def whole() -> Node | None:
        return same if wrapper is None else wrapper if same is None else merge(wrapper, same)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "part", "tree"])

    for batch in batches:
        for host, part, this, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "shape", "tree")), strict=True):
            other = load(json.loads(tree))
            if (host, part) != key:
                if key is not None:
                    out.append((*key, json.dumps(dump(whole()))))
                key, shape, wrapper, same = (host, part), this, None, other
            elif this == shape:
                same = merge(same, other)
            else:
                wrapper, shape, same = whole(), this, other
        if len(out) > 1000:
            yield flush()
    if key is not None:
        out.append((*key, json.dumps(dump(whole()))))
    yield flush()


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unlimited()
    for batch in batches:
        rows = []
        for host, tree in zip(batch.column("host").to_pylist(), batch.column("tree").to_pylist(), strict=True):
            root = load(json.loads(tree))
            path = article_path(root)
            rows.append((host, path, template_texts(root, path), expression(root)))
        kinds = [("host", pa.string()), ("path", pa.list_(pa.string())), ("fixed", pa.list_(pa.int64())), ("expression", pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


#: Into how many parts a host's shapes are dealt, by a hash, for each round of alignment; the last one has the whole host.
PARTS = (256, 16, 1)


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, path, fixed, expression: one wrapper for each host, from all of its pages, whatever order they come in."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("page"))
    trees = rows.mapInArrow(_expressions, "host string, shape string, tree string").withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(PARTS[0])).cast("int"))
    for parts in PARTS:
        dealt = trees.withColumn("part", F.col("part") % parts).repartition("host", "part").sortWithinPartitions("host", "part", "shape", "tree")
        trees = dealt.mapInArrow(_align, "host string, part int, tree string").withColumn("shape", F.format_string("%08d", "part"))
    return trees.select("host", "tree").mapInArrow(_summary, "host string, path array<string>, fixed array<bigint>, expression string")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars. Null or empty html gives an empty text; null urls form one host; repeated rows are read alike.

    Pages may be of any length and depth, and in any order. Other columns, whatever their names, are not read; an empty table gives none.
    """
    found = materialize(wrappers(pages, url, page).drop("expression"), "wrappers")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("page"), host_of(F.col(f"`{url}`")).alias("host"))
    joined = rows.join(found, "host", "left")  # the measured size of the wrappers decides between broadcast and shuffle

    @F.pandas_udf("string")
    def read(page, path, fixed):
        import pandas as pd

        return pd.Series([extract(p, list(x) if x is not None else [], frozenset(f) if f is not None else frozenset()) for p, x, f in zip(page, path, fixed, strict=True)], dtype=object)

    return joined.select("page_id", "url", read("page", "path", "fixed").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
