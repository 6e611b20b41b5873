"""Main text of web pages by wrapper induction: trees of same-host pages are aligned, constant nodes are template."""

from __future__ import annotations

import html as entities
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import arrow_rows
from cuefold.session import durable

#: A slot is template if at least so many different pages of the host have it, and this share has one text.
LEAST_PAGES, CONSTANT = 3, 0.5
#: How many times longer than the text of its articles what a page has beside them must be to count too, where the host's wrapper is known.
PRIOR = 4

# Elements without content, with raw content, of running text, without main text, and words of class, id or role that name such.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BARRED = frozenset("head nav footer aside form button select option fieldset menu dialog object audio video canvas map figure".split())
ROLES = frozenset(
    "ad ads advert adverts advertisement advertisements banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidebars aside comment comments reply replies respond disqus menu menus nav navbar navigation navigational breadcrumb breadcrumbs pagination pager "
    "share sharing social related recommended newsletter subscribe signup login search footer header masthead toolbar widget widgets complementary contentinfo".split()
)
MAIN = ("article", "main")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


@dataclass
class Node:
    tag: str
    label: str
    barred: bool
    parts: list = field(default_factory=list)


def parsed(page: str) -> Node:
    """The tree of a page as browsers would mend it in the main: unclosed elements end with their parent, p before a block."""
    root = Node("#root", "#root", False)
    stack, at = [root], 0
    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        closing, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            if found.group()[:2] not in ("<!", "<?"):
                stack[-1].parts.append(found.group())
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            open_tags = [n.tag for n in stack]
            if tag == "body" and "head" in open_tags:
                del stack[open_tags.index("head") :]
            elif tag != "br" and "p" in open_tags:
                del stack[len(open_tags) - 1 - open_tags[::-1].index("p") :]
            elif tag == "li" and stack[-1].tag == "li":
                stack.pop()
        words = re.findall(r"[a-z]+", " ".join("".join(m) for m in NAMES.findall(attributes)).lower()) if attributes else []
        inside = any(n.tag in MAIN for n in stack)
        barred = tag in BARRED or (tag == "header" and not inside) or (tag not in (*MAIN, "body", "html") and not ROLES.isdisjoint(words))
        node = Node(tag, tag + "".join("." + w for w in sorted(set(words))[:3]), barred)
        stack[-1].parts.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    return root


def blocks(node: Node, out: list[str], barred: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks under a node in page order, without barred nodes; inline elements run on, a line break is space."""
    piece: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            out.append(text)
        piece.clear()

    def walk(n: Node) -> None:
        for part in n.parts:
            if isinstance(part, str):
                piece.append(part)
            elif part.barred or id(part) in barred:
                if part.tag not in INLINE:
                    flush()
            elif part.tag == "br":
                piece.append(" ")
            elif part.tag in INLINE:
                walk(part)
            else:
                flush()
                walk(part)
                flush()

    walk(node)
    flush()
    return out


def mains(node: Node) -> list[Node]:
    """The outermost article or main elements outside barred nodes."""
    found = []
    for part in node.parts:
        if isinstance(part, Node) and not part.barred:
            found += [part] if part.tag in MAIN else mains(part)
    return found


def squeezed(node: Node) -> tuple[str, list, list[Node]]:
    """(label, children, nodes): the tree of block elements, in which a run of equal siblings is one repeated child."""
    children: list[tuple[str, list, list[Node]]] = []
    for part in node.parts:
        if isinstance(part, Node) and part.tag not in INLINE and part.tag not in VOID:
            child = squeezed(part)
            if children and children[-1][0] == child[0] and shape(children[-1]) == shape(child):
                children[-1][2].extend(child[2])
            else:
                children.append(child)
    return node.label, children, [node]


def shape(tree) -> list:
    """Labels alone, as JSON may hold them."""
    return [tree[0], [shape(c) for c in tree[1]]]


def tree_match(a, b, pairs: list[tuple]) -> int:
    """Simple tree matching: the most nodes two trees share in order, from the roots on; pairs gets (node of a, number of b).

    It is exact at any size: equal subtrees, and equal children at either end, match whole; the weight of two
    different shapes is found once, however often they meet; only pairs that match are traced.
    """
    shapes: dict[tuple, int] = {}
    keys: list[tuple] = []
    sizes: list[int] = []
    weights: dict[tuple[int, int], int] = {}

    def mark(tree, number: int) -> tuple:
        children, at = [], number + 1
        for c in tree[1]:
            children.append(mark(c, at))
            at += sizes[children[-1][0]]
        key = (tree[0], tuple(c[0] for c in children))
        n = shapes.setdefault(key, len(keys))
        if n == len(keys):
            keys.append(key)
            sizes.append(at - number)
        return n, tree, number, children

    def ends(xs: tuple, ys: tuple) -> tuple[int, int]:
        """Numbers of equal children at the start and, of the rest, at the end: some best matching has them all."""
        least = min(len(xs), len(ys))
        start = next((i for i in range(least) if xs[i] != ys[i]), least)
        return start, next((i for i in range(least - start) if xs[-1 - i] != ys[-1 - i]), least - start)

    def weight(m: int, n: int, ways: list[bytearray] | None = None) -> int:
        """Nodes two shapes share; ways gets what to do with each pair of the children between the ends: 0 and 1 leave one, 2 match."""
        if m == n:
            return sizes[m]
        (label, xs), (other, ys) = keys[m], keys[n]
        if label != other:
            return 0
        if ways is None and (m, n) in weights:
            return weights[m, n]
        start, end = ends(xs, ys)
        total = 1 + sum(sizes[x] for x in xs[:start]) + sum(sizes[x] for x in xs[len(xs) - end :])
        ys = ys[start : len(ys) - end]
        last = [0] * (len(ys) + 1)
        for x in xs[start : len(xs) - end]:
            row, way = [0], bytearray(len(ys))
            for j, y in enumerate(ys):
                both = last[j] + weight(x, y)
                up, left = last[j + 1], row[j]
                if both > up and both > left:
                    row.append(both)
                    way[j] = 2
                else:
                    row.append(max(up, left))
                    way[j] = up < left
            last = row
            if ways is not None:
                ways.append(way)
        weights[m, n] = total + last[-1]
        return weights[m, n]

    def trace(x: tuple, y: tuple) -> None:
        pairs.append((x[1], y[2]))
        ways: list[bytearray] = []
        xs, ys = x[3], y[3]
        if x[0] == y[0]:
            start, end = len(xs), 0
        else:
            weight(x[0], y[0], ways)
            start, end = ends(keys[x[0]][1], keys[y[0]][1])
        for i in range(start):
            trace(xs[i], ys[i])
        i, j = len(xs) - end - start, len(ys) - end - start
        while i and j:
            way = ways[i - 1][j - 1]
            i, j = i - (way != 1), j - (way != 0)
            if way == 2:
                trace(xs[start + i], ys[start + j])
        for i in range(end):
            trace(xs[-1 - i], ys[-1 - i])

    one, two = mark(a, 0), mark(b, 0)
    shared = weight(one[0], two[0])
    if shared:
        trace(one, two)
    return shared


def aligned(tree, exemplar: list) -> list[tuple]:
    """(squeezed node, number of the exemplar's node) of the nodes that match."""
    pairs: list[tuple] = []
    tree_match(tree, exemplar, pairs)
    return pairs


def own_text(tree) -> str:
    """Text of a slot: of its nodes and what stands in them."""
    return " ".join(t for node in tree[2] for t in blocks(node, []))


def places(root: Node) -> dict[int, bool]:
    """Nodes that may be template, by id, and whether they stand in an article or main element; such elements and what holds them may not, barred nodes never count."""
    out: dict[int, bool] = {}

    def walk(n: Node, inside: bool) -> bool:
        holds = not inside and n.tag in MAIN
        for part in n.parts:
            if isinstance(part, Node) and not part.barred:
                holds = walk(part, inside or n.tag in MAIN) or holds
        if not holds:
            out[id(n)] = inside
        return holds

    walk(root, False)
    return out


def main_text(root: Node, template: set[int], wrapped: bool) -> str:
    """Text of the page's articles less template; of the whole body less template if that is PRIOR times more beside
    them or they have none, by a known wrapper alone. A page that is all template has no other content."""

    def text(nodes: list[Node], gone: set[int] = frozenset()) -> str:
        out: list[str] = []
        for node in nodes:
            blocks(node, out, gone)
        return " ".join(out)

    found = mains(root)
    inner, whole = text(found, template), text([root], template) if wrapped else ""
    if inner and len(whole) <= (1 + PRIOR) * len(inner):
        return inner
    return whole or text(found) or text([root])


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): the host in lower case without port, empty for an address without one."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def exemplars(pages: DataFrame) -> DataFrame:
    """(host, exemplar): the tree most pages of a host have; of equally many the first as text."""

    def run(rows):
        for host, page in rows:
            yield host, json.dumps(shape(squeezed(parsed(page))))

    trees = pages.select("host", "html").mapInArrow(arrow_rows(run, pa.schema([("host", pa.string()), ("tree", pa.string())])), "host string, tree string")
    counts = trees.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("host").agg(F.min_by("tree", F.struct(-F.col("n"), "tree")).alias("exemplar"))


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def induced(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, exemplar, template): (node, least, most) of the exemplar's nodes whose text is constant over the host's
    different pages, and that text; where two texts have half the pages each, both.

    Inside articles the pages count as different only if their articles are. Slots are counted by (host, node,
    text) before they are shuffled, so a host may hold any share of the pages.
    """
    schema = pa.schema([("host", pa.string()), ("node", pa.int32()), ("text", pa.int64()), ("page", pa.int64())])

    def run(rows):
        for host, page, exemplar in rows:
            root = parsed(page)
            place = places(root)
            whole, article = hashed(page), hashed(" ".join(t for node in mains(root) for t in blocks(node, [])))
            for node, number in aligned(squeezed(root), json.loads(exemplar)):
                inside = place.get(id(node[2][0]))
                text = own_text(node) if inside is not None else ""
                if text:
                    yield host, number, hashed(text), article if inside else whole

    slots = pages.select("host", "html").join(trees, "host").select("host", "html", "exemplar").mapInArrow(arrow_rows(run, schema, 20_000), "host string, node int, text long, page long")
    texts = slots.distinct().groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("n"))
    nodes = texts.groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.max("n").alias("top"), F.min_by("text", F.struct(-F.col("n"), "text")).alias("least"), F.max_by("text", F.struct("n", "text")).alias("most")
    )
    constant = nodes.where((F.col("pages") >= LEAST_PAGES) & (F.col("top") >= CONSTANT * F.col("pages")))
    return trees.join(constant.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "least", "most"))).alias("template")), "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page row.

    The trees of a host's pages are aligned with its most frequent tree by simple tree matching. A slot
    whose text is the same on most of the host's different pages is template, the others hold content; within
    article or main elements only the text that is the same goes, and copies of one article count once.
    A run of equal siblings is one slot. The text is what is left of the article or main elements when
    template is taken away, or without any, or with PRIOR times more beside them, of the body; elements that
    are by name, class, id or role a menu, header, footer, sidebar, notice, advert, form or comment never
    count. A null or empty html gives an empty text; a null
    url is a host of its own. Repeated rows are answered one by one. Only page_id, url and html are read.
    An empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    found = hosts(pages)
    trees = durable(exemplars(found))
    wrappers = durable(induced(found, trees))

    def run(rows):
        for page_id, url, page, exemplar, numbers, least, most in rows:
            root = parsed(page)
            gone: set[int] = set()
            if numbers:
                constant, place = dict(zip(numbers, zip(least, most))), places(root)
                for node, number in aligned(squeezed(root), json.loads(exemplar)):
                    inside = place.get(id(node[2][0]))
                    if number in constant and inside is not None and (not inside or hashed(own_text(node)) in constant[number]):
                        gone.update(map(id, node[2]))
            yield page_id, url, main_text(root, gone, bool(numbers))

    texts = found.join(wrappers, "host", "left").select("page_id", "url", "html", "exemplar", "template.node", "template.least", "template.most")
    return texts.mapInArrow(arrow_rows(run, schema), "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
