"""Main text of HTML reports, by a style tree per site.

Health reports of earlier tools come as HTML, one site (node or host) giving
many pages of the same layout. The pages of a site are merged into one tree:
pages' elements that have the same path of names fall on the same node. A node
keeps how many pages have it, which child sequences (presentation) and which
texts (content) it shows, and how many pages show each. Entropies of the two
give its importance: a menu that reads the same on every page has none, an
article that no other page repeats has all. Pages of equal contents count once,
so that copies of one page do not make its text look like a menu. Each page then
loses its branches of low importance.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements without markup inside: all up to their end tag goes.
RAW = frozenset("script style iframe textarea title".split())
# Elements that go with their contents, but only where they are closed: one left open may hold the rest of the text.
CLOSED_NOISE = frozenset("noscript template svg select".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object param q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
) | CLOSED_NOISE
# A start tag that ends an open element of the same kind.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
       "nav ol p pre section table ul".split()},
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
# Elements that never hold main text, wherever they stand.
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head".split()) | CLOSED_NOISE
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Names say something only about elements that hold blocks; a heading or a paragraph of such a name is text.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td header center fieldset details figure ins".split())
# Names of what is no article text even where it is written as prose: adverts, consent, readers' comments, the site's frame.
NOISE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|sponsor\w*|cookies?|consent|gdpr|nav|navbar|navigation|sidebar|widgets?|footer|masthead|"
    r"breadcrumbs?|comments?|commentlist|respond|disqus|newsletter|subscribe|subscription|popup|modal)(?:$|[-_ ])"
)
# Names that an article's own parts may carry too: such an element goes if its links, or the site's other pages, agree.
DOUBTFUL_NAMES = re.compile(
    r"(?:^|[-_ ])(?:banner|promo\w*|notices?|menu\w*|topbar|header|reply|replies|share|sharing|social|related|recommend\w*|"
    r"signup|login|search\w*|overlay|pagination|pager|toolbar|skip)(?:$|[-_ ])"
)
LINKED = 0.5  # from this share of its letters within links, an element of a doubtful name is no text

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*(?:\"[^\"]*+\"|'[^']*+'|))*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]++|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# Name and value of each attribute; a quote opens a value only after an equals sign.
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")

GAMMA = 0.9  # weight of a node's own importance against its branches', as depth grows
MIN_PAGES = 5  # below this a site says nothing about what repeats
LOW = 0.2  # branches below this importance go


@dataclass(slots=True)
class Node:
    tag: str
    name: str
    noise: bool
    doubtful: bool = False
    path: int = 0
    children: list = field(default_factory=list)  # nodes and texts, in page order


def parse(text: str) -> Node:
    """A tree from any markup: unknown end tags are dropped, open elements are closed where they must be."""
    root = Node("", "", False)
    stack = [root]
    is_open: Counter[str] = Counter()  # names on the stack, so that an end tag without a start costs no search
    at, end = 0, len(text)

    def close(i: int, closed: bool = False) -> None:
        """Closes all from stack[i] on; those above it, and itself unless closed by its own end tag, were left open."""
        for node in stack[i + closed :]:
            if node.tag in CLOSED_NOISE:
                node.noise = False
        for node in stack[i:]:
            is_open[node.tag] -= 1
        del stack[i:]

    while at < end:
        found = _TOKEN.match(text, at)
        token, at = found.group(), found.end()
        if token[0] != "<" or len(token) == 1:
            stack[-1].children.append(token)
        elif token[1] in "!?":
            continue
        elif token[1] == "/":
            name = _NAME.match(token).group(1).lower()
            if is_open[name] and name not in ("body", "html"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        close(i, closed=True)
                        break
        else:
            name = _NAME.match(token).group(1).lower()
            if name in RAW:
                last = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(text, at)
                # Self-closed ones have no contents in drawings; elsewhere browsers look for the end tag, if there is one.
                if not token.endswith("/>") or last and not any(n.tag == "svg" for n in stack):
                    at = last.end() if last else end
                continue
            for over in CLOSES.get(name, ()):
                for i in () if not is_open[over] else range(len(stack) - 1, 0, -1):
                    if stack[i].tag == over:
                        close(i)
                        break
                    if stack[i].tag in CLOSED_NOISE or stack[i].tag not in INLINE and stack[i].tag != "p":
                        break
            node = _node(name, token)
            stack[-1].children.append(node)
            if name not in VOID and not token.endswith("/>"):
                stack.append(node)
                is_open[name] += 1
    close(1)
    return root


def _node(tag: str, token: str) -> Node:
    labels, role, hidden = "", "", False
    inside = token[len(tag) + 1 :]
    for key, value in _ATTRIBUTE.findall(inside) if len(inside) > 1 else ():
        key = key.lower()
        if key == "hidden":
            hidden = True
        elif key == "role":
            role = value.strip("\"'").lower()
        elif key in ("class", "id"):
            labels = f"{labels} {value.strip(chr(34) + chr(39)).lower()}"
    labels = " ".join(sorted(labels.split()))
    named = labels if tag in CONTAINERS else ""
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden or bool(named and NOISE_NAMES.search(named))
    if tag in ("html", "body", "article", "main"):
        # A page's frame may carry any name; a single article may be an advert or a comment.
        noise = tag == "article" and bool(re.search(r"(?:^|[-_ ])(?:comments?|promo\w*|ads?)(?:$|[-_ ])", labels))
    # Numbers in names (post-17) are of the page, not of the layout.
    name = f"{tag}.{re.sub(r'[0-9]+', '0', labels)}" if labels else tag
    return Node(tag, name, noise, bool(named and DOUBTFUL_NAMES.search(named)))


def _clean(text: str) -> str:
    return " ".join(html_entities.unescape(text).split())


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def features(text: str) -> set[tuple[int, int, int]]:
    """(path, kind, value) of a page: kind 0 the node itself, 1 its child sequence, 2 a text that stands in it.

    Without what is surely no main text: that goes in any case, and copies may differ in it.
    """
    out: set[tuple[int, int, int]] = set()
    todo = [(parse(text), 0)]
    while todo:
        node, above = todo.pop()
        path = _hash(node.name, above & ((1 << 64) - 1))
        out.add((path, 0, 0))
        below = [c for c in node.children if isinstance(c, Node) and not c.noise]
        # Runs of the same child count once: a longer list is no other layout.
        names = [c.name for i, c in enumerate(below) if i == 0 or below[i - 1].name != c.name]
        out.add((path, 1, _hash("|".join(names))))
        words = _clean(" ".join(c for c in node.children if isinstance(c, str)))
        if words:
            out.add((path, 2, _hash(words)))
        todo += [(c, path) for c in below]
    return out


def style_trees(reports: DataFrame, site: str = "node_ip", html: str = "content") -> DataFrame:
    """The merged tree of every site: (site, path, pages, presentation, content).

    Pages of equal features are one page, however many rows hold it. presentation
    is the entropy of the node's child sequences to the base of its pages, 1 at
    most (a page may show several); content is one minus the mean entropy of its texts, where a text
    on all pages has entropy 1 and one on a single page 0; null without texts.
    """
    schema = "site string, digest long, path array<long>, kind array<tinyint>, value array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int64()))
        for batch in batches:
            sites, pages = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(sites), 256):
                out = []
                for name, page in zip(sites[start : start + 256], pages.slice(start, 256).to_pylist(), strict=True):
                    found = sorted(features(page or ""))
                    out.append((name, _hash(repr(found)), *zip(*found, strict=True)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["site", "digest", "path", "kind", "value"]
                )

    source = reports.select(F.coalesce(F.col(site), F.lit("")).alias("site"), F.col(html).alias("page"))
    # One row per site and content; equal digests mean equal arrays, and a task sends each once.
    distinct = source.mapInArrow(rows, schema).dropDuplicates(["site", "digest"])
    # First per value, with map-side counts, so that a site of a third of all pages is spread; then per node.
    values = distinct.select("site", F.inline(F.arrays_zip("path", "kind", "value")))
    counted = values.groupBy("site", "path", "kind", "value").agg(F.count("*").alias("c"))
    entropy = F.col("c") * F.ln("c")
    per_node = counted.groupBy("site", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, entropy)).alias("style"),
        F.sum(F.when(F.col("kind") == 1, F.col("c"))).alias("layouts"),
        F.sum(F.when(F.col("kind") == 2, entropy)).alias("same"),
        F.sum(F.when(F.col("kind") == 2, F.col("c"))).alias("texts"),
    )
    base = F.ln("pages")
    several = F.col("pages") > 1
    return per_node.select(
        "site",
        "path",
        "pages",
        F.when(several, F.least(F.lit(1.0), (F.ln("layouts") - F.col("style") / F.col("layouts")) / base)).otherwise(1.0).alias("presentation"),
        F.when(F.col("texts") > 0, F.when(several, F.greatest(F.lit(0.0), 1 - F.col("same") / F.col("texts") / base)).otherwise(1.0)).alias("content"),
    )


def _importance(root: Node, tree: dict[int, tuple]) -> dict[int, tuple[float, int]]:
    """Composite importance and pages of every node of a page, from its leaves up."""
    order, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        node.path = _hash(node.name, above & ((1 << 64) - 1))
        order.append(node)
        todo += [(c, node.path) for c in node.children if isinstance(c, Node)]
    out: dict[int, tuple[float, int]] = {}
    for node in reversed(order):
        pages, presentation, content = tree.get(node.path, (0, 1.0, None))
        branches = [out[id(c)][0] for c in node.children if isinstance(c, Node) and c.tag not in VOID and not c.noise]
        if content is not None:
            branches.append(content)
        if not branches:
            value = 1.0
        elif len(branches) == 1 and content is not None:
            value = content
        else:
            kept = GAMMA ** len(branches)
            value = (1 - kept) * presentation + kept * sum(branches) / len(branches)
            value = max(value, *branches)
        out[id(node)] = (value, pages)
    return out


def _decide(root: Node, importance: dict[int, tuple[float, int]]) -> dict[int, int]:
    """Marks doubtful elements as noise where their links or the site's other pages agree; returns the letters left under each node."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        todo += [(c, linked) for c in node.children if isinstance(c, Node)]
    letters: dict[int, int] = {}
    links: dict[int, int] = {}
    for node, linked in reversed(order):
        own = sum(len(c) - c.count(" ") - c.count("\n") for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node) and not c.noise]
        n = own + sum(letters[id(c)] for c in below)
        in_links = (own if linked else 0) + sum(links[id(c)] for c in below)
        if node.doubtful and not node.noise:
            value, pages = importance[id(node)]
            node.noise = n == 0 or in_links >= LINKED * n or (pages >= MIN_PAGES and value < LOW)
        letters[id(node)], links[id(node)] = n, in_links
    return letters


def _roots(root: Node, letters: dict[int, int]) -> list[Node]:
    """Articles of a page, or its main elements, where these hold most of its letters; else all of it. Outer ones only."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    total, todo = 0, [(root, frozenset())]
    while todo:
        node, inside = todo.pop()
        if node.noise or node.tag == "header" and not inside:
            continue
        total += sum(len(c) - c.count(" ") - c.count("\n") for c in node.children if isinstance(c, str))
        kind = node.tag if node.tag in found else ""
        if kind and kind not in inside:
            found[kind].append(node)
            inside = inside | {kind}
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    for nodes in (found["article"], found["main"]):
        if nodes and 2 * sum(letters[id(n)] for n in nodes) >= total:
            return nodes
    return [root]


def main_text(page: str | None, tree: dict[int, tuple]) -> str:
    """Blocks of a page that are left after pruning, joined by two line ends."""
    if not page:
        return ""
    root = parse(page)
    importance = _importance(root, tree)
    roots = _roots(root, _decide(root, importance))
    whole = roots == [root]
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            blocks.append(text)

    for top in roots:
        # What repeats inside an article goes only where the article itself does not.
        prune = whole or importance[id(top)][0] >= 0.5
        todo: list = [(top, True)]
        while todo:
            item, opens = todo.pop()
            if isinstance(item, str):
                run.append(item)
                continue
            inline = item.tag in INLINE
            if not opens:
                if not inline:
                    flush()
                continue
            value, pages = importance[id(item)]
            if item is not top and (
                item.noise
                or (whole and item.tag == "header")
                or (prune and not inline and pages >= MIN_PAGES and value < LOW and item.tag not in VOID)
            ):
                continue
            if item.tag == "br":
                run.append(" ")
            if not inline:
                flush()
            todo.append((item, False))
            todo += [(c, True) for c in reversed(item.children)]
        flush()
    return "\n\n".join(blocks)


def extract_text(
    reports: DataFrame, report_id: str = "report_id", site: str = "node_ip", html: str = "content", keep: Sequence[str] = ()
) -> DataFrame:
    """Per row: report_id, the columns to keep (strings), text, n_chars.

    text is the main text: blocks with references decoded and white space
    collapsed, joined by two line ends; n_chars its code points. Null and empty
    pages, and pages without main text, give ''. A null site is a site of its
    own. Repeated rows give a row each, but pages of a site that are equal, save
    for what is marked as no main text, count as one for what repeats. An empty
    table gives an empty table. Sites with fewer than MIN_PAGES such pages on a
    node lose only what its element or name, with its links, marks as no main
    text. Columns to keep that are called as one of the results are replaced.
    """
    keep = [c for c in keep if c not in (report_id, "text", "n_chars")]
    trees = style_trees(reports, site, html).where(F.col("pages") >= MIN_PAGES)
    # One row per site: as large as its layout, not as its pages.
    trees = trees.groupBy("site").agg(F.collect_list(F.struct("path", "pages", "presentation", "content")).alias("tree"))
    source = reports.select(
        F.col(report_id).cast("long").alias("report"),
        F.array(*[F.col(c).cast("string") for c in keep]).cast("array<string>").alias("given"),
        F.coalesce(F.col(site), F.lit("")).alias("site"),
        F.col(html).alias("page"),
    )
    schema = "report long, given array<string>, text string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for name, page, tree in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), strict=True):
                    if name not in trees:
                        if len(trees) >= 64:
                            trees.clear()
                        trees[name] = {n["path"]: (n["pages"], n["presentation"], n["content"]) for n in tree.as_py() or ()}
                    texts.append(main_text(page, trees[name]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["report", "given", "text"])

    found = source.join(trees, "site", "left").select("report", "given", "site", "page", "tree").mapInArrow(rows, schema)
    return found.select(
        F.col("report").alias(report_id),
        *[F.get("given", F.lit(i)).alias(c) for i, c in enumerate(keep)],
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
