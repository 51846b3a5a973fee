"""Main text of web pages by consensus host paths.

Every page scores its containers: the deepest one that holds most of the page's text outside links and outside
menus, adverts and the like, and from there up to the outermost article, main or content class around it. Its
generalised path (tags with their classes, digits taken out) is a vote, and so is the text of every block beside
that article. Votes are counted by host in Spark: the path with most votes wins its host, and texts that stand beside
the articles of many of its pages are the host's furniture. Every page is then extracted anew: the containers on its
host's path unless these hold too little, and its own article but for furniture outside the path. A page without an
article, main or content class keeps, besides its container, what is marked up as text, ends a sentence or stands
before the container as a headline does, isn't mostly links and isn't furniture.

What isn't the article is named by tags, roles and the words of classes. A word that has other meanings (share,
related, search) only counts where the whole name is made of such words, else the block's links decide. A form, or a
container so named, that holds the page's main text is no such thing; of a form then only the controls go.

Text of a block is put together over inline marks, character references decoded, white space made one space. Time and
memory are linear in the page, however deep its tags are nested.

Defined results: null or empty html, and pages without any text, give an empty text; a null url or one without a host
belongs to the host ''; ties between paths fall to the smaller path hash; html that breaks off is read as far as it
goes; pages are read whole, whatever their length; repeated rows are returned as often as they stand; an empty table gives no rows. Only page_id, url and html
are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map, stored
from cyclewright.plans.joins import lookup_join

#: Share of a page's text that its container must hold.
SHARE = 0.7
#: A host's path adds its blocks where it holds at least this share of what the page's own container holds.
ENOUGH = 0.5
#: Pages of a host, and share of them, beside whose articles a text must stand to be furniture.
FURNITURE_PAGES, FURNITURE_SHARE = 3, 0.1
#: Hosts and furniture whose table is broadcast (a name or a number each); a larger one is joined by shuffle.
MOST_BROADCAST = 200_000

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^<>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = set(
    "html body main article section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset hr center menu dialog head".split()
)
CONTAINERS = {"body", "main", "article", "section", "div", "td", "center"}
NEVER_TEXT = {"head", "nav", "aside", "footer", "button", "label", "legend", "option", "output", "datalist", "select", "svg", "canvas", "object", "menu", "dialog", "audio", "video", "math"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark what isn't the article.
NOT_ARTICLE = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion sidebar sidebars menu "
    "menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies gdpr popup modal overlay newsletter "
    "subscribe login disqus comment comments commentlist widget widgets pagination pager".split()
)
#: Such words that have other meanings, too.
PERHAPS = set(
    "banner consent notice notices subscription signup share sharing social related recommended recommendations reply replies "
    "respond toolbar search skip alert".split()
)
#: Words that say where or what a box is and nothing about its text.
BOX = set(
    "bar box block body bottom btn button buttons card cards col column container content count desktop first fixed form group "
    "header holder icon icons inner input item items js last left link links list main mobile module more new outer page panel "
    "post posts articles article primary region right row secondary section site slot stories sticky text title tools top unit "
    "wrap wrapper".split()
)
#: Words in a class or id that mark the article; a header inside it is its own.
CONTENT = {"content", "article", "post", "entry", "story"}
#: A class that starts or ends so says how a page is laid out, not what it holds.
LAYOUT_FIRST = {"has", "with", "no", "without", "is", "page", "col"}
LAYOUT_LAST = {"open", "closed", "enabled", "disabled"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDS = re.compile(r"[a-z]+")
#: The end of a sentence.
ENDS = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")


class Node:
    __slots__ = ("article", "block", "container", "doubtful", "kept", "link", "named", "not_article", "number", "path", "skipped", "tag", "up", "within")

    def __init__(self, tag: str, up: Node | None, number: int):
        self.tag, self.up, self.number = tag, up, number
        self.block, self.container = tag in BLOCKS, tag in CONTAINERS
        self.article = tag in ("article", "main")
        #: Named as something else than the article; perhaps so named.
        self.not_article = self.doubtful = self.named = False
        #: Left out whatever it holds, inside an article, inside a link, hash of the containers' path.
        self.skipped, self.within, self.link = bool(up and up.skipped), bool(up and up.within), bool(up and up.link)
        self.path = up.path if up else 0


def _named(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class or id says that this isn't the article, and whether one may say so."""
    perhaps = content = False
    for name in (*attributes.get("class", "").split(), attributes.get("id", "")):
        parts = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if not parts or parts[0] in LAYOUT_FIRST or parts[-1] in LAYOUT_LAST:
            continue
        if not NOT_ARTICLE.isdisjoint(parts):
            return True, False
        if not PERHAPS.isdisjoint(parts):
            if all(x in PERHAPS or x in BOX or len(x) < 3 for x in parts):
                return True, False
            perhaps = True
        content = content or CONTENT.issuperset(parts)
    return False, perhaps and not content


def _node(tag: str, raw: str, up: Node | None, number: int) -> Node:
    node = Node(tag, up, number)
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
    names = attributes.get("class", "")
    if not node.skipped and tag not in ("html", "body", "main", "article"):
        words = WORDS.findall(f"{names} {attributes.get('id', '')}".lower()) if attributes else ()
        node.skipped = tag in NEVER_TEXT or (tag == "header" or "header" in words) and not node.within
        if attributes:
            hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            hidden = hidden or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            node.skipped = node.skipped or hidden
            node.not_article, node.doubtful = _named(attributes)
            node.not_article = node.not_article or attributes.get("role", "").lower() in ROLES
        node.not_article = node.not_article or tag == "form"
        if not CONTENT.isdisjoint(words):
            node.article = node.within = True
    elif tag == "article" and attributes:
        node.named = _named(attributes)[0]  # one of a list of comments, say
    if node.container:
        node.within = node.within or tag in ("article", "main")
        classes = sorted(c for c in (re.sub(r"\d+", "", x) for x in names.split()) if c) if names else ()
        label = ".".join((tag, *classes)).encode("utf-8", "surrogatepass")
        node.path = xxhash.xxh64_intdigest(label, node.path)
    node.link = node.link or tag == "a"
    return node


class Page:
    """Nodes of a page, each after its parent, and its blocks: (innermost node, text, characters outside links)."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str, int]] = []
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        nodes, blocks = self.nodes, self.blocks
        nodes.append(_node("html", "", None, 0))
        stack, parts, owner, free = [nodes[0]], [], nodes[0], 0
        is_open: dict[str, int] = {}

        def flush() -> None:
            nonlocal parts, free
            if parts and (text := " ".join("".join(parts).split())):
                blocks.append((owner, text, min(free, len(text))))
            parts, free = [], 0

        def add(text: str) -> None:
            nonlocal owner, free
            node = stack[-1]
            if node.skipped or not text:
                return
            if "&" in text:
                text = entities.unescape(text)
            if not parts:
                owner = node
            parts.append(text)
            free += 0 if node.link else len(text)

        def close(first: int) -> None:
            for node in stack[first:]:
                is_open[node.tag] -= 1
            del stack[first:]

        at, end = 0, len(page)
        while at < end:
            mark = MARK.search(page, at)
            if mark is None:
                add(page[at:])
                break
            add(page[at : mark.start()])
            at = mark.end()
            tag = mark[2] and mark[2].lower()
            if not tag:
                continue
            if mark[1]:
                if is_open.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            if any(n.block for n in stack[i:]):
                                flush()
                            close(i)
                            break
                        if stack[i].block and tag not in BLOCKS:
                            break  # a stray end of an inline mark
                continue
            if tag in RAW:
                shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = shut.end() if shut else end
                continue
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCKS:
                flush()
                closing = CLOSED_BY.get(tag, set()) | {"p"} | (HEADINGS if tag in HEADINGS else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closing:
                        close(i)
                        break
                    if stack[i].block:
                        break
            if tag == "html" or tag in VOID or mark[3].endswith("/"):
                continue
            if tag == "body":
                close(1)
            nodes.append(_node(tag, mark[3], stack[-1], len(nodes)))
            stack.append(nodes[-1])
            is_open[tag] = is_open.get(tag, 0) + 1
        flush()

    def _sums(self, blocks: list[tuple[Node, str, int]]) -> list[int]:
        """Characters outside links that each node holds."""
        held = [0] * len(self.nodes)
        for node, _, free in blocks:
            held[node.number] += free
        for node in reversed(self.nodes[1:]):
            held[node.up.number] += held[node.number]
        return held

    def _judge(self) -> None:
        """Leaves out the blocks in what is not the article, unless it holds the page's main text."""
        held = self._sums(self.blocks)
        half = held[0] / 2
        # Nodes with a main element, or with an article element that has half of the text, inside.
        main = [False] * len(self.nodes)
        for node in reversed(self.nodes[1:]):
            own = not node.not_article and not node.named and (node.tag == "main" or node.tag == "article" and held[node.number] >= half > 0)
            main[node.up.number] = main[node.up.number] or main[node.number] or own
        for node in self.nodes:
            excused = main[node.number] or node.tag == "form" and held[node.number] >= half > 0
            node.kept = (node.up is None or node.up.kept) and (not node.not_article or excused)
            if node.up is not None:
                node.doubtful = node.doubtful or node.up.doubtful
        self.blocks = [b for b in self.blocks if b[0].kept and (not b[0].doubtful or self._reads(b))]

    @staticmethod
    def _reads(block: tuple[Node, str, int]) -> bool:
        """Whether a block reads as a sentence and not as links."""
        _, text, free = block
        return 2 * free > len(text) and ENDS.search(text) is not None

    def container(self) -> tuple[Node | None, list[int]]:
        """The deepest container with enough of the page's text outside links, and what each node holds."""
        held = self._sums(self.blocks)
        best = None
        for node in self.nodes:
            n = held[node.number]
            if n and n >= SHARE * held[0] and (node.container or node.up is None):
                best = node  # two nodes with more than half of the text hold one another
        return best, held

    def inside(self, top: Node) -> list[bool]:
        """For each node whether it is `top` or in it."""
        within = [False] * len(self.nodes)
        within[top.number] = True
        for node in self.nodes[top.number + 1 :]:
            within[node.number] = within[node.up.number]
        return within


def around(node: Node | None) -> Iterator[Node]:
    """A node and what is around it, from the inside."""
    while node is not None:
        yield node
        node = node.up


def own_article(best: Node) -> Node:
    """The outermost article, main or content class around a page's container, or the container itself."""
    found = best
    for node in around(best):
        if node.article and node.container:
            found = node
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def votes(page: str | None) -> tuple[int | None, set[int]]:
    """Path of a page's article, and hashes of the texts beside it."""
    read = Page(page or "")
    best, _ = read.container()
    if best is None:
        return None, set()
    top = own_article(best)
    within = read.inside(top)
    return _signed(top.path), {text_hash(text) for node, text, _ in read.blocks if not within[node.number]}


def main_text(page: str | None, path: int | None = None, furniture: list[int] | None = None) -> str:
    """The blocks of the page's own article and those on the given path, without the host's furniture."""
    read = Page(page or "")
    best, held = read.container()
    if best is None:
        return "\n".join(text for _, text, _ in read.blocks)
    top, known = own_article(best), set(furniture or ())
    within = read.inside(top)
    on_path = [False] * len(read.nodes)
    for node in read.nodes:
        is_one = path is not None and (node.container or node.up is None) and _signed(node.path) == path
        on_path[node.number] = is_one or node.up is not None and on_path[node.up.number]
    placed = sum(free for node, _, free in read.blocks if on_path[node.number])
    if not placed or placed < ENOUGH * held[best.number]:
        on_path = [False] * len(read.nodes)
    corrected = any(on_path)
    before = True  # of the page's own container
    out = []
    for block in read.blocks:
        node, text, free = block
        before = before and not within[node.number]
        if on_path[node.number]:
            keep = True
        elif within[node.number]:
            keep = not (corrected and known and text_hash(text) in known)
        elif top.article:
            keep = False
        else:
            in_text = not node.container and node.up is not None or ENDS.search(text) is not None
            headline = before and node.up is top.up
            keep = 2 * free > len(text) and (in_text or headline) and not (known and text_hash(text) in known)
        if keep:
            out.append(text)
    return "\n".join(out)


#: Kinds of votes: a page, its article's path, a text beside its article.
PAGE, PATH, BESIDE = 0, 1, 2


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            path, beside = votes(page)
            rows.append((host, PAGE, 0))
            rows += [(host, PATH, path)] * (path is not None)
            rows += [(host, BESIDE, x) for x in beside]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        kinds = (pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "kind", "vote"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("html", "path", "furniture")]
        texts = [main_text(*row) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def host_votes(pages: DataFrame) -> DataFrame:
    """w_host, path (with most votes), furniture (hashes of texts) of each host. pages: of `with_host`.

    A host's furniture is bounded by the blocks that its pages have beside their articles, over FURNITURE_SHARE.
    """
    counts = arrow_map(pages.select("host", "html"), _votes, "host string, kind int, vote long").groupBy("host", "kind", "vote").count()
    counts = stored(counts.where((F.col("kind") != BESIDE) | (F.col("count") >= FURNITURE_PAGES)))
    size = counts.where(F.col("kind") == PAGE).select(F.col("host").alias("s_host"), F.col("count").alias("n_pages"))
    counts = lookup_join(counts, size.withColumnRenamed("s_host", "host"), ["host"])
    is_path, enough = F.col("kind") == PATH, F.col("count") >= F.col("n_pages") * FURNITURE_SHARE
    votes_ = counts.where(is_path | (F.col("kind") == BESIDE) & enough)
    return votes_.groupBy(F.col("host").alias("w_host")).agg(
        F.max_by(F.when(is_path, F.col("vote")), F.when(is_path, F.struct("count", F.bitwise_not("vote")))).alias("path"),
        F.collect_list(F.when(~is_path, F.col("vote"))).alias("furniture"),
    )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = with_host(pages)
    winners = stored(host_votes(pages))
    size = winners.agg(F.count("*") + F.coalesce(F.sum(F.size("furniture")), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        winners = F.broadcast(winners)
    rows = pages.join(winners, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "path", "furniture")
    return arrow_map(rows, _texts, "page_id long, url string, text string, n_chars long")
