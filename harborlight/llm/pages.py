"""HTML extraction by what the markup says and, where it is silent, by template deduction over the pages of a host.

A page's markup is read as a tree of open elements; a token is an element's path, or a text with the path it stands at. Tokens of a
host with the same occurrence vector (how often each different page has them) form an equivalence class; vectors are compared by a
sum of hashes over pages, so classes come out of one aggregation however many pages a host has. A text is the template's if an
element around it is of its class, as each of these elements then holds the text: the root for texts of every page, an optional or
repeated element for classes nested in it. What remains is the page's own. Elements that say they are an article, or that they are
not (menus, forms, advertisements), are taken at their word, as menus and advertisements differ from page to page. Within an article
a text is the template's only if it fills a plain container that stands, with this text, once in every article of the host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, map_batches

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed values of the HTML standard: elements without an end, with raw text, and those that start a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of an article, and words in a class, id or role that say the same of any element.
_OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe button select input textarea svg canvas object menu dialog title".split())
_ROLES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")
#: Plain containers: text right in one, unlike that of headings, paragraphs, lists and tables, is not yet prose by its markup.
_PLAIN = frozenset(("div", "section"))
#: What tokens of articles begin with; alone, it stands for the article of a page.
_OWN = "\1"
#: So many different pages of a host have to agree before a text counts as the template's.
SUPPORT = 3
#: Pages of one host are dealt to tasks in lots of at most one in this many of all pages.
SHARES = 1000


class Node:
    """An open element: its name, whether it is outside any article, whether it is one, and the innermost block element at it."""

    __slots__ = ("name", "outside", "article", "path", "block")

    def __init__(self, name: str, attributes: str, above: "Node | None") -> None:
        words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        self.article = name in ("article", "main") or bool(above and above.article)
        own = name in _OUTSIDE or name == "header" and not (above and above.article) or name not in ("html", "body", "article", "main") and bool(_ROLES.search(words))
        self.outside = own or bool(above and above.outside)
        self.name = name
        self.path = f"{above.path if above else ''}/{name}" + (f".{words}" if words else "")
        self.block = self if name in _BLOCK or not above else above.block


def events(page: str) -> Iterator[tuple[str, str, Node | None]]:
    """(kind, value, innermost open element): kind is text, open or close; a value is raw text or the tag's token."""
    stack: list[Node] = []
    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        if m is None:
            yield "text", page[at:], stack[-1] if stack else None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], stack[-1] if stack else None
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    node = stack[k]
                    del stack[k:]
                    yield "close", f"{node.path}>", node
                    break
            continue
        if name in _BLOCK and name != "br" and stack and any(n.name == "p" for n in stack[-3:]):
            k = max(i for i, n in enumerate(stack) if n.name == "p")
            yield "close", f"{stack[k].path}>", stack[k]
            del stack[k:]
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1].name == name:
            stack.pop()
        node = Node(name, m[3] or m[6] or "", stack[-1] if stack else None)
        yield "open", node.path, node
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in _VOID:
            stack.append(node)


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def text_token(text: str, node: Node | None) -> str:
    return f"{node.path if node else ''}\0{digest(squeezed(text)).hex()}"


def own_token(block: str, box: Node | None) -> str | None:
    """The token of an article's block of text, if a plain container in the article holds it."""
    return f"{_OWN}{box.path}\0{digest(block).hex()}" if box and box.name in _PLAIN and box.article else None


def tokens(page: str) -> tuple[dict[str, int], dict[str, int], int]:
    """How often the page has each element and text about which the markup is silent, next to "" for its root.

    Then the same of the plain containers in its article and of the blocks of text right in them, next to _OWN for the article, and a
    hash of the article's text; nothing and 0 if it has none.
    """
    count: dict[str, int] = {"": 1}
    own: dict[str, int] = {}
    whole: list[str] = []
    block: list[str] = []
    box: Node | None = None

    def close_block() -> None:
        text = squeezed("".join(block)) if block else ""
        block.clear()
        if text:
            whole.append(text)
            if token := own_token(text, box):
                own[token] = own.get(token, 0) + 1

    for kind, value, node in events(page):
        if kind != "text":
            if node.name in _BLOCK:
                close_block()
            if kind == "open" and node.article and not node.outside and node.name in _PLAIN:
                own[_OWN + node.path] = own.get(_OWN + node.path, 0) + 1
        elif node is None or not node.outside:
            if node is not None and node.article:
                block.append(value)
                box = node.block
            else:
                close_block()
        if kind == "close" or node is not None and (node.outside or node.article):
            continue
        if kind == "text":
            if not value.strip():
                continue
            value = text_token(value, node)
        count[value] = count.get(value, 0) + 1
    close_block()
    return (count, own | {_OWN: 1}, int.from_bytes(digest("\n".join(whole)), "little", signed=True)) if whole else (count, {}, 0)


def templates(pages: DataFrame) -> DataFrame:
    """host, texts: the text tokens of each host's template, for hosts that have any; pages(host, html)."""
    arrow_limits(pages.sparkSession)

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for host, key, page in zip(b.column("host").to_pylist(), b.column("page_key").to_pylist(), b.column("html").to_pylist()):
            count, own, article_key = tokens(page) if page else ({}, {}, 0)
            for k, found in ((key, count), (article_key, own)):
                for token, n in found.items():
                    for x, v in zip(out, (host, k, token, n)):
                        x.append(v)
        return pa.RecordBatch.from_pydict({"host": pa.array(out[0], pa.string()), "page_key": pa.array(out[1], pa.int64()), "token": pa.array(out[2], pa.string()), "n": pa.array(out[3], pa.int32())})

    seen = map_batches(pages.select("host", F.xxhash64("html").alias("page_key"), "html"), read, "host string, page_key long, token string, n int")
    # copies of a page, or of an article, count once: they show nothing about what its text is
    once = seen.select("host", "token", F.xxhash64("page_key", "n").cast("decimal(38,0)").alias("h")).distinct()
    vectors = once.groupBy("host", "token").agg(F.sum("h").alias("vector"), F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT)
    classes = vectors.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens"))
    inside = lambda t: F.exists(F.filter("tokens", lambda e: ~F.contains(e, F.lit("\0"))), lambda e: F.startswith(t, F.concat(e, F.lit("/"))) | F.startswith(t, F.concat(e, F.lit("\0"))))
    filled = lambda t: F.array_contains("tokens", F.lit(_OWN)) & F.exists("tokens", lambda e: e == F.substring_index(t, "\0", 1))
    texts = classes.select("host", F.explode(F.filter("tokens", lambda t: F.contains(t, F.lit("\0")) & F.when(F.startswith(t, F.lit(_OWN)), filled(t)).otherwise(inside(t)))).alias("token"))
    return texts.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("texts"))


def article(page: str, template: frozenset[str]) -> str:
    """The text of the article or main elements; a page with none in them takes what is neither outside nor of the template.

    Blocks of the article that are the template's go too, unless it has no others.
    """
    blocks: dict[bool, list[str]] = {True: [], False: []}
    fixed: list[bool] = []
    block: list[str] = []
    own = False
    box: Node | None = None

    def close_block() -> None:
        text = squeezed("".join(block)) if block else ""
        if text:
            blocks[own].append(text)
            if own:
                fixed.append(bool(template) and own_token(text, box) in template)
        block.clear()

    for kind, value, node in events(page):
        if kind != "text":
            if node.name in _BLOCK:
                close_block()
        elif node is None or not node.outside:
            inside = node is not None and node.article
            if inside != own:
                close_block()
                own = inside
            box = node.block if node is not None else None
            block.append(" " if template and not own and text_token(value, node) in template else value)
    close_block()
    return "\n".join([t for t, f in zip(blocks[True], fixed) if not f] or blocks[True] or blocks[False])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text. Repeated rows stay; a null url belongs to the host "". Other columns play no part.
    A host with more than a SHARES-th of all pages has its template once for each SHARES-th, and its pages spread over these copies.
    """
    arrow_limits(pages.sparkSession)
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    p = p.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[tuple, frozenset] = {}
        texts = []
        for page, t in zip(b.column("html").to_pylist(), b.column("texts").to_pylist()):
            key = tuple(t or ())
            texts.append(article(page or "", known.setdefault(key, frozenset(key))))
        return pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    share = max(1, p.count() // SHARES)
    # fewer than 2 * SHARES hosts, as each has more than a SHARES-th of the pages: small enough to broadcast whatever the input
    hot = p.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).cast("int").alias("copies"))
    spread = p.join(F.broadcast(hot), "host", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), "copies").cast("int"), F.lit(0)))
    copied = templates(p).join(F.broadcast(hot), "host", "left").select("host", "texts", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    joined = spread.join(copied, ["host", "copy"], "left").select("page_id", "url", "html", "texts")
    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")


def op5_pages(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
