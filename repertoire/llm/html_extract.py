r"""Main-text extraction by wrapper induction over the pages of a host.

Each page's DOM is reduced to its text blocks: what stands between two block boundaries, with the path of
block elements (tag, class and id words) that it lies in. Pages of one host are aligned by these paths:
simple tree matching only ever pairs nodes of equal paths, so rows by path align whatever it aligns, in
any order of siblings. Spark counts the rows (host, path, text) over the host's different pages, so no
tree is held, cut or gathered, and the counts do not depend on partitions.

The wrapper of a host, by place in the aligned trees:

* constant nodes: a text that nine tenths of the host's pages, and two at least, have at one path is
  template, inside the article too, but for headings between two varying blocks of one parent;
* stale slots: paths whose texts nearly all come back on other pages, on four pages each or more (rotating adverts,
  menus, mottos), so that two or three versions of an article are none; nor is the path with most text that differs;
* varying slots: all other paths. They are content. The core is the lowest common ancestor of those that
  hold more than links and are on half of the pages; stale slots and blocks of links count inside it only.

Roles that HTML itself names (``nav``, ``aside``, ``form``, a ``header`` outside the article, ...) are left
out before, and so are containers whose class or id says such a role and nothing else (``site-footer``,
``comments``), unless they hold an ``article`` or ``main`` or are named as content too: one page alone has nothing to
align with. In an article only names of what differs from page to page count (adverts, comments, related).

Defined results: null html is empty and gives an empty text; a null url has the host ''; pages of one
host with the same blocks are one page when texts are counted, so copies never make each other template;
a host without any varying slot has no template, and one article under changing adverts is constant; unclosed or crossed tags close where the next block or an outer end tag says, an unclosed quote
at the end of its tag, ``svg`` at the next block; a reference without semicolon is decoded where HTML does;
blocks nested deeper than ``CORE_DEPTH`` are aligned as all others, the core is not sought below it;
repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, ship, written

# fixed values: element names by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE_TAGS = frozenset("aside button dialog footer form head iframe menu nav noscript script select style svg template textarea".split())
ARTICLE = frozenset(["article", "main"])
# fixed values: words of class and id names by role
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget discussion responses".split()
)
#: Roles whose blocks differ from page to page, so that no other page tells them from an article they stand in.
VARYING_ROLES = frozenset("ad ads advert adverts advertisement comment comments discussion promo promotion related replies responses sponsor sponsored".split())
PLACE_WORDS = frozenset(
    "area bar block bottom box column container global inner left list main outer page panel post reader right section site slot top unit user wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_WORDS = frozenset("has is no non not show with without".split())
CONTENT_WORDS = frozenset("article body content entry prose story text".split())
CONTAINERS = frozenset("div dl figure ol section span table ul".split())
HEADLESS = frozenset(["head", "link", "meta", "title"])
CLOSED_BY_BLOCK = "p"
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: A text on this share of a host's pages is constant; a slot with this share of returning texts is stale.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 2
#: A text of a stale slot is on so many pages on average: two or three versions of a page are no menu.
STALE_RETURNS = 4
#: A slot must be on this share of the pages to be judged stale, which bounds the wrapper.
STALE_PAGES = 0.01
LINK_SHARE = 0.5
#: Bytes of all wrappers up to which they are broadcast; beyond, pages meet theirs by host.
WRAPPER_BYTES = 64 << 20
#: Hosts whose wrappers a task keeps decoded.
HOLD_HOSTS = 2000
#: Bytes that stand for a step of a path, and the steps kept apart; deeper ones are one hash.
STEP, CORE_DEPTH = 8, 256

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _is_role(name: str, roles: frozenset[str]) -> bool:
    """Whether a class or id is a role: its words are role words, one of them of ``roles``, and place words."""
    words = _WORD.findall(name)
    if not words or words[0] in NOT_WORDS:
        return False
    return not roles.isdisjoint(words) and all(w in PLACE_WORDS or w in ROLE_WORDS for w in words)


@lru_cache(8192)
def named_role(key: str, in_article: bool = False) -> bool:
    """Whether class and id words name a role other than content; in an article those count that other pages cannot tell."""
    names = key.split()
    roles = VARYING_ROLES if in_article else ROLE_WORDS
    return any(_is_role(n, roles) for n in names) and CONTENT_WORDS.isdisjoint(w for n in names for w in _WORD.findall(n))


class Node:
    """An element of a page: its tag, class and id words, children (nodes and strings), and whether an article is in it."""

    __slots__ = ("tag", "key", "children", "holds")

    def __init__(self, tag: str, key: str = ""):
        self.tag, self.key, self.children, self.holds = tag, key, [], False

    def boilerplate(self, in_article: bool) -> bool:
        if self.tag in BOILERPLATE_TAGS:
            return True
        if self.tag == "header":
            return not in_article and not self.holds
        return bool(self.key) and self.tag in CONTAINERS and not self.holds and named_role(self.key, in_article)


def parse(page: str) -> Node:
    """The DOM of a page; scripts, styles and comments are left out."""
    root = Node("#root")
    stack = [root]
    is_open: Counter = Counter()

    def close(tag: str, stops=frozenset()):
        """Pops the innermost open ``tag``, unless one of ``stops`` is inside it."""
        if is_open[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    for n in stack[i:]:
                        is_open[n.tag] -= 1
                    del stack[i:]
                    return
                if stack[i].tag in stops:
                    return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            close(tag)
            continue
        if tag in BLOCK:
            close("svg")
            close(CLOSED_BY_BLOCK, BLOCK)
            if tag not in HEADLESS:
                close("head")
        if tag in SAME_CLOSES:
            close(tag, SAME_CLOSES[tag])
        attributes = m[4] or m[7] or ""
        key = " ".join(x for _, a, b, c in _NAME.findall(attributes) for x in (a or b or c).lower().split()) if attributes else ""
        node = Node(tag, re.sub(r"\d+", "", key))
        stack[-1].children.append(node)
        if tag in ARTICLE:
            for n in reversed(stack):
                if n.holds:
                    break
                n.holds = True
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _text(parts: list[str]) -> str:
    return " ".join(htmllib.unescape("".join(parts)).split())


@lru_cache(4096)
def _step(tag: str, key: str) -> bytes:
    return blake2b(f"{tag} {key}".encode("utf-8", "replace"), digest_size=STEP).digest()


def _below(path: bytes, step: bytes) -> bytes:
    """The path one element deeper; below ``CORE_DEPTH`` the last step is a hash of all further ones."""
    if len(path) < STEP * CORE_DEPTH:
        return path + step
    return path[: STEP * CORE_DEPTH] + blake2b(path[STEP * CORE_DEPTH :] + step, digest_size=STEP).digest()


def segments(root: Node) -> list[tuple[bytes, str, bool, bool]]:
    """(path, text, mostly links, heading) of the text blocks in page order, named roles left out."""
    out: list[tuple[bytes, str, bool, bool]] = []
    own: list[str] = []
    links = 0

    def end(path: bytes, heading: bool):
        nonlocal links
        if own:
            text = _text(own)
            if text:
                out.append((path, text, links > LINK_SHARE * len(text), heading))
            own.clear()
        links = 0

    # children left, path, in a link, in the article, whether it is a block element, whether a heading
    stack = [(iter(root.children), b"", False, False, True, False)]
    while stack:
        children, path, linked, article, _, heading = stack[-1]
        for c in children:
            if isinstance(c, str):
                own.append(c)
                if linked:
                    links += len(c.strip())
            elif c.boilerplate(article):
                if c.tag in BLOCK:
                    end(path, heading)
            elif c.tag in BLOCK:
                end(path, heading)
                stack.append((iter(c.children), _below(path, _step(c.tag, c.key)), False, article or c.tag in ARTICLE, True, c.tag in HEADINGS))
                break
            elif c.tag == "br":
                own.append(" ")
            else:
                stack.append((iter(c.children), path, linked or c.tag == "a", article, False, heading))
                break
        else:
            if stack.pop()[4]:
                end(path, heading)
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


def block(path: bytes, text: str) -> int:
    """What stands for a text at a path."""
    return _digest(path + b"\0" + text.encode("utf-8", "replace"))


class Wrapper:
    """What is known of a host: its core path, constant blocks and stale paths."""

    __slots__ = ("core", "constant", "stale")

    def __init__(self, low: bytes | None = None, high: bytes | None = None, constant=(), stale=()):
        self.core = None if low is None else _common(low, high)
        self.constant, self.stale = frozenset(constant or ()), frozenset(stale or ())

    def main_text(self, page: str) -> str:
        """The varying blocks of a page, and constant headings that stand between two of one parent."""
        kept: list[tuple[str, bytes, bool]] = []  # text, parent, constant
        outside: dict[bytes, bool] = {}
        for path, text, linked, heading in segments(parse(page)):
            if self.core is None or not path.startswith(self.core):
                if path not in outside:
                    outside[path] = _digest(path) in self.stale
                if linked or outside[path]:
                    continue
            constant = bool(self.constant) and block(path, text) in self.constant
            if not constant or (heading and kept):
                kept.append((text, path[:-STEP], constant))
        following: list[bytes | None] = [None] * len(kept)
        parent = None
        for i in range(len(kept) - 1, -1, -1):
            following[i] = parent
            parent = parent if kept[i][2] else kept[i][1]
        out, before = [], None
        for (text, own, constant), after in zip(kept, following, strict=True):
            if not constant or own == before == after:
                out.append(text)
            before = before if constant else own
        return "\n".join(out)


_ROWS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("block", pa.int64()), ("path", pa.binary()), ("linked", pa.int32()), ("leads", pa.int32()), ("chars", pa.int32())])


def _induce(batches):
    """(host, html) -> a row for each different block of a page; ``leads`` marks the first of its path."""
    for b in batches:
        rows: list[tuple] = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found: dict[int, list] = {}
            paths: set[bytes] = set()
            whole = blake2b(digest_size=8)
            for path, text, linked, _ in segments(parse(page)):
                k = block(path, text)
                whole.update(k.to_bytes(8, "big", signed=True))
                if k in found:
                    found[k][1] &= int(linked)
                else:
                    found[k] = [path, int(linked), int(path not in paths), len(text)]
                    paths.add(path)
            name = int.from_bytes(whole.digest(), "big", signed=True)
            rows += [(host, name, k, path, linked, leads, chars) for k, (path, linked, leads, chars) in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _common(low: bytes, high: bytes) -> bytes:
    """The steps that two paths begin with, and thus all paths that sort between them."""
    same = len(commonprefix([low, high]))
    return low[: same - same % STEP]


def _extract(batches):
    held: dict[str, Wrapper] = {}
    for b in batches:
        texts = []
        for page, host, *wrapper in zip(*[b.column(i).to_pylist() for i in range(2, 8)], strict=True):
            if host not in held:
                if len(held) >= HOLD_HOSTS:
                    held.clear()
                held[host] = Wrapper(*wrapper)
            texts.append(held[host].main_text(page))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def _named(batches):
    """(host, path) -> (host, digest of the path)."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(p) for p in b.column(1).to_pylist()], pa.int64())], names=["host", "digest"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, low, high, constant, stale) for every host of ``pages`` with text: first and last path of the
    varying slots, whose common steps are the core, its constant blocks and its stale paths. A host has
    fewer constant blocks than its mean page has blocks / ``CONSTANT_SHARE``, and fewer stale paths than
    that / ``STALE_PAGES``, whatever its number of pages."""
    ship(pages.sparkSession)
    rows = _hosted(pages).select("host", "html").mapInArrow(_induce, "host string, page long, block long, path binary, linked int, leads int, chars int")
    rows = rows.groupBy("host", "page", "block", "path").agg(F.min("linked").alias("linked"), F.max("leads").alias("leads"), F.max("chars").alias("chars"))
    rows = written(rows, "blocks")
    counts = rows.groupBy("host", "path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("linked"), F.sum("leads").alias("leads"), F.sum("chars").alias("chars"))
    counts = written(counts, "block-counts")
    sizes = bounded(written(rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts"))
    constant = (F.col("n") >= CONSTANT_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    constants = counts.where(F.col("n") >= CONSTANT_PAGES).join(sizes, "host").where(constant).groupBy("host").agg(F.collect_list("block").alias("constant"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    own = counts.join(sizes, "host").withColumn("chars", F.when(constant | (F.col("linked") == 1), 0).otherwise(F.col("chars")))
    slots = own.groupBy("host", "pages", "path").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), again.alias("again"), F.min("linked").alias("linked"), F.sum("leads").alias("leads"), F.sum("chars").alias("chars")
    )
    stale = (F.col("again") >= CONSTANT_SHARE * F.col("n")) & (F.col("n") >= STALE_RETURNS * F.col("texts")) & (F.col("leads") >= STALE_PAGES * F.col("pages"))
    # the path with most text that differs is content, however often its texts come back
    most = slots.groupBy("host").agg(F.max(F.struct("chars", "path")).alias("most"))
    slots = slots.join(bounded(most), "host").withColumn("stale", stale & ((F.col("path") != F.col("most.path")) | (F.col("chars") == 0)))
    slots = written(slots.select("host", "pages", "path", "linked", "stale", (2 * F.col("leads") >= F.col("pages")).alias("usual")), "slots")
    varying = F.when(F.col("usual") & ~F.col("stale") & (F.col("linked") == 0), F.col("path"))
    cores = slots.groupBy("host", "pages").agg(F.min(varying).alias("low"), F.max(varying).alias("high"))
    named = slots.where("stale").select("host", "path").mapInArrow(_named, "host string, digest long")
    stales = named.groupBy("host").agg(F.collect_list("digest").alias("stale"))
    known = cores.join(constants, "host", "left").join(stales, "host", "left")
    only = lambda c: F.when(F.col("low").isNotNull(), F.col(c)).alias(c)
    return written(known.select("host", "pages", "low", "high", only("constant"), only("stale")), "wrappers")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    wrappers = host_wrappers(pages).drop("pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    held = F.coalesce(F.size("constant"), F.lit(0)) * 8 + F.coalesce(F.size("stale"), F.lit(0)) * 8 + F.coalesce(F.octet_length("low") + F.octet_length("high"), F.lit(0))
    bytes_ = wrappers.agg(F.coalesce(F.sum(held.cast("long")), F.lit(0))).first()[0]
    known = bounded(wrappers) if bytes_ <= WRAPPER_BYTES else wrappers
    joined = _hosted(pages).join(known, "host", "left").select("page_id", "url", "html", "host", "low", "high", "constant", "stale")
    texts = joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
