"""HTML main text by site style trees."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, forget

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: Elements by what they do.
RAW = "script style textarea title template noscript iframe svg math object canvas audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var td th ruby rt rp".split())
DROPPED = set("head nav footer aside form button select fieldset dialog menu".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that shape text: in an article or main element they part no branch from it.
TEXT = INLINE | set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th".split())
#: Words of class, id and role that mark boilerplate: whole, or as a beginning.
MARKS = set("ad ads adbox adslot adv side foot masthead modal overlay popup toast alert widget byline login signup search share sharing social related reply replies links copyright skip hidden gdpr paywall outbrain taboola pager toolbar topbar rail complementary contentinfo navigation feedback respond votes".split())
MARK_STARTS = tuple("advert sponsor promo banner cookie consent notice notif newsletter subscri sidebar menu navbar navig breadcrumb footer header comment disqus discussion recommend pagination disclaimer dropdown".split())
#: Of these, names that tell of the content itself; others may only tell of a page's layout.
STRONG = set("ad ads adbox adslot adv related recommend reply replies respond feedback share sharing social outbrain taboola".split())
STRONG_STARTS = tuple("advert sponsor promo comment disqus discussion cookie consent newsletter subscri".split())
#: Words before a name that say that something else has it, or nothing.
NOT_OWN = set("has with no without not hide show is".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|<[!?/][^>]*>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


@dataclass
class Block:
    """A run of text between block boundaries. path: the styles of the elements that hold it, outermost first."""

    path: tuple[str, ...]
    marked: bool
    inside: bool
    text: str
    linked: float


class _Open:
    __slots__ = ("mark", "style", "tag")

    def __init__(self, tag: str, style: str, mark: int):
        self.tag, self.style, self.mark = tag, style, mark


def _style(tag: str, attrs: str) -> tuple[str, int]:
    """The element's look: tag, class and id without digits; and whether a name marks boilerplate: 2 surely, 1 unless an article is inside, 0 not."""
    if not attrs or attrs.isspace():
        return tag, 0
    names, mark = [], 0
    for m in _NAMED.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden":
            mark = 2 if key == "hidden" or value.lower() == "true" else mark
            continue
        names.append(re.sub(r"\d+", "", f"{'#' if key == 'id' else '.'}{'.'.join(value.split())}"))
        for name in value.split():
            parts = [x.lower() for x in _PART.findall(name)]
            for before, p in zip(["", *parts], parts, strict=False):
                if before not in NOT_OWN and (p in MARKS or p.startswith(MARK_STARTS)):
                    mark = max(mark, 2 if p in STRONG or p.startswith(STRONG_STARTS) else 1)
    return tag + "".join(names), mark


def _marked(stack: list[_Open]) -> bool:
    """Whether a mark holds for what the innermost element has: weak ones don't reach into an article or main element."""
    inner = next((i for i, o in enumerate(stack) if o.tag in ("article", "main")), 0)
    return any(o.mark > (1 if i < inner else 0) for i, o in enumerate(stack))


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, read leniently: end tags may be missing, wrong or crossed."""
    out: list[Block] = []
    stack: list[_Open] = []
    words: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            tags = {o.tag for o in stack}
            out.append(Block(tuple(o.style for o in stack if o.tag not in INLINE or o.style != o.tag), _marked(stack), "article" in tags or "main" in tags, text, links / sum(map(len, words))))
        words.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            words.append(text)
            if any(o.tag == "a" for o in stack):
                links += len(text)

    def close(at: int) -> None:
        if any(o.tag not in INLINE for o in stack[at:]):
            flush()
        elif any(o.mark for o in stack[at:]):
            flush()
        del stack[at:]

    page = page or ""
    last = 0
    for m in _TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag == "br" or tag == "p" and not any(o.tag == "p" for o in stack):
                add(" ") if tag == "br" else flush()
                continue
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None and (tag not in INLINE or all(o.tag in INLINE for o in stack[at:])):
                close(at)
            if tag in ("td", "th"):
                add(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else add(" ") if tag == "br" else None
            continue
        if tag in ENDS_P:
            _implied(stack, close, ("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "button"))
        if tag == "li":
            _implied(stack, close, ("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            _implied(stack, close, ("dt", "dd"), ("dl",))
        elif tag == "tr":
            _implied(stack, close, ("tr",), ("table",))
        elif tag == "option":
            _implied(stack, close, ("option",), ("select",))
        elif tag == "body":
            _implied(stack, close, ("head",), ())
        style, mark = _style(tag, m[4])
        if tag in ("html", "body"):
            mark = 0
        elif tag in ("article", "main", "h1"):
            mark = mark if mark == 2 else 0
        elif tag == "form":
            mark = max(mark, 1)
        elif tag in DROPPED or tag == "header" and not any(o.tag in ("article", "main") for o in stack):
            mark = 2
        if tag not in INLINE or mark:
            flush()
        if tag in ("td", "th"):
            add(" ")
        if not m[4].rstrip().endswith("/") or tag not in ("svg", "path", "div", "span", "p"):
            stack.append(_Open(tag, style, mark))
    add(page[last:])
    flush()
    return out


def _implied(stack: list[_Open], close, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in tags:
            close(i)
            return
        if stack[i].tag in within:
            return


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


#: What a path holds, where it isn't the hash of a text: most of a page's text, be it a few words or an article's length.
MAIN, LONG_MAIN, ARTICLE = -1, -2, 200


def _main_path(found: list[Block]) -> tuple[str, int] | None:
    """The path that holds half of the page's text and more, menus left aside; none if there is no such path."""
    sizes: dict[str, int] = {}
    for b in found:
        if not b.marked and (b.inside or b.linked < 0.8):
            path = " > ".join(b.path)
            sizes[path] = sizes.get(path, 0) + len(b.text)
    path = max(sizes, key=lambda p: sizes[p], default=None)
    if path is None or 2 * sizes[path] < sum(sizes.values()):
        return None
    return path, LONG_MAIN if sizes[path] >= ARTICLE else MAIN


def _styles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page (key, url, html) the distinct (host, path, what, page): hashes of the texts at each style path, 0 once for the path itself, and MAIN or LONG_MAIN for the path that holds most of the page."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            part, rows = batch[i : i + 256], []
            for key, url, page in zip(part["key"], part["url"], part["html"], strict=True):
                found = blocks(page)
                own = xxh3_64_intdigest("\n".join(b.text for b in found)) >> 1
                seen = {(" > ".join(b.path), xxh3_64_intdigest(b.text) | 1) for b in found}
                rows += [(key, _host(url), p, (h >> 1) + 1, own) for p, h in sorted(seen)] + [(key, _host(url), p, 0, own) for p in sorted({p for p, _ in seen})]
                if main := _main_path(found):
                    rows.append((key, _host(url), *main, own))
            yield pd.DataFrame(rows, columns=["key", "host", "path", "what", "page"])


def _held(pages: DataFrame) -> DataFrame:
    """(key, host, path, what, page) of pages with a key each."""
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), "url", "html")
    return cut(keyed.mapInPandas(_styles, "key long, host string, path string, what long, page long"), "html")


def _trees(held: DataFrame) -> DataFrame:
    counts = held.where("what >= 0").select("host", "path", "what", "page").distinct().groupBy("host", "path", "what").agg(F.count("*").alias("c"))
    text = F.col("what") > 0
    sums = counts.groupBy("host", "path").agg(F.max(F.when(~text, F.col("c"))).alias("pages"), F.sum(F.when(text, F.col("c"))).alias("total"), F.sum(F.when(text, F.col("c") * F.log("c"))).alias("s"))
    return sums.select("host", "path", "pages", F.exp(F.col("s") / F.col("total")).alias("recurs"), F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("total") * F.log("pages"))).otherwise(1.0).alias("importance"))


def site_trees(pages: DataFrame) -> DataFrame:
    """(host, path, pages, recurs, importance): the merged style tree of each host.

    A node is a path of styles that holds text on so many pages. Its importance is one less the mean, over all texts there, of log c / log pages: c
    pages hold the same text there. What all pages share has 0, what differs on each has 1;
    with one page nothing is known and it is 1. recurs: the geometric mean of c, so pages over the effective number of texts there. Pages of a host with the same text count once, as a copy doesn't tell what its site repeats.
    Counts are pre-aggregated, so a host with most pages is no hot spot.
    """
    return _trees(_held(pages))


def _unimportant(held: DataFrame, least: float, min_pages: int, recurring: float, most: float, main: float) -> DataFrame:
    """(host, path) of what sites repeat: see extracted()."""
    tree = _trees(held)
    few = (F.col("importance") < least) & (F.col("recurs") >= F.least(F.lit(recurring), most * F.col("pages")))
    seen = held.groupBy("host").agg(F.countDistinct("page").alias("all"))
    mains = held.where("what < 0").groupBy("host", "path").agg(F.countDistinct("page").alias("n"), F.countDistinct(F.when(F.col("what") == LONG_MAIN, F.col("page"))).alias("long")).join(seen, "host")
    spared = mains.select("host", "path", (F.col("n") >= main * F.col("all")).alias("is_main"), (F.col("long") >= main * F.col("all")).alias("is_long"))
    low = tree.where((F.col("pages") >= min_pages) & few).join(spared, ["host", "path"], "left")
    universal = F.col("recurs") >= 0.9 * F.col("pages")
    return low.where(~(F.coalesce("is_long", F.lit(False)) | F.coalesce("is_main", F.lit(False)) & ~universal)).select("host", "path")


def _direct(path: tuple[str, ...]) -> bool:
    """Whether an article or main element holds what is at the path with nothing but text elements between them."""
    tags = (re.split(r"[.#]", style, maxsplit=1)[0] for style in reversed(path))
    return next((t for t in tags if t not in TEXT), "") in ("article", "main")


def main_text(page: str | None, low: frozenset[str] | set[str], marks: bool = True) -> str:
    """Blocks of the page, but for those at a path of low importance, those that names mark (if marks), and lists of links outside an article.

    Text is judged at its own path alone: so a branch goes as a whole only if all paths in it that hold text are low."""
    kept = []
    for b in blocks(page):
        if marks and b.marked or not b.inside and b.linked >= 0.8:
            continue
        if low and " > ".join(b.path) in low and not _direct(b.path):
            continue
        kept.append(b.text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame, least: float = 0.9, min_pages: int = 2, recurring: float = 5.0, most: float = 0.8, main: float = 0.25, list_bytes: int = 32 << 20) -> DataFrame:
    """pages' rows as (page_id, url, text): the main text, empty if none.

    Style trees of all pages are merged by host. A path on min_pages or more is unimportant if its importance is below `least` and its texts recur, on (geometric) average,
    on `recurring` pages or on a share `most` of the pages that have it: few texts on many pages. Texts that differ from page to page but for a second or third view of
    each are content. A path that holds half of the text and more on a share `main` of a host's pages is what the site is for, and is spared, unless that text is the same on all of them and
    shorter than an article. Each page loses its branches that hold nothing else. A branch goes only if all
    in it is unimportant, so the nodes that hold text settle what goes and inner nodes need no importance of their own. Elements and names that
    can only be boilerplate (menus, forms, adverts, comments) count as unimportant on any number of pages: a tree can't tell them on hosts of few
    pages, nor where they differ from page to page as readers' comments do. What an article or main element holds directly, be it in
    paragraphs, headings, lists or tables, is never judged by one host's copies: only branches beside or below it are. Text that many pages share
    directly under an element says nothing of the elements beside it.

    Unimportant paths are collected and sent to all tasks once if they are of less than list_bytes; else each page is joined with its own.

    Null html is empty. A null url, or one without `://`, belongs to the site without a name. Repeated pages stay; in the
    trees pages of one text count once. Pages of any length are read whole. Other columns are ignored, whatever their names. Empty table: empty result.
    """
    own = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    held = _held(pages)
    low = cut(_unimportant(held, least, min_pages, recurring, most, main), "html")
    size = low.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size < list_bytes:
        lists: dict[str, set[str]] = {}
        for r in low.toLocalIterator():
            lists.setdefault(r["host"], set()).add(r["path"])
        shared = pages.sparkSession.sparkContext.broadcast(lists)
        forget(held)
        forget(low)

        @F.pandas_udf("string")
        def of_host(html: pd.Series, url: pd.Series) -> pd.Series:
            return pd.Series([main_text(h, shared.value.get(_host(u), frozenset())) for h, u in zip(html, url, strict=True)], dtype=object)

        return own.select("page_id", "url", of_host("html", "url").alias("text"))

    @F.pandas_udf("string")
    def of_page(html: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset() if x is None else frozenset(x)) for h, x in zip(html, low, strict=True)], dtype=object)

    mine = held.where("what = 0").select("key", "host", "path").distinct().join(low, ["host", "path"], "left_semi")
    joined = own.join(mine.groupBy("key").agg(F.collect_list("path").alias("low")), "key", "left")
    return joined.select("page_id", "url", of_page("html", "low").alias("text"))
