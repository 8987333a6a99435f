"""Main text of web pages: a suffix array over each host's pages, guarded by markup.

A page is parsed into blocks. Blocks of running text (paragraphs, headings, list items, tables and the like) inside a part that the
page declares as its article are guarded: articles of a host share passages, and these stay. Everything else on the page, menus and
adverts included, is its token stream. The suffixes of all streams of a host are brought together by
their first ``long`` tokens, which is the order of a suffix array as deep as it matters. A run of ``long`` or more tokens that distinct pages of the host
share is boilerplate: what these runs cover is removed and the unique runs stay. Suffixes are counted before the
shuffle, so a host or a footer with a third of all pages makes no task large.

Menus that differ on each page repeat nowhere, so markup has a second say: blocks in elements that aren't part of an article (``nav``,
``footer``, classes such as ``ad`` or ``comments``) never are text. The words that are left decide which part is the page's root: its articles,
another declared part or all of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import col, map_arrow, shingles
from .url_filter import host_of

#: Tags as HTML reads them: a quote opens a value only behind an equals sign, and a value without its end quote ends like one without any.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
#: Names of layouts that mention a part without being it, such as has-sidebar.
_MENTION = re.compile(r"(?:has|with|no|without|is|js|not)[_-]")

#: Names of HTML elements and common class names.
_RAW = frozenset("script style textarea title iframe".split())
_SKIP = frozenset("nav footer aside form dialog menu fieldset search".split())
_SKIP_INLINE = frozenset("noscript template svg object canvas audio video select button datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_SPACING = frozenset("br td th img".split())
_ITEMS = frozenset("li dd dt td th".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var".split())
_NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments respond reply replies disqus share sharing social related recommended widget widgets pagination pager toolbar skip "
    "contentinfo complementary search".split()
)
_ANY = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards col column container content count entry feed form global group holder "
    "icons inline inner item items large left link links list main module outer page panel post posts primary reader readers region right row secondary section "
    "site slot small sticky stories story text thread to top unit user users view wrap wrapper zone".split()
)
_MAIN = frozenset("article post entry story articlebody main content".split())

#: Kinds of blocks: guarded running text of a declared part, other text, text that markup excludes.
GUARDED, OPEN, OUT = 0, 1, 2
Block = tuple[int, int, str]


def _names(said: str) -> bool:
    """Whether a class, id or role names a part that isn't main text: cookie-notice and ad-box do, related-work doesn't."""
    pieces = [x for x in re.split(r"[_-]+", said) if x and not x.isdigit()]
    return any(x in _NOT_MAIN for x in pieces) and all(x in _NOT_MAIN or x in _ANY for x in pieces)


class _Element:
    """An open element and what its content inherits; in_p: whether it stands in a paragraph; aside: in an element such as a button, which ends no block."""

    __slots__ = ("aside", "header", "in_p", "level", "name", "out", "running")

    def __init__(self, name: str, out: bool, level: int, header: bool, running: bool, in_p: bool, aside: bool):
        self.name, self.out, self.level, self.header, self.running, self.in_p, self.aside = name, out, level, header, running, in_p, aside


def page_blocks(page: str) -> list[Block]:
    """(level, kind, text) of each block: level 2 inside an article, 1 inside another declared part, 0 elsewhere."""
    top = _Element("", False, 0, False, False, False, False)
    stack: list[_Element] = []
    blocks: list[Block] = []
    parts: list[str] = []
    gone: list[str] = []
    here, heading, in_p, at, n = top, 0, False, 0, len(page)

    def flush() -> None:
        for own, out in ((parts, here.header and not heading), (gone, True)):  # what a header holds beside its headings is no text
            if own:
                if text := " ".join(unescape("".join(own)).split()):
                    guarded = here.level and (here.running or in_p or heading)
                    blocks.append((here.level, OUT if out else GUARDED if guarded else OPEN, text))
                own.clear()

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            (gone if here.out else parts).append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            to = len(stack)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    to = k
                    break
                if name in _INLINE and stack[k].name in _BLOCK:  # misplaced: it can't close what is around a block
                    break
            if here.aside and (to < len(stack) and not stack[to].aside or name == "p" and not in_p and here.in_p):
                while stack and stack[-1].aside:  # it has no end tag
                    in_p = stack.pop().in_p
                here = stack[-1] if stack else top
                to = min(to, len(stack))
            if name in _BLOCK and not here.aside:
                flush()
            if name in _HEADING:
                heading = max(0, heading - 1)
            if name == "p":
                in_p = False
            if to < len(stack):
                if name in _SKIP_INLINE:
                    in_p = stack[to].in_p
                del stack[to:]
                here = stack[-1] if stack else top
            continue
        if name in _RAW or name == "head":
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n if name != "head" else at
            continue
        if name in _BLOCK:
            if not here.aside:
                flush()
            in_p = name == "p"
        if stack and (stack[-1].name == "p" and name in _BLOCK or name in _ITEMS and stack[-1].name in _ITEMS):  # no end tag
            stack.pop()
            here = stack[-1] if stack else top
        if name in _SPACING:
            (gone if here.out else parts).append(" ")
        if name in _HEADING:
            heading += 1
        if name in _VOID or (name in _INLINE or name == "p") and not m[3] or name in _SKIP_INLINE and m[0].endswith("/>"):
            continue
        out, level, header, said = name in _SKIP or name in _SKIP_INLINE or name == "header" and not here.level, here.level, here.header, set()
        header = header or name == "header" and level > 0
        for x in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
            key, value = x[1].lower(), (x[2] or x[3] or x[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                out = True
            elif key in ("class", "id", "role", "itemprop"):
                said.update(t for t in value.split() if not _MENTION.match(t))
        if name not in _HEADING and name not in _INLINE and name not in ("body", "html", "main"):
            for t in filter(_names, said):
                if level and {"header", "masthead"} & set(re.split(r"[_-]+", t)):
                    header = True
                else:
                    out = True
        if not out and name == "article":
            level = 2
        elif not out and level < 1 and (name == "main" or said & {"main", "articlebody"} or name in ("div", "section") and any(_MAIN & set(re.split(r"[_-]+", t)) for t in said)):
            level = 1
        stack.append(_Element(name, here.out or out, level, header, here.running or name in _RUNNING, in_p, here.aside or name in _SKIP_INLINE))
        here = stack[-1]
        if name in _SKIP_INLINE:
            in_p = False
    if at < n:
        (gone if here.out else parts).append(page[at:])
    flush()
    return blocks


def packed_blocks(blocks: list[Block]) -> bytes:
    """The blocks in few bytes. A block's text has no line ends, as all white space in it is single spaces."""
    return zlib.compress("\n".join(f"{level}{kind}{text}" for level, kind, text in blocks).encode("utf-8", "surrogatepass"), 6)


def unpacked_blocks(data: bytes) -> list[Block]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(int(x[0]), int(x[1]), x[2:]) for x in text.split("\n")] if text else []


def stream_of(blocks: list[Block]) -> list[str]:
    """The texts of the page's token stream: all that isn't guarded."""
    return [text for _, kind, text in blocks if kind != GUARDED]


def _stream(texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token hashes of all texts, a border before and after each; and each token's (text, word), word -1 for a border."""
    tokens, places = [1], [(0, -1)]
    for b, text in enumerate(texts):
        for w, word in enumerate(text.split(" ")):
            tokens.append(xxhash.xxh3_64_intdigest(word))
            places.append((b, w))
        tokens.append(1)
        places.append((b, -1))
    return np.array(tokens, dtype=np.uint64), places


def unique_runs(texts: list[str], repeated: set[int] | frozenset[int], long: int) -> list[str]:
    """The texts without what runs of ``long`` tokens at the repeated starts cover; empty where nothing is left.

    Of a block's words a covered run goes if it is all of the block or ``long`` words: a run that starts in a neighbouring
    block may end a few words into this one by chance.
    """
    if not repeated:
        return texts
    _, places = _stream(texts)
    covered = {places[p] for start in repeated for p in range(start, min(len(places), start + long))}
    out = []
    for b, text in enumerate(texts):
        kept: list[str] = []
        for hit, run in groupby(enumerate(text.split(" ")), key=lambda x: (b, x[0]) in covered):
            own = [word for _, word in run]
            if not hit or len(own) < min(long, text.count(" ") + 1):
                kept += own
        out.append(" ".join(kept))
    return out


def article_of(blocks: list[Block], repeated: set[int] | frozenset[int], long: int) -> list[str]:
    """The page's main text, block by block, once its repeated runs are known.

    The articles are its root unless another declared part holds over three times their words, and declared parts unless the page holds over
    ten times theirs. A page of which nothing is left keeps what markup doesn't exclude.
    """

    def rooted(left: list[str]) -> list[str]:
        kept = [(level, text) for (level, kind, _), text in zip(blocks, left, strict=True) if kind != OUT and text]
        words = [sum(text.count(" ") + 1 for level, text in kept if level >= least) for least in (0, 1, 2)]
        root = 1 if words[1] * 10 >= words[0] and words[1] else 0
        root = 2 if root and words[2] * 3 >= words[1] and words[2] else root
        return [text for level, text in kept if level >= root]

    own = iter(unique_runs(stream_of(blocks), repeated, long))
    return rooted([text if kind == GUARDED else next(own) for _, kind, text in blocks]) or rooted([text for *_, text in blocks])


def _mapped(src: DataFrame, schema: T.StructType, row: Callable[[dict], list[tuple]]) -> DataFrame:
    names, arrow = src.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for values in zip(*[b.column(c).to_pylist() for c in names], strict=True) for x in row(dict(zip(names, values, strict=True)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return map_arrow(src, run, schema)


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", long: int = 6) -> DataFrame:
    """page_id, url, text, n_chars for each page. text joins the blocks by an empty line; it is empty for null or empty html.

    Pages with the same html are one page for what is repeated, so a copy removes nothing. Rows are never merged: a row
    that occurs twice gives two rows. Pages without a URL form a host of their own. Html counts whole, however long, and is parsed in one pass;
    an empty table gives no rows, and other columns play no part, whatever their names.
    """
    src = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), F.coalesce(col(html).cast("string"), F.lit("")).alias("html"))
    src = src.withColumns({"host": F.xxhash64(F.coalesce(host_of(F.col("url")), F.lit(""))), "key": F.unhex(F.md5("html"))})

    def streams(r: dict) -> list[tuple]:
        texts = stream_of(page_blocks(r["html"]))
        return [(r["host"], r["key"], texts)] if texts else []

    def suffixes(r: dict) -> list[tuple]:
        found = shingles(_stream(r["texts"])[0], long).view(np.int64)
        first = np.unique(found, return_index=True)[1]  # a run that a page repeats itself is brought once
        return [(r["host"], r["key"], int(found[i])) for i in first]

    def parsed(r: dict) -> list[tuple]:
        return [(r["page_id"], r["url"], r["host"], r["key"], packed_blocks(page_blocks(r["html"])))]

    def marked(r: dict) -> list[tuple]:
        blocks, runs = unpacked_blocks(r["blocks"]), set(r["runs"] or ())
        found = shingles(_stream(stream_of(blocks))[0], long).view(np.int64).tolist() if runs else []
        repeated = {i for i, h in enumerate(found) if h in runs}
        return [(r["page_id"], r["url"], "\n\n".join(article_of(blocks, repeated, long)))]

    page = _mapped(src.select("host", "key", "html"), T._parse_datatype_string("host bigint, key binary, texts array<string>"), streams)
    one = page.groupBy("host", "key").agg(F.first("texts").alias("texts"))
    suffix = _mapped(one, T._parse_datatype_string("host bigint, key binary, h bigint"), suffixes)
    # a page brings a run once and no two rows are of one page, so a count tells whether pages share it
    shared = suffix.groupBy("host", "h").agg(F.count("*").alias("n")).where("n > 1").select("host", "h")
    runs = suffix.join(shared, ["host", "h"]).groupBy("host", "key").agg(F.collect_list("h").alias("runs"))
    # pages meet their runs as packed blocks, which are a fraction of their html
    key = [T.StructField("host", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("blocks", T.BinaryType())]
    blocks = _mapped(src, T.StructType([src.schema["page_id"], src.schema["url"], *key]), parsed)
    told = blocks.join(runs.hint("merge"), ["host", "key"], "left").select("page_id", "url", "blocks", "runs")
    out = _mapped(told, T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType())]), marked)
    return out.withColumn("n_chars", F.length("text").cast("long"))
