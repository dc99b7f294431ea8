"""Main text of web pages by site template removal.

Pages are read into elements; every block element's subtree is hashed from its tag, its class, its text and its children's
hashes. Spark counts, for each host, on how many of its distinct pages a subtree occurs; those on at least ``share`` of the host's
pages or on ``many`` pages (and on ``least`` pages) are the site's template and are deleted, along with what markup itself names as
no article: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments.

Two tests tell a template from prose that recurs. A site's template is the site's: a subtree counts only if it is ``lift`` times as
frequent on the host as on all other pages, or is short, outside any article and on half of the host's pages (a widget that
many sites share). And of what stands inside ``<article>`` or ``<main>``, or a container named so, of paragraphs, and of
what is on less than ``share`` of the pages, only occurrences count on pages whose recurring text is the lesser part of their article
(or of the page, if it marks none): a share bar or a section's menu goes, and the prose of copied articles, which is
nearly all of theirs, stays. An article silences what stands outside it, unless the paragraphs outside are more text than it
holds (a teaser); where a page marks none, all that is left of the body is its text, and a page that would lose everything to
its template keeps what the markup rules leave.

A page is joined with those of its own subtrees that are template, so its list is no longer than the page.

Nulls and other cases: a null html is empty (text empty, 0 characters); a null url has an empty host, whose pages share no
template; null page_ids and repeated rows are kept; an empty table gives no rows; further columns of the input are ignored.
Unclosed and stray tags, unended comments and scripts are read as browsers do, as far as text is concerned; no page is cut.
Reading takes time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, small
from .tokens import slices
from .urls import LOWER, UPPER

#: A tag (slash, name, attributes, its end unless the page ends in it), a comment, or what browsers read as one. Quantifiers are
#: possessive and each alternative takes all that it starts, so that reading is linear in the page whatever is in it.
_MARKUP = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(>?)"""
    r"""|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_LONG_NUMBER = re.compile(r"&#(?:0{9,}|[0-9]{9,})([0-9]*)")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_TOKENS = re.compile(r"[a-z]+")
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead"
    " tr ul".split()
)
#: Parts of a row or line: apart, but in one block.
SPACED = frozenset("br td th option wbr".split()) - {"wbr"}
MAIN = frozenset({"article", "main"})
FRAMES = MAIN | {"html", "body"}
#: What is no article by its tag.
DROPPED_TAGS = RAW | frozenset(
    "head nav header footer aside form menu dialog noscript template button select svg math canvas audio video object search"
    " datalist fieldset".split()
)
#: What is no article by a word of its class, id or role.
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment"
    " comments commentlist discussion disqus respond replies share sharing social related recommended newsletter subscribe signup"
    " popup modal overlay widget login search pagination pager skip complementary contentinfo toolbar responses feedback".split()
)
#: Of those, what a paragraph itself is dropped for.
DROPPED_PARAGRAPHS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices comment comments".split()
)
#: Headings and marked words stay, whatever they are called.
KEPT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 b i em strong a".split())
CONTAINERS = frozenset("div section td".split())
#: Names of containers that hold the article where no element says so.
CONTENT_NAMES = frozenset("article story post entry content main".split())
#: Characters of a block that is a paragraph of prose, not a label or a line of a menu.
PARAGRAPH = 80
#: A start tag of these ends an open paragraph; of the same kind, an open item, row or cell.
_ENDS_P = BLOCKS - {"caption", "tbody", "tfoot", "thead", "tr", "head", "html", "body", "legend"}
_ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_RAW_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}
_STOPS_P = {"button", "td", "th", "table"}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


def plain(raw: str) -> str:
    """Character references decoded, runs of white space one blank each."""
    if "&" in raw:
        if "&#" in raw:  # Python refuses integers of thousands of digits; none that long is a character, zeros apart
            raw = _LONG_NUMBER.sub(lambda m: "&#" + (m[0][2:].lstrip("0")[:9] or "0"), raw)
        raw = html.unescape(raw)
    return " ".join(raw.split())


class _Element:
    """An open element: what it makes of its text, and the block (itself, if it is one) whose hash its content goes into."""

    __slots__ = ("dropped", "first", "inside", "mute", "number", "parts", "tag")

    def __init__(self, tag: str, dropped: bool, inside: int, mute: bool, first: int, number: int, parts: list[str] | None):
        self.tag, self.dropped, self.inside, self.mute = tag, dropped, inside, mute
        self.first, self.number, self.parts = first, number, parts


class Page:
    """A page as blocks of text in page order, and block subtrees with their hashes and the blocks they span."""

    def __init__(self, source: str | None, hashed: bool = True):
        self.blocks: list[str] = []
        self.flags: list[tuple[bool, int]] = []  # of each block: in dropped markup; in an article (2: by its element, 1: by name)
        self.subtrees: list[tuple[int, int, int, bool, bool, int]] = []  # hash, first block, block after the last, may be deleted, in an article, number
        self.owners: list[int] = []  # of each block: the number of the innermost block element around it, or -1
        self._hashed = hashed
        self._open: list[_Element] = []
        self._where: dict[str, list[int]] = {}  # of each tag: where it is among the open elements
        self._text: list[str] = []
        self._numbers = 0
        self._read(source or "")

    def _say(self, text: str) -> None:
        if not (self._open and self._open[-1].mute):
            self._text.append(text)

    def _flush(self) -> None:
        if self._text:
            text = plain("".join(self._text))
            self._text.clear()
            if text:
                top = self._open[-1] if self._open else None
                self.blocks.append(text)
                self.flags.append((top.dropped, top.inside) if top else (False, 0))
                self.owners.append(top.number if top else -1)
                if self._hashed and top and top.parts is not None:
                    top.parts.append(text)

    def _close(self) -> None:
        top = self._open[-1]
        if top.tag in BLOCKS:
            self._flush()
        self._open.pop()
        self._where[top.tag].pop()
        if self._hashed and top.tag in BLOCKS and len(self.blocks) > top.first:
            from xxhash import xxh64_intdigest

            value = xxh64_intdigest("\x00".join(top.parts).encode("utf-8", "surrogatepass"))
            value -= (value >> 63) << 64  # as a signed long
            self.subtrees.append((value, top.first, len(self.blocks), top.tag not in FRAMES, bool(top.inside) and not top.dropped, top.number))
            if self._open and self._open[-1].parts is not None:
                self._open[-1].parts.append(str(value))

    def _end(self, tag: str) -> None:
        while self._open[-1].tag != tag:
            self._close()
        self._close()

    def _reachable(self, tag: str, stops: set[str]) -> bool:
        """Whether ``tag`` is open, and none of ``stops`` was opened after it."""
        own = self._where.get(tag)
        return bool(own) and all(not (x := self._where.get(stop)) or x[-1] < own[-1] for stop in stops)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P and self._reachable("p", _STOPS_P):
            self._end("p")
        for own in _ENDS_OWN.get(tag, ()):
            if self._reachable(own, _STOPS[tag]):
                self._end(own)
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self._text.append(" ")
        if tag in VOID:
            return
        top = self._open[-1] if self._open else None
        before, inside, mute = (top.dropped, top.inside, top.mute) if top else (False, 0, False)
        dropped = before
        names = ""
        if attributes and not attributes.isspace():
            names = " ".join(_NAMED.findall(attributes)).lower()
        words = set(_TOKENS.findall(names)) if names else frozenset()
        named = not DROPPED_NAMES.isdisjoint(words)
        if not dropped:
            if tag == "header":
                dropped = named or not inside  # an article's own header holds its heading
            elif tag in FRAMES:
                dropped = tag == "article" and not {"comment", "comments"}.isdisjoint(words)
            elif tag == "p":
                dropped = not DROPPED_PARAGRAPHS.isdisjoint(words)
            elif tag in DROPPED_TAGS:
                dropped = True
            elif tag not in KEPT_TAGS:
                dropped = named or ("header" in words and not inside)
        if tag in MAIN or words == {"main"}:
            inside = 2
        elif tag in CONTAINERS and not CONTENT_NAMES.isdisjoint(words):
            inside = max(inside, 1)
        block = tag in BLOCKS
        number, parts = top.number if top else -1, top.parts if top else None
        if block:
            number, parts = self._numbers, [tag + " " + names]
            self._numbers += 1
        elif self._hashed and parts is not None:
            parts.append(tag + " " + names)
        mute = mute or (dropped and not before and not block)
        self._where.setdefault(tag, []).append(len(self._open))
        self._open.append(_Element(tag, dropped, inside, mute, len(self.blocks), number, parts))

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _MARKUP.search(source, at)
            if not found:
                self._say(source[at:])
                break
            if found.start() > at:
                self._say(source[at : found.start()])
            at = found.end()
            closing, tag, attributes, ended = found.groups()
            if tag is None:
                continue
            if not ended:
                break  # a tag that never ends is no text
            tag = tag.lower()
            if closing:
                if tag in BLOCKS:
                    self._flush()
                if self._where.get(tag):
                    self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                stop = _RAW_ENDS[tag].search(source, at)
                at = stop.start() if stop else end
        while self._open:
            self._close()
        self._flush()

    def hashes(self) -> dict[int, tuple[int, bool]]:
        """Of each block subtree that markup doesn't drop, by its hash: characters of prose directly in it; in an article or not.

        Where a page has an article, only that is prose.
        """
        marked = any(inside and not dropped for dropped, inside in self.flags)
        own = np.zeros(self._numbers + 1, dtype=np.int64)  # the last: blocks in no element
        prose = [0 if dropped or (marked and not inside) else len(b) for b, (dropped, inside) in zip(self.blocks, self.flags, strict=True)]
        np.add.at(own, np.array(self.owners, dtype=np.int64), np.array(prose, dtype=np.int64))
        left = np.concatenate(([0], np.cumsum([not dropped for dropped, _ in self.flags]))).tolist()
        found, own = {}, own.tolist()
        for key, first, after, may, inside, number in self.subtrees:
            if (may or own[number]) and left[after] > left[first]:
                n, within = found.get(key, (0, False))
                found[key] = n + own[number], within or inside
        return found

    def _kept(self, gone: list[bool]) -> list[bool]:
        """The blocks that neither markup nor ``gone`` drops, of the containers that hold most of the prose."""
        left = [not dropped and not x for (dropped, _), x in zip(self.flags, gone, strict=True)]
        levels = sorted({inside for (_, inside), x in zip(self.flags, left, strict=True) if x}, reverse=True)
        for level in levels:
            within = sum(len(b) for b, (_, i), x in zip(self.blocks, self.flags, left, strict=True) if x and i >= level)
            outside = sum(len(b) for b, (_, i), x in zip(self.blocks, self.flags, left, strict=True) if x and i < level and len(b) >= PARAGRAPH)
            if outside <= within:
                return [x and i >= level for (_, i), x in zip(self.flags, left, strict=True)]
        return left

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """What is left without the template's subtrees and without dropped markup."""
        gone = [False] * len(self.blocks)
        if template:
            change = np.zeros(len(self.blocks) + 1, dtype=np.int64)
            for key, first, after, may, _, _ in self.subtrees:
                if may and key in template:
                    change[first] += 1
                    change[after] -= 1
            gone = (np.cumsum(change[:-1]) > 0).tolist()
        kept = self._kept(gone)
        if not any(kept):
            kept = self._kept([False] * len(self.blocks))
        return "\n".join(b for b, k in zip(self.blocks, kept, strict=True) if k)


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def templates(pages: DataFrame, share: float = 0.2, least: int = 5, many: int = 50, lift: float = 10.0) -> DataFrame:
    """host, page (a hash of the html) and the hashes of its subtrees that are the host's template, of pages that have any."""
    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [Page(x).hashes() for x in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                flat = [(h, n, inside) for x in found for h, (n, inside) in x.items()]
                own = [pa.array([x[k] for x in flat], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
                columns = [part.column(0).take(at), part.column(1).take(at), *own]
                yield pa.record_batch(columns, names=["host", "page", "hash", "chars", "inside"])

    named = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").filter("host <> ''")
    found = named.mapInArrow(run, "host string, page long, hash long, chars long, inside boolean")
    found = durable(found.distinct(), "subtrees")  # copies of a page count once
    sizes = durable(named.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")), "sizes")
    everywhere = sizes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    sizes = sizes.filter(F.col("pages") >= least)
    enough = (F.col("n") >= least) & ((F.col("n") >= share * F.col("pages")) | (F.col("n") >= many))
    often = found.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside"), F.max("chars").alias("chars"))
    often = often.filter(F.col("n") >= least).join(small(sizes), "host").filter(enough)
    rare = F.col("n") < share * F.col("pages")
    doubtful = F.col("inside") | rare | (F.col("chars") >= PARAGRAPH)
    often = durable(often.select("host", "hash", "n", "pages", doubtful.alias("doubtful"), rare.alias("rare")), "often")
    # What other hosts' pages have as well is the corpus's, not the site's.
    total = found.join(small(often.select("hash").distinct()), "hash").groupBy("hash").agg(F.count("*").alias("total"))
    elsewhere = (F.col("total") - F.col("n")) * F.col("pages")
    own = F.col("n") * (F.lit(everywhere) - F.col("pages")) >= lift * elsewhere
    sites = often.join(small(durable(total, "totals")), "hash").filter(own | (~F.col("doubtful") & (2 * F.col("n") >= F.col("pages"))))
    # Pages that are mostly their own tell template from copied prose.
    again = small(often.select("host", "hash", F.lit(True).alias("again")))
    mixed = found.filter("chars > 0").join(again, ["host", "hash"], "left").groupBy("host", "page")
    mixed = mixed.agg(F.sum("chars").alias("all"), F.coalesce(F.sum(F.when(F.col("again"), F.col("chars"))), F.lit(0)).alias("same"))
    copied = mixed.filter("2 * same >= all").select("host", "page")
    doubtful = small(sites.filter("doubtful").select("host", "hash", "pages", "rare"))
    held = found.join(doubtful, ["host", "hash"])
    sure = held.filter(f"not (inside or rare or chars >= {PARAGRAPH})")
    held = held.filter(f"inside or rare or chars >= {PARAGRAPH}").join(copied, ["host", "page"], "left_anti").select("host", "hash", "pages")
    held = held.union(sure.select("host", "hash", "pages")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("pages").alias("pages"))
    told = sites.filter("not doubtful").select("host", "hash").union(held.filter(enough).select("host", "hash"))
    told = small(durable(told, "told"))
    return found.join(told, ["host", "hash"]).groupBy("host", "page").agg(F.sort_array(F.collect_list("hash")).alias("template"))


def extract(pages: DataFrame, share: float = 0.2, least: int = 5, many: int = 50, lift: float = 10.0) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    bound_batches(pages.sparkSession)
    found = durable(templates(pages, share, least, many, lift), "templates")
    told, hashes = found.agg(F.count("*"), F.coalesce(F.sum(F.size("template")), F.lit(0))).first()
    if told <= 20_000 and hashes <= 200_000:  # else Spark joins by shuffle and splits hot pages
        found = F.broadcast(found)

    def run(batches):
        known: tuple[list[int] | None, set[int]] = (None, set())
        for batch in batches:
            for part in slices(batch):
                texts = []
                for source, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if template != known[0]:
                        known = template, set(template or ())
                    texts.append(Page(source, hashed=bool(template)).text(known[1]))
                sizes = pa.array([len(x) for x in texts], type=pa.int64())
                texts = pa.array([x.encode("utf-8", "replace").decode() for x in texts], type=pa.string())
                yield pa.record_batch([part.column(0), part.column(1), texts, sizes], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    joined = own.join(found, ["host", "page"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
