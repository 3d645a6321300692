"""Main text of web pages: what a page marks as its article, without what its host repeats.

A small reader turns html into blocks of text, each in one of four regions: the article, chrome
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role, class or
id), and the plain rest. Markup names the candidates: the article without chrome, or, of a page
that marks none, all plain blocks. Repeats decide which of their tokens stay, on every page: a run of
``SPAN`` tokens or more is boilerplate if more than half of the different page contents of its host hold it, in
any region, and at least ``SEVERAL`` of them (``FEW``, on pages that mark no article). So a passage that some articles share
stays, however many pages the table holds.

1. The different contents of every host are counted.
2. They are dealt into groups of about ``GROUP`` to twice as many, each content once. What more than half of all hold, more than half of
   some group hold. The token streams of a group are concatenated and put in suffix order (``suffixes``: linear
   grouping); neighbours with ``SPAN`` equal tokens in more than half of its pages, and in a candidate block of one, are
   candidates. A group is bounded, so a host with a third of all pages is many of them.
3. Candidates, if there are any, are counted over all contents. A bitmap of fixed size says which windows need to be counted.
4. Maximal covered runs are cut out of the pages that hold any; outside articles, blocks that are nearly all covered go whole.

Pages are read anew for each of these, as their text is nearly all of them: written or shuffled twice it would need more room.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from vitaframe.llm.common import written
from vitaframe.llm.suffixes import suffix_orders
from vitaframe.llm.urls import host_of

#: Tokens of a long substring.
SPAN = 8
#: Different contents that hold a run at least, in articles and on pages that mark none.
SEVERAL, FEW = 3, 2
#: Contents of a host whose token streams are concatenated.
GROUP = 16
#: Tokens that are put in order together.
BATCH = 1 << 18
#: A block outside articles goes whole if at least this share of its tokens is repeated.
COVERED = 0.9
#: Bits of the broadcast marks that tell which windows may be repeated.
MARKS = 1 << 24
_FACTORS = np.random.default_rng(8).integers(1 << 62, 1 << 63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_SILENT = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select", "object", "canvas", "math", "audio", "video", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CHROME_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button", "search", "head"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CHROME_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar sidenav widget widgets ad ads advert adverts advertisement "
    "advertisements advertising adsense banner banners promo promos promotion promotional sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login form comment comments commentlist disqus respond replies "
    "share sharing social related recommended recommendations pagination pager toolbar skip".split()
)
_HEADER_WORDS = {"header", "topbar"}
_COMMENT_WORDS = {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "promo", "sponsored", "related", "teaser"}
_BODY_WORDS = {"article", "articlebody", "post", "entry", "story", "content", "maincontent", "main"}
_NOT = {"no", "has", "with", "without", "not"}


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("kept", pa.bool_())]))


class Block(NamedTuple):
    text: str
    chrome: bool
    main: bool
    body: bool


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    return out


def _marks(names: str) -> set[str]:
    """Words of class and id, without those that say what a page has or lacks (``with-sidebar``)."""
    out: set[str] = set()
    for name in names.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and parts[0] not in _NOT:
            out.update(parts)
    return out


class _Open(NamedTuple):
    tag: str
    chrome: bool
    head: bool
    main: bool
    body: bool
    form: bool


def _kind(tag: str, raw: str, in_main: bool) -> _Open:
    """What an element is by its name, role, class and id."""
    attributes = _attributes(raw) if raw.strip(" /\n\t\r") else {}
    role = attributes.get("role", "").lower()
    words = _marks(attributes.get("class", "") + " " + attributes.get("id", "")) if tag not in ("html", "body") else set()
    hidden = "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    article = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    if article:
        chrome = hidden or bool(words & _COMMENT_WORDS)
        return _Open(tag, chrome, False, not chrome, False, False)
    chrome = tag in _CHROME_TAGS or role in _CHROME_ROLES or hidden or bool(words & _CHROME_WORDS)
    if tag in _HEADINGS and in_main:
        chrome = hidden
    head = tag == "header" or bool(words & _HEADER_WORDS)
    return _Open(tag, chrome, head, False, not chrome and not head and bool(words & _BODY_WORDS), tag == "form")


class Reader:
    """One pass over a page; ``blocks`` in page order."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.chrome = self.head = self.main = self.body = self.form = self.heading = 0
        self.text: list[str] = []
        self.aside: list[str] = []
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(page, at)
            self._data(page[at : tag.start()] if tag else page[at:])
            if not tag:
                return
            at = tag.end()
            closing, name = tag.group(1), (tag.group(2) or "").lower()
            if not name:
                continue
            if closing:
                self._end(name)
            elif name in _SILENT:
                if name in _BLOCK:
                    self._flush()
                if not tag.group(3).endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
            else:
                self._start(name, tag.group(3))

    def _data(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        away = self.chrome or (self.head and not (self.main and self.heading)) or (self.form and not self.main)
        (self.aside if away else self.text).append(text)

    def _flush(self) -> None:
        for parts, chrome in ((self.aside, True), (self.text, False)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append(Block(text, chrome, self.main > 0, self.body > 0))
                parts.clear()

    def _start(self, tag: str, raw: str) -> None:
        block = tag in _BLOCK
        if block:
            self._flush()
            if self.open["p"]:
                self._pop("p")
            if tag == "li":
                self._close_until("li", ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self._close_until("dt", ("dl",))
                self._close_until("dd", ("dl",))
            elif tag in ("td", "th", "tr"):
                for cell in ("td", "th", *(["tr"] if tag == "tr" else [])):
                    self._close_until(cell, ("table",))
        if tag in _VOID:
            return
        kind = _kind(tag, raw, self.main > 0)
        if not block and not (kind.chrome or kind.main or kind.body):
            return
        if raw.endswith("/") and not block:
            return
        if kind.main or kind.body:
            self._flush()
        if kind.form and self.main:
            kind = kind._replace(chrome=True)
        self.stack.append(kind)
        self.open[tag] += 1
        self._count(kind, 1)

    def _count(self, kind: _Open, step: int) -> None:
        self.chrome += step * kind.chrome
        self.head += step * kind.head
        self.main += step * kind.main
        self.body += step * kind.body
        self.form += step * kind.form
        self.heading += step * (kind.tag in _HEADINGS)

    def _end(self, tag: str) -> None:
        if tag in _BLOCK or tag == "p":
            self._flush()
        if self.open[tag]:
            self._pop(tag)

    def _pop(self, tag: str) -> None:
        """Close the innermost element of this name and all in it."""
        while True:
            kind = self.stack.pop()
            if kind.main or kind.body or kind.chrome:
                self._flush()
            self.open[kind.tag] -= 1
            self._count(kind, -1)
            if kind.tag == tag:
                return

    def _close_until(self, tag: str, bounds: tuple[str, ...]) -> None:
        if not self.open[tag]:
            return
        for kind in reversed(self.stack):
            if kind.tag == tag:
                self._pop(tag)
                return
            if kind.tag in bounds:
                return


def chosen(blocks: list[Block]) -> tuple[list[bool], bool]:
    """Which blocks are candidates, and if the page marks an article."""
    for of in ("main", "body"):
        kept = [getattr(b, of) and not b.chrome for b in blocks]
        if any(kept):
            return kept, True
    return [not b.chrome for b in blocks], False


_hashes: dict[str, int] = {}


def _runs(host: str, tokens: list[str], span: int) -> np.ndarray:
    """Keys of every ``span`` tokens in a row, by place."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 500_000:
        _hashes.clear()
    for t in set(tokens):
        if t not in _hashes:
            _hashes[t] = xxhash.xxh64_intdigest(t)
    each = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    keys = np.full(n, xxhash.xxh64_intdigest(host), np.uint64)
    for k in range(span):
        keys += each[k : k + n] * _FACTORS[k]
        keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return keys


def windows(host: str, tokens: list[str]) -> np.ndarray:
    """Keys of the suffixes of at least ``SPAN`` tokens, by place."""
    return _runs(host, tokens, SPAN).view(np.int64)


def marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which keys have their bit in ``marks``."""
    mark = keys.view(np.uint64) % np.uint64(MARKS)
    return (marks[(mark >> np.uint64(6)).astype(np.int64)] >> (mark & np.uint64(63))) & np.uint64(1) == 1


def _tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All tokens in page order, and the number of each block's."""
    split = [t.split() for t in texts]
    return [t for part in split for t in part], np.array([len(part) for part in split], np.int64)


def _touching(kept: list[bool], sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows touch a candidate block."""
    sums = np.concatenate([[0], np.cumsum(np.repeat(np.array(kept, bool), sizes))])
    at = np.arange(n)
    return sums[at + SPAN] > sums[at] if n else np.zeros(0, bool)


def shared_windows(groups: list[list[tuple[str, list[str], list[bool]]]]) -> list[np.ndarray]:
    """For each group of pages ``(host, texts, kept)`` the keys of windows that more than half of the pages hold, by suffix order.

    A token of such a window is in more than half of the pages itself, so only stretches of ``SPAN`` or more of these
    tokens are concatenated and put in order.
    """
    number: dict[str, int] = {}
    pages = []  # group, token numbers, touching
    for g, group in enumerate(groups):
        for _, texts, kept in group:
            tokens, sizes = _tokens(texts)
            pages.append((g, np.array([number.setdefault(t, len(number)) for t in tokens], np.int64), _touching(kept, sizes, max(0, len(tokens) - SPAN + 1))))
    members = np.bincount([g for g, *_ in pages], minlength=len(groups))
    seen, times = np.unique(np.concatenate([np.unique(tokens) + g * len(number) for g, tokens, _ in pages]), return_counts=True)
    common = seen[2 * times > members[seen // max(1, len(number))]]
    parts: list[list[np.ndarray]] = [[] for _ in groups]  # symbols, page, place, touching, side by side
    for k, (g, tokens, touching) in enumerate(pages):
        at = np.searchsorted(common, tokens + g * len(number))
        often = common[np.minimum(at, len(common) - 1)] == tokens + g * len(number) if len(common) else np.zeros(len(tokens), bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], often.astype(np.int8), [0])))).reshape(-1, 2)
        for low, high in edges[edges[:, 1] - edges[:, 0] >= SPAN].tolist():
            starts = np.arange(low, high + 1) <= high - SPAN  # of windows; the last place is the stretch's end
            own = np.zeros((4, high - low + 1), np.int64)
            own[0, :-1], own[0, -1] = tokens[low:high] + 2, 1
            own[1] = np.where(starts, k, -1)
            first = np.arange(low, high - SPAN + 1)
            own[2, : len(first)], own[3, : len(first)] = first, touching[first]
            parts[g].append(own)
    full = sorted((g for g in range(len(groups)) if parts[g]), key=lambda g: -sum(x.shape[1] for x in parts[g]))
    found = [np.zeros(0, np.int64) for _ in groups]
    if not full:
        return found
    end = np.array([[0], [-1], [0], [0]])
    strings = [np.concatenate([*parts[g], end], axis=1) for g in full]
    lengths = np.array([x.shape[1] for x in strings])
    symbols, page, place, touch = np.concatenate(strings, axis=1)
    ends = np.cumsum(lengths)
    order = suffix_orders(symbols, ends - lengths, ends)
    string = np.repeat(np.arange(len(full)), lengths)
    order = order[page[order] >= 0]
    group = string[order]
    same = np.flatnonzero(group[1:] == group[:-1])
    for k in range(SPAN):
        same = same[symbols[order[same] + k] == symbols[order[same + 1] + k]]
    fresh = np.ones(len(order), bool)
    fresh[same + 1] = False
    run = np.cumsum(fresh) - 1
    holders = np.bincount(np.unique(run * len(pages) + page[order]) // len(pages))  # different pages of each run
    touched = np.bincount(run, touch[order]) > 0
    heads = np.flatnonzero(fresh)
    chosen_runs = touched & (2 * holders > members[np.array(full)][group[heads]])
    names = list(number)
    for k, g in enumerate(full):
        at = order[heads[chosen_runs & (group[heads] == k)]]
        runs = [[names[t] for t in pages[page[i]][1][place[i] : place[i] + SPAN]] for i in at]
        found[g] = np.array([windows(groups[g][0][0], run)[0] for run in runs], np.int64)
    return found


def asked(host: str, texts: list[str], kept: list[bool], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that touch a candidate block and may be boilerplate, and their places."""
    tokens, sizes = _tokens(texts)
    keys = windows(host, tokens)
    at = np.flatnonzero(_touching(kept, sizes, len(keys)) & marked(keys, marks)) if len(keys) else np.zeros(0, np.int64)
    return keys[at], at


def without_repeats(texts: list[str], kept: list[bool], article: bool, covered: set[int]) -> str:
    """Candidate blocks without the runs that the host repeats; all of them if nothing is left.

    ``covered`` holds the places of repeated windows in the stream of all blocks.
    """
    if not covered:
        return " ".join(text for text, stays in zip(texts, kept, strict=True) if stays)
    out, plain, at = [], [], 0
    hit = {i for p in covered for i in range(p, p + SPAN)}
    for text, stays in zip(texts, kept, strict=True):
        tokens = text.split()
        if stays:
            plain.append(text)
            left = [t for i, t in enumerate(tokens, at) if i not in hit]
            if article or len(tokens) - len(left) < COVERED * len(tokens):
                out += left
        at += len(tokens)
    return " ".join(out or plain)


def _mapped(rows: DataFrame, task: Callable, schema: str, keep: int) -> DataFrame:
    """Run ``task`` on the rows of each batch; the first ``keep`` columns go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                picked, columns = task(part)
                kept = [part.column(i).take(pa.array(picked, pa.int64())) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*part.schema.names[:keep], *names])

    names = [f.split()[0] for f in schema.split(", ")]
    out = rows.select(*rows.columns[:keep]).schema
    for field in schema.split(", "):
        name, kind = field.split(" ", 1)
        out = out.add(name, DataType.fromDDL(kind))
    return rows.mapInArrow(run, out)


def _blocks(page: str | None) -> tuple[list[str], list[bool], bool]:
    """Texts of a page's blocks, which of them are candidates, and if it marks an article."""
    own = Reader(page).blocks if page else []
    kept, article = chosen(own)
    return [b.text for b in own], kept, article


def _content(page: Column) -> Column:
    """Pages of one content are those with equal text between their tags, white space aside."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), r"<[^>]*>", " "), r"\s+", " ")
    return F.xxhash64(text)


def _contents(pages: DataFrame) -> DataFrame:
    """``host, contents``: hosts with the number of their different contents, where there are ``FEW`` or more."""
    distinct = pages.select("host", "content").distinct()
    return distinct.groupBy("host").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") >= FEW)


def _candidates(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """``key, host`` of the windows that more than half of some group of contents hold. Blocks travel as lines of text."""
    parts = F.greatest(F.lit(1), F.floor(F.col("contents") / GROUP))

    def streams(part: pa.RecordBatch):
        """Each content once, however often a batch has it."""
        found: dict[tuple[str, int], tuple] = {}
        for i, (host, content) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
            if (host, content) not in found:
                texts, kept, _ = _blocks(part.column(3)[i].as_py())
                found[host, content] = (i, "\n".join(texts), "".join("+" if k else "-" for k in kept))
        rows = list(found.values())
        return [r[0] for r in rows], [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

    asked_of = pages.join(contents, "host").select("host", parts.alias("parts"), "content", "html")
    read = _mapped(asked_of, streams, "texts string, kept string", 3)
    grouped = read.select("host", F.pmod(F.col("content"), F.col("parts")).alias("group"), "content", "texts", "kept")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, dict[int, tuple]] = {}
        last, size = None, 0

        def solved() -> pa.RecordBatch:
            found = shared_windows([list(group.values()) for group in waiting.values()])
            hosts = [host for (host, _), keys in zip(waiting, found, strict=True) for _ in keys]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(hosts, pa.string())], names=["key", "host"])

        for batch in batches:
            for host, group, content, texts, kept in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (host, group) != last and size > BATCH:
                    yield solved()
                    size = 0
                last = (host, group)
                own = waiting.setdefault(last, {})
                if content not in own:
                    own[content] = (host, texts.split("\n") if texts else [], [k == "+" for k in kept])
                    size += texts.count(" ") + 1
        if waiting:
            yield solved()

    return grouped.repartition("host", "group").sortWithinPartitions("host", "group").mapInArrow(task, "key long, host string").distinct()


def _boilerplate(pages: DataFrame) -> DataFrame:
    """``key, host, holders`` of the windows that more than half of the host's contents hold, and at least ``FEW``.

    Only hosts with candidates are read for it.
    """
    contents = written(_contents(pages), "page-hosts")
    candidates = written(_candidates(pages, contents), "page-candidates")
    shipped = pages.sparkSession.sparkContext.broadcast(_marks_of(candidates))

    def counted(part: pa.RecordBatch):
        picked, found = [], [np.zeros(0, np.int64)]
        for i, (host, page) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
            keys = windows(host, _tokens(_blocks(page)[0])[0])
            keys = np.unique(keys[marked(keys, shipped.value)]) if len(keys) else keys
            picked += [i] * len(keys)
            found.append(keys)
        return picked, [pa.array(np.concatenate(found), pa.int64())]

    concerned = pages.join(candidates.select("host").distinct(), "host", "left_semi").select("host", "content", "html")
    held = _mapped(concerned, counted, "key long", 2).join(candidates.select("key"), "key", "left_semi").distinct()
    counts = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("holders")).join(contents, "host")
    return counts.where((F.col("holders") >= FEW) & (2 * F.col("holders") > F.col("contents"))).select("key", "host", "holders")


def _marks_of(repeated: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` remainders that a repeated key has: at most 2 MB, whatever the number of keys."""
    mark = F.pmod(F.col("key"), F.lit(MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(mark, F.lit(64)).cast("int"))
    words = repeated.groupBy(F.shiftright(mark, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    return marks.view(np.uint64)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` per row of ``pages``.

    Null html is an empty page; a page without text gives an empty string. Pages with null urls are
    those of the empty host. Copies of a page, and rows that repeat one, count as one page, so they do not make each other
    boilerplate; a page that is repeated as a whole keeps its candidate blocks. A page of any length is read whole.
    Other columns have no effect; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    boilerplate = written(_boilerplate(rows.select("host", _content(F.col("html")).alias("content"), "html")), "page-boilerplate")
    marks, hosts = _marks_of(boilerplate), _marks_of(boilerplate.select(F.xxhash64("host").alias("key")))
    shipped = pages.sparkSession.sparkContext.broadcast((marks, hosts))
    none, nothing = boilerplate.isEmpty(), np.zeros(0, np.int64)

    def read(part: pa.RecordBatch):
        """The text of a page without marked windows; of the others the blocks, and the windows to be looked up."""
        texts_of, blocks_of, articles, asks = [], [], [], []
        marks, hosts = shipped.value
        clear = {h: not marked(np.array([xxhash.xxh64_intdigest(h, 42)], np.uint64), hosts)[0] for h in set(part.column(2).to_pylist())}
        for host, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            texts, kept, article = _blocks(page)
            keys, at = (nothing, nothing) if clear[host] else asked(host, texts, kept, marks)
            plain = not len(keys)
            texts_of.append(without_repeats(texts, kept, article, set()) if plain else None)
            blocks_of.append(None if plain else [{"text": t, "kept": k} for t, k in zip(texts, kept, strict=True)])
            articles.append(article)
            asks.append([{"key": k, "at": a} for k, a in zip(keys.tolist(), at.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
        columns = [pa.array(texts_of, pa.string()), pa.array(blocks_of, _BLOCKS), pa.array(articles, pa.bool_()), pa.array(asks, kind)]
        return list(range(part.num_rows)), columns

    kinds = "text string, blocks array<struct<text:string,kept:boolean>>, article boolean, asks array<struct<key:long,at:int>>"
    found = _mapped(rows, read, kinds, 2).withColumn("place", F.monotonically_increasing_id())
    if none:  # no page is open
        return found.select("id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    found = written(found, "pages-read")
    plain = found.where(F.col("text").isNotNull()).select("id", "url", "text")
    open_ = found.where(F.col("text").isNull())
    met = open_.select("place", F.inline("asks")).join(boilerplate.select("key", "holders"), "key").groupBy("place")
    covered = met.agg(F.collect_list(F.struct("at", "holders")).alias("covered"))  # at most a page's length

    def resolved(part: pa.RecordBatch):
        texts = []
        for blocks, article, hits in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            least = SEVERAL if article else FEW
            places = {h["at"] for h in hits or () if h["holders"] >= least}
            texts.append(without_repeats([b["text"] for b in blocks], [b["kept"] for b in blocks], article, places))
        return list(range(part.num_rows)), [pa.array(texts, pa.string())]

    rest = open_.join(covered, "place", "left").select("id", "url", "blocks", "article", "covered")
    out = plain.unionByName(_mapped(rest, resolved, "text string", 2))
    return out.select("id", "url", "text", F.length("text").cast("long").alias("n_chars"))
