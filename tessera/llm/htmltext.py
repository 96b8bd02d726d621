"""Main text of web pages: markup zones, and boilerplate found by suffix arrays per host.

A scanner cuts a page into blocks of text, each in one of three zones: an article
(``article`` or ``main``), furniture that its markup names (menus, headers, footers,
side bars, notices, adverts, reader comments), or neither. Furniture goes and an
article stays whole, whatever repeats in it.

A class, an id or a form says little of a container: its text, from ``RUN`` tokens up,
is judged by repetition, in an article too. An article in such a container is one if
the page has none outside, and one in furniture that is never closed is like any other;
in furniture named by element or role it is text in neither zone.

Text in neither zone is judged by repetition within its host. The token streams of a
chunk's pages are put end to end per host and sorted by their next ``RUN`` tokens, by
doubling ranks as a suffix array is built; a run that starts in two pages with
different streams is boilerplate. Chunks exchange their distinct runs once, so a run
is found wherever its pages lie and a host of any size is spread over all buckets.
Tokens that such runs cover go, and the runs of other tokens stay. Where a page has
an article, its other text is not part of the result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, mix64
from .exchange import PACKED, answered, bucket_edges, chunk_table, decoded, merged, packed_rows

RUN = 8  # tokens of a repeated run
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 256

FURNITURE, ARTICLE, OTHER, JUDGED = 0, 1, 2, 3
# Kinds of furniture: by a class or id, or a form; by element or role; a name with a word for
# comments in it, judged by where the articles stand; never part of a text.
NAMED, SURE, REMARK, CLOSED = 1, 2, 3, 4

# Elements of HTML by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog fieldset footer form head header math menu nav
noscript object optgroup option output progress select svg template video""".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead tr ul""".split())
ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note
search status toolbar""".split())
# Words of a class or id that name furniture.
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager
pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar
signup skip social sponsor sponsored subscribe subscription teaser toolbar widget""".split())
COMMENTS = frozenset("comment comments replies reply respond disqus".split())
FRAMES = frozenset("html body main article".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _furniture(name: str, attrs: str) -> int:
    """What an element's tag says: 0 nothing, ``NAMED``, ``SURE`` or ``CLOSED`` furniture."""
    if name in VOID:
        return CLOSED if name in DROPPED else 0
    kind = 0 if name not in DROPPED else CLOSED if name == "template" else NAMED if name == "form" else SURE
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key in ("class", "id") and name not in ("html", "body"):
            words = set(_SPLIT.split(value))
            if words & COMMENTS and name != "main":
                if COMMENTS & set(value.split()):   # "comments" itself, not "has-comments"
                    return CLOSED
                if name != "article":
                    kind = max(kind, REMARK)
                    continue
            if name not in FRAMES and words & HINTS:
                kind = max(kind, NAMED)
        elif name not in FRAMES and (key == "role" and value.strip() in ROLES or key == "hidden"
                                     or key == "aria-hidden" and value == "true"):
            kind = max(kind, SURE)
    return kind


class _Open:
    """An open element that bears on the zone: a frame (``kind`` 0) or furniture of a kind."""

    def __init__(self, name: str, kind: int):
        self.name, self.kind, self.depth, self.closed, self.words = name, kind, 1, False, 0


def _place(opened: list[_Open]) -> int:
    """How a frame's text ranks: 3 in a free article, 2 free main, 1 in furniture by name, 0 in none or
    in sure furniture, -1 in comments within an article."""
    free, named = set(), False
    last = max((k for k, e in enumerate(opened) if not e.kind), default=-1)
    if last < 0:
        return 0
    for e in opened[:last + 1]:
        if e.kind and e.closed:  # one that never ends takes no article with it
            if e.kind == SURE:
                return 0
            if e.kind == REMARK and "article" in free:   # reader comments stand after or in the article
                return -1
            named = True
        elif not e.kind and not named:
            free.add(e.name)
    return 3 if "article" in free else 2 if "main" in free else 1


def blocks(page: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of a page's blocks in order; white space within is one blank, empty blocks are left out."""
    out: list[tuple[tuple[_Open, ...], str]] = []
    held: list[str] = []
    opened: list[_Open] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((tuple(opened), text))
            if opened and opened[-1].kind == NAMED:
                opened[-1].words += len(text.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name, closing, attrs = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if name in BLOCKS or name in DROPPED:
            flush()
        elif name == "br":
            held.append(" ")
        top = opened[-1] if opened else None
        if closing:
            if name in ("body", "html"):
                flush()
                opened = [e for e in opened if not e.kind]
            elif top and top.kind and name == top.name:
                top.depth -= 1
                if top.depth == 0:
                    flush()
                    top.closed = True
                    opened.pop()
            elif name in ("article", "main") and any(e.name == name for e in opened):
                while opened.pop().name != name:
                    pass
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or attrs.endswith("/") and name in ("svg", "math"):
            continue
        kind = _furniture(name, attrs)
        inside = top.kind if top else 0
        if kind > inside or kind == inside == NAMED:
            flush()
            opened.append(_Open(name, kind))
        elif inside and name == top.name:
            top.depth += 1
        elif name in ("article", "main"):
            opened.append(_Open(name, 0))
        elif top and top.kind and name == "p" and top.name in ("li", "dt", "dd", "td", "tr"):
            opened.pop()
    flush()
    found = []
    for elements, text in out:
        inner = elements[-1] if elements else None
        if any(e.kind == CLOSED for e in elements) or inner and (
                inner.kind in (SURE, REMARK) or inner.kind == NAMED and inner.words < RUN):
            found.append((-1, False, text))
        else:
            found.append((_place(list(elements)), bool(inner and inner.kind), text))
    best = max((place for place, _, _ in found), default=0)
    return [(FURNITURE if place < 0 else OTHER if place == 0 or place != best else JUDGED if named else ARTICLE, text)
            for place, named, text in found]


def host_of(url: str | None) -> str:
    """Lower-case host of a URL, without a port; the empty text where there is none."""
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":")[0].lower()


class Streams:
    """Token streams of a chunk's pages outside articles, end to end per host, and their sorted runs."""

    def __init__(self, urls: list, pages: list):
        self.blocks = [blocks(p or "") for p in pages]
        self.judged = [not any(z in (ARTICLE, JUDGED) for z, _ in b) for b in self.blocks]
        token, page, stream, host = [], [], [], []
        for i, (url, bs) in enumerate(zip(urls, self.blocks)):
            words = [w for z, t in bs if z != ARTICLE for w in t.split()]
            token += [xxhash.xxh64_intdigest(w) for w in words]
            page += [i] * len(words)
            stream.append(xxhash.xxh64_intdigest("\0".join(words)))
            host.append(xxhash.xxh64_intdigest(host_of(url)))
        self.page, stream, host = np.array(page, np.int64), np.array(stream, np.uint64), np.array(host, np.uint64)
        token = np.array(token, np.uint64)
        n = len(token)
        rank = np.unique(token, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        value, span = mix64(token), 1
        while span < RUN:  # ranks by 2, 4, 8 tokens; a run does not leave its page
            fits = np.nonzero(self.page[:max(0, n - 2 * span + 1)] == self.page[2 * span - 1:])[0] if n >= 2 * span else np.zeros(0, np.int64)
            both = rank[fits] * (n + 1) + rank[fits + span]
            longer = np.zeros(n, np.int64)
            longer[fits] = np.unique(both, return_inverse=True)[1]
            with np.errstate(over="ignore"):
                mixed = value.copy()
                mixed[fits] = mix64(value[fits] * np.uint64(0xD6E8FEB86659FD93) + value[fits + span])
            rank, value, span = longer, mixed, span * 2
        self.start = fits if n >= RUN else np.zeros(0, np.int64)
        at = self.page[self.start]
        with np.errstate(over="ignore"):
            self.key = mix64(value[self.start] + host[at] * np.uint64(0xC2B2AE3D27D4EB4F))
        # the suffix array of the runs: equal runs of a host lie side by side
        self.order = np.lexsort((self.start, rank[self.start], host[at]))
        self.stream = stream[at]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(key, smallest stream, largest stream)`` of the distinct runs, sorted by key."""
        key, stream = self.key[self.order], self.stream[self.order]
        first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
        if len(first) == 0:
            return key, stream, stream
        low, high, key = np.minimum.reduceat(stream, first), np.maximum.reduceat(stream, first), key[first]
        by = np.argsort(key)
        return key[by], low[by], high[by]

    def texts(self, repeated: np.ndarray) -> list[str]:
        """Main text of each page, given the sorted keys of repeated runs."""
        covered = np.zeros(len(self.page) + RUN, bool)
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, self.key), len(repeated) - 1)
            hit = self.start[repeated[at] == self.key]
            for k in range(RUN):
                covered[hit + k] = True
        out, pos = [], 0
        for bs, judged in zip(self.blocks, self.judged):
            parts = []
            for zone, text in bs:
                if zone == ARTICLE:
                    parts.append(text)
                    continue
                words = text.split()
                if judged and zone == OTHER or zone == JUDGED:
                    kept = [w for k, w in enumerate(words) if not covered[pos + k]]
                    if kept:
                        parts.append(" ".join(kept))
                pos += len(words)
            out.append(" ".join(parts))
        return out


def _streams(blob: bytes, url: str, page: str) -> tuple[Streams, pa.RecordBatch]:
    batch = decoded(blob)
    at = batch.schema.get_field_index
    return Streams(batch.column(at(url)).to_pylist(), batch.column(at(page)).to_pylist()), batch


def _send(blob: bytes, chunk: int, buckets: int, names: tuple[str, str]) -> pa.Table:
    key, low, high = _streams(blob, *names)[0].distinct()
    return packed_rows(chunk, [(b, key[s:e].tobytes(), low[s:e].tobytes(), high[s:e].tobytes())
                               for b, s, e in bucket_edges(key, buckets)])


def _merge(rows: pa.Table) -> pa.Table:
    """To each chunk: its runs of a bucket that start in two different streams."""
    lists = [rows.column(n).to_pylist() for n in ("keys", "a", "b")]
    key, low, high = (np.frombuffer(b"".join(x), "<u8") for x in lists)
    every, at = np.unique(key, return_inverse=True)
    least, most = np.full(len(every), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(every), np.uint64)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    more = (least != most)[at]
    out, s = [], 0
    bucket = rows.column("bucket")[0].as_py()
    for chunk, x in zip(rows.column("chunk").to_pylist(), lists[0]):
        e = s + len(x) // 8
        if more[s:e].any():
            out.append(packed_rows(chunk, [(bucket, key[s:e][more[s:e]].tobytes(), b"", b"")]))
        s = e
    return pa.concat_tables(out) if out else packed_rows(0, [])


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text") -> DataFrame:
    """All rows of ``pages`` with ``out string``, the main text, in place of ``html_col``.

    Character references are decoded, blocks joined by one blank. Null and empty
    pages give the empty text. A null URL is a host of its own name, as is an empty
    one. Pages of a host with equal streams count as one page, so copies of a page do
    not remove each other. Repeated rows come back repeated; an input column named
    ``out`` is replaced; an empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in (html_col, out)]
    names = free("__url", pages.columns), free("__html", pages.columns)
    src = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url_col).cast("string").alias(names[0]),
                       F.col(html_col).cast("string").alias(names[1]))
    volume = src.agg(F.sum(F.octet_length(names[1]))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-volume // BUCKET_BYTES))
    chunks = chunk_table(src, "page_chunks")

    def first(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _send(blob, chunk, buckets, names).to_batches()

    def last(blob: bytes, _: int, replies: pa.Table) -> pa.Table:
        streams, batch = _streams(blob, *names)
        keys = [np.frombuffer(k, "<u8") for k in replies.column("keys").to_pylist()]
        texts = streams.texts(np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64))
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
        return pa.table({**cols, out: pa.array(texts, pa.string())})

    target = pages.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(out)).schema
    repeated = merged(chunks.mapInArrow(first, PACKED), _merge, "page-runs")
    return answered(chunks, repeated, last, target)
