"""Main text of web pages: differencing of pages with neighbouring addresses, and the roles that markup names."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread

# Elements by their role in HTML.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select option head fieldset label audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6".split())
ENDS_A_PARAGRAPH = frozenset("div section article main p ul ol table footer nav".split())
# Words in class, id and role that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion "
    "related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary".split()
)
UNLESS = frozenset("has with no without article entry post story".split())  # with-sidebar, entry-header
MAIN_WORDS = frozenset("article-body articlebody article-content entry-content post-content post-body story-body main-content".split())
COPY = 0.6  # a neighbour that has more than this share of what sets a page apart is a copy; see main_text
SAMPLE = 100  # addresses sampled for each range of pages, at most twice as many
PLAIN, MAIN, SIDE = 0, 1, 2  # roles of a line: none named, inside the main part, page furniture
ALIGNED = 1 << 24  # cells of an alignment that are kept at once

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*$")
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


def _roles(attrs: str) -> tuple[bool, bool]:
    """Whether class, id or role name page furniture or the main text."""
    named = [next(filter(None, m.groups()[1:]), "").lower() for m in _ATTR.finditer(attrs)] if "=" in attrs else []
    if not named:
        return False, False
    tokens = [t for n in named for t in n.split()]
    main = any(t in MAIN_WORDS or t == "main" for t in tokens)
    words = [frozenset(_WORD.findall(t)) for t in tokens]
    return not main and any(w & FURNITURE and not w & UNLESS for w in words), main


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text, closing, name, attributes, place after it) of the text and tags of a page, in one pass.

    A `<` that opens no tag is text. From the first quote that is never closed on, quotes in tags mean nothing; a tag
    or comment that the page's end cuts off is dropped. The caller may send a place from which to go on.
    """
    pos, end, tag = 0, len(page), _TAG
    while pos < end:
        at = page.find("<", pos)
        if at != pos:
            at = end if at < 0 else at
            yield page[pos:at], False, "", "", at
            pos = at
            continue
        if not _OPENS.match(page, pos):
            if m := _OTHER.match(page, pos):
                pos = m.end()
            else:
                yield "<", False, "", "", pos + 1
                pos += 1
            continue
        m = tag.match(page, pos)
        if m is None and tag is _TAG:
            tag = _TAG_UNQUOTED
            m = tag.match(page, pos)
        if m is None:
            return
        to = yield "", bool(m[1]), m[2].lower(), m[3], m.end()
        if to is not None:
            yield "", False, "", "", to
        pos = m.end() if to is None else to


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's text lines, without scripts and markup, each with its role: MAIN, SIDE or PLAIN."""
    out: list[tuple[str, int]] = []
    buf: list[str] = []
    skip, depth = "", 0  # an element of page furniture that is open
    named = seen = False  # whether its class, id or role named it; whether there was a main part
    open_: dict[str, int] = {}  # how many elements of each name are open
    mains: list[tuple[str, int]] = []  # open elements that hold the main text, and how many of their name were open
    main_at: dict[str, list[int]] = {}  # their places in mains, by name
    page = page or ""

    def flush() -> None:
        t = _SPACES.sub(" ", html.unescape("".join(buf))).strip()
        buf.clear()
        if t:
            out.append((t, SIDE if skip else MAIN if mains else PLAIN))

    scan = _tokens(page)
    for text, closing, name, attrs, pos in scan:
        if not name:
            buf.append(text)
            continue
        own = attrs.endswith("/")
        if name in RAW and not closing:
            if not own:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                scan.send(close.end() if close else len(page))
            continue
        block = name not in INLINE
        if skip:
            if name == skip and (closing or skip not in CLOSED_BY_BLOCK):
                depth += -1 if closing else 0 if own else 1
                if depth <= 0:
                    flush()
                    skip = ""
                elif block:
                    flush()
                continue
            # a wrapper that was named like furniture holds the page's first main part
            wraps = named and not seen and not closing and name in ("article", "main") and not _roles(attrs)[0]
            if not wraps and name != skip and not (skip in CLOSED_BY_BLOCK and block and (closing or name in ENDS_A_PARAGRAPH)):
                if block:
                    flush()
                continue
            flush()
            skip = ""  # left open, ended by the next block
        if block:
            flush()
        if closing:
            if open_.get(name):
                open_[name] -= 1
            if main_at.get(name) and open_.get(name, 0) < mains[main_at[name][-1]][1]:
                first = main_at[name][-1]
                for x, _ in mains[first:]:
                    main_at[x].pop()
                del mains[first:]
            continue
        furniture, main = _roles(attrs)
        if name not in VOID and not own:
            if furniture or name in ASIDE:
                if name == "header" and mains and not furniture:
                    continue  # an article's own heading
                if name not in ("html", "body", "article", "main") or furniture and name == "article":
                    flush()
                    skip, depth, named = name, 1, furniture and name not in ASIDE
                    continue
            open_[name] = open_.get(name, 0) + 1
            if name in ("article", "main") or main:
                main_at.setdefault(name, []).append(len(mains))
                mains.append((name, open_[name]))
                seen = True
    flush()
    return out


def _rows(x: list[str], at: dict[str, int], n: int) -> Iterator[int]:
    """For every number of x's first lines a bit vector whose zeros are where the longest common subsequence grows."""
    full = v = (1 << n) - 1
    yield v
    for t in x:
        u = v & at.get(t, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _places(y: list[str]) -> dict[str, int]:
    by: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        by.setdefault(t, []).append(j)
    out = {}
    for t, js in by.items():
        bits = bytearray(js[-1] // 8 + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[t] = int.from_bytes(bits, "little")
    return out


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of x and the first j lines of y, for every j."""
    v = 0
    for v in _rows(x, _places(y), len(y)):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit vectors over b.

    Large alignments are halved first, so that memory grows with the lines and not with their product.
    """
    found: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        off, x, y = todo.pop()
        lo, most = 0, min(len(x), len(y))
        while lo < most and x[lo] == y[lo]:
            lo += 1
        hi = 0
        while hi < most - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        found.update(range(off, off + lo), range(off + len(x) - hi, off + len(x)))
        off, x, y = off + lo, x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > ALIGNED:
            mid = len(x) // 2
            j = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
            todo += [(off, x[:mid], y[:j]), (off + mid, x[mid:], y[j:])]
            continue
        at = _places(y)
        rows = list(_rows(x, at, len(y)))
        j = len(y)
        for i in range(len(x) - 1, -1, -1):
            mask = (1 << j) - 1
            if ((~rows[i + 1]) & mask).bit_count() > ((~rows[i]) & mask).bit_count():
                found.add(off + i)
                j = (at[x[i]] & mask).bit_length() - 1  # the last match has the longest way to it
    return found


def main_text(own: list[tuple[str, int]], *others: list[tuple[str, int]] | None) -> str:
    """The lines that differ from the neighbours', the nearest first, less what markup names as furniture.

    The page's lines are aligned with those of two neighbours, furniture and all. Without a marked main part go the
    lines that the nearest shares, or the second if the nearest is a copy: one that has most of what sets the page
    apart from the second. Of a marked main part go the lines that both share and that don't end like a sentence, unless
    they are most of it: articles may share sentences, or be published twice. With one neighbour only, a page that shares most of its text is a copy.
    Of the lines that are left, those that markup names as furniture go, and on marked pages all outside the main part.
    """
    near = [x for x in others if x][:2]
    marked = any(m == MAIN for _, m in own)
    texts = [t for t, _ in own]
    body = {i for i, (_, m) in enumerate(own) if m == (MAIN if marked else PLAIN)}
    alike = [shared(texts, [t for t, _ in x]) for x in near]

    def size(places: set[int]) -> int:
        return sum(len(texts[i]) for i in places)

    if not near or marked and len(near) < 2:
        gone = set()
    elif marked or len(near) < 2:
        gone = set.intersection(*alike)
        if size(gone & body) > COPY * size(body):
            gone = set()
        if marked:
            gone = {i for i in gone if not _SENTENCE.search(texts[i])}
    else:
        a, b = alike
        apart = body - b
        copy = size(apart & a) > COPY * size(apart) or body <= a
        gone = a if not copy else b if not body <= b else set()
    return " ".join(t for i, t in enumerate(texts) if i in body and i not in gone)


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of part, host and path; each is compared with the two nearest of two rows before and two after.

    Equal pages are nearest last. Rows that a part has from those beside it are compared with, and give no row.
    """

    def rows():
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns))
        yield from (None, None)

    def text_of(row, beside):
        near = sorted((x for x in beside if x is not None and x[2] == row[2] and x[5:] == row[5:]), key=lambda x: (x[4] == row[4], -_near(row[3], x[3])))
        return main_text(row[4], *(x[4] for x in near[:2]))

    done: list[tuple] = []
    size = 0
    held: deque = deque([None] * 4, 5)
    own: deque = deque([False] * 4, 5)
    for r in rows():
        held.append(r and (*r[:4], lines(r[4]), r[5]))
        own.append(r is not None and r[6])
        row = held[2]
        if not own[2]:
            continue
        done.append((row[0], row[1], text_of(row, (held[1], held[3], held[0], held[4]))))
        size += len(done[-1][2])
        if size > 1 << 21 or len(done) >= 2000:
            yield _pages(done)
            done, size = [], 0
    if done:
        yield _pages(done)


def _pages(done: list[tuple]) -> pa.RecordBatch:
    ids, urls, texts = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _ranges(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows with the number of their range of keys, and (key, beside): the ranges that a key at an edge is carried to.

    Only keys are read: a sample of them for the bounds, and of every range the two least and the two greatest.
    """
    keys = rows.select("key")
    step = max(1, keys.count() // (SAMPLE * n))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).groupBy("key").count().collect())
    size, seen, bounds = sum(c for _, c in sample), 0, []
    for x, c in sample:
        if seen * n // max(1, size) > len(bounds):
            bounds.append(x)
        seen += c
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    ends: dict[str, int] = {}
    for _ in range(2):
        left = keys.where(~F.col("key").isin(list(ends))) if ends else keys
        for r in left.groupBy(part.alias("part")).agg(F.min("key"), F.max("key")).collect():
            ends |= {r[1]: r[0], r[2]: r[0]}
    edges = sorted(ends)
    beside: dict[str, list[int]] = {}
    for k in range(1, len(edges)):
        if ends[edges[k - 1]] != ends[edges[k]]:
            for keys_, to in ((edges[max(0, k - 2) : k], ends[edges[k]]), (edges[k : k + 2], ends[edges[k - 1]])):
                for x in keys_:
                    beside.setdefault(x, []).append(to)
    carried = rows.sparkSession.createDataFrame([(x, sorted(set(to) - {ends[x]})) for x, to in beside.items()], "key string, beside array<int>")
    return rows.withColumn("part", part), carried


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Pages are dealt out by ranges of (host, path, page_id), so a host of any number of pages spreads; the two keys at
    each edge of a range go to the next range as well, so that each page is compared with its two nearest neighbours in
    that order on the same host, however many ranges there are. Null html is empty, an empty page has an empty text;
    a page alone on its host is judged by markup only. A null url counts as the empty host. Repeated rows each give
    a row. Of two neighbours that are equally near the one before comes first. A page is read in one pass, however long
    or broken; alignments of many lines are halved to bound memory. An empty table gives an empty table. Columns other
    than page_id, url and html are not read.
    """
    small_batches(pages.sparkSession)
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")
    key = F.concat_ws("\x01", "host", "path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, " "))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html")).withColumn("key", key)
    n = spread(pages.sparkSession, 8)
    rows, carried = _ranges(rows, n)
    own = F.array(F.struct(F.col("part").alias("to"), F.lit(True).alias("own")))
    more = F.transform(F.coalesce("beside", F.array().cast("array<int>")), lambda p: F.struct(p.alias("to"), F.lit(False).alias("own")))
    dealt = rows.join(F.broadcast(carried), "key", "left").select("page_id", "url", "host", "path", "html", "key", F.explode(F.concat(own, more)).alias("x"))
    near = dealt.select("page_id", "url", "host", "path", "html", F.col("x.to").alias("to"), F.col("x.own").alias("own"), "key").repartitionById(n, F.col("to")).sortWithinPartitions("to", "key")
    return near.drop("key").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
