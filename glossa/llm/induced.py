"""External induced sorting: suffix arrays with common-prefix values, in scratch files and bounded memory.

The text, its types, names and orders are files that are read and written in blocks or mapped; what is held in memory is
at most about `limit` entries of a queue, a block of `limit` entries, and a counter for each symbol.
"""

from __future__ import annotations

import bisect
import tempfile
from collections.abc import Iterator

import numpy as np

NAME_CAP = 100  # common names that are counted: each stands for two symbols at least
SMALL = 1 << 10  # symbols up to which a queue for each is kept


class Scratch:
    """Scratch files of one sort. They have no name, so each ends with the last reference to it, or with the task."""

    def __init__(self):
        self.spilled = self.levels = 0
        self.place = np.int64  # type of places in the text

    def file(self):
        return tempfile.TemporaryFile(prefix="suffix-")

    def array(self, n: int, dtype) -> np.ndarray:
        """A mapped array of zeros."""
        return np.memmap(self.file(), dtype, "w+", shape=(max(n, 1),))[:n]


class Spool:
    """A sequence of (suffix, common prefix) that is appended to and read in blocks; beyond `limit` entries on disk."""

    def __init__(self, scratch: Scratch, limit: int):
        self.scratch, self.limit, self.n, self.stored = scratch, limit, 0, 0
        self.tail: list[tuple[np.ndarray, np.ndarray]] = []
        self.files = None

    def append(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.tail.append((np.array(suffix, self.scratch.place), np.array(lcp, np.int16)))
        self.n += len(suffix)
        if self.n - self.stored > self.limit:
            self._store()

    def _store(self) -> None:
        self.files = self.files or (self.scratch.file(), self.scratch.file())
        for f, k in zip(self.files, (0, 1)):
            f.seek(0, 2)
            f.write(b"".join(part[k].tobytes() for part in self.tail))
        self.scratch.spilled += self.n - self.stored
        self.tail, self.stored = [], self.n

    def read(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if self.files is None:
            a, b = (np.concatenate(x) for x in zip(*self.tail)) if self.tail else (np.zeros(0, self.scratch.place), np.zeros(0, np.int16))
            self.tail = [(a, b)]
            return a[lo:hi], b[lo:hi]
        if self.tail:
            self._store()
        out = []
        for f, t in zip(self.files, (self.scratch.place, np.int16)):
            size = np.dtype(t).itemsize
            f.seek(lo * size)
            out.append(np.frombuffer(f.read((hi - lo) * size), t))
        return out[0], out[1]

    def up(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hi = self.n if hi is None else hi
        for i in range(lo, hi, self.limit):
            yield self.read(i, min(hi, i + self.limit))

    def down(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last entry to the first, each in reverse."""
        hi = self.n if hi is None else hi
        for i in range(hi, lo, -self.limit):
            a, b = self.read(max(lo, i - self.limit), i)
            yield a[::-1], b[::-1]


class BucketQueue:
    """A monotone priority queue of (symbol, order of arrival) with suffix and common-prefix values.

    Entries arrive in the order of their sources, so a queue for each symbol returns them sorted. Beyond `limit` entries
    the queues are appended to one scratch file, in runs.
    """

    def __init__(self, symbols: int, scratch: Scratch, limit: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.n, self.limit, self.scratch, self.file = 0, limit, scratch, None

    def push(self, symbol: int, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.held[symbol].append((suffix, lcp))
        self.n += len(suffix)
        if self.n > self.limit:
            self.file = self.file or self.scratch.file()
            self.file.seek(0, 2)
            for s, parts in enumerate(self.held):
                if parts:
                    a, b = (np.concatenate(x) for x in zip(*parts))
                    self.runs[s].append((self.file.tell(), len(a)))
                    self.file.write(a.astype(self.scratch.place).tobytes() + b.astype(np.int16).tobytes())
                    self.held[s] = []
            self.scratch.spilled += self.n
            self.n = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's entries in order of arrival, in blocks, those too that arrive while blocks are taken."""
        while self.runs[symbol] or self.held[symbol]:
            runs, held = self.runs[symbol], self.held[symbol]
            self.runs[symbol], self.held[symbol] = [], []
            self.n -= sum(len(x) for x, _ in held)
            place, size = self.scratch.place, np.dtype(self.scratch.place).itemsize
            for at, n in runs:
                for i in range(0, n, self.limit):
                    k = min(self.limit, n - i)
                    self.file.seek(at + size * i)
                    a = np.frombuffer(self.file.read(size * k), place)
                    self.file.seek(at + size * n + 2 * i)
                    yield a, np.frombuffer(self.file.read(2 * k), np.int16)
            if held:
                yield tuple(np.concatenate(x) for x in zip(*held))


class Waiting:
    """A monotone priority queue of (symbol, order of arrival) with suffix and common-prefix values, for large alphabets.

    A list for each symbol that has entries, each `suffix << 8 | common prefix`; beyond `limit` entries they go to disk as
    a run in the order of symbols. Symbols are asked for in ascending order, so every run is read once from front to back.
    """

    BLOCK = 4096

    def __init__(self, scratch: Scratch, limit: int):
        self.scratch, self.limit, self.n = scratch, limit, 0
        self.lists: dict[int, list[int]] = {}
        self.runs: list[list] = []  # file, symbols and entries of the block in memory, place in it

    def check(self) -> None:
        """To be called when `n` has grown."""
        if self.n <= self.limit:
            return
        f = self.scratch.file()
        for part in self._blocks():
            f.write(part.tobytes())
        f.seek(0)
        self.scratch.spilled += self.n
        self.lists.clear()
        self.n = 0
        run = [f, np.zeros(0, np.int64), np.zeros(0, np.int64), 0]
        if self._fill(run):
            self.runs.append(run)

    def _blocks(self) -> Iterator[np.ndarray]:
        part: list[tuple[int, int]] = []
        for s in sorted(self.lists):
            part += [(s, e) for e in self.lists[s]]
            if len(part) >= self.BLOCK:
                yield np.array(part, np.int64)
                part = []
        if part:
            yield np.array(part, np.int64)

    def _fill(self, run: list) -> bool:
        data = np.frombuffer(run[0].read(16 * self.BLOCK), np.int64).reshape(-1, 2)
        run[1:] = data[:, 0], data[:, 1], 0
        return len(data) > 0

    def take(self, symbol: int) -> Iterator[list[int]]:
        """The symbol's entries in order of arrival, those too that arrive while they are taken."""
        more = True
        while more:
            more = False
            for run in list(self.runs):  # older than what the lists hold
                while run[3] < len(run[1]) and run[1][run[3]] == symbol:
                    to = int(np.searchsorted(run[1], symbol, "right"))
                    part = run[2][run[3] : to].tolist()
                    run[3] = to
                    if to == len(run[1]) and not self._fill(run):
                        self.runs.remove(run)
                    more = True
                    yield part
            if not more and (part := self.lists.pop(symbol, None)):
                self.n -= len(part)
                more = True
                yield part


def _run(t: np.ndarray, x: int, cap: int) -> int:
    """How often the symbol at x repeats from there on, up to cap."""
    s = np.asarray(t[x : x + cap])
    other = np.flatnonzero(s != s[0])
    return int(other[0]) if len(other) else len(s)


def _types(t: np.ndarray, scratch: Scratch, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S (less than the one after it), and the leftmost places of runs of S."""
    n = len(t)
    s_type = scratch.array(n, np.bool_)
    s_type[n - 1] = True
    for hi in range(n - 1, 0, -limit):
        lo = max(0, hi - limit)
        part = np.asarray(t[lo : hi + 1]).astype(np.int64)
        d = np.sign(part[1:] - part[:-1])
        m = len(d)
        nxt = np.where(d != 0, np.arange(m), m)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s_type[lo:hi] = np.append(d > 0, s_type[hi])[nxt]
    found = scratch.file()
    count = 0
    for lo in range(1, n, limit):
        part = np.asarray(s_type[lo - 1 : lo + limit])
        at = np.flatnonzero(part[1:] & ~part[:-1]) + lo
        found.write(at.astype(scratch.place).tobytes())
        count += len(at)
    found.flush()
    return s_type, np.memmap(found, scratch.place, "r", shape=(count,)) if count else np.zeros(0, scratch.place)


class _Pass:
    """One direction of induction: pushes the predecessors of sorted suffixes with their common-prefix values."""

    def __init__(self, t: np.ndarray, s_type: np.ndarray, want: bool, symbols: int, cap: int, scratch: Scratch, limit: int):
        self.t, self.s_type, self.want, self.cap = t, s_type, want, cap
        self.queue = BucketQueue(symbols, scratch, limit)
        self.least = np.full(symbols, -1, np.int16)  # least value since a symbol was last pushed; -1 at its first

    def feed(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        """suffix: sorted suffixes; lcp: of each with the one fed before it."""
        prev = suffix - 1
        k = np.flatnonzero((prev >= 0) & (self.s_type[prev] == self.want))
        low = np.minimum.accumulate(lcp)
        if not len(k):
            self.least = np.minimum(self.least, low[-1])
            return
        to = self.t[prev[k]]
        order = np.argsort(to.astype(np.uint16), kind="stable")
        k, to = k[order], to[order]
        first = np.concatenate(([True], to[1:] != to[:-1]))
        value = np.empty(len(k), np.int16)
        heads = np.flatnonzero(first)
        value[heads] = np.minimum(self.least[to[heads]], low[k[heads]])
        rest = np.flatnonzero(~first)
        if len(rest):
            pairs = np.stack((k[rest - 1] + 1, k[rest] + 1), 1).ravel()
            value[rest] = np.minimum.reduceat(np.append(lcp, np.int16(self.cap)), pairs)[::2]
        value = np.minimum(value + 1, self.cap).astype(np.int16)
        tails = np.append(heads[1:], len(k)) - 1
        self.least = np.minimum(self.least, low[-1])
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(self.cap))
        self.least[to[tails]] = after[k[tails] + 1]
        for h, e in zip(heads, tails):
            self.queue.push(int(to[h]), prev[k[h : e + 1]], value[h : e + 1])


def _induce_few(t: np.ndarray, s_type: np.ndarray, seeds: Spool, symbols: int, cap: int, scratch: Scratch, limit: int) -> Spool:
    """All suffixes from the greatest to the least, each with its common prefix with the one before, from the sorted
    leftmost S suffixes. L suffixes are induced in ascending order of symbols, then S suffixes in descending order."""
    size = np.zeros(symbols + 1, np.int64)
    for suffix, _ in seeds.up():
        size[1:] += np.bincount(t[suffix], minlength=symbols)
    cut = np.cumsum(size)
    up, large, ends = _Pass(t, s_type, False, symbols, cap, scratch, limit), Spool(scratch, limit), [0]
    for c in range(symbols):
        last = None
        for suffix, lcp in up.queue.pop(c):
            large.append(suffix, lcp)
            up.feed(suffix, lcp)
            last = int(suffix[-1])
        ends.append(large.n)
        for own, own_lcp in seeds.up(int(cut[c]), int(cut[c + 1])):
            if last is not None:
                own_lcp = own_lcp.copy()
                own_lcp[0] = min(_run(t, last, cap), _run(t, int(own[0]), cap))
                last = None
            up.feed(own, own_lcp)
    del up
    down, out = _Pass(t, s_type, True, symbols, cap, scratch, limit), Spool(scratch, limit)
    for c in range(symbols - 1, -1, -1):
        last = None
        for suffix, lcp in down.queue.pop(c):
            out.append(suffix, lcp)
            down.feed(suffix, lcp)
            last = int(suffix[-1])
        carry = np.zeros(1, np.int16)
        for big, lcp in large.down(ends[c], ends[c + 1]):
            if last is not None:
                carry[0] = min(_run(t, last, cap), _run(t, int(big[0]), cap))
                last = None
            value = np.concatenate((carry, lcp[:-1]))
            carry = lcp[-1:]
            out.append(big, value)
            down.feed(big, value)
    out.append(np.array([len(t) - 1]), np.zeros(1, np.int16))  # the end mark is below all and induced by none
    return out


class _Sweep:
    """One direction of induction for large alphabets. With common prefixes, the least one since a symbol was last pushed
    is looked up in a stack of the least ones up to now, which holds no more entries than there are values."""

    def __init__(self, t: np.ndarray, s_type: np.ndarray, want: int, flip: int, symbols: int, cap: int, scratch: Scratch, limit: int):
        self.sym, self.of_s, self.want, self.flip, self.cap = memoryview(t), memoryview(s_type).cast("B"), want, flip, cap
        self.waiting, self.fed = Waiting(scratch, limit), 0
        self.last = memoryview(scratch.array(symbols, np.int64))  # number of the feed before a symbol's last push
        self.at: list[int] = []
        self.least: list[int] = []

    def feed(self, entries: list[int]) -> None:
        """Sorted suffixes, each with its common prefix with the one fed before it: push those of the wanted type before them."""
        sym, of_s, want, flip, cap, last, at, least, lists = self.sym, self.of_s, self.want, self.flip, self.cap, self.last, self.at, self.least, self.waiting.lists
        i, pushed = self.fed, 0
        for e in entries:
            i += 1
            if cap > 1:
                v = e & 255
                while least and least[-1] >= v:
                    least.pop()
                    at.pop()
                least.append(v)
                at.append(i)
            x = e >> 8
            if x and of_s[x - 1] == want:
                s = sym[x - 1]
                if cap > 1:
                    before, last[s] = last[s], i
                    v = min(cap, least[bisect.bisect_right(at, before)] + 1) if before else 0
                else:
                    v = 0
                s = flip - s if flip else s
                if (own := lists.get(s)) is None:
                    lists[s] = [x - 1 << 8 | v]
                else:
                    own.append(x - 1 << 8 | v)
                pushed += 1
        self.fed = i
        if pushed:
            self.waiting.n += pushed
            self.waiting.check()

    def run(self, x: int) -> int:
        """How often the symbol at x repeats from there on, up to cap."""
        sym, n = self.sym, 1
        while n < self.cap and x + n < len(sym) and sym[x + n] == sym[x]:
            n += 1
        return n


class _Packed:
    """Entries on their way into a spool."""

    def __init__(self, spool: Spool):
        self.spool, self.held = spool, []

    def add(self, entries: list[int]) -> None:
        self.held += entries
        if len(self.held) >= 1 << 16:
            self.flush()

    def flush(self) -> None:
        e = np.array(self.held, np.int64)
        self.spool.append(e >> 8, e & 255)
        self.held = []


def _induce_many(t: np.ndarray, s_type: np.ndarray, seeds: Spool, symbols: int, cap: int, scratch: Scratch, limit: int) -> Spool:
    """As _induce_few(), for large alphabets: symbol by symbol, entry by entry."""

    def by_symbol(sweep: _Sweep, blocks: Iterator[list[int]], into: _Packed, all_: bool) -> None:
        """Every symbol's induced suffixes, then its own ones of `blocks`, which come in the order of symbols."""
        sym, flip, block, k = sweep.sym, sweep.flip, next(blocks, []), 0
        waiting, lists = sweep.waiting, sweep.waiting.lists
        for c in range(symbols):
            last = -1
            if c in lists or waiting.runs:
                for part in waiting.take(c):
                    into.add(part)
                    sweep.feed(part)
                    last = part[-1] >> 8
            own = flip - c if flip else c
            while k < len(block):
                a = k
                while k < len(block) and sym[block[k] >> 8] == own:
                    k += 1
                if k > a:
                    part = block[a:k]
                    if last >= 0 and cap > 1:
                        x = part[0] >> 8
                        part[0] = x << 8 | min(sweep.run(last), sweep.run(x))
                    last = -1
                    if all_:
                        into.add(part)
                    sweep.feed(part)
                if k < len(block):
                    break
                block, k = next(blocks, []), 0

    def ready() -> Iterator[list[int]]:
        for a, b in seeds.up():
            yield (a.astype(np.int64) << 8 | b).tolist()

    def from_above() -> Iterator[list[int]]:  # each with its common prefix with the greater one
        carry = np.zeros(1, np.int64)
        for a, b in large.down():
            b = b.astype(np.int64)
            yield (a.astype(np.int64) << 8 | np.append(carry, b[:-1])).tolist()
            carry = b[-1:]

    large, out = Spool(scratch, limit), Spool(scratch, limit)
    into = _Packed(large)
    by_symbol(_Sweep(t, s_type, 0, 0, symbols, cap, scratch, limit), ready(), into, False)
    into.flush()
    into = _Packed(out)
    by_symbol(_Sweep(t, s_type, 1, symbols - 1, symbols, cap, scratch, limit), from_above(), into, True)
    into.flush()
    out.append(np.array([len(t) - 1]), np.zeros(1, np.int16))
    return out


def _agree(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from a and b on are equal, up to `most` of each pair; compared symbol by symbol, eight at a time."""
    out = np.zeros(len(a), np.int64)
    todo = np.flatnonzero(most > 0)
    step, last = np.arange(8), len(t) - 1
    while len(todo):
        at = out[todo, None] + step
        same = t[np.minimum(a[todo, None] + at, last)] == t[np.minimum(b[todo, None] + at, last)]
        same &= at < most[todo, None]
        n = np.where(same.all(1), 8, same.argmin(1))
        out[todo] += n
        todo = todo[n == 8]
    return out


def _names(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, order: Spool, scratch: Scratch, limit: int) -> tuple[np.ndarray, int]:
    """Ranks of the substrings between leftmost S places, in the order of the text, and how many differ. `order` has all
    suffixes in the descending order of these substrings."""
    length = scratch.array(len(t) // 2 + 1, scratch.place)  # such places are two apart at least
    for lo in range(0, len(lms), limit):
        part = np.asarray(lms[lo : lo + limit + 1])
        length[part[:-1] // 2] = np.diff(part) + 1
    length[int(lms[-1]) // 2] = 1
    name = scratch.array(len(t) // 2 + 1, scratch.place)
    last, rank = np.zeros(0, scratch.place), -1
    for x, _ in order.down():
        x = x[(x > 0) & s_type[x] & ~s_type[x - 1]]
        if not len(x):
            continue
        a, b = np.append(last, x[:-1]), x if len(last) else x[1:]
        n = length[a // 2]
        new = (n != length[b // 2]) | (_agree(t, a, b, np.where(n == length[b // 2], n, 0)) < n)
        new = new if len(last) else np.append(True, new)
        ranks = rank + np.cumsum(new)
        name[x // 2] = ranks
        last, rank = x[-1:], int(ranks[-1])
    names = scratch.array(len(lms), scratch.place)
    for lo in range(0, len(lms), limit):
        names[lo : lo + limit] = name[np.asarray(lms[lo : lo + limit]) // 2]
    return names, rank + 1


def _by_symbol(t: np.ndarray, lms: np.ndarray, symbols: int, scratch: Scratch, limit: int) -> Spool:
    """The leftmost S places in the order of their symbols."""
    out, at = scratch.array(len(lms), scratch.place), scratch.array(symbols + 1, np.int64)
    for lo in range(0, len(lms), limit):
        s, n = np.unique(t[lms[lo : lo + limit]], return_counts=True)
        at[s.astype(np.int64) + 1] += n
    np.cumsum(at, out=at)
    for lo in range(0, len(lms), limit):
        part = np.asarray(lms[lo : lo + limit])
        s = t[part].astype(np.int64)
        order = np.argsort(s, kind="stable")
        part, s = part[order], s[order]
        kind, first, n = np.unique(s, return_index=True, return_counts=True)
        out[at[s] + np.arange(len(s)) - np.repeat(first, n)] = part
        at[kind] += n
    spool = Spool(scratch, limit)
    for lo in range(0, len(lms), limit):
        part = np.asarray(out[lo : lo + limit])
        spool.append(part, np.zeros(len(part), np.int16))
    return spool


def _in_memory(t: np.ndarray, cap: int, scratch: Scratch, limit: int) -> Spool:
    """suffix_order() of a text of names that fits in memory, ranked by doubling."""
    rank, k = np.asarray(t).astype(np.int64), 1
    while True:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (len(rank) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(len(rank), np.int64)
        new[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        if new[order[-1]] == len(rank) - 1:
            break
        rank, k = new, 2 * k
    lcp = _agree(t, order[:-1], order[1:], np.full(len(order) - 1, cap))
    out = Spool(scratch, limit)
    out.append(order[::-1], np.append(0, lcp[::-1]))
    return out


def suffix_order(t: np.ndarray, symbols: int, cap: int, scratch: Scratch, limit: int) -> Spool:
    """All suffixes of t from the greatest to the least, each with its common prefix, up to cap, with the one before.

    The last symbol of t is its only least one, 0. Leftmost S suffixes are sorted by their substrings first, which are
    named; if names repeat, the text of names is sorted by recursion, down to one of no more than `limit` names. Common
    names give common prefixes: where they end in the text, the symbols of the two substrings that differ are compared.
    """
    scratch.levels += 1
    if 1 < len(t) <= limit and scratch.levels > 1:
        return _in_memory(t, cap, scratch, limit)
    induce = _induce_few if symbols <= SMALL else _induce_many
    if len(t) == 1:
        out = Spool(scratch, limit)
        out.append(np.zeros(1, np.int64), np.zeros(1, np.int16))
        return out
    s_type, lms = _types(t, scratch, limit)
    order = induce(t, s_type, _by_symbol(t, lms, symbols, scratch, limit), symbols, 1, scratch, limit)
    names, kinds = _names(t, s_type, lms, order, scratch, limit)
    del order
    seeds = Spool(scratch, limit)
    if kinds == len(lms):
        ranked = scratch.array(len(lms), scratch.place)
        for lo in range(0, len(lms), limit):
            ranked[names[lo : lo + limit]] = np.arange(lo, min(len(lms), lo + limit))
        blocks = ((ranked[lo : lo + limit].astype(np.int64), None) for lo in range(0, len(lms), limit))
    else:
        blocks = suffix_order(names, kinds, NAME_CAP, scratch, limit).down()
    del names
    last, shared = np.zeros(0, np.int64), 0
    for i, v in blocks:  # ascending; v of an entry is what it has in common with the next one
        i = i.astype(np.int64)
        common = np.zeros(len(i), np.int64) if v is None else np.append(shared, v[:-1]).astype(np.int64)
        shared = 0 if v is None else int(v[-1])
        a, b = np.append(last, i[:-1]), i if len(last) else i[1:]
        r = common if len(last) else common[1:]
        off = np.minimum(lms[a + r] - lms[a], cap).astype(np.int64)
        lcp = off + _agree(t, lms[a] + off, lms[b] + off, cap - off)
        seeds.append(lms[i], lcp if len(last) else np.append(0, lcp))
        last = i[-1:]
    return induce(t, s_type, seeds, symbols, cap, scratch, limit)
