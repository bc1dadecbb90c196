"""Passes over a trie's nodes in the order of their paths, in ranges that are passed each by itself.

A node's subtree is a run of that order, so a stack of the nodes above the present one is all that a pass holds. What a
range can't know, as it hangs from nodes of ranges before it or goes on in ranges after it, is left to a pass over those
nodes alone, the skeleton. Node ids ascend with the order; the bits above SHIFT are the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SHIFT = 33
ROWS, BYTES = 10_000, 4_000_000  # of a batch that is put out

# n, m: bytes of the path and of the parent's. weight: of a key. w, cnt: weights and keys below and at the node.
SUMS = "id long, n int, m int, parent long, weight double, w double, cnt long, state int, path binary"
SKELETON = "id long, m int, parent long, w double, cnt long"
PLACES = "id long, m int, sib_rank int, w float, rank_path string, depth int, dfs_lo long, dfs_hi long"
CLOSED, OPEN, LAST = 0, 1, 2  # subtree within the range; it may go on after it; the same, and the range's last node

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary()}


class _Rows:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: str):
        self.schema = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])
        self.rows, self.bytes = [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.bytes >= BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names))


def common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, weight, range) in the order of paths to SUMS, each node when its subtree ends.

    The longest common prefix of neighbours is the path of the later one's parent. parent is null where it lies in a
    range before, m is -1 at the range's first node; w and cnt of an open node leave out open nodes below it.
    """
    out, stack, before, id_ = _Rows(SUMS), [], b"", None
    for batch in batches:
        for path, weight, of in _columns(batch, "path", "weight", "range"):
            if id_ is None:
                id_, m = of << SHIFT, -1
            else:
                id_, m = id_ + 1, common(before, path)
            while stack and stack[-1][1] > m:
                node, n, up, own, w, cnt = stack.pop()
                if stack:
                    stack[-1][4] += w
                    stack[-1][5] += cnt
                out.add((node, n, up, stack[-1][0] if stack else None, own, w, cnt, CLOSED, before[:n]), n)
                if out.full():
                    yield out.take()
            stack.append([id_, len(path), m, weight, 0.0 if weight is None else weight, 0 if weight is None else 1])
            before = path
    above = None
    for node, n, up, own, w, cnt in stack:
        out.add((node, n, up, above, own, w, cnt, LAST if node == id_ else OPEN, before[:n]), n)
        above = node
        if out.full():
            yield out.take()
    yield out.take()


def skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, m, w, cnt, state, edge) of open nodes and of those whose parent lies in a range before, in the order of
    ids, to SKELETON. edge: the paths of the first and the last node of each range, whose common prefix is the first
    one's parent."""
    out, stack, last = _Rows(SKELETON), [], None

    def close() -> None:
        node, _, up, w, cnt = stack.pop()
        if stack:
            stack[-1][3] += w
            stack[-1][4] += cnt
        out.add((node, up, stack[-1][0] if stack else None, w, cnt))

    for batch in batches:
        for id_, n, m, w, cnt, state, edge in _columns(batch, "id", "n", "m", "w", "cnt", "state", "edge"):
            if m < 0 and last is not None:
                m = common(last, edge)
            while stack and stack[-1][1] > m:
                close()
            stack.append([id_, n, m, w, cnt])
            last = edge if state == LAST else last
            if out.full():
                yield out.take()
    while stack:
        close()
        if out.full():
            yield out.take()
    yield out.take()


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, m, parent, w, cnt, terminal, sib_rank, earlier, rank_path, dfs_lo) in the order of ids to PLACES.

    earlier: the keys of earlier siblings. Rows without m give the place of the node that follows them; other nodes have
    their place from the parent.
    """
    out, stack, trail, known = _Rows(PLACES), [], "", None
    names = ("id", "m", "parent", "w", "cnt", "terminal", "sib_rank", "earlier", "rank_path", "dfs_lo")
    for batch in batches:
        for id_, m, parent, w, cnt, terminal, rank, earlier, path, lo in _columns(batch, *names):
            if m is None:
                known = path, lo
                continue
            while stack and stack[-1][0] != parent:
                stack.pop()
            if known is not None:
                trail, lo = known
                known = None
            elif parent is None:
                trail, lo = "", 0
            else:
                _, digits, low, key = stack[-1]
                trail, lo = f"{trail[:digits]}{rank:02X}", low + key + earlier
            stack.append((id_, len(trail), lo, terminal))
            out.add((id_, m, None if parent is None else rank, w, trail, len(trail) // 2, lo if cnt else None, lo + cnt - 1 if cnt else None), len(trail))
            if out.full():
                yield out.take()
    yield out.take()
