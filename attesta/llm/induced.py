"""Suffix sorting by induction over queues that spill to disk, and the repeated windows that it finds.

The text is byte strings end to end, each closed by a separator that is smaller than every byte. Suffixes are L (larger than their successor) or S; the
leftmost S of each stretch (LMS) split the text into substrings. One induction from unsorted LMS suffixes sorts these substrings, equal ones get equal
names, and the string of names is sorted by the recursive step; a second induction from the sorted LMS suffixes sorts everything. An induction is a scan in
order over one queue for each first byte: a block of suffixes is taken from the front of the smallest queue, and those of their predecessors that are L
(then, from the largest queue down, S) are appended to the queues of their first bytes, which never lie behind the scan. Queues hold positions, are read
and written in blocks, and go to disk beyond a budget; the text, the whole order and what belongs to windows are held in memory, so shards must be small.

Order is exact for the first ``depth`` bytes; that is what the common prefixes of neighbours are asked for, and it lets the recursive step stop
once names cover that many bytes. Neighbours' common prefixes are carried as one bit, whether they reach the depth, from comparing bytes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes taken from a queue at once, and bytes of all queues of one induction that stay in memory.
BLOCK, BUDGET = 1 << 18, 256 << 20


class Queue:
    """First in, first out, of int32 or int64 positions; the oldest parts may lie in a file (scratch of the running task, as Spark's spill files are)."""

    def __init__(self, pool: Pool):
        self.pool, self.parts, self.file, self.read, self.size = pool, [], None, 0, 0

    def push(self, a: np.ndarray) -> None:
        self.parts.append(a)
        self.size += len(a)
        self.pool.held += a.nbytes

    def spill(self) -> None:
        if self.parts:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.pool.folder)
            self.file.seek(0, os.SEEK_END)
            for a in self.parts:
                self.file.write(np.ascontiguousarray(a, self.pool.kind).tobytes())
            self.parts = []

    def _on_disk(self, most: int) -> np.ndarray:
        self.file.seek(self.read)
        raw = self.file.read(most * self.pool.kind.itemsize)
        self.read += len(raw)
        return np.frombuffer(raw, self.pool.kind)

    def pop(self, most: int = BLOCK) -> np.ndarray | None:
        if self.file is not None:
            if len(a := self._on_disk(most)):
                return a
            self.file.close()
            self.file = None
            self.read = 0
        if not self.parts:
            return None
        n, k = 0, 0
        while k < len(self.parts) and n < most:
            n += len(self.parts[k])
            k += 1
        out = self.parts[0] if k == 1 else np.concatenate(self.parts[:k])
        del self.parts[:k]
        self.pool.held -= out.nbytes
        return out

    def all(self) -> np.ndarray:
        """Everything, read at once; the queue is then empty."""
        out = []
        while (a := self.pop(1 << 24)) is not None:
            out.append(a)
        return np.concatenate(out) if out else np.zeros(0, self.pool.kind)


class Pool:
    """Queues under one budget."""

    def __init__(self, n: int, kind: np.dtype, budget: int):
        self.kind, self.budget, self.held = kind, budget, 0
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.queues = [Queue(self) for _ in range(n)]

    def check(self) -> None:
        if self.held > self.budget:
            for q in self.queues:
                q.spill()
            self.held = 0


def _push(pool: Pool, text: np.ndarray, at: np.ndarray) -> None:
    """Append positions to the queues of their symbols, in order."""
    if not len(at):
        return
    symbol = text[at]
    order = np.argsort(symbol, kind="stable")  # radix sort on 16 bits
    at, symbol = at[order], symbol[order]
    cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        pool.queues[symbol[a]].push(at[a:b])
    pool.check()


def _induce(text: np.ndarray, lms: list[np.ndarray], symbols: int, kind: np.dtype, budget: int) -> tuple[Pool, Pool]:
    """(L suffixes ascending, S suffixes descending) by first symbol, from LMS suffixes by first symbol."""
    left, out_l = Pool(symbols, kind, budget), Pool(symbols, kind, budget)
    for c in range(symbols):
        while (a := left.queues[c].pop()) is not None:
            out_l.queues[c].push(a)
            out_l.check()
            b = a[a > 0] - kind.type(1)
            _push(left, text, b[text[b] >= c])
        a = lms[c]
        for i in range(0, len(a), BLOCK):
            b = a[i : i + BLOCK]
            _push(left, text, b[b > 0] - kind.type(1))
    right, out_s = Pool(symbols, kind, budget), Pool(symbols, kind, budget)
    last = kind.type(len(text) - 1)
    for c in range(symbols - 1, -1, -1):
        while (a := right.queues[c].pop()) is not None:
            out_s.queues[c].push(a)
            out_s.check()
            b = a[a > 0] - kind.type(1)
            _push(right, text, b[text[b] <= c])
        if c == 0:
            out_s.queues[0].push(np.array([last], kind))  # the end of the text follows from nothing
        own = out_l.queues[c].all()
        for i in range(len(own), 0, -BLOCK):
            a = own[max(0, i - BLOCK) : i][::-1]
            b = a[a > 0] - kind.type(1)
            _push(right, text, b[text[b] < c])
        if len(own):
            out_l.queues[c].push(own)
            out_l.check()
    return out_l, out_s


def _types(text: np.ndarray) -> np.ndarray:
    """True for S."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # i where i and i + 1 differ
    rising = text[change + 1] > text[change]
    out = np.ones(n, bool)  # the last stretch, a separator, is S
    ends = np.concatenate((change, [n - 1]))
    begins = np.concatenate(([0], change + 1))
    out[:] = np.repeat(np.concatenate((rising, [True])), ends - begins + 1)
    return out


def _sort_names(names: np.ndarray, cover: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names by their first cover names. A rank is the number of smaller suffixes, so only ties are sorted again."""
    count = np.bincount(names)
    begin = np.cumsum(count) - count
    rank, step = begin[names], 1
    tied = np.flatnonzero(count[names] > 1)
    while step < cover and len(tied):
        after = np.zeros(len(tied), np.int64)
        inside = tied + step < len(rank)
        after[inside] = rank[tied[inside] + step] + 1
        own = rank[tied]
        order = np.argsort(own << np.int64(32) | after) if len(rank) < 1 << 31 else np.lexsort((after, own))
        tied, own, after = tied[order], own[order], after[order]
        group = np.ones(len(tied), bool)
        group[1:] = own[1:] != own[:-1]
        new = group.copy()
        new[1:] |= after[1:] != after[:-1]
        at = np.arange(len(tied))
        head, sub = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = own + sub - head
        alone = new & np.append(new[1:], True)
        tied, step = tied[~alone], 2 * step
    return rank


def suffix_order(text: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[np.ndarray]:
    """Blocks of the positions of text in the order of their suffixes' first depth symbols. text: int16 symbols from 0 on, 0 only as the separator, which is also last."""
    n = len(text)
    if not n:
        return
    if text[-1] != 0:
        raise ValueError("the text must end with the separator")
    kind = np.dtype(np.int32 if n < 2**31 - 1 else np.int64)
    symbols = int(text.max()) + 1
    s = _types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(kind) + kind.type(1)
    del s

    def by_symbol(at: np.ndarray) -> list[np.ndarray]:
        symbol = text[at]
        order = np.argsort(symbol, kind="stable")
        return np.split(at[order], np.searchsorted(symbol[order], np.arange(1, symbols)))

    if len(lms) > 1:
        _, out_s = _induce(text, by_symbol(lms), symbols, kind, budget)
        mark = np.zeros(n, bool)
        mark[lms] = True
        parts = []
        for q in out_s.queues:
            a = q.all()[::-1]
            parts.append(a[mark[a]])
        order = np.concatenate(parts)  # LMS substrings in order
        del mark, parts, out_s
        index = np.zeros(n, kind)
        index[lms] = np.arange(len(lms))
        number = index[order]
        del index
        length = np.append(np.diff(lms), 1)[number]
        same = length[1:] == length[:-1]
        alive, k = np.flatnonzero(same), 0
        while len(alive):
            a, b = order[alive], order[alive + 1]
            eq = text[np.minimum(a + k, n - 1)] == text[np.minimum(b + k, n - 1)]
            same[alive[~eq]] = False
            k += 1
            alive = alive[eq & (k <= length[alive])]
        name = np.concatenate(([0], np.cumsum(~same)))
        names = np.empty(len(lms), np.int64)
        names[number] = name
        rank = _sort_names(names, depth // 2 + 2)  # a name covers two symbols or more
        lms = lms[np.argsort(rank, kind="stable")]
    out_l, out_s = _induce(text, by_symbol(lms), symbols, kind, budget)
    for c in range(symbols):
        while (a := out_l.queues[c].pop()) is not None:
            yield a
        if len(a := out_s.queues[c].all()):
            yield a[::-1]


def repeated_windows(strings: np.ndarray, sizes: np.ndarray, ids: np.ndarray, width: int, budget: int = BUDGET) -> np.ndarray:
    """For every window of width bytes of every string, in order, whether the same bytes are also in a string with a smaller id.

    strings: the bytes end to end; sizes: of each string, width or more; ids: of each string.
    """
    n = len(sizes)
    sizes = np.asarray(sizes, np.int64)
    if not n:
        return np.zeros(0, bool)
    text = np.zeros(len(strings) + n, np.int16)
    raw = np.zeros(len(text) + 8, np.uint8)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside], raw[: len(text)][inside] = strings.astype(np.int16) + np.int16(1), strings
    del inside
    first = np.cumsum(sizes + 1) - (sizes + 1)
    count = sizes - width + 1
    begin = np.cumsum(count) - count
    # position -> number of its window, or -1
    total = int(count.sum())
    kind = np.int32 if len(text) < 2**31 - 1 else np.int64
    window = np.full(len(text), -1, kind)
    window[np.repeat((first - begin).astype(kind), count) + np.arange(total, dtype=kind)] = np.arange(total, dtype=kind)
    order = np.concatenate([a[window[a] >= 0] for a in suffix_order(text, width, budget)])
    wide = np.ndarray((len(text),), "<u8", buffer=raw.data, strides=(1,))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, width - 7, 8), *([width - 8] if width >= 8 and width % 8 else [])] if width >= 8 else []:
        x = wide[order + k]
        same &= x[1:] == x[:-1]
    if width < 8:
        for k in range(width):
            x = raw[order + k]
            same &= x[1:] == x[:-1]
    number = window[order]
    of = np.repeat(np.asarray(ids, np.int64), count)[number]
    new = np.concatenate(([True], ~same))
    least = np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(total, bool)
    out[number] = of > least
    return out
