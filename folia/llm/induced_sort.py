"""External induced sorting: suffix array and common-prefix values by queues of suffix tuples.

The scheme is that of induced suffix sorting in external memory: the leftmost
S-type positions seed a first induction that sorts and names their substrings,
the names form a shorter string that is sorted in turn, and a second induction
spreads its order to every suffix.  A priority queue keyed by first symbol and
arrival hands out suffixes in order; each carries its position and its common
prefix with the one before.  The common prefix of two suffixes that are induced
into one bucket is one more than the smallest value between their sources, so
it comes with the queue and the text is not compared again.

Whole buckets leave the queue at a time (in waves, where a symbol follows
itself), so every step is an array operation.  A queue that outgrows its memory
writes its buckets to a file of the task and reads each back once, in order; the text
of a shard beyond the limit is mapped from a file.  A shorter string that fits
in memory is sorted there; a longer one is induced again.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Bytes of queued tuples in memory; symbols of a text in memory; names that are sorted in memory.  An ordinary shard passes the first two.
QUEUE_BYTES, TEXT_ROWS, BASE_ROWS = 2 << 20, 1 << 20, 2 << 20
FAR = np.iinfo(np.int32).max


class Workspace:
    """A task's folder for queues and texts; gone when the sort ends.  ``spills``, ``mapped`` and ``depth`` tell what went to disk and how deep."""

    def __init__(self, queue_bytes: int = QUEUE_BYTES, text_rows: int = TEXT_ROWS):
        self.queue_bytes, self.text_rows, self.folder, self.files = queue_bytes, text_rows, "", 0
        self.spills = self.mapped = self.depth = 0

    def path(self) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="induced-")
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def text(self, symbols: np.ndarray) -> np.ndarray:
        if len(symbols) <= self.text_rows:
            return symbols
        self.mapped += 1
        out = np.memmap(self.path(), dtype=symbols.dtype, mode="w+", shape=symbols.shape)
        out[:] = symbols
        return out

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = ""


class Run:
    """A spilled queue: the tuples of all its buckets in one file, in bucket order, each read back once."""

    def __init__(self, path: str, chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]]):
        self.path, self.names = path, np.array(sorted(chunks), dtype=np.int64)
        sizes = [sum(len(p) for p, _ in chunks[b]) for b in self.names.tolist()]
        self.edges, self.gone = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(sizes), dtype=bool)
        self.left, self.kind = int(self.edges[-1]), next(iter(chunks.values()))[0][0].dtype
        with open(path, "wb") as out:
            for k in (0, 1):
                for b in self.names.tolist():
                    for chunk in chunks[b]:
                        out.write(np.ascontiguousarray(chunk[k]).tobytes())
        n, size = self.left, self.kind.itemsize
        self.pos = np.memmap(path, dtype=self.kind, mode="r", shape=(n,))
        self.lcp = np.memmap(path, dtype=np.int32, mode="r", offset=n * size, shape=(n,))

    def take(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        i = int(np.searchsorted(self.names, bucket))
        if i == len(self.names) or self.names[i] != bucket or self.gone[i]:
            return None
        lo, hi = int(self.edges[i]), int(self.edges[i + 1])
        self.gone[i] = True
        self.left -= hi - lo
        return np.array(self.pos[lo:hi]), np.array(self.lcp[lo:hi])

    def close(self) -> None:
        del self.pos, self.lcp
        os.remove(self.path)


class TupleQueue:
    """Buckets of (position, common prefix) chunks in arrival order; what outgrows the memory goes to disk as a run."""

    def __init__(self, space: Workspace):
        self.space, self.held = space, 0
        self.chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.runs: list[Run] = []

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks.setdefault(bucket, []).append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.space.queue_bytes:
            self.space.spills += 1
            self.runs.append(Run(self.space.path(), self.chunks))
            self.chunks, self.held = {}, 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        got = []
        for run in self.runs:
            if (part := run.take(bucket)) is not None:
                got.append(part)
        if got and any(not r.left for r in self.runs):
            for r in self.runs:
                if not r.left:
                    r.close()
            self.runs = [r for r in self.runs if r.left]
        for chunk in self.chunks.pop(bucket, ()):
            got.append(chunk)
            self.held -= chunk[0].nbytes + chunk[1].nbytes
        if not got:
            return None
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low..high] for each pair, both ends included."""
    span = high - low + 1
    level = np.floor(np.log2(span)).astype(np.int64)
    out = np.empty(len(low), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
        if (1 << k + 1) <= len(values):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class _Pass:
    """One sweep over the buckets: pops tuples in order and pushes their predecessors of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, buckets: int, space: Workspace):
        self.text, self.wanted, self.queue = text, wanted, TupleQueue(space)
        self.since = np.zeros(buckets, dtype=np.int32)  # smallest value since a bucket's last tuple
        self.has = np.zeros(buckets, dtype=bool)

    def spread(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """``lcp`` is each tuple's common prefix with the one handed out before it."""
        on = np.flatnonzero(pos > 0)
        on = on[self.wanted[pos[on] - 1]]
        if not len(on):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        before = pos[on] - 1
        target = self.text[before]
        order = np.argsort(target, kind="stable")
        on, before, target = on[order], before[order], target[order]
        first = np.append(True, target[1:] != target[:-1])
        value = np.empty(len(on), dtype=np.int32)
        heads, later = np.flatnonzero(first), np.flatnonzero(~first)
        if len(later):
            value[later] = 1 + range_min(lcp, on[later - 1] + 1, on[later])
        names = target[heads].astype(np.int64)
        lead = np.minimum.accumulate(lcp)
        value[heads] = np.where(self.has[names], 1 + np.minimum(self.since[names], lead[on[heads]]), 0)
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
        ends = np.append(heads[1:], len(on))
        np.minimum(self.since, lead[-1], out=self.since)
        self.since[names] = tail[on[ends - 1] + 1]
        self.has[names] = True
        for b, lo, hi in zip(names.tolist(), heads.tolist(), ends.tolist(), strict=True):
            self.queue.push(b, before[lo:hi], value[lo:hi])


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last symbol is S."""
    n = len(text)
    sign = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64)).astype(np.int8)
    at = np.where(sign != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(sign, 1)[at] > 0, True)


def _runs(text: np.ndarray) -> np.ndarray:
    """How often each symbol follows itself from its place on."""
    n = len(text)
    last = np.append(np.where(text[1:] != text[:-1], np.arange(n - 1), n - 1), n - 1)
    return (np.minimum.accumulate(last[::-1])[::-1] - np.arange(n) + 1).astype(np.int32)


def _induce(text: np.ndarray, small: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, symbols: np.ndarray, buckets: int, space: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes from sorted seeds; ``symbols`` are those in use."""
    owner = text[seeds]
    starts, ends = np.searchsorted(owner, symbols, "left"), np.searchsorted(owner, symbols, "right")
    sweep = _Pass(text, ~small, buckets, space)
    larges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c, lo, hi in zip(symbols.tolist(), starts.tolist(), ends.tolist(), strict=True):
        parts = []
        while (wave := sweep.queue.pop(c)) is not None:
            parts.append(wave)
            sweep.spread(*wave)
        if parts:
            larges[c] = (np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]))
        if hi > lo:
            lcp = seed_lcp[lo:hi].copy()
            lcp[0] = min(runs[larges[c][0][-1]], runs[seeds[lo]]) if parts else 0
            sweep.spread(seeds[lo:hi], lcp)
    sweep = _Pass(text, small, buckets, space)
    order, values = [], []
    for c in symbols[::-1].tolist():
        parts = []
        while (wave := sweep.queue.pop(c)) is not None:
            parts.append(wave)
            sweep.spread(*wave)
        down = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, dtype=seeds.dtype)
        down_lcp = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, dtype=np.int32)
        pos, lcp = larges.pop(c, (down[:0], down_lcp[:0]))
        edge = min(runs[pos[-1]], runs[down[-1]]) if len(pos) and len(down) else 0
        if len(pos):
            back = np.append(np.int32(edge), lcp[:0:-1]).astype(np.int32)  # between each and the next larger one
            sweep.spread(pos[::-1], back)
            first = lcp.copy()
            first[0] = 0
        else:
            first = lcp
        order += [down[::-1], pos]
        up = np.append(np.int32(edge), down_lcp[:0:-1]).astype(np.int32) if len(down) else down_lcp
        values += [up, first]
    order.append(np.array([len(text) - 1], dtype=seeds.dtype))  # the end mark, which nothing induces
    values.append(np.zeros(1, dtype=np.int32))
    return np.concatenate(order[::-1]), np.concatenate(values[::-1])


def doubled(names: np.ndarray, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of a string's suffixes in memory, by doubling, up to ``depth`` names."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    levels, size = [rank], 1
    order = np.argsort(rank, kind="stable")
    while size < n and (depth is None or size < depth) and rank.max() < n - 1:
        key = (rank + 1) * (n + 2)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        levels.append(rank)
        size *= 2
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp[1:], b + lcp[1:]
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        lcp[1 + same] += np.minimum(1 << k, n - np.maximum(x[same], y[same]))
    return order, lcp


def induced_sort(text: np.ndarray, space: Workspace, depth: int | None = None, base_rows: int = BASE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before) of symbols >= 1; an end mark 0 is added and left out again.

    With ``depth``, suffixes that agree on so many symbols may stand in any order
    among themselves and their value is at least ``depth``.
    """
    if not len(text):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    kind = np.int32 if len(text) < 2**31 - 2 else np.int64
    wide = np.append(text, 0).astype(np.uint16 if text.max() < 2**16 else np.int64)
    t = space.text(wide)
    buckets = int(wide.max()) + 1
    symbols = np.flatnonzero(np.bincount(wide, minlength=buckets)) if buckets < 1 << 24 else np.unique(wide)
    small, runs = _types(wide), _runs(wide)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if len(lms) == 1:  # only the end mark
        sa, lcp = _induce(t, small, runs, lms, np.zeros(1, dtype=np.int32), symbols, buckets, space)
        return sa[1:], lcp[1:]
    seeds = lms[np.argsort(wide[lms], kind="stable")]
    sa, lcp = _induce(t, small, runs, seeds, np.ones(len(seeds), dtype=np.int32), symbols, buckets, space)
    is_lms = np.zeros(len(wide), dtype=bool)
    is_lms[lms] = True
    at = np.flatnonzero(is_lms[sa])
    ordered = sa[at]
    near = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))  # smallest value since the one before
    place = np.full(len(wide), 0, dtype=kind)
    place[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms), 1) + 1  # of each substring, both ends included
    length = size[place[ordered]]
    fresh = np.append(True, (near[1:] < length[1:]) | (length[1:] != length[:-1]))
    names = np.empty(len(lms), dtype=np.int64)
    names[place[ordered]] = np.cumsum(fresh)
    del sa, lcp, is_lms
    if len(lms) <= base_rows or names.max() == len(lms):
        order, common = doubled(names, None if depth is None else depth // 2 + 2)
    else:
        space.depth += 1
        order, common = induced_sort(names, space, None if depth is None else depth // 2 + 2, base_rows)
    a, b = order[:-1], order[1:]
    edge = np.append(lms, len(wide)).astype(np.int64)
    same = edge[np.minimum(b + common[1:], len(lms))] - edge[b]  # the names that agree, in symbols
    same = np.minimum(same, edge[np.minimum(a + common[1:], len(lms))] - edge[a])
    value = np.append(0, same)
    todo = np.arange(1, len(order))
    if depth is not None:
        todo = todo[value[todo] < depth]
    while len(todo):  # and what agrees of the first names that do not
        x, y = lms[order[todo - 1]] + value[todo], lms[order[todo]] + value[todo]
        ok = (x < len(wide)) & (y < len(wide))
        todo, x, y = todo[ok], x[ok], y[ok]
        todo = todo[wide[x] == wide[y]]
        value[todo] += 1
    sa, lcp = _induce(t, small, runs, lms[order], np.minimum(value, FAR).astype(np.int32), symbols, buckets, space)
    return sa[1:], lcp[1:]
