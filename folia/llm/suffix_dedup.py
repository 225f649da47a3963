"""Exact substring removal over a corpus by suffix arrays from external induced sorting.

Every byte that some repeated ``window``-byte string covers is removed.  A window
belongs to its smallest ``anchor``-byte gram (by hash, leftmost of equals), which
depends on its bytes only, so equal windows have equal anchors wherever they
are.  Neighbouring windows of one anchor form a run, a few hundred bytes that
are kept together.  Anchors seen once repeat nothing.  Runs that are equal as a
whole are one text with a count.  The different runs of an anchor are laid end
to end in shards of whole anchors and sorted by external induced sorting; windows
whose common prefix reaches the window's length repeat.  The anchor itself is one
symbol there, as it is the same in all.  Results go back to every run.

An anchor with very many different runs (a line that thousands of documents
share, each with other neighbours) is dealt by a second anchor: the smallest gram
of the longer side of the window outside the first one.  Equal windows have equal
second anchors, so no match is lost, and runs whose neighbours differ part ways.
A shard goes to the task's disk as it comes; the sorter's queues, its texts and
its recursion are given less memory than a shard takes.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import cut_table
from folia.llm.induced_sort import Workspace, induced_sort

WINDOW, ANCHOR = 200, 80
#: Bytes that a task hashes together, symbols of a shard, different runs of an anchor beyond which it is dealt again, bytes of a second anchor.
CHUNK_BYTES, SHARD_ROWS, CUT_RUNS, SECOND = 1_500_000, 4_000_000, 2_000, 24
_LOW = np.uint64((1 << 30) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64."""

    def __init__(self):
        self.n, self.up, self.down = 0, np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = n
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, dtype=np.uint64))) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    y[:n] = x
    y = y.reshape(-1, w)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchored_runs(parts: list[bytes], powers: Powers, window: int = WINDOW, anchor: int = ANCHOR):
    """(part, first start, last start, anchor place, anchor hash) arrays over parts of at least ``window`` bytes, and the joined bytes."""
    data = b"".join(parts)
    n = len(data)
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * down[:n], out=total[1:])
    h = (total[anchor:] - total[:-anchor]) * up[: n - anchor + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    best = (_slide_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - anchor + 1) & _LOW).astype(np.int64)
    ends = np.cumsum([len(x) for x in parts])
    starts = np.arange(len(best))
    part = np.searchsorted(ends, starts, "right")
    at = np.flatnonzero(starts + window <= ends[part])
    change = np.flatnonzero((best[at[1:]] != best[at[:-1]]) | (part[at[1:]] != part[at[:-1]])) + 1
    first, last = at[np.append(0, change)], at[np.append(change - 1, len(at) - 1)]
    return data, part[first], first, last, best[first], h[best[first]]


def _pieces(texts: list[str | None], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes); long texts in pieces that overlap by a window less a byte."""
    held, size = [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        for a in range(0, max(0, len(raw) - window + 1), CHUNK_BYTES):
            held.append((i, a, raw[a : a + CHUNK_BYTES + window - 1]))
            size += len(held[-1][2])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _keys(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, n): anchors with their number of runs in a chunk."""

    def run(batches):
        powers = Powers()
        for b in batches:
            for group in _pieces(b.column("text").to_pylist(), window):
                key, n = np.unique(anchored_runs([x for _, _, x in group], powers, window, anchor)[-1].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long")


def _runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, full, row, s, e, p): each run's anchor, digest, text, starts and anchor place."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        powers = Powers()
        for b in batches:
            name = b.column("row").to_numpy()
            for group in _pieces(b.column("text").to_pylist(), window):
                data, part, first, last, place, key = anchored_runs([x for _, _, x in group], powers, window, anchor)
                view = memoryview(data)
                full = np.array([xxh3_64_intdigest(view[a : z + window]) for a, z in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
                begin = np.cumsum([0, *(len(x) for _, _, x in group[:-1])])
                shift = np.array([a for _, a, _ in group])[part] - begin[part]
                owner = name[np.array([i for i, _, _ in group])[part]]
                columns = [key.view(np.int64), full.view(np.int64), owner, *((x + shift).astype(np.int32) for x in (first, last, place))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "full", "row", "s", "e", "p"])

    return rows.select("row", "text").mapInArrow(run, "key long, full long, row long, s int, e int, p int")


_TIMES = np.array([pow(int(_BASE), i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def second_anchors(run: bytes, place: int, count: int, window: int, anchor: int, size: int = SECOND) -> list[tuple[int, int, int]]:
    """(second anchor, first, last start) of neighbouring windows of a run; ``place`` is the first anchor's place in it."""
    if len(run) < size or window - anchor < 2 * size:
        return [(1, 0, count - 1)]
    raw = np.frombuffer(run, dtype=np.uint8)
    grams = (np.lib.stride_tricks.sliding_window_view(raw, size).astype(np.uint64) * _TIMES[:size]).sum(axis=1, dtype=np.uint64)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    j = np.arange(count)
    left = place - j >= (window - anchor) // 2
    code = np.zeros(count, dtype=np.uint64)
    if left.any():  # grams from the window's start up to the anchor
        lowest = np.minimum.accumulate(grams[: place - size + 1][::-1])[::-1]
        code[left] = lowest[j[left]]
    if not left.all():  # grams from the anchor's end up to the window's
        lowest = np.minimum.accumulate(grams[place + anchor :])
        code[~left] = lowest[j[~left] + window - size - place - anchor]
    code = (code >> np.uint64(2)).astype(np.int64) * 2 + left
    edges = np.flatnonzero(code[1:] != code[:-1]) + 1
    return [(int(code[lo]) or 1, int(lo), int(hi) - 1) for lo, hi in zip([0, *edges], [*edges, count], strict=True)]


def _slices(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, block, full, from, at, bytes): the text of each listed run, cut by second anchors where the anchor is crowded."""
    size = SECOND

    def run(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode()
                for r in runs:
                    t, count = r["p"] - r["s"], r["e"] - r["s"] + 1
                    cuts = [(0, 0, count - 1)]
                    if r["crowded"]:
                        cuts = second_anchors(raw[r["s"] : r["e"] + window], t, count, window, anchor, size)
                    for block, lo, hi in cuts:
                        got = (r["key"], block, r["full"], lo, t - lo, raw[r["s"] + lo : r["s"] + hi + window])
                        for column, value in zip(out, got, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "block", "full", "lo", "at", "bytes"])

    return rows.mapInArrow(run, "key long, block long, full long, lo int, at int, bytes binary")


class Shard:
    """Slices of whole groups: their symbols on disk, their places in arrays; a slice that its group has already is only counted."""

    def __init__(self, space: Workspace, window: int, anchor: int):
        self.space, self.window, self.anchor = space, window, anchor
        self.path = space.path()
        self.file = open(self.path, "wb")
        self.size = self.n = 0
        self.begin, self.starts, self.marks, self.group = (array("q") for _ in range(4))
        self.owner: list[array] = [array("q") for _ in range(4)]  # slice, key, full, first start
        self.many = bytearray()
        self.groups: dict[tuple, int] = {}
        self.seen: dict[tuple, int] = {}
        self.last: tuple | None = None

    def add(self, key: int, block: int, full: int, lo: int, at: int, raw: bytes) -> None:
        if (key, block) != self.last:
            self.last = (key, block)
            self.seen, self.groups = {}, {}
        digest = (at, hashlib.blake2b(raw, digest_size=16).digest())
        if (k := self.seen.get(digest)) is None:
            gram = raw[at : at + self.anchor]
            if gram not in self.groups:
                self.groups[gram] = self.n
                self.n += 1
            k = self.seen[digest] = len(self.begin)
            symbols = np.frombuffer(raw[:at] + b"\0" + raw[at + self.anchor :] + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
            symbols[at], symbols[-1] = 258, 1
            self.file.write(symbols.tobytes())
            self.begin.append(self.size)
            self.starts.append(len(raw) - self.window + 1)
            self.group.append(self.groups[gram])
            self.many.append(0)
            self.size += len(symbols)
        else:
            self.many[k] = 1
        for column, value in zip(self.owner, (k, key, full, lo), strict=True):
            column.append(value)

    def found(self) -> pa.RecordBatch:
        """(key, full, lo, hi) of every added slice."""
        self.file.close()
        symbols = np.memmap(self.path, dtype=np.uint16, mode="r")
        begin, starts, group = (np.frombuffer(x, dtype=np.int64) for x in (self.begin, self.starts, self.group))
        k, lo, hi = repeated_starts(symbols, begin, starts, group, self.window - self.anchor + 1, self.space)
        del symbols
        os.remove(self.path)
        whole = np.flatnonzero(np.frombuffer(bytes(self.many), dtype=np.uint8))  # a slice that stands twice repeats as a whole
        k, lo, hi = np.concatenate([k, whole]), np.concatenate([lo, np.zeros(len(whole), np.int64)]), np.concatenate([hi, starts[whole] - 1])
        order = np.argsort(k, kind="stable")
        k, lo, hi = k[order], lo[order], hi[order]
        owner, key, full, first = (np.frombuffer(x, dtype=np.int64) for x in self.owner)
        low, high = np.searchsorted(k, owner, "left"), np.searchsorted(k, owner, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(np.arange(len(owner)), n)
        columns = (pa.array(key[rows]), pa.array(full[rows]), pa.array((first[rows] + lo[at]).astype(np.int32)), pa.array((first[rows] + hi[at]).astype(np.int32)))
        return pa.RecordBatch.from_arrays(list(columns), names=["key", "full", "lo", "hi"])


def repeated_starts(symbols: np.ndarray, begin: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int, space: Workspace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last): ranges of window starts whose ``depth`` symbols another start of the text's group also has.

    Texts lie end to end from ``begin`` on, with a mark behind each, and have
    ``starts`` window starts.  They are sorted as suffixes.
    """
    sa, lcp = induced_sort(symbols, space, depth)
    edges = np.zeros(len(symbols) + 1, dtype=np.int8)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + starts, -1)
    is_start = np.cumsum(edges[:-1], dtype=np.int8) > 0
    chosen = np.flatnonzero(is_start[sa])
    place = sa[chosen]
    same = np.cumsum(lcp < depth)[chosen]
    owner = np.searchsorted(begin, place, "right") - 1
    pair = same.astype(np.int64) * (int(groups.max(initial=0)) + 1) + groups[owner]
    order = np.argsort(pair, kind="stable")
    equal = pair[order[1:]] == pair[order[:-1]]
    hit = np.zeros(len(symbols) + 1, dtype=np.int8)
    hit[place[order[1:][equal]]] = 1
    hit[place[order[:-1][equal]]] = 1
    # starts of neighbouring texts never touch: a mark and the window's rest lie between
    step = np.diff(np.append(np.int8(0), hit))
    lows, highs = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    k = np.searchsorted(begin, lows, "right") - 1
    return k, lows - begin[k], highs - begin[k]


def _sorted_shards(slices: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, full, lo, hi): repeated window starts of each run, by suffix arrays of shards of whole groups."""

    def run(batches):
        space = Workspace()
        shard, last = Shard(space, window, anchor), None
        try:
            for b in batches:
                for key, block, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if shard.size > SHARD_ROWS and (key, block) != last:
                        yield shard.found()
                        shard = Shard(space, window, anchor)
                    last = (key, block)
                    shard.add(key, block, *row)
            if shard.size:
                yield shard.found()
        finally:
            space.close()

    return slices.mapInArrow(run, "key long, full long, lo int, hi int")


def repeated_ranges(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(row, a, b)``: byte ranges of ``(row, text)`` rows that repeated windows cover; ``row`` names equal rows alike."""
    many = _keys(rows, window, anchor).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    runs = cut_table(_runs(rows, window, anchor).join(many, "key"))
    kinds = runs.groupBy("key", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "s", "e", "p")).alias("one"))
    # the counts are dealt anew by another form of the key, as are the runs: a join of two plain exchanges can be split where an anchor is crowded
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.bitwise_not("key").alias("_key"), "m")
    listed = kinds.join(mixed, F.bitwise_not(kinds.key) == F.col("_key")).select("one.row", F.struct("key", "full", "one.s", "one.e", "one.p", (F.col("m") > CUT_RUNS).alias("crowded")).alias("run"))
    wanted = listed.groupBy("row").agg(F.collect_list("run").alias("runs"))  # of one text: as many as it has windows at most
    texts = rows.join(wanted, "row").dropDuplicates(["row"]).select("text", "runs")
    slices = _slices(texts, window, anchor).repartition("key", "block").sortWithinPartitions("key", "block")
    found = _sorted_shards(slices, window, anchor)
    whole = kinds.where("n > 1").select("key", "full", F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"))
    single = found.join(kinds.where("n = 1").select("key", "full"), ["key", "full"])
    hits = runs.join(whole.unionByName(single.select("key", "full", "lo", "hi")), ["key", "full"])
    return hits.select("row", (F.col("s") + F.col("lo")).alias("a"), (F.coalesce(F.col("s") + F.col("hi"), F.col("e")) + window).alias("b"))


def merged(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of half-open ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(a, b, strict=True)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def with_removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id``, ``text`` and ``removed`` (byte ranges a, b that may overlap; ``merged`` joins them) of every row.

    A null text counts as empty.  Rows that are equal in id and text are two
    copies: each holds what the other repeats.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(rows.where("octet_length(text) >= %d" % window), window, anchor)
    each = ranges.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("c"))  # of one text
    return rows.join(each, "row", "left").select("doc_id", "text", F.col("c").alias("removed"))


def removal_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, ranges in zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = merged([r["a"] for r in ranges or ()], [r["b"] for r in ranges or ()])
                h, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    h.update(raw[at:lo])
                    at = hi
                h.update(raw[at:])
                for column, value in zip(out, (len(raw), sum(hi - lo for lo, hi in spans), len(spans), h.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_removed(docs, window, anchor).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
