"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring tokens; it hashes the selected ones and
ignores the others, so a substituted token under a gap does not hide a hit.
Training positions whose hash a benchmark item also has give a diagonal (item,
offset); the tokens around the hit are then compared position by position, and
an overlap counts if a stretch of at least ``min_tokens`` tokens agrees in four
of five.  Every stretch of 13 tokens or more that does so holds a placement of
one of ``MASKS``.  A shorter item has to be there as a whole; it gets masks of its
own length, each blind to as many of its blocks as it may have changes.

Tokens are what white space divides; a character of a script that is written
without spaces is a token of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import give_back

MASKS = ("11010011", "111101", "1110111")
MIN_TOKENS = 13
#: Bytes of benchmark text up to which its hashes go to every task; beyond, both sides are shuffled by hash.
BROADCAST_BYTES = 16_000_000
#: Text tokens that are hashed together in a task.
CHUNK_TOKENS = 400_000
_EDGE = re.compile(r"^\W+|\W+$")
#: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
COLUMNS = "doc_id long, item_id long, start long, n_tokens long, n_equal long"


def normal(word: str) -> str:
    """A token's form: lower case without marks at its ends; a token of marks only stays as it is."""
    word = word.lower()
    return _EDGE.sub("", word) or word


def words(text: str | None) -> list[str]:
    text = text or ""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


def tokens(text: str | None) -> list[str]:
    return [normal(w) for w in words(text)]


def short_masks(n: int) -> list[str]:
    """Masks of an item of ``n`` tokens: with c changes allowed, all ways to be blind to c of c + 2 blocks."""
    changes = n // 5
    edges = [n * i // (changes + 2) for i in range(changes + 3)] if n > 1 else [0, 1]
    blocks = list(zip(edges, edges[1:], strict=False))
    out = []
    for blind in combinations(range(len(blocks)), changes):
        out.append("".join("0" if k in blind else "1" for k, (lo, hi) in enumerate(blocks) for _ in range(lo, hi)))
    return out


def masks_of(sizes: set[int], masks: tuple[str, ...], min_tokens: int) -> list[tuple[str, int]]:
    """(mask, item size or 0 for any) that items of the given numbers of tokens need."""
    return [(m, 0) for m in masks] + [(m, n) for n in sorted(sizes) if 0 < n < min_tokens for m in short_masks(n)]


def _mix(rows: list[np.ndarray]) -> np.ndarray:
    h = np.zeros_like(rows[0])
    for r in rows:
        h = (h ^ r) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every placement of ``mask`` over token numbers (uint64)."""
    n = len(ids) - len(mask) + 1
    on = [i for i, c in enumerate(mask) if c == "1"]
    return _mix([ids[i : i + n] for i in on]) if n > 0 else np.zeros(0, dtype=np.uint64)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal tokens) of the longest stretch, equal at both ends, that agrees in four of five tokens; the first of equals."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    before, after = total[at], total[at + 1]
    # a start only counts if it is lower than all before it; its end is the last place from which the rest is not lower than it
    starts = np.flatnonzero(before < np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(before)[:-1]]))
    highest = np.maximum.accumulate(after[::-1])[::-1]
    ends = len(at) - 1 - np.searchsorted(highest[::-1], before[starts], "left")
    best = int(np.argmax(at[ends] - at[starts]))
    start, end = int(at[starts[best]]), int(at[ends[best]]) + 1
    return start, end - start, int(equal[start:end].sum())


def overlap(text: np.ndarray, item: np.ndarray, offset: int, min_tokens: int) -> tuple[int, int, int] | None:
    """(start, length, equal tokens) of the agreeing stretch on a diagonal, if it is long enough.

    An item shorter than ``min_tokens`` has to be there as a whole.
    """
    low, high = max(0, offset), min(len(text), offset + len(item))
    start, length, same = best_stretch(text[low:high] == item[low - offset : high - offset])
    return (low + start, length, same) if 0 < length >= min(min_tokens, len(item)) and same * 5 >= length * 4 else None


class Benchmark:
    """Numbers for the benchmark's words (0 is every other word) and its seeds by hash."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS):
        self.min_tokens = min_tokens
        self.words: dict[str, int] = {}
        self.raw: dict[str, int] = {}
        self.items = [(i, np.array([self.words.setdefault(w, len(self.words) + 1) for w in tokens(t)], dtype=np.uint64)) for i, t in sorted(items)]
        self.index = []
        for mask, size in masks_of({len(x) for _, x in self.items}, masks, min_tokens):
            hashes = [seeds(x, mask) if size in (0, len(x)) else np.zeros(0, dtype=np.uint64) for _, x in self.items]
            item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
            h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << self.BITS, dtype=bool)
            bits[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True
            self.index.append((mask, h[order], item[order], at[order], bits))

    def number(self, word: str) -> int:
        got = self.raw.get(word)
        if got is None:
            got = self.words.get(normal(word), 0)
            if len(self.raw) < 200_000:
                self.raw[word] = got
        return got

    def numbers(self, text: str | None) -> np.ndarray:
        found = words(text)
        get, more = self.raw.get, self.number
        got = list(map(get, found))
        return np.array([more(w) if g is None else g for g, w in zip(got, found, strict=True)] if None in got else got, dtype=np.uint64)

    def diagonals(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct (text, item, offset) of verified-to-be hits over texts laid end to end; ``ends`` are their ends."""
        found = []
        for mask, h, item, at, bits in self.index:
            got = seeds(ids, mask)
            if not len(got) or not len(h):
                continue
            maybe = np.flatnonzero(bits[(got & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            low, high = np.searchsorted(h, got[maybe], "left"), np.searchsorted(h, got[maybe], "right")
            maybe, low, n = maybe[high > low], low[high > low], (high - low)[high > low]
            text = np.searchsorted(ends, maybe, "right")
            inside = np.searchsorted(ends, maybe + len(mask) - 1, "right") == text
            maybe, low, n, text = maybe[inside], low[inside], n[inside], text[inside]
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.concatenate([[0], ends[:-1]])[text]
            found.append(np.stack([np.repeat(text, n), item[hit], np.repeat(maybe - begin, n) - at[hit]], axis=1))
        return [tuple(x) for x in np.unique(np.concatenate(found), axis=0).tolist()] if found else []

    def scan(self, texts: list[tuple[int, str | None]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(doc_id, item_id, start, n_tokens, n_equal), one best overlap for each text and item."""
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for doc, text in texts:
            held.append((doc, self.numbers(text)))
            size += len(held[-1][1])
            if size >= CHUNK_TOKENS:
                yield from self._scan(held)
                held, size = [], 0
        yield from self._scan(held)

    def _scan(self, held):
        if not held:
            return
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, offset in self.diagonals(np.concatenate([x for _, x in held]), np.cumsum([len(x) for _, x in held])):
            got = overlap(held[text][1], self.items[item][1], offset, self.min_tokens)
            if got and ((text, item) not in best or _order(got) > _order(best[text, item])):
                best[text, item] = got
        for (text, item), (start, length, same) in sorted(best.items()):
            yield held[text][0], self.items[item][0], start, length, same


def _order(got: tuple[int, int, int]) -> tuple[int, int, int]:
    """Of a text's overlaps with an item the one with most equal tokens counts, then the first, then the shortest."""
    start, length, same = got
    return same, -start, -length


def _items(benchmark: DataFrame) -> DataFrame:
    """Its different (item_id, text) rows without nulls."""
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()


def _small(docs: DataFrame, items: DataFrame, limit: int):
    """The items for every task, if their texts have at most ``limit`` bytes in all; else nothing."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()]) if size <= limit else None


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit name (``_r1``, ``_r2``) of each row's id and text."""
    return docs.withColumns({"_r1": F.xxhash64("doc_id", "text"), "_r2": F.xxhash64("text", F.lit(1), "doc_id")})


def without_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, unchanged, that overlap no benchmark item.

    Null and empty texts stay; rows of a null id are judged by their text, each
    of several equal rows alike; an empty table or benchmark takes nothing away.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    items = _items(benchmark)
    index = _small(docs, items, broadcast_bytes)
    if index is None:
        own = _named(docs)
        found = _found(own.select("_r1", "_r2", "text"), items, masks, min_tokens).select("_r1", "_r2").distinct()
        return own.join(found, ["_r1", "_r2"], "left_anti").select(*docs.columns)
    at, out = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches):
        give_back()
        bench = Benchmark(index.value, masks, min_tokens)
        for b in batches:
            hit = {got[0] for got in bench.scan(list(enumerate(b.column(at).to_pylist())))}
            kept = b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=out)

    return docs.mapInArrow(run, docs.schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document row and benchmark item that overlap: doc_id, item_id, start, n_tokens, n_equal.

    Null ids of items, null or empty texts and items without tokens never
    overlap; a null doc_id stays null; extra columns are ignored; repeated
    documents are each reported, repeated items once, different items of one id
    each.  The result is the same whether the benchmark is sent or shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = _items(benchmark)
    index = _small(docs, items, broadcast_bytes)
    if index is None:
        own = _named(docs)
        found = _found(own.select("_r1", "_r2", "text"), items, masks, min_tokens)
        return own.select("doc_id", "_r1", "_r2").join(found, ["_r1", "_r2"]).select("doc_id", "item_id", "start", "n_tokens", "n_equal")

    def run(batches):
        bench = Benchmark(index.value, masks, min_tokens)
        for b in batches:
            got = list(bench.scan(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "item_id", "start", "n_tokens", "n_equal"])

    return docs.mapInArrow(run, COLUMNS)


def _hashed_words(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in tokens(text)], dtype=np.uint64)


def _found(rows: DataFrame, items: DataFrame, masks: tuple[str, ...], min_tokens: int) -> DataFrame:
    """(_r1, _r2, item_id, start, n_tokens, n_equal) over a benchmark of any size.

    Seeds of both sides are joined by hash, so that a common one can be split
    between tasks; distinct diagonals meet their texts again.
    """
    sized = items.select(F.xxhash64("item_id", "text").alias("_i1"), F.xxhash64("text", F.lit(1), "item_id").alias("_i2"), "item_id", "text")

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({n for t in b.column(0).to_pylist() if (n := len(tokens(t))) < min_tokens}), pa.int64())], names=["n"])

    sizes = {r.n for r in sized.select("text").mapInArrow(lengths, "n long").distinct().collect()}  # fewer than min_tokens numbers
    every = masks_of(sizes, masks, min_tokens)

    def seeded(a: str, b: str, item: bool):
        from xxhash import xxh64_intdigest

        salts = [np.uint64(xxh64_intdigest(f"{m}/{n}")) for m, n in every]

        def run(batches):
            for batch in batches:
                for x, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = _hashed_words(text)
                    parts = [(seeds(ids, m) ^ salt).view(np.int64) for (m, n), salt in zip(every, salts, strict=True) if not item or n in (0, len(ids))]
                    at = np.concatenate([np.arange(len(h)) for h in parts]) if parts else np.zeros(0, dtype=np.int64)
                    h = np.concatenate(parts) if parts else at
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x)), pa.array(np.full(len(h), y)), pa.array(h), pa.array(at)], names=[a, b, "h", "at"])

        return run

    one = rows.dropDuplicates(["_r1", "_r2"])
    a = one.mapInArrow(seeded("_r1", "_r2", False), "_r1 long, _r2 long, h long, at long")
    b = sized.select("_i1", "_i2", "text").mapInArrow(seeded("_i1", "_i2", True), "_i1 long, _i2 long, h long, at long").withColumnRenamed("at", "_at")
    hits = a.join(b, "h").select("_r1", "_r2", "_i1", "_i2", (F.col("at") - F.col("_at")).alias("offset")).distinct()
    meet = hits.join(one, ["_r1", "_r2"]).join(sized.withColumnRenamed("text", "item_text"), ["_i1", "_i2"])

    def check(batches):
        for b in batches:
            out = []
            for r1, r2, i1, i2, item, offset, text, ours in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if got := overlap(_hashed_words(text), _hashed_words(ours), offset, min_tokens):
                    out.append((r1, r2, i1, i2, item, *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["_r1", "_r2", "_i1", "_i2", "item_id", "start", "n_tokens", "n_equal"])

    seen = meet.select("_r1", "_r2", "_i1", "_i2", "item_id", "offset", "text", "item_text").mapInArrow(check, "_r1 long, _r2 long, _i1 long, _i2 long, " + COLUMNS.removeprefix("doc_id long, "))
    best = F.max_by(F.struct("start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("start"), -F.col("n_tokens")))
    return seen.groupBy("_r1", "_r2", "_i1", "_i2", "item_id").agg(best.alias("b")).select("_r1", "_r2", "item_id", "b.start", "b.n_tokens", "b.n_equal")
