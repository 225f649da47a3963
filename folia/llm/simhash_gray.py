"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within ``DISTANCE`` differing bits are linked, and the components
of the links are the groups.  Distinct fingerprints are sorted by Gray rank,
which puts those with few differences next to each other, and dealt into ranges.
Each range is a leaf of the upper tree and the root of a lower one; every node
holds the bits that all below it share and its ancestors do not.  A search adds
up the differences on the way down and drops a whole group as soon as they pass
the limit: the upper tree (three numbers a range) tells each task which ranges a
fingerprint has to visit, the ranges search their own trees.

Ranges are of like sizes however the fingerprints lie.  A range with many
visitors is dealt to several tasks, each with a copy of the range and a share of
the visitors.  A fingerprint has at most 2,080 others within two bits, and a task
only reports a spanning forest of its links, so a crowd of near copies stays
linear in its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from folia.llm.common import cut, few, sieve
from folia.llm.components import connected_components

WORDS, DISTANCE, SEED = 3, 2, 42
LEAF, FAN = 8, 8
#: Fingerprints of a range; ranges at least, whose number is the same for any smaller input, so that each fingerprint visits as many; rows of one.
RANGE_ROWS, RANGES, LEAST_ROWS = 1 << 20, 64, 256
#: Nodes that a search holds at a time.
HELD = 1 << 20
#: Shingles whose bits are counted together.
COUNT_ROWS = 65_536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the shingles' XXH64 values (unsigned); 0 without any word.

    A-Z are lower-cased; words are split at space and U+0009..U+000D; shingles
    keep repeats; a text of fewer words is one shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxh64_intdigest(b" ".join(found), SEED)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found]).tolist()
    ends = (ends - 1).tolist()
    n = len(found) - words + 1
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[words - 1 :], strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, COUNT_ROWS):
        part = h[i : i + COUNT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence (the inverse of x ^ x >> 1)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayTree:
    """Nodes over items in Gray order; an item is given by the AND and the OR of the values it stands for.

    ``visited`` and ``pruned`` count the nodes and items that searches met and
    dropped.
    """

    def __init__(self, both: np.ndarray, some: np.ndarray):
        levels = [(np.arange(len(both) + 1), both, some)]  # an item is a node of one
        size = LEAF
        while len(levels[-1][1]) > size:
            _, a, o = levels[-1]
            steps = np.append(np.arange(0, len(a), size), len(a))
            levels.append((steps, np.bitwise_and.reduceat(a, steps[:-1]), np.bitwise_or.reduceat(o, steps[:-1])))
            size = FAN
        self.levels = []
        above: np.ndarray | None = None
        for steps, a, o in reversed(levels):
            mask = ~(a ^ o)  # bits that all values below share
            self.levels.append((steps, a, mask if above is None else mask & ~above))
            above = np.repeat(mask, np.diff(steps)) if len(self.levels) < len(levels) else None
        self.visited = self.pruned = 0

    def search(self, queries: np.ndarray, distance: int = DISTANCE, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) numbers of the items whose shared bits differ from the query's in ``distance`` places at most."""
        count = len(self.levels[0][1])
        block = max(8, min(block, HELD // max(1, len(self.levels[-1][1]))))
        for begin in range(0, len(queries) if count else 0, block):
            q = np.arange(begin, min(len(queries), begin + block))
            who, node = np.repeat(q, count), np.tile(np.arange(count), len(q))
            gone = np.zeros(len(who), dtype=np.int64)
            for k, (steps, pattern, own) in enumerate(self.levels):
                gone = gone + np.bitwise_count((queries[who] ^ pattern[node]) & own[node])
                near = gone <= distance
                self.visited += len(near)
                who, node, gone = who[near], node[near], gone[near]
                self.pruned += len(near) - len(who)
                if k < len(self.levels) - 1:
                    size = np.diff(steps)[node]
                    node = np.repeat(steps[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    who, gone = np.repeat(who, size), np.repeat(gone, size)
            yield who, node


class GrayIndex(GrayTree):
    """A tree over distinct values."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        super().__init__(self.values, self.values)

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of the input's order within ``distance`` bits, each once, the smaller value first."""
        for who, at in self.search(self.values, distance):
            later = self.values[at] > self.values[who]
            yield self.order[who[later]], self.order[at[later]]


class Forest:
    """Keeps of the pairs it is given those that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def take(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


def with_fingerprints(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` of every row (fp as a signed long), after any ``carry`` columns."""
    rows = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column("_text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _unsigned_rank(fp: str):
    """The Gray rank as a long whose signed order is the rank's unsigned order."""
    x = F.col(fp)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _ranged(distinct: DataFrame, ranges: int, rows: int) -> DataFrame:
    """(part, fp) of ``rows`` rows, written, so that a lost task finds the same ranges again; a file takes several ranges."""
    dealt = distinct.select("fp").where("fp is not null").withColumn("_rank", _unsigned_rank("fp")).repartitionByRange(ranges, "_rank")
    return cut(few(dealt.select(F.spark_partition_id().alias("part"), "fp"), rows))


def _searched(dealt: DataFrame, distance: int) -> DataFrame:
    """Links (src, dst) of (part, salt, kind, fp) rows: kind 0 is the range, 1 its own queries, 2 visitors; rows come sorted."""

    def run(batches):
        last = index = forest = None
        held: list[np.ndarray] = []
        for b in batches:
            part, salt, kind, fp = (b.column(i).to_numpy() for i in range(4))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                if (part[lo], salt[lo]) != last:
                    last, index, forest, held = (part[lo], salt[lo]), None, Forest(), []
                if kind[lo] == 0:
                    held.append(fp[lo:hi])
                    continue
                if index is None:
                    index = GrayIndex(np.concatenate(held) if held else fp[:0])
                queries = fp[lo:hi]
                for who, at in index.search(queries, distance):
                    a, z = queries[who], index.values[at]
                    if kind[lo] == 1:
                        a, z = a[z > a], z[z > a]
                    if got := forest.take(a.view(np.int64), z.view(np.int64)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


def links(distinct: DataFrame, distance: int = DISTANCE, range_rows: int = RANGE_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``(src, dst)`` over distinct ``fp``: edges whose components are those of all links within ``distance`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    spread = min(RANGES, math.ceil(n / least_rows))
    filed = _ranged(distinct, max(1, math.ceil(n / range_rows), spread), n)
    # three numbers for each range, of which there are n / range_rows or a partition's number
    tops = sorted((r.part, r.a, r.o, r.n) for r in filed.groupBy("part").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o"), F.count(F.lit(1)).alias("n")).collect())
    names = np.array([t[0] for t in tops], dtype=np.int64)
    bits = [np.array([t[i] for t in tops], dtype=np.int64).view(np.uint64) for i in (1, 2)]
    tree = spark.sparkContext.broadcast((names, GrayTree(*bits)) if tops else None)

    def visits(b):
        """(query number, place of the range) of the ranges from the fingerprint's own one on."""
        names, upper = tree.value
        own, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        got = list(upper.search(fp, distance))
        who, at = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])
        on = names[at] >= own[who]
        return own, fp.view(np.int64), who[on], at[on], names

    def counted(batches):
        for b in batches:
            if b.num_rows:
                _, _, _, at, names = visits(b)
                part, k = np.unique(names[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(k.astype(np.int64))], names=["part", "k"])

    met = {r.part: r.k for r in filed.mapInArrow(counted, "part long, k long").groupBy("part").agg(F.sum("k").alias("k")).collect()} if tops else {}
    share = max(least_rows, math.ceil(n / max(1, len(tops)))) * 4
    salts = spark.sparkContext.broadcast(np.array([max(1, math.ceil(met.get(t[0], 0) / share)) for t in tops], dtype=np.int64))

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                own, fp, who, at, names = visits(b)
                many = salts.value
                place = np.searchsorted(names, own)
                times = many[place]
                copy = np.repeat(np.arange(len(fp)), times)
                salt = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
                where = fp[who].view(np.uint64) % np.uint64(1_000_003) % many[at].astype(np.uint64)
                kind = np.where(names[at] == own[who], 1, 2)
                columns = (np.concatenate([own[copy], names[at]]), np.concatenate([salt, where.astype(np.int64)]), np.concatenate([np.zeros(len(copy), np.int64), kind]), np.concatenate([fp[copy], fp[who]]))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "salt", "kind", "fp"])

    rows = filed.select(F.col("part").cast("long"), "fp").mapInArrow(dealt, "part long, salt long, kind long, fp long")
    return _searched(rows.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind"), distance)


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows stay.  A row of a null id links others as well as any; its
    component is null only where no row that can be reached has an id.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    marked = cut(with_fingerprints(docs, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = connected_components(links(distinct))
    joined = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("_c"))
    least = joined.groupBy("_c").agg(F.min("rep").alias("component_id"))
    named = cut(joined.join(least, "_c").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id that can be reached) of every row, as ``groups``."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ROW_NAME = ("_name_1", "_name_2")


def row_name(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit name of each row's id and text; rows that are equal in both have one name."""
    return docs.withColumns(dict(zip(ROW_NAME, (F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")), strict=True)))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without all but one row of each group: that of the smallest id (rows without id come last), then by name.

    Null and empty texts are one group; of repeated rows one stays; an empty
    table stays empty.
    """
    fp = cut(with_fingerprints(row_name(docs), words, carry=ROW_NAME))
    distinct = cut(fp.select("fp").distinct())
    linked = connected_components(links(distinct))
    named = fp.join(linked, fp.fp == linked.node, "left").withColumn("_c", F.coalesce("component", "fp"))
    first = named.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW_NAME)).alias("m"))
    return only(docs, first.select(*[f"m.{n}" for n in ROW_NAME]))


def only(docs: DataFrame, keep: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``row_name`` is in ``keep``, each name once; ``rows``: how many rows of ``docs`` there are, if known.

    Rows that surely are and have no equals stay where they are; only the others are moved.
    """
    small = (lambda df: df) if rows is None else (lambda df: few(df, rows))
    named, keep = row_name(docs), cut(small(keep))
    counts = named.groupBy(*ROW_NAME).agg(F.count(F.lit(1)).alias("_n"))
    loose = cut(small(counts.join(keep.withColumn("_kept", F.lit(True)), list(ROW_NAME), "left").where("_kept is null or _n > 1").select(*ROW_NAME)))
    moved = sieve(named, loose, list(ROW_NAME)).dropDuplicates(list(ROW_NAME)).join(keep, list(ROW_NAME), "left_semi")
    stay = sieve(named, loose, list(ROW_NAME), inside=False)
    return stay.unionByName(moved).select(*[f"`{c}`" for c in docs.columns])
