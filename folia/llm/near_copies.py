"""Near copies by word shingles: every pair of texts with a Jaccard similarity of 0.8 or more is linked.

Texts with equal shingle sets are one node.  The first candidates are the links
of the SimHash index (``simhash_gray``) over fingerprints of the same shingles.
At a similarity of 0.8 fingerprints differ in ten bits of 64 on average, which no
index can search at size, so the rest comes from prefix files: two sets of
similarity t share one of the first n - ceil(t n) + 1 members in any order common
to all, so each node is filed under these and no link can be lost.  The order
puts shingles that a sample holds often last, and the rest by hash: a common line
fills no file unless a text is made of such lines.  Candidates are compared by a
parity bitmap of two to four bits a member, whose differing bits are never more
than the differing members, and verified by their texts if it lets them pass.

Texts are moved for one candidate of each node first; what that links needs no
more.  A file of more than ``FILE_ROWS`` nodes is first compared with its
smallest node only, which is the same one in the many files that a group of
copies shares, so a file makes fewer than two rows a node however large it is.
What that links is left alone; all pairs between different components follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folia.llm.common import cut, cut_table, drop_table, few, give_back, sieve, sweep
from folia.llm.components import connected_components
from folia.llm.simhash_gray import ROW_NAME, links, only, row_name

#: Similarity PART / WHOLE; nodes of a file that are all compared (beyond 4 their pairs are more than 2 n - 1, the rows of a larger file).
WORDS, PART, WHOLE = 5, 4, 5
FILE_ROWS = 4
#: Texts of the sample, and how many of them a common shingle is in.
SAMPLE_DOCS, COMMON = 10_000, 3
#: Pairs that are put out together, and pairs whose sets are compared together.
PAIR_ROWS, SET_ROWS = 50_000, 256
#: Members that one task compares with a node's text.
STAR_ROWS = 2_000
_FACTORS = np.array([xxh64_intdigest(bytes([i])) | 1 for i in range(WORDS)], dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a text of fewer words is one run. Words as in op2's fingerprint."""
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return np.array([xxh64_intdigest(b" ".join(found), len(found) + 1)] if found else [], dtype=np.uint64)
    seen = {w: xxh64_intdigest(w) for w in set(found)}
    h = np.array([seen[w] for w in found], dtype=np.uint64)
    n = len(h) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        out += h[i : i + n] * _FACTORS[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The members of which similar sets share one; ``common`` is sorted and comes last."""
    n = len(found)
    if not n:
        return found
    often = np.zeros(n, dtype=bool)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~often], found[often]])[: n - (PART * n + WHOLE - 1) // WHOLE + 1]


def parity(found: np.ndarray) -> bytes:
    """The set's bitmap: a bit is on for an odd number of members; two to four bits a member, a power of two in all."""
    size = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as one of ``size`` bytes: halves laid over each other keep their parity."""
    out = np.frombuffer(bits, dtype=np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def fingerprint(found: np.ndarray) -> int:
    """SimHash of the set as a signed long: a bit is on if over half of the members have it."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 65_536):
        part = found[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(found)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of many texts of a sample, sorted; the order serves speed only, so any sample is right."""
    step = max(1, -(-size // SAMPLE_DOCS))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").distinct()

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["h"])

    often = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    # a bounded number: the members of the sampled texts, at most a third of them
    return np.sort(often.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def _marked(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """The named rows with node (digest of the shingle set), n (its size), bits (bitmap), fp (SimHash) and keys (prefix)."""
    order = docs.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", *ROW_NAME, "text", "node", "n", "bits", "fp", "keys"]

    def run(batches):
        give_back()
        for b in batches:
            for lo in range(0, b.num_rows, SET_ROWS):
                part = b.slice(lo, SET_ROWS)
                sets = [shingles(x.as_py()) for x in part.column("text")]
                node = np.array([xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
                keys = [prefix(x, order.value).view(np.int64) for x in sets]
                made = [pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x) for x in sets], pa.binary()), pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    rows = row_name(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *ROW_NAME, "text")
    return rows.mapInArrow(run, "doc_id long, _name_1 long, _name_2 long, text string, node long, n long, bits binary, fp long, keys array<long>")


def _files(batches):
    """Column arrays of each run of two or more rows of one key; rows come sorted by key, the first column."""
    held = None
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        edges = np.append(0, np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1)
        for k in np.flatnonzero(np.diff(edges) > 1):
            yield [c[edges[k] : edges[k + 1]] for c in columns]
        held = [c[edges[-1] :] for c in columns]
    if held is not None and len(held[0]) > 1:
        yield held


def _put(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _collected(pairs):
    """Batches of distinct pairs from pairs of arrays."""
    a, b, size = [], [], 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        size += len(x)
        if size >= PAIR_ROWS:
            yield _put(a, b)
            a, b, size = [], [], 0
    if size:
        yield _put(a, b)


def _near_bits(x: bytes, y: bytes, n: int, m: int) -> bool:
    size = min(len(x), len(y))
    gone = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return gone * (WHOLE + PART) <= (n + m) * (WHOLE - PART)


def _near_sizes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y) * WHOLE >= np.maximum(x, y) * PART


def _first_pairs(filed: DataFrame, file_rows: int) -> DataFrame:
    """(key, a, b): all pairs of small files and the smallest node's pairs of large ones, without key; (key, node, n) of large ones."""

    def large(key, node, n):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, n)], names=["key", "a", "b"])

    def run(batches):
        whole = []

        def pairs():
            for key, node, n in _files(batches):
                if len(node) <= file_rows:
                    i, j = np.triu_indices(len(node), 1)
                else:
                    whole.append((key, node, n))
                    i, j = np.full(len(node), np.argmin(node)), np.arange(len(node))
                ok = _near_sizes(n[i], n[j]) & (i != j)
                if ok.any():
                    yield node[i[ok]], node[j[ok]]

        for b in _collected(pairs()):
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), *b.columns], names=["key", "a", "b"])
            while whole:
                yield large(*whole.pop())
        while whole:
            yield large(*whole.pop())

    return filed.mapInArrow(run, "key long, a long, b long")


def _other_pairs(filed: DataFrame) -> DataFrame:
    """(a, b) of large files (key, node, n, component, bits): pairs of different components that the bitmap lets pass."""

    def pairs(batches):
        for _, node, n, component, bits in _files(batches):
            if (component == component[0]).all():
                continue
            order = np.argsort(n, kind="stable")
            node, n, component, bits = node[order], n[order], component[order], bits[order]
            maps: dict[int, np.ndarray] = {}
            ends = np.searchsorted(n, n * WHOLE // PART, "right")
            for i in range(len(n) - 1):
                size = len(bits[i])
                if size not in maps:
                    maps = {size: np.stack([folded(x, size) if len(x) >= size else np.zeros(size, dtype=np.uint8) for x in bits])}
                words = maps[size]
                j = np.arange(i + 1, ends[i])
                j = j[component[j] != component[i]]
                gone = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
                j = j[gone * (WHOLE + PART) <= (n[j] + n[i]) * (WHOLE - PART)]
                if len(j):
                    yield np.full(len(j), node[i]), node[j]

    return filed.mapInArrow(lambda batches: _collected(pairs(batches)), "a long, b long").distinct()


def _passed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs that the bitmaps let pass."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches):
        for b in batches:
            n, m, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            good = [min(p, q) * WHOLE >= max(p, q) * PART and _near_bits(u, v, p, q) for p, q, u, v in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, marked: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are similar enough; the texts of all b of an a follow that of a, in shares of ``STAR_ROWS``."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_ROWS)).cast("int").alias("shares"))
    members = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.col("b").alias("node"))
    centers = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"))
    wanted = members.unionByName(centers).join(firsts, "node")
    texts = sieve(marked.select(*ROW_NAME, "text"), wanted, list(ROW_NAME))
    rows = wanted.join(texts, list(ROW_NAME)).select("a", "share", "node", "text")

    def run(batches):
        center, ours, seen = None, None, None
        for b in batches:
            good_a, good_b = [], []
            for a, share, node, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if (a, share) != center:
                    center, ours, seen = (a, share), shingles(text.as_py()), None  # the center comes first
                    continue
                if node in (a, seen):  # a repeated row
                    continue
                seen, theirs = node, shingles(text.as_py())
                same = len(np.intersect1d(ours, theirs, assume_unique=True))
                if same * WHOLE >= (len(ours) + len(theirs) - same) * PART:
                    good_a.append(a)
                    good_b.append(node)
            if good_a:
                yield pa.RecordBatch.from_arrays([pa.array(good_a), pa.array(good_b)], names=["a", "b"])

    ordered = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("node") != F.col("a"), "node")
    return ordered.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, marked: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs that are similar enough.

    One candidate of each node is tried first, the smallest.  Pairs whose ends
    have come to the same node by two such links need not be tried.
    """
    first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = cut(_verified(first, marked, firsts))
    sweep(pairs.sparkSession)
    up = found.select(F.col("b").alias("node"), F.col("a").alias("up"))
    over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    tops = cut(up.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("top")))
    end = lambda side: tops.select(F.col("node").alias(side), F.col("top").alias(f"top_{side}"))
    apart = F.coalesce("top_a", "a") != F.coalesce("top_b", "b")
    left = cut(pairs.join(first, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left").where(apart).select("a", "b"))
    if not left.isEmpty():
        found = cut(found.unionByName(_verified(left, marked, firsts)))
    sweep(pairs.sparkSession)
    return found


def components(docs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """(doc_id, ``ROW_NAME``, component) of every row; null and empty texts are one component."""
    size = docs.count()
    marked = cut_table(_marked(docs, _common(docs, size)))
    firsts = cut(few(marked.groupBy("node").agg(F.min(F.struct(*ROW_NAME)).alias("m"), F.min("n").alias("n"), F.min("fp").alias("fp")).select("node", *[f"m.{n}" for n in ROW_NAME], "n", "fp"), size))
    bits = marked.groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    sweep(docs.sparkSession)
    # candidates of the SimHash index, over one node of each fingerprint
    heads = cut(few(firsts.groupBy("fp").agg(F.min("node").alias("head")), size))
    ends = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"h_{side}"))
    close = links(heads.select("fp")).join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("h_src").alias("a"), F.col("h_dst").alias("b"))
    alike = firsts.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # and of the prefix files
    nodes = marked.groupBy("node").agg(F.min("n").alias("n"), F.min("keys").alias("keys"))
    filed = nodes.select(F.explode("keys").alias("key"), "node", "n").repartition("key").sortWithinPartitions("key")
    first = cut(_first_pairs(filed, file_rows))
    every = close.unionByName(alike).unionByName(first.where("key is null").select("a", "b"))
    sweep(docs.sparkSession)
    pairs = cut(_passed(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), bits))
    sweep(docs.sparkSession)
    names = firsts.select("node", *ROW_NAME)
    found = _linked(pairs, marked, names)
    linked = connected_components(found, "a", "b")
    rest = first.where("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("n"))
    if not rest.isEmpty():
        named = rest.join(linked, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
        wide = named.join(mixed, "key").join(bits.select("node", "bits"), "node").select("key", "node", "n", "component", "bits")
        more = _other_pairs(wide.repartition("key").sortWithinPartitions("key"))
        more = cut(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not more.isEmpty():
            linked = connected_components(found.unionByName(_linked(more, marked, names)), "a", "b")
    out = cut(few(marked.select("doc_id", *ROW_NAME, "node").join(linked, "node", "left").select("doc_id", *ROW_NAME, F.coalesce("component", "node").alias("component")), size))
    drop_table(marked)
    return out


def one_of_each(docs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """``docs`` without all but one row of each component: that of the smallest id (rows without id come last), then by name.

    Null and empty texts are one component; of repeated rows one stays; an empty
    table stays empty; extra columns stay as they are.
    """
    named = components(docs, file_rows)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW_NAME)).alias("m"))
    return only(docs, first.select(*[f"m.{n}" for n in ROW_NAME]), named.count())
