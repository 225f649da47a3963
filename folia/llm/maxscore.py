"""Exact top-k search by MaxScore over the dimensions of integer vectors.

A term is a dimension with a sign.  Its posting list holds the vectors that have
that sign there, largest value first; it adds to a query of the same sign there
and takes from one of the other.  A list's bound is its first value times the
query's.  With the k-th best score so far as threshold, the lists of a query that
add are split by bound: as many of the weakest as sum to less than the threshold
are non-essential, since a vector that is in none of the others cannot enter.
The essential lists are traversed, strongest first; each only down to the value
at which a vector that was in no list before it can no longer reach the
threshold.  What they yield is then probed in the other dimensions, as long as
its score so far with the rest's bounds is competitive.  Shards are merged by
rank.  Dense vectors are in half of all lists, so there the cut inside a list
and the probes save the work, not the lists that are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Vectors in a shard and queries in a block: what one task holds.
SHARD_ROWS, QUERY_ROWS = 8192, 2048
SEED_ROWS, BLOCK_ROWS, PROBE = 64, 2048, 16


def _matrix(vectors) -> np.ndarray:
    """Rows padded with zeros: a missing component is an absent term."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Postings:
    """A shard's posting lists: for each dimension the rows with a positive and with a negative value, strongest first."""

    def __init__(self, vectors: np.ndarray):
        self.lists: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = []
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            order = np.argsort(-column, kind="stable")
            up = order[: int((column > 0).sum())]
            down = order[len(order) - int((column < 0).sum()) :][::-1]
            self.lists.append(((up, column[up]), (down, -column[down])))
        self.read = self.skipped = 0

    def adding(self, q: np.ndarray) -> list[tuple[object, int, np.ndarray, np.ndarray]]:
        """(bound, dimension, rows, products) of the lists that add to ``q``, strongest first; products are falling."""
        out = []
        for d in np.flatnonzero(q != 0).tolist():
            rows, values = self.lists[d][0 if q[d] > 0 else 1]
            if len(rows):
                out.append((values[0] * abs(q[d]), d, rows, values))
        return sorted(out, key=lambda t: -t[0])


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, postings: Postings | None = None):
    """``(query_id, vec_id, score)`` rows of each query's ``k`` best in this shard, by score then id; scores are integers of any size."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    top = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0))
    if top * top * max(width, 1) >= 2.0**53:  # beyond exact doubles: integers of any size
        vectors, queries = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (vectors, queries))
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    lists = postings or Postings(vectors)
    high, low = (vectors.max(axis=0), vectors.min(axis=0)) if len(ids) else (np.zeros(width), np.zeros(width))
    out_q, out_v, out_s = [], [], []

    def best_of(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if scores.dtype == object:
            best = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k], dtype=np.int64)
        else:
            best = np.lexsort((rows, -scores))[:k]  # rows are in id order
        return rows[best], scores[best]

    for qid, q in zip(query_ids, queries, strict=True):
        seen = ids == qid  # of the query's own id, and rows that were taken from a list
        terms = lists.adding(q)
        bounds = [t[0] for t in terms]
        weaker = [sum(bounds[i:]) for i in range(len(bounds) + 1)]  # what the lists from i on can add
        # the first rows of the strongest lists give a threshold
        start = np.unique(np.concatenate([t[2][: max(1, SEED_ROWS // (i + 1))] for i, t in enumerate(terms[:4])])) if terms else np.zeros(0, dtype=np.int64)
        start = start[~seen[start]]
        seen[start] = True
        found_i, found_s = best_of(start, vectors[start] @ q)
        spread = np.maximum(q * high, q * low)
        probes = np.argsort(-np.abs(spread), kind="stable")
        after = np.append(np.cumsum(spread[probes][::-1])[::-1], 0)  # bounds of the dimensions from here on
        for i, (_, d, rows, values) in enumerate(terms):
            threshold = found_s[-1] if len(found_i) == k else None
            if threshold is not None and weaker[i] < threshold:  # this list and all weaker ones are non-essential
                lists.skipped += len(terms) - i
                break
            if threshold is not None:  # a row not seen before is in no stronger list
                keep = values * abs(q[d]) + weaker[i + 1] >= threshold
                rows = rows[: int(keep.sum())]  # products fall along the list
            lists.read += len(rows)
            rows = rows[~seen[rows]]
            seen[rows] = True
            for lo in range(0, len(rows), BLOCK_ROWS):
                part = rows[lo : lo + BLOCK_ROWS]
                scores = vectors[part][:, :0].sum(axis=1)
                threshold = found_s[-1] if len(found_i) == k else None
                for done in range(0, width, PROBE):
                    if threshold is not None:
                        alive = scores + after[done] >= threshold
                        part, scores = part[alive], scores[alive]
                        if not len(part):
                            break
                    step = probes[done : done + PROBE]
                    scores = scores + vectors[np.ix_(part, step)] @ q[step]
                found_i, found_s = best_of(np.concatenate([found_i, part]), np.concatenate([found_s, scores]))
        else:
            # rows in no adding list score 0 or less and still count where places are free or the last is not above
            if len(found_i) < k or found_s[-1] <= 0:
                rest = np.flatnonzero(~seen)
                found_i, found_s = best_of(np.concatenate([found_i, rest]), np.concatenate([found_s, vectors[rest] @ q]))
        out_q += [qid] * len(found_i)
        out_v += ids[found_i].tolist()
        out_s += [int(x) for x in found_s]
    return out_q, out_v, out_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``.  A null vector or id, or a null or
    non-finite component, takes no part on either side; a row is never a candidate
    for a query of its own id.  Ties go to the smaller id.  Vectors of other
    lengths count as padded with zeros.  Each row of a repeated id is a candidate;
    of rows that ask under one id the smallest vector asks.  Ranks are by whole
    scores; a score beyond a long is put out as null.  Shards of the rows meet
    blocks of the stated queries; nothing else is multiplied.
    """
    ok = F.col(column).isNotNull() & ~F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(key).isNotNull()
    scaled = F.transform(F.col(column), lambda x: x.cast("double") * scale)
    rows = vectors.where(ok).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v"))
    asked = queries.where(ok).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asked = vectors.count(), queries.count()
    shards, blocks = max(1, math.ceil(n_rows / SHARD_ROWS)), max(1, math.ceil(n_asked / QUERY_ROWS))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", cells(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", cells(shards))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, v, s = search_shard(a.vec_id.to_numpy(), np.floor(_matrix(a.v)), b.vec_id.to_numpy(), np.floor(_matrix(b.v)), k) if len(a) and len(b) else ([], [], [])
        # a score as two parts that sort like the whole: its quotient and rest by 2^53, the first held at a double
        high = [float(x >> 53) for x in s]
        return pd.DataFrame({"query_id": q, "vec_id": v, "high": high, "low": [x & (2**53 - 1) for x in s], "score": [x if -(2**63) <= x < 2**63 else None for x in s]}).astype({"query_id": "int64", "vec_id": "int64", "high": "float64", "low": "int64", "score": "Int64"})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, high double, low long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
