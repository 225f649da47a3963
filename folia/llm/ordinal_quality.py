"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a sparse vector of hashed features with one shared weight vector; K
grades share it through K-1 ordered thresholds, P(grade <= j) = logistic(t_j - s).
The fit gives the expected grade and the tail probability that selection uses.

Every labelled text takes part.  The ids are dealt by hash to shares of about
``FIT_ROWS``, each task fits the model of a share, and the models' parameters are
averaged by rows, so a task's memory and what the driver gets (``BINS`` numbers)
are the same for any number of labels.  Texts move once, to their shares, where
they meet their grades; a bitmap of ``MARKS`` bits of the labelled ids' hashes
leaves most others where they are, and its size is the same for any table.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import SIEVE_BITS, give_back, sieve

WORD_BINS, TAIL_BINS, SHAPE_BINS = 1 << 17, 1 << 10, 32
BINS = WORD_BINS + TAIL_BINS + SHAPE_BINS
#: Labelled rows of a share, about; parts of one in which parameters are summed, as whole numbers, so that their order does not count.
FIT_ROWS, UNIT = 3000, 1 << 30
CACHE_WORDS = 150_000
#: Bits by which texts without a label are left out early (those that pass meet no grade); a power of two.
MARKS = SIEVE_BITS
_TAIL = re.compile(r"[^\w]*\Z")


class Features:
    """Hashed features of whole texts: words, their trailing marks, and repetition shape."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def bins(self, word: str) -> tuple[int, int]:
        from xxhash import xxh32_intdigest

        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            tail = _TAIL.search(word).group()
            got = self.known[word] = xxh32_intdigest(word) % WORD_BINS, WORD_BINS + xxh32_intdigest(tail, 1) % TAIL_BINS
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Bins and values; an empty or null text has only its shape."""
        words = (text or "").lower().split()
        counts = Counter(words)
        n, distinct = len(words), len(counts)
        share = np.fromiter(counts.values(), dtype=np.float64, count=distinct) / max(n, 1)
        pairs = np.array([self.bins(w) for w in counts], dtype=np.int64).reshape(-1, 2)
        tails = np.bincount(pairs[:, 1] - WORD_BINS, weights=share, minlength=TAIL_BINS)
        used = np.flatnonzero(tails)
        fresh = distinct / n if n else 0.0
        expected = min(1.0, 3.0 / max(n, 1) ** 0.35)  # distinct words thin out in long texts of any kind
        top = float(share.max()) if n else 0.0
        shape = np.zeros(SHAPE_BINS)
        shape[0] = 1.0
        shape[1 + min(9, int(10 * fresh))] = 1.0
        shape[11 + min(9, int(10 * top))] = 1.0
        shape[21] = 1.0 if n == 0 else 0.0
        shape[22] = max(0.0, 0.3 * expected - fresh) * 10
        shape[23 + min(5, int(np.log10(n + 1)))] = 1.0
        on = np.flatnonzero(shape)
        return np.concatenate([pairs[:, 0], used + WORD_BINS, on + WORD_BINS + TAIL_BINS]), np.concatenate([np.sqrt(share), np.sqrt(tails[used]), shape[on]])


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = 400, rate: float = 1.0, decay: float = 1e-6, min_rows: int = 12):
        """Full-batch adaptive-moment descent on the mean negative log-likelihood; the same rows give the same model.

        A feature in fewer than ``min_rows`` rows (a tenth of a small sample) keeps weight 0.
        """
        seen = np.bincount(np.concatenate([np.unique(b) for b, _ in rows]), minlength=BINS) >= min(min_rows, max(1, len(rows) // 10))
        rows = [(b[seen[b]], v[seen[b]]) if seen[b].any() else (b[-1:], v[-1:]) for b, v in rows]
        sizes = np.array([len(b) for b, _ in rows])
        starts = np.cumsum(sizes) - sizes
        bins, values, row = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), sizes)
        shares = np.cumsum(np.bincount(grades, minlength=levels))[:-1] / len(grades)
        shares = np.clip(shares, 1e-3, 1 - 1e-3)
        cuts = np.log(shares / (1 - shares))
        # thresholds as a first one and positive gaps, so that they stay ordered
        p = np.concatenate([np.zeros(BINS), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            gaps = np.exp(p[BINS + 1 :])
            cuts = p[BINS] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.add.reduceat(values * p[bins], starts)
            bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
            with np.errstate(over="ignore"):
                upper, lower = 1 / (1 + np.exp(score - bounds[grades + 1])), 1 / (1 + np.exp(score - bounds[grades]))
            chance = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            g_score = (du - dl) / len(grades)  # of the loss
            g = np.zeros_like(p)
            g[:BINS] = np.bincount(bins, weights=values * g_score[row], minlength=BINS) + decay * p[:BINS]
            g_cut = np.array([(-du[grades == j].sum() + dl[grades == j + 1].sum()) / len(grades) for j in range(levels - 1)])
            g[BINS] = g_cut.sum()
            g[BINS + 1 :] = [gaps[i] * g_cut[i + 1 :].sum() for i in range(levels - 2)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(p[:BINS].astype(np.float32), p[BINS] + np.concatenate([[0.0], np.cumsum(np.exp(p[BINS + 1 :]))]))

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= j) for j = 1 .. K-1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def graded(labels: DataFrame) -> Column:
    """The grade of a labelled row: 0 junk, 1 readable but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


def _dealt(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, int]:
    """``(share, doc_id, grade, text)``, a share in one partition, and the number of shares: an id's grade comes before its texts, which have none."""
    graded_ids = (
        labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), graded(labels).alias("grade"))
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
    )
    shares = max(1, -(-graded_ids.count() // fit_rows))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int").alias("share")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    near = sieve(rows, graded_ids, ["doc_id"], bits=MARKS)
    grades = graded_ids.select(share, "doc_id", "grade", F.lit(None).cast("string").alias("text"))
    both = grades.unionByName(near.select(share, "doc_id", F.lit(None).cast("int").alias("grade"), "text"))
    return both.repartition(shares, "share").sortWithinPartitions("share", "doc_id", F.col("grade").isNull()), shares


def _graded_texts(batches):
    """``(share, doc_id, grade, text)`` of the texts in ``_dealt`` rows whose id has a grade."""
    at = grade = None
    for b in batches:
        for share, i, got, text in zip(*(b.column(n).to_pylist() for n in ("share", "doc_id", "grade")), b.column("text"), strict=True):
            if got is not None:
                at, grade = i, got
            elif i == at:
                yield share, i, grade, text.as_py()


def _first_texts(rows):
    """Of each id's rows the one of the smallest digest."""
    from xxhash import xxh64_intdigest

    for _, same in groupby(rows, key=lambda row: row[1]):
        first = next(same)
        for row in same:
            first = min(first, row, key=lambda x: (xxh64_intdigest(x[3]) ^ (1 << 63)))  # as a signed long
        yield first


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, int]:
    """``(doc_id, grade, share, text)`` of all labelled rows with a text, and the number of shares."""

    def run(batches):
        rows = _graded_texts(batches)
        while part := list(islice(rows, 256)):
            share, i, grade, text = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(grade, pa.int32()), pa.array(share, pa.int32()), pa.array(text, pa.string())], names=["doc_id", "grade", "share", "text"])

    dealt, shares = _dealt(docs, labels, fit_rows)
    return dealt.mapInArrow(run, "doc_id long, grade int, share int, text string"), shares


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, levels: int = 3) -> CumulativeLink:
    """Fit on all labelled texts.  Without any every document gets the top grade."""

    def fitted(batches):
        """(at, part) of each share's model times its rows, in ``UNIT``: weights, thresholds, and a one."""
        give_back()
        f = Features()
        for _, group in groupby(_first_texts(_graded_texts(batches)), key=lambda row: row[0]):
            rows, grades = [], []
            for _, _, grade, text in group:
                bins, values = f(text)
                rows.append((bins, values.astype(np.float32).astype(np.float64)))
                grades.append(grade)
            model = CumulativeLink.fit(rows, np.array(grades, dtype=np.int64), levels)
            p = np.concatenate([model.weights, model.thresholds, [1.0]])
            at = np.flatnonzero(p)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.rint(p[at] * UNIT).astype(np.int64) * len(rows))], names=["at", "part"])

    parts = _dealt(docs, labels, fit_rows)[0].mapInArrow(fitted, "at int, part long")
    got = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(20,0)")).cast("double").alias("total")).toArrow()
    if got.num_rows == 0:
        return CumulativeLink(np.zeros(BINS, dtype=np.float32), np.full(levels - 1, -60.0))
    p = np.zeros(BINS + levels)
    p[got.column("at").to_numpy()] = got.column("total").to_numpy()
    p /= p[-1]
    return CumulativeLink(p[:BINS].astype(np.float32), p[BINS:-1])


def classify(docs: DataFrame, model: CumulativeLink, min_grade: int = 2, min_tail: float = 0.6, keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_columns`` of every row with expected_grade, tail (P of ``min_grade`` or more) and keep.

    A null or empty text is scored on its shape alone.  Repeated rows and ties
    get equal values.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(*[F.col(f"`{c}`") for c in keep_columns], F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # BINS floats, whatever the input
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    out = to_arrow_schema(schema)

    def run(batches):
        f, m = Features(), CumulativeLink(*shared.value)
        for b in batches:
            expected, tail = [], []
            for text in b.column("_text"):
                bins, values = f(text.as_py())
                tails = m.tails(float(values @ m.weights[bins]))
                expected.append(float(tails.sum()))
                tail.append(float(tails[min_grade - 1]))
            extra = [pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= min_tail for t in tail], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], schema=out)

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: CumulativeLink, min_grade: int = 2, min_tail: float = 0.6) -> DataFrame:
    """The rows of ``docs``, unchanged, whose probability of ``min_grade`` or more is ``min_tail`` at least.

    Null and empty texts are judged by their shape; repeated rows alike; an empty
    table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at, out = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches):
        give_back()
        f, m = Features(), CumulativeLink(*shared.value)
        for b in batches:
            good = []
            for text in b.column(at):
                bins, values = f(text.as_py())
                good.append(bool(m.tails(float(values @ m.weights[bins]))[min_grade - 1] >= min_tail))
            kept = b.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=out)

    return docs.mapInArrow(run, docs.schema)
