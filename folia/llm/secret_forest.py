"""Secret scans: candidate strings judged by a random forest.

Candidates are all runs of ``MIN_CHARS`` or more key-like characters that hold a
digit or a mix of cases, and values of ``MIN_NAMED`` or more characters behind a
password-like name, quoted or not; neither has an upper bound.  A forest over length,
character transitions, dictionary coverage, path and neighbouring words removes
the false positives; it is trained from labelled findings that
``labelled_findings`` makes from a seed (keys of many kinds; checksums, commits,
identifiers, paths, long words, sample values).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import give_back

MIN_CHARS, MIN_NAMED = 16, 8
RUN, MIXED = re.compile(r"[A-Za-z0-9_+/=~.-]{%d,}" % MIN_CHARS), re.compile(r"[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]")
#: A value in quotes, or up to the next space, after an assignment; of any length.
ASSIGNED = re.compile(r"[:=]\s*+[\"']([^\"'\s]{%d,}+)[\"']" % MIN_NAMED)
BARE = re.compile(r"(?::=|=>|[:=])[ \t]*+([^\"'\s]{%d,}+)" % MIN_NAMED)
NAME = re.compile(r"(?i)(?:(?<![a-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)")
REDACTED = "[secret removed]"
THRESHOLD = 0.5
NEAR = 48
POSITIVE_WORDS = frozenset("token secret password passwd pwd key apikey api_key api auth bearer credential credentials access private client_secret authorization".split())
NEGATIVE_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash integrity etag uuid guid id revision build version image example sample placeholder dummy fixture test isbn".split())
#: English syllables and word parts; a string that they cover is prose, not a key.
PARTS = frozenset(
    "the and ing ion tion ent ment able ible ness less ful est ers pre pro con com per ver ter der ber ster ance ence ity ous ive ate age ist ism "
    "sch ich ein eit keit ung und gen ver lich heit aus auf zu mit que elle aux ier pour dans des les une mente ado cion dad ar er ir or on an en in es is it at as of re st nd th he ha ou ea ly ed".split()
)
CLASSES = 5  # upper, lower, digit, mark, other


def _class(ch: str) -> int:
    return 0 if "A" <= ch <= "Z" else 1 if "a" <= ch <= "z" else 2 if "0" <= ch <= "9" else 3 if ch in "_-+/=.~" else 4


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _covered(s: str) -> float:
    """Share of the letters that word parts of three letters or more, or runs of two-letter parts, cover."""
    low, i, hit, letters = s.lower(), 0, 0, sum(c.isalpha() for c in s)
    while i < len(low):
        for n in (4, 3, 2):
            if low[i : i + n] in PARTS:
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / letters if letters else 0.0


NAMES = (
    "length", "log_length", "entropy", "entropy_share", "digits", "uppers", "lowers", "marks", "covered", "hex", "transitions",
    *[f"from_{a}_to_{b}" for a in range(4) for b in range(4)],
    "longest_letters", "longest_digits", "repeats", "distinct", "dots", "slashes", "dashes", "assigned", "quoted", "good_words", "bad_words", "before_is_path", "path_test", "path_config", "uuid_shape", "prefix_shape", "sequential",
)


def features(value: str, before: str, after: str, path: str = "") -> list[float]:
    """Numbers for one candidate; ``before`` and ``after`` are the text next to it, ``path`` its source."""
    n = len(value)
    kinds = [_class(c) for c in value]
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    share = lambda k: kinds.count(k) / n
    near = re.findall(r"[a-z_0-9]+", (before + " " + after).lower())
    words = set(near) | {w for x in near for w in x.split("_")}
    tail = before.rstrip(" \t\"'")
    e = _entropy(value)
    seq = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / n
    return [
        float(n), math.log(n), e, e / max(1.0, math.log2(min(n, 64))), share(2), share(0), share(1), share(3), _covered(value),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None), sum(v for (a, b), v in moves.items() if a != b) / n,
        *[moves[a, b] / n for a in range(4) for b in range(4)],
        float(max(map(len, re.findall(r"[A-Za-z]+", value)), default=0)), float(max(map(len, re.findall(r"[0-9]+", value)), default=0)),
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n, len(set(value)) / n,
        float(value.count(".")), float(value.count("/")), float(value.count("-")),
        float(tail[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
        float(len(words & POSITIVE_WORDS)), float(len(words & NEGATIVE_WORDS)),
        float(before[-1:] in ("/", "\\", "@")), float("test" in path.lower() or "example" in path.lower()), float(any(x in path.lower() for x in (".env", "config", "secret", ".pem"))),
        float(re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", value) is not None),
        float(re.match(r"(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ|glpat-)", value) is not None), seq,
    ]


class Tree:
    """A binary tree as flat arrays: feature, cut, children, share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, rng, depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean())))
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return me
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], size=max(2, int(math.sqrt(x.shape[1])) + 2), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= leaf) & (len(y) - n[:-1] >= leaf))
            if len(ok):
                a, p, q = n[ok], ones[ok], ones[-1] - ones[ok]
                b = len(y) - a
                gini = p * (a - p) / a + q * (b - q) / b
                k = int(np.argmin(gini))
                gain = ones[-1] * (len(y) - ones[-1]) / len(y) - gini[k]
                if gain > best[0] + 1e-12:
                    best = (float(gain), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return me
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], rng, depth - 1, leaf)
        b = self._grow(x[~left], y[~left], rng, depth - 1, leaf)
        self.nodes[me] = (best[1], best[2], a, b, self.nodes[me][4])
        return me

    def __call__(self, row: list[float]) -> float:
        i = 0
        while (node := self.nodes[i])[0] >= 0:
            i = node[2] if row[node[0]] <= node[1] else node[3]
        return node[4]


class Forest:
    """Bagged trees over random feature subsets; the same findings and seed give the same forest."""

    def __init__(self, x: list[list[float]], y: list[int], trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 7):
        rng = np.random.default_rng(seed)
        a, b = np.array(x), np.array(y, dtype=np.float64)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(b), len(b))
            self.trees.append(Tree(a[pick], b[pick], rng, depth, leaf))

    def __call__(self, row: list[float]) -> float:
        return sum(t(row) for t in self.trees) / len(self.trees)


def labelled_findings(n: int = 2400, seed: int = 11) -> Iterator[tuple[str, str, str, str, int]]:
    """``(value, before, after, path, is_secret)`` findings, half of them secrets."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    parts = sorted(PARTS)
    prose = lambda k: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(k))
    paths = ("src3", "app/config.yml", ".env", "docs/readme.md", "tests/test_auth.py", "example/settings.py", "crawl")
    for i in range(n):
        path, quote = r.choice(paths), r.choice(("\"", "'", "\"", ""))
        if i % 2 == 0:
            value = r.choice((
                lambda: some(hexes, r.choice((32, 40, 64))), lambda: some(alnum, r.choice((20, 24, 32, 40, 48, 64))), lambda: some(alnum + "+/", 43) + "=",
                lambda: r.choice(("ghp_", "sk_live_", "AKIA", "AIza", "glpat-", "xoxb-")) + some(alnum, r.randint(16, 40)),
                lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 60) + "." + some(alnum, 40), lambda: some(alnum + "_-", r.randint(18, 50)),
                lambda: some(alnum[:52], r.randint(16, 40)), lambda: (r.choice(parts) + r.choice(parts) + r.choice(parts) + some("0123456789", r.randint(2, 5)) + r.choice(("", "!")))[-15:].rjust(8, "k"),
                lambda: some(alnum + "!#%_-", r.randint(8, 15)),
            ))()
            name = r.choice(("token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "Authorization: Bearer", "key"))
            before = f"{prose(r.randint(0, 6))} {name}{r.choice((' = ', '=', ': ', ' '))}{quote}"
            yield value, before[-NEAR:], f"{quote} {prose(r.randint(0, 6))}"[:NEAR], path, 1
        else:
            kind = r.randrange(13)
            value = (
                some(hexes, 40) if kind == 0 else some(hexes, r.choice((32, 64))) if kind == 1 else "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)) if kind == 2
                else "/".join(prose(1) for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 99)}.html" if kind == 3 else "".join(r.choice(parts) for _ in range(r.randint(6, 12))) + r.choice(("", "2", "-1"))
                if kind == 4 else r.choice(("x", "0", "A")) * r.randint(16, 40) + r.choice(("1", "a")) if kind == 5 else "abcdefghijklmnopqrstuvwxyz0123456789"[: r.randint(18, 36)] if kind == 6
                else f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{prose(1)}-{prose(1)}.tar.gz" if kind == 7 else "".join(prose(1).title() for _ in range(r.randint(3, 5))).ljust(16, "s") if kind == 9
                else "/".join(prose(1).title() for _ in range(r.randint(3, 6))) + r.choice(("", "/Readme.md")) if kind == 10 else some("0123456789", r.randint(16, 24)) if kind == 11
                else r.choice((prose(1) + prose(1), prose(1) + prose(1), "${" + prose(1).upper() + "_TOKEN}", "<your-" + prose(1) + ">", "config." + prose(1), prose(1).title() + prose(1))).ljust(8, "s") if kind == 12 else "_".join(prose(1).upper() for _ in range(r.randint(2, 5))) + f"_{r.randint(0, 99)}"
            ).replace(" ", "")
            name = r.choice(("commit ", "sha256:", "md5 ", "checksum: ", "integrity=", "revision ")) if kind < 2 else r.choice(("uuid=", "id: ", "request id ")) if kind == 2 else r.choice(("token = ", "example key: ", "password=")) if kind in (5, 6) else r.choice(("token: ", "password: ", "secret=", "auth: ", "PASSWORD=")) if kind == 12 else r.choice(("", "see ", "class=", "https://site.example/"))
            before = f"{prose(r.randint(0, 6))} {name}{quote if kind > 2 else ''}"
            yield value, before[-NEAR:], f"{quote} {prose(r.randint(0, 6))}"[:NEAR], path, 0


@lru_cache(maxsize=2)
def trained(n: int = 2400, seed: int = 11) -> Forest:
    rows = list(labelled_findings(n, seed))
    return Forest([features(*x[:4]) for x in rows], [x[4] for x in rows])


def name_before(text: str, at: int) -> str:
    """The identifier in front of an assignment, whatever its length, without quotes and spaces between."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    if at > 0 and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return text[start:at]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans to judge, left to right, without overlaps."""
    found = []
    for m in RUN.finditer(text):
        begin, s = m.start(), m[0]
        value = s.strip("=./-~+") if s[0] in "=./-~+" else s.rstrip("./-~+")
        start = begin + s.find(value) if value else begin
        if "=" in value.rstrip("="):  # name=value
            start += value.rstrip("=").rfind("=") + 1
            value = value[value.rstrip("=").rfind("=") + 1 :]
        if len(value) >= MIN_CHARS and MIXED.search(value):
            found.append((start, start + len(value)))
    for pattern in (ASSIGNED, BARE):
        for m in pattern.finditer(text):
            begin, end = m.start(1), m.start(1) + len(m[1].rstrip(",;.)]}>") if pattern is BARE else m[1])
            at = bisect_left(found, (begin, begin))
            free = (at == 0 or found[at - 1][1] <= begin) and (at == len(found) or end <= found[at][0])
            if end - begin >= MIN_NAMED and free and NAME.search(name_before(text, m.start())):
                found.insert(at, (begin, end))
    return found


def scan_text(text: str | None, path: str, forest: Forest) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` of every candidate, code points, end exclusive."""
    if not text:
        return []
    return [(a, b, forest(features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path))) for a, b in candidates(text)]


FINDINGS = "doc_id long, start long, end long, probability double, is_secret boolean, value_sha256 string"


def findings(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate of each text: span, probability, decision, and a digest in place of the value.

    Null and empty texts have none.  Values are never put out.  ``source`` (null:
    empty) is the path feature.  Repeated rows are reported each.
    """
    forest = docs.sparkSession.sparkContext.broadcast(trained())  # a model of fixed size
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(source, F.lit("")).alias("path"))

    def run(batches):
        f = forest.value
        for b in batches:
            got = [
                (doc, s, e, p, p >= threshold, hashlib.sha256(text[s:e].encode()).hexdigest())
                for doc, text, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                for s, e, p in scan_text(text, path, f)
            ]
            if got:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "start", "end", "probability", "is_secret", "value_sha256"])

    return rows.mapInArrow(run, FINDINGS)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret replaced by a mark; ``n_chars``, if there, follows the text.

    Null and empty texts stay as they are; repeated rows are treated alike; extra
    columns are unchanged; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    forest = docs.sparkSession.sparkContext.broadcast(trained())
    out = to_arrow_schema(docs.schema)
    names = docs.columns
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.LongType)

    def run(batches):
        give_back()
        f = forest.value
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            paths = b.column(names.index("source")).to_pylist() if "source" in names else [""] * len(texts)
            sizes = b.column(names.index("n_chars")).to_pylist() if counted else []
            for i, text in enumerate(texts):
                parts, at = [], 0
                for s, e, p in scan_text(text, str(paths[i] or ""), f):
                    if p >= threshold:
                        parts += [text[at:s], REDACTED]
                        at = e
                if parts:
                    texts[i] = "".join([*parts, text[at:]])
                    if counted:
                        sizes[i] = len(texts[i])
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, out.field("text").type)
            if counted:
                columns[names.index("n_chars")] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, docs.schema)
