"""PII: fixed base patterns plus a semi-Markov conditional random field over whole spans.

The base finds email, ip, card and phone by their patterns.  The field reads the
tokens around every digit, ``@`` and spelled-out ``at``; each candidate segment of up to
``MAX_TOKENS`` tokens is scored as a whole (shape, checks, neighbours, cue words)
for each type, every other token is a segment of its own, and a dynamic program
over boundaries picks segments and types jointly.  It is trained by conditional
likelihood on labelled snippets made from a seed.  Its spans are added where
they touch no base span; base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Tokens of a candidate segment: the longest spaced account numbers have 18 to 22.
MAX_TOKENS = 24
#: Characters around a trigger that belong to its zone.
REACH = 56
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where its digits start (if that fails, so does every later digit of the run), so a run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]| (?:at|AT) (?=[A-Za-z0-9-]+(?: (?:dot|DOT) | ?[\[(]dot[\])]|\.[A-Za-z]))")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\S\n]+|.", re.S)
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and without overlaps inside a kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z")),
    ("email_words", re.compile(r"[A-Za-z0-9._%+-]+(?: at | AT | ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?: dot | DOT | ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]+)+\Z")),
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\Z")),
    ("four_numbers", re.compile(r"\d+(?:\.\d+){3}\Z")),
    ("digits", re.compile(r"\d+\Z")),
    ("card_groups", re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}\Z|\d{4}([ -])\d{6}\2\d{5}\Z")),
    ("phone_plus", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\Z")),
    ("phone_local", re.compile(r"(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}\Z")),
    ("phone_zero", re.compile(r"0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,4})*\Z")),
    ("ssn", re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\Z")),
    ("iban", re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\Z")),
    ("date", re.compile(r"\d{4}-\d\d-\d\d\Z|\d\d?[./]\d\d?[./]\d{2,4}\Z")),
)
CUES = {
    "email": "email mail contact write courriel correo", "phone": "phone tel telephone call mobile fax cell telefon llame",
    "card": "card visa mastercard credit debit amex karte carte tarjeta", "ip": "ip address host server client login from", "ssn": "ssn social security", "iban": "iban bank account konto compte cuenta",
    "other": "version v order invoice item page total commit sha token id isbn section chapter figure",
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}


def segment_features(s: str, before: str, after: str, cues: frozenset[str]) -> list[str]:
    """Of a whole candidate span; ``before`` and ``after`` are the characters next to it."""
    shapes = [name for name, p in SHAPES if p.match(s)]
    digits = NOT_DIGIT.sub("", s)
    n = len(digits)
    f = [f"shape:{x}" for x in shapes] or ["shape:none"]
    f.append(f"digits:{min(n, 20)}")
    f.append("before:" + ("digit" if before.isdigit() else "letter" if before.isalpha() else "space" if not before or before.isspace() else before))
    f.append("after:" + ("digit" if after.isdigit() else "letter" if after.isalpha() else "space" if not after or after.isspace() else after))
    if 12 <= n <= 19 and len(s) <= n + 6 and not any(c.isalpha() for c in s):
        f.append(f"luhn:{luhn(digits)}")
    if "shape:iban" in f:
        f.append(f"mod97:{_iban(s)}")
    for c in cues:
        f.append(f"cue:{c}")
        f += [f"cue:{c}:{x}" for x in shapes]
    return f


class Zone:
    """Tokens of a stretch of text and its candidate segments."""

    def __init__(self, text: str, start: int, end: int):
        self.at, self.tokens = [], []
        for m in TOKEN.finditer(text, start, end):
            self.at.append(m.start())
            self.tokens.append(m[0])
        self.at.append(end)
        self.segments: list[tuple[int, int, list[str]]] = []
        n = len(self.tokens)
        digit = [t[0].isdigit() for t in self.tokens]
        lower = [t.lower() for t in self.tokens]
        wordy = [t[0].isalpha() for t in self.tokens]
        for i in range(n):
            first = self.tokens[i]
            if not (digit[i] or wordy[i] or first in "+("):
                continue
            cues = None
            triggered = False
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = self.tokens[j]
                if "\n" in t:
                    break
                triggered = triggered or digit[j] or t == "@" or t.lower() == "at"
                if not triggered or not (digit[j] or wordy[j] or t == ")"):
                    continue
                if wordy[i] and not digit[j] and not any(x == "@" or x in ("at", "AT") for x in self.tokens[i : j + 1]) and not any(digit[i : j + 1]):
                    continue
                if cues is None:
                    cues = frozenset(CUE_OF[w] for w in lower[max(0, i - 8) : i] if w in CUE_OF)
                a, b = self.at[i], self.at[j + 1]
                s = text[a:b]
                # spans without any entity shape differ only from each other: one token is enough for them
                f = segment_features(s, text[a - 1 : a], text[b : b + 1], cues)
                if f[0] != "shape:none":
                    self.segments.append((i, j + 1, f))


class SemiCrf:
    """Weights by (feature, type); a token outside every entity scores ``bias`` 0, an entity its features."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.table = table

    def scores(self, zone: Zone) -> np.ndarray:
        none = np.zeros(len(KINDS))
        return np.array([sum((self.table.get(x, none) for x in f), none) for _, _, f in zone.segments]).reshape(-1, len(KINDS))

    @classmethod
    def fit(cls, rows: list[tuple[Zone, set[tuple[int, int, str]]]], steps: int = 60, rate: float = 0.3, decay: float = 1e-3):
        """Full-batch adaptive-moment ascent; forward-backward over segment boundaries gives expected counts."""
        index: dict[str, int] = {}
        packed = []
        for zone, gold in rows:
            ids = [np.array([index.setdefault(x, len(index)) for x in f]) for _, _, f in zone.segments]
            begin, end = np.array([s[0] for s in zone.segments], dtype=int), np.array([s[1] for s in zone.segments], dtype=int)
            truth = np.array([[(zone.at[i], zone.at[j], k) in gold for k in KINDS] for i, j, _ in zone.segments], dtype=float).reshape(-1, len(KINDS))
            size = np.array([len(x) for x in ids], dtype=int)
            if len(ids):
                packed.append((len(zone.tokens), begin, end, truth, np.concatenate(ids), np.repeat(np.arange(len(ids)), size), np.cumsum(size) - size))
        p = np.zeros((len(index), len(KINDS)))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            g = -decay * p * len(packed)
            for n, begin, end, truth, ids, owner, starts in packed:
                s = np.add.reduceat(p[ids], starts, axis=0)
                whole = np.logaddexp.reduce(s, axis=1)
                a, z = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                a[0] = z[n] = 0.0
                by_end, by_begin = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
                for k in range(len(begin)):
                    by_end[end[k]].append(k)
                    by_begin[begin[k]].append(k)
                for j in range(1, n + 1):
                    a[j] = np.logaddexp.reduce([a[j - 1], *(a[begin[k]] + whole[k] for k in by_end[j])])
                for i in range(n - 1, -1, -1):
                    z[i] = np.logaddexp.reduce([z[i + 1], *(z[end[k]] + whole[k] for k in by_begin[i])])
                chance = np.exp(a[begin, None] + s + z[end, None] - a[n])
                np.add.at(g, ids, (truth - chance)[owner])
            g /= len(packed)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls({f: p[i] for f, i in index.items()})

    def decode(self, zone: Zone) -> list[tuple[str, int, int]]:
        """The best segmentation's entities; between equal scores the shorter history of entities wins."""
        if not zone.segments:
            return []
        s = self.scores(zone)
        kind, value = s.argmax(axis=1), s.max(axis=1)
        n = len(zone.tokens)
        best, came = [0.0] * (n + 1), [-1] * (n + 1)
        by_end: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(zone.segments):
            by_end.setdefault(j, []).append(k)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in by_end.get(j, ()):
                got = best[zone.segments[k][0]] + float(value[k])
                if got > best[j]:
                    best[j], came[j] = got, k
        out, j = [], n
        while j > 0:
            if came[j] >= 0:
                i = zone.segments[came[j]][0]
                out.append((KINDS[kind[came[j]]], zone.at[i], zone.at[j]))
                j = i
            else:
                j -= 1
        return out[::-1]


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits, ``@`` and spelled-out ``at``; only they can hold an entity of these types."""
    start = end = -1
    at = 0
    while m := TRIGGER.search(text, at):
        i = m.start()
        if i - REACH > end:
            if end >= 0:
                yield start, end
            start = max(0, i - REACH, end)
        end = min(len(text), i + REACH)
        at = i + 1
    if end >= 0:
        yield start, end


def labelled_snippets(n: int = 360, seed: int = 3) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """Text with the spans that are personal data, and look-alikes that are not."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    parts = ["the", "er", "on", "an", "re", "he", "in", "und", "que", "la", "de", "th", "ing", "ou"]
    w = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        full = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(full[i : i + 4] for i in range(0, 16, 4)) if sep else full

    def not_card() -> str:
        body = d(15)
        return next(body + str(k) for k in r.sample(range(10), 10) if not luhn(body + str(k)))

    def iban() -> str:
        body = d(18)
        check = 98 - int(body + "131400") % 97
        full = f"DE{check:02d}{body}"
        return full if r.random() < 0.5 else " ".join(full[i : i + 4] for i in range(0, len(full), 4))

    real = {
        "email": lambda: r.choice((f"{w()} at {w()} dot {r.choice(('com', 'net', 'org', 'edu'))}", f"{w()}.{w()} [at] {w()} [dot] {w()}", f"{w()} (at) {w()}.org", f"{w()}.{d(2)}@mail{d(1)}.example.com", f"{w()}@{w()}.org", f"{w()} at {w()}{d(1)} dot com", f"{w()}{d(2)} [at] {w()} [dot] net")),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card,
        "phone": lambda: r.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+49 {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}")),
        "iban": iban, "ssn": lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    }
    fake = (
        lambda: not_card(), lambda: "token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\"", lambda: f"Version {d(1)}.{d(1)}", lambda: f"version {d(1)}.{d(2)}.{d(1)}.{d(4)}", lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}",
        lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: d(r.randint(1, 6)), lambda: f"{d(3)}.{d(2)} EUR", lambda: f"page {d(3)}", lambda: f"order {d(9)}", lambda: f"{r.randint(256, 999)}.{d(2)}.{d(3)}.{d(2)}", lambda: f"@{w()}", lambda: f"{w()} at {d(2)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(8)}-{d(4)}-{d(4)}", lambda: d(r.randint(20, 30)),
        lambda: "TOKEN = \"" + "".join(r.choice("0123456789ABCDEF") for _ in range(40)) + "\"", lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)), lambda: f"{w()} at {d(2)}.{w()}", lambda: f"{w()} at {w()} dot", lambda: f"{w()} at {w()}.", lambda: f"{d(16)} That {w()}. {w()}",
    )
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(w() for _ in range(r.randint(0, 7))) + r.choice((" ", " ", ". ", ", "))
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.35:
                    text += r.choice(CUES[kind].split()) + r.choice((": ", " ", " is "))
                s = real[kind]()
                gold.add((len(text), len(text) + len(s), kind))
                text += s
            else:
                text += r.choice(fake)()
            text += r.choice((" ", ". ", ", ", "; ", "\n"))
        yield text + w(), gold


@lru_cache(maxsize=2)
def trained(n: int = 360, seed: int = 3) -> SemiCrf:
    rows = []
    for text, gold in labelled_snippets(n, seed):
        for a, b in zones(text):
            rows.append((Zone(text, a, b), {g for g in gold if a <= g[0] and g[1] <= b}))
    return SemiCrf.fit(rows)


def spans(text: str | None, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base's and those of the field that touch none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    lows, highs = [], []  # what the base covers, as disjoint stretches in order
    for _, i, j in base:
        if highs and i < highs[-1]:
            highs[-1] = max(highs[-1], j)
        else:
            lows.append(i)
            highs.append(j)
    every = list(base)
    for a, b in zones(text):
        for k, i, j in model.decode(Zone(text, a, b)):
            at = bisect_right(highs, i)  # the first stretch that ends after the span starts
            if at == len(lows) or j <= lows[at]:
                every.append((k, i, j))
    return base, sorted(every, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _said(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; a null text counts as empty.

    A null id stays null, repeated rows are reported each, extra columns are
    ignored, and an empty table gives an empty result.  A text is read whole, in
    time that grows with its length; the field's spans hold ``MAX_TOKENS`` tokens
    at most, the base's have no bound.

    Counts and digest are of the base; offsets are code points, ends exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())  # a model of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches):
        m = model.value
        for b in batches:
            counts, digests, said = {k: [] for k in BASE}, [], []
            for text in b.column(1).to_pylist():
                base, every = spans(text, m)
                for k in BASE:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(said)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
