"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A piece of text (one match of the tokenizer's pattern) is a set of token-position
rows, one for each byte at first.  A recursive query joins neighbouring rows with
the merge table, contracts each piece's leftmost pair of minimum rank (``best``
packs the rank, the place of the pair and that of its second token, which goes)
and goes on until no pair of the piece can be merged; its rows are then done and
leave the recursion.  The merge table holds every split of each vocabulary entry
into two entries, which is the rule that rank-based encoders follow.  Decoding
joins ids with the vocabulary in position order, which leaves the bytes of a
sequence next to each other.  A piece that is known is not encoded again.

A query takes pieces of like sizes up to ``QUERY_ROWS`` rows over all passes: its
memory has the same bound for any script.  Pieces longer than ``LONG_PIECE`` bytes
(runs without any break) would need a pass for each merge; a heap with the same
contraction order encodes those.  Vocabulary files are read from a path that is a
parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import trim

#: Characters of text whose pieces are split together; pieces of a text that are; pieces that a worker keeps encoded before it drops some; see above.
CHUNK_CHARS, CHUNK_PIECES, CACHE_PIECES, LONG_PIECE = 2_000_000, 500_000, 300_000, 255
#: Bytes of the pieces of one recursive query; rows of all its passes (a piece of n bytes has n + ... + 1 at most); ids decoded together.
QUERY_BYTES, QUERY_ROWS, DECODE_IDS = 250_000, 6_000_000, 250_000

ENCODE_SQL = """
WITH RECURSIVE step(w, pos, id, nid, npos, done) AS (
  SELECT w, pos, id, nid, (pos + 1)::SMALLINT, false FROM start
  UNION ALL
  SELECT s.w, s.pos, CASE WHEN s.pos = b.first THEN b.merged ELSE s.id END,
         CASE WHEN s.pos = b.first THEN b.nid WHEN s.npos = b.first THEN b.merged ELSE s.nid END,
         CASE WHEN s.pos = b.first THEN b.npos ELSE s.npos END, b.w IS NULL
  FROM step s LEFT JOIN (
    SELECT a.w, a.merged, a.first, a.gone, g.nid, g.npos
    FROM (
      SELECT w, (best // 65536)::INTEGER AS merged, (best // 256 % 256)::SMALLINT AS first, (best % 256)::SMALLINT AS gone
      FROM (
        SELECT s.w, min(m.merged * 65536::BIGINT + s.pos * 256::INTEGER + s.npos) AS best
        FROM step s JOIN merges m ON m.pair = s.id * 4294967296::BIGINT + s.nid GROUP BY s.w
      )
    ) a JOIN step g ON g.w = a.w AND g.pos = a.gone
  ) b ON s.w = b.w
  WHERE NOT s.done AND (b.w IS NULL OR s.pos <> b.gone)
)
SELECT w, list(id ORDER BY pos) AS ids FROM step WHERE done GROUP BY w ORDER BY w
"""
DECODE_SQL = "SELECT t.pos, v.raw FROM tokens t JOIN vocabulary v ON v.id = t.id ORDER BY t.pos"


class Vocabulary:
    """Ranks of a ``.tiktoken`` file and a DuckDB connection that holds its tables."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a * 2**32 + b)
                    merged.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        ids = list(self.ranks.values())
        self._load("vocabulary", pa.table({"id": pa.array(ids, pa.int64()), "raw": pa.array(list(self.ranks), pa.binary())}))
        self.bytes_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.encoded: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not yet known and decode the new id sequences."""
        if len(self.encoded) > CACHE_PIECES:  # what these pieces need stays, so frequent words do
            self.encoded = {p: self.encoded[p] for p in pieces & self.encoded.keys()}
            self.decoded = {x: self.decoded[x] for x in self.encoded.values()}
        todo: list[tuple[str, bytes]] = []
        fresh = pieces - self.encoded.keys()
        for piece in fresh:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.encoded[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.encoded[piece] = np.array(self.long_piece(raw), dtype="<u4").tobytes()
            else:
                todo.append((piece, raw))
        for part in _batches(todo):
            self.encoded.update(zip((p for p, _ in part), self.recurse([raw for _, raw in part]), strict=True))
        new = list({self.encoded[p] for p in fresh} - self.decoded.keys())
        self.decoded.update(zip(new, self.decode(new), strict=True))

    def recurse(self, raws: list[bytes]) -> Iterator[bytes]:
        """Ids of each piece (little-endian unsigned 32-bit) by the recursive query."""
        sizes = np.array([len(r) for r in raws])
        ids = self.bytes_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        w = np.repeat(np.arange(len(raws)), sizes)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        following = np.append(np.where(w[1:] == w[:-1], ids[1:], -1), -1)
        small = {"w": w.astype(np.int32), "pos": pos.astype(np.int16), "id": ids.astype(np.int32), "nid": following.astype(np.int32)}
        self.db.register("start", pa.table(small))
        got = self.db.sql(ENCODE_SQL).to_arrow_table()
        self.db.unregister("start")
        lists = got.column("ids").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
        begin = 0
        for end in ends.tolist():
            yield flat[begin:end]
            begin = end

    def decode(self, sequences: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence by an ordered join; an id outside the vocabulary raises."""
        limit = 4 * DECODE_IDS
        raw: list[bytes] = []
        held, size = [], 0
        for x in sequences:
            if held and size + len(x) > limit:
                raw += self._decode(held)
                held, size = [], 0
            if len(x) > limit:
                raw.append(b"".join(self._decode([x[i : i + limit]])[0] for i in range(0, len(x), limit)))
            else:
                held.append(x)
                size += len(x)
        return raw + self._decode(held)

    def _decode(self, sequences: list[bytes]) -> list[bytes]:
        if not sequences:
            return []
        ids = np.frombuffer(b"".join(sequences), dtype="<u4").astype(np.int64)
        self.db.register("tokens", pa.table({"pos": np.arange(len(ids)), "id": ids}))
        got = self.db.sql(DECODE_SQL).to_arrow_table().column("raw").combine_chunks()
        self.db.unregister("tokens")
        if len(got) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        # the rows stand in order, so the bytes of a sequence are next to each other
        raw = got.buffers()[2].to_pybytes() if len(got) else b""
        ends = np.append(0, np.cumsum(pc.binary_length(got).to_numpy()))[np.cumsum([len(x) // 4 for x in sequences])].tolist()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def long_piece(self, raw: bytes) -> list[int]:
        """The same contraction order with a heap of (rank, position) over linked positions."""
        n = len(raw)
        end = list(range(1, n + 1))  # of the token that starts here
        back = list(range(-1, n - 1))
        alive = [True] * n
        rank = lambda i: self.ranks.get(raw[i : end[end[i]]]) if end[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
            for k in (i, back[i]):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, end[end[k]]))
        i, out = 0, []
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _batches(todo: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """Pieces of like sizes together, as many as a query's passes have room for: memory is bounded for any script."""
    held, size, rows = [], 0, 0
    for piece, raw in sorted(todo, key=lambda x: len(x[1])):
        n = len(raw)
        if held and (size + n > QUERY_BYTES or rows + n * (n + 1) // 2 > QUERY_ROWS):
            yield held
            held, size, rows = [], 0, 0
        held.append((piece, raw))
        size += n
        rows += n * (n + 1) // 2
    if held:
        yield held


def encoded_blocks(v: Vocabulary, pattern, texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Blocks of ``(text number, id sequences of pieces)``; a long text comes in several, in order.

    The decoded form of a block's sequences is known until the next is asked for.
    """
    held: list[tuple[int, list[str]]] = []
    size = 0

    def known():
        v.learn(set().union(*(p for _, p in held)))
        return [(i, list(map(v.encoded.__getitem__, pieces))) for i, pieces in held]

    for i, text in enumerate(texts):
        text = text or ""
        if len(text) <= CHUNK_CHARS:
            held.append((i, pattern.findall(text)))
            size += len(text)
        else:
            found = (m[0] for m in pattern.finditer(text))
            while part := list(islice(found, CHUNK_PIECES)):
                held.append((i, part))
                yield known()
                held, size = [], 0
        if size >= CHUNK_CHARS:
            yield known()
            held, size = [], 0
    if held:
        yield known()


def encode_texts(v: Vocabulary, pattern, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """For each text the id sequences of its pieces, in order."""
    texts = list(texts)
    out: list[list[bytes]] = [[] for _ in texts]
    for block in encoded_blocks(v, pattern, texts):
        for i, sequences in block:
            out[i] += sequences
    yield from out


def _setup(path: str, pattern: str | None):
    import public_tokenizers
    import regex

    return vocabulary(path), regex.compile(pattern or public_tokenizers.PATTERN)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<long>) to every row; a null or empty text has no ids.  No special tokens."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or _default_path()
    kept = docs.drop(ids)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.LongType()))])
    out = to_arrow_schema(schema)

    def run(batches):
        v, p = _setup(path, pattern)
        for b in batches:
            for small in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                got = [np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in encode_texts(v, p, small.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[small.column(n) for n in names], pa.array(got, type=pa.list_(pa.int64()))], schema=out)

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", raw: str = "bytes") -> DataFrame:
    """Adds ``raw`` (binary), the bytes of each row's id list; null ids give no bytes."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or _default_path()
    kept = docs.drop(raw)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(raw, T.BinaryType())])
    out = to_arrow_schema(schema)

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for small in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                got = v.decode([np.array(x or [], dtype="<u4").tobytes() for x in small.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[small.column(n) for n in names], pa.array(got, type=pa.binary())], schema=out)

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without moving the ids.

    A null text counts as empty (no tokens, digests of no bytes); a null id and
    repeated rows are kept as they are.
    """
    path = path or _default_path()

    def run(batches):
        trim()
        v, p = _setup(path, pattern)
        for b in batches:
            count = [0] * b.num_rows
            coded, plain = [hashlib.sha256() for _ in count], [hashlib.sha256() for _ in count]
            for block in encoded_blocks(v, p, (x.as_py() for x in b.column(1))):
                back = v.decoded.__getitem__
                for i, sequences in block:
                    ids = b"".join(sequences)
                    count[i] += len(ids) // 4
                    coded[i].update(ids)
                    plain[i].update(b"".join(map(back, sequences)))
            digests = (pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (coded, plain))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
