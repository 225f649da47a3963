"""op8 on pieces that are long and all different: unspaced scripts, random letters."""

import random

import numpy as np
import pytest

from folia.llm import duck_bpe as B


@pytest.mark.parametrize("letters, size, n", [([chr(c) for c in range(0x4E00, 0x9FFF)], 80, 1200), (list("etaoinshrdlu"), 240, 600)])
def test_long_pieces_are_encoded_in_bounded_queries(letters, size, n):
    import tiktoken

    r = random.Random(3)
    pieces = ["".join(r.choice(letters) for _ in range(size)) for _ in range(n)]
    v = B.vocabulary(B._default_path())
    assert all(sum(len(raw) * (len(raw) + 1) // 2 for _, raw in part) <= B.QUERY_ROWS for part in B._batches([(p, p.encode()) for p in pieces]))
    v.learn(set(pieces))
    public = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=v.ranks, special_tokens={})
    assert all(np.frombuffer(v.encoded[p], "<u4").tolist() == public.encode_ordinary(p) for p in pieces)


def test_a_long_text_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_CHARS", 50)
    monkeypatch.setattr(B, "CHUNK_PIECES", 3)
    monkeypatch.setattr(B, "DECODE_IDS", 4)
    monkeypatch.setattr(B, "CACHE_PIECES", 5)
    import public_tokenizers as T
    import regex

    v, pattern = B.Vocabulary(B._default_path()), regex.compile(T.PATTERN)
    texts = ["one two three four five six seven " * 5, None, "", "x" * 300, "eight nine"]
    got = [b"".join(x) for x in B.encode_texts(v, pattern, texts)]
    assert v.decode(got) == [(t or "").encode() for t in texts]


def test_other_stages_drop_the_vocabulary_that_a_worker_keeps():
    import public_tokenizers

    from folia.llm import duck_bpe
    from folia.llm.common import give_back

    duck_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    give_back()
    assert duck_bpe.vocabulary.cache_info().currsize == 0


def test_a_full_cache_keeps_what_the_next_pieces_need(monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 3)
    v = B.Vocabulary(B._default_path())
    often = {"qzaqz", "qzbqz", "qzcqz", "qzdqz"}
    v.learn(often | {"qzeqz"})
    asked, recurse = [], v.recurse
    monkeypatch.setattr(v, "recurse", lambda raws: (asked.extend(raws), recurse(raws))[1])
    v.learn(often | {"qzfqz"})
    assert asked == [b"qzfqz"] and "qzeqz" not in v.encoded
    assert all(v.decoded[v.encoded[p]] == p.encode() for p in often | {"qzfqz"})


def test_the_stages_before_the_encoder_give_back_too(spark, monkeypatch):
    from folia.llm.secret_forest import redact
    from folia.llm.spaced_decontam import without_overlaps

    rows = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "an item")], "item_id long, text string")
    made = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *_: made.append(f) or self)
    redact(rows)
    without_overlaps(rows, items)
    for run in made[-1], made[0]:
        B.vocabulary(B._default_path())
        assert list(run(iter([]))) == [] and B.vocabulary.cache_info().currsize == 0
