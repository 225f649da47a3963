"""op5, op6, op8, op9, op10 and the pipeline."""

import hashlib
import re

import numpy as np
import pytest

from folia.llm import duck_bpe as B
from folia.llm import ordinal_quality as O
from folia.llm import pii_semicrf as P
from folia.llm import secret_forest as S
from folia.llm import spaced_decontam as D

EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x" * 30_000), (5, "tie tie tie")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 0.5, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tail double, start int")


# op5


def test_forest_on_held_out_findings():
    forest = S.trained()
    rows = list(S.labelled_findings(400, 77))
    assert np.mean([(forest(S.features(*r[:4])) >= 0.5) == bool(r[4]) for r in rows]) > 0.97


def test_secrets_found_and_cut_out(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [*EDGES, (7, f'so token = "{key}" it goes'), (8, f"see commit {key} for it"), (9, 'password: "hunterhunter!"')]
    got = {(r.doc_id, r.start, r.end): r.is_secret for r in S.findings(docs(spark, rows)).collect()}
    assert got[7, 12, 52] is True
    assert got[8, 11, 51] is False
    assert (9, 11, 24) in got and all(d in (7, 8, 9) for d, _, _ in got)
    cut = {r.doc_id: r for r in S.redact(docs(spark, rows)).collect()}
    assert cut[7].text == f'so token = "{S.REDACTED}" it goes' and cut[7].n_chars == len(cut[7].text) and cut[8].text == rows[-2][1] and cut[1].text is None
    assert S.findings(docs(spark, rows).limit(0)).count() == 0


# op6


def test_ordinal_fit_and_edges(spark):
    good, toxic, junk = "the quick words of a fine text ", "idiot scum trash ", "zz%%% yy%%% xx### "
    rows = [(i, (good * 6, good * 3 + toxic * 3, junk * 9)[i % 3] + f"w{i % 7}") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 != 2), int(i % 3 == 1)) for i in range(90)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = O.train(docs(spark, rows), labels)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in O.classify(docs(spark, rows), model).collect()}
    assert all(got[i].keep == (i % 3 == 0) for i in range(90))
    assert got[0].expected_grade > got[1].expected_grade > got[2].expected_grade
    edge = O.classify(docs(spark, EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.tail <= 1 for r in edge)
    assert {r.doc_id for r in O.keep_good(docs(spark, rows), model).collect()} == set(range(0, 90, 3))
    untrained = O.train(docs(spark, rows), labels.limit(0))
    assert all(r.keep for r in O.classify(docs(spark, rows), untrained).collect())


def test_ordinal_fit_reads_every_label(spark):
    words = ("fine text of words ", "idiot scum trash ", "zz%%% yy%%% ")
    rows = [(i, words[i % 3] * 5 + f"only{i}x") for i in range(90)] + [(0, "again")]
    labels = spark.createDataFrame([(i, int(i % 3 != 2), int(i % 3 == 1)) for i in range(95)], "doc_id long, quality int, toxic int")
    f, fit = O.Features(), O.CumulativeLink.fit
    got, shares = O.training_rows(docs(spark, rows), labels, 20)
    assert shares == 5 and {r.doc_id for r in got.collect()} == set(range(90))
    by = {s: sorted((r.doc_id, r.text, r.grade) for r in got.collect() if r.share == s and r.text != "again") for s in range(5)}
    models = [(fit([f(t) for _, t, _ in x], np.array([g for _, _, g in x]), 3), len(x)) for x in by.values() if x]
    model = O.train(docs(spark, rows[:-1]), labels, 20)
    assert sum(n for _, n in models) == 90
    assert np.allclose(model.weights, sum(m.weights * n for m, n in models) / 90, atol=1e-3)
    assert np.allclose(model.thresholds, sum(m.thresholds * n for m, n in models) / 90, atol=1e-3)
    again = O.train(docs(spark, rows[::-1]).repartition(7), labels, 20)
    assert np.array_equal(again.weights, O.train(docs(spark, rows), labels, 20).weights)


# op8

TEXTS = ["", "a" * 3000, "ab" * 700, " " * 999, "\n\n  \t x", "日本語テキスト😀😀", "it's we've I'll", "é" * 300, "Thonre ingedly, the heating of 12345 !!! ???", "\x00\x7f̀ ‍"]


def test_bpe_equals_the_public_encoder():
    import public_tokenizers as T
    import regex
    import tiktoken

    v = B.vocabulary(B._default_path())
    public = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("etaoin shrdlu"), 2000)) for _ in range(5)] + ["".join(chr(c) for c in rng.integers(1, 0x3000, 800))]
    got = [b"".join(x) for x in B.encode_texts(v, regex.compile(T.PATTERN), texts)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [public.encode_ordinary(t) for t in texts]
    assert v.decode(got) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        v.decode([np.array([60_000], "<u4").tobytes()])


def test_bpe_round_trip_and_digests(spark):
    df = docs(spark, [*EDGES, *enumerate(TEXTS, 50)])
    back = B.decode(B.encode(df)).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back)
    got = B.token_digests(df).collect()
    assert len(got) == len(back)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)} == {(0, empty, empty)}
    assert B.token_digests(df.limit(0)).count() == 0


# op9

ITEM = "the red fox runs over a lazy brown dog near the old stone bridge at dawn every single day"


def test_masks_find_thirteen_tokens_with_two_changes():
    import itertools

    for gone in itertools.combinations(range(13), 2):
        assert any(all(m[k] == "0" or o + k not in gone for k in range(len(m))) for m in D.MASKS for o in range(13 - len(m) + 1))


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_overlaps(spark, limit):
    words = ITEM.split()
    changed = " ".join("CHANGED" if i in (3, 9, 15) else w for i, w in enumerate(words))
    rows = [*EDGES, (11, f"before {ITEM}, after"), (12, f"Before {changed.upper()} after"), (13, " ".join(words[:8])), (14, " ".join(reversed(words)))]
    bench = spark.createDataFrame([(1, ITEM), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_tokens, r.n_equal) for r in D.overlaps(docs(spark, rows), bench, broadcast_bytes=limit).collect()}
    assert got == {(11, 1): (1, 19, 19), (12, 1): (1, 19, 16)}
    kept = D.without_overlaps(docs(spark, rows), bench, broadcast_bytes=limit)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 3, None, 4, 5, 13, 14], key=str)
    assert D.overlaps(docs(spark, rows).limit(0), bench).count() == 0 and D.overlaps(docs(spark, rows), bench.limit(0)).count() == 0


# op10


def defined(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.ORDER[s[0]]))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (974) 555-3436", "+12", "+1+123456789", " ", "é", "-", "%+-@a-.b", "a@b.c", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        assert P.base_spans(text) == defined(text), text


def test_field_on_held_out_snippets():
    model = P.trained()
    hit = wrong = missed = 0
    for text, gold in P.labelled_snippets(150, 55):
        got = {(i, j, k) for a, b in P.zones(text) for k, i, j in model.decode(P.Zone(text, a, b))}
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93


def test_find(spark):
    rows = [*EDGES, (7, "two 7536784127813050 4845168114407329 cards"), (8, "é mail a@b.co and 10.0.0.1")]
    got = {r.doc_id: r for r in P.find(docs(spark, rows)).collect()}
    assert got[7].n_card == 0 and "card:4:20" in got[7].spans.split(",")
    assert got[8].spans == "email:7:13,ip:18:26" and got[8].base_sha256 == hashlib.sha256(got[8].spans.encode()).hexdigest()
    assert got[1].spans == "" and P.find(docs(spark, rows)).count() == len(rows) and P.find(docs(spark, rows).limit(0)).count() == 0


# pipeline


def test_pipeline_stages_equal_brute_force(spark, data):
    import corpus_pipeline as C

    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "secrets", "tokens"]
    all_docs = spark.read.parquet(f"{data}/documents.parquet")
    model = O.train(all_docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r.asDict() for r in all_docs.collect()]
    f = O.Features()
    kept = [r for r in rows if model.tails(float((x := f(r["text"]))[1] @ model.weights[x[0]]))[1] >= 0.6]
    from folia.llm.simhash_gray import fingerprint

    fps = [fingerprint(r["text"]) for r in kept]
    up = list(range(len(kept)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)), key=lambda k: kept[k]["doc_id"])
                up[b] = a
    kept = [r for i, r in enumerate(kept) if top(i) == i]
    items = [D.tokens(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def leaked(text):
        t = D.tokens(text)
        for item in items:
            for o in range(-len(item), len(t)):
                lo, hi = max(0, o), min(len(t), o + len(item))
                equal = [t[k] == item[k - o] for k in range(lo, hi)]
                if sum(equal) >= 11:  # four in five of thirteen
                    _, n, same = D.best_stretch(np.array(equal))
                    if n >= 13 and same * 5 >= n * 4:
                        return True
        return False

    short = [r for r in kept if len(r["text"] or "") < 1500]
    want = {r["doc_id"] for r in short if not leaked(r["text"])}
    got = {r.doc_id: r for r in C.run(spark, data).collect()}
    assert {i for i in got if i in {r["doc_id"] for r in short}} == want
    assert set(got) <= {r["doc_id"] for r in kept}
