"""op1, op3, op4: extraction, search and url verdicts."""

import numpy as np

from folia.llm import html_crf as H
from folia.llm.maxscore import top_k
from folia.llm.url_alias import Rule, judge_urls, page_edges


def test_blocks_of_broken_markup():
    page = "<html><head><title>t</title></head><body><nav><li><a href='/x'>menu</a></nav><!-- <p>no --><article><h1>Head &amp; &eacute; x</h1><p><b>One  two<br>three<p>Four &lt;5 <a href=y>link</a> end.<script>var a='</p>';</script></article><div hidden>gone</div>tail"
    assert [b.text for b in H.leaf_blocks(page)] == ["menu", "Head & é x", "One two three", "Four <5 link end.", "gone", "tail"]
    assert H.leaf_blocks(None) == H.leaf_blocks("") == H.leaf_blocks("<p></p><script>x") == []


def test_held_out_pages():
    model = H.trained()
    hit = total = 0
    for page, labels in H.labelled_pages(60, 91):
        blocks = H.leaf_blocks(page)
        got = model.viterbi([H.block_features(b, i, len(blocks)) for i, b in enumerate(blocks)])
        hit, total = hit + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert hit / total > 0.98


def test_extract_keeps_rows(spark):
    html = "<body><nav><a href=/>home</a></nav><article><h1>Title of it</h1><p>The first words. And more of them here.</p></article><footer>&copy; x</footer></body>"
    df = spark.createDataFrame([(1, "u", html, "e"), (2, None, None, "e"), (None, "u", "", "e"), (1, "u", html, "e")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()), key=str)
    text = "Title of it\nThe first words. And more of them here."
    assert got == sorted([(1, text, len(text)), (2, "", 0), (None, "", 0), (1, text, len(text))], key=str)
    assert H.extract(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(1)], "c") for i in range(300)]
    rows += [(300, None, "c"), (350, [1.0, float("nan")] + [0.0] * 6, "c"), (400, [1.0, None] + [0.0] * 6, "c"), (450, [0.5] * 3, "c"), (500, [], "c")] + [(600 + i, rows[0][1], "c") for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    ok = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0
    few = df.where("vec_id in (0, 1)")
    assert top_k(few, few.where("vec_id = 0"), 5).count() == 1


def test_url_verdicts(spark):
    rows = [
        (1, "http://a.example.com/x", "<link rel='canonical' href='http://bad.net/y#z'>"), (2, "http://bad.net/y", ""), (3, "https://B.org/fr/1", "<LINK href='/q' rel=canonical>"),
        (4, "https://b.org/q", "<meta http-equiv='refresh' content='0; url=http://bad.net/y'>"), (5, None, None), (6, "nohost", None), (7, "http://q.EXAMPLE.net/en/a?x#y", None),
        (8, "http://n.net", None), (9, "http://a.example.com/x#frag", ""), (10, "http://x.example.com/de/", None), (11, "ftp://u.info", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got == {
        1: ("a.example.com", "/x", None, "block"), 2: ("bad.net", "/y", "net/", "block"), 3: ("b.org", "/fr/1", "org/fr/", "allow"), 4: ("b.org", "/q", None, "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("q.example.net", "/en/a", "example.net/en/", "allow"), 8: ("n.net", "", None, "allow"),
        9: ("a.example.com", "/x", None, "block"), 10: ("x.example.com", "/de/", "example.com/de/", "block"), 11: ("u.info", "", None, "allow"),
    }
    many = [Rule(f"h{i}.tld", "/", "block") for i in range(300)] + [Rule("example.net", "/en/", "allow"), Rule("net", "/", "block")]
    joined = {r.page_id: r.rule for r in judge_urls(df, rules=many).collect()}
    assert joined[2] == "net/" and joined[7] == "example.net/en/" and joined[5] is None
    seen = spark.createDataFrame([("ftp://u.info", "http://bad.net/y")], "src string, dst string")
    assert {r.page_id: r.verdict for r in judge_urls(df, seen).collect()}[11] == "block"
    assert judge_urls(df.limit(0)).count() == 0


def test_rules_in_any_number_and_null_keys(spark):
    few = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow")]
    many = few + [Rule(f"h{i}.tld", "/", "block") for i in range(300)]
    df = spark.createDataFrame([(None, "http://n.net/x", None), (None, "http://n.net/x", None), (3, None, None), (4, "http://a.example.net/en/", None), (4, "http://h7.tld/q", None)], "page_id long, url string, html string")
    get = lambda rules: sorted(map(str, judge_urls(df, rules=rules).where("host <> 'h7.tld'").collect()))
    assert get(few) == get(many) and sum("'block'" in x for x in get(many)) == 2


def test_all_links_of_a_page_but_those_that_are_no_markup(spark):
    page = """<!-- <link rel=canonical href=http://no.net/1> --><script>'<link rel="canonical" href="http://no.net/2">'</script><link rel=canonical href=http://a.info/1>
    <link href='http://b.info/2' rel='canonical'><meta http-equiv=refresh content='3;url=http://c.info/3'><meta http-equiv="refresh" content="0; URL=/d">"""
    got = {r.dst for r in page_edges(spark.createDataFrame([("http://x.info/p", page)], "url string, html string")).collect()}
    assert got == {"http://a.info/1", "http://b.info/2", "http://c.info/3", "http://x.info/d"}


def test_chains_equal_their_sql(spark, data, duck):
    from folia.llm import queries as Q

    got = Q.url_alias_chains(spark, data)
    want = duck.sql(Q.CHAINS_SQL)
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(str, want.fetchall()))
    assert got.where("alias_block").count() > 0
