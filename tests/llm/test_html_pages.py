"""op1 on hand-written pages and against enumeration."""

import itertools
import random

import pytest

from folia.llm import html_crf as H

ARTICLE = "The old bridge was opened again on Monday after two years of work. Hundreds of people came to see it."


def test_parts_that_were_dropped_are_read():
    page = f"""<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>All</a></li></ul></nav>
    <article><h1>Bridge opens</h1><p>{ARTICLE}</p><p hidden>A hidden article part that says more of the same bridge.</p>
    <p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> as they say in the town.</p><object data=a>These fallback words say what the picture shows.</object>
    <p>{ARTICLE}</p></article><footer>&copy; town.example &middot; all rights reserved</footer></body></html>"""
    text = H.main_text(page, H.trained())
    for part in ("Bridge opens", "A hidden article part", "Energy is E = m as" if "E = m" in text else "Energy is E=m as", "These fallback words", ARTICLE):
        assert part in text
    assert "Home" not in text and "rights" not in text


def test_scripts_styles_and_markup_comments_go():
    page = f"<body><main><h1>One</h1><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>not this</p> --><p>{ARTICLE}<p>{ARTICLE}</main><div class=footer>Copyright town</div>"
    assert H.main_text(page, H.trained()) == f"One\n{ARTICLE}\n{ARTICLE}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "no markup at all", "<p>" * 3000, "<ul>" + "<li>" * 2000, "&#x110000;&bogus;<p>a</q></p>"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page, H.trained()), str)


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_equals_enumeration(seed):
    r = random.Random(seed)
    model = H.trained()
    names = list(model.table)
    blocks = [[r.choice(names) for _ in range(4)] for _ in range(r.randint(1, 8))]

    def score(y):
        return sum(model.table[f][k] for fs, k in zip(blocks, y, strict=True) for f in fs) + sum(float(model.moves[a, b]) for a, b in itertools.pairwise(y))

    best = max(score(y) for y in itertools.product((0, 1), repeat=len(blocks)))
    assert abs(score(model.viterbi(blocks)) - best) < 1e-9
