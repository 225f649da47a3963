"""op10 on long runs, spelled-out addresses, and the field's segmentation against enumeration."""

import random
import re
import time

import numpy as np
import pytest

from folia.llm import pii_semicrf as P

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_runs_of_zeros_and_digits():
    assert [s for s in P.base_spans("0" * 5000 + ".1.2.3") if s[0] == "ip"] == [("ip", 0, 5006)]
    assert P.base_spans("9" * 5000 + ".1.2.3") == []
    began = time.time()
    P.spans("7" * 1_000_000 + " " + "1 " * 2000, P.trained())
    assert time.time() - began < 20


def test_ip_starts_are_those_of_the_plain_pattern():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("0012.. x") for _ in range(r.randint(0, 24)))
        ok = [m.span() for m in PLAIN_IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in P.base_spans(text) if s[0] == "ip"] == ok


def test_spelled_out_addresses_without_digits():
    text = "write to john at mail dot com or jane.roe [at] mail [dot] net at noon. we met at school."
    got = {text[a:b] for k, a, b in P.spans(text, P.trained())[1] if k == "email"}
    assert got == {"john at mail dot com", "jane.roe [at] mail [dot] net"}


def test_field_spans_never_touch_the_base():
    r = random.Random(9)
    for text, _ in P.labelled_snippets(120, 31):
        text += " +49 111 2345678 " * r.randint(0, 3)
        base, every = P.spans(text, P.trained())
        extra = [s for s in every if s not in base]
        assert all(j <= a or b <= i for _, i, j in extra for _, a, b in base) and set(base) <= set(every)
        assert all(j <= a for (_, _, j), (_, a, _) in zip(extra, extra[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_decoding_equals_enumeration(seed):
    r = random.Random(seed)
    text = "".join(r.choice(("12", "ab", " ", "@", ".", "-", "+")) for _ in range(9))
    zone, model = P.Zone(text, 0, len(text)), P.trained()
    scores = model.scores(zone).max(axis=1) if zone.segments else np.zeros(0)

    def best(at):
        if at >= len(zone.tokens):
            return 0.0
        return max([best(at + 1), *(float(scores[k]) + best(e) for k, (s, e, _) in enumerate(zone.segments) if s == at)])

    kinds = {(zone.at[i], zone.at[j]): float(scores[k]) for k, (i, j, _) in enumerate(zone.segments)}
    got = model.decode(zone)
    assert abs(sum(kinds[a, b] for _, a, b in got) - best(0)) < 1e-9
