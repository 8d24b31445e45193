import hashlib
import itertools
import math
import random
import re

import pytest

from vellum.llm import personal_data

DOCS = "doc_id long, text string, spans string, masked int, c0 string"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def check_digit(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (2 if place % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = [True, kind != 1 or all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and check_digit(digits), 9 <= len(digits) <= 15][kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


TEXTS = ["", None, "no data", "a@b.c x.y+1@m-1.co.uk, @b.c a@@b.c a@b a@b..c a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 1.2.3 .1.2.3.4.",
         "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 411111111111111 0000000000000000000 4111  1111", "9" * 3000 + " 5500005555555559",
         "+1 (017) 555-7713 +12345678 +123456789012345 +1234567890123456 ++4 20 7946 0958) +1(((2", "é 1.2.3.4 ü a@b.ch ñ", "+1 (826) 555-4081 190.137.2.1",
         "4111111111111111 4111111111111111", "a" * 50_000 + "@x.y", "x@" * 3000, "+1" * 500, "1." * 2000 + "1"]


@pytest.mark.parametrize("seed", range(40))
def test_rules_are_the_plain_patterns(seed):
    draw = random.Random(seed)
    for text in TEXTS if seed == 0 else ["".join(draw.choice(["a", "1", "23", "@", ".", "+", "-", " ", "(", ")", "%", "é", "255", "4111111111111111", "256"]) for _ in range(80)) for _ in range(60)]:
        if len(text or "") < 20_000:
            assert personal_data.rules(text or "") == plain(text or ""), text


@pytest.fixture(scope="module")
def field():
    made = personal_data.Field({})
    made.learn(personal_data.made_up(random.Random(7)))
    return made


def read(field, text):
    return [s for a, b in personal_data.islands(text) for s in field.best(text, a, b)]


def test_model_on_unseen_sentences(field):
    right = [read(field, text) == gold for text, gold in personal_data.made_up(random.Random(99))]
    assert sum(right) >= 0.98 * len(right)


def test_model_adds_what_rules_miss(field):
    for text, kind, span in [("write to jo.doe(at)mail.org now", "email", "jo.doe(at)mail.org"), ("call 415-555-2671, please", "phone", "415-555-2671")]:
        base, spans = personal_data.all_spans(text, field)
        assert base == [] and [(personal_data.KINDS[k], text[s:e]) for s, k, e in spans] == [(kind, span)]


@pytest.mark.parametrize("text", ["call 415-555-2671 or +1 (017) 555-7713", "x 4111111111111111 a(at)b.org 1.2.3.4"])
def test_best_reading_is_the_best_of_all(field, text):
    """Dynamic programming against every set of segments that do not overlap."""
    for start, end in personal_data.islands(text):
        borders, found = personal_data.segments(text, start, end)
        scored = [(max(field.scores(personal_data.features(text, borders[i], borders[j]))), i, j) for i, j in found]
        scored = sorted([s for s in scored if s[0] > 0], reverse=True)[:12]
        def total(some):
            some = sorted(some, key=lambda s: s[1])
            return sum(s[0] for s in some) if all(a[2] <= b[1] for a, b in zip(some, some[1:])) else -math.inf
        most = max(total(c) for n in range(4) for c in itertools.combinations(scored, n))
        got = sum(max(field.scores(personal_data.features(text, s, e))) for s, _, e in field.best(text, start, end))
        assert got == pytest.approx(most)


def test_rows(spark):
    rows = [(i, t, "s", 1, "c") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None, None), (3, TEXTS[3], "s", 1, "c")]
    got = personal_data.detected(spark.createDataFrame(rows, DOCS), ["doc_id", "c0"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (TEXTS[3] if r["doc_id"] is None else TEXTS[r["doc_id"]]) or ""
        base = plain(text) if len(text) < 20_000 else [(0, 0, len(text))]
        named = [f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(named) <= set(r["spans"].split(",")) | {""}
        assert (r["masked"] is None) == (r["doc_id"] == 1)
    assert {r["doc_id"]: r["masked"] for r in got}[8] == "é <IP> ü <EMAIL> ñ"
    assert personal_data.detected(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
