import itertools
import re

import numpy as np
import pytest

from vellum.llm import spaced_seeds

DOCS = "doc_id long, text string, item_id long, keys int, text_hash string"


@pytest.mark.parametrize("length", [10, 13, 14, 15, 17, 19, 20, 22])
def test_masks_meet_every_worn_copy(length):
    """However a fifth of the words of a copy is chosen to be replaced, some mask fits between them."""
    for bad in itertools.combinations(range(length), length // 5):
        assert any(not {o + i for i in mask} & set(bad) for mask in spaced_seeds.MASKS for o in range(length - mask[-1])), bad


def words(text):
    found = [w.strip(spaced_seeds.PUNCTUATION.decode()) for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    return [w for w in found if w]


def brute(docs, items):
    """Every item on every diagonal of every document."""
    hits = set()
    for doc, text in docs:
        own = words(text)
        for item, item_text in items:
            other = words(item_text)
            if len(other) < spaced_seeds.SPAN:
                continue
            for diagonal in range(-len(other), len(own)):
                pairs = [(own[diagonal + i], w) for i, w in enumerate(other) if 0 <= diagonal + i < len(own)]
                same = [x == y for x, y in pairs]
                most = max((sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                            if 100 * sum(same[a:b]) >= spaced_seeds.SHARE * (b - a)), default=0)
                if most >= min(spaced_seeds.LEAST, len(other)):
                    hits.add((doc, item))
    return hits


def made(seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 500)}"
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(int(n)))) for i, n in enumerate([15, 22, 40, 9, 8, 7, 1])] + [(7, ""), (8, None), (None, " ".join(text(20)))]
    items += [items[2], (20, items[2][1])]
    docs = []
    for i in range(60):
        own = text(int(rng.integers(0, 80)))
        if i % 2:
            copy = (items[int(rng.integers(0, 10))][1] or "x").split()
            copy = copy[int(rng.integers(0, 8)):] if i % 4 == 1 else copy
            for _ in range(int(rng.integers(0, 4))):
                if copy:
                    copy[int(rng.integers(0, len(copy)))] = word()
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = [w.upper() + "***" if i % 3 == 0 else w + "," for w in copy]
            if i % 5 == 0:
                own = " | ".join(own).split()
        docs.append((i * 3, " ".join(own)))
    return docs + [docs[1], (None, items[0][1]), (1003, None), (1004, ""), (1005, items[1][1] * 2), (1006, (items[1][1] + " ") * 300)], items


@pytest.mark.parametrize("seed", range(2))
def test_against_every_diagonal(spark, seed):
    docs, items = made(seed)
    frame = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], DOCS).repartition(2)
    benchmark = spark.createDataFrame([(i, t, "hash") for i, t in items], "item_id long, text string, hash string")
    got = spaced_seeds.contaminations(frame, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    assert len({(r["doc_id"], r["text_hash"], r["item_id"]) for r in got}) == len(got)
    for r in got:
        assert r["n_equal"] <= r["n_words"] and r["n_equal"] * 100 >= r["n_words"] * 80
    kept = spaced_seeds.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    bad = {d for d, _ in brute(docs, items)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        (d is None, d or 0, t or "") for d, t in docs if d not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l", 1, 1, "")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert spaced_seeds.contaminations(none, items).count() == 0
    assert spaced_seeds.contaminations(some, items.limit(0)).count() == 0
    assert spaced_seeds.without_contaminated(some, items.limit(0)).count() == 1
    assert spaced_seeds.contaminations(some, items).first()["n_equal"] == 12
