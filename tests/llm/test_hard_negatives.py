"""Hard negatives against scores of all pairs."""

import random

import numpy as np
import pytest

from vellum.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, rank int, block string, cell int"


def plain(rows, scale=256.0, every=100, most=5):
    """The contract, pair by pair."""
    import math
    sound = sorted({(i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, label, v, *_ in rows
                    if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    made = set()
    for i, label, q in sound:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), j, other) for j, other, r in sound]
        same = sorted({(s, j) for s, j, other in scored if other == label and j != i})[:most]
        for s, j in same:
            fit = sorted({(t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s})[:most]
            made |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1)}
    return made


def found(spark, rows, **settings):
    made = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    assert len(made) == len(set(map(tuple, made)))
    return {tuple(r) for r in made}


def row(i, label, vector):
    return (i, label, vector, 1, "x", 3)


@pytest.mark.parametrize("high, dims", [(160, 64), (1, 1), (3, 5), (1 << 28, 9)])
def test_scores_are_exact(high, dims):
    draw = np.random.default_rng(dims)
    anchors, others = (draw.integers(-high, high + 1, (n, dims)) for n in (9, 1100))
    made = np.concatenate([s for _, s in H.scores(H.tables(anchors), H.planes(others))])
    assert (made == others @ anchors.T).all()


def test_all_minus_one_needs_only_the_plane_of_the_sign():
    others, anchors = -np.ones((3, 4), np.int64), np.arange(8).reshape(2, 4)
    assert (np.concatenate([s for _, s in H.scores(H.tables(anchors), H.planes(others))]) == others @ anchors.T).all()


def test_against_all_pairs_with_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 64)
    monkeypatch.setattr(H, "BLOCK", 4)
    draw = random.Random(5)
    centres = [[draw.gauss(0, 0.2) for _ in range(9)] for _ in range(4)]
    rows = [row(i, 0 if i % 3 == 0 else draw.randrange(4), [round(c + draw.gauss(0, 0.1), 1) for c in draw.choice(centres)]) for i in range(700)]
    expected = plain(rows, every=20)
    assert len(expected) > 200 and found(spark, rows, every=20) == expected


def test_nulls_repeats_odd_lengths_and_an_empty_table(spark):
    draw = random.Random(6)
    good = [row(i, i % 3, [draw.uniform(0, 1) for _ in range(4)]) for i in range(0, 400, 4)]
    odd = [row(None, 1, [1.0]), row(3, None, [1.0]), row(7, 1, None), row(9, 1, [1.0, None]), row(100, 0, [float("nan")]), row(13, 1, [float("inf")]),
           row(11, 1, []), row(200, 1, [0.5]), row(200, 2, [0.25, 0.5]), row(17, 2, [0.0] * 4)]
    rows = good + odd + good[:20] + odd
    assert found(spark, rows) == plain(rows)
    assert found(spark, [row(1, 1, [3e38, -3e38]), row(100, 1, [3e38]), *good]) == plain(good)  # too large to be scored in 64 bits
    assert found(spark, []) == set()
    assert found(spark, [row(100, 1, [1.0])]) == set()
