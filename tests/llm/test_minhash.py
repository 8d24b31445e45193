import collections
import re

import numpy as np
import pytest

from vellum.llm import common, minhash
from vellum.llm.components import components

DOCS = "doc_id long, text string, node long, n int, component string, signature binary"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted([(d, len(shingles(t, width)), c, d is None or d == c) for d, t, c in brute_rows(rows, width, percent)], key=key)


def brute_rows(rows, width, percent):
    sets = [shingles(t, width) if d is not None else set() for d, t in rows]
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = doc if least[root(i)] is None else min(doc, least[root(i)])
    return [(doc, text, None if doc is None else least[root(i)]) for i, (doc, text) in enumerate(rows)]


def make(seed, family):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Word"]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    texts = []
    for size in (30, 120, 500):
        base = text(size)
        for _ in range(family):
            copy = list(base)
            for at in rng.integers(0, size, rng.integers(0, max(2, size // 25))):
                copy[at] = vocabulary[rng.integers(0, 400)]
            texts.append(" ".join(copy[:size - int(rng.integers(0, size // 12))]))
    texts += [" ".join(text(int(n))) for n in rng.integers(0, 60, 30)]
    texts += [texts[0].upper(), texts[0] + "\n", texts[1].replace(" ", "\t \x0b"), "", None, "  \n", "one", "One", "one two", "é one", "É one", "a b c", "a b c d", "x " * 500]
    ids = rng.permutation(len(texts) * 2)[:len(texts)] - 7
    rows = list(zip(ids.tolist(), texts))
    return rows + [rows[2], (None, texts[3]), (None, None), (rows[5][0], "another text under an id that is there")]


@pytest.mark.parametrize("width,percent,part,block", [(3, 85, 2000, 2000), (5, 80, 7, 9)])
def test_against_all_pairs(spark, monkeypatch, width, percent, part, block):
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = make(width, 40)
    frame = spark.createDataFrame([(d, t, 1, 2, "c", b"") for d, t in rows], DOCS).repartition(3)
    got = sorted(map(tuple, minhash.near_copies(frame, width, percent).drop("text_hash").collect()), key=lambda r: tuple((x is not None, x or 0) for x in r))
    want = brute(rows, width, percent)
    assert got == want
    left = minhash.without_near_copies(frame, width, percent)
    assert left.columns == frame.columns
    kept = {(d, t or "") for d, t in rows if d is None or d == next(w[2] for w in brute_rows(rows, width, percent) if w[:2] == (d, t))}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((d is None, d or 0, t) for d, t in kept)


def test_empty_table(spark):
    assert minhash.near_copies(spark.createDataFrame([], DOCS), 3, 85).count() == 0


def test_minima_tell_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 64, 2000, np.uint64)
    for kept in (1000, 1600, 1900):
        other = np.concatenate((base[:kept], rng.integers(0, 1 << 64, 2000 - kept, np.uint64)))
        signature = minhash.minima([base, other], 1024).astype(np.uint8)
        assert minhash.likeness(signature[0], signature[1:])[0] == pytest.approx(kept / (4000 - kept), abs=0.06)


def test_bands_are_enough():
    for similarity in (0.8, 0.85):
        assert (1 - similarity ** minhash.ROWS) ** minhash.bands_for(similarity) <= 1 / minhash.MISS


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 290)] + [(300, i) for i in range(301, 400)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_groups_over_batches():
    import pyarrow as pa
    values = [1, 1, 2, 3, 3, 3, 3, 3, 4]
    for cut in range(1, 6):
        batches = [pa.RecordBatch.from_pydict({"k": values[i:i + cut], "v": list(range(i, min(i + cut, 9)))}) for i in range(0, 9, cut)]
        assert [g.column("v").to_pylist() for g in common.groups(iter(batches), ["k"])] == [[0, 1], [2], [3, 4, 5, 6, 7], [8]]


def test_texts_are_shuffled_once(spark):
    """Dropping near copies and repeated rows deals texts out by the same keys."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        left = minhash.without_near_copies(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string"), 3, 85)
        plan = left._jdf.queryExecution().executedPlan().toString()
        rows = left.select("doc_id", "text").collect()
    finally:
        spark.conf.set(key, before)
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "own_" in line]) == 1
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "a b c d"), (None, "a b c d"), (None, None)], key=str)
