import hashlib

import numpy as np
import pytest

from vellum.llm import suffix_dedup, suffix_sort

DOCS = "doc_id long, text string, spans string, text_hash int, kept string"


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 1 + int(rng.choice([1, 2, 3, 250])), int(rng.integers(0, 400))).astype(np.uint8)
    if seed % 3 == 0 and len(text):
        text = np.concatenate((text, text[:100], [1] * 80, text)).astype(np.uint8)
    raw = text.tobytes()
    for depth in (9, 50, 600):
        order = suffix_sort.suffix_array(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        prefixes = [raw[i:i + depth] for i in order]
        assert prefixes == sorted(prefixes)
        words = suffix_sort.words_at(text, depth + 8)
        inner = order[order <= len(text) - depth]
        equal = [raw[a:a + depth] == raw[b:b + depth] for a, b in zip(inner, inner[1:])]
        assert suffix_sort.adjacent_equal(inner, words, depth).tolist() == equal


def brute(rows):
    first = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                first[data[i:i + 50]] = min(doc, first.get(data[i:i + 50], doc))
    result = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            if doc is not None and first[data[i:i + 50]] < doc:
                gone[i:i + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        result.append((doc, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return result


def make(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    shared = [sentence(n) for n in (3, 9, 11, 14, 40, 200)]
    texts = [sentence(int(rng.integers(0, 60))) + " " + " ".join(rng.choice(shared, rng.integers(0, 4))) + sentence(5) for _ in range(40)]
    texts += [texts[3], texts[3], texts[4][:120], texts[5][10:], shared[4], shared[4][:49], shared[4][1:51], "", None, "a" * 49, "a" * 50, "a" * 51,
              "ab" * 400, "ba" * 400, "x" * 3000, "y" + "x" * 2999, texts[6] + "\n" + texts[6], texts[7][:200] + "Q" + texts[7][201:], "é" * 100]
    ids = rng.permutation(len(texts) * 3)[:len(texts)] - 20
    rows = [(int(i), t, "s", 1, "k") for i, t in zip(ids, texts)]
    return rows + [rows[3], (rows[4][0], shared[5], None, None, None), (None, shared[5], None, None, None), (None, None, "", 2, "")]


@pytest.mark.parametrize("small", [False, True])
def test_against_every_window(spark, small, monkeypatch):
    rows = make(11 + small)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    if small:  # the same in one process, in blocks and flushes of a few bytes
        for name, value in (("BLOCK", 64), ("FLUSH_KEYS", 30), ("FLUSH_BYTES", 500)):
            monkeypatch.setattr(suffix_dedup, name, value)
        for data in ([r[1] or "" for r in rows]):
            data = data.encode()
            batches = [{"doc_id": [1], "text_hash": [2], "text": [data.decode()]}]
            class Batch(dict):
                def column(self, name):
                    return type("C", (), {"to_pylist": lambda s, v=self[name]: v})()
            windows = []
            for pieces in suffix_dedup.blocks([Batch(b) for b in batches]):
                which, start, count, _ = suffix_dedup.runs([p[3] for p in pieces])
                windows += [pieces[w][2] + s + i for w, s, n in zip(which, start, count) for i in range(n)]
            assert windows == list(range(max(0, len(data) - 49)))
        return
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    # rows with one id are one document to each other
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(5)
    common = bytes(rng.integers(97, 101, 300).astype(np.uint8))
    texts = [bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) + common + b"z" * int(n) for n in rng.integers(0, 200, 20)]
    keys = {}
    which, start, count, key = suffix_dedup.runs(texts)
    for w, s, n, k in zip(which, start, count, key):
        for i in range(n):
            assert keys.setdefault(texts[w][s + i:s + i + 50], k) == k


def test_merged_spans():
    spans = np.array([[5, 9], [0, 3], [9, 12], [6, 8], [20, 21]])
    assert suffix_dedup.merged(spans).tolist() == [[0, 3], [5, 12], [20, 21]]
    assert suffix_dedup.merged(np.zeros((0, 2), np.int64)).tolist() == []


def test_a_phrase_in_many_surroundings_is_no_large_group(spark, monkeypatch):
    """One key with many different strings: its windows are dealt anew, with the results of every window."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_MOST", 4000, raising=False)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700, raising=False)
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh é\0"), n))
    passages = [letters(60) + "the same phrase!" + letters(60) for _ in range(30)]
    texts = [letters(40) + passages[int(rng.integers(30))] + letters(40) + "the same phrase!" + letters(40) for _ in range(120)]
    rows = [(int(i), t, "s", 1, "k") for i, t in zip(rng.permutation(len(texts)), texts)] + make(4)
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    docs = spark.createDataFrame(rows, DOCS).where("doc_id is not null and octet_length(text) >= 50").repartition(3)
    shared = suffix_dedup.shared_keys(suffix_dedup.key_blocks(docs.selectExpr("doc_id", "text", "xxhash64(text) as text_hash"), 1), 1)
    found = suffix_dedup.candidates(docs.selectExpr("doc_id", "text", "xxhash64(text) as text_hash"), shared, 1)
    parts = suffix_dedup.overfull(found)
    dealt = suffix_dedup.dealt_windows(found.where("bucket = 0").selectExpr("*", f"{parts[0]} as n_parts")).collect()
    sizes = {}
    for r in dealt:
        sizes[r["part"]] = sizes.get(r["part"], 0) + len(suffix_dedup.common.unpacked(r["strings"]))
    assert len(sizes) == parts[0] > 10 and max(sizes.values()) < 2 * 4000
