import os
import random
import zlib

import numpy as np
import pytest

from vellum import session
from vellum.llm import packing, token_records
from vellum.llm.encoding import Encoder, tokenizer_file

TEXTS = [
    "", "a", "Plain words, two lines.\nAnd  a double space \n\n then tabs\tand trailing space ", None, " lead", "\n\n",
    "no break  space", "ça vá ́ x", "it's we'll 12 345,6", "!!\x1c!! a\x1c b", "<|endoftext|> x",
    "ab <|endoftext|> cd<|startoftext|>.", "a <|ENDOFTEXT|> b", "half <|end of it", "two | bars, one.) \"end.\" 'quote'... 3.5, x!?\"", "Don't. it's, (we'll) o'clock' 's. é. ä,",
    "你好 世界 \U0001f600\U0001f600", "x" * 5000, "word " * 9000, "TAB\t\tTAB \r\n end",
]
DOCS = "doc_id long, text string, file string, part long, length long"


def plain(name):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_as_whole_texts(name):
    direct, cached = plain(name), Encoder(tokenizer_file(name), keep=40)
    for again in range(2):
        got = cached.encode([t or "" for t in TEXTS])
        assert [g.tolist() for g in got] == [direct(t) for t in TEXTS], again
    assert cached.encode([]) == []


def test_long_text_is_cut_between_words(monkeypatch):
    from vellum.llm import encoding
    monkeypatch.setattr(encoding, "CHUNK", 50)
    text = "some  words\nof \n different length " * 40 + "y" * 300 + " end"
    assert Encoder(tokenizer_file("byte_bpe_50k.json")).encode([text])[0].tolist() == plain("byte_bpe_50k.json")(text)


def test_records_round_trip(spark):
    rows = [(i * 3 - 4, t, "f", 1, 2) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "f", 1, 2), (None, "no id", None, None, None)]
    folder = session.fresh_folder(spark, "records")
    token_records.write_records(spark.createDataFrame(rows, DOCS), folder, tokenizer_file("byte_bpe_50k.json"), 2)
    index = token_records.read_index(spark, folder)
    read = token_records.read_records(index, folder).collect()
    encode, start = plain("byte_bpe_50k.json"), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(read, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in ordered]
    for row, record in zip(ordered, got):
        ids = np.frombuffer(record["ids"], "<u4").tolist()
        assert ids == encode(row[1]) + [2] and record["start"] == start
        start += len(ids)
    # any part of the index can be read on its own
    one = index.where("doc_id = 2").limit(1)
    assert np.frombuffer(token_records.read_records(one, folder).first()["ids"], "<u4").tolist() == encode(TEXTS[2]) + [2]


def test_empty_table(spark):
    folder = session.fresh_folder(spark, "records")
    token_records.write_records(spark.createDataFrame([], DOCS), folder, tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_records.read_records(token_records.read_index(spark, folder), folder).count() == 0


@pytest.mark.parametrize("at", [0, 9, 12, 14, -1])
def test_damage_is_found(at):
    record = bytearray(token_records.frame(np.arange(5, dtype="<u2")))
    assert token_records.unframe(bytes(record)).tolist() == [0, 1, 2, 3, 4]
    record[at] ^= 1
    with pytest.raises(token_records.BadRecord):
        token_records.unframe(bytes(record))


def best_fit(lengths, capacity):
    """One piece after another: the tightest open sequence that fits."""
    left = []
    for length in sorted(lengths, reverse=True):
        fit = min((room, i) for i, room in enumerate(left + [capacity]) if room >= length)[1]
        if fit == len(left):
            left.append(capacity)
        left[fit] -= length
    return sorted(left)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 70))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 400))
    if seed % 3 == 0:
        lengths = np.minimum(lengths, rng.integers(1, capacity + 1))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    rows, sequences = packing.plan(counts, capacity)
    used = np.zeros(sequences, int)
    for length, count in sorted(counts.items(), reverse=True):
        own = rows[rows[:, 0] == length]
        for rank in range(count):
            _, start, first, each, offset = own[own[:, 1] <= rank][-1]
            at = first + (rank - start) // each
            assert used[at] == offset + (rank - start) % each * length  # in the order of planning there are no gaps
            used[at] += length
    assert sorted((capacity - used).tolist()) == best_fit(lengths.tolist(), capacity)


def test_pack(spark):
    rows = [(i, t, "f", 1, 2) for i, t in enumerate(TEXTS)] + [(0, "again " * 70, None, None, None), (None, "b", "", 0, 0)]
    packed = packing.pack(packing.pieces(spark.createDataFrame(rows, DOCS), tokenizer_file("word_bpe_49k.json"), 1, 64), 64).collect()
    encode = plain("word_bpe_49k.json")
    want = []
    for doc, text, *_ in rows:
        ids = encode(text) + [1]
        want += [(doc, n, s, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in packed], key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 64
    assert sorted(64 - v for v in filled.values()) == best_fit([w[3] for w in want], 64)


def test_pack_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS), tokenizer_file("word_bpe_49k.json"), 1, 64), 64).count() == 0


def test_files_of_lost_attempts_are_not_read(spark):
    folder = session.fresh_folder(spark, "records")
    docs = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    token_records.write_records(docs, folder, tokenizer_file("byte_bpe_50k.json"), 2)
    system, base = token_records.file_system(folder)
    with system.open_output_stream(os.path.join(base, "part-000000-lost.rec")) as out:
        out.write(b"half a reco")
    assert token_records.read_records(token_records.read_index(spark, folder), folder).count() == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_punctuation_encode_as_in_their_texts(name):
    draw, direct = random.Random(4), plain(name)
    texts = ["".join(draw.choice(["ab", "It", "'s", "'", ".", ",\"", "(", ")", "!?", " ", "  ", "\n", "é", "9", "-", "<|", "\u0301", "ll", "'ll"]) for _ in range(draw.randrange(30))) for _ in range(1500)]
    assert [g.tolist() for g in Encoder(tokenizer_file(name)).encode(texts)] == [direct(t) for t in texts]


def test_long_words_are_not_kept():
    own = Encoder(tokenizer_file("byte_bpe_50k.json"))
    own.encode(["short " + "x" * 5000 + ". " + "y" * 5000])
    assert max(map(len, own.known)) < 200
