"""Language-model scores from a log-frequency Bloom filter that holds quantised n-gram counts.

The filter never stores an n-gram. A count c is quantised to q = 1 + floor(log2 c), and the n-gram is put into a Bloom
filter once for each level up to q. Reading probes level after level until one is missing; the levels found give the
count back as the mean of its range. A false count needs a false positive at every level above the true one, so
its size is bounded by falling odds.

Tokens are words between ASCII white space with A-Z in lower case, then one end per document. Words and pairs (word,
follower; a start stands before the first) are counted over all training documents. The probability of a token mixes both:

    P(w | v) = m c(v w) / c(v) + (1 - m) P(w),    m = MIX c(v) / (c(v) + PRIOR),    P(w) = (c(w) + 1) / (N + V + 1)

with the counts c read from the filter, and N tokens and V different ones counted exactly. c(v w) counts as at most c(v).

How it is spread:

1. Documents are gathered in blocks of about BLOCK_TOKENS tokens, which are written once, packed.
2. Tasks count the n-grams of a block and send them, packed, to segments of the key space, whose number grows with the text. An
   n-gram of a third of all tokens is one entry per block. N-grams of held-out documents go along with a count of 0.
3. A segment adds the counts up, puts its n-grams into its slice of the filter, and probes the slice for all n-grams it was sent.
   The levels found go back to each block in the order in which it sent its n-grams, and with them the exact counts of its words,
   which the base score needs. So an n-gram travels once per block, and its levels, a few bits each, come back.
4. A block meets its answers and all its documents are scored.

Nothing is broadcast, and no word or pair is left out of the filter. Words are known by their hash alone.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vellum import session
from vellum.llm import common
from vellum.llm.common import SlicedFilter

HEAD = 200_000
MIX, PRIOR = 0.7, 50.0
BITS_PER_KEY, PROBES = 10, 4
MOST_BYTES = 32 << 20  # of a filter small enough to be broadcast
KEYS_PER_SEGMENT = 1 << 20
TOKEN_BYTES = 6  # bytes of text for one token, about
BLOCK_TOKENS = 1_000_000
LEVELS = 64
ODD = np.uint64(1)
PAIR = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
LEVEL = 0xD1B54A32D192ED03

# Words of up to LONG bytes are hashed side by side: a sum of a number for each byte times a power for its place.
CHUNK, LONG = 1 << 20, 64
SPACES = b" \t\n\x0b\x0c\r"
WHITE = np.isin(np.arange(256), list(SPACES))
BYTE = common.mix(np.arange(1, 257, dtype=np.uint64) * PAIR)
BASE = 0x5851F42D4C957F2D
POWERS = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, BASE, np.uint64)], dtype=np.uint64)
INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
START, END = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b"\t", b"\n"))  # no word holds these bytes


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of word pairs, all odd, from the keys of their words."""
    return common.mix(left * PAIR + (right ^ (right >> np.uint64(29)))) | ODD


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of single words, all even, from the hashes of words."""
    return words & ~ODD


def level_keys(keys: np.ndarray, level: int) -> np.ndarray:
    """Keys under which a level of these n-grams is stored; they stay in the segment of the n-gram."""
    return (keys & ~LOW) | (common.mix(keys + np.uint64(LEVEL * level & 0xFFFFFFFFFFFFFFFF)) & LOW)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts that have a level; 0 for none, exactly 1 for the first."""
    return np.where(levels > 0, (np.exp2(levels - 1.0) + np.exp2(levels) - 1) / 2, 0.0)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of `data`, in lower case, begin, and their hashes; a chunk at a time, cut at white space."""
    begins, hashes, at = [], [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in SPACES)
            if cut < 0:  # one word longer than a chunk
                ends = [p for p in (data.find(c, end) for c in SPACES) if p >= 0]
                end = min(ends, default=len(data))
                begins.append(np.array([at]))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
                at = end
                continue
            end = cut + 1
        raw = np.frombuffer(data, np.uint8)[at:end]
        edges = np.flatnonzero(np.diff(WHITE[raw], prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * POWERS[:len(raw)], out=sums[1:])
        made = common.mix((sums[last] - sums[first]) * INVERSES[first] + (last - first).astype(np.uint64))
        for i in np.flatnonzero(last - first > LONG).tolist():
            made[i] = xxhash.xxh3_64_intdigest(data[at + first[i]:at + last[i]])
        begins.append(at + first)
        hashes.append(made)
        at = end
    return np.concatenate(begins or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def transitions(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of texts, at most BLOCK_TOKENS at a time: the one before each, it, and the number of its text."""
    for some in common.slices(texts):
        data = [t.encode().lower() for t in texts[some.start:some.stop]]
        sizes = np.array([len(d) + 1 for d in data])
        at, words = word_hashes(b" ".join(data))
        of = np.searchsorted(np.cumsum(sizes), at, "right")
        held = np.bincount(of, minlength=len(data)) + 2  # a start and an end
        stops = np.cumsum(held)
        keys = np.zeros(stops[-1], np.uint64)
        inner = np.ones(len(keys), np.bool_)
        inner[stops - 1] = inner[stops - held] = False
        keys[inner], keys[stops - 1], keys[stops - held] = words, END, START
        follows = np.ones(len(keys), np.bool_)
        follows[stops - held] = False  # a start is given, not scored
        follows, number = np.flatnonzero(follows), np.repeat(np.arange(some.start, some.stop), held)
        for first in range(0, len(follows), BLOCK_TOKENS):
            part = follows[first:first + BLOCK_TOKENS]
            yield keys[part - 1], keys[part], number[part]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the number of each key among them."""
    codes, different = pd.factorize(keys)
    order = np.argsort(different)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return different[order], rank[codes]


def per_segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment begins among keys in order, and the end."""
    return np.searchsorted(common.segment_of(keys, segments).astype(np.int64), np.arange(segments + 1))


def halves(keys: np.ndarray) -> np.ndarray:
    """The lower halves of keys of one segment, which are enough within it."""
    return (keys & LOW).astype(np.uint32)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers packed byte by byte: all their first bytes, all their second ones, and so on, as the last are mostly zeros."""
    return common.packed(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(common.unpacked(data, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Keys in order, packed by their differences."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def from_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(from_planes(data, kind), dtype=kind)


def blocks_of(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Consecutive parts with about BLOCK_TOKENS tokens together; a part begins with an array of its tokens."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    different, number = np.unique(np.concatenate(keys), return_inverse=True)
    return different, np.bincount(number, np.concatenate(counts), len(different)).astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The different keys in order, where those of each list are among them, and their summed counts."""
    different, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts), len(different)).astype(np.int64)
    return different, np.split(number, np.cumsum([len(k) for k in keys])[:-1]), total


def lowest_level(held: np.ndarray, room: float) -> int:
    """The lowest level such that n-grams from it on, held[level] of each, have no more keys than `room`."""
    keys = np.cumsum((held * np.arange(len(held)))[::-1])[::-1]
    return int(np.flatnonzero(np.append(keys, 0) <= room)[0])


COUNTED = "segment int, words binary, word_counts binary, pairs binary, pair_counts binary"


def counted(training: DataFrame, segments: int) -> DataFrame:
    """The n-grams of `training` (text) per segment: words with 64-bit hashes, pairs with the lower halves of theirs, packed
    in order with their counts; N and V of the segment, how many n-grams have each level and words each class of counts.

    A class is an eighth of a doubling. The start counts as a word in levels, not in N, V and classes.
    """
    def count(batches):
        for block in blocks_of(part for batch in batches for part in transitions(common.strings(batch))):
            left, right = (np.concatenate([part[i] for part in block]) for i in (0, 1))
            words, word = numbered(np.append(right, left[left == START]))
            pairs, pair = numbered(pair_keys(left, right))
            word_counts, pair_counts = np.bincount(word).astype(np.uint32), np.bincount(pair).astype(np.uint32)
            of_words, of_pairs = per_segment(words, segments), per_segment(pairs, segments)
            some = np.flatnonzero((np.diff(of_words) > 0) | (np.diff(of_pairs) > 0)).tolist()
            w, p = ([slice(of[s], of[s + 1]) for s in some] for of in (of_words, of_pairs))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(column, pa.binary()) for column in (
                [steps(words[at]) for at in w], [planes(word_counts[at]) for at in w],
                [steps(halves(pairs[at])) for at in p], [planes(pair_counts[at]) for at in p]))],
                names=["segment", "words", "word_counts", "pairs", "pair_counts"])

    def add(key, table):
        column = {c: [read(v, kind) for v in table.column(c).to_pylist()]
                  for c, kind, read in (("words", "u8", from_steps), ("word_counts", "u4", from_planes),
                                        ("pairs", "u4", from_steps), ("pair_counts", "u4", from_planes))}
        words, word_counts = summed(column["words"], column["word_counts"])
        pairs, pair_counts = summed(column["pairs"], column["pair_counts"])
        own = word_counts[words != START]
        levels = np.bincount(levels_of(np.append(word_counts, pair_counts)), minlength=LEVELS)
        classes = np.bincount(np.floor(np.log2(own) * 8).astype(np.int64), minlength=8 * LEVELS)
        return pa.table({"segment": table.column("segment")[:1], "words": [steps(words)], "word_counts": [planes(word_counts)],
                         "pairs": [steps(pairs)], "pair_counts": [planes(pair_counts)], "tokens": [int(own.sum())],
                         "different": [len(own)], "levels": [levels.tolist()], "classes": [classes.tolist()]})

    return (common.mapped(training.select("text"), count, COUNTED).groupBy("segment")
            .applyInArrow(add, COUNTED + ", tokens long, different long, levels array<long>, classes array<long>"))


def added_up(counts: DataFrame, column: str, size: int) -> np.ndarray:
    """The sums of arrays of `size` numbers."""
    sums = counts.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()
    made = np.zeros(size, np.int64)
    for at, n in sums:
        made[at] = n
    return made


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words, as hashes in order, with their counts, from the lowest class of counts on with which there are at most `most`."""
    above = np.cumsum(added_up(counts, "classes", 8 * LEVELS)[::-1])[::-1]
    least = int(np.flatnonzero(np.append(above, 0) <= most)[0])

    def choose(batches):
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("word_counts").to_pylist()):
                words, n = from_steps(words, "u8"), from_planes(n, "i8")
                chosen = (np.floor(np.log2(n) * 8) >= least) & (words != START)
                yield pa.RecordBatch.from_arrays([pa.array(words[chosen].view(np.int64)), pa.array(n[chosen])], names=["word", "n"])

    found = common.mapped(counts.select("words", "word_counts"), choose, "word long, n long").toArrow()  # at most `most` rows
    words, n = (found.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    return words.view(np.uint64)[order], n[order]


def stored_keys(keys: np.ndarray, levels: np.ndarray, lowest: int) -> np.ndarray:
    """The keys under which n-grams are stored at all their levels from `lowest` on."""
    return np.concatenate([keys[:0], *(level_keys(keys[levels >= at], at) for at in range(lowest, int(levels.max(initial=0)) + 1))])


class Model:
    """Reads counts from a filter that holds levels from `lowest` on, and scores tokens whose counts were read."""

    def __init__(self, held: SlicedFilter | None, total: int, different: int, lowest: int = 1):
        self.held, self.total, self.different, self.lowest = held, total, different, lowest

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams, by their short keys, found in the filter; 0 for those it does not hold."""
        levels = np.zeros(len(keys), np.int64)
        at, level = np.arange(len(keys)), self.lowest
        while len(at) and level < LEVELS:
            at = at[self.held.holds(level_keys(keys[at], level))]
            levels[at] = level
            level += 1
        return levels

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams as the filter gives them back."""
        return count_of(self.levels(keys))

    def logs(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens from the levels of the word before, the word and the pair."""
        before, word, pair = count_of(before), count_of(word), count_of(pair)
        mix = MIX * before / (before + PRIOR)
        return np.log10(mix * np.minimum(pair, before) / np.maximum(before, 1) + (1 - mix) * (word + 1) / (self.total + self.different + 1))


BLOCKS = "block long, ids array<long>, held_out array<boolean>, sizes binary, texts binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Consecutive rows of `docs` (doc_id, held_out, text), with about BLOCK_TOKENS tokens together, as one row."""
    def gather(batches):
        def packed(nth, rows):
            ids, held_out, texts = zip(*rows)
            return pa.RecordBatch.from_pylist([{"block": nth, "ids": ids, "held_out": held_out, "sizes": planes(np.array([len(t) for t in texts])),
                                                "texts": common.packed(b"".join(texts))}], schema)

        nth, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc, kept_out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), common.strings(batch)):
                data = text.encode()
                held.append((doc, kept_out, data))
                size += len(data) + TOKEN_BYTES
                if size >= BLOCK_TOKENS * TOKEN_BYTES:
                    yield packed(nth, held)
                    nth, held, size = nth + 1, [], 0
        if held:
            yield packed(nth, held)

    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("texts", pa.binary())])
    return common.mapped(docs.select("doc_id", "held_out", "text"), gather, BLOCKS)


def parts_of(sizes: bytes, texts: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of a block in parts of about BLOCK_TOKENS: the one before each, it, and the number of its text. Mostly one part."""
    ends, data = np.cumsum(np.r_[0, from_planes(sizes, "i8")]).tolist(), common.unpacked(texts)
    for some in blocks_of(transitions([data[a:b].decode() for a, b in zip(ends, ends[1:])])):
        yield tuple(np.concatenate([part[i] for part in some]) for i in range(3))


def numbered_grams(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different words and pairs of tokens in order, and of each token the numbers of the word before, the word and the pair."""
    words, word = numbered(np.append(left, right))
    pairs, pair = numbered(pair_keys(left, right))
    return words, pairs, word[:len(left)], word[len(left):], pair


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays as one packed byte string, behind their lengths; of each, all first bytes, all second ones, and so on."""
    return common.packed(np.array([len(x) for x in arrays], np.uint32).tobytes()
                         + b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays))


def parted(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = common.unpacked(data, "u1")
    made, at = [], 4 * len(kinds)
    for size, kind in zip(raw[:at].view("u4").tolist(), map(np.dtype, kinds)):
        made.append(np.ascontiguousarray(raw[at:at + size * kind.itemsize].reshape(kind.itemsize, size).T).view(kind).ravel())
        at += size * kind.itemsize
    return made


def sent(held: DataFrame, segments: int) -> DataFrame:
    """For each part of a block and each segment, its different n-grams there, with how often they stand in documents learned from."""
    def count(batches):
        for batch in batches:
            for block, kept_out, sizes, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "held_out", "sizes", "texts"))):
                learned = ~np.array(kept_out, np.bool_)
                for nth, (left, right, of) in enumerate(parts_of(sizes, texts)):
                    words, pairs, before, word, pair = numbered_grams(left, right)
                    use = learned[of]
                    # the start counts where a document begins
                    at = np.append(word[use], before[use & (left == START)])
                    word_counts, pair_counts = (np.bincount(x, minlength=n).astype(np.uint32) for x, n in ((at, len(words)), (pair[use], len(pairs))))
                    of_words, of_pairs = per_segment(words, segments), per_segment(pairs, segments)
                    some = np.flatnonzero((np.diff(of_words) > 0) | (np.diff(of_pairs) > 0)).tolist()
                    grams = []
                    for s in some:
                        w, p = (slice(x[s], x[s + 1]) for x in (of_words, of_pairs))
                        grams.append(joined(np.diff(words[w], prepend=np.uint64(0)), word_counts[w],
                                            np.diff(halves(pairs[p]), prepend=np.uint32(0)), pair_counts[p]))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array([nth] * len(some), pa.int32()),
                                                      pa.array(some, pa.int32()), pa.array(grams, pa.binary())], names=["block", "part", "segment", "grams"])

    return common.mapped(held.select("block", "held_out", "sizes", "texts"), count, "block long, part int, segment int, grams binary")


def answers(grams: DataFrame, segments: int) -> DataFrame:
    """For each row of `grams`, the levels of its words and pairs in the segment's slice of the filter, and the exact counts of its words.

    A row without a block for each segment has its share of N (tokens) and V (different).
    """
    def answer(key, table):
        segment = key[0].as_py()
        asked = [parted(g, "u8", "u4", "u4", "u4") for g in table.column("grams").to_pylist()]
        words, word, word_counts = merged([np.cumsum(a[0], dtype=np.uint64) for a in asked], [a[1] for a in asked])
        pairs, pair, pair_counts = merged([np.cumsum(a[2], dtype=np.uint32) for a in asked], [a[3] for a in asked])
        keys = np.append(common.short_keys(word_keys(words), segments),
                         common.first_of_segment(np.uint64(segment), segments) | pairs.astype(np.uint64))
        counts = np.append(word_counts, pair_counts)
        seen = counts > 0
        stored = stored_keys(keys[seen], levels_of(counts[seen]), 1)
        size = max(64, -(-len(stored) * BITS_PER_KEY // 8))
        # within a segment the slice is a filter of its own
        bits = np.frombuffer(SlicedFilter.slice_of(stored, size, PROBES), np.uint8)
        levels = Model(SlicedFilter(1, size, PROBES, bits), 0, 0).levels(keys).astype(np.uint8)
        exact = np.where(words == START, 0, word_counts)  # the start is no token
        made = [joined(levels[w], levels[len(words) + p], exact[w]) for w, p in zip(word, pair)]
        n = table.num_rows
        return pa.table({"block": pa.chunked_array([*table.column("block").chunks, pa.nulls(1, pa.int64())]),
                         "part": pa.chunked_array([*table.column("part").chunks, pa.nulls(1, pa.int32())]),
                         "segment": pa.array([segment] * (n + 1), pa.int32()), "answer": pa.array([*made, None], pa.binary()),
                         "tokens": pa.array([None] * n + [int(exact.sum())], pa.int64()),
                         "different": pa.array([None] * n + [int((exact > 0).sum())], pa.int64())})

    return grams.groupBy("segment").applyInArrow(answer, "block long, part int, segment int, answer binary, tokens long, different long")


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, logs double, score double"


def scored(held: DataFrame, answered: DataFrame, total: int, different: int) -> DataFrame:
    """Every document of the blocks `held` with its tokens, those known, the sum of log10(c + 1) and the model's score."""
    def score(blocks, answered):
        model = Model(None, total, different)
        given = answered.select(["part", "segment", "answer"]).sort_by([("part", "ascending"), ("segment", "ascending")])
        starts = np.searchsorted(given.column("part").to_numpy(), np.arange(1 + max(given.column("part").to_pylist())))
        given, made = given.column("answer"), []
        for block in blocks.to_pylist():
            n = len(block["ids"])
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
            for nth, (left, right, of) in enumerate(parts_of(block["sizes"], block["texts"])):
                words, pairs, before, word, pair = numbered_grams(left, right)
                read = [parted(a, "u1", "u1", "i8") for a in given[starts[nth]:starts[nth + 1] if nth + 1 < len(starts) else None].to_pylist()]
                word_levels, pair_levels, exact = (np.concatenate(x) for x in zip(*read))
                if len(word_levels) != len(words) or len(pair_levels) != len(pairs):
                    raise ValueError(f"block {block['block']} has other n-grams than were counted")
                counts = exact[word]
                for total_of, values in zip(sums, (None, counts > 0, np.log10(counts + 1), model.logs(
                        *(x[y].astype(np.int64) for x, y in ((word_levels, before), (word_levels, word), (pair_levels, pair)))))):
                    total_of += np.bincount(of, values, n).astype(total_of.dtype)
            made.append(pa.table([pa.array(block["ids"], pa.int64()), pa.array(block["held_out"], pa.bool_()), *map(pa.array, sums)],
                                 names=["doc_id", "held_out", "n_tokens", "known", "logs", "score"]))
        return pa.concat_tables(made)

    return held.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, SCORED)


def scores(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    Rows whose `held_out` is false are learned from; a null counts as true. A null text is empty: its only token
    is the end. Without any row to learn from, all counts are 0. Repeated rows are each learned from and scored; an empty table
    gives no row. A very long text is several parts of a block; its task holds about eight times its bytes. Other columns do not matter.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held_out), F.lit(True)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(0, math.ceil(math.log2(max(1, 2 * size / TOKEN_BYTES / KEYS_PER_SEGMENT))))
    held = session.written(blocks(rows), "blocks")
    answered = session.written(answers(sent(held, segments), segments), "answers")
    total, different = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    made = scored(held, answered.where(F.col("block").isNotNull()).select("block", "part", "segment", "answer"), total, different)
    return made.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(total + different + 1)).alias("base_score"), "score")
