"""Benchmark decontamination by spaced seeds.

A seed is a window of words read through a mask that ignores some positions, so a replaced word under a gap does not hide a
copy. The masks below meet every copy of LEAST words in which up to a fifth is replaced (a test tries all ways to do so).

1. All seeds of the benchmark are hashed to a table, and into a Bloom filter of at most `most_bytes`.
2. Tasks hash all seeds of every document and keep those in the filter. Only documents with any go on, with the keys
   of their words. The filter thins out; a false yes is found out by the join.
3. Seeds of documents and of the benchmark are joined by hash. A joint seed says where a document and an item might lie on
   each other (a diagonal).
4. On each diagonal, of all stretches with SHARE percent of equal words or more, the one with the most is found in one scan.
   It is a copy if it has LEAST equal words (all of a shorter item).

Words stand between ASCII white space, with A-Z in lower case and without ASCII punctuation at their ends; what is
punctuation only is no word. Items of fewer words than a mask spans are too short to tell and match nothing.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vellum import session
from vellum.llm import common
from vellum.llm.words import word_lists

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 2, 5, 6, 7))
SPAN = 8
LEAST, SHARE = 10, 80
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BITS_PER_KEY, PROBES, MOST_BYTES = 24, 8, 32 << 20
KEYS_PER_SEGMENT = 1 << 20
TURN = np.uint64(0x9E3779B97F4A7C15)


class Keys:
    """Hashes of words as compared, held for up to `keep` different ones; 0 for what is no word."""

    def __init__(self, keep: int = 500_000):
        self.known, self.keep = {}, keep

    def of(self, text: str) -> np.ndarray:
        known, parts = self.known, []
        if len(known) > self.keep:
            known.clear()
        for words in word_lists(text.encode().lower()):
            for word in set(words).difference(known):
                bare = word.strip(PUNCTUATION)
                known[word] = xxhash.xxh3_64_intdigest(bare) or 1 if bare else 0
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        keys = np.concatenate(parts)
        return keys[keys != 0]


def seeds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of a text of words, and the places they start at."""
    hashes, places = [], []
    for number, mask in enumerate(MASKS):
        count = len(keys) - mask[-1]
        if count > 0 and len(keys) >= SPAN:
            rolled = np.full(count, number + 1, np.uint64)
            for at in mask:
                rolled = common.mix(rolled * TURN + keys[at:at + count])
            hashes.append(rolled)
            places.append(np.arange(count))
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def item_seeds(items: DataFrame) -> DataFrame:
    """item, keys (of its words), hashes and places (of its seeds) of every different text of `items` (item, text)."""
    def task(batches):
        keys = Keys()
        for batch in batches:
            rows = []
            for text in common.strings(batch):
                own = keys.of(text)
                hashes, places = seeds(own)
                rows.append((own.tobytes(), hashes.view(np.int64).tolist(), places.tolist()))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["item", "keys", "hashes", "places"])

    made = common.mapped(items, task, "item long, keys binary, hashes array<long>, places array<long>")
    return session.written(made.withColumn("nth_item", F.monotonically_increasing_id()), "items")


def seed_filter(known: DataFrame, most_bytes: int) -> common.SlicedFilter:
    """A filter over all seeds of the items, built one segment of the hashes at a time."""
    hashes = known.select(F.explode("hashes").alias("hash")).distinct()
    segments = max(1, -(-known.agg(F.sum(F.size("hashes"))).first()[0] // KEYS_PER_SEGMENT) if known.head(1) else 1)

    segment_of = ((F.shiftrightunsigned("hash", 32) * segments) / F.lit(1 << 32)).cast("int")

    def pack(key, table):
        keys = table.column("hash").to_numpy().view(np.uint64)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "stored": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})

    rows = hashes.select(segment_of.alias("segment"), "hash").groupBy("segment").applyInArrow(pack, "segment int, stored long, keys binary")
    stored = session.written(rows, "seeds")
    most = stored.agg(F.max("stored")).first()[0] or 0
    return common.sliced_filter(stored, most, segments, BITS_PER_KEY, PROBES, most_bytes)


def suspects(docs: DataFrame, held: common.SlicedFilter) -> DataFrame:
    """Documents with a seed in the filter: doc_id, text_hash, keys of their words, and those seeds."""
    sent = docs.sparkSession.sparkContext.broadcast((held.segments, held.slice_bytes, held.probes, held.bits.tobytes()))  # <= most_bytes

    def task(batches):
        segments, slice_bytes, probes, bits = sent.value
        known, keys = common.SlicedFilter(segments, slice_bytes, probes, np.frombuffer(bits, np.uint8)), Keys()
        for batch in batches:
            ids, text_hashes = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            texts, rows = common.strings(batch), []
            for some in common.slices(texts):
                own = [keys.of(t) for t in texts[some.start:some.stop]]
                found = [seeds(k) for k in own]
                sizes = np.fromiter((len(h) for h, _ in found), np.int64, len(found))
                ends = np.cumsum(sizes)
                hits = np.flatnonzero(known.holds(np.concatenate([h for h, _ in found])))
                which = np.searchsorted(ends, hits, "right")
                for at in np.unique(which).tolist():
                    inside = hits[which == at] - (ends[at] - sizes[at])
                    rows.append((ids[some.start + at], text_hashes[some.start + at], own[at].tobytes(),
                                 found[at][0][inside].view(np.int64).tolist(), found[at][1][inside].tolist()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "text_hash", "keys", "hashes", "places"])

    made = common.mapped(docs, task, "doc_id long, text_hash long, keys binary, hashes array<long>, places array<long>")
    return session.written(made.withColumn("nth_doc", F.monotonically_increasing_id()), "suspects")


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch with the most equal words among those with SHARE percent or more."""
    equals = np.concatenate(([0], np.cumsum(equal)))
    surplus = 100 * equals - SHARE * np.arange(len(equals))  # a stretch has the share if this does not fall over it
    later = np.maximum.accumulate(surplus[::-1])[::-1]  # falling, so that the last end is found by bisection
    ends = np.searchsorted(-later, -surplus, "right") - 1
    begin = int(np.argmax(equals[ends] - equals))
    return begin, int(ends[begin]), int(equals[ends[begin]] - equals[begin])


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Where an item lies on a document that many words further on: first word, words, equal words; None if it is no copy."""
    first, last = max(0, diagonal), min(len(doc), diagonal + len(item))
    begin, end, equal = best_stretch(doc[first:last] == item[first - diagonal:last - diagonal])
    if equal < min(LEAST, len(item)):
        return None
    return first + begin, end - begin, equal


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The best overlap of each document with each item it holds a copy of: doc_id, text_hash (xxhash64 of the text, an
    empty one for null), item_id, start (its first word), n_words and n_equal.

    Null and empty texts hold nothing. Ids may be null; rows that are repeated, and items, give their overlap once per different id.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = item_seeds(items)
    found = suspects(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), seed_filter(known, most_bytes))

    def laid_out(frame, nth, place):
        pairs = F.explode(F.arrays_zip("hashes", "places")).alias("s")
        return frame.select(nth, pairs).select(nth, F.col("s.hashes").alias("hash"), F.col("s.places").alias(place))

    diagonals = (laid_out(found, "nth_doc", "at").join(laid_out(known, "nth_item", "item_at"), "hash")
                 .select("nth_doc", "nth_item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    pairs = (diagonals.join(known.select("nth_item", "item", F.col("keys").alias("item_keys")), "nth_item")
             .join(found.select("nth_doc", "doc_id", "text_hash", "keys"), "nth_doc"))

    def verify(batches):
        for batch in batches:
            made = []
            for keys, item, diagonal in zip(*(batch.column(c).to_pylist() for c in ("keys", "item_keys", "diagonal"))):
                made.append(overlap(np.frombuffer(keys, np.uint64), np.frombuffer(item, np.uint64), diagonal))
            good = pa.array([m is not None for m in made], pa.bool_())
            columns = list(zip(*[m or (0, 0, 0) for m in made])) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "item")), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc_id", "text_hash", "item_id", "start", "n_words", "n_equal"]).filter(good)

    verified = common.mapped(pairs.select("doc_id", "text_hash", "item", "keys", "item_keys", "diagonal"), verify,
                             "doc_id long, text_hash long, item_id long, start long, n_words long, n_equal long")
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("n"), (-F.col("start")).alias("s"))).alias("best")
    return (verified.groupBy("doc_id", "text_hash", "item_id").agg(best)
            .select("doc_id", "text_hash", "item_id", (-F.col("best.s")).alias("start"), (-F.col("best.n")).alias("n_words"), F.col("best.n_equal").alias("n_equal")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whatever their names, that hold no copy of an item.

    Null and empty texts hold none. Rows with a null id and repeated rows are judged by their text like any other; an empty table
    of documents or items changes nothing.
    """
    marks = contaminations(docs, benchmark, doc_id, text).select("doc_id", "text_hash").distinct()
    # Columns travel as c0, c1, ..., so that none meets a name used here.
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (doc_id, text))
    own = F.xxhash64(F.coalesce(own_text, F.lit("")))
    left = given.join(marks, own_id.cast("long").eqNullSafe(F.col("doc_id")) & (own == F.col("text_hash")), "left_anti")
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
