"""Removal of long byte strings that also start in an earlier document, by suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller id is removed. A suffix
array over a whole corpus would not fit a task, so equal strings are first brought together:

1. The smallest hash of the 16-byte grams of a window of LENGTH bytes is the window's key; equal windows have equal keys.
   Following windows mostly share a key, so a text falls into runs of windows, one for about 18 bytes. Keys found in two
   documents or more go to a Bloom filter of bounded size. It only thins out the work: a false yes costs time, no result.
2. Runs whose key is in the filter are cut out as strings, with their context of LENGTH - 1 bytes, and equal strings
   of a task become one with its smallest and largest document. They go to buckets by key; the number of buckets grows
   with the corpus. A passage in a third of all documents is one string per task.
3. Each bucket sorts the suffixes of its different strings in two stages (suffix_sort) and compares adjacent ones. Windows
   with a common prefix of LENGTH bytes are equal, and the smallest document of each group is known.
   A 16-byte phrase in ever new surroundings is one key with any number of different strings. The windows of a bucket with more
   than BUCKET_MOST bytes of strings are dealt anew, each on its own, by a hash of all its LENGTH bytes: equal ones still meet,
   and none is in a group more than once for each CHUNK of strings, so the groups have BUCKET_MOST bytes of windows, about.
4. The answers go back to the tasks' strings, become removed spans of documents, and are joined to the texts.

Rows with a null id neither lose bytes nor take any. Rows with one id are one document to each other. Null texts are empty.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vellum import session
from vellum.llm import common, suffix_sort

LENGTH = 50
GRAM = 16
PRIME = 0x9E3779B97F4A7C15
SEPARATOR = 0xFF  # in no UTF-8 text
BLOCK = 2 << 20  # bytes of texts worked on at a time
FLUSH_KEYS, FLUSH_BYTES = 2_000_000, 12 << 20
RUN = 18  # bytes of text for one key, about
KEYS_PER_SEGMENT = 1 << 19
BUCKET_TEXT = 4 << 20  # bytes of corpus for each bucket
BUCKET_MOST, CHUNK = 16 << 20, 1 << 20  # bytes of strings in a bucket, and of strings whose windows are made at a time
MOST_BYTES, BITS_PER_KEY, PROBES = 64 << 20, 12, 5
LOW_BIT = np.uint64(1)


def window_minima(text: np.ndarray) -> np.ndarray:
    """The smallest gram hash in every window of LENGTH bytes."""
    grams = text.astype(np.uint64) + LOW_BIT
    for step in (1, 2, 4, 8):  # hashes of 2, 4, 8, 16 bytes
        grams = grams[:-step] * np.uint64(pow(PRIME, step, 1 << 64)) + grams[step:]
    least, width, span = common.mix(grams), 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:len(least) - (span - width)], least[span - width:])


def runs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of following windows with one key: the piece, the first window's place in it, the number of windows, the key."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    if len(text) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    keys = window_minima(text)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths) - lengths
    windows = lengths - LENGTH + 1
    steps = np.zeros(len(keys) + 1, np.int8)
    steps[begins[windows > 0]] = 1
    steps[(begins + windows)[windows > 0]] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8) > 0
    change = keys[1:] != keys[:-1]
    starts = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
    ends = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True]))) + 1
    which = np.searchsorted(begins, starts, "right") - 1
    return which, starts - begins[which], ends - starts, common.mix(keys[starts])  # least hashes are small: spread them


def blocks(batches):
    """Texts as pieces of bounded length: lists of (doc_id, text hash, place in the text, bytes). Windows are in one piece each."""
    held, size = [], 0
    for batch in batches:
        for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
            data = text.encode()
            for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
                piece = data[at:at + BLOCK + LENGTH - 1]
                held.append((doc, text_hash, at, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def key_blocks(docs: DataFrame, segments: int) -> DataFrame:
    """The lower halves of the different keys of slices of text, per segment; the lowest bit says whether two documents have one."""
    def collect(batches):
        keys, owners, size = [], [], 0

        def flush():
            all_keys, docs_of = common.short_keys(np.concatenate(keys) & ~LOW_BIT, segments), np.concatenate(owners)
            keys.clear(), owners.clear()
            order = np.argsort(all_keys, kind="stable")
            all_keys, docs_of = all_keys[order], docs_of[order]
            first = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1])))
            two = np.minimum.reduceat(docs_of, first) != np.maximum.reduceat(docs_of, first)
            different = all_keys[first] | two.astype(np.uint64)
            at = np.searchsorted(common.segment_of(different, segments).astype(np.int64), np.arange(segments + 1))
            some = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([different[at[s]:at[s + 1]].astype(np.uint32).tobytes() for s in some], pa.binary())],
                                              names=["segment", "keys"])

        for pieces in blocks(batches):
            which, _, _, found = runs([p[3] for p in pieces])
            keys.append(found)
            owners.append(np.array([p[0] for p in pieces], np.int64)[which])
            size += len(found)
            if size > FLUSH_KEYS:
                yield flush()
                size = 0
        if size:
            yield flush()

    return common.mapped(docs, collect, "segment int, keys binary")


def shared_keys(found: DataFrame, segments: int) -> common.SlicedFilter:
    """A filter over the keys that two documents have."""
    def shared(key, table):
        halves = np.sort(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32))
        first = np.flatnonzero(np.concatenate(([True], (halves[1:] ^ halves[:-1]) > 1)))
        several = (np.diff(first, append=len(halves)) > 1) | (np.bitwise_or.reduceat(halves, first) & 1).astype(np.bool_)
        keys = common.first_of_segment(np.array([key[0].as_py()]), segments) | (halves[first][several] & ~np.uint32(1)).astype(np.uint64)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "stored": pa.array([len(keys)], pa.int64()),
                         "keys": pa.array([keys.tobytes()], pa.binary())})

    stored = session.written(found.groupBy("segment").applyInArrow(shared, "segment int, stored long, keys binary"), "shared-keys")
    most = stored.agg(F.max("stored")).first()[0] or 0
    return common.sliced_filter(stored, most, segments, BITS_PER_KEY, PROBES, MOST_BYTES)


CANDIDATES = ("flush string, bucket int, size long, windows long, strings binary, lengths binary, least binary, greatest binary, "
              "docs binary, hashes binary, starts binary, numbers binary")


def candidates(docs: DataFrame, filter_: common.SlicedFilter, buckets: int) -> DataFrame:
    """Runs with shared keys. Per flush of a task, a row for each bucket with its different strings, and one (bucket -1)
    that says where they are: document, text hash, place and the string's number, counted bucket by bucket."""
    held = docs.sparkSession.sparkContext.broadcast((filter_.segments, filter_.slice_bytes, filter_.probes, filter_.bits.tobytes()))  # <= MOST_BYTES

    def collect(batches):
        segments, slice_bytes, probes, bits = held.value
        shared = common.SlicedFilter(segments, slice_bytes, probes, np.frombuffer(bits, np.uint8))
        part, flushes = TaskContext.get().partitionId(), 0
        numbers, owners, places, kept_keys, size = {}, [], [], [], 0

        def flush():
            strings = list(numbers)
            bucket = common.segment_of(common.mix(np.array(kept_keys, np.uint64)), buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            renumbered = np.empty(len(order), np.int64)
            renumbered[order] = np.arange(len(order))
            docs_of, hashes, starts, own = (np.array(x, np.int64) for x in zip(*places))
            own = renumbered[own]
            least, greatest = np.full(len(order), np.iinfo(np.int64).max), np.full(len(order), np.iinfo(np.int64).min)
            np.minimum.at(least, own, docs_of)
            np.maximum.at(greatest, own, docs_of)
            lengths = np.fromiter((len(strings[i]) for i in order), np.uint32, len(order))
            values, at = np.unique(bucket[order], return_index=True)
            ends = [*at.tolist(), len(order)]
            at = at.tolist()
            name = f"{part}-{flushes}"
            sizes = [int(lengths[s:e].sum()) for s, e in zip(at, ends[1:])]
            rows = [(name, int(b), n, n - (e - s) * (LENGTH - 1), common.packed(b"".join(strings[i] for i in order[s:e])), *(common.packed(x[s:e]) for x in (lengths, least, greatest)),
                     None, None, None, None) for b, n, s, e in zip(values, sizes, at, ends[1:])]
            rows.append((name, -1, *[None] * 6, *map(common.packed, (docs_of, hashes, starts, own))))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 8]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in CANDIDATES.split(", ")])

        for pieces in blocks(batches):
            which, start, count, key = runs([p[3] for p in pieces])
            some = np.flatnonzero(shared.holds(common.short_keys(key & ~LOW_BIT, segments)))
            for w, s, n, k in zip(which[some].tolist(), start[some].tolist(), count[some].tolist(), key[some].tolist()):
                doc, text_hash, at, data = pieces[w]
                string = data[s:s + n + LENGTH - 1]
                number = numbers.get(string)
                if number is None:
                    number = numbers[string] = len(numbers)
                    kept_keys.append(k)
                    size += len(string)
                places.append((doc, text_hash, at + s, number))
            if size + 32 * len(places) > FLUSH_BYTES:
                yield flush()
                flushes, size = flushes + 1, 0
                numbers.clear(), places.clear(), kept_keys.clear()
        if places:
            yield flush()

    return session.written(common.mapped(docs, collect, CANDIDATES), "repeat-candidates")


def least_documents(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For every window of LENGTH bytes of each string, the smallest of `least` over all strings that hold the window."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    words = suffix_sort.words_at(text, LENGTH + suffix_sort.WORD)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    left = np.repeat(begins + lengths, lengths + 1) - np.arange(len(text))
    order = suffix_sort.suffix_array(text, LENGTH, words)
    order = order[left[order] >= LENGTH]  # suffixes that start a window
    first = np.flatnonzero(np.concatenate(([True], ~suffix_sort.adjacent_equal(order, words, LENGTH))))
    smallest = np.minimum.reduceat(least[owner[order]], first)
    result = np.zeros(len(text), np.int64)
    result[order] = np.repeat(smallest, np.diff(first, append=len(order)))
    return [result[b:b + n - LENGTH + 1] for b, n in zip(begins.tolist(), lengths.tolist())]


def runs_of(windows: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (from, to, smallest document) of the windows of a string with one smallest document."""
    starts = np.concatenate(([0], np.flatnonzero(windows[1:] != windows[:-1]) + 1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(windows)], windows[starts].tolist()))


ANSWERS = "flush string, bucket int, counts binary, parts binary"


def answer(flush: str, bucket: int, strings: list[list[tuple[int, int, int]]], greatest: bytes) -> tuple:
    """A row of ANSWERS: of the runs of each string, those with a document before the string's last."""
    parts = [[c for c in changes if c[2] < most] for changes, most in zip(strings, common.unpacked(greatest, "i8").tolist())]
    return (flush, bucket, common.packed(np.array([len(p) for p in parts], np.int64)),
            common.packed(np.array([c for p in parts for c in p], np.int64).reshape(-1, 3)))


def cut_up(joined: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def windows_of(strings: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different windows of strings in the order of the part each is dealt to, these parts, and for all
    windows, string by string, the string and the number among the different ones."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    places = np.arange(len(owner)) + owner * (LENGTH - 1)  # a string has LENGTH - 1 places that start no window
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[places].view(f"S{LENGTH}").ravel()
    different, first, number = np.unique(windows, return_index=True, return_inverse=True)
    words, hashes = suffix_sort.words_at(text, LENGTH), np.zeros(len(first), np.uint64)
    for at in sorted({*range(0, LENGTH - suffix_sort.WORD + 1, suffix_sort.WORD), LENGTH - suffix_sort.WORD}):
        hashes = common.mix(hashes * np.uint64(PRIME) + words[places[first] + at])
    part = common.segment_of(hashes, parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return different[order], part[order], owner, place[number]


def overfull(found: DataFrame) -> dict[int, int]:
    """Buckets with more than BUCKET_MOST bytes of strings, and in how many parts their windows go."""
    sizes = found.where("bucket >= 0").groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("windows").alias("windows"))
    # each holds more than BUCKET_MOST bytes, so they are few
    return {r["bucket"]: math.ceil(r["windows"] * LENGTH / BUCKET_MOST) for r in sizes.where(F.col("size") > BUCKET_MOST).collect()}


def dealt_windows(rows: DataFrame) -> DataFrame:
    """The different windows of every CHUNK of the strings of `rows` (with `n_parts`), by the part each is dealt to."""
    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                strings = cut_up(common.unpacked(row["strings"]), common.unpacked(row["lengths"], "u4"))
                least = common.unpacked(row["least"], "i8")
                for chunk, some in enumerate(common.slices(strings, CHUNK)):
                    windows, part, owner, number = windows_of(strings[some.start:some.stop], row["n_parts"])
                    smallest = np.full(len(windows), np.iinfo(np.int64).max)
                    np.minimum.at(smallest, number, least[some.start:some.stop][owner])
                    values, at = np.unique(part, return_index=True)
                    ends = [*at[1:].tolist(), len(part)]
                    columns = [[row["flush"]] * len(at), [row["bucket"]] * len(at), [chunk] * len(at), values,
                               [common.packed(windows[s:e]) for s, e in zip(at, ends)], [common.packed(smallest[s:e]) for s, e in zip(at, ends)]]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["flush", "bucket", "chunk", "part", "strings", "least"])

    return common.mapped(rows.select("flush", "bucket", "n_parts", "strings", "lengths", "least"), deal,
                         "flush string, bucket int, chunk int, part int, strings binary, least binary")


def answers_by_window(rows: DataFrame) -> DataFrame:
    """`answers` for the rows of overfull buckets."""
    def meet(key, table):
        windows = [np.frombuffer(common.unpacked(w), f"S{LENGTH}") for w in table.column("strings").to_pylist()]
        least = np.concatenate([common.unpacked(n, "i8") for n in table.column("least").to_pylist()])
        different, number = np.unique(np.concatenate(windows), return_inverse=True)
        smallest = np.full(len(different), np.iinfo(np.int64).max)
        np.minimum.at(smallest, number, least)
        ends = np.cumsum([len(w) for w in windows])
        return table.select(["flush", "bucket", "chunk", "part"]).append_column(
            "smallest", pa.array([common.packed(n) for n in np.split(smallest[number], ends[:-1])], pa.binary()))

    met = dealt_windows(rows).groupBy("bucket", "part").applyInArrow(meet, "flush string, bucket int, chunk int, part int, smallest binary")
    back = met.groupBy("flush", "bucket").agg(F.array_sort(F.collect_list(F.struct("chunk", "part", "smallest"))).alias("met"))

    def gather(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                strings = cut_up(common.unpacked(row["strings"]), common.unpacked(row["lengths"], "u4"))
                held, changes = {}, []
                for m in row["met"]:
                    held.setdefault(m["chunk"], []).append(m["smallest"])
                for chunk, some in enumerate(common.slices(strings, CHUNK)):
                    smallest = np.concatenate([common.unpacked(n, "i8") for n in held[chunk]])
                    _, _, owner, number = windows_of(strings[some.start:some.stop], row["n_parts"])
                    changes += map(runs_of, np.split(smallest[number], np.flatnonzero(np.diff(owner)) + 1))
                made.append(answer(row["flush"], row["bucket"], changes, row["greatest"]))
            columns = list(zip(*made)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["flush", "bucket", "counts", "parts"])

    return common.mapped(rows.join(back, ["flush", "bucket"]).select("flush", "bucket", "n_parts", "strings", "lengths", "greatest", "met"), gather, ANSWERS)


def answers(found: DataFrame) -> DataFrame:
    """For the strings of each flush and bucket, runs of windows (from, to, smallest document) that an earlier document has."""
    rows = found.where("bucket >= 0").select("flush", "bucket", "strings", "lengths", "least", "greatest")
    parts = overfull(found)
    if not parts:
        return answers_by_bucket(rows)
    parts = F.broadcast(found.sparkSession.createDataFrame(list(parts.items()), "bucket int, n_parts int"))
    return answers_by_bucket(rows.join(parts, "bucket", "left_anti")).unionByName(answers_by_window(rows.join(parts, "bucket")))


def answers_by_bucket(rows: DataFrame) -> DataFrame:
    """`answers` by suffix arrays, one for each bucket."""
    def sort(key, table):
        numbers, least, own = {}, [], []
        for joined, lengths, docs_of in zip(*(table.column(c).to_pylist() for c in ("strings", "lengths", "least"))):
            mine = []
            for string, doc in zip(cut_up(common.unpacked(joined), common.unpacked(lengths, "u4")), common.unpacked(docs_of, "i8").tolist()):
                number = numbers.setdefault(string, len(numbers))
                if number == len(least):
                    least.append(doc)
                else:
                    least[number] = min(least[number], doc)
                mine.append(number)
            own.append(mine)
        changes = [runs_of(windows) for windows in least_documents(list(numbers), np.array(least, np.int64))]
        rows = [answer(flush, key[0].as_py(), [changes[n] for n in mine], greatest)
                for flush, mine, greatest in zip(table.column("flush").to_pylist(), own, table.column("greatest").to_pylist())]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["flush", "bucket", "counts", "parts"])

    return rows.groupBy("bucket").applyInArrow(sort, ANSWERS)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (begin, end) in order, with those that meet or overlap as one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.column_stack((spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]))


def removed_spans(found: DataFrame) -> DataFrame:
    """Removed spans of documents: doc_id, text_hash, spans (pairs of 64-bit integers)."""
    per_flush = answers(found).groupBy("flush").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts", "parts"))).alias("answers"))
    places = found.where("bucket = -1").select("flush", "docs", "hashes", "starts", "numbers")

    def locate(batches):
        for batch in batches:
            rows = []
            for answered, *arrays in zip(*(batch.column(c).to_pylist() for c in ("answers", "docs", "hashes", "starts", "numbers"))):
                docs_of, hashes, starts, numbers = (common.unpacked(a, "i8") for a in arrays)
                counts = np.concatenate([common.unpacked(a["counts"], "i8") for a in answered])
                parts = np.concatenate([common.unpacked(a["parts"], "i8") for a in answered]).reshape(-1, 3)
                begins, own = np.cumsum(counts) - counts, counts[numbers]
                at = np.repeat(begins[numbers] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                place = np.repeat(np.arange(len(numbers)), own)
                earlier = parts[at, 2] < docs_of[place]
                at, place = at[earlier], place[earlier]
                spans = np.column_stack((starts[place] + parts[at, 0], starts[place] + parts[at, 1] + LENGTH - 1))
                order = np.lexsort((hashes[place], docs_of[place]))
                place, spans = place[order], spans[order]
                new = np.ones(len(place), np.bool_)
                new[1:] = (docs_of[place[1:]] != docs_of[place[:-1]]) | (hashes[place[1:]] != hashes[place[:-1]])
                first = np.flatnonzero(new)
                rows += [(int(docs_of[place[s]]), int(hashes[place[s]]), merged(spans[s:e]).tobytes()) for s, e in zip(first, [*first[1:], len(place)])]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "text_hash", "spans"])

    located = common.mapped(places.join(per_flush, "flush"), locate, "doc_id long, text_hash long, spans binary")
    return located.groupBy("doc_id", "text_hash").agg(F.collect_list("spans").alias("spans"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes left, of every row of `docs`."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    known = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, math.ceil(size / RUN / KEYS_PER_SEGMENT))
    shared = shared_keys(key_blocks(known, segments), segments)
    spans = removed_spans(candidates(known, shared, max(1, math.ceil(size / BUCKET_TEXT))))

    def cut(batches):
        for batch in batches:
            made = []
            for value, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = value.encode()
                gone = merged(np.frombuffer(b"".join(parts or []), np.int64).reshape(-1, 2))
                ends = [0, *gone[:, 1].tolist()]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*gone[:, 0].tolist(), len(data)]))
                made.append((len(data), len(data) - len(kept), len(gone), kept))
            columns = list(zip(*made)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()]))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return common.mapped(rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans"), cut,
                         "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
