"""Helpers shared by the operators of this folder: Arrow batches, slices of bounded size, bit filters."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum import session

# Characters of text worked on at a time, so that lists and arrays made from them stay small.
SLICE_CHARS = 2_000_000
# Bytes of rows that go to a Python worker at a time; a longer row goes alone.
BATCH_BYTES = 8 << 20


def mapped(frame: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`frame.mapInArrow` with this package on the workers and batches cut by bytes, so that a worker holds little at a time."""
    session.ship(frame.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(task, schema)


def slices(values: list[str], most: int = SLICE_CHARS) -> Iterator[range]:
    """Consecutive index ranges of `values` with about `most` characters each, one value at least."""
    start = size = 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > most:
            yield range(start, i)
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield range(start, len(values))


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The values of a string column, null as the empty string."""
    return [v or "" for v in batch.column(name).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Which of `segments` equal ranges of 64-bit keys each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def first_of_segment(segment: np.ndarray, segments: int) -> np.ndarray:
    """The least key of a segment."""
    return ((segment.astype(np.uint64) << np.uint64(32)) + np.uint64(segments - 1)) // np.uint64(segments) << np.uint64(32)


def short_keys(keys: np.ndarray, segments: int) -> np.ndarray:
    """`keys` with only their segment and lower half left, so that the half is enough within a segment."""
    return first_of_segment(segment_of(keys, segments), segments) | (keys & np.uint64(0xFFFFFFFF))


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed, for tables between two steps."""
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 3)


def unpacked(data: bytes, kind: str | None = None) -> np.ndarray | bytes:
    raw = zstandard.decompress(data)
    return np.frombuffer(raw, kind) if kind else raw


def sampled(rows: DataFrame, column: str, most: int) -> DataFrame:
    """A row for each of the `most` different values of `column` with the smallest hashes; nulls are left out.

    Only counts by hash range (1,024 numbers) and one hash reach the driver, and only rows of chosen values are shuffled, so a
    sample costs the same whatever the size of values, tasks and groups of copies.
    """
    given = rows.where(F.col(column).isNotNull()).withColumn("_sample", F.xxhash64(column))
    of_range = F.shiftright("_sample", 54)
    counts = sorted(tuple(r) for r in given.groupBy(of_range.alias("at")).count().collect())  # at most 1,024 rows
    total, last = 0, None
    for last, count in counts:
        total += count
        if total >= 4 * most:  # copies of one value count once later
            break
    if last is None:
        return rows.where(F.lit(False))
    near = given.select("_sample").where(of_range <= last).distinct()
    limit = near.orderBy("_sample").limit(most).agg(F.max("_sample")).first()[0]
    return given.where(F.col("_sample") <= limit).dropDuplicates(["_sample"]).drop("_sample")


class SlicedFilter:
    """A Bloom filter made of one slice of bits per segment of the key space, so that every slice is built by one group."""

    def __init__(self, segments: int, slice_bytes: int, probes: int, bits: np.ndarray):
        self.segments, self.slice_bytes, self.probes, self.bits = segments, slice_bytes, probes, bits

    @staticmethod
    def positions(keys: np.ndarray, slice_bits: int, probe: int) -> np.ndarray:
        """Bit positions of one probe within the slices of the keys."""
        spread = mix(keys + np.uint64((probe * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        return ((spread >> np.uint64(32)) * np.uint64(slice_bits)) >> np.uint64(32)

    @classmethod
    def slice_of(cls, keys: np.ndarray, slice_bytes: int, probes: int) -> bytes:
        """The bits of one slice that hold `keys`, all of its segment."""
        flags = np.zeros(slice_bytes * 8, np.bool_)
        for probe in range(probes):
            flags[cls.positions(keys, slice_bytes * 8, probe).astype(np.int64)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is in the filter; a few that are not may seem to be."""
        found = np.ones(len(keys), np.bool_)
        at = np.arange(len(keys))
        for probe in range(self.probes):
            left = keys[at]
            position = self.positions(left, self.slice_bytes * 8, probe)
            byte = segment_of(left, self.segments) * np.uint64(self.slice_bytes) + (position >> np.uint64(3))
            hit = (self.bits[byte.astype(np.int64)] >> (position & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found[at[~hit]] = False
            at = at[hit]
            if not len(at):
                break
        return found


def joined_slices(rows: DataFrame, segments: int, slice_bytes: int) -> np.ndarray:
    """The slices (segment, bits) side by side; at most segments * slice_bytes bytes reach the driver."""
    bits = np.zeros(segments * slice_bytes, np.uint8)
    for row in rows.toLocalIterator():
        bits[row["segment"] * slice_bytes:(row["segment"] + 1) * slice_bytes] = np.frombuffer(row["bits"], np.uint8)
    return bits


def sliced_filter(stored: DataFrame, most: int, segments: int, bits_per_key: int, probes: int, most_bytes: int) -> SlicedFilter:
    """The filter over the packed keys of `stored`, a row (segment, keys) for each segment, `most` keys in the fullest.

    Sized for that one, and never above `most_bytes` in all: with more keys it answers yes more often.
    """
    slice_bytes = max(64, min(-(-most * bits_per_key // 8), most_bytes // segments))

    def slices(batches):
        for batch in batches:
            bits = [SlicedFilter.slice_of(np.frombuffer(k, np.uint64), slice_bytes, probes) for k in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary())], names=["segment", "bits"])

    rows = mapped(stored.select("segment", "keys"), slices, "segment int, bits binary")
    return SlicedFilter(segments, slice_bytes, probes, joined_slices(rows, segments, slice_bytes))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that follow each other with equal values of the long columns `keys`, over batch borders."""
    held: list[pa.RecordBatch] = []

    def values(batch, at):
        return tuple(batch.column(k)[at].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, np.bool_)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(new).tolist()
        if held and values(held[-1], held[-1].num_rows - 1) != values(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *cuts]
        for start, end in zip(starts, cuts):
            part = batch.slice(start, end - start)
            yield pa.Table.from_batches([*held, part])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)
