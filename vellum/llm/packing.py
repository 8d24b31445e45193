"""Best-fit decreasing packing of token sequences, with a segment tree over the remaining capacities.

Best fit decreasing takes the longest piece first and puts it in the open sequence it fills most. Pieces of one length
are alike, and so are sequences with one remaining capacity. So the whole plan depends only on how many pieces there are
of each length: at most `capacity` numbers, whatever the size of the corpus. The driver plans over these; open sequences
are kept as ranges of sequence numbers per remaining capacity, and a segment tree over the capacities finds the
tightest one that fits in logarithmic time. The plan says where the i-th piece of each length goes, and tasks look it up.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vellum import session
from vellum.llm import common
from vellum.llm.encoding import encoder


class OpenSequences:
    """Ranges of alike open sequences by remaining capacity, and a segment tree that knows which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, left: int) -> None:
        node = self.leaves + left
        self.any[node] = bool(self.ranges[left])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def put(self, left: int, first: int, count: int) -> None:
        if left and count:
            self.ranges[left].append((first, count))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        taken = self.ranges[left].pop()
        self._mark(left)
        return taken

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of `length` or more that an open sequence has."""
        node = self.leaves + length
        while not self.any[node]:
            while node & 1:  # a right child: the next leaves to the right hang below an ancestor
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where best fit decreasing puts `counts[length]` pieces of each length, and the number of sequences.

    Rows: length, rank, first, each, offset. Pieces of `length` with ranks from `rank` on go `each` to a sequence, one
    after another from `offset`, into the sequences from `first` on; the next row of that length ends the range.
    """
    rows, sequences, open_ = [], 0, OpenSequences(capacity)
    for length in sorted(counts, reverse=True):
        rank, left_over = 0, counts[length]
        while left_over:
            room = open_.tightest(length) if length <= capacity else None
            if room is None:  # open as many as these pieces need
                first, count, room = sequences, -(-left_over // (capacity // length)), capacity
                sequences += count
            else:
                first, count = open_.take(room)
            each = room // length
            full = min(count, left_over // each)
            rest = min(left_over - full * each, each) if full < count else 0
            rows.append((length, rank, first, each, capacity - room))
            open_.put(room - each * length, first, full)
            if rest:
                open_.put(room - rest * length, first + full, 1)
            open_.put(room, first + full + bool(rest), count - full - bool(rest))
            rank += full * each + rest
            left_over -= full * each + rest
    return np.array(rows, np.int64).reshape(-1, 5), sequences


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, the end id last, cut into pieces of at most `capacity`, as a written table.

    Null texts are empty: one piece with the end id. `part` and `nth` number the pieces of one length within a task.
    """
    def cut(batches):
        encode, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), common.strings(batch)
            for some in common.slices(texts):
                rows = []
                for at, tokens in zip(some, encode(texts[some.start:some.stop])):
                    whole = np.append(tokens, np.array([end_id], tokens.dtype)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        own = whole[start:start + capacity]
                        nth = seen.get(len(own), 0)
                        seen[len(own)] = nth + 1
                        rows.append((ids[at], piece, start, len(own), zlib.crc32(own.tobytes()), part, nth))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = common.mapped(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")
    return session.written(made, "pieces")


def pack(made: DataFrame, capacity: int) -> DataFrame:
    """`pieces` with sequence_id and offset; every sequence is filled from 0 without gaps, up to `capacity`."""
    spark = made.sparkSession
    per_task = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("held"))
    counts = {r["length"]: r["held"] for r in per_task.groupBy("length").agg(F.sum("held").alias("held")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(plan(counts, capacity)[0])  # bounded by the capacity, not by the corpus
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))

    def place(batches):
        rows = places.value
        width = np.int64(1) << np.int64(40)
        order = np.lexsort((rows[:, 1], rows[:, 0])) if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, start, first, each, offset = rows[np.searchsorted(keys, length * width + rank, "right") - 1].T
            nth = rank - start
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(first + nth // each), pa.array(offset + nth % each * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return common.mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
