"""Hard negatives by exact inner products of quantised vectors, scored with the method of the Four Russians.

Every component becomes an integer. A candidate's integers are stored as bit planes, eight dimensions to a byte. For each group of
eight dimensions an anchor has a table of the sums of all 256 subsets of its components there, so a byte of a plane is looked
up instead of multiplied. The looked-up sums of a plane are added over the groups, and the planes, from the sign's down,
by doubling and adding: the full, exact score. The tables of a block of anchors stand side by side, so that one look-up
serves them all.

Candidates are written once in chunks of packed planes, anchors in blocks. Chunks and blocks meet in a grid of cells, whose
number follows the number of pairs, and each keeps the best few of an anchor only; these are ranked by Spark, task by task
before they are shuffled. No step is keyed by a label, so a label with most of the rows is spread as any other.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vellum import session
from vellum.llm import common

CHUNK, BLOCK = 4096, 128  # candidates of a chunk, anchors of a block
TILE = 512  # candidates scored at a time, so that sums and tables stay in a core's cache
CELL_PAIRS = 1 << 32  # pairs that one cell of the grid is to hold at most
GROUP = 8


def quantised(rows: DataFrame, vec_id: str, label: str, vector: str, scale: float) -> DataFrame:
    """vec_id, label, q (floor of scale times each component) of the rows that take part, each different row once.

    Rows with a null id, label, vector or component, a component that is not finite, or one so large that a score could leave 64
    bits, take no part.
    """
    x = F.col("x")
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("x"))
    most = F.least(F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(x), F.lit(1)))), F.lit((1 << 31) - 1))
    fits = lambda v: F.coalesce(F.abs(F.floor(v * scale).cast("double")) <= most, F.lit(False)) & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall(x, fits))
    return sound.select("vec_id", "label", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q")).dropDuplicates()


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of `dims` integers; a shorter one ends in zeros."""
    lists = batch.column("q")
    sizes = np.diff(lists.offsets.to_numpy())
    made = np.zeros((batch.num_rows, dims), np.int64)
    made[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return made


def planes(q: np.ndarray) -> np.ndarray:
    """Bit planes of the rows of `q` in two's complement, the sign's first: (planes, groups, rows) bytes."""
    bits = 1 + max(int(q.max(initial=0)).bit_length(), int(~q.min(initial=0)).bit_length())
    made = [np.packbits((q >> (bits - 1 - b)) & 1 == 1, axis=1, bitorder="little").T for b in range(bits)]
    return np.ascontiguousarray(np.stack(made))


def tables(anchors: np.ndarray) -> np.ndarray:
    """The subset sums of each group of eight dimensions of each row of `anchors`: (groups, 256, rows)."""
    rows, dims = anchors.shape
    padded = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = anchors
    by_group = padded.reshape(rows, -1, GROUP).transpose(1, 2, 0)
    made = np.zeros((by_group.shape[0], 1, rows), np.int64)
    for bit in range(GROUP):
        made = np.concatenate([made, made + by_group[:, bit:bit + 1, :]], axis=1)
    return made


def scores(lookup: np.ndarray, packed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of candidates (rows) with anchors (columns), a tile of candidates at a time, with the number of the first."""
    bits, groups, rows = packed.shape
    reach = int(max(lookup.max(initial=0), -lookup.min(initial=0))) * groups << bits
    lookup = lookup.astype(np.int32 if reach < 1 << 31 else np.int64)
    for start in range(0, rows, TILE):
        tile = packed[:, :, start:start + TILE]
        made = np.zeros((tile.shape[2], lookup.shape[2]), lookup.dtype)
        part = np.empty_like(made)
        for bit in range(bits):
            if bit == 1:
                np.negative(made, out=made)  # the plane of the sign counts against the others
            made <<= 1
            for group in range(groups):
                np.take(lookup[group], tile[bit, group], axis=0, out=part, mode="clip")
                made += part
        yield start, -made if bits == 1 else made


def packer(kind: str, dims: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows vec_id, label, q to rows of `most` vectors: chunks of bit planes, or blocks of anchors' numbers."""
    def pack(batches):
        held, size, made = [], 0, 0
        part = TaskContext.get().partitionId()

        def row():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, labels, q = whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), matrix(whole, dims)
            order = np.lexsort((ids, labels))
            ids, labels, q = ids[order], labels[order], q[order]
            body = planes(q) if kind == "chunk" else q
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()]), pa.array([labels.tobytes()]),
                 pa.array([body.shape[0]], pa.int32()), pa.array([body.tobytes()])], names=["at", "n", "ids", "labels", "rows", "body"])

        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, most - size)
                held.append(own)
                size += own.num_rows
                batch = batch.slice(own.num_rows)
                if size == most:
                    yield row()
                    held, size, made = [], 0, made + 1
        if size:
            yield row()
    return pack


def best(values: np.ndarray, ids: np.ndarray, at: np.ndarray, keep: int) -> np.ndarray:
    """The first `keep` of the places `at` by value downwards, then id; equal pairs of the two count once."""
    def ordered(some):
        some = some[np.lexsort((ids[some], -values[some].astype(np.int64)))]
        new = np.ones(len(some), np.bool_)
        new[1:] = (values[some][1:] != values[some][:-1]) | (ids[some][1:] != ids[some][:-1])
        return some[new][:keep]

    if len(at) > keep:
        own = values[at]
        first = ordered(at[own >= np.partition(own, len(own) - keep)[len(own) - keep]])
        if len(first) == keep:
            return first
    return ordered(at)


def _met(blocks: DataFrame, chunks: DataFrame, find: Callable, schema: str) -> DataFrame:
    """`find` over every pair of a block and a chunk, spread over a grid of cells."""
    spark = blocks.sparkSession
    (n_blocks, anchors), (n_chunks, rows) = (f.agg(F.count("at"), F.coalesce(F.sum("n"), F.lit(0))).first() for f in (blocks, chunks))
    cells = max(-(-anchors * rows // CELL_PAIRS), 4 * max(spark.sparkContext.defaultParallelism, common.shuffle_partitions(spark)))
    # A cell's sides in proportion, so that as little as possible is sent twice.
    columns = max(1, min(n_chunks, math.ceil(math.sqrt(cells * max(1, rows) / max(1, anchors)))))
    lines = max(1, min(n_blocks, math.ceil(cells / columns)))
    line, column = F.pmod(F.xxhash64("b_at"), F.lit(lines)), F.pmod(F.xxhash64("c_at"), F.lit(columns))
    spread = lambda frame, own, others, cell: frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", cell(own, F.col("other"))).drop("other")
    left = spread(blocks.select(*(F.col(c).alias("b_" + c) for c in blocks.columns)), line, columns, lambda own, other: own * columns + other)
    right = spread(chunks.select(*(F.col(c).alias("c_" + c) for c in chunks.columns)), column, lines, lambda own, other: other * columns + own)
    parts = min(lines * columns, 20_000)
    met = left.repartition(parts, "cell").join(right.repartition(parts, "cell").hint("merge"), "cell")
    return common.mapped(met.drop("cell"), find, schema)


def _read(batch: pa.RecordBatch, side: str, at: int, dims: int):
    """A chunk (ids, labels, planes) or block (ids, labels, numbers) of a row."""
    ids, labels = (np.frombuffer(batch.column(f"{side}_{c}")[at].as_buffer(), np.int64) for c in ("ids", "labels"))
    body = batch.column(f"{side}_body")[at].as_buffer()
    rows = batch.column(f"{side}_rows")[at].as_py()
    return ids, labels, np.frombuffer(body, np.uint8).reshape(rows, -1, len(ids)) if side == "c" else np.frombuffer(body, np.int64).reshape(rows, dims)


def _ranked(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first `keep` different (score, id) per key with their rank; cut within each task before anything is shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    first = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= keep)
    return first.dropDuplicates([*keys, "place"]).withColumnRenamed("place", "rank")


def hard_negatives(rows: DataFrame, scale: float = 256.0, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each anchor and positive, the first `negatives` rows of another label that score from `low` to `high` per cent of the positive:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; an anchor's positives are its first `positives` other rows, by score and
    then by smaller id, of its label. Shares are compared exactly. See `quantised` for rows that take no part. Vectors of different
    lengths are compared as if the shorter ended in zeros. Repeated rows count once; different rows with one id are rows of their
    own but never each other's positives, and where they have equal scores they are one entry of a list. An empty table, an anchor
    without positives, and one with nothing in the range give no rows. Other columns are left out.
    """
    spark = rows.sparkSession
    stored = session.written(quantised(rows, vec_id, label, vector, scale), "vectors")
    dims = max(1, stored.agg(F.max(F.size("q"))).first()[0] or 0)
    made = "at long, n long, ids binary, labels binary, rows int, body binary"
    chunks = session.written(common.mapped(stored, packer("chunk", dims, CHUNK), made), "chunks")
    # Anchors of one label stand together, so that a block meets few labels.
    anchors = stored.where(F.pmod("vec_id", F.lit(every)) == 0).repartitionByRange(common.shuffle_partitions(spark), "label", "vec_id")
    blocks = session.written(common.mapped(anchors, packer("block", dims, BLOCK), made), "anchors")

    def rows_of(made: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=names)

    def like(batches):
        """The best rows of each anchor's own label in a chunk."""
        for batch in batches:
            for row in range(batch.num_rows):
                block, found = batch.column("b_at")[row].as_py(), []
                own_ids, own_labels, numbers = _read(batch, "b", row, dims)
                ids, labels, packed = _read(batch, "c", row, dims)
                for value in np.intersect1d(own_labels, labels).tolist():
                    first, last = np.searchsorted(labels, value), np.searchsorted(labels, value, "right")  # chunks are sorted by label
                    mine, part = np.flatnonzero(own_labels == value), ids[first:last]
                    whole = np.concatenate([s for _, s in scores(tables(numbers[mine]), packed[:, :, first:last])])
                    for slot, own in zip(mine.tolist(), whole.T):
                        at = best(own, part, np.flatnonzero(part != own_ids[slot]), positives)
                        found += [(block, slot, int(own_ids[slot]), int(own[i]), int(part[i])) for i in at]
                if found:
                    yield rows_of(found, ["block", "slot", "anchor_id", "score", "id"])

    alike = _met(blocks, chunks, like, "block long, slot long, anchor_id long, score long, id long")
    alike = session.written(_ranked(alike, ["block", "slot"], positives), "positives")
    # At most BLOCK * positives entries in a group.
    wanted = alike.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "score"))).alias("wanted"))
    wanted = wanted.select("block", F.col("wanted.slot").alias("slots"), F.col("wanted.rank").alias("ranks"), F.col("wanted.score").alias("scores"))

    def unlike(batches):
        """The best rows of other labels in a chunk within the range of each positive."""
        for batch in batches:
            for row in range(batch.num_rows):
                block, found = batch.column("b_at")[row].as_py(), []
                own_ids, own_labels, numbers = _read(batch, "b", row, dims)
                ids, labels, packed = _read(batch, "c", row, dims)
                slots, ranks, aims = (batch.column(f"b_{c}")[row].values.to_numpy() for c in ("slots", "ranks", "scores"))
                mine, back = np.unique(slots, return_inverse=True)
                whole = np.concatenate([s for _, s in scores(tables(numbers[mine]), packed)])
                other = {value: np.flatnonzero(labels != value) for value in np.unique(own_labels).tolist()}
                for slot, place, rank, aim in zip(slots.tolist(), back.tolist(), ranks.tolist(), aims.tolist()):
                    least, most = -(-low * aim // 100), high * aim // 100
                    at = other[int(own_labels[slot])]
                    own = whole[:, place]
                    at = best(own, ids, at[(own[at] >= least) & (own[at] <= most)], negatives)
                    found += [(block, slot, rank, int(own[i]), int(ids[i])) for i in at]
                if found:
                    yield rows_of(found, ["block", "slot", "positive", "score", "id"])

    asked = blocks.join(wanted, blocks["at"] == wanted["block"]).drop("block")
    against = _met(asked, chunks, unlike, "block long, slot long, positive long, score long, id long")
    against = _ranked(against, ["block", "slot", "positive"], negatives)
    named = alike.select("block", "slot", "anchor_id", F.col("rank").cast("long").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return against.join(named, ["block", "slot", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
