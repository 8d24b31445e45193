"""Near copies by MinHash: universal hash minima in bands, signatures, exact checks, and connected components.

1. Documents become sets of word shingles. Equal sets become one set. Each set gets the minima of many universal hashes
   (a x + b over 64 bits, a odd, the upper half), of which bands of ROWS minima make bucket keys. There are so many bands that two
   sets at the threshold miss each other in all of them less than once in MISS pairs.
2. Sets that share a bucket are compared by signature, the lowest byte of every minimum. Within a bucket, sets gather
   around leaders: a set no leader is close to becomes one, and a set is tied to every leader that a partner of it could
   be close to. The ties make families; a linked pair is in one family. Buckets are split into parts of at most
   PART sets, whose leaders meet in turn, so a bucket with a third of all sets is many tasks.
3. Within a family, links are confirmed on the full sets, by counting common shingles. A task sees two blocks of a family, of
   bounded bytes and rows, and gives back a forest of the links it found, not all pairs.
4. Components of the confirmed links follow by large-star and small-star.

Families only bring sets together; a link depends on the full sets alone. A family beyond one block costs a task for each two
of its blocks.
"""

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vellum import session
from vellum.llm import common
from vellum.llm.components import components
from vellum.llm.words import word_lists

ROWS = 6
MISS = 100_000
SEED = 20
PART = 2000
RADIUS = 0.8  # a set with a leader this close by signature needs none of its own
SLACK = 0.42  # below the threshold: how far, by signature, the partner of a set near a leader may be from it
LEADER_SLACK = 0.65  # the same for two leaders of parts of a bucket
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 2000
TURN = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, rows: int = ROWS) -> int:
    return math.ceil(-math.log(MISS) / math.log(1 - similarity ** rows))


class Shingles:
    """Sets of hashed word shingles; keys of words are held for up to `keep` different ones."""

    def __init__(self, words: int, keep: int = 500_000):
        self.width, self.keep, self.known = words, keep, {}

    def keys(self, text: str) -> np.ndarray:
        known, parts = self.known, []
        if len(known) > self.keep:
            known.clear()
        for words in word_lists(text.encode().lower()):
            for word in set(words).difference(known):
                known[word] = xxhash.xxh3_64_intdigest(word)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts)

    def of(self, text: str) -> np.ndarray:
        """The different shingles of a text, in ascending order; a text with fewer words is one shingle, without words none."""
        keys = self.keys(text)
        width = min(self.width, len(keys))
        if not width:
            return keys
        rolled = np.full(len(keys) - width + 1, width, np.uint64)
        for at in range(width):
            rolled = common.mix(rolled * TURN + keys[at:len(keys) - width + 1 + at])
        return np.unique(rolled)


def fingerprint(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


@functools.cache
def universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers, all odd, and addends of `count` universal hashes."""
    numbers = np.random.default_rng(SEED).integers(0, 1 << 64, (2, count), np.uint64)
    return numbers[0] | np.uint64(1), numbers[1]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The smallest value of each of `count` hashes over every set (none may be empty), as 32-bit numbers: a row per set."""
    elements = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    result = np.empty((len(sets), count), np.uint32)
    hashed = np.empty_like(elements)
    for at, (a, b) in enumerate(zip(*universal(count))):
        np.multiply(elements, a, out=hashed)
        hashed += b
        result[:, at] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return result


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key for every band of every row."""
    bands = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1), bands.shape[:2])
    for at in range(rows):
        keys = common.mix(keys * TURN + bands[:, :, at])
    return keys


def sketched(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, n, fingerprint, bands and signature of every row; the last three are null for empty sets."""
    bands = bands_for(similarity)

    def sketch(batches):
        shingles = Shingles(words)
        for batch in batches:
            texts, columns = common.strings(batch), ([], [], [], [])
            for some in common.slices(texts):
                sets = [shingles.of(t) for t in texts[some.start:some.stop]]
                full = [s for s in sets if len(s)]
                signature = minima(full, bands * ROWS) if full else np.zeros((0, bands * ROWS), np.uint32)
                keys, low, at = band_keys(signature, ROWS).view(np.int64), signature.astype(np.uint8), 0
                for s in sets:
                    values = (fingerprint(s), keys[at].tolist(), low[at].tobytes()) if len(s) else (None,) * 3
                    at += bool(len(s))
                    for column, value in zip(columns, (len(s), *values)):
                        column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["doc_id", "text_hash", "n", "fingerprint", "bands", "signature"])

    return common.mapped(docs, sketch, "doc_id long, text_hash long, n long, fingerprint binary, bands array<long>, signature binary")


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity as the signatures tell it: the share of equal bytes without that of chance."""
    return ((many == one).mean(1) - 1 / 256) / (1 - 1 / 256)


class Forest:
    """Which of some places are linked so far."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, place: int, others: np.ndarray) -> list[int]:
        """Links a place to others; gives back one of each group that was apart from it."""
        labels, first = np.unique(self.label[others], return_index=True)
        apart = labels != self.label[place]
        if apart.any():
            self.label[np.isin(self.label, labels[apart])] = self.label[place]
        return others[first[apart]].tolist()


def around_leaders(nodes: np.ndarray, signatures: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Ties (node, leader) of at least that likeness, without those that other ties imply, and the places of the leaders."""
    ties, leaders, forest = [], [0], Forest(len(nodes))
    for at in range(1, len(nodes)):
        near = likeness(signatures[at], signatures[leaders])
        close = np.array(leaders)[near >= least]
        ties += [(int(nodes[at]), int(nodes[i])) for i in forest.join(at, close)] if len(close) else []
        if near.max() < RADIUS:
            leaders.append(at)
    return ties, leaders


def gathered(members: DataFrame, least: float) -> DataFrame:
    """Ties of the sets of each part of a bucket: (key, a, b, null), and its leaders: (key, node, null, signature)."""
    def gather(batches):
        for group in common.groups(batches, ["key", "part"]):
            nodes = group.column("node").to_numpy()
            signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
            ties, leaders = around_leaders(nodes, signatures, least)
            key = group.column("key")[0].as_py()
            split = group.column("parts")[0].as_py() > 1
            rows = [(key, a, b, None) for a, b in ties]
            rows += [(key, int(nodes[i]), None, signatures[i].tobytes()) for i in leaders] if split else []
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "a", "b", "signature"])

    dealt = members.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return common.mapped(dealt, gather, "key long, a long, b long, signature binary")


def families(sets: DataFrame, similarity: float) -> DataFrame:
    """node, component: sets that share a bucket, in groups such that linked ones are in the same."""
    rows = sets.select("node", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = rows.join(full, "key").join(sets.select("node", "signature"), "node")
    parts = F.ceil(F.col("size") / PART).cast("int")
    members = members.select("key", "node", "signature", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    found = session.written(gathered(members, similarity - SLACK), "ties")
    leaders = found.where("b is null").select("key", F.col("a").alias("node"), "signature", F.lit(1).alias("parts"), F.lit(0).cast("long").alias("part"))
    ties = found.where("b is not null").select("a", "b").union(gathered(leaders, similarity - LEADER_SLACK).where("b is not null").select("a", "b"))
    return components(ties)


def confirmed(nodes: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between sets: those of a single block, or those between two blocks."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    elements, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(which, kind="stable")
    holders, at = owner[order], np.searchsorted(which[order], np.arange(len(elements) + 1))
    begins, forest, links = np.cumsum(sizes) - sizes, Forest(len(sets)), []
    one_block = blocks[0] == blocks[-1] and (blocks == blocks[0]).all()
    for i in range(len(sets)):
        own = which[begins[i]:begins[i] + sizes[i]]
        common_to = np.bincount(np.concatenate([holders[at[e]:at[e + 1]] for e in own]), minlength=len(sets))
        linked = 100 * common_to >= percent * (sizes + sizes[i] - common_to)
        linked[i:] = False
        if not one_block:
            linked &= blocks != blocks[i]
        others = np.flatnonzero(linked)
        if len(others):
            links += [(int(nodes[i]), int(nodes[o])) for o in forest.join(i, others)]
    return links


def links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between nodes of `sets`, enough of them to tie together all that are linked in any way."""
    family = families(sets, percent / 100)
    stats = (family.join(sets.select("node", "n"), "node").groupBy("component")
             .agg(F.greatest(F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks")))
    wanted = (family.join(sets.select("node", "doc_id", "fingerprint"), "node").join(stats, "component")
              .select("doc_id", "fingerprint", "node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))

    def fetch(batches):
        shingles = Shingles(words)
        for batch in batches:
            sets_of = [shingles.of(t) for t in common.strings(batch)]
            right = pa.array([fingerprint(s) == f for s, f in zip(sets_of, batch.column("fingerprint").to_pylist())], pa.bool_())
            names = ["node", "component", "blocks", "block"]
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([s.tobytes() for s in sets_of], pa.binary())], names=[*names, "elements"])
            yield made.filter(right)  # another row may have the same id and a different text

    # A text is joined to its set by id; rows that are repeated give the same set again.
    texts = docs.join(wanted, "doc_id").select("text", "fingerprint", "node", "component", "blocks", "block")
    full = session.written(common.mapped(texts, fetch, "node long, component long, blocks int, block int, elements binary").dropDuplicates(["node"]), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = (full.withColumn("other", other).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                                                    "node", "block", "elements"))

    def confirm(batches):
        for group in common.groups(batches, ["component", "low", "high"]):
            sets_of = [np.frombuffer(e, np.uint64) for e in group.column("elements").to_pylist()]
            found = confirmed(group.column("node").to_numpy(), sets_of, group.column("block").to_numpy(), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    dealt = pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
    return common.mapped(dealt, confirm, "a long, b long")


def near_copies(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, an empty one for null), n_shingles, component_id and kept of every row of `docs`.

    Two documents are linked if 100 times the shingles they share are `percent` or more times those of either.
    component_id is the smallest id that links reach; kept says whether it is the row's own. Texts without words, null ones
    included, are linked with nothing. Rows with a null id are linked with nothing and kept, with a null component.
    Rows that are repeated are one document: all of them carry the same values.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketches = session.written(sketched(rows.withColumn("text_hash", F.xxhash64("text")), words, percent / 100), "sketches")
    sets = (sketches.where("n > 0 and doc_id is not null").groupBy("fingerprint")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    sets = session.written(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    found = components(links(rows.where("doc_id is not null"), sets, words, percent))
    least = (sets.select("node", "fingerprint", "doc_id").join(found, "node", "left")
             .select("fingerprint", "doc_id", F.coalesce("component", "node").alias("component")))
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = least.join(smallest, "component").select("fingerprint", "component_id")
    named = sketches.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint"))
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return named.join(by_set, "fingerprint", "left").select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whatever their names, but one document of each group of near copies: the one with the
    smallest id.

    Rows with an equal id and text stay once, those with a null id too. Texts without words and rows with a null id are in no group.
    An empty table gives an empty one.
    """
    gone = near_copies(docs, words, percent, doc_id, text).where("not kept").select("doc_id", "text_hash").distinct()
    # Columns travel as c0, c1, ..., so that none meets a name used here.
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (doc_id, text))
    marked = given.withColumns({"own_doc": own_id.cast("long"), "own_hash": F.xxhash64(F.coalesce(own_text, F.lit("")))})
    # A null id is never gone, so plain equality will do: texts are then shuffled once, by the same keys for this and for the next step.
    left = marked.join(gone, (F.col("own_doc") == F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti")
    return left.dropDuplicates(["own_doc", "own_hash"]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
