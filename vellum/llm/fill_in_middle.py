"""Fill-in-middle: a text cut at two units into prefix, middle and suffix, which are put in another order.

Units are runs of ASCII letters and single other characters. An indexable skip list over them finds the cuts: every node
is a unit, every lane skips over more nodes than the one below, and each link carries its width twice, in units and in
code points. Descending from the fastest lane and adding up widths reaches the unit of any rank, and with it the code point
where the text is to be cut. How high a node reaches is taken from a mix of its number, so the list is the same in every run.

The order is drawn from a hash of the document's id, so a task that runs again makes the same output. A document that holds
one of the marks stays as it is, so every output can be undone.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 90  # per cent of documents that are cut
SPM_RATE = 20  # per cent of those whose suffix comes first
LANE_BITS = 3  # a lane has about one in 2 ** LANE_BITS nodes of the lane below


class SkipList:
    """The units of a text, to be found by rank; lane k holds (unit width, code point width) of the links between its nodes.

    The head of the list stands before the first unit, and every lane ends with a link to the end of the text.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = ((codes | 32) >= ord("a")) & ((codes | 32) <= ord("z"))
        first = ~letter
        first[1:] |= ~letter[:-1]
        first[:1] = True
        starts = np.flatnonzero(first)
        self.units = len(starts)
        places = np.append(starts, len(codes))  # of the node of each rank, and of the end
        heights = common.mix(np.arange(1, self.units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        nodes, down, mask = np.arange(self.units), None, 0
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        while True:
            ends = np.append(nodes, self.units)
            self.lanes.append((np.diff(ends), np.diff(places[ends]), down))
            mask = mask << LANE_BITS | (1 << LANE_BITS) - 1
            reaches = heights[nodes] & np.uint64(mask) == 0
            reaches[:1] = True  # the head is on every lane
            down = np.flatnonzero(reaches)  # where the next lane's nodes are in this one
            if len(nodes) <= 1 << LANE_BITS or len(down) == len(nodes):
                break
            nodes = nodes[down]

    def place(self, rank: int) -> int:
        """How many code points the first `rank` units have; `rank` is at most the number of units."""
        units = chars = node = 0
        for unit_widths, char_widths, down in reversed(self.lanes):
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += int(unit_widths[node])
                chars += int(char_widths[node])
                node += 1
            if units == rank:
                break
            node = node if down is None else int(down[node])
        return chars


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 from the hash of `seed`:`doc_id`; a null id counts as the empty text."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(made[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), code points of prefix and middle (None if plain), and output of a text."""
    units = SkipList(text)
    h1, h2, h3, h4 = drawn(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return units.units, "plain", None, None, text
    low, high = sorted((h1 % (units.units + 1), h2 % (units.units + 1)))
    begin, end = units.place(low), units.place(high)
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if h4 % 100 < spm_rate:
        return units.units, "spm", begin, end - begin, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.units, "psm", begin, end - begin, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text an output was made of. No mark is in the text, and none can begin within another, so the first of each is the one put there."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = rest.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = rest.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + middle + suffix


def filled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The output of every document and the text restored from it: doc_id, n, form, prefix_chars, middle_chars, output, restored.

    A null text is empty, and an empty one is plain. A null id draws as the empty text does. Rows with one id draw alike, repeated
    rows each give their row, an empty table gives none, and other columns are left out. A text is held whole, with a few numbers
    for each of its units.
    """
    def fill(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), common.strings(batch)
            for some in common.slices(texts):
                own = ids.slice(some.start, len(some))
                rows = [transformed(t, d, seed, rate, spm_rate) for t, d in zip(texts[some.start:some.stop], own.to_pylist())]
                n, form, prefix, middle, output = zip(*rows)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = (n, form, prefix, middle, output, [restored(o, f) for o, f in zip(output, form)])
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.mapped(rows, fill, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
