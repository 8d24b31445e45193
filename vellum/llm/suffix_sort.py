"""Two-stage suffix sorting of bytes to a bounded depth, with numpy.

A suffix is smaller or larger than its successor, the suffix one byte later. Only the smaller ones are sorted
directly, by their first bytes. The larger ones follow from a single scan over the buckets of first bytes: whenever a suffix is
reached, the one before it, if larger than its successor, is the next of its own bucket.
"""

import numpy as np

WORD = 8


def words_at(text: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian number; zeros follow the text, and `pad` more positions."""
    padded = np.zeros(len(text) + pad + WORD, np.uint64)
    padded[:len(text)] = text
    for step in (1, 2, 4):
        padded[:-step] = (padded[:-step] << np.uint64(8 * step)) | padded[step:]
    return padded[:len(text) + pad]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last is larger than the empty one."""
    steps = np.sign(np.diff(text.astype(np.int16), append=-1))
    last = len(text) - 1
    decided = np.where(steps != 0, np.arange(len(text)), last)
    return steps[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def sort_directly(positions: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """`positions` in the order of their first `depth` bytes at least; ties stay in ascending order."""
    order = positions[np.argsort(words[positions], kind="stable")]
    values = words[order]
    group = np.cumsum(np.concatenate(([False], values[1:] != values[:-1])))
    for at in range(WORD, depth, WORD):
        tied = np.zeros(len(order), np.bool_)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        values, groups = words[order[tied] + at], group[tied]
        rank = np.argsort(values, kind="stable")
        rank = rank[np.argsort(groups[rank], kind="stable")]
        order[tied], values, groups = order[tied][rank], values[rank], groups[rank]
        # a group starts anew where the next bytes differ
        new = np.zeros(len(order), np.bool_)
        new[tied[1:]] = (values[1:] != values[:-1]) & (groups[1:] == groups[:-1])
        group = group + np.cumsum(new)
    return order


def by_first_byte(positions: np.ndarray, text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """`positions` split by their first byte, each part in the given order."""
    first = text[positions]
    order = np.argsort(first, kind="stable")
    values, at = np.unique(first[order], return_index=True)
    return list(zip(values.tolist(), np.split(positions[order], at[1:])))


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All positions of `text` (unsigned bytes) in the order of the first `depth` bytes of their suffixes at least."""
    if not len(text):
        return np.zeros(0, np.int64)
    words = words_at(text, depth + WORD) if words is None else words
    smaller = smaller_than_successor(text)
    direct = dict(by_first_byte(sort_directly(np.flatnonzero(smaller), words, depth), text))
    waiting: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([len(text) - 1])]}  # follows the empty suffix
    result = []

    def induce(reached: np.ndarray, byte: int) -> np.ndarray:
        """Queues the larger suffixes before `reached`; gives back those of the bucket being scanned."""
        before = reached[reached > 0] - 1
        before = before[~smaller[before]]
        own = text[before] == byte
        for first, some in by_first_byte(before[~own], text):
            waiting.setdefault(first, []).append(some)
        return before[own]

    for byte in range(256):
        reached = np.concatenate(waiting.pop(byte)) if byte in waiting else np.zeros(0, np.int64)
        while len(reached):
            result.append(reached)
            reached = induce(reached, byte)
        if byte in direct:
            result.append(direct[byte])
            induce(direct[byte], byte)
    return np.concatenate(result)


def adjacent_equal(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of `order` but the first has a common prefix of `depth` bytes or more with the one before it."""
    equal = np.ones(max(0, len(order) - 1), np.bool_)
    for at in sorted({*range(0, depth - WORD + 1, WORD), depth - WORD}):
        values = words[order + at]
        equal &= values[1:] == values[:-1]
    return equal
