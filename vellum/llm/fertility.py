"""Quality rules by tokeniser fertility: how a public vocabulary cuts a document, held against bands per language.

Text a vocabulary was not made for breaks into more and shorter tokens, falls back to bytes, or repeats few of them.
Four figures are measured over all tokens of a document: characters per token, tokens per word (as words per token),
the share of byte-fallback tokens, and the entropy of its tokens. A band is the median of a group plus or minus
some robust deviations (1.4826 times the median absolute deviation), widened for short documents, whose figures
scatter more. Bands of entropy are per size class (the whole part of log2 of the tokens), as entropy grows with length
far more than it differs between languages; the others are per language.

Every group has a band, however few documents it has, and no count of documents switches a rule on. The deviation of a group of
n documents is mixed with the usual one at a share of PRIOR / (n + PRIOR). Its median is as uncertain as deviation^2 / n, and is
mixed with the expected one by how that compares with the variance between groups; what stays uncertain widens the band.
Expected of a language is the mean of the languages' medians, of a size class the line through the classes' medians.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vellum import session
from vellum.llm import common
from vellum.llm.words import word_lists

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
LEAST_WORDS = 50

# How many deviations below and above the median a document may be. Few byte-fallback tokens are never amiss.
BANDS = {"chars_per_token": (4.0, 8.0), "words_per_token": (5.0, 5.0), "byte_share": (math.inf, 8.0), "entropy": (4.0, 8.0)}
# Short documents: the deviation of a document of n tokens counts as sqrt(1 + SHORT / n) deviations.
SHORT = 400
# A deviation is at least this share of the median; that of byte_share, whose median is mostly 0, is at least this share itself.
LEAST_SPREAD = 0.01
# As many documents of a group say as much of its deviation as all other groups do.
PRIOR = 30
# Up to so many groups, each a row of a few numbers, bands are broadcast; more are joined like any table.
MOST_BANDS = 10_000

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
            "byte_tokens long, entropy double")


class PieceCounter:
    """Piece ids of words; every different word is encoded once until `keep` are held."""

    def __init__(self, path: str, keep: int = 600_000):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.known: dict[bytes, bytes] = {}
        self.keep = keep

    def count(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is in the words."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = set(words)
        new = list(new)
        for word, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            self.known[word] = np.array(ids, np.uint32).tobytes()
        return np.bincount(np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32), minlength=self.size)


_COUNTERS: dict[str, PieceCounter] = {}


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that are found twice or more, the first finding included."""
    if len(codes) < 4:
        return 0
    different = int(codes.max()) + 1
    pairs = codes[:-1].astype(np.int64) * different + codes[1:]
    if different > 1 << 20:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * different + codes[2:]
    _, which, found = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(found[which] > 1)
    covered = np.zeros(len(codes), np.bool_)
    for step in range(3):
        covered[again + step] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return again


def measure(text: str, counter: PieceCounter) -> tuple:
    """The MEASURES of one text."""
    codes, counts, index = [], np.zeros(counter.size, np.int64), {}
    for words in word_lists(text.encode()):
        codes.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        if words:
            counts += counter.count(words)
    codes = np.concatenate(codes)
    tokens = int(counts.sum())
    some = counts[counts > 0]
    entropy = math.log2(tokens) - float((some * np.log2(some)).sum()) / tokens if tokens else 0.0
    return (len(codes), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
            repeated_words(codes), tokens, int(counts[counter.is_byte].sum()), max(0.0, entropy))


def measured(docs: DataFrame, model: str, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` of every document with its MEASURES; a null text is measured as an empty one."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(carry)] + [MEASURES])
    names = [f"c{i}" for i in range(len(carry))] + [m.split()[0] for m in MEASURES.split(", ")]

    def task(batches):
        if model not in _COUNTERS:
            _COUNTERS[model] = PieceCounter(model)
        for batch in batches:
            rows = [measure(t, _COUNTERS[model]) for t in common.strings(batch, "t")]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f"c{i}") for i in range(len(carry))),
                 *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.float64())], names=names)

    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text}`").alias("t"))
    return common.mapped(given, task, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def small(groups: DataFrame) -> DataFrame:
    """`groups` as a written table, to be broadcast if it is counted to have at most MOST_BANDS rows."""
    held = session.written(groups, "bands")
    return F.broadcast(held) if held.count() <= MOST_BANDS else held


def banded(groups: DataFrame, group: str, figures: list[str], place: Column) -> DataFrame:
    """`groups(group, _n, _m_*, _s_*)`, a written table, as (group, _c_*, _u_*): the centre and the unit of each group's bands.

    One row of sums over all groups is read on the driver. `place` is where a group stands on the line of medians.
    """
    share, chosen = F.lit(PRIOR) / (F.col("_n") + PRIOR), [F.col(group)]
    for f in figures:
        middle, spread = F.col(f"_m_{f}"), F.col(f"_s_{f}")
        mean, at, slope, between, usual = (v or 0.0 for v in groups.agg(
            F.avg(middle), F.avg(place), F.regr_slope(middle, place),
            F.var_pop(middle) * (1 - F.coalesce(F.regr_r2(middle, place), F.lit(0.0))),
            F.try_divide(F.sum(F.col("_n") * spread), F.sum("_n"))).first())
        own, between = 1.4826 * (spread + share * (F.lit(usual) - spread)), F.lit(max(0.0, between))
        unsure = own * own / F.col("_n")
        trust = F.coalesce(F.try_divide(unsure, unsure + between), F.lit(0.0))
        centre = F.round(middle + trust * (F.lit(mean) + F.lit(slope) * (place - F.lit(at)) - middle), 6)
        least = F.lit(LEAST_SPREAD) if f == "byte_share" else centre * LEAST_SPREAD
        unit = F.greatest(F.sqrt(own * own + trust * between), least)
        chosen += [centre.alias(f"_c_{f}"), F.round(unit, 6).alias(f"_u_{f}")]
    return groups.select(*chosen)


def judged(measures: DataFrame, language: str) -> DataFrame:
    """`measures`, a written table, with base_failed, chars_per_token, words_per_token, byte_share and kept.

    A document is kept if it does not fail the base rules and is within every band. Null languages are one group.
    """
    n = F.col("n_tokens")
    rows = measures.withColumns({
        "base_failed": base_failed(), "byte_share": F.coalesce(F.try_divide("byte_tokens", n), F.lit(0.0)),
        "chars_per_token": F.round(F.coalesce(F.try_divide("word_chars", n), F.lit(0.0)), 3),
        "words_per_token": F.round(F.coalesce(F.try_divide("n_words", n), F.lit(0.0)), 3),
        "entropy": F.round("entropy", 3), "_wide": F.sqrt(1 + F.lit(SHORT) / F.greatest(n, F.lit(1))),
        "_of_language": F.coalesce(F.col(language).cast("string"), F.lit("")), "_of_size": F.floor(F.log2(F.greatest(n, F.lit(1))))})
    within, sound = ~F.col("base_failed"), rows.where(~F.col("base_failed"))
    for group, figures, place in (("_of_language", ["chars_per_token", "words_per_token", "byte_share"], F.lit(0.0)),
                                  ("_of_size", ["entropy"], F.col("_of_size").cast("double"))):
        # Figures are rounded, so that an exact median needs as many counters as there are different values.
        figure = {f: F.round(f, 3) for f in figures}
        middle = small(sound.groupBy(group).agg(F.count(F.lit(1)).alias("_n"),
                                                *(F.percentile(figure[f], F.lit(0.5)).alias(f"_m_{f}") for f in figures)))
        away = {f: F.round((figure[f] - F.col(f"_m_{f}")) / F.col("_wide"), 3) for f in figures}
        spread = session.written(sound.join(middle, group).groupBy(group, "_n", *(f"_m_{f}" for f in figures))
                                 .agg(*(F.percentile(F.abs(away[f]), F.lit(0.5)).alias(f"_s_{f}") for f in figures)), "bands")
        rows = rows.join(small(banded(spread, group, figures, place)), group, "left")  # the texts may be carried along
        for f in figures:
            off, (low, high), unit = F.round((figure[f] - F.col(f"_c_{f}")) / F.col("_wide"), 6), BANDS[f], F.col(f"_u_{f}")
            within &= off <= unit * high
            if low < math.inf:
                within &= off >= -unit * low
    return rows.withColumn("kept", within)


def verdicts(docs: DataFrame, model: str, carry: list[str], language: str = "lang", text: str = "text") -> DataFrame:
    """One row per document: the columns `carry` and `language`, all figures, base_failed and kept.

    Empty and null texts have no words, so they fail the base rules. An empty table gives an empty result.
    """
    names = [*carry, *([language] if language not in carry else [])]
    held = session.written(measured(docs, model, names, text), "fertility")
    return judged(held, f"c{names.index(language)}").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
                              *(m.split()[0] for m in MEASURES.split(", ")), "chars_per_token", "words_per_token", "byte_share",
                              "base_failed", "kept")


def within_bands(docs: DataFrame, model: str, language: str = "lang", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that `verdicts` keeps."""
    held = session.written(measured(docs, model, docs.columns, text), "fertility")
    kept = judged(held, f"c{docs.columns.index(language)}").where("kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
