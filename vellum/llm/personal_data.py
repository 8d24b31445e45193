"""Personal data by rules and by a semi-Markov conditional random field over whole spans.

The rules find e-mail addresses, IP addresses, card and phone numbers that are written as usual. The model adds those
that are not: it looks at islands of text (runs of digits and their separators, and what stands around an at sign or a word for
it), scores every candidate segment of at most LONGEST tokens by features of the whole span (its shape, lengths of its
groups, check digits, neighbours), and chooses kinds and borders of all segments of an island together by dynamic programming.
Outside of islands no segment can score, so islands are scored on their own without changing the result. Spans of the
rules stay; the model's are added where they do not overlap one.

The model is trained on the driver from a bounded, documented sample: islands with a rule's span of at most SAMPLE documents,
chosen by hash, with the rules' spans as labels, the same islands with those spans written in other ways, and made-up sentences. Training maximises the
conditional likelihood with forward and backward sums over the same segments.
"""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1000
LONGEST = 24  # tokens of a segment
AROUND = 90  # characters of an island before and after an at sign
EPOCHS, RATE, DECAY = 6, 0.2, 1e-4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit run can match from its middle if it does not from its start, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r"@|[(\[{] ?at ?[)\]}]| at (?=[A-Za-z0-9-]{1,63} ?(?:[(\[{] ?dot ?[)\]}]| dot ))", re.I)
NUMBERS = re.compile(r"[+(]?[0-9](?:[ ().+/-]{0,3}[0-9])++")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, from each at sign outwards, so that long runs cost nothing twice."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            spans.append((start, last))
        at = text.find("@", max(at + 1, last))
    return spans


def rules(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, in order; kinds are numbers of KINDS."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m.group())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found)


def islands(text: str) -> list[tuple[int, int]]:
    """The stretches of a text that can hold a segment; those that meet are one."""
    spans = [(m.start(), m.end()) for m in NUMBERS.finditer(text) if sum(map(len, DIGITS.findall(m.group()))) >= 7]
    spans += [(max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)) for m in AT.finditer(text)]
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(m) for m in merged]


def segments(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token borders of an island, and the segments (first and last border) that look at all like personal data."""
    borders = [start, *(m.end() for m in TOKEN.finditer(text, start, end))]
    tokens = [text[a:b] for a, b in zip(borders, borders[1:])]
    digits = [0]
    for t in tokens:
        digits.append(digits[-1] + (len(t) if t[0] in "0123456789" else 0))
    solid = [t[0].isalnum() and t[0].isascii() for t in tokens]
    signs = [m.start() + (m.group()[0] == " ") for m in AT.finditer(text, start, end)]
    ats = set(signs)
    found = []
    for i, first in enumerate(tokens):
        if not (solid[i] or first in "+("):
            continue
        at = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            at = at or borders[j] in ats
            if solid[j] and (digits[j + 1] - digits[i] >= 7 or at and j > i):
                found.append((i, j + 1))
    return borders, found


def shape(span: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span))


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span; a weight belongs to a kind and one of them."""
    span = text[start:end]
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    before, after = text[start - 1:start], text[end:end + 1]
    words = re.findall(r"[a-z]+", text[max(0, start - 25):start].lower())
    kind = lambda c: "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c or "^"
    found = ["bias", f"digits={min(len(digits), 20)}", f"before={kind(before)}", f"after={kind(after)}", f"first={kind(span[0])}",
             f"plus={span[0] == '+'}", f"luhn={12 <= len(digits) <= 19 and luhn(digits)}", f"letters={bool(re.search('[A-Za-z]', span))}"]
    ended = re.match(r"[.+/@-]?[A-Za-z0-9]", text[end:end + 2]) is not None
    begun = re.search(r"[A-Za-z0-9][.+/@_-]?$", text[max(0, start - 2):start]) is not None
    found.append(f"cut={begun}{ended}")
    if AT.search(span):
        found += ["at", f"address={bool(ADDRESS.fullmatch(span))}", f"tail={min(7, len(re.split('[^A-Za-z]', span)[-1]))}"]
    else:
        found += [f"shape={shape(span)[:20]}", f"groups={'-'.join(str(min(9, len(g))) for g in groups[:6])}",
                  f"dotted={span.count('.') == 3 and len(groups) == 4 and bool(IP.fullmatch(span)) and octets(span)}"]
    return found + [f"near={w}" for w in words[-1:]]


ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]|at) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z0-9-]+)+", re.I)


def logsum(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Field:
    """A semi-Markov conditional random field: weights of (kind, feature)."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def scores(self, named: list[str]) -> list[float]:
        get = self.weights.get
        return [sum(get(f"{kind}|{n}", 0.0) for n in named) for kind in KINDS]

    def best(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The spans (start, kind, end) of the most probable reading of an island."""
        borders, found = segments(text, start, end)
        into = defaultdict(list)
        for i, j in found:
            scores = self.scores(features(text, borders[i], borders[j]))
            score = max(scores)
            if score > 0:
                into[j].append((score, i, scores.index(score)))
        best: list[float] = [0.0]
        back: list[tuple | None] = [None]
        for j in range(1, len(borders)):
            best.append(best[-1])
            back.append(None)
            for score, i, kind in into[j]:
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
        spans, at = [], len(borders) - 1
        while at > 0:
            if back[at]:
                i, kind = back[at]
                spans.append((borders[i], kind, borders[at]))
                at = i
            else:
                at -= 1
        return spans[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int, int]]]]) -> None:
        """Steps along the gradient of the log likelihood of labelled islands, each a text of its own."""
        ready = []
        for text, gold in examples:
            borders, found = segments(text, 0, len(text))
            named = [features(text, borders[i], borders[j]) for i, j in found]
            ready.append((len(borders), found, named, {(borders.index(s), borders.index(e), k) for s, k, e in gold if s in borders and e in borders}))
        order = random.Random(1)
        for epoch in range(EPOCHS):
            order.shuffle(ready)
            rate = RATE / (1 + epoch)
            for size, found, named, gold in ready:
                scores = [self.scores(n) for n in named]
                ahead, behind = [0.0] + [-math.inf] * (size - 1), [-math.inf] * (size - 1) + [0.0]
                ends, starts = defaultdict(list), defaultdict(list)
                for at, (i, j) in enumerate(found):
                    ends[j].append(at)
                    starts[i].append(at)
                for j in range(1, size):
                    ahead[j] = ahead[j - 1]
                    for at in ends[j]:
                        for score in scores[at]:
                            ahead[j] = logsum(ahead[j], ahead[found[at][0]] + score)
                for i in range(size - 2, -1, -1):
                    behind[i] = behind[i + 1]
                    for at in starts[i]:
                        for score in scores[at]:
                            behind[i] = logsum(behind[i], behind[found[at][1]] + score)
                for at, (i, j) in enumerate(found):
                    for kind, score in enumerate(scores[at]):
                        expected = math.exp(min(0.0, ahead[i] + score + behind[j] - ahead[-1]))
                        step = rate * (((i, j, kind) in gold) - expected)
                        if abs(step) > 1e-6:
                            for name in named[at]:
                                key = f"{KINDS[kind]}|{name}"
                                self.weights[key] = self.weights.get(key, 0.0) * (1 - DECAY) + step


def rewritten(kind: int, span: str, draw: random.Random) -> str:
    """The same data written in a way the rules do not know."""
    digits = "".join(DIGITS.findall(span))
    if kind == 0:
        at, dot = draw.choice([("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "(dot)")])
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == 2:
        return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and len(digits) >= 10:
        area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return draw.choice([f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"1-{area}-{middle}-{last}"])
    return span


def made_up(draw: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with data of each kind, and with numbers that are none of it."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    examples = []
    for _ in range(120):
        card = number(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        spans = [f"{word()}.{number(2)}@{word()}.{draw.choice(['com', 'org', 'net', 'de'])}", ".".join(str(draw.randint(1, 255)) for _ in range(4)), card,
                 f"+1 ({number(3)}) {number(3)}-{number(4)}"]
        for kind, span in enumerate(spans):
            for text in (span, rewritten(kind, span, draw)):
                before, after = f"{word()} {word()} ", draw.choice([f" {word()}", f", {word()}", f". {word().title()}", ""])
                examples.append((before + text + after, [(len(before), kind, len(before) + len(text))]))
        wrong = number(15)
        wrong += next(d for d in "0123456789" if not luhn(wrong + d))
        for text in (f"20{number(2)}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}", f"1{number(2)}.{number(3)}.{number(3)}", wrong, number(draw.choice([7, 8, 9, 11, 20, 24])),
                     f"v{number(1)}.{number(2)}.{number(1)}.{number(4)}", f"0x{number(8)}{word()}{number(7)}", f"{number(4)}-{number(4)}", f"{word()} @ {word()}",
                     f"@{word()}", f"{number(3)} {number(3)} {number(3)}", f"{word()} at {word()}", f"3{number(2)}.{number(3)}.{number(3)}.{number(3)}"):
            examples.append((f"{word()} {text} {word()}", []))
    return examples


def trained(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """A field fitted to islands of at most `sample` documents, chosen by the hash of their text, and to made-up sentences."""
    def cut(batches):
        for batch in batches:
            rows = []
            for value in common.strings(batch, "t"):
                spans = rules(value)
                for start, end in islands(value)[:4]:  # a few of each, so that one long document is not the sample
                    low, high = max(0, start - 30), min(len(value), end + 5)
                    inside = [(s - low, k, e - low) for s, k, e in spans if low <= s and e <= high]
                    if inside and high - low <= 400:  # one without a rule's span may hold data that the rules miss
                        rows.append((value[low:high], [v for span in inside for v in span]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.int32())))], names=["island", "spans"])

    given = docs.select(F.col(f"`{text}`").alias("t")).where(F.col("t").rlike("[0-9@]"))
    chosen = common.sampled(given, "t", sample)
    drawn = sorted((r["island"], tuple(r["spans"])) for r in common.mapped(chosen, cut, "island string, spans array<int>").toLocalIterator())
    draw = random.Random(7)
    examples = made_up(draw)
    for island, flat in drawn:
        spans = list(zip(flat[::3], flat[1::3], flat[2::3]))
        examples.append((island, spans))
        if len(spans) == 1:
            start, kind, end = spans[0]
            other = rewritten(kind, island[start:end], draw)
            examples.append((island[:start] + other + island[end:], [(start, kind, start + len(other))]))
    field = Field({})
    field.learn(examples)
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans of the rules, and these together with the model's, both in order of start and kind."""
    base = rules(text)
    added = []
    for start, end in islands(text):
        added += [(s, k, e) for s, k, e in field.best(text, start, end) if not any(s < be and bs < e for bs, _, be in base)]
    return base, sorted(base + added) if added else base


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with every span as <KIND>; of spans that overlap, the later ones lengthen the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _read(docs: DataFrame, keep: list[str], text: str, field: Field | None) -> DataFrame:
    """The columns `keep` as c0, c1, ... with what `detected` tells."""
    sent = docs.sparkSession.sparkContext.broadcast((field or trained(docs, text)).weights)  # bounded by the training sample
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [f"c{i}" for i in range(len(keep))]

    def find(batches):
        own = Field(sent.value)
        for batch in batches:
            rows = []
            for value in batch.column("t").to_pylist():
                base, spans = all_spans(value or "", own)
                counts = Counter(k for _, k, _ in base)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(named(base).encode()).hexdigest(), named(spans),
                             value if value is None or not spans else masked(value, spans)))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             names=[*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"])

    given = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{text}`").alias("t"))
    schema = [*(f"{n} {kinds[c]}" for c, n in zip(keep, names)), *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, masked string"]
    return common.mapped(given, find, ", ".join(schema))


def detected(docs: DataFrame, keep: list[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """The columns `keep` of every row with n_email, n_ip, n_card, n_phone and base_sha256 (of the rules' spans), spans (all of
    them, as kind:start:end in code points, joined by commas) and masked (the text with every span as <KIND>).

    A null text is empty, has no spans, and stays null in masked. Repeated rows each give their row.
    """
    return _read(docs, keep, text, field).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked")


def without_personal_data(docs: DataFrame, text: str = "text", length: str = "n_chars", field: Field | None = None) -> DataFrame:
    """The rows and columns of `docs` with every span as <KIND>; a column `length`, if there is one, counts the new code points."""
    found = _read(docs, docs.columns, text, field)
    new = {text: F.col("masked")}
    if length in docs.columns:
        new[length] = F.char_length("masked").cast(docs.schema[length].dataType)
    return found.select(*(new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
