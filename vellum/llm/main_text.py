"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a row of tokens. Words score by where they stand (the section and the element around them): positive where
labelled pages have content, negative where they have menus and the like. Tags score negative: a little where they come with
content, much where they come with something else. The contiguous stretch with the highest sum, found in one scan, is the
content; words in it whose place scores negative (a form or an advert within it) are left out.

Weights are log odds of a token's place being inside the content of labelled pages, those that mark it with an <article> element,
from at most SAMPLE of them (taken by a hash of the page). Places that pages name alike but rarely are given a few counts
beforehand (PRIOR_*), so that a table without a single label still has weights.
"""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import common

SAMPLE = 2000

# Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "button", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
SECTIONS = {"article", "aside", "body", "div", "dialog", "footer", "form", "header", "main", "nav", "section"}
PRIOR_OUT = {"aside", "dialog", "footer", "form", "header", "nav"}
PRIOR_IN = {"article", "main"}
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
OUT_NAME = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|footer|header|login|menu|nav\w*|newsletter|"
                      r"notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|widget)(?:$|[-_ 0-9])")

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INSIDE = "in:"
OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}


def tokens(page: str):
    """The tags and texts of a page: (kind, place, text). Kinds: tag, word (its text is what stands between two tags) and cut,
    the border of a block. Scripts, styles and comments give nothing. Places inside an <article> or <main> begin with INSIDE."""
    at, end, strict = 0, len(page), True
    stack: list[tuple[str, str]] = []  # element, its name as a section

    def place() -> str:
        section = next((s for _, s in reversed(stack) if s), "")
        element = next((e for e, _ in reversed(stack)), "")
        link = any(e == "a" for e, _ in stack)
        return f"{inside()}{section}>{'a' if link else element}"

    def inside() -> str:
        return INSIDE if any(e in PRIOR_IN for e, _ in stack) else ""

    while at < end:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = end
        if open_ > at:
            yield "word", place(), page[at:open_]
            at = open_
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        match = TAG.match(page, at) if strict else None
        if match is None:
            match = LOOSE.match(page, at)
            strict = strict and match is None  # a quote is left open: from here on quotes are not looked at
        if match is None:  # a lone <
            yield "word", place(), "<"
            at += 1
            continue
        at = match.end()
        closing, name, attributes = match.group(1), match.group(2).lower(), match.group(3)
        if closing:
            if any(e == name for e, _ in stack):
                while stack.pop()[0] != name:
                    pass
            if name not in INLINE:
                yield "cut", "", ""
            yield "tag", f"{inside()}/{name}", ""
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else end
            yield "tag", inside() + name, ""
            continue
        named = name
        if attributes and (found := [next(filter(None, g), "").lower() for g in NAME.findall(attributes)]):
            out = any(OUT_NAME.search(v) or v in OUT_ROLE for v in found)
            named = f"{name}.{'out' if out else ' '.join(found[0].split()[:1])}" if name in SECTIONS or out else name
        if name not in INLINE:
            yield "cut", "", ""
        yield "tag", inside() + named, ""
        if name in VOID or attributes.endswith("/"):
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            stack.pop()
        if name == "a" or name not in INLINE:
            stack.append((name, named if name in SECTIONS or named.endswith(".out") else ""))


def label_counts(page: str) -> Counter:
    """(kind, place, inside) of every word and tag of a page, by whether an <article> is around it."""
    counts, depth = Counter(), 0
    for kind, place, text in tokens(page):
        if kind == "tag" and place.split(".")[0] in ("article", "/article"):
            depth = max(0, depth + (-1 if place[0] == "/" else 1))
            counts[kind, place, False] += 1
        elif kind != "cut":
            counts[kind, place, depth > 0] += len(text.split()) if kind == "word" else 1
    return counts


class Weights:
    """Scores of words and tags by place, from counts (kind, place) -> [outside, inside]."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        self.counts = counts
        self.sections: dict[str, list[int]] = {}
        for (kind, place), (outside, inside) in counts.items():
            if kind == "word":
                known = self.sections.setdefault(place.split(">")[0], [0, 0])
                known[0] += outside
                known[1] += inside
        self.known: dict[tuple[str, str], float] = {}

    @staticmethod
    def prior(place: str) -> tuple[float, float]:
        section, _, element = place.removeprefix(INSIDE).partition(">")
        base = section.lstrip("/").split(".")[0]
        outside = 20.0 if base in PRIOR_OUT or section.endswith(".out") else 0.0
        inside = 5.0 if base in PRIOR_IN or not outside and place.startswith(INSIDE) else 0.0
        if element == "a":
            outside += 2.0
        elif element in ("p", "h1", "h2", "h3", "blockquote", "pre"):
            inside += 2.0
        return 1.0 + outside, 1.0 + inside

    def of(self, kind: str, place: str) -> float:
        score = self.known.get((kind, place))
        if score is None:
            outside, inside = self.prior(place)
            seen = self.counts.get((kind, place))
            if seen is None and kind == "word":
                seen = self.sections.get(place.split(">")[0])
                seen = seen and tuple(n / max(1, sum(seen)) * 5 for n in seen)
            outside, inside = outside + (seen or (0, 0))[0], inside + (seen or (0, 0))[1]
            odds = math.log(inside / outside)
            if kind == "word":
                score = max(-4.0, min(4.0, odds)) + 0.25
            else:  # within an article even an advert's tags may be passed over; its words are left out later
                score = -0.05 if place.startswith(INSIDE) else min(-0.05, max(-8.0, odds * 2))
            self.known[kind, place] = score
        return score


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the highest sum above 0; the first and shortest of equal ones."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, region = total, (start, at + 1)
    return region


def main_text(page: str, weights: Weights) -> str:
    """The content of a page: its blocks joined by one space."""
    parts = list(tokens(page))
    scores = [weights.of(k, p) * (len(t.split()) if k == "word" else 1) if k != "cut" else 0.0 for k, p, t in parts]
    begin, end = best_region([0.0 if s < 0 and k == "word" and p.startswith(INSIDE) else s for s, (k, p, _) in zip(scores, parts)])
    blocks = [[]]
    for (kind, place, text), score in zip(parts[begin:end], scores[begin:end]):
        if kind == "cut":
            blocks.append([])
        elif kind == "word" and score >= 0:
            blocks[-1].append(html.unescape(text))
        elif kind == "tag" and place.removeprefix(INSIDE) in VOID:
            blocks.append([])
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def learned(pages: DataFrame, column: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most `sample` different pages with an <article>, chosen by the hash of the page."""
    def count(batches):
        for batch in batches:
            counts = Counter()
            for page in common.strings(batch, "html"):
                counts.update(label_counts(page))
            rows = [(k, p, i, n) for (k, p, i), n in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.int64()))],
                                                 names=["kind", "place", "inside", "n"])

    labelled = pages.select(F.col(f"`{column}`").alias("html")).where(F.lower("html").contains("<article"))
    chosen = common.sampled(labelled, "html", sample)
    counts: dict[tuple[str, str], list[int]] = {}
    summed = common.mapped(chosen, count, "kind string, place string, inside boolean, n long").groupBy("kind", "place", "inside").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # places of `sample` pages
        counts.setdefault((row["kind"], row["place"]), [0, 0])[row["inside"]] += row["n"]
    return Weights({k: tuple(v) for k, v in counts.items()})


def extracted(pages: DataFrame, keep: list[str], column: str = "html", weights: Weights | None = None) -> DataFrame:
    """The columns `keep` of every page with its main text and n_chars, its code points. A null page is empty; so is its text."""
    sent = pages.sparkSession.sparkContext.broadcast((weights or learned(pages, column)).counts)  # places of at most SAMPLE pages
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    names = [f"c{i}" for i in range(len(keep))]

    def extract(batches):
        own = Weights(sent.value)
        for batch in batches:
            texts = [main_text(p, own) for p in common.strings(batch, "h")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*names, "text", "n_chars"])

    given = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{column}`").alias("h"))
    made = common.mapped(given, extract, ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(keep, names)), "text string, n_chars long"]))
    return made.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "text", "n_chars")
