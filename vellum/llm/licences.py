"""Licence notices by a trained paragraph classifier, confirmed by comparison with templates.

Every line of a text is a paragraph. Its words and pairs of words that the templates know are a sparse vector; a multinomial
logistic regression gives the probability of each licence family and of UNKNOWN, which is everything else. It is trained on
the driver: on the templates below, whole, cut and worn, and on at most SAMPLE lines of the corpus, chosen by hash, as UNKNOWN,
besides sentences that name licences without granting one. A part of the examples is held back to calibrate the
probabilities by one temperature. A line is reported if a family is more probable than LEAST and if one of the family's
templates confirms it: enough of the template's sentence or of the line is found in the other.
"""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import common

SAMPLE = 3000
LEAST = 0.5  # calibrated probability of a family
CONFIRMED = 0.6  # share of a template's word pairs in the line, or of the line's in the template
UNKNOWN = "unknown"
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
NUMBER = re.compile(r"\d+(?:\.\d+)*")

# Sentences by which licences are granted, as their publishers give them.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Released under the BSD 3-Clause License.", "Licensed under the BSD License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Released under the ISC License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 The Company. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
NO_GRANT = ["He was licensed to drive a truck in the state of Ohio.", "The license plate of the car was not found.", "The Apache helicopter landed on the field.", "A version of the story was released last year.",
            "Students at MIT wrote a general report under the guidance of the department.", "The public library is open to all.", "All seats at the table are reserved.", "The rights of all people must be respected.",
            "The terms of the agreement were published in general form.", "This work was published under the name of the author.", "The software was copied without permission.", "The notice above the door was written in red.",
            "A copy of the report can be obtained free of charge.", "The distribution of source material is limited."]


def words_of(line: str) -> list[str]:
    """The words of a line in lower case, numbers of versions as one word."""
    return [NUMBER.sub("0", w) for w in WORDS.findall(line.lower())]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class Classifier:
    """A sparse multinomial logistic regression with a temperature."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, temperature: float):
        self.index, self.weights, self.temperature = index, weights, temperature
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.strong = self._strong()
        self.numbers = any(NUMBER.search(w) for w in self.strong)
        self.pairs = {f: [(s, set(zip(["^", *s], [*s, "$"]))) for s in map(words_of, texts)] for f, texts in TEMPLATES.items()}

    def _strong(self) -> frozenset[str]:
        """Words of which a line must have one to reach a family.

        What an n-gram can add to a family over UNKNOWN counts for the one of its words that has most on its own. The words
        that add least are weak as long as all of them together do not make up for what a line without any n-gram lacks.
        """
        families = self.weights[:, :-1] - self.weights[:, -1:]
        gain = {g: max(0.0, float(families[i].max())) for g, i in self.index.items()}
        adds: dict[str, float] = {}
        for gram, value in gain.items():
            word = max(gram.split(), key=lambda w: (gain[w], w))
            adds[word] = adds.get(word, 0.0) + value
        room, weak = -float(families[-1].max()), set()
        for word in sorted(adds, key=lambda w: (adds[w], w)):
            room -= adds[word]
            if room < 0:
                break
            weak.add(word)
        return frozenset(adds) - weak

    def may_grant(self, line: str) -> bool:
        """Whether a line in lower case has a strong word at all; without one it is UNKNOWN."""
        return not self.strong.isdisjoint(WORDS.findall(line)) or self.numbers and NUMBER.search(line) is not None

    def logits(self, words: list[str]) -> np.ndarray:
        places = [self.index[g] for g in grams(words) if g in self.index]
        return self.weights[places].sum(0) + self.weights[-1]

    def probabilities(self, words: list[str]) -> np.ndarray:
        scaled = self.logits(words) / self.temperature
        scaled = np.exp(scaled - scaled.max())
        return scaled / scaled.sum()

    def likeness(self, family: str, words: list[str]) -> float:
        """The largest share of word pairs that the line has of one of a family's templates, or that template of the line."""
        own = set(zip(["^", *words], [*words, "$"]))
        best = 0.0
        for _, template in self.pairs[family]:
            both = len(own & template)
            best = max(best, both / len(template), both / len(own) if len(words) >= 4 else 0.0)
        return best

    def judge(self, line: str) -> tuple[str, float, float] | None:
        """Family, probability and likeness to its template of a line that grants a licence; None for any other."""
        words = words_of(line)
        chance = self.probabilities(words)
        at = int(chance.argmax())
        if self.classes[at] == UNKNOWN or chance[at] < LEAST:
            return None
        like = self.likeness(self.classes[at], words)
        return (self.classes[at], float(chance[at]), like) if like >= CONFIRMED else None


def examples(lines: list[str], draw: random.Random) -> list[tuple[list[str], str]]:
    """Labelled lines: templates whole, cut, worn and among other words, and `lines` and NO_GRANT as UNKNOWN."""
    other = [w for line in lines for w in words_of(line)] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    some = lambda n: [draw.choice(other) for _ in range(n)]
    made = []
    for family, texts in sorted(TEMPLATES.items()):
        for words in map(words_of, texts):
            for turn in range(16):
                own = list(words)
                if turn % 4 == 1 and len(own) > 6:
                    own = own[:max(6, int(len(own) * draw.uniform(0.5, 1)))]
                if turn % 4 == 2:
                    own = some(draw.randint(1, 8)) + own
                if turn % 4 == 3:
                    own = [w for w in own if draw.random() > 0.05] + some(draw.randint(1, 6))
                made.append((own, family))
    for line in NO_GRANT:
        made += [(words_of(line), UNKNOWN), (words_of(line) + some(4), UNKNOWN), (some(5) + words_of(line), UNKNOWN)]
    for text in sorted(t for ts in TEMPLATES.values() for t in ts):  # loose words of the templates grant nothing
        words = words_of(text)
        for _ in range(4):
            made.append((draw.sample(words, min(len(words), 3)) + some(6), UNKNOWN))
    known = [grams(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    for line in lines:
        own = grams(words_of(line))
        if own and max(len(own & k) / len(k) for k in known) < 0.5:  # the corpus may hold notices, which are not to be unlearned
            made.append((words_of(line), UNKNOWN))
    return made


def fitted(lines: list[str]) -> Classifier:
    """A classifier from the templates and lines of the corpus."""
    draw = random.Random(11)
    made = examples(lines, draw)
    draw.shuffle(made)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    index = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t))}))}
    rows = np.zeros((len(made), len(index) + 1), np.float32)
    rows[:, -1] = 1
    for at, (words, _) in enumerate(made):
        rows[at, [index[g] for g in grams(words) if g in index]] = 1
    labels = np.array([classes.index(c) for _, c in made])
    held = np.arange(len(made)) % 5 == 0
    weights = np.zeros((len(index) + 1, len(classes)), np.float32)
    goal = np.eye(len(classes), dtype=np.float32)[labels[~held]]
    own, size = rows[~held], np.bincount(labels[~held], minlength=len(classes))
    balance = (1 / np.sqrt(size[labels[~held]]))[:, None].astype(np.float32)
    balance /= balance.mean()
    for epoch in range(EPOCHS):
        for part in np.array_split(np.arange(len(own)), max(1, len(own) // 256)):
            scores = own[part] @ weights
            scores = np.exp(scores - scores.max(1, keepdims=True))
            scores /= scores.sum(1, keepdims=True)
            weights += RATE / (1 + epoch / 20) / len(part) * own[part].T @ ((goal[part] - scores) * balance[part]) - DECAY * weights
    logits, true = rows[held] @ weights, labels[held]

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        scaled -= scaled.max(1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(true)), true]).mean())

    temperature = min((0.25 * 1.25 ** k for k in range(14)), key=loss)
    return Classifier(index, weights, temperature)


def trained(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Classifier:
    """A classifier whose UNKNOWN lines are one line, cut to 2,000 characters, of each of at most `sample` different texts, all chosen by hash."""
    lines, h = F.split("t", "\n"), F.xxhash64("t")
    chosen = common.sampled(docs.select(F.col(f"`{text}`").alias("t")), "t", sample)
    line = F.substring(F.element_at(lines, (F.pmod(h, F.size(lines)) + 1).cast("int")), 1, 2000)
    return fitted(sorted(r["line"] for r in chosen.select(line.alias("line")).collect()))  # at most `sample` lines


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """Every line that grants a licence: doc_id, line (from 0), start and end (code points), family, probability and likeness.

    Null and empty texts have none. Repeated rows give their lines again; a null id is passed on.
    """
    model = model or trained(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.temperature))  # n-grams of the templates

    def scan(batches):
        own = Classifier(*sent.value)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), common.strings(batch)):
                at = 0
                for number, line in enumerate(value.split("\n")):
                    if own.may_grant(line.lower()) and (found := own.judge(line)):
                        rows.append((doc, number, at, at + len(line), *found))
                    at += len(line) + 1
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "line", "start", "end", "family", "probability", "likeness"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(rows, scan, "doc_id long, line long, start long, end long, family string, probability double, likeness double")
