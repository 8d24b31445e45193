import random
import re

import numpy as np
import pytest

from vellum.llm import licences, queries

DOCS = "doc_id long, text string, line string, family int, start string"
FILLER = ["the thing and what for", "A short line of 12 words.", "Nothing here is granted to anyone at all.", "x", "la casa de papel", "Version 2.0 of the plan was late.", "general public house"]


@pytest.fixture(scope="module")
def model():
    draw = random.Random(3)
    return licences.fitted([" ".join(draw.choice(FILLER).split()[:draw.randint(1, 9)]) for _ in range(300)])


def test_templates_are_found_whole_and_worn(model):
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            for line in (text, text.upper(), f"  {text}  ", text.replace("2020", "1999")):
                assert model.judge(line)[0] == family, line


@pytest.mark.parametrize("line", ["", "the", "Apache", "public license", *FILLER, *licences.NO_GRANT, "rights", "GNU is not unix", "software " * 500])
def test_other_lines_are_unknown(model, line):
    assert model.judge(line) is None


def test_probabilities_are_calibrated(model):
    made = licences.examples(FILLER * 20, random.Random(77))
    chances = [model.probabilities(words) for words, _ in made]
    right = np.array([model.classes[int(c.argmax())] == label for c, (_, label) in zip(chances, made)])
    sure = np.array([c.max() for c in chances])
    assert right.mean() > 0.93
    assert abs(right.mean() - sure.mean()) < 0.06


def test_lines_without_a_strong_word_are_unknown(model):
    draw = random.Random(5)
    weak = sorted({w for g in model.index for w in g.split()} - model.strong)
    assert weak and model.strong
    for _ in range(500):
        words = [draw.choice(weak) for _ in range(draw.randint(0, 40))]
        assert model.classes[int(model.probabilities(words).argmax())] == licences.UNKNOWN


def test_rows(spark, model):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [notice, f"é\n{notice}\n\nAll rights reserved.", None, "", "\n\n", "words " * 200_000, f"{notice}\r\n{notice}", notice]
    rows = [(i, t, "l", 1, "s") for i, t in enumerate(texts)] + [(None, notice, None, None, None), (0, notice, "l", 1, "s")]
    got = licences.scanned(spark.createDataFrame(rows, DOCS), model=model).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["line"], r["family"]) for r in got)
    assert found == [(-1, 0, "apache"), (0, 0, "apache"), (0, 0, "apache"), (1, 1, "apache"), (1, 3, "proprietary"), (6, 0, "apache"), (6, 1, "apache"), (7, 0, "apache")]
    for r in got:
        if r["doc_id"] is not None:
            assert "\n" not in texts[r["doc_id"]][r["start"]:r["end"]] and model.judge(texts[r["doc_id"]][r["start"]:r["end"]])[0] == r["family"]
    assert licences.scanned(spark.createDataFrame([], DOCS)).count() == 0


def test_notices_of_the_documents(spark):
    folder = "/root/testdata/sf0.01"
    patterns = {"apache": "Licensed under the Apache", "mit": "Released under the MIT", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    want = {(r["doc_id"], n, f) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
            for n, line in enumerate((r["text"] or "").split("\n")) for f, p in patterns.items() if re.search(p, line)}
    assert {(r["doc_id"], r["line"], r["family"]) for r in queries.QUERIES["op7_licence_notices"](spark, folder).collect()} == want
