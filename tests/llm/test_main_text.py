import html
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import common, main_text, queries

PAGES = "page_id long, url string, html string, text string, h int, n_chars int"
PAGE = """<!DOCTYPE html><html><head><title>no <b>title</b></title><script>if (a < b) x("<p>no</p>");</script></head><body>
<header class="top"><a href="/">no home</a></header><nav><ul><li><a>no menu</a><li><a>no other</a></ul></nav>
<article><h1>Yes &amp; head</h1><p>Yes <b>bo</b>ld&nbsp;text<br>new
 line<p title="a > b">second &eacute; block <!-- no <p>comment</p> --><form><label>no name</label></form>
<div class="ad banner">no advert words here</div><p>yes last 3 &lt; 4</article>
<aside><p>no aside words</p></aside><div id="comments"><p>no reader comment</p></div><footer><p>no footer &copy;</p></footer></body></html>"""
WANT = "Yes & head Yes bold text new line second é block yes last 3 < 4"


@pytest.mark.parametrize("labelled", [False, True])
def test_parts_of_a_page(spark, labelled):
    counts = {}
    for (kind, place, inside), n in (main_text.label_counts(PAGE) if labelled else {}).items():
        counts.setdefault((kind, place), [0, 0])[inside] += n
    assert main_text.main_text(PAGE, main_text.Weights(counts)) == WANT


def test_rows(spark):
    pages = [PAGE, None, "", "<", "<p", "a < b <p>words that stand alone</p", '<p class="open>quote <p>more', "<script>never closed", "plain words only",
             "<p>" + "long words " * 200_000 + "</p>", "<" * 2000, "<p a='" * 500 + "x", "<!-- open", "&amp;&#x41;&bogus;", "<div>" * 3000 + "deep"]
    rows = [(i, "u", p, "t", 1, 2) for i, p in enumerate(pages)] + [(None, None, PAGE, None, None, None), (0, "u", PAGE, "t", 1, 2)]
    got = main_text.extracted(spark.createDataFrame(rows, PAGES), ["page_id", "url", "h"]).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "h", "text", "n_chars"}
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[0] == WANT and texts[None] == WANT and texts[1] == texts[2] == texts[7] == texts[12] == ""
    assert texts[8] == "plain words only" and texts[9] == " ".join(["long words"] * 200_000) and texts[13] == "&A&bogus;"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text.extracted(spark.createDataFrame([], PAGES), ["page_id"]).count() == 0


@pytest.mark.parametrize("scores,region", [([], (0, 0)), ([-1.0], (0, 0)), ([1, -2, 3, -1, 2, -9, 3], (2, 5)), ([2, -2, 2], (0, 1)), ([1, 1], (0, 2))])
def test_best_region(scores, region):
    assert main_text.best_region(scores) == region


def test_labelled_pages_give_their_articles_back(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.QUERIES["op8_maximum_scoring_text"](spark, folder).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S).group(1)
        article = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))
        assert r["text"] == " ".join(html.unescape(article).split())


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_samples_are_the_different_values_with_the_smallest_hashes(spark, most):
    values = [f"v{i}" for i in range(300)] + ["hot"] * 500 + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    hashes = {r["v"]: r["h"] for r in rows.select("v", F.xxhash64("v").alias("h")).collect() if r["v"]}
    assert sorted(r["v"] for r in common.sampled(rows, "v", most).collect()) == sorted(sorted(hashes, key=hashes.get)[:most])
    assert common.sampled(rows.where("v is null"), "v", most).count() == 0
