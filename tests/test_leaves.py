"""Leaves of JSON and XML against plain walks with the standard library."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from vellum.operators import leaves as L


def read(spark, texts, reader):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", reader(F.col("t")).alias("r"))
    return [([tuple(leaf) for leaf in r["r"]["leaves"]], r["r"]["error"]) for r in frame.orderBy("i").collect()]


def walk(value, path="$", level=0):
    if isinstance(value, dict) and value:
        for key in sorted(value, key=lambda k: k.encode()):
            name = key if key and key.replace("_", "a").isalnum() and key.isascii() else '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
            yield from walk(value[key], f"{path}.{name}", level + 1)
    elif isinstance(value, list) and value:
        for at, item in enumerate(value):
            yield from walk(item, f"{path}[{at}]", level + 1)
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
        yield path, level, kind, value if isinstance(value, str) else json.dumps(value)


def grown(draw, depth):
    k = draw.randrange(8)
    if depth and k < 3:
        return {draw.choice(["a", "b c", "d.e", "f_1", 'q"', "é", ""]) + str(draw.randrange(3)): grown(draw, depth - 1) for _ in range(draw.randrange(4))}
    if depth and k < 5:
        return [grown(draw, depth - 1) for _ in range(draw.randrange(4))]
    return draw.choice([None, True, False, 0, -17, 12345678901, "text [1, {", 'say "x"', "", "a\nb é😀", "{}"])


def test_json_of_any_shape(spark):
    draw = random.Random(1)
    values = [grown(draw, 6) for _ in range(150)] + [1, "x", None, [], {}, [[[[[[[[[[[["deep"]]]]]]]]]]]]]
    for value, (found, error) in zip(values, read(spark, [json.dumps(v, ensure_ascii=draw.random() < 0.5) for v in values], L.json_leaves)):
        assert error is None and found == list(walk(value)), value


def test_json_with_errors_and_nulls(spark):
    bad = ["", "{", '{"a": 1,}', "[1", "nope", '{"a": 1, "a": 2}', '"open', "1 2", "1, 2", "1] [2", "[1]]", '{"a": 1} x', "}{"]
    assert read(spark, bad, L.json_leaves) == [([], "not well-formed JSON")] * len(bad)
    assert read(spark, [None], L.json_leaves) == [([], None)]


def test_json_of_a_long_text(spark):
    value = {"rows": [{"id": i, "note": "a \\ \"b\"\n" * 200} for i in range(3000)]}
    (found, error), = read(spark, [json.dumps(value)], L.json_leaves)
    assert error is None and found == list(walk(value))


def walk_xml(node, path="", level=1):
    path = f"{path}/{node.tag}"
    for name, value in node.attrib.items():
        yield f"{path}/@{name}", level, "attribute", value
    if (node.text or "").strip():
        yield path, level, "text", node.text.strip()
    elif not len(node) and not node.attrib:
        yield path, level, "empty", ""
    for child in node:
        yield from walk_xml(child, path, level + 1)
        if (child.tail or "").strip():
            yield path, level, "text", child.tail.strip()


def element(draw, depth):
    name = draw.choice(["a", "b", "ns-c", "d_1"])
    attributes = "".join(f" {n}={q}{v}{q}" for n, q, v in [("x", '"', "1 &gt; 0"), ("y", "'", 'a "b" > c'), ("z", '"', "it's")] if draw.random() < 0.3)
    if draw.random() < 0.2:
        return f"<{name}{attributes}/>"
    inside = "".join(draw.choice(["text", " ", "&amp; &#233;", "\n  "]) if draw.random() < 0.4 else element(draw, depth - 1) for _ in range(draw.randrange(5))) if depth else "end"
    return f"<{name}{attributes}>{inside}</{name}>"


def test_xml_of_any_shape(spark):
    draw = random.Random(2)
    texts = [element(draw, 4) for _ in range(120)] + ["<?xml version='1.0'?>\n<!DOCTYPE r>\n<r>" + "".join(f"<i n='{k}'>v{k}</i>" for k in range(900)) + "</r>\n"]
    for text, (found, error) in zip(texts, read(spark, texts, L.xml_leaves)):
        assert error is None and found == list(walk_xml(ET.fromstring(text))), text


def test_xml_parts_that_are_left_out_or_kept_whole(spark):
    text = "<!-- <no> --><r><![CDATA[a < b & ]] c]]><!-- x > y --><e></e><f> </f><?pi <z> ?></r>"
    assert read(spark, [text], L.xml_leaves) == [([("/r", 1, "text", "a < b & ]] c"), ("/r/e", 2, "empty", ""), ("/r/f", 2, "empty", "")], None)]


@pytest.mark.parametrize("bad", ["", "text", "<a>", "</a>", "<a></b>", "<a><b></a></b>", "<a/><b/>", "<a/>tail", "<a b=1/>", "<a b='1/>", "<a>1 < 2</a>", "<a><!-- open </a>", "<a b></a>", "<a></a b>"])
def test_xml_errors(spark, bad):
    assert read(spark, [bad], L.xml_leaves) == [([], "not well-formed XML")]


def test_rows_of_mixed_documents(spark):
    docs = spark.createDataFrame([("a.json", '{"k": [1]}', 1), ("b.xml", "<r>t</r>", 2), ("c.json", "{", 3), ("d.txt", "t", 4), ("e.XML", None, 5)], "name string, text string, path int")
    rows = L.as_leaf_rows(L.with_leaves(docs), "name").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("a.json", 0, "$.k[0]", 2, "number", "1", None), ("b.xml", 0, "/r", 1, "text", "t", None),
                                        ("c.json", None, None, None, None, None, "not well-formed JSON"), ("d.txt", None, None, None, None, None, "no reader for leaves of: txt")]
    assert L.as_leaf_rows(L.with_leaves(docs.limit(0)), "name").count() == 0


def test_documents_of_one_task_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, "a.xml", f"<r>{i}</r>") for i in range(100)], "id int, name string, text string").coalesce(1)
    read = L.with_leaves(docs)
    assert read.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted((r.id, r.text) for r in L.as_leaf_rows(read, "id").collect()) == [(i, str(i)) for i in range(100)]
