"""Conditions that reach the listing: the same rows, fewer folders."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from vellum.sources import tree


@pytest.fixture()
def root(tmp_path):
    for a in range(6):
        for b in range(5):
            os.makedirs(tmp_path / f"a{a}" / f"b{b}" / "c")
            for n in range(3):
                (tmp_path / f"a{a}" / f"b{b}" / "c" / f"f{n}.html").write_bytes(b"x" * (a + n))
        (tmp_path / f"a{a}" / "top.html").write_bytes(b"")
    return str(tmp_path)


def rows(frame):
    return sorted((r["path"], r["name"], r["length"]) for r in frame.collect())


def test_the_same_rows_as_a_filter_after_the_listing(spark, root):
    listed = tree.walk_batch(spark, root, root + "/none")
    everything = rows(listed)
    assert len(everything) == 96
    path, name, length = F.col("path"), F.col("name"), F.col("length")
    for condition, want in [
            (path.startswith(f"{root}/a3/b1"), lambda p, n, s: p.startswith(f"{root}/a3/b1")),
            (path.startswith(f"{root}/a") & (name == "f1.html") & (length >= 3), lambda p, n, s: n == "f1.html" and s >= 3),
            (path.isin(f"{root}/a0/top.html", f"{root}/a5/b4/c/f2.html", f"{root}/no"), lambda p, n, s: p in (f"{root}/a0/top.html", f"{root}/a5/b4/c/f2.html")),
            (path == f"{root}/a2/b2/c/f0.html", lambda p, n, s: p == f"{root}/a2/b2/c/f0.html"),
            (name.endswith("p.html") | (length > 6), lambda p, n, s: n.endswith("p.html") or s > 6),
            (path.contains("/b2/") & (length < 4) & (length > 1), lambda p, n, s: "/b2/" in p and 1 < s < 4),
            (path.startswith(f"{root}x"), lambda p, n, s: False)]:
        assert rows(listed.where(condition)) == [r for r in everything if want(*r)]
        assert rows(listed) == everything  # no query has the conditions of one before it


def test_filters_are_in_the_plan(spark, root):
    plan = tree.walk_batch(spark, root, root + "/none").where(F.col("path").startswith(f"{root}/a3"))._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0]


def listings(root, monkeypatch, *filters):
    entered = []
    keep = tree._Tree.list
    with monkeypatch.context() as patched:
        patched.setattr(tree._Tree, "list", lambda self, folder, level: (entered.append(folder), keep(self, folder, level))[1])
        patched.setattr(tree, "_CUT_FOLDERS", 4)
        reader = tree._Reader({"root": root, "clutter": "false", "skip": "[]"})
        left = reader.pushFilters(list(filters))
        found = sorted(r["path"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist())
    return set(entered), found, left


def test_fewer_folders_are_listed(root, monkeypatch):
    every, found, left = listings(root, monkeypatch)
    assert len(every) == 67 and len(found) == 96
    some, found, left = listings(root, monkeypatch, StringStartsWith(("path",), f"{root}/a3/b1"), Not(EqualTo(("name",), "x")))
    assert len(some) == 4 and len(found) == 3 and left == [Not(EqualTo(("name",), "x"))]
    some, found, left = listings(root, monkeypatch, In(("path",), (f"{root}/a0/top.html", None)))
    assert some == {root, f"{root}/a0"} and len(found) == 1 and not left
