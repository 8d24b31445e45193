"""Totals of nested folders against a plain walk."""

import posixpath
import random

from vellum.operators import report as R


def totals(spark, files, root):
    rows = R.folder_totals(spark.createDataFrame([(p, n, "x", 1) for p, n in files], "path string, length long, folder string, files int"), root).collect()
    assert len(rows) == len({r["folder"] for r in rows})
    return {r["folder"]: (r["own_files"], r["files"], r["bytes"], r["size"]) for r in rows}


def test_every_folder_has_what_is_below_it(spark):
    draw = random.Random(4)
    files = [("/data/in/" + "/".join(draw.choice(["a", "b", "c d", "_"]) for _ in range(draw.randint(0, 5))) + f"//f{i}", draw.choice([0, 7, None, 5000])) for i in range(400)]
    files += [("/data/input/x", 9), ("/data/in", 9), (None, 9), ("/data/in/../in/y", 3)] + files[:30]
    want = {}
    for path, length in files:
        path = path and posixpath.normpath(path)
        if path and path.startswith("/data/in/"):
            folder = own = posixpath.dirname(path)
            while folder.startswith("/data/in"):
                before = want.get(folder, (0, 0, 0))
                want[folder] = (before[0] + (folder == own), before[1] + 1, before[2] + (length or 0))
                folder = posixpath.dirname(folder)
    found = totals(spark, files, "/data/in")
    assert {f: v[:3] for f, v in found.items()} == want
    assert totals(spark, files, "/data/in/")["/data/in"] == found["/data/in"]


def test_root_sizes_and_an_empty_table(spark):
    assert totals(spark, [("/a/b", 1536), ("/c", 1)], "/") == {"/": (1, 2, 1537, "1.5K"), "/a": (1, 1, 1536, "1.5K")}
    assert totals(spark, [("/d/x", 1 << 41), ("/d/e/y", 1023)], "/d")["/d/e"] == (1, 1, 1023, "1023B")
    assert totals(spark, [], "/d") == {}
