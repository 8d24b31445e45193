"""Links resolved by doubling against a plain walk."""

import posixpath
import random

from vellum import session
from vellum.operators import links as L

LINKS, PATHS = "path string, target string, real string", "path string, n int, loop string, error int"


def walk(path, links, open_=(), most=4000):
    """The real path, or None in a loop: element by element, every link's whole target before what follows it."""
    at, rest = "", [p for p in path.split("/") if p not in ("", ".")]
    while rest:
        part, rest = rest[0], rest[1:]
        if part == "..":
            at = posixpath.dirname(at) if at.count("/") > 1 else ""
            continue
        at = f"{at}/{part}"
        if at in links:
            if at in open_:
                return None
            target = links[at]
            at = walk(target if target.startswith("/") else posixpath.dirname(at) + "/" + target, links, (*open_, at))
            if at is None:
                return None
            at = at.rstrip("/")
    return at or "/"


def resolved(spark, links):
    rows = L.resolve_links(spark.createDataFrame([(p, t, "x") for p, t in links], LINKS)).collect()
    return {r["path"]: None if r["loop"] else r["real"] for r in rows}


def test_chains_of_every_length_and_loops(spark):
    links = {f"/d/c{i}": f"c{i - 1}" if i % 2 else f"../d/./c{i - 1}" for i in range(1, 70)}
    links |= {"/d/x": "y/1", "/d/y": "/e/z", "/e/z": "../d/c9", "/l/a": "b", "/l/b": "c", "/l/c": "a", "/l/in": "c/x", "/l/own": "own", "/l/deep": "deep/x",
              "/m/r": "/n", "/m/t": "r/s", "/n/s": "/m/t", "/o/up": "..", "/o/top": "/", "/o/root": "../../../..", "/p/dir": "/q", "/q/sub": "/r/s", "/p/both": "dir/sub/../end"}
    found = resolved(spark, [*links.items(), ("/d/x", "y/1"), ("/d/c1", "c0"), (None, "x"), ("/z", None)])
    assert found == {p: walk(p, links) for p in links}
    assert found["/d/c69"] == "/d/c0" and found["/l/deep"] is None and found["/m/t"] is None and found["/p/both"] == "/r/end"


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    made = []
    keep = session.written
    monkeypatch.setattr(session, "written", lambda frame, name: (made.append(name), keep(frame, name))[1])

    def rounds(n):
        made.clear()
        assert set(resolved(spark, [(f"/d/c{i}", f"c{i - 1}") for i in range(1, n + 1)]).values()) == {"/d/c0"}
        return made.count("ahead")
    assert rounds(8) <= 4 and rounds(256) <= 9


def test_random_links_and_paths(spark):
    draw = random.Random(8)
    for _ in range(3):
        names = ["a", "b", "c", "d"]
        some = lambda n: "/".join(draw.choice([*names, ".."]) for _ in range(draw.randint(1, n)))
        folders = [f"/{a}" for a in names] + [f"/{a}/{b}" for a in names for b in names]
        links = {}
        for folder in draw.sample(folders, 7):  # links lie in real folders
            if posixpath.dirname(folder) not in links:
                links[folder] = draw.choice(["", "/"]) + some(3)
        links = {p: t for p, t in links.items() if posixpath.dirname(p) not in links}
        paths = [("/" + some(5), i) for i in range(60)] + [(None, 99)]
        final = L.resolve_links(spark.createDataFrame([(p, t, "x") for p, t in links.items()], LINKS))
        rows = L.real_paths(spark.createDataFrame([(p, n, "x", 1) for p, n in paths], PATHS), final).collect()
        assert {r["n"]: (None if r["loop"] else r["real"]) for r in rows} == {n: p and walk(p, links) for p, n in paths}, links
        assert len(rows) == 61 and "error" in rows[0]


def test_confined(spark):
    links = spark.createDataFrame([("/data/in", "store/in", ""), ("/data/store/in/out", "/etc", ""), ("/data/store/in/far", "x/../../../../../etc", ""), ("/data/store/in/l", "l", ""),
                                   ("/data/store/in/back", "../in/real", "")], LINKS)
    paths = ["/data/in/a.pdf", "/data/in/out/passwd", "/data/in/l/a", "/data/in/back/b.pdf", "/data/in/far", "/data/in/../other/x", None, "/data/in/back/../../in/c"]
    rows = L.confine_resolved(spark.createDataFrame([(p, i, "", 0) for i, p in enumerate(paths)], PATHS), links, "/data/in", "path").orderBy("n").collect()
    refused = "path must be under /data/in"
    assert [(r["real"], r["error"]) for r in rows] == [
        ("/data/store/in/a.pdf", None), ("/etc/passwd", refused), (None, "path leads into a loop of links"), ("/data/store/in/real/b.pdf", None),
        ("/etc", refused), ("/data/store/other/x", refused), (None, refused), ("/data/store/in/c", None)]


def test_without_links_and_without_paths(spark):
    none = spark.createDataFrame([], LINKS)
    paths = spark.createDataFrame([("/a/../b", 1, "", 0), ("/a/../b", 1, "", 0)], PATHS)
    assert [(r["real"], r["error"]) for r in L.confine_resolved(paths, none, "/b", "path").collect()] == [("/b", None)] * 2
    assert L.confine_resolved(paths.limit(0), none, "/b", "path").count() == 0


def test_links_are_never_broadcast(spark):
    """A table of names is small on disk and large in memory: looking links up merges, whatever Spark takes its size to be."""
    facts = spark.createDataFrame([("a", "/x"), ("b", "/y"), ("c", None)], "id string, at string")
    found = L._look_up(facts, "at", spark.createDataFrame([("/x", 1)], "key string, real int"), "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the links' own join is in the plan twice; only hot keys (bounded, see skew) are broadcast
    assert plan.count("strategy=merge") == 3 and plan.count("strategy=broadcast") == 1
    assert sorted(map(tuple, found.select("id", "at", "real").collect())) == [("a", "/x", 1), ("b", "/y", None), ("c", None, None)]
