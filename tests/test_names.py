"""Names and paths against tables of expected values."""

import random

import pytest
from pyspark.sql import functions as F

from vellum import fixed
from vellum.functions import paths as P
from vellum.operators import corpus as C, naming as N

# Four levels of folders, each with one file of every kind the filter must tell apart.
LEVELS = ["", "box/", "box/2024/", "box/2024/in tray/", "box/2024/in tray/deep/"]
KEPT = ["ledger.pdf", "Minutes.DOCX", "scan 7.png"]
LEFT_OUT = ["readme.txt", "tune.mp3", "noext", f"{fixed.SIDECAR_NAME}", f"ledger{fixed.SIDECAR_SUFFIX}", "node_modules/lib.pdf", ".git/hook.pdf"]
TREE = [level + name for level in LEVELS for name in KEPT + LEFT_OUT]


def manifest(spark, names, root="/i/"):
    return spark.createDataFrame([(root + n, i) for i, n in enumerate(names)], "path string, input_seq bigint")


def test_extension_and_stem(value):
    names = ["a.pdf", ".hidden", ".a.b", "x.tar.gz", "foo.", "README", "...", "a b.PDF"]
    rows = [(n,) for n in names]
    assert value(rows, "n string", P.ext(F.col("n"))) == [".pdf", "", ".b", ".gz", ".", "", "", ".PDF"]
    assert value(rows, "n string", P.stem(F.col("n"))) == ["a", ".hidden", ".a", "x.tar", "foo", "README", "...", "a b"]


def test_listing_at_every_depth(spark):
    files = manifest(spark, TREE)
    for depth in range(7):
        kept = C.corpus_filter(files, "/i", fixed.HEAVY_FORMATS, depth).collect()
        assert {r.path[3:] for r in kept} == {level + name for level in LEVELS[:max(1, depth)] for name in KEPT}, depth


def test_output_folders_are_one_to_one(value):
    names = [stem + tail for stem in ("memo", "memo_v1", ".memo", "memo.v1") for tail in ("", ".d", "_d", ".odt", "_odt", ".o_dt", ".odt.d")]
    got = value([("/in/" + n,) for n in names], "p string", P.output_folder(F.col("p"), "/out", "/in"))
    assert len(set(got)) == len(names)
    assert dict(zip(names, got))["memo.odt"] == "/out/memo_odt" and dict(zip(names, got))["memo_odt"] == "/out/memo_odt.d"
    nested = value([("/in/q/Z.ODT",), ("/other/z.odt",)], "p string", P.output_folder(F.col("p"), "/out", "/in"))
    assert nested == ["/out/q/Z_odt", "/out/z_odt"]


def test_no_path_leaves_the_output_root(value):
    rows = [("/in/../../secret/z.odt",), ("/in/q/../z.odt",), ("/in/./q//z.odt",), ("/in/../in/z.odt",)]
    assert value(rows, "p string", P.output_folder(F.col("p"), "/out", "/in")) == ["/out/z_odt", "/out/z_odt", "/out/q/z_odt", "/out/z_odt"]
    assert value(rows, "p string", P.relative_to(F.col("p"), "/in/x/..")) == [None, "z.odt", "q/z.odt", "z.odt"]


def test_names_that_differ_in_case_only_meet(value):
    rows = [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("É", "é"), ("a", "b")]
    assert value(rows, "a string, b string", P.name_key(F.col("a")) == P.name_key(F.col("b"))) == [True, True, True, False]


def test_safe_names(value):
    steered = ["/k.odt", "../k.odt", "../../up/k.odt", "c:\\\\share\\k.odt", "in/side/k.odt"]
    rows = [("k.odt",), *((n,) for n in steered), *((n,) for n in ("", " \t", ".", "..", "x/..", "x/", None))]
    assert value(rows, "n string", P.safe_name(F.col("n"))) == ["k.odt"] * 6 + ["document"] * 7


def test_confined_paths(value):
    rows = [("/data/input/a.pdf",), ("/data/input/../../etc/passwd",), ("/data/inputs/a",), ("/data/input",), ("/etc/passwd",)]
    errors = value(rows, "p string", P.confine(F.col("p"), "/data/input", "path").error)
    assert [e is None for e in errors] == [True, False, False, True, False]
    assert "must be under" in errors[1]


def stems(spark, names, root, flat, **kw):
    named = N.output_stems(manifest(spark, names), root, flat, **kw)
    return {r.path[3:]: r.output_name for r in named.collect()}


def test_output_stems(spark):
    assert stems(spark, ["p.odt", "q.csv"], "/i", False) == {"p.odt": "p", "q.csv": "q"}
    assert stems(spark, ["north/plan.csv", "south/plan.csv"], "/i", False) == {
        "north/plan.csv": "north/plan_csv", "south/plan.csv": "south/plan_csv"}
    assert stems(spark, ["Plan.csv", "pLAN.odt"], None, False) == {"Plan.csv": "Plan_csv", "pLAN.odt": "pLAN_odt"}
    assert stems(spark, ["k.odt", "k.csv", "k_odt.txt"], "/i", False) == {"k.odt": "k_odt", "k.csv": "k_csv", "k_odt.txt": "k_odt_txt"}
    assert stems(spark, ["n/K.csv", "s/k.csv", "n_k_csv.odt"], "/i", True) == {"n/K.csv": "n_K_csv", "s/k.csv": "s_k_csv", "n_k_csv.odt": "n_k_csv_odt"}


def test_clashes_refuse_both(spark):
    named = N.output_stems(manifest(spark, ["Plan.CSV", "plan.csv", "z.odt"]), None, True)
    clash = {r.path[3:]: r.clash for r in N.name_clashes(named).collect()}
    assert clash == {"Plan.CSV": True, "plan.csv": True, "z.odt": False}


def test_first_input_keeps_its_output(spark):
    rows = spark.createDataFrame([("/o/SAME.md", 2), ("/o/same.md", 1), ("/o/x.md", 3)], "output string, input_seq bigint")
    assert {r.input_seq: r.written for r in N.written_guard(rows).collect()} == {1: True, 2: False, 3: True}


def test_hot_stems_are_split_without_changing_a_name(spark):
    """Two thirds of all files share one stem: the salted path gives the names the plain one gives."""
    names = [f"d{i % 7}/s{i // 60}/index.{'pdf' if i % 2 else 'html'}" for i in range(200)] + [f"u{i}.pdf" for i in range(100)]
    names = sorted(set(names))
    for root, flat in (("/i", True), (None, False)):
        assert stems(spark, names, root, flat, hot_rows=5) == stems(spark, names, root, flat)


def free_name_model(wanted, existing):
    taken, given = set(existing), {}
    for seq, stem in sorted(wanted):
        name, n = f"{stem}.md", 2
        while name in taken:
            name, n = f"{stem}_{n}.md", n + 1
        taken.add(name)
        given[seq] = name
    return given


def test_free_names(spark):
    rng = random.Random(5)
    wanted = [(i, rng.choice(["a", "b", "a_2", "c"])) for i in range(40)]
    existing = {f"{rng.choice('ab')}{rng.choice(['', '_1', '_2', '_3', '_5', '_02', '_9', '_2_2'])}.md" for _ in range(12)}
    # A name free for one stem may be the numbered name of another (a_2): stems are kept apart here.
    wanted = [(i, s) for i, s in wanted if s != "a_2"]
    frame = spark.createDataFrame([("/o", s, "md", i) for i, s in wanted], "folder string, stem string, extension string, input_seq bigint")
    held = spark.createDataFrame([("/o", n) for n in existing], "folder string, name string")
    for chunk in (3, 1000):
        got = {r.input_seq: r.file_name for r in N.free_names(frame, held, clobber=False, chunk=chunk).collect()}
        assert got == free_name_model(wanted, existing)
    assert {r.file_name for r in N.free_names(frame, held).collect()} == {f"{s}.md" for _, s in wanted}


@pytest.mark.parametrize("seed", range(4))
def test_free_names_across_stems(spark, seed):
    """Stems that are numbered names of other stems: every input gets the name one input after another would."""
    rng = random.Random(seed)
    stems = [["a", "a_2"], ["a", "a_2", "a_3", "a_2_2", "a_1", "b_02"], ["a", "a_2", "a_2_2", "a_2_2_2", "a_5", "_2", ""],
             ["a", "a_2", "a_3", "a_4", "a_7", "a_4_2", "a_4_3", "b", "b_2"]][seed]
    wanted = [(i, rng.choice(stems)) for i in range(30)]
    existing = {f"{s}.md" for s in ["a", "a_3_2", "a_4", "a_2_5", "b"] if rng.random() < 0.4} | ({"a.md"} if seed == 0 else set())
    frame = spark.createDataFrame([("/o", s, "md", i) for i, s in wanted], "folder string, stem string, extension string, input_seq bigint")
    held = spark.createDataFrame([("/o", n) for n in existing], "folder string, name string")
    got = {r.input_seq: r.file_name for r in N.free_names(frame, held, clobber=False, chunk=3 if seed % 2 else 1000).collect()}
    assert got == free_name_model(wanted, existing)


def test_inputs_named_as_files_and_folders(spark):
    files = manifest(spark, ["a.pdf", "n/b.pdf", "n/m/c.pdf", "n/converted/d.pdf", "n/notes.txt", "n/x/y/z/e.pdf"])
    asked = spark.createDataFrame([("/i/n", 0), ("/i/n/notes.txt", 1), ("/i/a.pdf", 2), ("/i/./a.pdf", 3), ("/i/ghost", 4)],
                                  "path string, input_seq bigint")
    got = {(r.path, r.input_seq, r.status) for r in C.resolve_inputs(asked, files, fixed.HEAVY_FORMATS, hot_rows=1).collect()}
    assert got == {("/i/n/b.pdf", 0, "present"), ("/i/n/m/c.pdf", 0, "present"), ("/i/n/notes.txt", 1, "present"),
                   ("/i/a.pdf", 2, "present"), ("/i/ghost", 4, "missing")}
