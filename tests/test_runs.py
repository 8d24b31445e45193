"""Conversion, storage, reports and streams end to end on small fixtures."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from vellum import fixed, session
from vellum.operators import blocks as B, convert as U, jobs as J, provenance as V, report as R
from vellum.operators.skew import attach, rank_in_chunks
from vellum.plans import prepare
from vellum.sinks import files as K
from vellum.sources import tables as T, tree
from vellum.streaming import queue as Q


def stub(data, name, options, resources):
    if "boom" in name:
        raise RuntimeError("refusing")
    if "slow" in name:
        time.sleep(30)
    if "dead" in name:
        os._exit(3)
    return {"doc.md": b"# " + data, "provenance.json": b"{}", "images/f.png": b"x"}, {"tool": 1}


def documents(spark, names):
    return spark.createDataFrame([("/i/" + n, n, n.encode(), {"output_dir": "/x", "page_range": "0"}, 2) for n in names],
                                 "path string, name string, content binary, options map<string,string>, timeout bigint")


def test_one_bad_document_is_a_row(spark):
    rows = {r.name: r for r in U.convert_documents(documents(spark, ["a.pdf", "boom.pdf", "../b.txt"]), "s", stub).collect()}
    assert set(rows) == {"a.pdf", "boom.pdf", "b.txt"}
    assert [f.name for f in rows["a.pdf"].files] == ["doc.md", "images/f.png"] and rows["a.pdf"].versions == {"tool": "1"}
    assert (rows["boom.pdf"].ok, rows["boom.pdf"].error) == (False, "RuntimeError: refusing")


def test_deadlines_end_a_document_not_its_batch(spark):
    docs = documents(spark, ["slow.pdf", "dead.pdf", "a.pdf"]).coalesce(1)
    rows = {r.name: r for r in U.convert_documents(docs, "s", stub, deadlines=True).collect()}
    assert rows["slow.pdf"].error.startswith("Timeout") and rows["dead.pdf"].error.startswith("ConverterDied")
    assert rows["a.pdf"].ok and bytes(rows["a.pdf"].files[0].body) == b"# a.pdf"


def test_results_leave_with_their_batch(spark):
    """Short results of a long partition do not gather in Python: a converter never sees more than a few batches of them alive."""
    def counting(data, name, options, resources):
        class Body(bytes):
            def __del__(self):
                resources["alive"] -= 1
        resources["alive"] += 1
        return {"n": Body(str(resources["alive"]).encode())}, {}

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "5")
    try:
        docs = documents(spark, [f"d{i}" for i in range(100)]).coalesce(1)
        alive = [int(bytes(r.files[0].body)) for r in U.convert_documents(docs, "s", counting, lambda: {"alive": 0}).collect()]
    finally:
        spark.conf.set(key, before)
    assert len(alive) == 100 and max(alive) <= 20


def test_files_get_a_folder_of_their_own(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def on_disk(source, out, options, resources):
        with open(seen, "a") as log:
            log.write(source + "\n")
        with open(os.path.join(out, "d.md"), "w") as md:
            md.write(open(source).read().upper())
        return {}
    rows = U.convert_documents(documents(spark, ["a.txt"]), "s", U.on_file(on_disk)).collect()
    assert bytes(rows[0].files[0].body) == b"A.TXT"
    assert not any(os.path.exists(p) for p in open(seen).read().split())


def test_a_loader_that_fails_fails_its_documents(spark):
    def broken():
        raise OSError("no weights")
    for deadlines in (False, True):
        docs = documents(spark, ["a.txt"]).withColumn("timeout", F.lit(20))
        (row,) = U.convert_documents(docs, "s", stub, broken, deadlines=deadlines).collect()
        assert not row.ok and row.error == "OSError: no weights"
    routed = documents(spark, ["a.txt"]).withColumn("backend", F.lit("nobody"))
    (row,) = U.convert_routed(routed, {"s": (stub, None)}).collect()
    assert not row.ok and "nobody" in row.error


def test_resources_belong_to_their_loader(spark):
    def show(data, name, options, resources):
        return {"x.md": resources.encode()}, {}
    for word in ("one", "two"):
        (row,) = U.convert_documents(documents(spark, ["a.txt"]), "s", show, lambda word=word: word).collect()
        assert bytes(row.files[0].body) == word.encode()


def test_records_are_compared_by_entries_and_redacted(spark):
    conversion = {"finished": "2", "started": "1", "output_dir": "/o"}
    def record(path, versions, options):
        return (path, "h", versions, options)
    held = [record("same", {"a": "1"}, {"x_token": "[redacted]"}), record("comma", {"a": "1,b=2"}, {}), record("opt", {}, {"y": "1"})]
    sidecars = spark.createDataFrame([({"path": p, "sha256": h}, conversion, v, o) for p, h, v, o in held],
                                     "source struct<path:string,sha256:string>, conversion struct<finished:string,started:string,output_dir:string>, "
                                     "versions map<string,string>, options map<string,string>")
    wanted = spark.createDataFrame([record("same", {"a": "1"}, {"x_token": "hush"}), record("comma", {"a": "1", "b": "2"}, {}), record("opt", {}, {"y": "2"})],
                                   "path string, sha256 string, versions map<string,string>, options map<string,string>")
    got = {r.path: r.status for r in V.reconvert_diff(wanted, sidecars).collect()}
    assert got == {"same": "unchanged", "comma": "version_changed", "opt": "option_changed"}


def test_trees_are_listed_with_their_hidden_names(spark, tmp_path):
    names = ["in/a.html", "in/_p.jpeg", "in/.h.pdf", "in/md/x.md.provenance.json", "in/md/a.jpeg", "in/sub/provenance.json",
             "in/sub/data.json", "in/converted/z.html", "in/a/b/c/deep.pdf"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    os.symlink(tmp_path / "in", tmp_path / "in" / "loop")
    os.symlink(tmp_path / "in" / "md", tmp_path / "md-link")
    root = str(tmp_path / "in")

    def rel(listed):
        return sorted(os.path.relpath(r.path, root) for r in listed.collect())
    assert rel(tree.scan_corpus(spark, root, fixed.LIGHT_FORMATS, skip=[str(tmp_path / "md-link")])) == [
        ".h.pdf", "_p.jpeg", "a.html", "sub/data.json"]
    assert rel(tree.walk_batch(spark, root, root + "/md")) == [".h.pdf", "_p.jpeg", "a.html", "a/b/c/deep.pdf", "converted/z.html"]
    docs = tree.scan_corpus(spark, root, ["html"]).select("path", "name")
    assert bytes(U.convert_documents(docs, "s", stub).collect()[0].files[0].body) == b"# x"


def test_sidecars_round_trip(spark, tmp_path):
    now = F.timestamp_seconds(F.lit(1000))
    docs = spark.range(1).select(
        F.lit("/in/a/r.pdf").alias("path"), F.sha2(F.lit("x"), 256).alias("sha256"), F.lit(1).alias("bytes"),
        now.alias("modified"), F.lit("marker").alias("backend"), now.alias("started"),
        F.timestamp_millis(F.lit(1001500)).alias("finished"), F.lit(None).cast("string").alias("output_format"),
        F.array(F.lit("m"), F.lit("--api_key"), F.lit("SECRET")).alias("command"), F.lit("/out/r").alias("output_dir"),
        F.array(F.lit("b.md"), F.lit("a.json")).alias("outputs"), F.create_map(F.lit("torch"), F.lit("2")).alias("versions"),
        F.create_map(F.lit("db_password"), F.lit("SECRET")).alias("options"))
    record = V.provenance_record(docs, "/in")
    root = str(tmp_path)
    K.export_files(K.sidecar_rows(record, F.lit("r")), root)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "provenance.json").write_text("{broken")
    text = (tmp_path / "r" / "provenance.json").read_text()
    got = json.loads(text)
    assert text.endswith("}\n") and "SECRET" not in text and list(got) == sorted(got)
    assert got["source"]["relative_path"] == "a/r.pdf" and got["source"]["modified"] == "1970-01-01T00:16:40Z"
    assert got["conversion"]["seconds"] == 1.5 and got["conversion"]["outputs"] == ["a.json", "b.md"]
    assert got["conversion"]["output_format"] == "markdown"
    assert [r.source.path for r in T.read_sidecars(spark, root + "/*/provenance.json").collect()] == ["/in/a/r.pdf"]
    assert os.listdir(tmp_path / "r") == ["provenance.json"]
    with pytest.raises(Exception, match="bare file name"):
        K.sidecar_rows(record, F.lit("r"), F.lit("../x.json")).collect()
    assert abs(K.storage_clock(root).timestamp() - time.time()) < 60 and not any(n.startswith(".clock") for n in os.listdir(root))


def test_sidecars_are_read_by_name(spark, tmp_path):
    """Files are opened by the tasks that hold their names, each once; no folder is listed, so what else is there is not met."""
    def body(path):
        return json.dumps({"schema": "s", "source": {"path": path, "sha256": "x"}, "conversion": {"backend": "b"}}, indent=2)
    for folder, text in (("a", body("/i/ä")), ("b", "{broken"), ("c", body("/i/c"))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "provenance.json").write_text(text)
    names = spark.createDataFrame([("a/provenance.json",), ("a/provenance.json",), ("b/provenance.json",)], "rel string")
    got = T.read_sidecars_by_name(names, str(tmp_path)).select("sidecar", "source.path").collect()
    assert [tuple(r) for r in got] == [("a/provenance.json", "/i/ä")]


def test_copies_of_a_hot_source_are_found_in_parts(spark):
    held = [(f"/o/c{i}", "/in/a.pdf", "marker") for i in range(50)] + [("/o/a", "/in/a.pdf", "marker"),
            ("/o/k1", "/in/a.pdf", "markitdown"), ("/o/k2", "/else/a.pdf", "marker"), ("/o/b", "/in/a.pdf", "marker")]
    own = spark.createDataFrame([("/in/a.pdf", "/o/a"), ("/in/b.pdf", "/o/b")], "source_path string, folder string")
    gone = V.drop_duplicates(spark.createDataFrame(held, "folder string, source_path string, backend string"), own, hot_rows=4)
    assert {r.folder for r in gone.collect()} == {f"/o/c{i}" for i in range(50)}


def test_hot_keys_join_and_rank_exactly(spark):
    facts = spark.range(300).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 11)).alias("k"))
    stats = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(facts, stats, ["k"], "n", "seq", hot_rows=7)
    assert joined.count() == 300 and joined.where("k = 'hot' and n = 100").count() == 100
    ranks = {(r.k, r.seq): r["rank"] for r in rank_in_chunks(facts, ["k"], "seq", "rank", chunk=10).collect()}
    hot = sorted(s for k, s in ranks if k == "hot")
    assert [ranks["hot", s] for s in hot] == list(range(1, 101))


def test_bench_arithmetic(spark):
    runs = [(0, "a.pdf", 5, "text", 2.0, True), (1, "b.docx", None, None, 2.0, True), (2, "c.pdf", 22, "ocr", 2.0, True),
            (3, "d.pdf", 9, "ocr", 9.0, False)]
    frame = spark.createDataFrame(runs, "seq bigint, file string, pages int, path string, seconds double, ok boolean")
    over = R.overhead(spark.createDataFrame([("text", [14.0, 14.0], 2.0), ("ocr", [30.0, 30.0], 2.0), ("x", [1.5, 1.5], 2.0)],
                                            "path string, cold_seconds array<double>, warm_seconds double"))
    costs = {r.path: r for r in over.collect()}
    assert (costs["text"].seconds, costs["ocr"].seconds, costs["x"].seconds) == (12.0, 28.0, None)
    assert "do not measure the overhead" in costs["x"].why
    by = {r.file: r for r in R.resident_saving(R.doc_mean(frame), over).collect()}
    assert (by["a.pdf"].overhead_seconds, by["a.pdf"].speedup, by["a.pdf"].speedup_if_its_tables_are_ocrd) == (12.0, 7.0, 15.0)
    assert (by["c.pdf"].speedup, by["c.pdf"].speedup_if_its_tables_are_ocrd, by["b.docx"].speedup) == (15.0, None, None)
    warm = {r.path: r for r in R.path_summary(frame).collect()}
    assert set(warm) == {"text", "ocr", "unknown"} and warm["ocr"].seconds_per_page == round(2 / 22, 3)
    assert warm["unknown"].pages == 0 and warm["unknown"].seconds_per_page is None
    assert [r.why for r in R.pick_sample(frame.where("seq = 0")).orderBy("path").collect()] == ["no ocr PDF in the set", None]


def test_the_worst_code_wins(spark):
    worst_first = [1, 2, 3, 0]
    runs = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    codes = spark.createDataFrame([(str(run), code) for run in runs for code in run], "run string, code int")
    assert {r.run: r.code for r in R.run_outcome(codes, "run").collect()} == {str(run): min(run, key=worst_first.index) for run in runs}


def test_blocks_keep_the_text(spark):
    html = ("<html><head><script>var t=\"</p>\";</script></head><body><h2>T &lt;1&gt; &#8364;&#x41; &amp;lt; &nosuch; a&b</h2>"
            "<p>one<br>two <b>bold<p>un\n closed<!-- <p>no</p> --><ul><li>i</ul></body>")
    docs = spark.createDataFrame([("x.html", html), ("t.csv", 'a,b\n"x, ""y""",2\n'), ("d.json", '{"k": [1]}')], "name string, text string")
    got = {r.name: r for r in B.with_blocks(docs).select("name", "blocks", B.as_markdown(F.col("blocks")).alias("md")).collect()}
    assert [(b.kind, b.level, b.text) for b in got["x.html"].blocks] == [
        ("heading", 2, "T <1> €A &lt; &nosuch; a&b"), ("paragraph", 0, "one\ntwo bold"), ("paragraph", 0, "un closed"), ("item", 0, "i")]
    assert got["t.csv"].md == '| a | b |\n| --- | --- |\n| x, "y" | 2 |' and got["d.json"].md == '{"k": [1]}'


def test_refused_jobs_stop_no_other(spark, tmp_path):
    jobs = [{"job_id": "ok", "func": "convert_document", "path": "/data/input/b.pdf", "options": "{}"},
            {"job_id": "sys", "func": "os.system", "path": "/data/input/b.pdf", "options": "{}"},
            {"job_id": "cls", "func": "convert_document", "path": "/data/input/b.pdf", "options": '{"processors":"x"}'},
            {"job_id": "etc", "func": "convert_document", "path": "/data/input/../../etc/p", "options": "{}"}]
    folder = tmp_path / "queue"
    folder.mkdir()
    (folder / "j.json").write_text("\n".join(json.dumps({"ts": "2024-01-01T00:00:00Z", **j}) for j in jobs))

    def convert(admitted):
        docs = admitted.select("job_id", "ts", "path", F.lit("b.pdf").alias("name"), F.lit(b"x").alias("content"))
        return U.convert_documents(docs, "s", stub, keep=("job_id", "ts")).select("job_id", "ts", "path", "ok", "error")
    for _ in range(2):      # started again from its checkpoint, the queue has nothing left to do
        Q.run_queue(T.read_jobs(spark, str(folder)), str(tmp_path / "status"), str(tmp_path / "state"), convert).awaitTermination()
    got = {r.job_id: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert got["ok"] == ("finished", None) and len(got) == 4
    assert "os.system" in got["sys"][1] and "processors" in got["cls"][1] and "path outside" in got["etc"][1]


def test_results_vanish_after_their_lifetime(spark):
    rows = [("a", "2024-01-01 00:00:00", 1, "finished"), ("b", "2024-01-02 11:00:00", 2, "failed"), ("c", "2024-01-01 00:00:00", 3, "started")]
    events = spark.createDataFrame(rows, "job_id string, ts string, seq bigint, status string").select(
        "job_id", F.to_timestamp("ts").alias("ts"), "seq", "status", F.lit("/o").alias("result"))
    states = J.latest_status(events)
    live = J.live_results(states, F.to_timestamp(F.lit("2024-01-02 12:00:00")))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "job_id string")
    got = {r.job_id: (r.status, r.error) for r in J.lookup_status(asked, live).collect()}
    assert got == {"a": ("not found", None), "b": ("failed", fixed.CALLER_ERROR), "c": ("started", None), "z": ("not found", None)}


def test_the_shared_folder_is_the_sessions(spark):
    assert session.fresh_folder(spark, "x") != session.fresh_folder(spark, "x")


def test_a_plan_reads_its_manifest_once(spark):
    """Both halves are counted and joined back, but from the short written list, not by listing everything again."""
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    names = ["a.pdf", "a.docx", "A.pdf", "b.html", "a_docx.txt", "c.zip"]
    files = spark.createDataFrame([(f"/in/{d}/{n}", 10 * d + i, 1) for d in range(3) for i, n in enumerate(names)], "path string, input_seq long, pdf_pages long")
    got = prepare.plan_run(files.mapInPandas(counting, files.schema), "/in", "/out").collect()
    assert len(got) == 15 and read.value == 18
