"""Files published all together, or not at all."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vellum.sinks import publish as K

FILES = "rel string, body binary, other int"


def seen(root):
    return {os.path.relpath(os.path.join(folder, n), root): open(os.path.join(folder, n), "rb").read() for folder, _, names in os.walk(root) for n in names}


def test_all_files_get_their_names(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"d{i % 7}/_f{i}.md", f"text {i}".encode(), 1) for i in range(200)] + [(".hidden", None, 1), ("a/../b", b"x", 1)]
    K.publish_files(spark.createDataFrame(rows, FILES).repartition(5), root)
    assert seen(root) == {os.path.normpath(r): b or b"" for r, b, _ in rows}
    K.publish_files(spark.createDataFrame([("b", b"new", 1)], FILES), root)
    K.publish_files(spark.createDataFrame([], FILES), root)
    assert seen(root)["b"] == b"new" and len(seen(root)) == 202
    assert os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("bad", ["../up", None, "/etc/x"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    root = str(tmp_path / "out")
    frame = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 97, F.lit(bad)).otherwise(F.concat(F.lit("f"), "id")).alias("rel"), F.lit("x").alias("body"))
    with pytest.raises(Exception):
        K.publish_files(frame, root)
    assert not os.path.exists(root)
    time.sleep(1)  # tasks that were running when the job was given up
    assert K.recover(spark, root) == 0 and os.listdir(tmp_path) == []


def test_what_was_committed_is_completed_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    with monkeypatch.context() as broken:
        broken.setattr(K, "_roll_forward", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            K.publish_files(spark.createDataFrame([(f"f{i}", b"1", 1) for i in range(40)], FILES).repartition(4), root)
    assert not os.path.exists(root)
    staging = str(tmp_path / [n for n in os.listdir(tmp_path)][0])
    attempt = [n for n in os.listdir(staging) if n.startswith("a-")][0]
    os.makedirs(root)  # one file had been moved, and a second attempt of a task had not been counted
    names = K._lines(K.open_store(root)[0], f"{staging}/{attempt}/{K.LIST}")
    os.rename(f"{staging}/{attempt}/0", f"{root}/{names[0]}")
    os.makedirs(f"{staging}/a-lost")
    open(f"{staging}/a-lost/0", "w").write("twice")
    assert K.recover(spark, root) == 1
    assert seen(root) == {f"f{i}": b"1" for i in range(40)} and os.listdir(tmp_path) == ["out"]
    assert K.recover(spark, root) == 0


def test_an_attempt_that_is_not_committed_stays_unseen(spark, tmp_path):
    root = str(tmp_path / "out")
    writer = K._Writer(root, "job")
    batch = spark.createDataFrame([("f", b"1", 1)], FILES).select("rel", "body").toArrow().to_batches()
    first, again = writer.write(iter(batch)), writer.write(iter(batch))
    assert first.folder != again.folder and not os.path.exists(root)
    writer.commit([again, None])
    assert K.recover(spark, root) == 1 and seen(root) == {"f": b"1"}
