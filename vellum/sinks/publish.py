"""Files published all together or not at all: the `vellum_files` data source writer.

Tasks write below a staging folder beside the output folder, every attempt into a folder of its own with a list of what it
wrote. The commit is one small file in the staging folder that names the attempts that count; before it is there, nothing of
the job has its name, and an aborted job's staging folder is removed. After it, the files are moved to their names by tasks, an
attempt each. Moving can be repeated at any time: a file that has been moved is not in the staging folder any more. So a job that dies
after its commit is completed by `recover`, which the next export to the same folder calls first.
"""

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from vellum.sources.tree import open_store

SCHEMA = "rel string, body binary"
COMMIT, LIST = "_committed", "_files"


def _staging(base: str) -> str:
    """What the names of all staging folders of an output folder begin with."""
    parent, name = os.path.split(base.rstrip("/"))
    return f"{parent}/.{name}.staging-"


def _put(store, path: str, body: bytes) -> None:
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(body)


def _lines(store, path: str) -> list[str]:
    with store.open_input_stream(path, compression=None) as file:
        return [json.loads(line) for line in file.read().decode().splitlines()]


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = open_store(self.root)
        base, names = base.rstrip("/"), []
        own = f"a-{uuid.uuid4().hex}"
        below = f"{_staging(base)}{self.job}/{own}"
        for batch in iterator:
            for rel, body in zip(batch.column("rel").to_pylist(), batch.column("body")):
                path = os.path.normpath(os.path.join(base, rel))
                if not path.startswith(base + "/"):
                    raise ValueError(f"{rel!r} is outside the output folder")
                names.append(path[len(base) + 1:])
                _put(store, f"{below}/{len(names) - 1}", body.as_buffer().to_pybytes() if body.is_valid else b"")
        if names:
            _put(store, f"{below}/{LIST}", "".join(json.dumps(n) + "\n" for n in names).encode())
        return _Attempt(own, len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = open_store(self.root)
        folder = _staging(base) + self.job
        attempts = "".join(json.dumps(m.folder) + "\n" for m in messages if m is not None and m.files)  # one for each task
        _put(store, f"{folder}/{COMMIT}.part", attempts.encode())
        store.move(f"{folder}/{COMMIT}.part", f"{folder}/{COMMIT}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = open_store(self.root)
        _remove(store, _staging(base) + self.job)


class FilesSink(DataSource):
    """Options: root, and job, the name of the staging folder."""

    @classmethod
    def name(cls):
        return "vellum_files"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["root"], self.options["job"])


def _remove(store, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moves the files of committed attempts to their names; those that are gone have been moved before."""
    for batch in batches:
        made = 0
        for root, folder in zip(batch["root"], batch["folder"]):
            store, base = open_store(root)
            names, folders = _lines(store, f"{folder}/{LIST}"), set()
            for at, rel in enumerate(names):
                target = f"{base.rstrip('/')}/{rel}"
                if os.path.dirname(target) not in folders:
                    folders.add(os.path.dirname(target))
                    store.create_dir(os.path.dirname(target), recursive=True)
                try:
                    store.move(f"{folder}/{at}", target)
                    made += 1
                except FileNotFoundError:
                    continue
        yield pd.DataFrame({"n": [made]})


def _roll_forward(spark: SparkSession, root: str, staging: str) -> None:
    store, _ = open_store(root)
    attempts = [f"{staging}/{a}" for a in _lines(store, f"{staging}/{COMMIT}")]
    if attempts:
        rows = spark.createDataFrame([(root, a) for a in attempts], "root string, folder string").repartition(len(attempts))
        rows.mapInPandas(_moved, "n long").write.format("noop").mode("overwrite").save()
    _remove(store, staging)


def recover(spark: SparkSession, root: str) -> int:
    """Completes the committed exports to `root` that died before all their files had their names; returns how many there were.

    What is left of exports without a commit is removed: tasks that were still running when their job was given up may have written on.
    """
    store, base = open_store(root)
    parent, start = os.path.split(_staging(base))
    left = [e.path for e in store.get_file_info(fs.FileSelector(parent, allow_not_found=True)) if e.base_name.startswith(start)]
    committed = [f for f in left if store.get_file_info(f"{f}/{COMMIT}").type == fs.FileType.File]
    for staging in left:
        if staging in committed:
            _roll_forward(spark, root, staging)
        else:
            _remove(store, staging)
    return len(committed)


def publish_files(files: DataFrame, root: str) -> None:
    """`files(rel, body)` as files below `root`, all of them or none.

    Nothing is visible before all tasks have ended well. A task that runs twice is counted once. Files of equal names are replaced; of rows
    with one name any one stays. A null body is an empty file, a null or outside name an error. One export to a folder at a time.
    """
    spark = files.sparkSession
    spark.dataSource.register(FilesSink)
    recover(spark, root)
    job = uuid.uuid4().hex
    named = F.coalesce("rel", F.raise_error(F.lit("a file has no name")).cast("string"))
    files.select(named.alias("rel"), F.col("body").cast("binary").alias("body")).write.format("vellum_files").option("root", root).option("job", job).mode("append").save()
    _roll_forward(spark, root, _staging(open_store(root)[1]) + job)
