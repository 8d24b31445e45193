"""Results as tables, and as files where a reader needs files."""

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum import fixed
from vellum.sources.tree import open_store


def _publish(store, path: str, body: bytes) -> None:
    """Written under a name of its own and then renamed: a reader never meets half a file."""
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(body)
    store.move(part, path)


def export_files(files: DataFrame, root: str) -> None:
    """`files(rel, body)` as files below `root`, written by the tasks that hold them.

    A task that runs twice writes the same bytes under the same names.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        for batch in batches:
            for rel, body in zip(batch["rel"], batch["body"]):
                path = os.path.normpath(os.path.join(base, rel))
                if not path.startswith(base.rstrip("/") + "/"):
                    raise ValueError(f"{rel!r} is outside the output folder")
                _publish(store, path, bytes(body))
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("rel", F.col("body").cast("binary").alias("body")).mapInPandas(put, "n bigint").write.format(
        "noop").mode("overwrite").save()


def write_outputs(converted: DataFrame, names: DataFrame, folder: str) -> None:
    """A run's outputs as two tables: bodies by input path, and the output name of each path.

    Bodies are written where they were converted. Only paths and names were ever grouped or
    joined, so the corpus itself is not shuffled to give each document its own name.
    """
    converted.where("ok").select("path", F.explode("files").alias("_f")).select(
        "path", F.col("_f.name").alias("name"), F.col("_f.body").alias("body")).write.mode("overwrite").parquet(
        f"{folder}/files")
    names.select("path", "output_name").write.mode("overwrite").parquet(f"{folder}/names")


def read_outputs(spark: SparkSession, folder: str, layout: str = "folder") -> DataFrame:
    """(path, rel, body) of every output file. `folder` gives each document its own folder;
    `shared` puts its one text file at `<output_name>.md` beside the others."""
    files = spark.read.schema("path string, name string, body binary").parquet(f"{folder}/files")
    names = spark.read.schema("path string, output_name string").parquet(f"{folder}/names")
    rel = (F.concat("output_name", F.lit("/"), "name") if layout == "folder"
           else F.concat("output_name", F.lit(".md")))
    return files.join(names, "path").select("path", rel.alias("rel"), "body")


def sidecar_rows(records: DataFrame, folder, name=None) -> DataFrame:
    """Provenance records as sidecar files: bare names only, sorted keys, a newline at the end.

    Keys sort in Python, in the tasks: the record is small and JSON key order is its
    only business there.
    """
    name = F.lit(fixed.SIDECAR_NAME) if name is None else name
    bad = name.contains("/") | name.isin("", ".", "..")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("provenance name must be a bare file name, got "), name))
                     .cast("string")).otherwise(name)
    keep_null = {"ignoreNullFields": "false"}
    rows = records.select(
        F.concat_ws("/", folder, checked).alias("rel"),
        F.to_json(F.struct("schema", "source", "conversion", "versions", "options"), keep_null).alias("body"))

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["body"] = [json.dumps(json.loads(b), indent=2, sort_keys=True) + "\n" for b in batch["body"]]
            yield batch

    return rows.mapInPandas(tidy, "rel string, body string")


def write_provenance(records: DataFrame, table: str) -> None:
    """Records appended to the provenance table; the commit is atomic."""
    records.write.mode("append").parquet(table)


def write_report(report: DataFrame, folder: str) -> None:
    """Report rows as text, one JSON object per line."""
    report.select(F.col(report.columns[0]).alias("value")).write.mode("overwrite").text(folder)


def storage_clock(folder: str):
    """The time by the clock of the storage `folder` is on: the age of a file written there now."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    probe = f"{path.rstrip('/')}/.clock.{uuid.uuid4().hex}"
    with store.open_output_stream(probe) as out:
        out.write(b"")
    try:
        return store.get_file_info(probe).mtime.replace(microsecond=0)
    finally:
        store.delete_file(probe)


