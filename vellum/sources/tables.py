"""Documents, sidecars and jobs read by explicit schema; nothing is inferred."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators.jobs import JOB_SCHEMA
from vellum.operators.provenance import RECORD_SCHEMA
from vellum.sources.tree import open_store


def read_bytes(table: DataFrame, name: Column, content: Column, path: Column | None = None) -> DataFrame:
    """Documents handed over as bytes and a name, from any table that holds both."""
    return table.select((path if path is not None else name).alias("path"), name.alias("name"),
                        content.cast("binary").alias("content"),
                        F.expr("cast(map() as map<string,string>)").alias("options"))


def valid_sidecars(records: DataFrame) -> DataFrame:
    """Records that name a source and a backend; an unreadable or foreign file is ignored."""
    return records.where(F.col("source.path").isNotNull() & F.col("conversion.backend").isNotNull())


def read_sidecars(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """Sidecar files, one indented JSON object each, with the file they came from."""
    return valid_sidecars(spark.read.schema(RECORD_SCHEMA).json(files, multiLine=True, mode="PERMISSIVE")
                          .withColumn("sidecar", F.col("_metadata.file_path")))


def parse_sidecars(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Sidecars already held as text, one per row."""
    parsed = bodies.withColumn("_r", F.from_json(body, RECORD_SCHEMA, {"mode": "PERMISSIVE"}))
    return valid_sidecars(parsed.select(*[c for c in bodies.columns if c != body], "_r.*"))


def read_sidecars_by_name(files: DataFrame, root: str) -> DataFrame:
    """The sidecars at `files(rel)` below `root`, each opened once by the task that holds its name: no folder is listed."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        for batch in batches:
            bodies = []
            for rel in batch["rel"]:
                with store.open_input_stream(f"{base}/{rel}") as source:
                    bodies.append(source.read().decode())
            yield pd.DataFrame({"sidecar": batch["rel"], "body": bodies})

    return parse_sidecars(files.select("rel").distinct().mapInPandas(read, "sidecar string, body string"))


def read_jobs(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """The queue: a stream of job files, one JSON object per line."""
    reader = spark.readStream.schema(JOB_SCHEMA)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(folder)
