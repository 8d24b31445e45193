"""Provenance rows: what was converted, by which versions and options, and what that makes stale."""

from pyspark.sql import Column, DataFrame, functions as F

from vellum import fixed
from vellum.functions import paths as P, records as R
from vellum.functions.redact import redact_argv, redact_options
from vellum.operators.skew import HOT_ROWS, attach

RECORD_SCHEMA = (
    "schema string, "
    "source struct<path:string,relative_path:string,sha256:string,bytes:bigint,modified:string>, "
    "conversion struct<backend:string,started:string,finished:string,seconds:double,output_format:string,"
    "command:array<string>,output_dir:string,outputs:array<string>>, "
    "versions map<string,string>, options map<string,string>")


def output_names(files: Column) -> Column:
    """A document's own output files from its conversion row: sorted, sidecars and subfolders left out."""
    names = F.transform(files, lambda f: f["name"])
    return F.array_sort(F.filter(names, lambda n: ~P.is_sidecar(n) & ~n.contains("/")))


def outputs_of(output_files: DataFrame) -> DataFrame:
    """Listed `output_files(folder, name)` that are outputs, as rows: a folder may hold any number."""
    return output_files.where(~P.is_sidecar(F.col("name")) & ~F.col("name").contains("/"))


def provenance_record(documents: DataFrame, input_root: str | None = None) -> DataFrame:
    """The nested record of each conversion in RECORD_SCHEMA's shape.

    `documents` has path, sha256, bytes, modified, backend, started, finished,
    output_format, command, output_dir, outputs, versions and options. Every key is there
    whether it applies or not; credentials are hidden here, before anything is stored.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    return documents.select(
        F.lit(fixed.PROVENANCE_SCHEMA).alias("schema"),
        F.struct(
            P.normalise(F.col("path")).alias("path"),
            P.relative_to(P.normalise(F.col("path")), input_root).alias("relative_path"),
            F.col("sha256"),
            F.col("bytes").cast("bigint").alias("bytes"),
            R.utc_iso(F.col("modified")).alias("modified")).alias("source"),
        F.struct(
            F.col("backend"),
            R.utc_iso(F.col("started")).alias("started"),
            R.utc_iso(F.col("finished")).alias("finished"),
            R.seconds_between(F.col("started"), F.col("finished")).alias("seconds"),
            F.coalesce("output_format", F.try_element_at("options", F.lit("output_format")),
                       F.lit("markdown")).alias("output_format"),
            redact_argv(F.col("command")).alias("command"),
            P.normalise(F.col("output_dir")).alias("output_dir"),
            F.array_sort("outputs").alias("outputs")).alias("conversion"),
        F.coalesce("versions", empty).alias("versions"),
        redact_options(F.col("options")).alias("options"))


def latest_sidecars(sidecars: DataFrame, by: Column, *tie: Column) -> DataFrame:
    """The current record per `by`: a rewrite replaces the earlier one, copies merged map-side."""
    row = F.struct(*[F.col(c) for c in sidecars.columns])
    return (sidecars.groupBy(by.alias("_by"))
            .agg(F.max_by(row, F.struct(F.col("conversion.finished"), F.col("conversion.started"), *tie)).alias("_row"))
            .select("_row.*"))


def _entries(name: str) -> Column:
    """A map as sorted entries, which compare; as text, values with separators in them could look alike."""
    return F.array_sort(F.map_entries(F.col(name)))


def reconvert_diff(wanted: DataFrame, sidecars: DataFrame) -> DataFrame:
    """`wanted(path, sha256, versions, options)` against what is recorded: one status per source.

    new, source_changed, version_changed, option_changed, unchanged, or gone. Both sides
    are first brought to one row per source, so the full join has unique keys. Records hold redacted options,
    so those of `wanted` are redacted before they are compared.
    """
    current = latest_sidecars(sidecars, F.col("source.path"), F.col("source.sha256")).select(
        F.col("source.path").alias("path"), F.col("source.sha256").alias("_sha"),
        _entries("versions").alias("_versions"), _entries("options").alias("_options"),
        F.col("conversion.output_dir").alias("output_dir"), F.lit(True).alias("_recorded"))
    now = wanted.select("path", "sha256", _entries("versions").alias("versions"),
                        F.array_sort(F.map_entries(redact_options(F.col("options")))).alias("options"), F.lit(True).alias("_wanted"))
    status = (F.when(F.col("_wanted").isNull(), F.lit("gone"))
              .when(F.col("_recorded").isNull(), F.lit("new"))
              .when(~F.col("sha256").eqNullSafe(F.col("_sha")), F.lit("source_changed"))
              .when(~F.col("versions").eqNullSafe(F.col("_versions")), F.lit("version_changed"))
              .when(~F.col("options").eqNullSafe(F.col("_options")), F.lit("option_changed"))
              .otherwise(F.lit("unchanged")))
    return now.join(current, "path", "full").select("path", status.alias("status"), "output_dir")


def drop_duplicates(sidecars: DataFrame, own: DataFrame, backend: str = fixed.HEAVY,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Output folders to remove: an earlier copy of a source that has its own folder in this run.

    `sidecars(folder, source_path, backend)` lists what is on storage, `own(source_path,
    folder)` the folder this run gave each source. Records of other sources or other
    backends stay, and so does every folder of the run. One source may have any number of
    stale copies, so its copies are counted first and spread over the join.
    """
    copies = sidecars.where(F.col("backend") == backend).select("folder", "source_path")
    mine = own.select("source_path", F.col("folder").alias("kept_as"))
    counted = copies.groupBy("source_path").agg(F.count(F.lit(1)).alias("_copies")).join(mine, "source_path")
    stale = attach(copies, counted, ["source_path"], "_copies", "folder", hot_rows).where(
        F.col("kept_as").isNotNull() & (F.col("folder") != F.col("kept_as")))
    run_folders = own.select("folder").distinct()
    return stale.join(run_folders, "folder", "left_anti").select("folder", "source_path", "kept_as")


def is_fresh(output_files: DataFrame, started: Column) -> DataFrame:
    """Per folder, whether this run wrote anything in it: the newest file against the run's start,
    both by the storage's own clock."""
    return output_files.groupBy("folder").agg(F.max("modified").alias("newest")).withColumn(
        "fresh", F.col("newest") >= started)


def conversion_status(documents: DataFrame, freshness: DataFrame, skip_existing: bool = False) -> DataFrame:
    """Each document's outcome from its output folder: converted, skipped or failed, with a reason."""
    joined = documents.join(freshness.select("folder", "fresh"), "folder", "left")
    stale = F.lit("skipped") if skip_existing else F.lit("failed")
    why_stale = F.lit("already converted") if skip_existing else F.lit("the folder is from an earlier run")
    return joined.select(
        *documents.columns,
        F.when(F.col("fresh").isNull(), F.lit("failed")).when(F.col("fresh"), F.lit("converted"))
        .otherwise(stale).alias("status"),
        F.when(F.col("fresh").isNull(), F.lit("no output folder was written"))
        .when(~F.col("fresh"), why_stale).alias("reason"))
