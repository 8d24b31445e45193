"""A whole run: what would be converted and where to, and then converting it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from vellum import fixed, session
from vellum.functions import paths as P, records as R
from vellum.operators import convert as U, corpus as C, facts, naming as N, provenance as V
from vellum.operators.skew import HOT_ROWS


def in_scope(files: DataFrame, root: str, output_dir: str, depth: int | None = fixed.DEFAULT_DEPTH) -> DataFrame:
    """What a run over `root` covers: both converters' formats, no clutter, no sidecars, not its own output."""
    formats = sorted(set(fixed.HEAVY_FORMATS) | set(fixed.LIGHT_FORMATS))
    return C.corpus_filter(files, root, formats, depth, skip=[output_dir])


def plan_run(manifest: DataFrame, root: str, output_dir: str, depth: int | None = fixed.DEFAULT_DEPTH,
             input_root: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each file of `manifest(path, input_seq, pdf_pages)` to be converted: by which converter, to
    which output name, for how long, or why it is refused.

    A PDF or image goes to the heavy converter, anything else to the light one, and names
    are decided per half: one writes `<name>/`, the other `<name>.md`. `input_root` is empty
    here as it is when a folder was expanded before it was routed.
    """
    listed = in_scope(manifest, root, output_dir, depth)
    name = P.basename(F.col("path"))
    # Both halves are counted and joined back, so what is listed is read several times: paths only, written once.
    routed = session.written(listed.select(
        "path", "input_seq", C.route(name).alias("backend"),
        facts.page_count(name, F.col("pdf_pages")).alias("pages")), "routed")
    heavy = routed.where(F.col("backend") == fixed.HEAVY)
    light = routed.where(F.col("backend") == fixed.LIGHT)
    heavy = session.written(N.output_stems(heavy, input_root, flat=True, hot_rows=hot_rows), "heavy")
    heavy = N.name_clashes(heavy, hot_rows).select(
        *routed.columns, F.concat(F.lit(output_dir + "/"), "output_name").alias("output"),
        F.when(F.col("clash"), F.lit("its output folder would also be another input's")).alias("refused"))
    light = session.written(N.output_stems(light, input_root, flat=False, hot_rows=hot_rows).withColumn(
        "output", F.concat(F.lit(output_dir + "/"), "output_name", F.lit(".md"))), "light")
    light = N.written_guard(light, hot_rows).select(
        *routed.columns, "output",
        F.when(~F.col("written"), F.lit("its output was already written by another input of this run")).alias("refused"))
    return heavy.unionByName(light).withColumn("timeout", R.job_timeout(F.col("pages")))


def run(documents: DataFrame, planned: DataFrame, converters: dict[str, tuple[Callable, Callable | None]],
        scope: Callable[[DataFrame], DataFrame], input_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, records) of converting `documents(path, name, content, sha256, bytes, modified)` as planned.

    `scope` cuts documents to what the plan covered, by their paths alone.
    `planned` should be a written table. Both converters run in one pass, straight from the
    scan of `documents`, whatever happens in either: what a plan decides about a body is only whether
    it is refused, and the refused paths are written on their own so that Spark knows how
    many there are when it chooses how to leave them out. The converted rows are written
    once to the shared folder: results, records and outputs come from that table, so no
    document is converted twice and a lost executor costs a reread.
    """
    name = P.basename(F.col("path"))
    refused = session.written(planned.where(F.col("refused").isNotNull()).select("path"), "refused")
    mine = scope(documents).join(refused, "path", "left_anti").withColumn("backend", C.route(name))
    # What the records say of a document comes back beside its result, so that no body is read a second time.
    converted = session.written(U.convert_routed(mine, converters, keep=("sha256", "bytes", "modified")), "converted")
    outcome = planned.join(converted.select("path", "ok", "error"), "path", "left").select(
        "path", "backend", "output",
        F.when(F.col("ok"), F.lit("converted")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce("refused", "error").alias("reason"))
    done = converted.where("ok").withColumn("outputs", V.output_names(F.col("files"))).drop("files")
    done = done.join(planned.select("path", "output"), "path").select(
        "path", "sha256", "bytes", "modified", "backend", "started", "finished",
        F.lit("markdown").alias("output_format"), F.array("backend", "path").alias("command"),
        F.col("output").alias("output_dir"), "outputs", "versions",
        F.expr("cast(map() as map<string,string>)").alias("options"))
    return outcome, V.provenance_record(done, input_root)
