"""What is in a corpus: formats, depth, clutter, routing, and which inputs were asked for."""

from pyspark.sql import Column, DataFrame, functions as F

from vellum import fixed
from vellum.functions import paths as P
from vellum.operators.skew import HOT_ROWS, attach


def supported(name: Column, formats: list[str]) -> Column:
    return P.file_format(name).isin(formats)


def within_depth(rel: Column, depth: int | None) -> Column:
    """Files at most `depth` levels down; depth 0 still lists the root's own files."""
    if depth is None:
        return F.lit(True)
    return F.size(F.split(rel, "/")) <= max(depth, 1)


def in_clutter(rel: Column) -> Column:
    """Does any folder of the relative path, the file name aside, hold generated output or tool clutter?"""
    parts = F.split(rel, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda d: d.isin(fixed.CLUTTER_FOLDERS))


def route(name: Column) -> Column:
    return F.when(supported(name, fixed.ROUTED_HEAVY_FORMATS), F.lit(fixed.HEAVY)).otherwise(F.lit(fixed.LIGHT))


def corpus_filter(manifest: DataFrame, root: str, formats: list[str], depth: int | None = fixed.DEFAULT_DEPTH,
                  skip: list[str] = (), clutter: bool = True) -> DataFrame:
    """A manifest cut to what a scan of `root` lists: one narrow pass, no shuffle."""
    rel = P.relative_to(F.col("path"), root)
    name = P.basename(F.col("path"))
    kept = manifest.where(rel.isNotNull() & supported(name, formats) & ~P.is_sidecar(name) & within_depth(rel, depth))
    if clutter:
        kept = kept.where(~in_clutter(rel))
    for folder in skip:
        kept = kept.where(~P.under(F.col("path"), folder))
    return kept


def distinct_inputs(files: DataFrame) -> DataFrame:
    """One row per absolute path, the first by `input_seq`; copies are merged before the shuffle."""
    row = F.struct(*[F.col(c) for c in files.columns])
    return (files.withColumn("_abs", P.normalise(F.col("path")))
            .groupBy("_abs").agg(F.min_by(row, F.col("input_seq")).alias("_row"))
            .select("_row.*"))


def _folders_up(folder: Column) -> Column:
    """A normalised folder and every folder above it."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)),
                        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("/")), above))


def resolve_inputs(requested: DataFrame, manifest: DataFrame, formats: list[str],
                   depth: int | None = fixed.DEFAULT_DEPTH, skip: list[str] = (),
                   hot_rows: int = HOT_ROWS, salts: int = 16) -> DataFrame:
    """`requested(path, input_seq)`, files and folders mixed, as rows of files with a `status`.

    A file stands for itself, a folder for what a scan of it lists, and a path that is
    neither is `missing`. Only the folders of the corpus, never its files, are matched
    with the requests above them; the chosen folders then fetch their files in one join
    that splits a folder holding a large part of the corpus.
    """
    asked = requested.groupBy(P.normalise(F.col("path")).alias("asked")).agg(F.min("input_seq").alias("input_seq"))
    files = manifest.select(P.normalise(F.col("path")).alias("path")).withColumn("_folder", P.parent(F.col("path")))
    name = P.basename(F.col("path"))
    listable = files.where(supported(name, formats) & ~P.is_sidecar(name))
    for folder in skip:
        listable = listable.where(~P.under(F.col("path"), folder))

    folders = listable.groupBy("_folder").agg(F.count(F.lit(1)).alias("_files"))
    below = F.when(F.col("_folder") != F.col("asked"), P.relative_to(F.col("_folder"), F.col("asked")))
    inside = F.when(below.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.split(below, "/"))
    reach = (folders.withColumn("asked", F.explode(_folders_up(F.col("_folder"))))
             .where(~F.exists(inside, lambda d: d.isin(fixed.CLUTTER_FOLDERS))))
    if depth is not None:
        reach = reach.where(F.size(inside) + 1 <= max(depth, 1))
    # The root is above every folder, so that key is spread before the join.
    reach = reach.withColumn("_salt", F.pmod(F.xxhash64("_folder"), F.lit(salts)).cast("int"))
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    chosen = reach.join(salted, ["asked", "_salt"]).groupBy("_folder").agg(
        F.min("input_seq").alias("input_seq"), F.max("_files").alias("_files"))
    by_folder = attach(listable, chosen, ["_folder"], "_files", "path", hot_rows).where(
        F.col("input_seq").isNotNull()).select("path", "input_seq")

    by_name = files.join(asked, F.col("path") == F.col("asked")).select("path", "input_seq")
    hits = by_folder.unionByName(by_name).groupBy("path").agg(F.min("input_seq").alias("input_seq")).select(
        "path", "input_seq", F.lit("present").alias("status"))
    every_folder = files.select("_folder").distinct().select(
        F.explode(_folders_up(F.col("_folder"))).alias("asked")).distinct()
    known = files.select(F.col("path").alias("asked")).unionByName(every_folder)
    missing = asked.join(known, "asked", "left_anti").select(
        F.col("asked").alias("path"), "input_seq", F.lit("missing").alias("status"))
    return hits.unionByName(missing)


def requested_present(requested: DataFrame, present: DataFrame) -> DataFrame:
    """Every requested file with whether it exists; the missing are reported, not fatal."""
    there = present.select("path").distinct().withColumn("_there", F.lit(True))
    return requested.join(there, "path", "left").withColumn(
        "status", F.when(F.col("_there"), F.lit("present")).otherwise(F.lit("missing"))).drop("_there")


def input_root(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row: the root that output mirrors. One folder given is its own root; otherwise it
    is the common parent folder of all files."""
    parts = F.split(P.parent(F.col("path")), "/")
    shared = files.agg(F.min(parts).alias("_first"), F.max(parts).alias("_last")).select(
        F.lit(1).alias("_one"), F.array_join(P.common_prefix(F.col("_first"), F.col("_last")), "/").alias("shared"))
    if requested is None:
        return shared.select(F.col("shared").alias("input_root"))
    asked = requested.select(P.normalise(F.col("path")).alias("asked"))
    only = asked.agg(F.count(F.lit(1)).alias("_n"), F.max("asked").alias("only")).withColumn("_one", F.lit(1))
    is_file = files.select(P.normalise(F.col("path")).alias("only")).join(
        only.where(F.col("_n") == 1), "only", "left_semi").agg((F.count(F.lit(1)) > 0).alias("_file")).withColumn(
        "_one", F.lit(1))
    return shared.join(only, "_one").join(is_file, "_one").select(
        F.when((F.col("_n") == 1) & ~F.col("_file"), F.col("only")).otherwise(F.col("shared")).alias("input_root"))


def common_paths(files: DataFrame, key: str) -> DataFrame:
    """Per `key`, the common parent folder of its files: the prefix shared by the least and the greatest."""
    parts = F.split(P.parent(F.col("path")), "/")
    return files.groupBy(key).agg(F.min(parts).alias("_first"), F.max(parts).alias("_last")).select(
        key, F.array_join(P.common_prefix(F.col("_first"), F.col("_last")), "/").alias("common_path"))
