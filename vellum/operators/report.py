"""Run outcomes, throughput and overhead: ordinary aggregates, exact whatever the row order.

Seconds are summed as decimals. A double sum depends on the order partitions finish in,
and a rounded rate could then differ from one run to the next.
"""

from pyspark.sql import Column, DataFrame, functions as F

from vellum import fixed
from vellum.functions import paths as P
from vellum.functions.records import human_size

EXACT = "decimal(28,9)"


def _ratio(top: Column, bottom: Column, digits: int) -> Column:
    """top / bottom rounded half up; null when there is nothing to divide by."""
    return F.round(top.cast(EXACT) / F.nullif(bottom.cast(EXACT), F.lit(0)), digits).cast("double")


def path_summary(runs: DataFrame) -> DataFrame:
    """Per path kind, never blended: documents, pages, seconds and rates of the runs that succeeded."""
    seconds, pages = F.col("_seconds"), F.col("pages")
    summed = runs.where("ok").groupBy(F.coalesce("path", F.lit("unknown")).alias("path")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.coalesce("pages", F.lit(0)).cast("bigint")).alias("pages"),
        F.sum(F.col("seconds").cast(EXACT)).alias("_seconds"))
    return summed.select(
        "path", "documents", "pages", F.round(seconds, 3).cast("double").alias("seconds"),
        F.when(pages > 0, _ratio(seconds, pages, 3)).alias("seconds_per_page"),
        F.when((pages > 0) & (seconds > 0), _ratio(pages * 60, seconds, 2)).alias("pages_per_minute"))


def doc_mean(runs: DataFrame) -> DataFrame:
    """Per file over its successful runs: mean seconds, the kind of its first run, where it first appeared."""
    return runs.where("ok").groupBy("file").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.col("seconds").cast(EXACT)).alias("total"),
        F.min_by("path", "seq").alias("path"),
        F.min("seq").alias("first_seq"))


def with_mean(means: DataFrame) -> DataFrame:
    return means.withColumn("warm_seconds", _ratio(F.col("total"), F.col("runs"), 3))


def overhead(samples: DataFrame) -> DataFrame:
    """Per kind: mean of the cold samples less the warm one; unknown, with a reason, when cold is no dearer."""
    cold = F.aggregate("cold_seconds", F.lit(0).cast("decimal(38,9)"),
                       lambda n, s: (n + s.cast(EXACT)).cast("decimal(38,9)"))
    over = cold.cast(EXACT) / F.size("cold_seconds").cast("decimal(10,0)") - F.col("warm_seconds").cast(EXACT)
    return samples.select(
        "path", F.col("warm_seconds"),
        F.when(over > 0, F.round(over, 3).cast("double")).alias("seconds"),
        F.when(over <= 0, F.lit("a fresh process was no slower than a warm one: "
                                "these samples do not measure the overhead")).alias("why"))


def resident_saving(means: DataFrame, overheads: DataFrame) -> DataFrame:
    """Each document's mean warm time against the overhead of its own path.

    `overheads` has one row per path kind, and only two kinds have an overhead, so what is
    broadcast is two rows. A text document whose tables are OCR'd may pay the OCR overhead too.
    """
    costs = overheads.where(F.col("path").isin("text", "ocr")).groupBy("path").agg(F.max("seconds").alias("_own"))
    ocr = costs.where(F.col("path") == "ocr").select(F.lit("text").alias("path"), F.col("_own").alias("_ocr"))
    joined = means.join(F.broadcast(costs), "path", "left").join(F.broadcast(ocr), "path", "left")
    own = F.col("_own")
    mean = F.col("total").cast(EXACT) / F.col("runs")

    def speedup(over: Column) -> Column:
        return _ratio(over.cast(EXACT) * F.col("runs").cast("decimal(12,0)") + F.col("total"), F.col("total"), 2)

    return joined.select(
        "file", "path", "first_seq", _ratio(F.col("total"), F.col("runs"), 3).alias("warm_seconds"),
        own.alias("overhead_seconds"),
        F.round(own.cast(EXACT) + mean, 3).cast("double").alias("cli_seconds"),
        F.when(F.col("total") > 0, speedup(own)).alias("speedup"),
        F.when((F.col("path") == "text") & (F.col("total") > 0), speedup(F.col("_ocr")))
        .alias("speedup_if_its_tables_are_ocrd"))


def pick_sample(files: DataFrame) -> DataFrame:
    """The first PDF of each path kind in input order, or why there is none."""
    firsts = files.where(F.lower("file").endswith(".pdf") & F.col("path").isin("text", "ocr")).agg(
        *[F.min_by(F.when(F.col("path") == k, F.col("file")),
                   F.when(F.col("path") == k, F.col("seq"))).alias(k) for k in ("text", "ocr")])
    return firsts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("path"), F.col(k).alias("file")) for k in (
        "text", "ocr")]))).withColumn(
        "why", F.when(F.col("file").isNull(), F.concat(F.lit("no "), "path", F.lit(" PDF in the set"))))


def severity(code: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in fixed.EXIT_SEVERITY]), code)


def run_outcome(codes: DataFrame, *by: str) -> DataFrame:
    """The exit code that wins: a failure outranks a missing input, which outranks nothing to convert."""
    return codes.groupBy(*by).agg(F.max_by("code", severity(F.col("code"))).alias("code"))


def run_counts(results: DataFrame, *by: str) -> DataFrame:
    """Per run: converted, failed, missing and without provenance, and the exit code they make.

    `results(status, has_provenance)` has status converted, failed, missing or skipped.
    """
    status = F.col("status")
    counted = results.groupBy(*by).agg(
        F.count_if(status == "converted").alias("converted"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "missing").alias("missing"),
        F.count_if((status == "converted") & ~F.col("has_provenance")).alias("without_provenance"))
    return counted.withColumn(
        "code", F.when((F.col("failed") > 0) | (F.col("without_provenance") > 0), fixed.EXIT_FAILED)
        .when(F.col("missing") > 0, fixed.EXIT_NO_INPUT)
        .when(F.col("converted") == 0, fixed.EXIT_NOTHING)
        .otherwise(fixed.EXIT_OK))


def backend_outcomes(*halves: DataFrame) -> DataFrame:
    """Outcome rows of several converters side by side: every half runs, none hides another."""
    rows = halves[0]
    for half in halves[1:]:
        rows = rows.unionByName(half)
    return rows


def folder_size(files: DataFrame, folder: Column) -> DataFrame:
    """Bytes and files per folder."""
    return files.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("length").cast("bigint")).alias("bytes"))


def folder_totals(files: DataFrame, root: str) -> DataFrame:
    """Every folder from `root` down that has a file somewhere below it: own_files, files and bytes of all levels, and size to be read.

    `files(path, length)`; files outside `root`, and null paths, belong to no folder; a null length counts as 0. Files are added up per
    folder first, then each folder's sums are handed to the folders above it, and added up again within a task before they are
    shuffled: even the root is one row a task.
    """
    path, base = P.normalise(F.col("path")), root.rstrip("/")
    folder = F.when(P.under(path, root) & (path != F.lit(base or "/")), P.parent(path))
    own = files.select(folder.alias("folder"), F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length")).where("folder is not null").groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    names = F.filter(F.split(F.substr("folder", F.lit(len(base) + 1)), "/"), lambda n: n != "")
    above = F.transform(F.sequence(F.lit(0), F.size("_names")), lambda n: F.when(n == 0, F.lit(base or "/")).otherwise(
        F.concat_ws("/", F.lit(base), F.slice("_names", F.lit(1), n))))
    handed = own.withColumn("_names", names).select(F.explode(above).alias("above"), "folder", "files", "bytes")
    summed = handed.groupBy(F.col("above").alias("folder")).agg(
        F.coalesce(F.sum(F.when(F.col("folder") == F.col("above"), F.col("files"))), F.lit(0)).alias("own_files"),
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return summed.withColumn("size", human_size(F.col("bytes")))


def bench_summary(runs: DataFrame, overheads: DataFrame) -> DataFrame:
    """The report's summary as one JSON row: a few kinds, whatever the number of documents."""
    kinds = path_summary(runs).agg(F.array_sort(F.collect_list(F.struct(
        "path", "documents", "pages", "seconds", "seconds_per_page", "pages_per_minute"))).alias("warm"))
    costs = overheads.where(F.col("path").isin("text", "ocr")).agg(
        F.array_sort(F.collect_list(F.struct("path", "seconds", "why"))).alias("overhead"))
    both = kinds.withColumn("_one", F.lit(1)).join(costs.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct(
        F.lit(fixed.BENCH_SCHEMA).alias("schema"), "warm", "overhead"), {"ignoreNullFields": "false"}).alias("report"))
