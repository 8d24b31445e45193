"""Jobs as rows: accepted into the queue, checked again before they run, and looked up afterwards."""

from pyspark.sql import Column, DataFrame, functions as F

from vellum import fixed
from vellum.functions import options as O, page_ranges as PR, paths as P, records as R
from vellum.functions.let import let

# What a caller sends, and what a queued job carries.
REQUEST_SCHEMA = ("path string, output_format string, output_dir string, use_llm boolean, "
                  "force_ocr boolean, page_range string")
JOB_SCHEMA = ("job_id string, ts timestamp, func string, path string, options string, "
              "kwargs map<string,string>, callback string, webhooks array<string>, depends_on array<string>")
TERMINAL = ["finished", "failed"]


def parse_requests(bodies: DataFrame) -> DataFrame:
    """`bodies(job_id, ts, body)` with the JSON body read by schema and its defaults filled in."""
    body = F.from_json("body", REQUEST_SCHEMA)
    return bodies.withColumn("_r", body).select(
        "job_id", "ts", F.col("_r.path").alias("path"),
        F.coalesce("_r.output_format", F.lit("markdown")).alias("output_format"),
        F.col("_r.output_dir").alias("output_dir"),
        F.coalesce("_r.use_llm", F.lit(False)).alias("use_llm"),
        F.coalesce("_r.force_ocr", F.lit(False)).alias("force_ocr"),
        F.col("_r.page_range").alias("page_range"))


def intake(requests: DataFrame, settings: dict[str, str] | None = None, pages: Column | None = None,
           exists: Column | None = None, input_root: str = fixed.INPUT_ROOT,
           output_root: str = fixed.OUTPUT_ROOT) -> DataFrame:
    """Requests as jobs: `error` says why one is refused before it costs a queue slot.

    Rules in order: the path inside the input root, an existing file, the output folder
    inside its root, the output format, the page range, a model service if one is asked
    for. Accepted rows carry the options and the timeout sized from their pages.
    """
    has_range = F.coalesce("page_range", F.lit("")) != ""
    read = requests.select(
        "*", P.confine(F.col("path"), input_root, "path").alias("_path"),
        P.confine(F.coalesce(F.nullif("output_dir", F.lit("")), F.lit(output_root)), output_root, "output_dir").alias("_out"),
        F.when(has_range, PR.parse_page_range(F.col("page_range"))).alias("_range"),
        (pages if pages is not None else F.lit(None).cast("bigint")).alias("_pages"),
        (exists if exists is not None else F.lit(True)).alias("_exists"))
    error = F.coalesce(
        F.when(F.col("path").isNull(), F.lit("path is required")),
        F.col("_path.error"),
        F.when(~F.col("_exists"), F.lit("path must be an existing file")),
        F.col("_out.error"),
        O.output_format_error(F.col("output_format")),
        F.col("_range.error"),
        F.when(F.col("use_llm"), F.lit(None if settings else "use_llm was requested but no LLM is configured")))
    options = F.to_json(F.struct(
        F.col("output_format"), F.col("_out.path").alias("output_dir"),
        F.when(F.col("use_llm"), F.lit(True)).alias("use_llm"),
        F.when(F.col("force_ocr"), F.lit(True)).alias("force_ocr"),
        F.col("_range.normalised").alias("page_range")))
    accepted = F.col("error").isNull()
    return read.withColumn("error", error).select(
        "job_id", "ts", "error",
        F.when(accepted, F.lit(fixed.JOB_FUNCTION)).alias("func"),
        F.when(accepted, F.col("_path.path")).alias("path"),
        F.when(accepted, options).alias("options"),
        F.when(accepted, F.create_map(F.lit("input_root"), F.lit(input_root))).alias("kwargs"),
        F.when(accepted, R.job_timeout(R.job_pages(F.col("_pages"), F.col("_range.pages")))).alias("timeout"))


def refusal(settings: dict[str, str] | None = None, func: str = fixed.JOB_FUNCTION,
            input_root: str = fixed.INPUT_ROOT, output_root: str = fixed.OUTPUT_ROOT) -> Column:
    """Why a queued job (JOB_SCHEMA) must not run; null when it is one the intake made.

    The first failing rule is the reason. The queue is not trusted: a job that came by
    another way must not choose what is called, read or written.
    """
    options = F.coalesce("options", F.lit(""))
    kwargs = F.coalesce("kwargs", F.expr("cast(map() as map<string,string>)"))
    others = F.array_except(F.map_keys(kwargs), F.array(F.lit("input_root")))
    root = F.try_element_at(kwargs, F.lit("input_root"))

    def reason(kinds: Column) -> Column:
        out_dir = F.get_json_object(options, "$.output_dir")
        outside_out = ~kinds["output_dir"].isin("STRING", "VOID") | (
            (kinds["output_dir"] == "STRING") & ~P.under(P.normalise(out_dir), output_root))
        return F.coalesce(
            F.when(~F.col("func").eqNullSafe(func), F.concat(
                F.lit("names '"), F.coalesce("func", F.lit("")), F.lit(f"', not {func}"))),
            F.when(F.col("path").isNull() | ~F.coalesce(kinds["all"].startswith("OBJECT"), F.lit(False)),
                   F.lit("arguments are not a path and an options dict")),
            F.when(F.size(others) > 0, F.lit("keyword arguments other than input_root")),
            F.when(F.col("callback").isNotNull(), F.lit("names a callback")),
            F.when(F.coalesce(F.size("webhooks"), F.lit(0)) > 0, F.lit("carries webhooks")),
            F.when(F.coalesce(F.size("depends_on"), F.lit(0)) > 0, F.lit("depends on other jobs")),
            F.when(~P.under(P.normalise(F.col("path")), input_root), F.lit(f"path outside {input_root}")),
            F.when(F.coalesce(root, F.lit("")) != "", F.when(
                ~P.under(P.normalise(root), input_root), F.lit(f"input_root outside {input_root}"))),
            F.when(outside_out, F.lit(f"output_dir outside {output_root}")),
            F.concat(F.lit("options: "), O.validate_options(options, settings)["error"]))

    def kinds(parsed: Column) -> Column:
        out_dir = F.try_variant_get(parsed, "$.output_dir", "variant")
        return F.struct(F.schema_of_variant(parsed).alias("all"), F.schema_of_variant(out_dir).alias("output_dir"))

    return let(F.try_parse_json(options), lambda parsed: let(kinds(parsed), reason))


def admit_jobs(jobs: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """`jobs` with `refusal`. A refused job is failed without being run, and stops no other."""
    return jobs.withColumn("refusal", refusal(settings))


def latest_status(events: DataFrame) -> DataFrame:
    """The latest state per job from `events(job_id, ts, seq, status, result, error)`.

    Failures read the same to every caller: paths and internals stay in the logs.
    """
    state = F.struct("ts", "status", "result")
    newest = events.groupBy("job_id").agg(F.max_by(state, F.struct("ts", "seq")).alias("_s"))
    return newest.select(
        "job_id", F.col("_s.status").alias("status"), F.col("_s.result").alias("result"),
        F.when(F.col("_s.status") == "failed", F.lit(fixed.CALLER_ERROR)).alias("error"),
        F.col("_s.ts").alias("ts"))


def live_results(states: DataFrame, now: Column, ttl: int = fixed.RESULT_TTL) -> DataFrame:
    """States a caller can still see: results and failures vanish `ttl` seconds after they ended."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    ended = F.col("status").isin(TERMINAL)
    return states.where(~ended | (age <= F.lit(ttl).cast("bigint") * 1_000_000))


def lookup_status(asked: DataFrame, states: DataFrame) -> DataFrame:
    """Each asked job id with its state, or `not found`."""
    return asked.join(states.withColumn("_there", F.lit(True)), "job_id", "left").select(
        *asked.columns,
        F.when(F.col("_there"), F.col("status")).otherwise(F.lit("not found")).alias("status"),
        "result", "error")
