"""Jobs: accepted, checked, converted and looked up, as tables and as streams."""

from pyspark.sql import functions as F

from vellum import session
from vellum.operators import convert as U, jobs as J
from vellum.plans import inputs as I
from vellum.plans.conversion_queries import load_refusing, refusing
from vellum.plans.registry import query
from vellum.sources.tables import read_jobs
from vellum.streaming import queue as Q


def _events(spark, sf):
    return I.table(spark, sf, "events")


@query("WITH " + I.JOBS_SQL + "SELECT job_id, path, refusal FROM jobs")
def admit_job(spark, sf):
    return J.admit_jobs(I.jobs(_events(spark, sf))).select("job_id", "path", "refusal")


_TAKEN = "WITH " + I.REQUESTS_SQL + "SELECT job_id, error, path, timeout, options FROM taken"


@query(_TAKEN)
def job_intake(spark, sf):
    return J.intake(J.parse_requests(I.requests(_events(spark, sf)))).select("job_id", "error", "path", "timeout", "options")


_LATEST = "WITH " + I.JOB_EVENTS_SQL + """,
latest AS (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1),
seen AS (SELECT job_id, status, result, CASE WHEN status = 'failed' THEN 'conversion failed — see worker logs' END AS error, ts FROM latest)
"""
_NOW = "TIMESTAMP '2024-01-31 12:00:00'"


def _latest(spark, sf):
    return J.latest_status(I.job_events(_events(spark, sf)))


@query(_LATEST + "SELECT job_id, status, result, error FROM seen")
def job_status(spark, sf):
    return _latest(spark, sf).drop("ts")


@query(_LATEST + f"SELECT job_id, status, result FROM seen WHERE status NOT IN ('finished', 'failed') OR ts >= {_NOW} - INTERVAL 1 DAY")
def result_ttl(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-31 12:00:00"))
    return J.live_results(_latest(spark, sf), now).select("job_id", "status", "result")


@query(_LATEST + """SELECT c_custkey, 'j' || c_custkey AS job_id, coalesce(s.status, 'not found') AS status, s.result, s.error
FROM customer LEFT JOIN seen s ON s.job_id = 'j' || c_custkey""")
def job_lookup(spark, sf):
    asked = I.table(spark, sf, "customer", "c_custkey").withColumn("job_id", F.concat(F.lit("j"), "c_custkey"))
    return J.lookup_status(asked, _latest(spark, sf).drop("ts"))


def _folders(spark, name, *parts):
    base = session.fresh_folder(spark, name)
    return [f"{base}/{p}" for p in parts]


@query("WITH " + I.REQUESTS_SQL + "SELECT job_id, error, path, options FROM taken")
def stream_intake(spark, sf):
    """The request stream run to its end: queued job files and refused rows."""
    queue, refused, state = _folders(spark, "intake", "queue", "refused", "state")
    Q.job_intake(I.requests(I.event_stream(spark, sf)), queue, refused, state).awaitTermination()
    no = F.lit(None).cast("string")
    queued = spark.read.schema(J.JOB_SCHEMA).json(queue).select("job_id", no.alias("error"), "path", "options")
    return queued.unionByName(spark.read.schema("job_id string, ts timestamp, error string").parquet(refused).select(
        "job_id", "error", no.alias("path"), no.alias("options")))


@query("WITH " + I.JOBS_SQL + """
SELECT job_id, CASE WHEN refusal IS NULL THEN 'finished' ELSE 'failed' END AS status, CASE WHEN refusal IS NULL THEN path END AS result,
  'refused: ' || refusal AS error, CASE WHEN refusal IS NULL THEN sha256('# converted e' || i || '.pdf' || chr(10) || props) END AS sha256 FROM jobs""")
def stream_queue(spark, sf):
    """The queue run to its end: every job checked, the admitted converted, each with its state and output."""
    session.limit_batches(spark)
    status, outputs, state = _folders(spark, "queue", "status", "outputs", "state")

    def convert(admitted):
        docs = admitted.select("job_id", "ts", "path", F.substring_index("path", "/", -1).alias("name"), "content",
                               F.from_json("options", "map<string,string>").alias("options"))
        return U.convert_documents(docs, "stand-in", refusing, load_refusing, keep=("job_id", "ts")).select(
            "job_id", "ts", "path", "ok", "error", "files")

    Q.run_queue(I.jobs(I.event_stream(spark, sf)), status, state, convert, outputs).awaitTermination()
    body = F.try_element_at("files", F.lit(1))["body"]
    files = spark.read.parquet(outputs).select("job_id", F.sha2(body, 256).alias("sha256"))
    states = spark.read.schema("job_id string, ts timestamp, status string, result string, error string").parquet(status)
    return states.join(files, "job_id", "left").select("job_id", "status", "result", "error", "sha256")


@query(_LATEST + "SELECT job_id, status, result, error FROM seen")
def stream_status(spark, sf):
    """The latest state per job, kept by a stream."""
    table, state = _folders(spark, "states", "table", "state")
    Q.job_status(I.job_events(I.event_stream(spark, sf)), table, state).awaitTermination()
    schema = "job_id string, status string, result string, error string, ts timestamp, batch_id bigint"
    return Q.read_status(spark, table, schema).drop("ts")


@query(_LATEST + """SELECT job_id, CASE WHEN status IN ('finished', 'failed') AND ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM job_events) THEN 'expired' ELSE status END AS status FROM seen""")
def stream_expiry(spark, sf):
    """The last thing a stream says of each job: its state, or that its result has expired."""
    table, state = _folders(spark, "expiry", "table", "state")
    events = I.job_events(I.event_stream(spark, sf)).select("job_id", "ts", "seq", "status")
    (Q.result_expiry(events).writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema("job_id string, status string, ts timestamp").parquet(table)
    return rows.groupBy("job_id").agg(F.max_by("status", F.struct("ts", F.col("status") == "expired")).alias("status"))


@query("SELECT DISTINCT '/data/input/u' || user_id || '.pdf' AS path FROM events")
def stream_dedup(spark, sf):
    """A path named again within the watermark is one input."""
    table, state = _folders(spark, "dedup", "table", "state")
    named = I.event_stream(spark, sf).select(
        F.concat(F.lit(I.ROOT + "/u"), "user_id", F.lit(".pdf")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    (Q.job_dedup(named, "60 days").writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("path string, ts timestamp").parquet(table).select("path")


@query("WITH " + I.REQUESTS_SQL + """
SELECT job_id, CASE WHEN error IS NULL THEN 'finished' ELSE 'refused' END AS status, path AS result, error FROM taken""")
def stream_service(spark, sf):
    """Requests to results: the intake stream writes job files, and a second stream takes them from there."""
    queue, refused, taken, status, ran = _folders(spark, "service", "queue", "refused", "taken", "status", "ran")
    Q.job_intake(I.requests(I.event_stream(spark, sf)), queue, refused, taken).awaitTermination()

    def convert(admitted):
        docs = admitted.select("job_id", "ts", "path", F.col("path").alias("name"), F.col("options").cast("binary").alias("content"),
                               F.from_json("options", "map<string,string>").alias("options"))
        return U.convert_documents(docs, "stand-in", refusing, load_refusing, keep=("job_id", "ts")).select(
            "job_id", "ts", "path", "ok", "error")

    Q.run_queue(read_jobs(spark, queue), status, ran, convert).awaitTermination()
    rows = spark.read.schema("job_id string, ts timestamp, status string, result string, error string").parquet(status)
    turned_away = spark.read.schema("job_id string, ts timestamp, error string").parquet(refused)
    return rows.select("job_id", "status", "result", "error").unionByName(turned_away.select(
        "job_id", F.lit("refused").alias("status"), F.lit(None).cast("string").alias("result"), "error"))
