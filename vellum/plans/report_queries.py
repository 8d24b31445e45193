"""Run outcomes, throughput and overhead."""

from pyspark.sql import functions as F

from vellum.operators import report as R
from vellum.plans import inputs as I
from vellum.plans.registry import query


def ratio_sql(top: str, bottom: str, digits: int) -> str:
    """top / bottom rounded half up, in integers (both are non-negative)."""
    scale = 10 ** digits
    return f"(((2 * ({top})::HUGEINT * {scale} + ({bottom})::HUGEINT) // (2 * ({bottom})::HUGEINT))::DOUBLE / {scale})"


BASE = "WITH " + I.RUNS_SQL
SAMPLES = "WITH " + I.SAMPLES_SQL


@query(BASE + f"""
SELECT path, documents, pages, (ms::DOUBLE / 1000) AS seconds, {ratio_sql('ms', 'nullif(pages, 0) * 1000', 3)} AS seconds_per_page,
  CASE WHEN pages > 0 THEN {ratio_sql('pages * 60 * 1000', 'ms', 2)} END AS pages_per_minute
FROM (SELECT coalesce(path, 'unknown') AS path, count(*) AS documents, sum(coalesce(pages, 0))::BIGINT AS pages, sum(ms) AS ms
      FROM runs WHERE ok GROUP BY 1)""")
def path_summary(spark, sf):
    return R.path_summary(I.bench_runs(spark, sf))


_MEANS = """means AS (SELECT file, count(*) AS n, sum(ms) AS ms, arg_min_null(path, seq) AS path, min(seq) AS first_seq FROM runs WHERE ok GROUP BY file)"""


@query(BASE + ", " + _MEANS + f"SELECT file, path, first_seq, n AS runs, {ratio_sql('ms', 'n * 1000', 3)} AS warm_seconds FROM means")
def doc_mean(spark, sf):
    return R.with_mean(R.doc_mean(I.bench_runs(spark, sf))).drop("total")


_OVER = "over AS (SELECT *, CASE WHEN c1 + c2 > 2 * w THEN round((c1 + c2 - 2 * w) / 2)::HUGEINT END AS o FROM samples)"
_WHY = "'a fresh process was no slower than a warm one: these samples do not measure the overhead'"


@query(SAMPLES + ", " + _OVER + f"""
SELECT path, warm_seconds, CASE WHEN o IS NOT NULL THEN {ratio_sql('c1 + c2 - 2 * w', '2000', 3)} END AS seconds,
  CASE WHEN o IS NULL THEN {_WHY} END AS why FROM over""")
def overhead(spark, sf):
    return R.overhead(I.overhead_samples(spark, sf))


def _speedup(over: str) -> str:
    return ratio_sql(f"{over} * n + m.ms", "m.ms", 2)


# The overhead in milliseconds is rounded half up before it is used, as the report shows it.
_COST = "cost AS (SELECT path, CASE WHEN c1 + c2 > 2 * w THEN (c1 + c2 - 2 * w + 1) // 2 END AS o FROM samples WHERE path IN ('text', 'ocr'))"


@query(SAMPLES + ", " + _MEANS + ", " + _COST + f"""
SELECT m.file, m.path, m.first_seq, {ratio_sql('m.ms', 'n * 1000', 3)} AS warm_seconds, (c.o::DOUBLE / 1000) AS overhead_seconds,
  {ratio_sql('c.o * n + m.ms', 'n * 1000', 3)} AS cli_seconds, {_speedup('c.o')} AS speedup,
  CASE WHEN m.path = 'text' THEN {_speedup("(SELECT o FROM cost WHERE path = 'ocr')")} END AS speedup_if_its_tables_are_ocrd
FROM means m LEFT JOIN cost c ON c.path = m.path""")
def overhead_lookup(spark, sf):
    means = R.doc_mean(I.bench_runs(spark, sf))
    return R.resident_saving(means, R.overhead(I.overhead_samples(spark, sf)))


@query(BASE + """
SELECT k.path, f.file, CASE WHEN f.file IS NULL THEN 'no ' || k.path || ' PDF in the set' END AS why
FROM (SELECT unnest(['text', 'ocr']) AS path) k
LEFT JOIN (SELECT path, arg_min(file, seq) AS file FROM runs WHERE suffix(file, '.pdf') GROUP BY path) f USING (path)""")
def pick_sample(spark, sf):
    return R.pick_sample(I.bench_runs(spark, sf))


_CODES = """codes AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice < 60000 THEN 1 ELSE 0 END
  WHEN 'O' THEN 3 ELSE 2 END AS code FROM orders)"""


@query("WITH " + _CODES + """
SELECT run, CASE WHEN bool_or(code = 1) THEN 1 WHEN bool_or(code = 2) THEN 2 WHEN bool_or(code = 3) THEN 3 ELSE 0 END AS code FROM codes GROUP BY run""")
def run_outcome(spark, sf):
    status = F.col("o_orderstatus")
    codes = I.table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice").select(
        F.col("o_custkey").alias("run"),
        F.when(status == "F", F.when(F.col("o_totalprice") < 60000, 1).otherwise(0)).when(status == "O", 3).otherwise(2).alias("code"))
    return R.run_outcome(codes, "run")


_RESULTS = """results AS (SELECT l_suppkey AS run, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity < 3 THEN 'failed' ELSE 'converted' END
  WHEN 'A' THEN CASE WHEN l_tax = 0 THEN 'missing' ELSE 'converted' END ELSE 'skipped' END AS status, l_discount > 0.001 AS has_provenance FROM lineitem)"""


@query("WITH " + _RESULTS + """
SELECT run, converted, failed, missing, without_provenance, CASE WHEN failed + without_provenance > 0 THEN 1 WHEN missing > 0 THEN 2 WHEN converted = 0 THEN 3 ELSE 0 END AS code
FROM (SELECT run, count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing,
  count(*) FILTER (status = 'converted' AND NOT has_provenance) AS without_provenance FROM results GROUP BY run)""")
def run_counts(spark, sf):
    flag = F.col("l_returnflag")
    status = (F.when(flag == "R", F.when(F.col("l_quantity") < 3, "failed").otherwise("converted"))
              .when(flag == "A", F.when(F.col("l_tax") == 0, "missing").otherwise("converted")).otherwise("skipped"))
    rows = I.table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_quantity", "l_tax", "l_discount").select(
        F.col("l_suppkey").alias("run"), status.alias("status"), (F.col("l_discount") > 0.001).alias("has_provenance"))
    return R.run_counts(rows, "run")


@query("WITH " + I.MANIFEST_SQL + ", " + I.names_sql() + """,
halves AS (SELECT dir AS run, CASE WHEN fmt IN ('pdf', 'png') THEN 'marker' ELSE 'markitdown' END AS backend,
  CASE WHEN length < 300 THEN 1 WHEN fmt = 'txt' THEN 3 WHEN fmt = '' THEN 2 ELSE 0 END AS code FROM m0)
SELECT run, count(DISTINCT backend) AS backends, CASE WHEN bool_or(code = 1) THEN 1 WHEN bool_or(code = 2) THEN 2 WHEN bool_or(code = 3) THEN 3 ELSE 0 END AS code
FROM halves GROUP BY run""")
def backend_outcomes(spark, sf):
    """Both converters' results per folder, each half's worst code first, then the worse of the two."""
    from vellum.functions import paths as P
    from vellum.operators import corpus as C
    fmt = P.file_format(F.col("name"))
    files = I.manifest(spark, sf).select(
        P.parent(F.col("path")).alias("run"), C.route(F.col("name")).alias("backend"),
        F.when(F.col("length") < 300, 1).when(fmt == "txt", 3).when(fmt == "", 2).otherwise(0).alias("code"))
    halves = [R.run_outcome(files.where(F.col("backend") == b), "run", "backend") for b in ("marker", "markitdown")]
    both = R.backend_outcomes(*halves)
    return R.run_outcome(both, "run").join(both.groupBy("run").agg(F.count(F.lit(1)).alias("backends")), "run")


@query(SAMPLES + ", " + _COST + f""",
warm AS (SELECT path, documents, pages, (ms::DOUBLE / 1000) AS seconds, {ratio_sql('ms', 'nullif(pages, 0) * 1000', 3)} AS seconds_per_page,
  CASE WHEN pages > 0 THEN {ratio_sql('pages * 60 * 1000', 'ms', 2)} END AS pages_per_minute
  FROM (SELECT coalesce(path, 'unknown') AS path, count(*) AS documents, sum(coalesce(pages, 0))::BIGINT AS pages, sum(ms) AS ms FROM runs WHERE ok GROUP BY 1))
SELECT w.path, w.documents, w.pages, w.seconds, w.seconds_per_page, w.pages_per_minute, (c.o::DOUBLE / 1000) AS overhead
FROM warm w LEFT JOIN cost c USING (path)""")
def bench_report(spark, sf):
    """The summary as JSON, read back."""
    report = R.bench_summary(I.bench_runs(spark, sf), R.overhead(I.overhead_samples(spark, sf)))
    kind = "struct<path:string,documents:bigint,pages:bigint,seconds:double,seconds_per_page:double,pages_per_minute:double>"
    read = report.select(F.from_json("report", f"schema string, warm array<{kind}>, "
                                     "overhead array<struct<path:string,seconds:double,why:string>>").alias("r"))
    warm = read.select(F.inline("r.warm"))
    costs = read.select(F.inline("r.overhead")).select("path", F.col("seconds").alias("overhead"))
    return warm.join(costs, "path", "left")
