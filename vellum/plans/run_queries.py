"""Whole runs as registered queries."""

from pyspark.sql import functions as F

from vellum import fixed, session
from vellum.operators import report as O
from vellum.plans import inputs as I, prepare
from vellum.plans.conversion_queries import load_refusing, refusing
from vellum.plans.corpus_queries import _LCP, BASE, CLUTTER, LIGHT, ROUTED, SIDECAR, HEAVY
from vellum.plans.registry import query


def _half(name: str, where: str, flat: bool) -> str:
    rel = f"CASE WHEN dir = {_LCP} THEN '' ELSE substr(dir, length({_LCP}) + 2) END"
    joined = "replace(r, '/', '_') || '_'" if flat else "r || '/'"
    return f"""{name}_g AS (
  SELECT *, count(*) OVER (PARTITION BY lower(stem)) AS n, min(string_split(dir, '/')) OVER (PARTITION BY lower(stem)) AS a,
         max(string_split(dir, '/')) OVER (PARTITION BY lower(stem)) AS b FROM kept WHERE {where}),
{name}_x AS (SELECT *, stem || '_' || substr(ext, 2) AS suffixed,
         CASE WHEN n = 1 THEN stem WHEN r = '' THEN stem || '_' || substr(ext, 2) ELSE {joined} || stem || '_' || substr(ext, 2) END AS first
       FROM (SELECT *, {rel} AS r FROM {name}_g)),
{name} AS (SELECT *, CASE WHEN n = 1 AND count(*) OVER (PARTITION BY lower(first)) > 1 THEN suffixed ELSE first END AS output_name FROM {name}_x)"""


PLANNED = BASE + f""", kept AS (SELECT *, fmt IN {ROUTED} AS to_heavy FROM m0
  WHERE (fmt IN {HEAVY} OR fmt IN {LIGHT}) AND NOT {SIDECAR} AND NOT ({CLUTTER}) AND length(rel) - length(replace(rel, '/', '')) + 1 <= 3),
{_half('heavy', 'to_heavy', True)}, {_half('light', 'NOT to_heavy', False)},
planned AS (
  SELECT path, name, text, input_seq, length, 'marker' AS backend, CASE WHEN fmt = 'pdf' THEN length // 500 + 1 ELSE 1 END::BIGINT AS pages,
    '/data/output/' || output_name AS output,
    CASE WHEN count(*) OVER (PARTITION BY lower(output_name)) > 1 THEN 'its output folder would also be another input''s' END AS refused FROM heavy
  UNION ALL SELECT path, name, text, input_seq, length, 'markitdown', CASE WHEN fmt = 'pdf' THEN length // 500 + 1 END::BIGINT, '/data/output/' || output_name || '.md',
    CASE WHEN row_number() OVER (PARTITION BY lower(output_name) ORDER BY input_seq) > 1 THEN 'its output was already written by another input of this run' END FROM light)
"""


def planned(spark, sf):
    files = I.manifest(spark, sf).select("path", "input_seq", F.expr("length div 500 + 1").alias("pdf_pages"))
    return prepare.plan_run(files, I.ROOT, I.OUTPUT)


@query(PLANNED + "SELECT path, input_seq, backend, pages, output, refused, coalesce(1800 + 180 * pages, 21600)::BIGINT AS timeout FROM planned")
def plan_run(spark, sf):
    """Which documents would be converted, by which converter, to which name, and at what cost."""
    return planned(spark, sf)


def _run(spark, sf):
    session.limit_batches(spark)
    docs = I.manifest(spark, sf, hashed=True).select(
        "path", "name", F.col("text").cast("binary").alias("content"), "sha256", F.col("length").alias("bytes"),
        F.timestamp_seconds(F.col("input_seq") * 60).alias("modified"))
    docs = docs.withColumn("name", F.when(F.col("bytes") < 300, F.concat(F.lit("boom "), "name")).otherwise(F.col("name")))
    both = {b: (refusing, load_refusing) for b in (fixed.HEAVY, fixed.LIGHT)}
    return prepare.run(docs, session.written(planned(spark, sf), "planned"), both,
                       lambda d: prepare.in_scope(d, I.ROOT, I.OUTPUT), I.ROOT)


_STATUS = """CASE WHEN refused IS NULL AND length >= 300 THEN 'converted' ELSE 'failed' END"""


@query(PLANNED + f"""SELECT path, backend, output, {_STATUS} AS status,
  CASE WHEN refused IS NOT NULL THEN refused WHEN length < 300 THEN 'RuntimeError: refusing boom ' || name END AS reason FROM planned""")
def run_results(spark, sf):
    """A run over both converters: each document's outcome."""
    return _run(spark, sf)[0]


@query(PLANNED + f"""SELECT path, substr(path, 13) AS relative_path, sha256(text) AS sha256, backend, output AS output_dir,
  CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END || '.md' AS outputs, 'stand-in=1.0' AS versions
FROM planned WHERE {_STATUS} = 'converted'""")
def run_provenance(spark, sf):
    """The records of the same run."""
    from vellum.functions.records import map_text
    return _run(spark, sf)[1].select(
        "source.path", "source.relative_path", "source.sha256", "conversion.backend", "conversion.output_dir",
        F.array_join("conversion.outputs", ",").alias("outputs"), map_text(F.col("versions")).alias("versions"))


@query(PLANNED + f"""SELECT backend, count(*) FILTER ({_STATUS} = 'converted') AS converted, count(*) FILTER ({_STATUS} = 'failed') AS failed,
  0::BIGINT AS missing, 0::BIGINT AS without_provenance, CASE WHEN count(*) FILTER ({_STATUS} = 'failed') > 0 THEN 1 ELSE 0 END AS code FROM planned GROUP BY backend""")
def run_summary(spark, sf):
    """The same run's counts and exit code per converter."""
    outcome, records = _run(spark, sf)
    noted = records.select("source.path", F.lit(True).alias("has_provenance"))
    rows = outcome.join(noted, "path", "left").withColumn("has_provenance", F.coalesce("has_provenance", F.lit(False)))
    return O.run_counts(rows, "backend")
