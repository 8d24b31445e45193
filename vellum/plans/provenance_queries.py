"""Provenance records and what they decide: stale, duplicate, fresh, to be converted again."""

from pyspark.sql import functions as F

from vellum import fixed
from vellum.functions import records as R
from vellum.operators import provenance as V
from vellum.plans import inputs as I
from vellum.plans.registry import query
from vellum.sinks import files as K
from vellum.sources import tables as T

BASE = "WITH " + I.MANIFEST_SQL + ", " + I.SIDECARS_SQL


def _documents(spark, sf):
    """Every document as a finished conversion."""
    docs = I.manifest(spark, sf, hashed=True)
    started = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("input_seq"))
    return docs.select(
        "path", "sha256", F.col("length").alias("bytes"), F.timestamp_seconds(F.col("length") * 1000).alias("modified"),
        F.lit(fixed.HEAVY).alias("backend"), started.alias("started"),
        F.timestamp_millis(F.unix_millis(started) + F.col("length") * 7).alias("finished"),
        F.when(F.col("lang") == "fr", F.lit("json")).alias("output_format"),
        F.array(F.lit("convert"), F.lit("--api_key"), F.col("lang"), F.col("path")).alias("command"),
        F.concat(F.lit(I.OUTPUT + "/o"), "input_seq").alias("output_dir"),
        F.array(F.lit("z.md"), F.lit("a.json")).alias("outputs"),
        F.create_map(F.lit("torch"), F.lit("2.1")).alias("versions"),
        F.create_map(F.lit("api_key"), F.col("lang"), F.lit("output_format"), F.lit("html")).alias("options"))


def records(spark, sf):
    return V.provenance_record(_documents(spark, sf), I.ROOT)


@query("WITH " + I.MANIFEST_SQL + """
SELECT 'vellum/provenance/1' AS schema, path, substr(path, 13) AS relative_path, sha256(text) AS sha256, length AS bytes,
  strftime(make_timestamp(length * 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified, 'marker' AS backend,
  strftime(make_timestamp((1700000000 + input_seq) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started,
  strftime(make_timestamp((1700000000 + input_seq) * 1000000 + length * 7000), '%Y-%m-%dT%H:%M:%SZ') AS finished,
  round(length * 7 / 1000.0, 3)::DOUBLE AS seconds, CASE WHEN lang = 'fr' THEN 'json' ELSE 'html' END AS output_format,
  'convert --api_key [redacted] ' || path AS command, '/data/output/o' || input_seq AS output_dir, 'a.json,z.md' AS outputs,
  'torch=2.1' AS versions, 'api_key=[redacted],output_format=html' AS options FROM manifest""")
def provenance_record(spark, sf):
    return records(spark, sf).select(
        "schema", "source.path", "source.relative_path", "source.sha256", "source.bytes", "source.modified",
        "conversion.backend", "conversion.started", "conversion.finished", "conversion.seconds",
        "conversion.output_format", F.array_join("conversion.command", " ").alias("command"), "conversion.output_dir",
        F.array_join("conversion.outputs", ",").alias("outputs"), R.map_text(F.col("versions")).alias("versions"),
        R.map_text(F.col("options")).alias("options"))


@query("WITH " + I.MANIFEST_SQL + """
SELECT 'o' || input_seq || '/' || CASE WHEN lang = 'de' THEN name || '.md.' ELSE '' END || 'provenance.json' AS rel,
  path, sha256(text) AS sha256, length AS bytes, 2 AS indent, true AS newline FROM manifest""")
def sidecar_files(spark, sf):
    """Sidecars as text, in a document's own folder or named after a shared folder's output, read back."""
    held = records(spark, sf)
    named = held.withColumn("_name", F.substring_index("source.path", "/", -1))
    own = F.substring_index("conversion.output_dir", "/", -1)
    docs = I.manifest(spark, sf).select(F.col("path").alias("p"), "lang")
    named = named.join(docs, named["source.path"] == docs["p"]).drop("p")
    german = F.col("lang") == "de"
    name = F.when(german, F.concat("_name", F.lit(".md"), F.lit(fixed.SIDECAR_SUFFIX))).otherwise(F.lit(fixed.SIDECAR_NAME))
    texts = K.sidecar_rows(named, own, name).withColumn("text", F.col("body"))
    read = T.parse_sidecars(texts)
    return read.select("rel", "source.path", "source.sha256", "source.bytes",
                       (F.length(F.regexp_extract("text", r"^\{\n( +)", 1))).alias("indent"),
                       F.col("text").endswith("}\n").alias("newline"))


@query(BASE + """
SELECT output_dir, path, sha256, nth FROM (SELECT *, row_number() OVER (PARTITION BY output_dir ORDER BY nth DESC) AS rn FROM sidecars) WHERE rn = 1""")
def latest_sidecar(spark, sf):
    newest = V.latest_sidecars(I.sidecar_records(spark, sf), F.col("conversion.output_dir"))
    return newest.select("conversion.output_dir", "source.path", "source.sha256",
                         F.substring("conversion.finished", 10, 1).cast("int").alias("nth"))


@query(BASE + """,
latest AS (SELECT * FROM sidecars QUALIFY row_number() OVER (PARTITION BY path ORDER BY nth DESC) = 1)
SELECT coalesce(m.path, s.path) AS path, s.output_dir, CASE WHEN m.path IS NULL THEN 'gone' WHEN s.path IS NULL THEN 'new'
  WHEN s.sha256 <> sha256(m.text) THEN 'source_changed' WHEN s.version <> '2.0.0' THEN 'version_changed'
  WHEN s.fmt <> 'markdown' THEN 'option_changed' ELSE 'unchanged' END AS status
FROM manifest m FULL JOIN latest s ON s.path = m.path""")
def reconvert_diff(spark, sf):
    wanted = I.manifest(spark, sf, hashed=True).select(
        "path", "sha256", F.create_map(F.lit("torch"), F.lit("2.1"), F.lit("marker-pdf"), F.lit("2.0.0")).alias("versions"),
        F.create_map(F.lit("output_format"), F.lit("markdown")).alias("options"))
    return V.reconvert_diff(wanted, I.sidecar_records(spark, sf))


@query("WITH " + I.MANIFEST_SQL + """,
found AS (SELECT path AS source_path, '/data/output/k' || k || '_' || input_seq AS folder, CASE WHEN k = 2 THEN 'markitdown' ELSE 'marker' END AS backend
  FROM manifest, (SELECT unnest([0, 1, 2]) AS k)
  UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN (SELECT path FROM manifest WHERE input_seq = 0) ELSE '/elsewhere/' || item_id END, '/data/output/b' || item_id, 'marker' FROM benchmark)
SELECT f.folder, f.source_path, '/data/output/k0_' || m.input_seq AS kept_as FROM found f JOIN manifest m ON m.path = f.source_path
WHERE f.backend = 'marker' AND f.folder <> '/data/output/k0_' || m.input_seq""")
def drop_duplicates(spark, sf):
    """Stale output folders: copies of sources of this run; one source has many."""
    docs = I.manifest(spark, sf).select("path", "input_seq")
    found = docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat(F.lit(I.OUTPUT + "/k"), "k", F.lit("_"), "input_seq").alias("folder"), F.col("path").alias("source_path"),
        F.when(F.col("k") == 2, F.lit(fixed.LIGHT)).otherwise(F.lit(fixed.HEAVY)).alias("backend"))
    of_first = F.when(F.col("item_id") % 2 == 0, F.lit(0)).cast("bigint")
    copies = I.table(spark, sf, "benchmark", "item_id").withColumn("input_seq", of_first).join(
        docs, "input_seq", "left").select(
        F.concat(F.lit(I.OUTPUT + "/b"), "item_id").alias("folder"),
        F.coalesce("path", F.concat(F.lit("/elsewhere/"), "item_id")).alias("source_path"),
        F.lit(fixed.HEAVY).alias("backend"))
    own = docs.select(F.col("path").alias("source_path"), F.concat(F.lit(I.OUTPUT + "/k0_"), "input_seq").alias("folder"))
    return V.drop_duplicates(found.unionByName(copies), own)


_FRESH = """
WITH files AS (SELECT 'u' || user_id AS folder, ts AS modified FROM events),
f AS (SELECT folder, max(modified) AS newest FROM files GROUP BY folder)
"""


def _fresh(spark, sf):
    files = I.table(spark, sf, "events", "user_id", "ts").select(
        F.concat(F.lit("u"), "user_id").alias("folder"), F.col("ts").cast("timestamp").alias("modified"))
    return V.is_fresh(files, F.to_timestamp(F.lit("2024-01-30 12:00:00")))


@query(_FRESH + "SELECT folder, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest, newest >= TIMESTAMP '2024-01-30 12:00:00' AS fresh FROM f")
def is_fresh(spark, sf):
    return _fresh(spark, sf).select("folder", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "fresh")


def _skip_sql(stale: str, why: str) -> str:
    return _FRESH + f"""
SELECT c_custkey, 'u' || (c_custkey % 200) AS folder, CASE WHEN f.folder IS NULL THEN 'failed' WHEN newest >= TIMESTAMP '2024-01-30 12:00:00' THEN 'converted' ELSE '{stale}' END AS status,
  CASE WHEN f.folder IS NULL THEN 'no output folder was written' WHEN newest < TIMESTAMP '2024-01-30 12:00:00' THEN '{why}' END AS reason
FROM customer LEFT JOIN f ON f.folder = 'u' || (c_custkey % 200)"""


def _outcomes(spark, sf, skip):
    docs = I.table(spark, sf, "customer", "c_custkey").withColumn("folder", F.concat(F.lit("u"), F.col("c_custkey") % 200))
    return V.conversion_status(docs, _fresh(spark, sf), skip)


@query(_skip_sql("failed", "the folder is from an earlier run"))
def conversion_status(spark, sf):
    return _outcomes(spark, sf, False)


@query(_skip_sql("skipped", "already converted"))
def skip_existing(spark, sf):
    return _outcomes(spark, sf, True)


@query("WITH " + I.MANIFEST_SQL + """
SELECT lang AS folder, name, path FROM manifest WHERE NOT (name = 'provenance.json' OR suffix(name, '.provenance.json'))""")
def outputs_of(spark, sf):
    listed = I.manifest(spark, sf).select(F.col("lang").alias("folder"), "name", "path")
    return V.outputs_of(listed)
