"""The inputs of the registered queries, derived from the given tables.

Each is written twice, for Spark and as DuckDB SQL, and covers its whole source table. A
path or an option is computed from a row's own columns, so the work grows with the data.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.functions import paths as P, page_ranges as PR

ROOT = "/data/input"
OUTPUT = "/data/output"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


# --- a manifest from documents -------------------------------------------------

_FORMATS = ["pdf", "docx", "HTML", "html", "png", "txt", "xlsx", "csv", "provenance.json", ""]


def _manifest_columns() -> tuple[Column, Column]:
    lone = F.col("doc_id") % 5 == 0
    stem = F.when(lone, F.concat(F.lit("u"), F.expr("doc_id div 10"))).otherwise(
        F.concat(F.when(F.col("lang") == "de", F.lit("Doc")).otherwise(F.lit("doc")), F.col("doc_id") % 97))
    ext = F.element_at(F.array(*[F.lit(f) for f in _FORMATS]), (F.expr("(doc_id div 3) % 10") + 1).cast("int"))
    name = F.concat(stem, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))
    below = (F.when(F.col("lang") == "es", F.lit("/converted")).when(F.col("lang") == "fr", F.lit("/a/b"))
             .otherwise(F.lit("")))
    folder = F.concat(F.lit(ROOT + "/"), F.when(lone, F.lit("shared")).otherwise(F.col("source")),
                      F.lit("/v"), F.expr("doc_id div 5000"), below)
    return F.concat(folder, F.lit("/"), name), name


def manifest(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    columns = ["doc_id", "lang", "source", "n_chars"] + (["text"] if hashed else [])
    path, name = _manifest_columns()
    docs = table(spark, sf_dir, "documents", *columns).withColumn("path", path).withColumn("name", name)
    kept = [F.col("path"), F.col("name"), F.col("n_chars").alias("length"), F.col("doc_id").alias("input_seq"), "lang"]
    return docs.select(*kept, *([F.sha2("text", 256).alias("sha256"), "text"] if hashed else []))


MANIFEST_SQL = """
manifest AS (
  SELECT folder || '/' || name AS path, name, n_chars AS length, doc_id AS input_seq, lang, text
  FROM (SELECT *, stem || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS name,
               '/data/input/' || CASE WHEN doc_id % 5 = 0 THEN 'shared' ELSE source END || '/v' || (doc_id // 5000)
               || CASE lang WHEN 'es' THEN '/converted' WHEN 'fr' THEN '/a/b' ELSE '' END AS folder
        FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'u' || (doc_id // 10)
                             ELSE CASE WHEN lang = 'de' THEN 'Doc' ELSE 'doc' END || (doc_id % 97) END AS stem,
                     ['pdf','docx','HTML','html','png','txt','xlsx','csv','provenance.json',''][((doc_id // 3) % 10)::INT + 1] AS ext
              FROM documents)))
"""

# splitext as two regular expressions, as the SQL side sees it
EXT_SQL = r"regexp_extract({n}, '^(\.*[^.].*)(\.[^.]*)$', 2)"
FORMAT_SQL = "lower(substr(" + EXT_SQL + ", 2))"


def names_sql(alias: str = "m0", source: str = "manifest") -> str:
    """CTE `m0`: the manifest with ext, fmt, stem, dir and rel."""
    ext = EXT_SQL.format(n="name")
    return f"""{alias} AS (
  SELECT *, lower(substr(ext, 2)) AS fmt, left(name, length(name) - length(ext)) AS stem,
         left(path, length(path) - length(name) - 1) AS dir, substr(path, 13) AS rel
  FROM (SELECT *, {ext} AS ext FROM {source}))"""


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- page-range specs from lineitem ---------------------------------------------

def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per line: mostly good, each tax rate breaking it in its own way."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_partkey")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    lo = F.col("l_partkey") % 40
    base = F.concat(n.cast("string"), F.lit(","), lo, F.lit("-"), lo + q)
    tax = F.round(F.col("l_tax") * 100).cast("int")
    spec = (F.when(tax == 0, F.concat(n, F.lit(","), lo + q, F.lit("-"), lo))
            .when(tax == 1, F.concat(base, F.lit(",")))
            .when(tax == 2, F.concat(base, F.lit(",0-999999999")))
            .when(tax == 3, F.concat(F.lit(" "), n, F.lit(" , 00"), lo, F.lit("-"), lo + q, F.lit("\t")))
            .when(tax == 4, F.concat(base, F.lit(",٣")))
            .when(tax == 5, F.concat(base, F.lit(",100-"), F.lit(100) + q * 50))
            .otherwise(base))
    # One row per line of an order; some orders of the tables repeat a line number.
    return items.select("l_orderkey", "l_linenumber", "l_partkey", spec.alias("spec"), q.alias("quantity"))


SPECS_SQL = """
specs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, q AS quantity,
    CASE tax WHEN 0 THEN l_linenumber || ',' || (lo + q) || '-' || lo
             WHEN 1 THEN base || ','
             WHEN 2 THEN base || ',0-999999999'
             WHEN 3 THEN ' ' || l_linenumber || ' , 00' || lo || '-' || (lo + q) || chr(9)
             WHEN 4 THEN base || ',٣'
             WHEN 5 THEN base || ',100-' || (100 + q * 50)
             ELSE base END AS spec
  FROM (SELECT *, l_linenumber || ',' || lo || '-' || (lo + q) AS base
        FROM (SELECT *, l_quantity::INT AS q, l_partkey % 40 AS lo, round(l_tax * 100)::INT AS tax FROM lineitem)))
"""

# A second reading of the page-range rules, over one row per element.
PARSED_SQL = SPECS_SQL + r""",
keyed AS (SELECT row_number() OVER () AS rid, * FROM specs),
items AS (
  SELECT rid, unnest(list_transform(string_split(trim(spec, ' ' || chr(9)), ','), lambda x: trim(x))) AS e,
         generate_subscripts(string_split(spec, ','), 1) AS k FROM keyed),
read AS (
  SELECT *, regexp_matches(e, '^[0-9]+(-[0-9]+)?$') AS good, contains(e, '-') AS is_range,
         CASE WHEN regexp_matches(e, '^[0-9]+(-[0-9]+)?$') THEN split_part(e, '-', 1)::BIGINT END AS lo,
         CASE WHEN regexp_matches(e, '^[0-9]+(-[0-9]+)?$')
              THEN (CASE WHEN contains(e, '-') THEN split_part(e, '-', 2) ELSE e END)::BIGINT END AS hi FROM items),
judged AS (
  SELECT *, sum(CASE WHEN good AND hi >= lo THEN hi - lo + 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS running FROM read),
faults AS (
  SELECT *, CASE WHEN e = '' THEN 'page_range has an empty element'
                 WHEN NOT good THEN 'page_range element ''' || e || ''' is not a page or a page range'
                 WHEN hi < lo THEN 'page_range element ''' || e || ''' counts backwards'
                 WHEN hi > 100000 THEN 'page_range element ''' || e || ''' is past the maximum page index 100000'
                 WHEN running > 2000 THEN 'page_range covers more than 2000 pages' END AS fault FROM judged),
verdict AS (
  SELECT rid, arg_min(fault, k) FILTER (WHERE fault IS NOT NULL) AS error,
         string_agg(CASE WHEN is_range THEN lo || '-' || hi ELSE lo::VARCHAR END, ',' ORDER BY k) AS text,
         sum(hi - lo + 1)::BIGINT AS pages FROM faults GROUP BY rid),
parsed AS (
  SELECT k.*, v.error IS NULL AS ok, CASE WHEN v.error IS NULL THEN v.text END AS normalised,
         CASE WHEN v.error IS NULL THEN v.pages END AS pages, v.error
  FROM keyed k JOIN verdict v USING (rid))
"""


def parsed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_specs(spark, sf_dir).withColumn("p", PR.parse_page_range(F.col("spec"))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "quantity", "spec", "p.*")


# --- options as JSON from orders ------------------------------------------------

def options_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    fmt = F.element_at(F.array(*[F.lit(f) for f in ("markdown", "json", "html", "chunks", "pdf", "MARKDOWN")]),
                       (F.col("o_custkey") % 6 + 1).cast("int"))
    day = F.dayofmonth("o_orderdate")
    text = F.concat(
        F.lit('{"output_format":"'), fmt, F.lit('"'),
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_custkey") % 10 == 0, F.lit(',"force_ocr":"yes"'))
               .otherwise(F.lit(',"force_ocr":true'))).otherwise(F.lit("")),
        F.when(F.col("o_orderstatus") == "P", F.lit(',"use_llm":true')).otherwise(F.lit(',"use_llm":false')),
        F.when(day > 20, F.lit(',"page_range":null')).when(day == 1, F.lit(',"page_range":"3,,4"'))
        .otherwise(F.concat(F.lit(',"page_range":" 0,'), day, F.lit("-"), day + 4, F.lit('"'))),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(',"processors":"x","converter_cls":1')).otherwise(F.lit("")),
        F.lit(',"output_dir":"/data/output/c'), F.col("o_custkey"), F.lit('"}'))
    raw = F.when(F.col("o_custkey") % 50 == 7, F.lit("[1]")).when(F.col("o_custkey") % 50 == 8, F.lit("{broken")).otherwise(text)
    return orders.select("o_orderkey", raw.alias("options"))


OPTIONS_SQL = """
raw_options AS (
  SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN '[1]' WHEN o_custkey % 50 = 8 THEN '{broken' ELSE
    '{"output_format":"' || ['markdown','json','html','chunks','pdf','MARKDOWN'][(o_custkey % 6)::INT + 1] || '"'
    || CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 10 = 0 THEN ',"force_ocr":"yes"' ELSE ',"force_ocr":true' END ELSE '' END
    || CASE WHEN o_orderstatus = 'P' THEN ',"use_llm":true' ELSE ',"use_llm":false' END
    || CASE WHEN day(o_orderdate) > 20 THEN ',"page_range":null' WHEN day(o_orderdate) = 1 THEN ',"page_range":"3,,4"'
            ELSE ',"page_range":" 0,' || day(o_orderdate) || '-' || (day(o_orderdate) + 4) || '"' END
    || CASE WHEN o_orderpriority = '1-URGENT' THEN ',"processors":"x","converter_cls":1' ELSE '' END
    || ',"output_dir":"/data/output/c' || o_custkey || '"}' END AS options
  FROM orders)
"""

# --- pages of documents from conversations --------------------------------------

def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length(P.strip(F.col("text")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"),
        F.when(F.col("conv_id") % 3 == 0, F.least(chars, F.lit(9))).otherwise(chars).alias("chars"))


PAGES_SQL = """
doc_pages AS (
  SELECT conv_id AS doc, turn AS page, CASE WHEN conv_id % 3 = 0 THEN least(chars, 9) ELSE chars END AS chars
  FROM (SELECT *, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8239) || chr(12288))) AS chars
        FROM conversations))
"""


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per conversation: its format, range and force flag from its own first turn."""
    conv = table(spark, sf_dir, "conversations", "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    d = F.col("conv_id")
    name = F.concat(F.lit("c"), d, F.when(d % 7 == 5, F.lit(".docx")).when(d % 7 == 6, F.lit(".PNG")).otherwise(F.lit(".pdf")))
    spec = F.when(d % 4 == 1, F.lit("1-2,1,50")).when(d % 4 == 2, F.lit("3-90"))
    return conv.select(d.alias("doc"), name.alias("name"), spec.alias("spec"),
                       (d % 11 == 0).alias("force_ocr"), "n")


PAGE_DOCS_SQL = """
page_docs AS (
  SELECT conv_id AS doc, 'c' || conv_id || CASE WHEN conv_id % 7 = 5 THEN '.docx' WHEN conv_id % 7 = 6 THEN '.PNG' ELSE '.pdf' END AS name,
         CASE WHEN conv_id % 4 = 1 THEN '1-2,1,50' WHEN conv_id % 4 = 2 THEN '3-90' END AS spec,
         conv_id % 11 = 0 AS force_ocr, count(*) AS n
  FROM conversations GROUP BY conv_id)
"""

# --- sidecars: what earlier runs recorded ---------------------------------------

def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per labelled document (two where it was converted twice), and records of sources now gone."""
    docs = manifest(spark, sf_dir, hashed=True)
    labels = table(spark, sf_dir, "labels", F.col("doc_id").alias("input_seq"), "quality", "toxic")
    twice = F.when(F.col("lang") == "en", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    have = docs.join(labels, "input_seq").withColumn("nth", F.explode(twice))
    old = (F.col("nth") == 1) | (F.col("quality") == 0)
    known = have.select(
        F.col("path"), F.when(old, F.sha2(F.concat("text", F.lit("old")), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.col("length").alias("bytes"), F.col("nth"),
        F.concat(F.lit(OUTPUT + "/o"), "input_seq").alias("output_dir"),
        F.when(F.col("toxic") == 1, F.lit("1.9.0")).otherwise(F.lit("2.0.0")).alias("version"),
        F.when(F.col("lang") == "fr", F.lit("json")).otherwise(F.lit("markdown")).alias("fmt"))
    gone = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit(ROOT + "/gone/"), "item_id", F.lit(".pdf")).alias("path"), F.sha2("text", 256).alias("sha256"),
        F.length("text").cast("bigint").alias("bytes"), F.lit(1).alias("nth"),
        F.concat(F.lit(OUTPUT + "/g"), "item_id").alias("output_dir"), F.lit("2.0.0").alias("version"),
        F.lit("markdown").alias("fmt"))
    return known.unionByName(gone)


SIDECARS_SQL = """
sidecars AS (
  SELECT m.path, CASE WHEN t.nth = 1 OR l.quality = 0 THEN sha256(m.text || 'old') ELSE sha256(m.text) END AS sha256,
         m.length AS bytes, t.nth, '/data/output/o' || m.input_seq AS output_dir,
         CASE WHEN l.toxic = 1 THEN '1.9.0' ELSE '2.0.0' END AS version,
         CASE WHEN m.lang = 'fr' THEN 'json' ELSE 'markdown' END AS fmt
  FROM manifest m JOIN labels l ON l.doc_id = m.input_seq
       JOIN (SELECT unnest([1, 2]) AS nth) t ON (m.lang = 'en' OR t.nth = 2)
  UNION ALL
  SELECT '/data/input/gone/' || item_id || '.pdf', sha256(text), length(text), 1, '/data/output/g' || item_id, '2.0.0', 'markdown'
  FROM benchmark)
"""


def sidecar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sidecars` in the record's nested shape, the second conversion later than the first."""
    s = sidecars(spark, sf_dir)
    day = F.concat(F.lit("2024-01-0"), "nth", F.lit("T00:00:00Z"))
    return s.select(
        F.struct(F.col("path"), F.col("sha256"), F.col("bytes")).alias("source"),
        F.struct(F.lit("marker").alias("backend"), day.alias("started"), day.alias("finished"),
                 F.col("output_dir"), F.col("fmt").alias("output_format")).alias("conversion"),
        F.create_map(F.lit("marker-pdf"), F.col("version"), F.lit("torch"), F.lit("2.1")).alias("versions"),
        F.create_map(F.lit("output_format"), F.col("fmt")).alias("options"))


# --- events: runs, jobs and their states ----------------------------------------

def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    kind = F.when(F.col("user_id") % 3 == 0, F.lit("text")).when(F.col("user_id") % 3 == 1, F.lit("ocr"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("d"), "user_id", F.when(F.col("user_id") % 5 == 4, F.lit(".docx")).otherwise(F.lit(".pdf"))).alias("file"),
        kind.alias("path"),
        F.when(kind.isNotNull(), F.get_json_object("props", "$.k").cast("int")).alias("pages"),
        F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("ok"))


RUNS_SQL = """
runs AS (
  SELECT event_id AS seq, 'd' || user_id || CASE WHEN user_id % 5 = 4 THEN '.docx' ELSE '.pdf' END AS file,
         CASE user_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'ocr' END AS path,
         CASE WHEN user_id % 3 < 2 THEN (props->>'$.k')::INT END AS pages,
         value AS seconds, round(value * 1000)::HUGEINT AS ms, event_type <> 'error' AS ok
  FROM events)
"""


def overhead_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path kind, cold samples from its dearest successful runs and a warm one from its cheapest."""
    runs = bench_runs(spark, sf_dir).where("ok")
    return runs.groupBy(F.coalesce("path", F.lit("unknown")).alias("path")).agg(
        F.array(F.max("seconds"), F.round(F.max("seconds") / 2, 2)).alias("cold_seconds"),
        F.min("seconds").alias("warm_seconds"))


SAMPLES_SQL = RUNS_SQL + """,
samples AS (
  SELECT coalesce(path, 'unknown') AS path, max(ms) AS c1, (round(max(seconds) / 2, 2) * 1000)::HUGEINT AS c2, min(ms) AS w,
         min(seconds) AS warm_seconds
  FROM runs WHERE ok GROUP BY 1)
"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def jobs(e: DataFrame) -> DataFrame:
    """Events as queued jobs, some of them none the intake would have made; a job's document is its props."""
    i = F.col("event_id")
    path = F.concat(F.lit(ROOT + "/u"), "user_id", F.lit("/e"), "event_id", F.lit(".pdf"))
    no = F.lit(None).cast("string")
    names = F.expr("cast(null as array<string>)")
    options = F.concat(
        F.lit('{"output_format":"'), F.when(i % 41 == 0, F.lit("pdf")).otherwise(F.lit("markdown")),
        F.lit('","output_dir":"'), F.when(i % 37 == 0, F.lit("/etc")).otherwise(F.lit(OUTPUT + "/x")), F.lit('"'),
        F.when(i % 43 == 0, F.lit(',"processors":"os.getcwd"')).otherwise(F.lit("")),
        F.when(i % 47 == 0, F.lit(',"page_range":"7-3"')).otherwise(F.lit(',"page_range":"0-1"')), F.lit("}"))
    return e.select(
        F.concat("user_id", F.lit("-"), "event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(i % 23 == 0, F.lit("os.system")).otherwise(F.lit("convert_document")).alias("func"),
        F.when(i % 19 == 0, F.lit(ROOT + "/../../etc/passwd")).otherwise(path).alias("path"),
        F.when(i % 53 == 0, no).otherwise(options).alias("options"),
        F.when(i % 59 == 0, F.create_map(F.lit("output_dir"), F.lit("/etc")))
        .when(i % 61 == 0, F.create_map(F.lit("input_root"), F.lit("/")))
        .otherwise(F.create_map(F.lit("input_root"), F.lit(ROOT))).alias("kwargs"),
        F.when(i % 29 == 0, F.lit("canary")).alias("callback"),
        F.when(i % 31 == 0, F.array(F.lit("http://h/x"))).otherwise(names).alias("webhooks"),
        F.when(i % 67 == 0, F.array(F.lit("j0"))).otherwise(names).alias("depends_on"),
        F.col("props").cast("binary").alias("content"))


JOBS_SQL = """
jobs AS (
  SELECT user_id || '-' || event_id AS job_id, event_id AS i, ts, user_id, props,
    CASE WHEN event_id % 19 = 0 THEN '/data/input/../../etc/passwd' ELSE '/data/input/u' || user_id || '/e' || event_id || '.pdf' END AS path,
    CASE WHEN event_id % 23 = 0 THEN 'names ''os.system'', not convert_document'
         WHEN event_id % 53 = 0 THEN 'arguments are not a path and an options dict'
         WHEN event_id % 59 = 0 THEN 'keyword arguments other than input_root'
         WHEN event_id % 29 = 0 THEN 'names a callback'
         WHEN event_id % 31 = 0 THEN 'carries webhooks'
         WHEN event_id % 67 = 0 THEN 'depends on other jobs'
         WHEN event_id % 19 = 0 THEN 'path outside /data/input'
         WHEN event_id % 61 = 0 THEN 'input_root outside /data/input'
         WHEN event_id % 37 = 0 THEN 'output_dir outside /data/output'
         WHEN event_id % 43 = 0 THEN 'options: not an option this service takes: processors'
         WHEN event_id % 41 = 0 THEN 'options: output_format must be one of markdown, json, html, chunks'
         WHEN event_id % 47 = 0 THEN 'options: page_range element ''7-3'' counts backwards' END AS refusal
  FROM events)
"""


def requests(e: DataFrame) -> DataFrame:
    """Events as request bodies: some leave fields out, some may not be queued."""
    i, kind = F.col("event_id"), F.col("event_type")
    body = F.concat(
        F.lit('{"path":"'), F.when(kind == "error", F.lit(ROOT + "/../secret/")).otherwise(F.lit(ROOT + "/")),
        F.lit("u"), "user_id", F.lit("/e"), i, F.lit('.pdf"'),
        F.when(kind == "click", F.when(F.col("value") < 5, F.lit(',"output_format":"pdf"')).otherwise(F.lit(',"output_format":"json"')))
        .otherwise(F.lit("")),
        F.when(kind == "view", F.concat(F.lit(',"page_range":" 0-'), F.get_json_object("props", "$.k"), F.lit('"'),
                                        F.when(F.col("value") < 5, F.lit(',"use_llm":true')).otherwise(F.lit(',"force_ocr":true'))))
        .otherwise(F.lit("")),
        F.when(kind == "signup", F.when(F.col("value") < 5, F.lit(',"output_dir":"/tmp"')).otherwise(F.lit(',"output_dir":"/data/output/x"')))
        .otherwise(F.lit("")), F.lit("}"))
    return e.select(F.concat(F.lit("r"), i).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))


REQUESTS_SQL = """
requests AS (
  SELECT 'r' || event_id AS job_id, event_type AS kind, value, (props->>'$.k')::INT AS k, '/data/input/u' || user_id || '/e' || event_id || '.pdf' AS path,
    CASE WHEN event_type = 'error' THEN 'path must be under /data/input'
         WHEN event_type = 'signup' AND value < 5 THEN 'output_dir must be under /data/output'
         WHEN event_type = 'click' AND value < 5 THEN 'output_format must be one of markdown, json, html, chunks'
         WHEN event_type = 'view' AND value < 5 THEN 'use_llm was requested but no LLM is configured' END AS error
  FROM events),
taken AS (
  SELECT job_id, error, CASE WHEN error IS NULL THEN path END AS path,
    CASE WHEN error IS NULL THEN CASE kind WHEN 'view' THEN 1800 + 180 * (k + 1) ELSE 21600 END END::BIGINT AS timeout,
    CASE WHEN error IS NULL THEN '{"output_format":"' || CASE kind WHEN 'click' THEN 'json' ELSE 'markdown' END
      || '","output_dir":"/data/output' || CASE kind WHEN 'signup' THEN '/x' ELSE '' END || '"'
      || CASE kind WHEN 'view' THEN ',"force_ocr":true,"page_range":"0-' || k || '"' ELSE '' END || '}' END AS options
  FROM requests)
"""


def job_events(e: DataFrame) -> DataFrame:
    """State changes of one job per user."""
    status = (F.when(F.col("event_type") == "signup", F.lit("queued")).when(F.col("event_type") == "view", F.lit("started"))
              .when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("finished")))
    return e.select(
        F.concat(F.lit("j"), "user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), status.alias("status"),
        F.when(status == "finished", F.concat(F.lit(OUTPUT + "/e"), "event_id")).alias("result"),
        F.when(status == "failed", F.concat(F.lit("Traceback "), "event_id")).alias("error"))


JOB_EVENTS_SQL = """
job_events AS (
  SELECT 'j' || user_id AS job_id, ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'finished' END AS status,
         CASE WHEN event_type NOT IN ('signup', 'view', 'error') THEN '/data/output/e' || event_id END AS result
  FROM events)
"""
