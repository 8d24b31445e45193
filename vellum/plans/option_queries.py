"""Options, page ranges, job sizes and redaction."""

from pyspark.sql import functions as F

from vellum import fixed
from vellum.functions import options as O, page_ranges as PR, records as R, redact
from vellum.operators import facts
from vellum.plans import inputs as I
from vellum.plans.registry import query

SETTINGS = O.model_config("Ollama ", base_url="http://models:11434/", model="gemma3")


@query("WITH " + I.PARSED_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, spec, ok, normalised, pages, error FROM parsed""")
def parse_page_range(spark, sf):
    return I.parsed_specs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "spec", "ok", "normalised", "pages", "error")


@query("WITH " + I.PARSED_SQL + """
SELECT l_linenumber, l_partkey, l_orderkey, normalised, pages FROM parsed""")
def range_size(spark, sf):
    return I.parsed_specs(spark, sf).select("l_linenumber", "l_partkey", "l_orderkey", "normalised",
                         PR.range_size(F.col("intervals")).alias("pages"))


# A document of `total` pages for each spec: gaps and islands over its distinct pages.
_SELECTED = "WITH " + I.PARSED_SQL + """,
totals AS (SELECT rid, l_partkey, l_orderkey, l_linenumber, spec, ok, quantity * 2 AS total FROM parsed),
kept AS (SELECT DISTINCT t.rid, p.page FROM totals t JOIN judged j USING (rid), LATERAL (SELECT unnest(range(j.lo, least(j.hi + 1, t.total::BIGINT))) AS page) p WHERE t.ok),
"""


@query(_SELECTED + """
runs AS (SELECT rid, min(page) AS a, max(page) AS b FROM (
    SELECT rid, page, page - row_number() OVER (PARTITION BY rid ORDER BY page) AS island FROM kept) GROUP BY rid, island),
cut AS (SELECT rid, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS clamped, sum(b - a + 1)::BIGINT AS n FROM runs GROUP BY rid)
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.spec, c.clamped, CASE WHEN t.ok THEN coalesce(c.n, 0) END::BIGINT AS n_pages FROM totals t LEFT JOIN cut c USING (rid)""")
def clamp_range(spark, sf):
    total = F.col("quantity") * 2
    return I.parsed_specs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "spec", PR.clamp_range(F.col("intervals"), total).alias("clamped"),
        PR.selected_count(F.col("intervals"), total).alias("n_pages"))


@query(_SELECTED + """
dummy AS (SELECT 1) SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.spec, k.page FROM totals t JOIN kept k USING (rid)""")
def page_select(spark, sf):
    """The chosen pages each document has, one row per page."""
    pages = PR.page_indices(F.col("intervals"), F.col("quantity") * 2)
    return I.parsed_specs(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "spec", F.explode(pages).alias("page"))


@query("WITH " + I.PAGES_SQL + ", " + I.PAGE_DOCS_SQL + """
SELECT DISTINCT p.doc, p.page, p.chars FROM doc_pages p JOIN page_docs d USING (doc)
WHERE (d.spec = '1-2,1,50' AND p.page IN (1, 2, 50)) OR (d.spec = '3-90' AND p.page BETWEEN 3 AND 90)""")
def range_pages_join(spark, sf):
    """Page rows of each document that fall in its range."""
    ranges = I.page_documents(spark, sf).where(F.col("spec").isNotNull()).select(
        "doc", PR.parse_page_range(F.col("spec")).intervals.alias("intervals"))
    return facts.select_pages(ranges, I.doc_pages(spark, sf))


_FORMATS = I.listed(fixed.OUTPUT_FORMATS)


@query("WITH " + I.OPTIONS_SQL + f"""
SELECT o_orderkey, fmt, CASE WHEN fmt IS NULL OR fmt NOT IN {_FORMATS} THEN 'output_format must be one of markdown, json, html, chunks' END AS error
FROM (SELECT o_orderkey, CASE WHEN json_valid(options) THEN json_extract_string(options, '$.output_format') END AS fmt FROM raw_options)""")
def validate_output_format(spark, sf):
    fmt = F.get_json_object("options", "$.output_format")
    return I.options_json(spark, sf).select("o_orderkey", fmt.alias("fmt"), O.output_format_error(fmt).alias("error"))


_CHECKED = "WITH " + I.OPTIONS_SQL + f""",
j AS (SELECT o_orderkey, CASE WHEN json_valid(options) THEN options::JSON END AS o FROM raw_options),
checked AS (SELECT *, CASE
    WHEN o IS NULL OR json_type(o) <> 'OBJECT' THEN 'options must be a dict'
    WHEN json_exists(o, '$.processors') THEN 'not an option this service takes: converter_cls, processors'
    WHEN json_type(o, '$.force_ocr') NOT IN ('BOOLEAN', 'NULL') THEN 'force_ocr must be a bool'
    WHEN o->>'$.output_format' NOT IN {_FORMATS} THEN 'output_format must be one of markdown, json, html, chunks'
    WHEN contains(o->>'$.page_range', ',,') THEN 'page_range has an empty element'
    WHEN MODEL THEN 'use_llm was requested but no LLM is configured' END AS error FROM j)
"""


@query(_CHECKED.replace("MODEL", "(o->>'$.use_llm') = 'true'") + """
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN o->>'$.output_format' END AS output_format,
  CASE WHEN error IS NULL THEN o->>'$.output_dir' END AS output_dir,
  CASE WHEN error IS NULL THEN (o->>'$.force_ocr')::BOOLEAN END AS force_ocr,
  CASE WHEN error IS NULL THEN trim(o->>'$.page_range') END AS page_range FROM checked""")
def validate_options(spark, sf):
    checked = I.options_json(spark, sf).withColumn("v", O.validate_options(F.col("options")))
    return checked.select("o_orderkey", "v.error", "v.output_format", "v.output_dir", "v.force_ocr", "v.page_range")


@query(_CHECKED.replace("MODEL", "false") + """
SELECT o_orderkey, CASE WHEN error IS NULL THEN
  concat_ws(',', 'force_ocr=' || (o->>'$.force_ocr'),
    CASE WHEN (o->>'$.use_llm') = 'true' THEN 'llm_service=marker.services.ollama.OllamaService,ollama_base_url=http://models:11434,ollama_model=gemma3' END,
    'output_dir=' || (o->>'$.output_dir'), 'output_format=' || (o->>'$.output_format'),
    'page_range=' || coalesce(trim(o->>'$.page_range'), ''), 'use_llm=' || (o->>'$.use_llm')) END AS resolved FROM checked""")
def model_options(spark, sf):
    """Accepted options as a conversion gets them, the deployment's model service merged in."""
    checked = I.options_json(spark, sf).select("o_orderkey", O.validate_options(F.col("options"), SETTINGS).alias("v"))
    return checked.select("o_orderkey", F.when(F.col("v.error").isNull(), R.map_text(F.col("v.resolved"))).alias("resolved"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'no options are taken, got: lang, page_range'
  WHEN 'view' THEN 'no options are taken, got: k' END AS error FROM events""")
def reject_options(spark, sf):
    kind = F.col("event_type")
    options = (F.when(kind == "click", F.create_map(F.lit("page_range"), F.lit("0"), F.lit("lang"), F.lit("x")))
               .when(kind == "view", F.from_json("props", "map<string,string>"))
               .when(kind == "error", F.expr("cast(map() as map<string,string>)")))
    return I.table(spark, sf, "events", "event_id", "event_type", "props").select(
        "event_id", O.reject_options(options).alias("error"))


_SIZED = "WITH " + I.PARSED_SQL + """,
sized AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'scan.PNG' WHEN 1 THEN 'book.pdf' ELSE 'report.docx' END AS name,
   CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN quantity * 3 END::BIGINT AS doc_pages FROM parsed)
"""


@query(_SIZED + """
SELECT l_orderkey, l_linenumber, l_partkey, spec, doc_pages, least(doc_pages, pages)::BIGINT AS job_pages, ok,
  coalesce(1800 + 180 * least(doc_pages, pages), 21600)::BIGINT AS timeout, coalesce(1800 + 180 * doc_pages, 21600)::BIGINT AS whole_timeout FROM sized""")
def job_timeout(spark, sf):
    """Pages a job converts and how long it may run, with its range and without."""
    k = F.col("l_partkey") % 3
    name = F.when(k == 0, F.lit("scan.PNG")).when(k == 1, F.lit("book.pdf")).otherwise(F.lit("report.docx"))
    known = facts.page_count(name, F.col("quantity") * 3)
    jobs = I.parsed_specs(spark, sf).withColumn("doc_pages", known)
    pages = R.job_pages(F.col("doc_pages"), F.col("pages"))
    return jobs.select("l_orderkey", "l_linenumber", "l_partkey", "spec", "ok", "doc_pages", pages.alias("job_pages"),
                       R.job_timeout(pages).alias("timeout"), R.job_timeout(F.col("doc_pages")).alias("whole_timeout"))


_URL = r"regexp_replace({}, '([A-Za-z][A-Za-z0-9+.-]*://)[^/?#\s]*@', '\1[redacted]@', 'g')"


@query(f"SELECT page_id, {_URL.format('raw')} AS clean FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://u:p@ss@') "
       "WHEN 1 THEN 'see ' || url || ' or http://tok@h/p?q=a@b' ELSE url END AS raw FROM pages)")
def redact_url(spark, sf):
    k, url = F.col("page_id") % 3, F.col("url")
    raw = (F.when(k == 0, F.replace(url, F.lit("://"), F.lit("://u:p@ss@")))
           .when(k == 1, F.concat(F.lit("see "), url, F.lit(" or http://tok@h/p?q=a@b"))).otherwise(url))
    return I.table(spark, sf, "pages", "page_id", "url").select("page_id", redact.redact_url(raw).alias("clean"))


@query(f"""SELECT page_id, {_URL.format("replace(url, '://', '://me@')")} AS base_url, '[redacted]' AS api_key, '[redacted]' AS auth, 'p' || page_id AS plain FROM pages""")
def redact_options(spark, sf):
    options = F.create_map(
        F.lit("openai_base_url"), F.replace("url", F.lit("://"), F.lit("://me@")),
        F.lit("LLM_API_KEY"), F.sha2("html", 256), F.lit("auth_Token"), F.col("url"),
        F.lit("output_format"), F.concat(F.lit("p"), "page_id"))
    clean = I.table(spark, sf, "pages").select("page_id", redact.redact_options(options).alias("o"))
    return clean.select("page_id", F.col("o.openai_base_url").alias("base_url"), F.col("o.LLM_API_KEY").alias("api_key"),
                        F.col("o.auth_Token").alias("auth"), F.col("o.output_format").alias("plain"))


@query("""SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN 'convert --openai_api_key [redacted] --lang ' || lang
  WHEN 1 THEN 'convert --client_secret=[redacted] /docs/token-list.pdf -o ' || source
  WHEN 2 THEN 'convert --x=https://[redacted]@host/' || source || ' --password [redacted] --after'
  ELSE 'convert --token-file [redacted] ' || lang END AS command FROM documents""")
def redact_argv(spark, sf):
    k, lang, src = F.col("doc_id") % 4, F.col("lang"), F.col("source")
    lit = F.lit
    argv = (F.when(k == 0, F.array(lit("convert"), lit("--openai_api_key"), F.concat(lit("sk-"), src), lit("--lang"), lang))
            .when(k == 1, F.array(lit("convert"), F.concat(lit("--client_secret=s="), src), lit("/docs/token-list.pdf"), lit("-o"), src))
            .when(k == 2, F.array(lit("convert"), F.concat(lit("--x=https://u:p@host/"), src), lit("--password"), lit("--key"), lit("--after")))
            .otherwise(F.array(lit("convert"), lit("--token-file"), lit("--token-file"), lang)))
    return I.table(spark, sf, "documents", "doc_id", "lang", "source").select(
        "doc_id", F.array_join(redact.redact_argv(argv), " ").alias("command"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    return I.table(spark, sf, "documents", "doc_id", "text").select("doc_id", R.content_hash(F.col("text")).alias("sha256"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS started,
  strftime(o_orderdate + to_milliseconds(o_custkey * 37 + 1), '%Y-%m-%dT%H:%M:%SZ') AS finished,
  round((o_custkey * 37 + 1) / 1000.0, 3)::DOUBLE AS seconds FROM orders""")
def utc_times(spark, sf):
    """Start and end as sidecars write them, and the seconds between."""
    started = F.col("o_orderdate").cast("timestamp")
    finished = F.timestamp_micros(F.unix_micros(started) + (F.col("o_custkey") * 37 + 1) * 1000)
    return I.table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", R.utc_iso(started).alias("started"), R.utc_iso(finished).alias("finished"),
        R.seconds_between(started, finished).alias("seconds"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 3 THEN 'base=http://h/v1?a=' || s_name || ',name=' || s_name END AS pairs,
  CASE WHEN s_suppkey % 5 = 3 THEN '--option wants KEY=VALUE, got ''' || s_name || '''' END AS error FROM supplier""")
def key_value_map(spark, sf):
    name = F.col("s_name")
    items = F.array(F.concat(F.lit("name=x"), name), F.concat(F.lit("base=http://h/v1?a="), name),
                    F.when(F.col("s_suppkey") % 5 == 3, name).otherwise(F.concat(F.lit("name="), name)))
    read = I.table(spark, sf, "supplier", "s_suppkey", "s_name").select("s_suppkey", R.pairs_map(items, "option").alias("p"))
    return read.select("s_suppkey", R.map_text(F.col("p.pairs")).alias("pairs"), F.col("p.error").alias("error"))


@query("""SELECT s_suppkey, 'marker-pdf=' || CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE '2.' || s_nationkey END
  || ',surya-ocr=absent,torch=2.1' AS versions FROM supplier""")
def versions_map(spark, sf):
    items = F.array(F.concat(F.lit("marker-pdf="), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("2."), "s_nationkey"))), F.lit("torch=2.1"), F.lit("other=9"))
    versions = R.versions_map(R.pairs_map(items, "version").pairs, fixed.BACKEND_PACKAGES[fixed.HEAVY])
    return I.table(spark, sf, "supplier").select("s_suppkey", R.map_text(versions).alias("versions"))


_FACTS = "WITH " + I.PAGES_SQL + ", " + I.PAGE_DOCS_SQL + """,
chosen AS (SELECT d.doc, p.page, p.chars, row_number() OVER (PARTITION BY d.doc ORDER BY p.page) AS rank
  FROM page_docs d JOIN doc_pages p USING (doc)
  WHERE d.spec IS NULL OR (d.spec = '1-2,1,50' AND p.page IN (1, 2, 50)) OR (d.spec = '3-90' AND p.page BETWEEN 3 AND 90)),
sums AS (SELECT doc, count(*) AS n_sel, sum(chars) FILTER (WHERE rank <= 3) AS chars FROM chosen GROUP BY doc)
"""


@query("WITH " + I.PAGES_SQL + """
SELECT doc, page, chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page)::INTEGER AS rank FROM doc_pages) WHERE rank <= 3""")
def first_pages(spark, sf):
    return facts.first_pages(I.doc_pages(spark, sf))


@query(_FACTS + """
SELECT d.doc, d.name, CASE WHEN suffix(d.name, '.PNG') THEN 1 WHEN suffix(d.name, '.pdf') THEN coalesce(s.n_sel, 0) END::BIGINT AS pages,
  CASE WHEN suffix(d.name, '.PNG') THEN 'ocr' WHEN d.force_ocr THEN 'ocr'
       WHEN suffix(d.name, '.pdf') THEN CASE WHEN coalesce(s.chars, 0) >= 50 THEN 'text' ELSE 'ocr' END END AS path
FROM page_docs d LEFT JOIN sums s USING (doc)""")
def text_layer_kind(spark, sf):
    docs = I.page_documents(spark, sf).select(
        "doc", "name", PR.parse_page_range(F.col("spec")).intervals.alias("intervals"), "force_ocr")
    return facts.text_layer(docs, I.doc_pages(spark, sf))


_NAMES = "WITH " + I.MANIFEST_SQL + ", " + I.names_sql() + "\n"


@query(_NAMES + """SELECT path, CASE WHEN fmt = 'png' THEN 1 WHEN fmt = 'pdf' THEN length // 500 + 1 END::BIGINT AS pages FROM m0""")
def page_count(spark, sf):
    return I.manifest(spark, sf).select("path", facts.page_count(F.col("name"), F.expr("length div 500 + 1")).alias("pages"))


@query(_NAMES + """SELECT path, CASE WHEN lang = 'de' THEN NULL ELSE length(text) END::BIGINT AS pdf_pages
FROM m0 WHERE fmt = 'pdf'""")
def probe_pages(spark, sf):
    """A pluggable reader counts each PDF from its whole body; one it cannot read is unknown."""
    def reader(body: bytes) -> int:
        text = body.decode("utf-8")
        if text.startswith("unreadable"):
            raise ValueError("not a PDF")
        return len(text)
    text = F.when(F.col("lang") == "de", F.concat(F.lit("unreadable"), "text")).otherwise(F.col("text"))
    docs = I.manifest(spark, sf, hashed=True).select("path", text.cast("binary").alias("content"))
    return facts.probe_pages(docs, reader)


