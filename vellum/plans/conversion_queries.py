"""Conversion, text formats, and documents written to and read from storage."""

from pyspark.sql import functions as F

from vellum import fixed, session
from vellum.functions import paths as P
from vellum.operators import blocks as B, convert as U, corpus as C
from vellum.plans import inputs as I
from vellum.plans.corpus_queries import BASE as NAMES, _HEAVY_STEMS, heavy_named
from vellum.plans.registry import query
from vellum.sinks import files as K
from vellum.sources import tables as T, tree


def refusing(data: bytes, name: str, options: dict, resources) -> tuple[dict, dict]:
    """A stand-in converter: whole text under a heading, except names it refuses."""
    if "boom" in name:
        raise RuntimeError(f"refusing {name}")
    stem = name.rsplit(".", 1)[0] or "document"
    body = f"# {resources['heading']} {name}\n".encode() + data
    return {f"{stem}.md": body, fixed.SIDECAR_NAME: b"{}"}, {"stand-in": resources["version"]}


def load_refusing() -> dict:
    return {"heading": "converted", "version": "1.0"}


def _documents(spark, sf):
    """Every document as bytes; the German ones have a name the converter refuses."""
    name = F.concat(F.when(F.col("lang") == "de", F.lit("../boom ")).otherwise(F.lit("a\\b\\")), F.lit("d"), "doc_id", F.lit(".txt"))
    docs = I.table(spark, sf, "documents", "doc_id", "lang", "text")
    return T.read_bytes(docs, name, F.col("text"), F.concat(F.lit(I.ROOT + "/d"), "doc_id"))


_CONVERTED = """
SELECT '/data/input/d' || doc_id AS path, lang <> 'de' AS ok, CASE WHEN lang = 'de' THEN 'RuntimeError: refusing boom d' || doc_id || '.txt' END AS error,
  CASE WHEN lang <> 'de' THEN 'd' || doc_id || '.md' END AS file, CASE WHEN lang <> 'de' THEN sha256('# converted d' || doc_id || '.txt' || chr(10) || text) END AS sha256,
  CASE WHEN lang <> 'de' THEN 'stand-in=1.0' ELSE '' END AS versions FROM documents"""


def _summary(converted):
    from vellum.functions.records import map_text
    first = F.try_element_at("files", F.lit(1))
    return converted.select("path", "ok", "error", first["name"].alias("file"), F.sha2(first["body"], 256).alias("sha256"),
                            map_text(F.col("versions")).alias("versions"))


@query(_CONVERTED)
def convert_documents(spark, sf):
    """Bytes in, files out; a document that fails is a row with its error."""
    session.limit_batches(spark)
    return _summary(U.convert_documents(_documents(spark, sf), "stand-in", refusing, load_refusing))


@query(_CONVERTED)
def convert_with_deadlines(spark, sf):
    """The same, each document in a process that is ended at the document's own timeout."""
    session.limit_batches(spark)
    docs = _documents(spark, sf).withColumn("timeout", F.lit(fixed.JOB_TIMEOUT_BASE).cast("bigint"))
    return _summary(U.convert_documents(docs, "stand-in", refusing, load_refusing, deadlines=True))


_BLOCK_TAGS = B._BLOCK_TAGS
_BLOCKS = rf"""
WITH t1 AS (SELECT page_id, regexp_replace(translate(html, chr(30) || chr(31), ''), '(?is)<!--.*?-->|<![^>]*>|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g') AS h FROM pages),
t2 AS (SELECT page_id, regexp_replace(regexp_replace(h, '[\s\x0b]+', ' ', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g') AS h FROM t1),
t3 AS (SELECT page_id, regexp_replace(h, '(?i)<(/?)({_BLOCK_TAGS})(?:[\s/][^>]*)?>', chr(30) || '\1\2' || chr(31), 'g') AS h FROM t2),
t4 AS (SELECT page_id, unnest(string_split(h, chr(30))) AS p, generate_subscripts(string_split(h, chr(30)), 1) AS k FROM t3),
t5 AS (SELECT page_id, k, CASE WHEN contains(p, chr(31)) THEN lower(split_part(p, chr(31), 1)) ELSE '' END AS tag,
       regexp_replace(CASE WHEN contains(p, chr(31)) THEN split_part(p, chr(31), 2) ELSE p END, '<[^>]*>', '', 'g') AS raw FROM t4),
t6 AS (SELECT *, trim(replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
       ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM t5),
blocks AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS block_no,
  CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'title' THEN 'title' WHEN tag = 'p' THEN 'paragraph'
       WHEN tag = 'li' THEN 'item' WHEN tag IN ('td', 'th') THEN 'cell' ELSE 'text' END AS kind,
  CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2)::INTEGER ELSE 0 END AS level, text FROM t6 WHERE text <> '')
"""


def _pages(spark, sf):
    pages = I.table(spark, sf, "pages", "page_id", "html").select(
        "page_id", F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("name"), F.col("html").alias("text"))
    return B.with_blocks(pages, ["html"])


@query(_BLOCKS + "SELECT page_id, block_no, kind, level, text FROM blocks")
def html_blocks(spark, sf):
    """Every page as rows of blocks: the `chunks` format."""
    return B.as_chunks(_pages(spark, sf), "page_id")


@query(_BLOCKS + """SELECT page_id, string_agg(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'item' THEN '* ' || text ELSE text END,
  chr(10) || chr(10) ORDER BY block_no) AS body FROM blocks GROUP BY page_id""")
def render_markdown(spark, sf):
    return _pages(spark, sf).select("page_id", B.render(F.col("blocks"), F.lit("markdown")).alias("body"))


@query(_BLOCKS + """SELECT page_id, string_agg('<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>', chr(10) ORDER BY block_no) AS body
FROM (SELECT *, CASE kind WHEN 'heading' THEN 'h' || level WHEN 'item' THEN 'li' ELSE 'p' END AS tag FROM blocks) GROUP BY page_id""")
def render_html(spark, sf):
    return _pages(spark, sf).select("page_id", B.render(F.col("blocks"), F.lit("html")).alias("body"))


@query(_BLOCKS + """SELECT page_id, string_agg(kind || level || text, '|' ORDER BY block_no) AS body FROM blocks GROUP BY page_id""")
def render_json(spark, sf):
    """Blocks as JSON, read back."""
    body = _pages(spark, sf).select("page_id", B.render(F.col("blocks"), F.lit("json")).alias("body"))
    read = F.from_json("body", B.BLOCKS)
    return body.select("page_id", F.array_join(F.transform(read, lambda b: F.concat(b.kind, b.level, b.text)), "|").alias("body"))


@query("""
SELECT 'p' || p_partkey || '.csv' AS name, unnest([0, 1, 2])::INTEGER AS block_no, unnest(['header', 'row', 'row']) AS kind,
  unnest(['name | brand', p_name || ', "big" | ' || p_brand, p_type || chr(10) || 'x | ' || p_size]) AS text FROM part
UNION ALL SELECT 'e' || event_id || '.json', 0, 'code', props FROM events
UNION ALL SELECT 'c' || c_custkey || '.xml', 0, 'code', '<c name="' || c_name || '">' || c_mktsegment || '</c>' FROM customer""")
def text_blocks(spark, sf):
    """CSV, JSON and XML documents as blocks."""
    part = I.table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey", F.lit(".csv")).alias("name"),
        F.concat(F.lit('name,brand\r\n"'), "p_name", F.lit(', ""big""",'), "p_brand", F.lit('\r\n"'), "p_type", F.lit('\nx",'),
                 "p_size", F.lit("\r\n")).alias("text"))
    events = I.table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("name"), F.col("props").alias("text"))
    people = I.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey", F.lit(".xml")).alias("name"),
        F.concat(F.lit('<c name="'), "c_name", F.lit('">'), "c_mktsegment", F.lit("</c>")).alias("text"))
    csv = B.with_blocks(part, ["csv"])
    rest = B.with_blocks(events.unionByName(people), ["json", "xml"])
    return B.as_chunks(csv.select("name", "blocks").unionByName(rest.select("name", "blocks")), "name").select(
        "name", "block_no", "kind", "text")


@query("SELECT url AS name, octet_length(encode(html))::INTEGER AS bytes, sha256(html) AS sha256 FROM pages")
def read_bytes(spark, sf):
    """Pages as documents handed over in bytes."""
    docs = T.read_bytes(I.table(spark, sf, "pages", "url", "html"), F.col("url"), F.col("html"))
    return docs.select("name", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(_HEAVY_STEMS + """, c AS (SELECT n.*, m.text, m.name, count(*) OVER (PARTITION BY lower(output_name)) AS rows FROM named n JOIN m0 m USING (path))
SELECT path, output_name || '/' || CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END || '.md' AS rel,
  sha256('# converted ' || name || chr(10) || text) AS sha256 FROM c WHERE rows = 1""".replace("\\\\", "\\"))
def write_outputs(spark, sf):
    """Documents converted under their output names and written as a table; clashing names are refused."""
    from vellum.operators.naming import name_clashes
    session.limit_batches(spark)
    named = session.written(heavy_named(spark, sf).select("path", "output_name"), "named")
    checked = session.written(name_clashes(named), "checked")
    clashes = session.written(checked.where("clash").select("path"), "clashes")
    docs = I.manifest(spark, sf, hashed=True).where(
        C.supported(F.col("name"), fixed.HEAVY_FORMATS) & ~P.is_sidecar(F.col("name"))).select(
        "path", "name", F.col("text").cast("binary").alias("content"))
    converted = U.convert_documents(docs.join(clashes, "path", "left_anti"), "stand-in", refusing, load_refusing)
    folder = session.fresh_folder(spark, "outputs")
    K.write_outputs(converted, checked.where("not clash"), folder)
    return K.read_outputs(spark, folder).select("path", "rel", F.sha2("body", 256).alias("sha256"))


# A tree written from the pages: some in clutter, some hidden, some too deep, some output.
_TREE = """WITH tree AS (SELECT html, CASE page_id % 6 WHEN 0 THEN 'a/_p' || page_id || '.HTML' WHEN 1 THEN '.p' || page_id || '.html'
  WHEN 2 THEN 'a/b/c/p' || page_id || '.html' WHEN 3 THEN 'a/node_modules/p' || page_id || '.html' WHEN 4 THEN 'out/p' || page_id || '.png'
  ELSE 'b b/p' || page_id || '.html.provenance.json' END AS rel, page_id % 6 AS k FROM pages)
"""


def _tree(spark, sf):
    p, k = F.col("page_id"), F.col("page_id") % 6
    rel = (F.when(k == 0, F.concat(F.lit("a/_p"), p, F.lit(".HTML"))).when(k == 1, F.concat(F.lit(".p"), p, F.lit(".html")))
           .when(k == 2, F.concat(F.lit("a/b/c/p"), p, F.lit(".html"))).when(k == 3, F.concat(F.lit("a/node_modules/p"), p, F.lit(".html")))
           .when(k == 4, F.concat(F.lit("out/p"), p, F.lit(".png"))).otherwise(F.concat(F.lit("b b/p"), p, F.lit(".html.provenance.json"))))
    root = session.fresh_folder(spark, "tree")
    K.export_files(I.table(spark, sf, "pages", "page_id", "html").select(rel.alias("rel"), F.col("html").alias("body")), root)
    return root


def _below(listed, root):
    base = tree.open_store(root)[1]
    return listed.select(P.relative_to(F.col("path"), base).alias("rel"), "name", "length")


@query(_TREE + "SELECT rel, regexp_extract(rel, '[^/]*$') AS name, octet_length(encode(html))::BIGINT AS length FROM tree WHERE k IN (0, 1)")
def scan_corpus(spark, sf):
    """Pages written as files, then listed by the data source: three levels, no clutter, no output folder."""
    root = _tree(spark, sf)
    return _below(tree.scan_corpus(spark, root, fixed.LIGHT_FORMATS, skip=[root + "/out"]), root)


@query(_TREE + "SELECT rel, regexp_extract(rel, '[^/]*$') AS name, octet_length(encode(html))::BIGINT AS length FROM tree WHERE k <= 3")
def walk_batch(spark, sf):
    """The bulk walk of the same tree: every level, tool folders too, not the output folder."""
    root = _tree(spark, sf)
    return _below(tree.walk_batch(spark, root, root + "/out"), root)


@query("WITH " + I.MANIFEST_SQL + """
SELECT path, sha256(text) AS sha256, '/data/output/o' || input_seq AS output_dir FROM manifest""")
def write_provenance(spark, sf):
    """Records appended to a table and exported as sidecar files, the files read back and matched."""
    from vellum.plans.provenance_queries import records
    held = records(spark, sf)
    table = session.fresh_folder(spark, "provenance")
    K.write_provenance(held, table)
    stored = spark.read.parquet(table)
    root = session.fresh_folder(spark, "sidecars")
    sidecars = K.sidecar_rows(stored, F.substring_index("conversion.output_dir", "/", -1))
    K.export_files(sidecars, root)
    # Only those in a folder of their own.
    files = T.read_sidecars_by_name(sidecars.where(F.col("rel").contains("/")), root)
    mine = stored.select("source.path", "source.sha256", "conversion.output_dir")
    return mine.join(files.select("source.path", "source.sha256"), ["path", "sha256"])


@query("""SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS documents FROM events GROUP BY 1""")
def write_report(spark, sf):
    """Outcome counts written as a JSON report and read back."""
    counts = I.table(spark, sf, "events", "event_type").groupBy(
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("documents"))
    folder = session.fresh_folder(spark, "report")
    K.write_report(counts.select(F.to_json(F.struct("outcome", "documents")).alias("report")), folder)
    return spark.read.schema("outcome string, documents bigint").json(folder)


@query(NAMES + f"""SELECT path, CASE WHEN fmt IN {I.listed(fixed.ROUTED_HEAVY_FORMATS)} THEN 'marker' ELSE 'markitdown' END AS backend,
  (1 + length // 500)::BIGINT AS pages FROM m0""")
def spread_by_cost(spark, sf):
    """Documents spread over tasks by their pages, none lost on the way."""
    docs = I.manifest(spark, sf).select("path", C.route(F.col("name")).alias("backend"), F.expr("1 + length div 500").alias("pages"))
    return U.spread_by_cost(docs, "pages", "path", per_task=500)


