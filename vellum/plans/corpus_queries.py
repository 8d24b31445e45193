"""Names, filters, routing and output names over the corpus."""

from pyspark.sql import functions as F

from vellum import fixed
from vellum.functions import paths as P
from vellum.operators import corpus as C, naming as N, report as R
from vellum.plans import inputs as I
from vellum.plans.registry import query
from vellum.session import written

BASE = "WITH " + I.MANIFEST_SQL + ", " + I.names_sql() + "\n"
HEAVY, LIGHT, BATCH = (I.listed(f) for f in (fixed.HEAVY_FORMATS, fixed.LIGHT_FORMATS, fixed.BATCH_FORMATS))
ROUTED = I.listed(fixed.ROUTED_HEAVY_FORMATS)
SIDECAR = "(name = 'provenance.json' OR suffix(name, '.provenance.json'))"
CLUTTER = "len(list_intersect(string_split(rel, '/')[:-2], ['node_modules','.git','converted','marker-output','markitdown-output'])) > 0"


@query(BASE + "SELECT path, ext, stem, fmt FROM m0")
def ext_stem(spark, sf):
    name = F.col("name")
    return I.manifest(spark, sf).select("path", P.ext(name).alias("ext"), P.stem(name).alias("stem"),
                                        P.file_format(name).alias("fmt"))


@query(r"""
WITH u AS (SELECT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS name FROM pages)
SELECT url, name, regexp_extract(name, '^(\.*[^.].*)(\.[^.]*)$', 2) AS ext,
       left(name, length(name) - length(regexp_extract(name, '^(\.*[^.].*)(\.[^.]*)$', 2))) AS stem FROM u""")
def url_names(spark, sf):
    name = P.basename(F.regexp_replace("url", "[?#].*$", ""))
    return I.table(spark, sf, "pages", "url").select("url", name.alias("name"), P.ext(name).alias("ext"),
                                                     P.stem(name).alias("stem"))


@query(BASE + f"SELECT path, fmt IN {HEAVY} AS heavy, fmt IN {LIGHT} AS light, fmt IN {BATCH} AS batch FROM m0")
def supported(spark, sf):
    name = F.col("name")
    return I.manifest(spark, sf).select(
        "path", C.supported(name, fixed.HEAVY_FORMATS).alias("heavy"),
        C.supported(name, fixed.LIGHT_FORMATS).alias("light"), C.supported(name, fixed.BATCH_FORMATS).alias("batch"))


@query(BASE + """SELECT path, levels <= 1 AS at_0, levels <= 1 AS at_1, levels <= 3 AS at_3, levels <= 5 AS at_5
FROM (SELECT path, length(rel) - length(replace(rel, '/', '')) + 1 AS levels FROM m0)""")
def depth_filter(spark, sf):
    rel = P.relative_to(F.col("path"), I.ROOT)
    return I.manifest(spark, sf).select("path", *[C.within_depth(rel, d).alias(f"at_{d}") for d in (0, 1, 3, 5)])


@query(BASE + f"SELECT path FROM m0 WHERE NOT ({CLUTTER})")
def clutter_filter(spark, sf):
    return I.manifest(spark, sf).where(~C.in_clutter(P.relative_to(F.col("path"), I.ROOT))).select("path")


@query(BASE + "SELECT path FROM m0 WHERE NOT starts_with(path, '/data/input/shared/')")
def exclude_output(spark, sf):
    return I.manifest(spark, sf).where(~P.under(F.col("path"), I.ROOT + "/shared")).select("path")


@query(BASE + f"SELECT path, {SIDECAR} AS sidecar FROM m0")
def is_sidecar(spark, sf):
    return I.manifest(spark, sf).select("path", P.is_sidecar(F.col("name")).alias("sidecar"))


@query(BASE + f"SELECT path, CASE WHEN fmt IN {ROUTED} THEN 'marker' ELSE 'markitdown' END AS backend FROM m0")
def route(spark, sf):
    return I.manifest(spark, sf).select("path", C.route(F.col("name")).alias("backend"))


@query(BASE + f"""SELECT path, length, (row_number() OVER (ORDER BY path))::BIGINT AS position FROM m0
WHERE fmt IN {HEAVY} AND NOT {SIDECAR} AND NOT ({CLUTTER}) AND length(rel) - length(replace(rel, '/', '')) + 1 <= 3""")
def scan_manifest(spark, sf):
    """The sorted listing of a scan, with each file's place in it."""
    from vellum.operators.ranking import sorted_positions
    kept = C.corpus_filter(I.manifest(spark, sf).select("path", "length"), I.ROOT, fixed.HEAVY_FORMATS)
    return sorted_positions(kept, "path", "position")


_VARIANTS = """
paths AS (SELECT event_id, CASE event_type
  WHEN 'error' THEN '/data/input/u' || user_id || '/../../../etc/e' || event_id
  WHEN 'click' THEN '/data/input//u' || user_id || '/./e' || event_id || '/'
  WHEN 'view' THEN '/data/inputs/e' || event_id
  WHEN 'signup' THEN 'rel/../u' || user_id
  ELSE '/data/input/u' || user_id || '/x/../e' || event_id END AS raw,
  CASE event_type WHEN 'error' THEN '/etc/e' || event_id WHEN 'click' THEN '/data/input/u' || user_id || '/e' || event_id
  WHEN 'view' THEN '/data/inputs/e' || event_id WHEN 'signup' THEN '/u' || user_id
  ELSE '/data/input/u' || user_id || '/e' || event_id END AS path FROM events)
"""


@query("WITH " + _VARIANTS + """
SELECT event_id, path, CASE WHEN NOT starts_with(path, '/data/input/') THEN 'path must be under /data/input' END AS error FROM paths""")
def confine(spark, sf):
    kind, u, e = F.col("event_type"), F.col("user_id"), F.col("event_id")
    root = F.lit(I.ROOT)
    raw = (F.when(kind == "error", F.concat(root, F.lit("/u"), u, F.lit("/../../../etc/e"), e))
           .when(kind == "click", F.concat(root, F.lit("//u"), u, F.lit("/./e"), e, F.lit("/")))
           .when(kind == "view", F.concat(root, F.lit("s/e"), e))
           .when(kind == "signup", F.concat(F.lit("rel/../u"), u))
           .otherwise(F.concat(root, F.lit("/u"), u, F.lit("/x/../e"), e)))
    confined = P.confine(raw, I.ROOT, "path")
    return I.table(spark, sf, "events", "event_id", "user_id", "event_type").select(
        "event_id", confined.path.alias("path"), confined.error.alias("error"))


@query(BASE + """SELECT path, rel AS from_root, CASE WHEN starts_with(path, '/data/input/shared/') THEN substr(path, 20) END AS from_shared FROM m0""")
def relative_path(spark, sf):
    return I.manifest(spark, sf).select(
        "path", P.relative_to(F.col("path"), I.ROOT).alias("from_root"),
        P.relative_to(F.col("path"), I.ROOT + "/shared").alias("from_shared"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'p' || page_id || '.html' WHEN 2 THEN 'p' || page_id || '.html'
  WHEN 3 THEN 'document' WHEN 4 THEN 'document' ELSE CASE WHEN suffix(url, '/') THEN 'document' ELSE regexp_extract(url, '[^/]*$') END END AS name
FROM pages""")
def safe_name(spark, sf):
    p, k = F.col("page_id"), F.col("page_id") % 6
    raw = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.concat(F.lit("../../etc/p"), p, F.lit(".html")))
           .when(k == 2, F.concat(F.lit("a\\b\\p"), p, F.lit(".html "))).when(k == 3, F.lit("  \t"))
           .when(k == 4, F.lit("a/..")).otherwise(F.col("url")))
    return I.table(spark, sf, "pages", "page_id", "url").select("page_id", P.safe_name(raw).alias("name"))


@query(BASE + """SELECT path, '/data/output/' || CASE WHEN contains(rel, '/') THEN left(rel, length(rel) - length(name)) ELSE '' END
  || CASE WHEN length(ext) > 1 AND NOT contains(ext, '_') THEN stem || '_' || lower(substr(ext, 2)) ELSE name || '.d' END AS folder,
  '/data/output/' || CASE WHEN length(ext) > 1 AND NOT contains(ext, '_') THEN stem || '_' || lower(substr(ext, 2)) ELSE name || '.d' END AS rootless
FROM m0""")
def output_folder(spark, sf):
    return I.manifest(spark, sf).select(
        "path", P.output_folder(F.col("path"), I.OUTPUT, I.ROOT).alias("folder"),
        P.output_folder(F.col("path"), I.OUTPUT).alias("rootless"))


@query(BASE + "SELECT path, input_seq FROM m0")
def distinct_inputs(spark, sf):
    """Every file named twice, the second time by a longer spelling of its path."""
    files = I.manifest(spark, sf).select("path", "input_seq")
    again = files.select(F.replace("path", F.lit("/data/"), F.lit("/data/./")).alias("path"),
                         (F.col("input_seq") + 10 ** 12).alias("input_seq"))
    return C.distinct_inputs(files.unionByName(again))


_REQUESTED = """
requested AS (SELECT path, input_seq FROM m0
  UNION ALL SELECT '/data/input/ghost/g' || item_id || '.pdf', 1000000000 + item_id FROM benchmark)
"""


def _requested(spark, sf):
    return I.manifest(spark, sf).select("path", "input_seq").unionByName(I.table(spark, sf, "benchmark").select(
        F.concat(F.lit(I.ROOT + "/ghost/g"), "item_id", F.lit(".pdf")).alias("path"),
        (F.col("item_id") + 1_000_000_000).alias("input_seq")))


@query(BASE + ", " + _REQUESTED + """
SELECT path, input_seq, CASE WHEN input_seq < 1000000000 THEN 'present' ELSE 'missing' END AS status FROM requested""")
def requested_present(spark, sf):
    return C.requested_present(_requested(spark, sf), I.manifest(spark, sf).select("path"))


@query(BASE + f""", folders AS (SELECT DISTINCT '/data/input/' || source AS f, min(doc_id) + 2000000000 AS seq FROM documents GROUP BY source),
requested AS (SELECT path, input_seq FROM m0 WHERE lang = 'de' UNION ALL SELECT f, seq FROM folders
  UNION ALL SELECT '/data/input/ghost/g' || item_id, 1000000000 + item_id FROM benchmark),
found AS (
  SELECT m.path, f.seq AS input_seq FROM m0 m JOIN folders f ON starts_with(m.path, f.f || '/')
  WHERE fmt IN {HEAVY} AND NOT {SIDECAR} AND NOT ({CLUTTER}) AND length(rel) - length(replace(rel, '/', '')) <= 3
  UNION ALL SELECT path, input_seq FROM m0 WHERE lang = 'de'),
known AS (SELECT path FROM m0 UNION SELECT f FROM folders f WHERE EXISTS (SELECT 1 FROM m0 WHERE starts_with(m0.path, f.f || '/')))
SELECT path, min(input_seq) AS input_seq, 'present' AS status FROM found GROUP BY path
UNION ALL SELECT path, min(input_seq), 'missing' FROM requested WHERE path NOT IN (SELECT path FROM known) GROUP BY path""")
def resolve_inputs(spark, sf):
    """Folders, files and paths that are neither, in one list."""
    files = I.manifest(spark, sf)
    folders = I.table(spark, sf, "documents", "source", "doc_id").groupBy("source").agg(
        (F.min("doc_id") + 2_000_000_000).alias("input_seq")).select(
        F.concat(F.lit(I.ROOT + "/"), "source").alias("path"), "input_seq")
    ghosts = I.table(spark, sf, "benchmark", "item_id").select(
        F.concat(F.lit(I.ROOT + "/ghost/g"), "item_id").alias("path"), (F.col("item_id") + 1_000_000_000).alias("input_seq"))
    named = files.where(F.col("lang") == "de").select("path", "input_seq")
    return C.resolve_inputs(named.unionByName(folders).unionByName(ghosts), files.select("path"), fixed.HEAVY_FORMATS)


_LCP = """array_to_string(list_filter(range(1, len(a) + 1), lambda i: a[1:i] = b[1:i]).list_transform(lambda i: a[i]), '/')"""


@query(BASE + f"""SELECT stem_key, {_LCP} AS common_path FROM (
  SELECT lower(stem) AS stem_key, min(string_split(dir, '/')) AS a, max(string_split(dir, '/')) AS b FROM m0 GROUP BY 1)""")
def common_path(spark, sf):
    files = I.manifest(spark, sf).withColumn("stem_key", P.name_key(P.stem(F.col("name"))))
    return C.common_paths(files, "stem_key")


@query(BASE + f"""SELECT 'files' AS asked, {_LCP} AS input_root FROM (SELECT min(string_split(dir, '/')) AS a, max(string_split(dir, '/')) AS b FROM m0)
UNION ALL SELECT 'folder', '/data/input' UNION ALL SELECT 'file', (SELECT dir FROM m0 WHERE path = (SELECT min(path) FROM m0))""")
def input_root_rule(spark, sf):
    """The root when all files were named, when their folder was, and when one file was."""
    files = I.manifest(spark, sf).select("path")
    folder = spark.createDataFrame([(I.ROOT,)], "path string")
    one = files.agg(F.min("path").alias("path"))
    alone = files.join(one, "path", "left_semi")
    return (C.input_root(files, files).withColumn("asked", F.lit("files"))
            .unionByName(C.input_root(files, folder).withColumn("asked", F.lit("folder")))
            .unionByName(C.input_root(alone, one).withColumn("asked", F.lit("file"))))


def _stems_sql(formats: str, base: str, flat: bool) -> str:
    """The naming rule as windows; `base` is the folder shared names are relative to."""
    rel = f"CASE WHEN dir = {base} OR NOT starts_with(dir, {base} || '/') THEN '' ELSE substr(dir, length({base}) + 2) END"
    sep = "_" if flat else "/"
    joined = "replace(r, '/', '_')" if flat else "r"
    return BASE + f""", g AS (
  SELECT *, count(*) OVER (PARTITION BY lower(stem)) AS n, min(string_split(dir, '/')) OVER (PARTITION BY lower(stem)) AS a,
         max(string_split(dir, '/')) OVER (PARTITION BY lower(stem)) AS b FROM m0 WHERE fmt IN {formats} AND NOT {SIDECAR}),
r AS (SELECT *, CASE WHEN starts_with(r0, '..') THEN '' ELSE r0 END AS r FROM (SELECT *, {rel} AS r0 FROM g)),
x AS (SELECT *, stem || '_' || substr(ext, 2) AS suffixed,
             CASE WHEN n = 1 THEN stem WHEN r = '' THEN stem || '_' || substr(ext, 2) ELSE {joined} || '{sep}' || stem || '_' || substr(ext, 2) END AS first FROM r),
named AS (SELECT path, input_seq, CASE WHEN n = 1 AND count(*) OVER (PARTITION BY lower(first)) > 1 THEN suffixed ELSE first END AS output_name FROM x)
"""


_HEAVY_STEMS = _stems_sql(HEAVY, "'/data/input'", True)
_LIGHT_STEMS = _stems_sql(LIGHT, _LCP, False)


def heavy_named(spark, sf):
    files = I.manifest(spark, sf).where(C.supported(F.col("name"), fixed.HEAVY_FORMATS) & ~P.is_sidecar(F.col("name")))
    return N.output_stems(files.select("path", "input_seq"), I.ROOT, flat=True)


def light_named(spark, sf):
    files = I.manifest(spark, sf).where(C.supported(F.col("name"), fixed.LIGHT_FORMATS) & ~P.is_sidecar(F.col("name")))
    return N.output_stems(files.select("path", "input_seq"), None, flat=False)


@query(_HEAVY_STEMS + "SELECT path, output_name FROM named")
def output_stems_flat(spark, sf):
    return heavy_named(spark, sf).select("path", "output_name")


@query(_LIGHT_STEMS + "SELECT path, output_name FROM named")
def output_stems_rootless(spark, sf):
    return light_named(spark, sf).select("path", "output_name")


@query(_HEAVY_STEMS + "SELECT path, output_name, count(*) OVER (PARTITION BY lower(output_name)) > 1 AS clash FROM named")
def name_clashes(spark, sf):
    return N.name_clashes(written(heavy_named(spark, sf).select("path", "output_name"), "named"))


@query(_LIGHT_STEMS + """SELECT path, '/data/output/' || output_name || '.md' AS output, input_seq,
  row_number() OVER (PARTITION BY lower(output_name) ORDER BY input_seq) = 1 AS written FROM named""")
def written_guard(spark, sf):
    rows = light_named(spark, sf).select(
        "path", F.concat(F.lit(I.OUTPUT + "/"), "output_name", F.lit(".md")).alias("output"), "input_seq")
    return N.written_guard(written(rows, "named"))


@query("""
WITH w AS (SELECT 's' || (doc_id % 97) AS stem, doc_id AS seq, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS turn FROM documents),
e AS (SELECT DISTINCT 's' || (o_orderkey % 120) AS stem, CASE WHEN o_custkey % 40 < 2 THEN 1 ELSE o_custkey % 40 END AS slot FROM orders),
-- every slot up to the number of inputs and taken slots of its stem, less the taken ones
lim AS (SELECT stem, count(*) + (SELECT count(*) FROM e WHERE e.stem = w.stem) AS n FROM w GROUP BY stem),
free AS (SELECT c.stem, c.slot, row_number() OVER (PARTITION BY c.stem ORDER BY c.slot) AS turn
  FROM (SELECT stem, unnest(range(1, n + 1)) AS slot FROM lim) c
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.stem = c.stem AND e.slot = c.slot))
SELECT w.seq AS input_seq, w.stem || CASE WHEN f.slot = 1 THEN '' ELSE '_' || f.slot END || '.md' AS file_name
FROM w JOIN free f USING (stem, turn)""")
def free_names(spark, sf):
    """Names for a run that must not overwrite, next to what is already there."""
    wanted = I.table(spark, sf, "documents", "doc_id").select(
        F.lit(I.OUTPUT).alias("folder"), F.concat(F.lit("s"), F.col("doc_id") % 97).alias("stem"),
        F.lit("md").alias("extension"), F.col("doc_id").alias("input_seq"))
    slot = F.col("o_custkey") % 40
    existing = I.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.lit(I.OUTPUT).alias("folder"),
        F.concat(F.lit("s"), F.col("o_orderkey") % 120, F.when(slot < 2, F.lit("")).otherwise(F.concat(F.lit("_"), slot)),
                 F.lit(".md")).alias("name"))
    return N.free_names(wanted, existing, clobber=False).select("input_seq", "file_name")


@query(BASE + """SELECT folder, count(*) AS files, sum(length)::BIGINT AS bytes,
  CASE WHEN sum(length) >= 1024*1024*1024 THEN printf('%.1fG', sum(length) / (1024.0*1024*1024))
       WHEN sum(length) >= 1024*1024 THEN printf('%.1fM', sum(length) / (1024.0*1024))
       WHEN sum(length) >= 1024 THEN printf('%.1fK', sum(length) / 1024.0) ELSE sum(length) || 'B' END AS size
FROM (SELECT split_part(rel, '/', 1) AS folder, length FROM m0) GROUP BY folder""")
def folder_size(spark, sf):
    from vellum.functions.records import human_size
    top = F.substring_index(P.relative_to(F.col("path"), I.ROOT), "/", 1)
    return R.folder_size(I.manifest(spark, sf).select("path", "length"), top).withColumn("size", human_size(F.col("bytes")))
