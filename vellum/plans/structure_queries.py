"""What is inside documents and folders: leaves of JSON and XML, totals of nested folders, paths behind links."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vellum import session
from vellum.functions import paths as P
from vellum.operators import leaves as L, links as K, report as R
from vellum.plans import inputs as I
from vellum.plans.registry import query
from vellum.sinks import publish
from vellum.sources import tree


@query(r"""
WITH docs AS (
  SELECT event_id, '{"event": {"id": ' || event_id || ', "type": "' || event_type || '"}, "props": ' || props || ', "more": ["u' || user_id || '", [], [null, {"x y": true}], {}]' AS start FROM events),
nodes AS (
  SELECT event_id, t.id, t.parent, t.fullkey, t.type, t.atom FROM docs, json_tree(start || '}') t WHERE event_id % 17 <> 0),
leaves AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.event_id = n.event_id AND m.parent = n.id))
SELECT event_id, fullkey AS path, length(regexp_replace(regexp_replace(fullkey, '"[^"]*"', 'q', 'g'), '[^.\[]', '', 'g'))::INTEGER AS level,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE type WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN '{}' WHEN 'ARRAY' THEN '[]' ELSE atom ->> '$' END AS text, NULL::VARCHAR AS error FROM leaves
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'not well-formed JSON' FROM docs WHERE event_id % 17 = 0""")
def json_leaves(spark, sf):
    """Events as nested JSON documents, some cut short, taken apart."""
    text = F.concat(F.lit('{"event": {"id": '), "event_id", F.lit(', "type": "'), "event_type", F.lit('"}, "props": '), "props", F.lit(', "more": ["u'), "user_id",
                    F.lit('", [], [null, {"x y": true}], {}]'), F.when(F.col("event_id") % 17 != 0, "}").otherwise(""))
    docs = I.table(spark, sf, "events").select("event_id", F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("name"), text.alias("text"))
    return L.as_leaf_rows(L.with_leaves(docs), "event_id").drop("leaf_no")


@query("""
WITH c AS (SELECT *, c_custkey % 13 = 5 AS broken FROM customer)
SELECT c_custkey, k::INTEGER AS leaf_no, path, level::INTEGER AS level, kind, text, NULL::VARCHAR AS error
FROM (SELECT c_custkey, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest(['/c/@key', '/c/@name', '/c/nation', '/c', '/c/money', '/c/money/currency/@of']) AS path, unnest([1, 1, 2, 1, 2, 3]) AS level,
    unnest(['attribute', 'attribute', 'text', 'text', 'text', 'attribute']) AS kind,
    unnest([c_custkey::VARCHAR, c_name || ' > "x"', c_nationkey::VARCHAR, c_mktsegment || ' & <b>', 'é' || c_custkey % 7, 'n' || c_nationkey]) AS text FROM c WHERE NOT broken)
UNION ALL
SELECT c_custkey, (6 + i)::INTEGER, '/c/order', 2, CASE WHEN i = 0 THEN 'empty' ELSE 'text' END, CASE WHEN i = 0 THEN '' ELSE 'o' || i END, NULL
FROM (SELECT c_custkey, unnest(range(c_custkey % 4)) AS i FROM c WHERE NOT broken)
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, 'not well-formed XML' FROM c WHERE broken""")
def xml_leaves(spark, sf):
    """Customers as XML documents with attributes, CDATA, references and comments, some not closed, taken apart."""
    key = F.col("c_custkey")
    orders = F.array_join(F.transform(F.sequence(F.lit(0), key % 4), lambda i: F.when(i == key % 4, "").when(i == 0, "<order />").otherwise(
        F.concat(F.lit("<order>"), F.lit("o"), i, F.lit("</order >")))), "\n")
    text = F.concat(F.lit("<?xml version='1.0'?><!-- <c> -->\n<c key='"), key, F.lit("' name = '"), "c_name", F.lit(' > "x"\'><nation>'), "c_nationkey", F.lit("</nation><![CDATA["), "c_mktsegment",
                    F.lit(" & <b>]]><money> &#233;"), key % 7, F.lit("<currency of='n"), "c_nationkey", F.lit("'/>\n</money>"), orders,
                    F.when(key % 13 != 5, "</c>\n").otherwise("</b>"))
    docs = I.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c"), key, F.lit(".xml")).alias("name"), text.alias("text"))
    return L.as_leaf_rows(L.with_leaves(docs), "c_custkey")


@query("WITH " + I.MANIFEST_SQL + """,
f AS (SELECT string_split(path, '/') AS parts, length FROM manifest),
above AS (SELECT array_to_string(parts[1:n], '/') AS folder, n = len(parts) - 1 AS own, length FROM f, unnest(range(3, len(parts))) AS u(n))
SELECT folder, count(*) FILTER (own) AS own_files, count(*) AS files, sum(length)::BIGINT AS bytes,
  CASE WHEN sum(length) >= 1024*1024*1024 THEN printf('%.1fG', sum(length) / (1024.0*1024*1024)) WHEN sum(length) >= 1024*1024 THEN printf('%.1fM', sum(length) / (1024.0*1024))
       WHEN sum(length) >= 1024 THEN printf('%.1fK', sum(length) / 1024.0) ELSE sum(length) || 'B' END AS size
FROM above GROUP BY folder""")
def folder_totals(spark, sf):
    """Files and bytes of every folder of the manifest, with all that is below it."""
    return R.folder_totals(I.manifest(spark, sf).select("path", "length"), I.ROOT)


@query("""
WITH RECURSIVE links AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 64 = 0 THEN NULL WHEN c_custkey % 97 = 5 AND c_custkey % 64 <= 60 THEN c_custkey + 3 ELSE c_custkey - 1 END AS next,
    CASE WHEN c_custkey % 192 = 0 THEN '/data/store/r' ELSE '/data/input/real/r' END || c_custkey AS stop FROM customer),
walk AS (SELECT k AS link, k, 0 AS hop FROM links UNION ALL SELECT link, next, hop + 1 FROM walk JOIN links USING (k) WHERE next IS NOT NULL AND hop < 200),
ends AS (SELECT link, CASE WHEN w.hop < 200 THEN coalesce(l.stop, '/data/input/c' || w.k) END AS stop
  FROM (SELECT link, max_by(k, hop) AS k, max(hop) AS hop FROM walk GROUP BY link) w LEFT JOIN links l USING (k)),
paths AS (SELECT o_orderkey, CASE WHEN stop IS NULL THEN NULL WHEN o_orderkey % 10 = 1 THEN regexp_replace(stop, '/[^/]*$', '') || '/o' || o_orderkey || '.pdf' ELSE stop || '/d/o' || o_orderkey || '.pdf' END AS real
  FROM orders JOIN ends ON link = o_custkey)
SELECT o_orderkey, real, CASE WHEN real IS NULL THEN 'path leads into a loop of links' WHEN NOT starts_with(real, '/data/input/') THEN 'path must be under /data/input' END AS error FROM paths""")
def confine_links(spark, sf):
    """Orders' paths through chains of up to 63 links, some of which leave the input folder and some of which never end."""
    k = F.col("c_custkey")
    target = (F.when(k % 192 == 0, F.concat(F.lit("/data/./store/r"), k)).when(k % 64 == 0, F.concat(F.lit("real/r"), k))
              .when((k % 97 == 5) & (k % 64 <= 60), F.concat(F.lit("c"), k + 3)).when(k % 2 == 1, F.concat(F.lit("./c"), k - 1)).otherwise(F.concat(F.lit("../input/c"), k - 1)))
    links = I.table(spark, sf, "customer", "c_custkey").select(F.concat(F.lit(I.ROOT + "/c"), k).alias("path"), target.alias("target"))
    order = F.col("o_orderkey")
    path = F.concat(F.lit(I.ROOT + "/c"), "o_custkey", F.when(order % 10 == 1, "/../o").otherwise("/d/o"), order, F.lit(".pdf"))
    paths = I.table(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", path.alias("path"))
    return K.confine_resolved(paths, links, I.ROOT, "path").drop("path")


@query("SELECT 'p' || page_id % 9 || '/_' || page_id || '.html' AS rel, octet_length(encode(html))::BIGINT AS length FROM pages")
def publish_files(spark, sf):
    """Pages published together as files, one export after another that failed, and listed."""
    root = session.fresh_folder(spark, "published")
    page = F.col("page_id")
    files = I.table(spark, sf, "pages", "page_id", "html").select(F.concat(F.lit("p"), page % 9, F.lit("/_"), page, F.lit(".html")).alias("rel"), F.col("html").alias("body"))
    try:
        publish.publish_files(files.union(files.limit(1).select(F.lit("../outside"), "body")), root)
    except PySparkException:  # one name is refused, so none of the others is there either
        pass
    publish.publish_files(files.where(page % 2 == 0), root)
    publish.publish_files(files, root)
    listed = tree.walk_batch(spark, root, root + "/none")
    return listed.select(P.relative_to(F.col("path"), tree.open_store(root)[1]).alias("rel"), "length")
