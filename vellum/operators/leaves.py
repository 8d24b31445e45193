"""JSON and XML documents taken apart: one row per leaf, with the path that leads to it.

Both readers are expressions inside the JVM, so a document's leaves are one array in its own row and nothing is shuffled. JSON is
parsed once to a variant, which is opened level by level: every step replaces each object and array by its members, as many
steps as the document is deep. XML is scanned once, with the open elements as a stack. The scan works through chunks of
the document's tokens, so that the leaves found so far are copied once a chunk and not once a token.
"""

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import paths as P
from vellum.functions.let import let
from vellum.operators.blocks import decode_entities

LEAF = "struct<path:string,level:int,kind:string,text:string>"
LEAVES = f"array<{LEAF}>"
CHUNK = 256  # tokens
_NONE = f"cast(array() as {LEAVES})"

_OPEN = "array<struct<path:string,level:int,value:variant>>"
# A token of XML: comment, CDATA, instruction, document type, tag, text, and last a `<` that begins none of them.
_TOKEN = (r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?\s*>|"
          r"""</?[^\s<>/!?"'=]+(?:[^"'<>]++|"[^"<]*"|'[^'<]*')*+>|[^<]++|<""")
_ATTRIBUTE = r"""([^\s=<>/"']+)\s*=\s*("[^"]*"|'[^']*')"""
# What may stand in a tag after its name: attributes, white space, and a slash at the end.
_TAG_BODY = r"""(?s)^(?:\s+[^\s=<>/"']+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+\s*/?$"""
_ITEM = "struct<op:string,name:string,attributes:array<struct<name:string,value:string>>,text:string>"
_STATE = f"struct<path:array<string>,fresh:boolean,roots:int,bad:boolean,found:{LEAVES}>"


def json_nesting(text: Column) -> Column:
    """struct(most, least): the highest and lowest count of open brackets at any place of a JSON text, brackets in strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")

    def step(s: Column, c: Column) -> Column:
        now = s.now + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s.most, now).alias("most"), F.least(s.least, now).alias("least"))
    return F.aggregate(brackets, F.struct(*(F.lit(0).alias(n) for n in ("now", "most", "least"))), step, lambda s: F.struct(s.most, s.least))


def _member(path: Column, key: Column) -> Column:
    """Path of a member: `.name`, or `."na.me"` where the name is no plain word."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(path, F.lit("."), F.when(key.rlike(r"^\w+$"), key).otherwise(quoted))


def _opened(node: Column) -> Column:
    """The members of an object or array with any, or the node itself."""
    def inside(kind: str) -> Column:
        return F.try_variant_get(node.value, "$", kind)

    fields = F.transform(F.map_entries(inside("map<string,variant>")), lambda e: F.struct(
        _member(node.path, e.key).alias("path"), (node.level + 1).alias("level"), e.value.alias("value")))
    items = F.transform(inside("array<variant>"), lambda v, i: F.struct(
        F.concat(node.path, F.lit("["), i, F.lit("]")).alias("path"), (node.level + 1).alias("level"), v.alias("value")))
    return let(F.coalesce(fields, items).cast(_OPEN), lambda members: F.when(F.size(members) > 0, members).otherwise(F.array(node).cast(_OPEN)))


def _json_leaf(node: Column) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(node.value), r"^\w+", 0)
    name = (F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
            .when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").otherwise("number"))
    text = F.coalesce(F.try_variant_get(node.value, "$", "string"), F.lit("null"))
    return F.struct(node.path.alias("path"), node.level.alias("level"), name.alias("kind"), text.alias("text"))


def json_leaves(text: Column) -> Column:
    """The leaves of a JSON text as struct(leaves, error): scalars, and objects and arrays without members.

    Members come in the order of their names, items in their own; `$` is the document, level 0. Numbers stand as a variant
    writes them. A text that is no JSON, or names a member twice, has an error and no leaves; a null has neither.
    """
    # The parser is content with a value at the start of a text. Between brackets that no bracket of the text closes, it must read all.
    def read(nesting: Column) -> Column:
        whole = F.when(nesting.least == 0, F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"))
        root = F.when(F.size(whole) == 1, F.transform(whole, lambda v: F.struct(F.lit("$").alias("path"), F.lit(0).alias("level"), v.alias("value")))).cast(_OPEN)
        levels = F.sequence(F.lit(1), nesting.most + 1)  # the last step finds nothing to open
        nodes = F.aggregate(levels, root, lambda open_, _: F.flatten(F.transform(open_, _opened)).cast(_OPEN))
        return let(F.transform(nodes, _json_leaf).cast(LEAVES), lambda found: F.struct(
            F.coalesce(found, F.expr(_NONE)).alias("leaves"), F.when(text.isNotNull() & found.isNull(), "not well-formed JSON").alias("error")))
    return let(json_nesting(text), read)


def _item(token: Column) -> Column:
    """A token as what it does to the stack of open elements."""
    name = F.regexp_extract(token, r"""^</?([^\s<>/!?"'=]+)""", 1)
    body = F.substr(token, F.length(name) + F.when(token.startswith("</"), 3).otherwise(2), F.length(token))
    body = F.substr(body, F.lit(1), F.length(body) - 1)
    op = (F.when(token.startswith("<![CDATA["), "text").when(token.startswith("<!--") | token.startswith("<?") | token.rlike("(?i)^<!doctype"), "skip")
          .when(token == "<", "bad").when(~token.startswith("<"), F.when(P.strip(token) == "", "skip").otherwise("text"))
          .when(token.startswith("</"), F.when(P.strip(body) == "", "close").otherwise("bad"))
          .when(~body.rlike(_TAG_BODY), "bad").when(body.endswith("/"), "whole").otherwise("open"))
    values = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2))
    attributes = F.when(op.isin("open", "whole"), F.zip_with(
        F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(1)), values,
        lambda n, v: F.struct(n.alias("name"), decode_entities(F.substr(v, F.lit(2), F.length(v) - 2)).alias("value"))))
    text = (F.when(token.startswith("<![CDATA["), F.substr(token, F.lit(10), F.length(token) - 12))
            .when(op == "text", decode_entities(token)))
    return F.struct(op.alias("op"), name.alias("name"), attributes.alias("attributes"), P.strip(text).alias("text")).cast(_ITEM)


def _next(state: Column, item: Column) -> Column:
    op, depth, empty = item.op, F.size(state.path), F.expr(_NONE)
    opens = op.isin("open", "whole")
    inner = F.array_append(state.path, item["name"])

    def leaf(path: Column, level: Column, kind: str, text: Column) -> Column:
        return F.struct(F.concat(F.lit("/"), F.array_join(path, "/")).alias("path"), level.cast("int").alias("level"), F.lit(kind).alias("kind"), text.alias("text"))

    attributes = F.transform(item.attributes, lambda a: leaf(F.array_append(inner, F.concat(F.lit("@"), a["name"])), depth + 1, "attribute", a.value)).cast(LEAVES)
    found = (F.when((op == "whole") & (F.size(item.attributes) == 0), F.array(leaf(inner, depth + 1, "empty", F.lit(""))).cast(LEAVES))
             .when(opens, attributes)
             .when((op == "close") & state.fresh, F.array(leaf(state.path, depth, "empty", F.lit(""))).cast(LEAVES))
             .when(op == "text", F.array(leaf(state.path, depth, "text", item.text)).cast(LEAVES)).otherwise(empty))
    return F.struct(
        F.when(op == "open", inner).when((op == "close") & (depth > 0), F.slice(state.path, F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(state.path).alias("path"),
        F.when(op == "skip", state.fresh).otherwise((op == "open") & (F.size(item.attributes) == 0)).alias("fresh"),
        (state.roots + (opens & (depth == 0)).cast("int")).alias("roots"),
        (state.bad | (op == "bad") | ((op == "text") & (depth == 0))
         | ((op == "close") & ~F.coalesce(F.try_element_at(state.path, F.lit(-1)) == item["name"], F.lit(False)))).alias("bad"),
        F.concat(state.found, found).alias("found")).cast(_STATE)


def xml_leaves(text: Column) -> Column:
    """The leaves of an XML text as struct(leaves, error), in the order of the document: attributes (path `/a/b/@name`), runs of
    text, and elements that hold nothing.

    A leaf's level is the number of elements it is in. Elements of one name share a path. Text is trimmed; CDATA is a run of its
    own; comments, instructions and the document type are left out. An error means: a tag that is cut short, has unquoted values
    or does not close the element last opened, text outside the root, or not exactly one root. A null has no leaves and no error.
    """
    items = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), _item), lambda i: i.op != "skip")

    def scan(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / F.lit(CHUNK)).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(F.expr("cast(array() as array<string>)").alias("path"), F.lit(False).alias("fresh"), F.lit(0).alias("roots"), F.lit(False).alias("bad"),
                         F.expr(_NONE).alias("found")).cast(_STATE)

        def chunk(state: Column, some: Column) -> Column:
            start = F.struct(state.path.alias("path"), state.fresh.alias("fresh"), state.roots.alias("roots"), state.bad.alias("bad"), F.expr(_NONE).alias("found")).cast(_STATE)
            return let(F.aggregate(some, start, _next), lambda end: F.struct(
                end.path.alias("path"), end.fresh.alias("fresh"), end.roots.alias("roots"), end.bad.alias("bad"),
                F.concat(state.found, end.found).alias("found")).cast(_STATE))
        return F.aggregate(chunks, begin, chunk)

    def finished(end: Column) -> Column:
        wrong = end.bad | (F.size(end.path) > 0) | (end.roots != 1)
        return F.struct(F.when(~wrong, end.found).otherwise(F.expr(_NONE)).cast(LEAVES).alias("leaves"), F.when(wrong, "not well-formed XML").alias("error"))
    return F.when(text.isNotNull(), let(let(items, scan), finished)).otherwise(F.struct(F.expr(_NONE).alias("leaves"), F.lit(None).cast("string").alias("error")))


def with_leaves(documents: DataFrame) -> DataFrame:
    """`documents(name, text)` with `leaves` and `error`, read by the extension of the name; other formats have an error."""
    # A small file holds many documents and is one task: they are dealt out before they are read, which takes far longer.
    documents = documents.repartition(4 * documents.sparkSession.sparkContext.defaultParallelism)
    fmt, text = P.file_format(F.col("name")), F.col("text")
    read = (F.when(fmt == "json", json_leaves(F.when(fmt == "json", text))).when(fmt == "xml", xml_leaves(F.when(fmt == "xml", text)))
            .otherwise(F.struct(F.expr(_NONE).alias("leaves"), F.concat(F.lit("no reader for leaves of: "), fmt).alias("error"))))
    return documents.withColumn("_read", read).select("*", "_read.leaves", "_read.error").drop("_read")


def as_leaf_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per leaf, numbered from 0; a document with an error is one row with that error and no leaf."""
    rows = documents.select(*keep, "error", F.posexplode_outer("leaves").alias("leaf_no", "_leaf"))
    return rows.where(F.col("leaf_no").isNotNull() | F.col("error").isNotNull()).select(*keep, "leaf_no", "_leaf.path", "_leaf.level", "_leaf.kind", "_leaf.text", "error")


def leaf_blocks(leaves: Column) -> Column:
    """Leaves as blocks, `path: text` each, for rendering."""
    return F.transform(leaves, lambda leaf: F.struct(F.lit("item").alias("kind"), F.lit(0).alias("level"), F.concat(leaf.path, F.lit(": "), leaf.text).alias("text")))
