"""Text formats as blocks: HTML, CSV, JSON and XML to `(kind, level, text)`, and back to documents.

A document's blocks are one array in its own row, so rendering needs no shuffle. HTML is
taken apart with built-in functions inside the JVM; only CSV goes through Python, whose
quoting rules its csv module knows.
"""

import csv
import io
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from vellum.functions import paths as P

BLOCKS = "array<struct<kind:string,level:int,text:string>>"
_MARK, _END = "\x1e", "\x1f"
# Elements that start or end a block of text.
_BLOCK_TAGS = ("title|h[1-6]|p|div|li|ul|ol|dl|dt|dd|nav|article|section|header|footer|main|aside|"
               "blockquote|pre|table|thead|tbody|tr|td|th|form|figure|hr|body|head|html")
_NOT_TEXT = (r"(?is)<!--.*?-->|<![^>]*>|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)")


def _entity(piece: Column) -> Column:
    """What stood after an `&`: the character it names, or the `&` itself."""
    name = F.regexp_extract(piece, r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    rest = F.substr(piece, F.length(name) + 2)
    digits = F.when(name.rlike("^#[0-9]+$"), F.regexp_replace(F.substr(name, F.lit(2)), "^0+(?=.)", ""))
    hexes = F.when(name.rlike("^#[xX]"), F.conv(F.regexp_replace(F.substr(name, F.lit(3)), "^0+(?=.)", ""), 16, 10))
    code = F.coalesce(digits, hexes).cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    by_code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    names = F.create_map(*[F.lit(x) for n, c in sorted((name2codepoint | {"apos": ord("'")}).items()) for x in (n, chr(c))])
    char = F.when(name.startswith("#"), by_code).otherwise(F.try_element_at(names, name))
    return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references replaced once, left to right."""
    pieces = F.split(text, "&")
    head = F.try_element_at(pieces, F.lit(1))
    tail = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.when(text.contains("&"), F.concat(head, F.array_join(F.transform(tail, _entity), ""))).otherwise(text)


def html_blocks(html: Column) -> Column:
    """HTML as blocks: a new one at every block element, inline elements dropped, text kept whole."""
    text = F.translate(html, _MARK + _END, "")
    text = F.regexp_replace(text, _NOT_TEXT, "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>", "\n")
    text = F.regexp_replace(text, rf"(?i)<(/?)({_BLOCK_TAGS})(?:[\s/][^>]*)?>", f"{_MARK}$1$2{_END}")
    pieces = F.transform(F.split(text, _MARK), lambda p: F.struct(
        F.when(p.contains(_END), F.lower(F.substring_index(p, _END, 1))).otherwise(F.lit("")).alias("tag"),
        F.regexp_replace(F.substring_index(p, _END, -1), "<[^>]*>", "").alias("text")))
    heading = r"^h[1-6]$"
    blocks = F.transform(pieces, lambda b: F.struct(
        F.when(b.tag.rlike(heading), F.lit("heading")).when(b.tag == "title", F.lit("title"))
        .when(b.tag == "p", F.lit("paragraph")).when(b.tag == "li", F.lit("item"))
        .when(b.tag.isin("td", "th"), F.lit("cell")).otherwise(F.lit("text")).alias("kind"),
        F.when(b.tag.rlike(heading), F.substr(b.tag, F.lit(2)).cast("int")).otherwise(F.lit(0)).alias("level"),
        P.strip(decode_entities(b.text)).alias("text")))
    return F.filter(blocks, lambda b: b.text != "")


def plain_blocks(text: Column) -> Column:
    """JSON, XML and plain text: one block, the text as it stands."""
    return F.array(F.struct(F.lit("code").alias("kind"), F.lit(0).alias("level"), text.alias("text")))


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_rows(texts: pd.Series) -> pd.Series:
    csv.field_size_limit(2 ** 31 - 1)
    return texts.map(lambda t: None if t is None else list(csv.reader(io.StringIO(t, newline=""))))


def csv_blocks(text: Column) -> Column:
    """CSV as one block per row, cells joined with ` | `; the first row is the header."""
    return F.transform(csv_rows(text), lambda row, n: F.struct(
        F.when(n == 0, F.lit("header")).otherwise(F.lit("row")).alias("kind"), F.lit(0).alias("level"),
        F.array_join(row, " | ").alias("text")))


def with_blocks(documents: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """`documents(name, text)` with `blocks`, read by the extension of the name.

    `formats` limits the readers planned in: without `csv` nothing leaves the JVM.
    """
    fmt = P.file_format(F.col("name"))
    blocks = F.when(fmt.isin("html", "htm"), html_blocks(F.col("text")))
    if formats is None or "csv" in formats:
        blocks = blocks.when(fmt == "csv", csv_blocks(F.when(fmt == "csv", F.col("text"))))
    return documents.withColumn("blocks", blocks.otherwise(plain_blocks(F.col("text"))))


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def as_markdown(blocks: Column) -> Column:
    """Blocks as Markdown, one blank line between them; a CSV header gets its rule."""
    def one(b: Column) -> Column:
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(b.text, r" \| "))))
        return (F.when(b.kind == "heading", F.concat(F.repeat(F.lit("#"), b.level), F.lit(" "), b.text))
                .when(b.kind == "item", F.concat(F.lit("* "), b.text))
                .when(b.kind == "header", F.concat(F.lit("| "), b.text, F.lit(" |\n"), rule))
                .when(b.kind == "row", F.concat(F.lit("| "), b.text, F.lit(" |")))
                .otherwise(b.text))
    table = F.exists(blocks, lambda b: b.kind == "header")
    parts = F.transform(blocks, one)
    return F.when(table, F.array_join(parts, "\n")).otherwise(F.array_join(parts, "\n\n"))


def as_html(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        tag = (F.when(b.kind == "heading", F.concat(F.lit("h"), b.level)).when(b.kind == "item", F.lit("li"))
               .when(b.kind == "code", F.lit("pre")).otherwise(F.lit("p")))
        return F.concat(F.lit("<"), tag, F.lit(">"), _escape(b.text), F.lit("</"), tag, F.lit(">"))
    return F.array_join(F.transform(blocks, one), "\n")


def as_json(blocks: Column) -> Column:
    return F.to_json(blocks)


def render(blocks: Column, output_format: Column) -> Column:
    """The document in the asked format; `chunks` are rows and have none."""
    return (F.when(output_format == "markdown", as_markdown(blocks))
            .when(output_format == "html", as_html(blocks))
            .when(output_format == "json", as_json(blocks)))


def as_chunks(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per block: the `chunks` format."""
    return documents.select(*keep, F.posexplode("blocks").alias("block_no", "_b")).select(
        *keep, "block_no", "_b.kind", "_b.level", "_b.text")
