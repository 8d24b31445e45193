"""What is known of a document before it is converted: its pages, and whether they need OCR."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum import fixed
from vellum.functions import page_ranges as PR, paths as P


def page_count(name: Column, pdf_pages: Column) -> Column:
    """Pages: 1 for an image, the counted pages of a PDF, otherwise unknown (null, not 0)."""
    fmt = P.file_format(name)
    return (F.when(fmt.isin(fixed.IMAGE_FORMATS), F.lit(1).cast("bigint"))
            .when(fmt == "pdf", pdf_pages.cast("bigint")))


def probe_pages(documents: DataFrame, probe: Callable[[bytes], int]) -> DataFrame:
    """`documents(path, content)` with `pdf_pages` from a pluggable PDF reader; unreadable is unknown.

    Only PDFs cross into Python, and only their path and bytes do.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pages(body):
            try:
                return probe(bytes(body))
            except Exception:  # noqa: BLE001 - a count only sizes a job
                return None
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "pdf_pages": batch["content"].map(pages).astype("Int64")})

    pdfs = documents.where(P.file_format(P.basename(F.col("path"))) == "pdf").select("path", "content")
    return pdfs.mapInPandas(count, "path string, pdf_pages bigint")


def first_pages(pages: DataFrame, k: int = fixed.SAMPLE_PAGES) -> DataFrame:
    """The first `k` pages per document. The limit is applied before the shuffle too, so a
    document with very many pages sends at most `k` rows per task."""
    order = Window.partitionBy("doc").orderBy("page")
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_pages(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of each document its range names and the document has.

    `ranges(doc, intervals)` has one row per document, which meets the document's pages as it is: no page number
    is made that the document may not have, and a page named twice is one page.
    """
    inside = F.exists("intervals", lambda i: F.col("page").between(i.lo, i.hi))
    return pages.join(ranges.select("doc", "intervals"), "doc").where(inside).drop("intervals")


def text_layer(documents: DataFrame, pages: DataFrame, min_chars: int = fixed.TEXT_LAYER_MIN_CHARS) -> DataFrame:
    """Pages each document will convert and the path they take: text, ocr, or unknown (null).

    `documents(doc, name, intervals, force_ocr)`, with null intervals for a whole document,
    and `pages(doc, page, chars)` with the characters of each page's text layer.
    """
    totals = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    ranged = documents.where(F.col("intervals").isNotNull()).select("doc", "intervals")
    whole = first_pages(pages.select("doc", "page", "chars")).withColumn("ranged", F.lit(False))
    chosen = first_pages(select_pages(ranged, pages.select("doc", "page", "chars"))).withColumn("ranged", F.lit(True))
    chars = whole.unionByName(chosen).groupBy("doc", "ranged").agg(F.sum("chars").alias("chars"))
    known = documents.withColumn("ranged", F.col("intervals").isNotNull()).join(totals, "doc", "left").join(
        chars, ["doc", "ranged"], "left")
    fmt = P.file_format(F.col("name"))
    image, readable = fmt.isin(fixed.IMAGE_FORMATS), (fmt == "pdf") & F.col("total").isNotNull()
    forced = F.when(F.col("force_ocr"), F.lit("ocr"))
    count = F.when(F.col("ranged"), PR.selected_count(F.col("intervals"), F.col("total"))).otherwise(F.col("total"))
    by_text = F.when(F.coalesce("chars", F.lit(0)) >= min_chars, F.lit("text")).otherwise(F.lit("ocr"))
    return known.select(
        "doc", "name",
        F.when(image, F.lit(1).cast("bigint")).when(readable, count).alias("pages"),
        F.when(image, F.lit("ocr")).when(readable, F.coalesce(forced, by_text)).otherwise(forced).alias("path"))
