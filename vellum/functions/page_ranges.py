"""Page ranges such as `0,5-10`: 0-indexed, inclusive, checked before anything expands them."""

from pyspark.sql import Column, functions as F

from vellum import fixed
from vellum.functions.let import let
from vellum.functions.paths import strip


def parse_page_range(spec: Column, max_pages: int = fixed.PAGE_RANGE_MAX_PAGES,
                     max_index: int = fixed.PAGE_RANGE_MAX_INDEX) -> Column:
    """struct(ok, normalised, pages, error, intervals); the error is the first rule that failed,
    element by element, as a reader from left to right would meet it."""
    text = strip(F.coalesce(spec, F.lit("")))
    read = F.transform(F.transform(F.split(text, ","), strip), lambda e: F.struct(
        e.alias("element"), e.rlike("^[0-9]+(-[0-9]+)?$").alias("good"), e.contains("-").alias("is_range"),
        _bare(F.substring_index(e, "-", 1)).alias("first"), _bare(F.substring_index(e, "-", -1)).alias("last")))
    numbered = F.transform(read, lambda e: F.struct(
        e.element, e.good, e.is_range, e.first, e["last"].alias("last"),
        _number(e.good, e.first).alias("lo"), _number(e.good, e["last"]).alias("hi")))

    def verdict(elements: Column, total: Column) -> Column:
        error = F.when(text == "", F.lit("page_range is empty")).otherwise(total.error)
        ok = error.isNull()
        shown = F.transform(elements, lambda e: F.when(e.is_range, F.concat(e.lo, F.lit("-"), e.hi)).otherwise(
            e.lo.cast("string")))
        return F.struct(
            ok.alias("ok"), F.when(ok, F.array_join(shown, ",")).alias("normalised"),
            F.when(ok, total.pages).alias("pages"), error.alias("error"),
            F.when(ok, F.transform(elements, lambda e: F.struct(e.lo, e.hi))).alias("intervals"))

    def totalled(elements: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("pages"), F.lit(None).cast("string").alias("error"))

        def add(acc: Column, e: Column) -> Column:
            pages = acc.pages + e.hi - e.lo + 1
            fault = F.coalesce(_fault(e, max_index), F.when(
                pages > max_pages, F.lit(f"page_range covers more than {max_pages} pages")))
            return F.when(acc.error.isNotNull(), acc).otherwise(F.struct(
                F.when(_plain(e, max_index), pages).otherwise(acc.pages).alias("pages"), fault.alias("error")))

        return F.aggregate(elements, start, add)

    return let(numbered, lambda es: let(totalled(es), lambda t: verdict(es, t)))


def _bare(digits: Column) -> Column:
    """Digits without leading zeros, which do not count towards the length of a number."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def _number(good: Column, digits: Column) -> Column:
    # Tested before it is cast: a cast that fails costs far more than one that does not.
    return F.when(good & (F.length(digits) <= 18), digits.cast("bigint"))


def _plain(e: Column, max_index: int) -> Column:
    """An element with nothing wrong by itself."""
    return F.coalesce((e.hi >= e.lo) & (e.hi <= max_index), F.lit(False))


def _fault(e: Column, max_index: int) -> Column:
    """What is wrong with one element by itself, or null."""
    named = F.concat(F.lit("page_range element '"), e.element, F.lit("' "))
    # Numbers of any length compare as (length, text), as they have no leading zeros.
    lo, hi = e.first, e["last"]
    backwards = (F.length(hi) < F.length(lo)) | ((F.length(hi) == F.length(lo)) & (hi < lo))
    return (F.when(_plain(e, max_index), F.lit(None).cast("string"))
            .when(e.element == "", F.lit("page_range has an empty element"))
            .when(~e.good, F.concat(named, F.lit("is not a page or a page range")))
            .when(backwards, F.concat(named, F.lit("counts backwards")))
            .when((F.length(hi) > 18) | (F.coalesce(e.hi, F.lit(max_index + 1)) > max_index),
                  F.concat(named, F.lit(f"is past the maximum page index {max_index}"))))


def range_size(intervals: Column) -> Column:
    """Pages covered, a page named twice counted twice."""
    return F.aggregate(intervals, F.lit(0).cast("bigint"), lambda n, i: n + i.hi - i.lo + 1)


def _pages(intervals: Column, total: Column | None = None) -> Column:
    """The distinct pages of a range in order, those below `total` if it is given; no more than the page limit."""
    if total is not None:
        intervals = F.transform(F.filter(intervals, lambda i: i.lo < total), lambda i: F.struct(
            i.lo.alias("lo"), F.least(i.hi, total.cast("bigint") - 1).alias("hi")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(intervals, lambda i: F.sequence(i.lo, i.hi)))))


def _runs(intervals: Column, total: Column | None = None) -> Column:
    """The shortest sorted, disjoint runs covering the pages: each starts where the page before is not listed."""
    def cut(pages: Column) -> Column:
        starts = F.filter(pages, lambda p, i: ~F.get(pages, i - 1).eqNullSafe(p - 1))
        ends = F.filter(pages, lambda p, i: ~F.get(pages, i + 1).eqNullSafe(p + 1))
        return F.zip_with(starts, ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return let(_pages(intervals, total), cut)


def clamp_range(intervals: Column, total: Column) -> Column:
    """The range cut to a document of `total` pages, as the shortest runs; null if none is left."""
    text = F.array_join(F.transform(_runs(intervals, total), lambda r: F.when(
        r.lo == r.hi, r.lo.cast("string")).otherwise(F.concat(r.lo, F.lit("-"), r.hi))), ",")
    return F.nullif(text, F.lit(""))


def selected_count(intervals: Column, total: Column) -> Column:
    """Distinct pages of the range that the document has."""
    return F.when(intervals.isNotNull() & total.isNotNull(), F.size(_pages(intervals, total))).cast("bigint")


def page_indices(intervals: Column, total: Column | None = None) -> Column:
    """Distinct page numbers of an accepted range, sorted: at most the page limit, so safe to explode."""
    return _pages(intervals, total)
