"""Small expressions a provenance record is made of: times, sizes, versions, key-value pairs."""

from pyspark.sql import Column, functions as F

from vellum import fixed


def utc_iso(ts: Column) -> Column:
    """`2024-01-31T23:59:59Z` in UTC whatever the session's time zone, fractions dropped."""
    return F.date_format(
        F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp").cast("timestamp_ntz")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(started: Column, finished: Column) -> Column:
    """Elapsed seconds to the millisecond."""
    micros = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.round(micros / F.lit(1e6), 3)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def human_size(size: Column) -> Column:
    """Bytes as `512B`, `1.5K`, `2.0G`: 1024-based, one decimal above bytes."""
    text = F.concat(size.cast("bigint"), F.lit("B"))
    scaled = size.cast("double")
    for power, unit in enumerate("KMGT", start=1):
        step = F.call_function("format_number", scaled / F.lit(1024.0 ** power), F.lit("0.0"))
        text = F.when(scaled >= F.lit(1024.0 ** power), F.concat(step, F.lit(unit))).otherwise(text)
    return text


def pairs_map(items: Column, what: str) -> Column:
    """struct(pairs, error) from `KEY=VALUE` texts: the first `=` splits, a later key wins."""
    items = F.coalesce(items, F.expr("cast(array() as array<string>)"))
    bad = F.filter(items, lambda i: ~i.rlike("(?s)^[^=]+=.*$"))
    # Keep the last entry of each key: an entry stays when no later one has its key.
    entries = F.transform(items, lambda i, n: F.struct(
        F.substring_index(i, "=", 1).alias("key"),
        F.regexp_replace(i, "(?s)^[^=]*=", "").alias("value"), n.alias("n")))
    kept = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o.key == e.key) & (o.n > e.n)))
    pairs = F.map_from_entries(F.transform(kept, lambda e: F.struct(e.key, e.value)))
    return F.struct(
        F.when(F.size(bad) == 0, pairs).alias("pairs"),
        F.when(F.size(bad) > 0, F.concat(F.lit(f"--{what} wants KEY=VALUE, got '"),
                                         F.try_element_at(bad, F.lit(1)), F.lit("'"))).alias("error"))


def versions_map(pairs: Column, packages: list[str] | None = None) -> Column:
    """Versions with an empty one recorded as `unknown`, and a missing package as `absent`."""
    known = F.transform_values(pairs, lambda _, v: F.when(v == "", F.lit("unknown")).otherwise(v))
    if packages is None:
        return known
    return F.map_from_arrays(
        F.array(*[F.lit(p) for p in packages]),
        F.array(*[F.coalesce(F.try_element_at(known, F.lit(p)), F.lit("absent")) for p in packages]))


def map_text(pairs: Column) -> Column:
    """A map as sorted `k=v` text: maps themselves neither compare nor group."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("")))), ",")


def job_pages(pages: Column, range_pages: Column) -> Column:
    """Pages a job converts: the smaller of the document's and the range's, whichever is known."""
    return F.least(pages, range_pages)


def job_timeout(pages: Column, fixed_seconds: int | None = None) -> Column:
    """Seconds a job may run, sized from its pages; a fixed setting wins."""
    if fixed_seconds is not None:
        return F.lit(fixed_seconds).cast("bigint")
    return F.coalesce(F.lit(fixed.JOB_TIMEOUT_BASE) + pages * fixed.JOB_TIMEOUT_PER_PAGE,
                      F.lit(fixed.JOB_TIMEOUT_UNKNOWN)).cast("bigint")
