"""Paths resolved through symbolic links that are known as a table, `links(path, target)`.

Every link is resolved first, once, then paths take the finished targets. A link's target may begin with another link, that one's
with a third, and so on; such chains are followed by path doubling: in every round each link takes over where its
successor has got to, so a chain of n links takes about log2(n) rounds, and what is still on its way after 2 ** rounds >= links
is in a loop. Loops are found on names alone, before any target is put together, so their growing targets are never built.

Prefixes that many paths share are looked up by `skew.attach`: counted first, and spread where one is very frequent.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from vellum import session
from vellum.functions import paths as P
from vellum.functions.let import let
from vellum.operators import skew

# How often what is left of a target may begin with a link again; nothing real comes near.
MOST_NESTED = 40
_PREFIX = "struct<prefix:string,rest:string>"


def prefixes(path: Column) -> Column:
    """array<struct(prefix, rest)> of an absolute path, shortest first: what one has come to after each element, and what is left.

    An element `..` goes back from where one has come to, so it counts only once nothing before it is a link.
    """
    def walked(parts: Column) -> Column:
        start = F.struct(F.expr("cast(array() as array<string>)").alias("at"), F.expr(f"cast(array() as array<{_PREFIX}>)").alias("made"))

        def step(state: Column, part: Column) -> Column:
            on = F.when(part == "..", F.slice(state["at"], F.lit(1), F.greatest(F.size(state["at"]) - 1, F.lit(0)))).otherwise(F.array_append(state["at"], part))
            return let(on, lambda at: F.struct(at.alias("at"), F.array_append(state["made"], F.struct(
                F.concat(F.lit("/"), F.array_join(at, "/")).alias("prefix"),
                F.array_join(F.slice(parts, F.size(state["made"]) + 2, F.size(parts)), "/").alias("rest")).cast(_PREFIX)).alias("made")))
        return F.aggregate(parts, start, step, lambda state: state["made"])
    return let(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), walked)


def _join(path: Column, rest: Column) -> Column:
    return F.when(rest == "", path).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), rest))


def _look_up(facts: DataFrame, column: str, table: DataFrame, spread: str) -> DataFrame:
    """`facts` left-joined to `table`, which has one row per value of its column `key`, on `column`."""
    # Names compress so well that a written table looks small enough to broadcast when it is not: these joins are by merging.
    known = facts.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("_rows")).join(table.hint("merge"), "key")
    return skew.attach(facts.withColumn("key", F.col(column)), known.hint("merge"), ["key"], "_rows", spread).drop("key", "_rows")


def first_links(paths: DataFrame, links: DataFrame) -> DataFrame:
    """`paths(id, path)` that lead through one of `links(key, ...)`: id, the columns of the first such link, and `rest`."""
    parts = paths.select("id", F.posexplode(prefixes(F.col("path"))).alias("at", "_part")).select("id", "at", "_part.*")
    found = _look_up(parts, "prefix", links.withColumn("_link", F.struct("key", *[c for c in links.columns if c != "key"])).select("key", "_link"), "id")
    first = found.where(F.col("_link").isNotNull()).groupBy("id").agg(F.min_by(F.struct("_link", "rest"), "at").alias("_first"))
    return first.select("id", "_first._link.*", "_first.rest")


def resolve_links(links: DataFrame) -> DataFrame:
    """Where each of `links(path, target)` leads: path, real (null in a loop) and loop.

    Paths are absolute and lie in real folders, as a listing gives them; a relative target starts at the link's folder. Repeated rows
    count once; of a path with different targets the smallest counts. Rows with a null path or target are no links. A link that
    needs itself to be resolved, or one that does, is in a loop; so is one whose target begins with links more than MOST_NESTED times.
    """
    full = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(P.parent(F.col("path")), F.lit("/"), F.col("target")))
    given = links.where("path is not null and target is not null").withColumn("path", P.normalise(F.col("path"))).groupBy("path").agg(F.min(full).alias("target"))
    state = session.written(given.select(F.col("path").alias("key"), F.col("target").alias("real"), F.lit(False).alias("loop")), "links")
    for _ in range(MOST_NESTED):
        on_way = state.where("not loop").select(F.col("key").alias("id"), F.col("real").alias("path"))
        hits = session.written(first_links(on_way, state.select("key")).withColumnRenamed("key", "next"), "hits")
        n = hits.count()
        if not n:
            break
        endless = _endless(hits, n)
        ended = _ends(hits.join(endless.hint("merge"), "id", "left_anti"))
        to = _look_up(ended, "next", state.select("key", F.col("real").alias("to_real"), F.col("loop").alias("to_loop")), "id")
        moved = to.select(F.col("id").alias("key"), F.when(~F.col("to_loop"), _join(F.col("to_real"), F.col("rest"))).alias("new"), F.col("to_loop").alias("bad"))
        moved = moved.unionByName(endless.select(F.col("id").alias("key"), F.lit(None).cast("string").alias("new"), F.lit(True).alias("bad")))
        state = session.written(state.join(moved.hint("merge"), "key", "left").select(
            "key", F.when(F.col("bad").isNull(), F.col("real")).otherwise(F.col("new")).alias("real"), F.coalesce("bad", "loop").alias("loop")), "links")
    else:
        left = first_links(state.where("not loop").select(F.col("key").alias("id"), F.col("real").alias("path")), state.select("key")).select(F.col("id").alias("key"), F.lit(True).alias("left"))
        state = state.join(left, "key", "left").select("key", "real", (F.col("loop") | F.coalesce("left", F.lit(False))).alias("loop"))
    return state.select(F.col("key").alias("path"), F.when(~F.col("loop"), P.normalise(F.col("real"))).alias("real"), "loop")


def _endless(hits: DataFrame, n: int) -> DataFrame:
    """The `hits(id, next)`, `n` of them, from which no end is reached."""
    ahead = hits.select("id", "next")
    for _ in range(math.ceil(math.log2(n)) + 1):
        table = ahead.select(F.col("id").alias("key"), F.col("next").alias("_far"))
        moved = session.written(_look_up(ahead, "next", table, "id").select("id", F.coalesce("_far", "next").alias("next"), F.col("_far").isNotNull().alias("moving")), "ahead")
        ahead = moved.select("id", "next")
        if moved.where("moving").isEmpty():
            break
    ids = hits.select(F.col("id").alias("key"), F.lit(True).alias("_on"))
    return session.written(_look_up(ahead, "next", ids, "id").where("_on").select("id"), "endless")


def _ends(hits: DataFrame) -> DataFrame:
    """`hits(id, next, rest)` without loops, each moved on to the last link of its chain, with all that is left after it."""
    while True:
        table = hits.select(F.col("id").alias("key"), F.col("next").alias("_far"), F.col("rest").alias("_more"))
        moved = _look_up(hits, "next", table, "id")
        hits = session.written(moved.select("id", F.coalesce("_far", "next").alias("next"), F.when(F.col("_far").isNull(), F.col("rest")).otherwise(
            F.concat_ws("/", F.nullif("_more", F.lit("")), F.nullif("rest", F.lit("")))).alias("rest"), F.col("_far").isNotNull().alias("moving")), "ends")
        if hits.where("moving").isEmpty():
            return hits.drop("moving")
        hits = hits.drop("moving")


def real_paths(paths: DataFrame, resolved: DataFrame, path: str = "path") -> DataFrame:
    """`paths` with `real`, the path without links and `..`, and `loop`; `resolved` is what `resolve_links` made of the links.

    One round for each link in a path, over the rows that still have one. A null path has a null `real`. Repeated rows each give their
    row. The columns `real`, `loop` and `_id` of `paths` itself, if there are any, are replaced.
    """
    links = resolved.select(F.col("path").alias("key"), "real", "loop")
    different = paths.select(F.col(path).alias("id")).where("id is not null").distinct()
    todo = session.written(different.select("id", F.when(F.col("id").startswith("/"), F.col("id")).otherwise(F.concat(F.lit("/"), "id")).alias("path")), "paths")
    done: DataFrame | None = None
    while True:
        hits = session.written(first_links(todo, links), "through")
        over = hits.where("loop").select("id", F.lit(None).cast("string").alias("real"), F.lit(True).alias("loop"))
        plain = todo.join(hits.hint("merge"), "id", "left_anti").select("id", P.normalise(F.col("path")).alias("real"), F.lit(False).alias("loop"))
        done = over.unionByName(plain) if done is None else done.unionByName(over).unionByName(plain)
        if hits.where("not loop").isEmpty():
            break
        todo = hits.where("not loop").select("id", _join(F.col("real"), F.col("rest")).alias("path"))
    known = session.written(done, "real")
    kept = paths.drop("real", "loop", "_id")
    return kept.join(known.withColumnRenamed("id", "_id").hint("merge"), kept[path] == F.col("_id"), "left").drop("_id")


def confine_resolved(paths: DataFrame, links: DataFrame, root: str, what: str, path: str = "path") -> DataFrame:
    """`paths` with `real` and `error`: why a path is refused that leaves `root` once its links are followed, or leads into a loop.

    `root` is resolved as well. A null path is refused.
    """
    resolved = session.written(resolve_links(links), "resolved")
    top = real_paths(paths.sparkSession.createDataFrame([(root,)], "path string"), resolved).first()
    found = real_paths(paths, resolved, path)
    inside = F.coalesce(P.under(F.col("real"), top["real"]), F.lit(False)) if not top["loop"] else F.lit(False)
    error = F.when(F.col("loop"), f"{what} leads into a loop of links").when(~inside, f"{what} must be under {root}")
    return found.withColumn("error", error).drop("loop")
