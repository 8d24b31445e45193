"""One output name per input, decided by the inputs alone."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import paths as P
from vellum.operators.skew import HOT_ROWS, attach, count_per_key, rank_in_chunks
from vellum.session import written


def _with_ext(stem: Column, ext: Column) -> Column:
    bare = F.ltrim(ext, F.lit("."))
    return F.when(ext != "", F.concat(stem, F.lit("_"), bare)).otherwise(stem)


def _relative(folder: Column, base: Column) -> Column:
    """`folder` below `base`, or empty where it is the base, outside it, or starts with `..`."""
    below = P.relative_to(folder, base)
    return F.when(below.isNull() | below.startswith(".."), F.lit("")).otherwise(below)


def output_stems(files: DataFrame, input_root: str | None = None, flat: bool = False,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """`files(path, ...)` with `output_name`: the stem, and more only where inputs share it.

    Inputs whose stems fold to one take `<dir>/<stem>_<ext>`, the folder taken below
    `input_root` or below what the group's folders have in common (`flat` joins it with
    `_`). A plain name that then meets another input's name takes `<stem>_<ext>` too, in
    one pass. Both passes count with a map-side aggregate and join the count back, so a
    stem that a third of the corpus shares is never gathered in one task.
    """
    name = P.basename(F.col("path"))
    parts = (files
             .withColumn("_ext", P.ext(name))
             .withColumn("_stem", P.stem(name))
             .withColumn("_dir", P.parent(P.normalise(F.col("path")))))
    common = [] if input_root else [F.min(F.split("_dir", "/")).alias("_first"),
                                    F.max(F.split("_dir", "/")).alias("_last")]
    grouped = count_per_key(parts, P.name_key(F.col("_stem")), "_stem_key", "path", "_stem_rows",
                            common, hot_rows)
    if input_root:
        base = P.normalise(F.lit(input_root))
    else:
        base = F.array_join(P.common_prefix(F.col("_first"), F.col("_last")), "/")
    rel = _relative(F.col("_dir"), base)
    shared_name = _with_ext(F.col("_stem"), F.col("_ext"))
    rel = F.replace(rel, F.lit("/"), F.lit("_")) if flat else rel
    in_dir = F.concat(rel, F.lit("_" if flat else "/"), shared_name)
    plain = F.col("_stem_rows") == 1
    first = grouped.withColumn("_plain", plain).withColumn(
        "_name", F.when(plain, F.col("_stem")).when(rel == "", shared_name).otherwise(in_dir)).select(
        *files.columns, "_stem", "_ext", "_plain", "_name")
    # The second pass reads the first one twice, to count and to join: it is written once instead.
    first = written(first, "names")
    taken = count_per_key(first, P.name_key(F.col("_name")), "_name_key", "path", "_name_rows",
                          hot_rows=hot_rows)
    moved = F.col("_plain") & (F.col("_name_rows") > 1) & (F.col("_ext") != "")
    return taken.withColumn("output_name", F.when(moved, shared_name).otherwise(F.col("_name"))).select(
        *files.columns, "output_name")


def name_clashes(named: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`named` with `clash`: another input of the run has the same output name. All of them are refused."""
    counted = count_per_key(named, P.name_key(F.col("output_name")), "_key", "path", "_rows", hot_rows=hot_rows)
    return counted.withColumn("clash", F.col("_rows") > 1).select(*named.columns, "clash")


def written_guard(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows(output, input_seq, ...)` with `written`: the first input keeps an output path, later ones fail."""
    counted = count_per_key(rows, P.name_key(F.col("output")), "_key", "input_seq", "_rows",
                            [F.min("input_seq").alias("_first")], hot_rows)
    return counted.withColumn("written", F.col("input_seq") == F.col("_first")).select(*rows.columns, "written")


_NAME = ["folder", "stem", "extension"]
_NUMBERED = r"(?s)^(.*)_([1-9][0-9]{0,17})$"


def _count_below(marks: DataFrame, rows: DataFrame, order: str, name: str, chunk: int) -> DataFrame:
    """`marks` with the number of `rows` of the same name whose `order`, never equal to a mark's, is smaller."""
    both = rows.select(*_NAME, order).unionByName(marks.select(*_NAME, order))
    every = rank_in_chunks(both, _NAME, order, "_every", chunk)
    own = rank_in_chunks(marks, _NAME, order, "_own", chunk)
    return own.join(every, [*_NAME, order]).withColumn(name, F.col("_every") - F.col("_own")).drop("_every", "_own")


def _who_was_first(key, table):
    """Whether inputs of a stem reach each contested slot, in ascending order, before the stem that is called like it."""
    table = table.sort_by("slot")
    passed, reached = 0, []
    for slot, taken, earlier in zip(*(table.column(c).to_pylist() for c in ("slot", "_taken", "_earlier"))):
        # the slot is the (slot - taken - passed)-th free one, for the input of this turn
        reached.append(earlier >= slot - taken - passed)
        passed += not reached[-1]
    return table.select([*_NAME, "slot", "child"]).append_column("reached", pa.array(reached, pa.bool_()))


def _across_stems(wanted: DataFrame, slots: DataFrame, chunk: int) -> DataFrame:
    """`slots` with those that inputs of another stem take: `a_2` is slot 1 of stem `a_2` and slot 2 of stem `a`.

    No third stem has the name, and the first input of `a_2` takes it unless an input of `a` already has. So a stem's names
    depend on when the stems called like its slots begin, which is known, and on its own slot 1, which the stem it
    is called after decides. Stems are settled from the shortest on, and only those that meet: as many rounds as the longest
    chain `a`, `a_2`, `a_2_2`, ... of wanted stems has steps.
    """
    stems = wanted.groupBy(*_NAME).agg(F.min("input_seq").alias("input_seq"))
    called = (stems.where(F.col("stem").rlike(_NUMBERED))
              .withColumn("child", F.col("stem"))
              .withColumn("slot", F.regexp_extract("child", _NUMBERED, 2).cast("bigint"))
              .withColumn("stem", F.regexp_extract("child", _NUMBERED, 1)).where("slot >= 2"))
    meeting = called.join(stems.select(*_NAME), _NAME, "left_semi")
    left = written(meeting.join(slots, [*_NAME, "slot"], "left_anti"), "names-met")
    while not left.isEmpty():
        unsettled = left.select("folder", F.col("child").alias("stem"), "extension")
        ready = written(left.join(unsettled, _NAME, "left_anti"), "names-ready")
        stems_ready = ready.select(*_NAME).distinct()
        counted = _count_below(ready, wanted.join(stems_ready, _NAME, "left_semi"), "input_seq", "_earlier", chunk)
        counted = _count_below(counted, slots.join(stems_ready, _NAME, "left_semi"), "slot", "_taken", chunk)
        kinds = {f.name: f.dataType.simpleString() for f in left.schema}
        settled = written(counted.select(*_NAME, "slot", "child", "_earlier", "_taken").groupBy(*_NAME).applyInArrow(
            _who_was_first, ", ".join(f"{c} {kinds[c]}" for c in [*_NAME, "slot", "child"]) + ", reached boolean"), "names-settled")
        slots = slots.unionByName(settled.select(
            "folder", F.when(F.col("reached"), F.col("child")).otherwise(F.col("stem")).alias("stem"), "extension",
            F.when(F.col("reached"), F.lit(1).cast("bigint")).otherwise(F.col("slot")).alias("slot")))
        left = written(left.join(stems_ready, _NAME, "left_anti"), "names-met")
    return slots


def free_names(wanted: DataFrame, existing: DataFrame, clobber: bool = True,
               chunk: int = HOT_ROWS) -> DataFrame:
    """`wanted(folder, stem, extension, input_seq)` with `file_name`, the name each input writes.

    Overwriting is the default. Without it an input takes the first of `<stem>`,
    `<stem>_2`, `<stem>_3`, ... that neither `existing(folder, name)` nor an earlier input
    of the run has. Slot k of a name is free or taken; the r-th input takes the r-th free
    one, and with m inputs and e taken slots that is always among the first m + e. Slots
    that another stem's input has taken by then are taken as well.
    """
    plain = F.concat("stem", F.lit("."), "extension")
    if clobber:
        return wanted.withColumn("file_name", plain)
    keys = _NAME
    turns = rank_in_chunks(wanted, keys, "input_seq", "_turn", chunk)

    # A taken name is slot 1 as it stands, and slot N as well when it reads <stem>_N.
    found = (existing.select("folder", "name").distinct()
             .withColumn("extension", F.substr(P.ext(F.col("name")), F.lit(2)))
             .withColumn("_whole", P.stem(F.col("name"))))
    nth = F.when(F.col("_whole").rlike(_NUMBERED), F.regexp_extract("_whole", _NUMBERED, 2).cast("bigint"))
    slots = found.select("folder", "extension", F.inline(F.array(
        F.struct(F.col("_whole").alias("stem"), F.lit(1).cast("bigint").alias("slot")),
        F.struct(F.regexp_extract("_whole", _NUMBERED, 1).alias("stem"),
                 F.when(nth >= 2, nth).alias("slot"))))).where(F.col("slot").isNotNull()).distinct()
    slots = _across_stems(wanted, slots.select(*keys, "slot"), chunk)
    inputs = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_inputs"))
    sizes = slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slots")).join(inputs, keys)
    taken = attach(slots, sizes, keys, "_slots", "slot", chunk).where(F.col("_inputs").isNotNull())

    # Candidates 1..m+e, one per row of both sides, so no key ever builds a sequence.
    beyond = rank_in_chunks(taken, keys, "slot", "_nth", chunk).select(
        *keys, (F.col("_nth") + F.col("_inputs")).alias("slot"))
    candidates = turns.select(*keys, F.col("_turn").alias("slot")).unionByName(beyond)
    free = candidates.join(taken.select(*keys, "slot"), [*keys, "slot"], "left_anti")
    free = rank_in_chunks(free, keys, "slot", "_turn", chunk)
    given = turns.join(free, [*keys, "_turn"], "left")
    return given.withColumn("file_name", F.when(F.col("slot") == 1, plain).otherwise(
        F.concat("stem", F.lit("_"), F.col("slot"), F.lit("."), "extension"))).select(*wanted.columns, "file_name")
