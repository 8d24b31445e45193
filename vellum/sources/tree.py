"""A folder tree as a table: the `vellum_corpus` data source.

Spark's own file listing hides names that start with `_` or `.`, which a corpus may hold.
This source lists them, prunes folders before it enters them, and gives each task its own
part of the tree. It reads local folders, and any store pyarrow reaches, by URI.
"""

import json
import os
from collections import deque

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)

from vellum import fixed
from vellum.operators import corpus

SCHEMA = "path string, name string, length bigint, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()),
                    ("modified", pa.timestamp("us", tz="UTC"))])
# Folders looked at on the driver to cut the tree into tasks, and rows per batch read.
_CUT_FOLDERS = 256
_ROWS = 8192


def open_store(uri: str):
    """(file system, path) of a local path or a URI."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        fs.LocalFileSystem(), os.path.abspath(uri))


class _Tree:
    """The pruning rules of one scan."""

    def __init__(self, options):
        self.store, self.root = open_store(options["root"])
        self.root = self.root.rstrip("/") or "/"
        self.local = isinstance(self.store, fs.LocalFileSystem)
        depth = options.get("depth", "")
        self.depth = max(int(depth), 1) if depth != "" else None
        self.clutter = set(fixed.CLUTTER_FOLDERS) if options.get("clutter", "true") == "true" else set()
        self.skip = {self._real(open_store(f)[1]) for f in json.loads(options.get("skip", "[]"))}

    def _real(self, path):
        return os.path.realpath(path) if self.local else path.rstrip("/")

    def list(self, folder, level):
        """(files, folders to enter) of one folder; an unreadable one has neither."""
        try:
            entries = self.store.get_file_info(fs.FileSelector(folder, recursive=False))
        except OSError:
            return [], []
        files = [e for e in entries if e.type == fs.FileType.File]
        if self.depth is not None and level >= self.depth:
            return files, []
        below = [e.path for e in entries if e.type == fs.FileType.Directory and e.base_name not in self.clutter
                 and not (self.local and os.path.islink(e.path)) and self._real(e.path) not in self.skip]
        return files, below


# What a filter that Spark hands down asks of a value; a listed file has all four columns.
_TESTS = {
    EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, IsNotNull: lambda v, w: True, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, StringStartsWith: lambda v, w: v.startswith(w),
    StringEndsWith: lambda v, w: v.endswith(w), StringContains: lambda v, w: w in v}


class _Wanted:
    """Filters the listing applies itself: on the path, the name and the length of a file."""

    def __init__(self):
        self.tests = []

    def take(self, given: Filter) -> bool:
        """Whether the filter is one of these; if so it is kept, and Spark need not apply it again."""
        kind, column = type(given), getattr(given, "attribute", ())
        if kind not in _TESTS or column not in (("path",), ("name",), ("length",)):
            return False
        self.tests.append((kind, column[0], getattr(given, "value", None)))
        return True

    def file(self, path, name, length):
        values = {"path": path, "name": name, "length": length}
        return all(_TESTS[kind](values[column], value) for kind, column, value in self.tests)

    def folder(self, folder):
        """Whether a file that is wanted can be below a folder."""
        start = folder.rstrip("/") + "/"
        for kind, column, value in self.tests:
            if column == "path" and kind in (StringStartsWith, EqualTo, In):
                begins = value if kind is In else [value]
                if not any(start.startswith(b) and kind is StringStartsWith or b.startswith(start) for b in begins if b is not None):
                    return False
        return True


class _Part(InputPartition):
    def __init__(self, folder, level, deep):
        self.folder, self.level, self.deep = folder, level, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.wanted = _Wanted()

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self):
        tree = _Tree(self.options)
        # Breadth first until there are enough folders; each entered one leaves a task for
        # its own files, each not yet entered one a task for everything below it.
        entered, waiting = [], deque([(tree.root, 1)])
        while waiting and len(entered) + len(waiting) < _CUT_FOLDERS:
            folder, level = waiting.popleft()
            entered.append(_Part(folder, level, False))
            waiting.extend((f, level + 1) for f in tree.list(folder, level)[1] if self.wanted.folder(f))
        return entered + [_Part(f, n, True) for f, n in waiting]

    def read(self, part):
        tree, todo, rows = _Tree(self.options), [(part.folder, part.level)], []
        while todo:
            folder, level = todo.pop()
            files, below = tree.list(folder, level)
            if part.deep:
                todo.extend((f, level + 1) for f in below if self.wanted.folder(f))
            for e in files:
                if not self.wanted.file(e.path, e.base_name, e.size):
                    continue
                rows.append({"path": e.path, "name": e.base_name, "length": e.size, "modified": e.mtime})
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class CorpusSource(DataSource):
    """Options: root, depth (empty for no limit), clutter (true prunes tool folders), skip (JSON list).

    Conditions on path, name and length reach the listing (`spark.sql.python.filterPushdown.enabled`): folders that no wanted path
    can be in are not entered.
    """

    @classmethod
    def name(cls):
        return "vellum_corpus"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _listed(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
    # Spark keeps the reader of the last query with conditions for a later one that hands none down. So every query has one.
    return spark.read.format("vellum_corpus").option("root", root).options(**options).load().where(F.col("path").isNotNull())


def scan_corpus(spark: SparkSession, root: str, formats: list[str], depth: int | None = fixed.DEFAULT_DEPTH,
                skip: list[str] = (), clutter: bool = True) -> DataFrame:
    """Convertible files under `root`, `depth` levels deep; the output folder and sidecars are never inputs."""
    listed = _listed(spark, root, depth="" if depth is None else str(depth), clutter=str(clutter).lower(), skip=json.dumps([s for s in skip if s]))
    return listed.where(corpus.supported(F.col("name"), formats) & ~corpus.P.is_sidecar(F.col("name")))


def walk_batch(spark: SparkSession, root: str, output_dir: str) -> DataFrame:
    """The bulk walk: no depth limit, no clutter list, the output folder pruned, sidecars kept to formats."""
    listed = _listed(spark, root, clutter="false", skip=json.dumps([output_dir]))
    return listed.where(corpus.supported(F.col("name"), fixed.BATCH_FORMATS))
