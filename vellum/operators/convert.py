"""The converter port: bytes and a name in, files and versions out, in bulk and row by row safe.

A converter is any callable `convert(data, name, options, resources) -> (files, versions)`
with `files` a dict of relative names to bytes. What it loads once, it gets back as
`resources` for every document its Python worker sees.
"""

import contextlib
import hashlib
import multiprocessing
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from vellum import fixed
from vellum.functions import paths as P
from vellum.sources.tree import open_store

Converter = Callable[[bytes, str, dict, object], tuple[dict[str, bytes], dict[str, str]]]

RESULT = ("path string, name string, backend string, ok boolean, error string, seconds double, "
          "started timestamp, finished timestamp, "
          "files array<struct<name:string,body:binary>>, versions map<string,string>")

# Results handed back to the JVM per batch; bodies are large.
_OUT_BYTES = 8 * 1024 * 1024
_RESOURCES: dict = {}


def _resources(key: tuple, load: Callable[[], object] | None):
    """Loaded once per Python worker and loader, and reused by every task it runs."""
    if load is None:
        return None
    if key not in _RESOURCES:
        _RESOURCES[key] = load()
    return _RESOURCES[key]


class Produced:
    """A folder a converter fills; what is in it at the end, by relative name, is the result."""

    def __init__(self, top: Path):
        self.top = top

    def files(self) -> dict[str, bytes]:
        return {p.relative_to(self.top).as_posix(): p.read_bytes() for p in sorted(self.top.rglob("*")) if p.is_file()}


def on_file(convert: Callable) -> Converter:
    """A converter that reads and writes files, `convert(source, folder, options, resources) -> versions`.

    Document and results are scratch of the running task, gone when the document is done.
    """
    def port(data, name, options, resources):
        with tempfile.TemporaryDirectory(prefix="vellum-document-") as scratch:
            source, results = Path(scratch, "document", name), Path(scratch, "results")
            for folder in (source.parent, results):
                folder.mkdir()
            source.write_bytes(data)
            versions = convert(str(source), str(results), options, resources)
            return Produced(results).files(), versions
    return port


def _instant(epoch: float) -> pd.Timestamp:
    """A POSIX time to the microsecond, which is what a timestamp column holds."""
    return pd.Timestamp(int(epoch * 1_000_000), unit="us")


def _attempt(convert: Converter, data: bytes, name: str, options: dict, resources) -> tuple:
    """(files, versions, error) of one document; a failure is a result, not an exception."""
    try:
        files, versions = convert(data, name, options, resources)
        kept = {n: b for n, b in files.items()
                if n != fixed.SIDECAR_NAME and not n.endswith(fixed.SIDECAR_SUFFIX)}
        return sorted(kept.items()), {k: str(v) for k, v in versions.items()}, None
    except Exception as exc:  # noqa: BLE001 - one bad document must not stop the rest
        return None, None, f"{type(exc).__name__}: {exc}"


class _Helper:
    """A child process that converts one document after another and can be ended at a deadline."""

    def __init__(self, convert, load):
        context = multiprocessing.get_context("fork")
        self.pipe, end = context.Pipe()
        self.child = context.Process(target=self._serve, args=(end, convert, load), daemon=True)
        self.child.start()
        end.close()

    @staticmethod
    def _serve(pipe, convert, load):
        resources, fault = None, None
        try:
            resources = load() if load else None
        except Exception as exc:  # noqa: BLE001 - every document sent here gets this error
            fault = (None, None, f"{type(exc).__name__}: {exc}")
        while True:
            try:
                data, name, options = pipe.recv()
            except EOFError:
                os._exit(0)
            pipe.send(fault or _attempt(convert, data, name, options, resources))

    def run(self, data, name, options, limit):
        """(result, alive): past `limit` seconds, or if the process died, it must be replaced."""
        try:
            self.pipe.send((data, name, options))
            return (self.pipe.recv(), True) if self.pipe.poll(limit) else (
                (None, None, f"Timeout: longer than {limit} seconds"), False)
        except (EOFError, OSError):
            return (None, None, "ConverterDied: the converter's process ended"), False

    def close(self):
        self.pipe.close()
        self.child.kill()
        self.child.join()


def _read(path: str) -> bytes:
    store, local = open_store(path)
    with store.open_input_stream(local) as source:
        return source.read()


def convert_documents(documents: DataFrame, backend: str, convert: Converter,
                      load: Callable[[], object] | None = None, deadlines: bool = False,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """`documents(path, name[, content][, options][, timeout])` converted in bulk, one result row each.

    Without `content` the task that converts a document reads it from its `path`, so bodies
    never travel with the plan. `options` is a map; the caller's output_dir is dropped,
    since where files end up is the sink's business. With `deadlines` each row has its own
    `timeout` in seconds and its document is ended when it is over. The name is made safe
    first and keeps its extension, by which converters choose a reader. Columns in `keep`
    come back beside the result, which saves joining it to its input.
    """
    return convert_routed(documents.withColumn("backend", F.lit(backend)), {backend: (convert, load)}, deadlines, keep)


def convert_routed(documents: DataFrame, converters: dict[str, tuple[Converter, Callable | None]],
                   deadlines: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same with a `backend` column choosing each document's converter: one pass over the bodies."""
    given = set(documents.columns)
    sent = F.col("options") if "options" in given else F.lit(None).cast("map<string,string>")
    wanted = documents.select(
        "path", P.safe_name(F.col("name")).alias("name"), "backend",
        *(["content"] if "content" in given else []),
        F.map_filter(F.coalesce(sent, F.expr("cast(map() as map<string,string>)")),
                     lambda k, _: k != "output_dir").alias("options"),
        *(["timeout"] if deadlines else []),
        *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = [f"keep_{c}" for c in keep]
    # A worker is reused by other runs: resources belong to the loader as it is, not to a backend's name.
    loaders = {name: (name, load and hashlib.sha256(cloudpickle.dumps(load)).hexdigest()) for name, (_, load) in converters.items()}
    held = "content" in given

    def convert_row(row, helpers: dict) -> tuple:
        try:
            data = bytes(row.content) if held else _read(row.path)
        except Exception as exc:  # noqa: BLE001 - an unreadable document is that document's failure
            return None, None, f"{type(exc).__name__}: {exc}"
        if row.backend not in converters:
            return None, None, f"UnknownBackend: {row.backend}"
        convert, load = converters[row.backend]
        if not deadlines:
            try:
                resources = _resources(loaders[row.backend], load)
            except Exception as exc:  # noqa: BLE001 - what cannot be loaded fails its documents, not the run
                return None, None, f"{type(exc).__name__}: {exc}"
            return _attempt(convert, data, row.name, dict(row.options), resources)
        if row.backend not in helpers:
            helpers[row.backend] = _Helper(convert, load)
        done, alive = helpers[row.backend].run(data, row.name, dict(row.options), row.timeout)
        if not alive:
            helpers.pop(row.backend).close()
        return done

    def converted(batch: pd.DataFrame, helpers: dict) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in batch.itertuples(index=False):
            if not deadlines and row.backend in converters:     # loading is not part of any document's seconds
                with contextlib.suppress(Exception):            # the row will say why
                    _resources(loaders[row.backend], converters[row.backend][1])
            started, clock = time.time(), time.perf_counter()
            files, versions, error = convert_row(row, helpers)
            seconds = round(time.perf_counter() - clock, 3)
            rows.append((row.path, row.name, row.backend, error is None, error, seconds,
                         _instant(started), _instant(started + seconds),
                         [{"name": n, "body": b} for n, b in files or []], versions or {},
                         *(getattr(row, k) for k in kept)))
            size += sum(len(b) for _, b in files or [])
            if size > _OUT_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        helpers = {}
        try:
            for batch in batches:   # results leave with their batch: short ones would gather until the partition ends
                yield from converted(batch, helpers)
                del batch           # or it would stay while the next one is read
        finally:
            for helper in helpers.values():
                helper.close()

    columns = [c.split()[0] for c in RESULT.split(", ")] + list(keep)
    schema = RESULT + "".join(f", {c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return wanted.mapInPandas(run, schema)


def spread_by_cost(documents: DataFrame, cost: str, key: str, per_task: float) -> DataFrame:
    """Documents over enough tasks that each holds about `per_task` of `cost`.

    A row count says little about work: one scan may cost more than a thousand notes. The
    total is one number read on the driver; rows go to tasks by a hash of `key`, so a
    task that is run again sees the same rows.
    """
    total = documents.agg(F.sum(F.col(cost).cast("double"))).first()[0] or 0.0
    tasks = int(max(1, -(-total // per_task)))
    return documents.repartition(tasks, key)
