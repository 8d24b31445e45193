"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads.

A record file is a row of frames, each

    length     unsigned 64 bits, little endian: bytes of the payload
    check      unsigned 32 bits: masked CRC-32 of the 8 bytes before
    payload    one byte with the bytes per id (2 or 4), then the ids, little endian
    check      unsigned 32 bits: masked CRC-32 of the payload

with the mask of record files: the checksum turned right by 15 bits plus a constant, so that a checksum over data that
holds checksums stays sound. Files hold the documents in ascending id order, one file per range of ids. The index is a
table of its own: file, place and size of each record, so any order of reading needs one seek per record.

A task writes a file with a name no other attempt uses; the index, which Spark commits, names only files of tasks that
ended, so lost executors leave at most files that nothing refers to.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellum.llm import common
from vellum.llm.encoding import encoder

MASK = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
READ_AHEAD = 4 << 20


class BadRecord(ValueError):
    """A frame whose lengths or checksums do not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    """One record; ids are 16 or 32 bits wide."""
    payload = bytes([ids.dtype.itemsize]) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> np.ndarray:
    """The ids of one record as unsigned 32-bit integers; raises BadRecord if it is damaged."""
    if len(record) < HEAD.size + 1 + TAIL.size:
        raise BadRecord("a record is cut short")
    length, check = HEAD.unpack_from(record)
    if check != masked(record[:8]) or len(record) != HEAD.size + length + TAIL.size:
        raise BadRecord("the length of a record is damaged")
    payload = record[HEAD.size:HEAD.size + length]
    if TAIL.unpack_from(record, HEAD.size + length)[0] != masked(payload):
        raise BadRecord("the payload of a record is damaged")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def file_system(folder: str):
    """The pyarrow file system of a folder given as a URI or a path, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes `docs` and writes record files below `folder` and their index to `folder`/index.

    Null texts are empty, so their record holds the end id alone; null ids come first; rows with one id follow each
    other by the hash of their text. An empty table gives an empty index. `tokenizer` is a file that every worker has.
    """
    schema = "doc_id long, file string, part long, offset long, size long, before long, n_tokens long"

    def write(batches):
        system, base = file_system(folder)
        part = TaskContext.get().partitionId()
        name, out, offset, before = f"part-{part:06d}-{uuid.uuid4().hex}.rec", None, 0, 0
        encode = encoder(tokenizer).encode
        try:
            for batch in batches:
                ids, texts = batch.column("doc_id"), common.strings(batch)
                if out is None and len(texts):
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                for some in common.slices(texts):
                    rows = []
                    for tokens in encode(texts[some.start:some.stop]):
                        record = frame(np.append(tokens, np.array([end_id], tokens.dtype)))
                        out.write(record)
                        rows.append((offset, len(record), before, len(tokens) + 1))
                        offset += len(record)
                        before += len(tokens) + 1
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(some.start, len(some)), pa.array([name] * len(rows)), pa.array([part] * len(rows), pa.int64()),
                         *columns], names=["doc_id", "file", "part", "offset", "size", "before", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(common.shuffle_partitions(docs.sparkSession), "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    common.mapped(ordered, write, schema).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index, with `start`: the number of ids in all records before each one, over all files."""
    index = spark.read.parquet(f"{folder}/index")
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("held"))  # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    return index.join(files, "file").select("doc_id", "file", "offset", "size", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The ids of each row of `index` (any part of it, in any order), read from the files: doc_id, start, ids."""
    def read(batches):
        system, base = file_system(folder)
        held, low, window, source = None, 0, b"", None
        for batch in batches:
            ids = []
            for name, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if name != held:
                    source, held, low, window = system.open_input_file(f"{base}/{name}"), name, 0, b""
                if not low <= offset <= offset + size <= low + len(window):
                    low, window = offset, source.read_at(max(size, READ_AHEAD), offset)
                ids.append(unframe(window[offset - low:offset - low + size]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.binary())],
                                             names=["doc_id", "start", "ids"])

    wanted = index.select("doc_id", "start", "file", "offset", "size").sortWithinPartitions("file", "offset")
    return common.mapped(wanted, read, "doc_id long, start long, ids binary")
