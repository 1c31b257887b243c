"""Reading logs by byte ranges: a Python data source whose partitions are planned from a file plan.

Only what the plan names is opened, from where it says on. Lines come with their byte offsets, so nothing has to be
counted, ordered or shuffled afterwards, and a large plain log is as many tasks as its ranges.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shared_folder, written

NAME = "usage_log_lines"
SCHEMA = "path string, pos bigint, value string"
#: Suffixes of packed logs and how they are unpacked.
CODECS = {".gz": "gzip", ".zst": "zstd"}
PACKED = r"\.(zst|gz)$"
MAX_LINE_BYTES = 50 * 1024 * 1024
#: Stores that Python opens; a log elsewhere is read by Spark's text reader (readers.scan_log_lines).
OPENED = ("", "file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")
NEWLINE = 10


def log_name(path: Column) -> Column:
    """A log's name: that of its file without the suffix of compression."""
    return F.regexp_replace(path, PACKED, "")


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a file and its path there."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path)
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


@dataclass
class Range:
    """Lines of one file that begin at ``start`` or later and before ``stop``; of the file ``size`` bytes count."""

    file: str
    path: str
    start: int
    stop: int
    size: int
    codec: str | None = None


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def cut_ranges(plan: list[dict], split_bytes: int, open_cost: int) -> list[Ranges]:
    """The plan's files as partitions of about ``split_bytes``: large plain files are cut, small ones put together. A
    packed file can't be cut. Opening a file counts as ``open_cost`` bytes."""
    pieces = []
    for f in plan:
        codec = CODECS.get(os.path.splitext(f["file"])[1])
        if codec:
            pieces.append(Range(f["file"], f["path"], f["start"], 2**63 - 1, f["size"], codec))
            continue
        for low in range(f["start"], f["size"], split_bytes):
            pieces.append(Range(f["file"], f["path"], low, min(low + split_bytes, f["size"]), f["size"]))
    pieces.sort(key=lambda r: (-(min(r.stop, r.size) - r.start), r.file, r.start))
    out, held = [], 0
    for r in pieces:
        cost = min(r.stop, r.size) - r.start + open_cost
        if not out or held + cost > split_bytes:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += cost
    return out


def range_lines(source: BinaryIO, r: Range, max_line_bytes: int, block_bytes: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(starts, ends, bytes) of the range's complete lines, a block at a time: ``starts`` are offsets in the file,
    ``ends`` those in ``bytes``, which holds the lines without their line breaks.

    Of a plain file nothing outside the range is read, but for the byte before it, which tells whether a line begins at
    ``start``, and the rest of its last line. A line of over
    ``max_line_bytes`` is never held; it only moves the offset. A last line without a line break is not given out.
    """
    inside = r.start > 0 and not r.codec
    at = r.start - 1 if inside else 0  # a packed file is unpacked from its beginning; lines before start are dropped below
    if inside:
        source.seek(at)
    limit = None if r.codec else r.size
    held, line, skipping = b"", at, inside  # held: the beginning of the line that begins at ``line``
    while line < r.stop:
        want = block_bytes if limit is None else min(block_bytes, limit - at, r.stop - at if at < r.stop else 1 << 16)
        block = source.read(want) if want > 0 else b""
        if not block:
            return
        breaks = np.flatnonzero(np.frombuffer(block, dtype=np.uint8) == NEWLINE)
        if not len(breaks):
            at += len(block)
            held = b"" if skipping or len(held) + len(block) > max_line_bytes else held + block
            skipping = skipping or not held
            continue
        starts = np.append(line, at + breaks[:-1] + 1)
        sizes = at + breaks - starts
        good = (sizes <= max_line_bytes) & (starts < r.stop) & (starts >= r.start)
        good[0] &= not skipping
        data = np.frombuffer(held + block if good[0] else block, dtype=np.uint8)
        base = line if good[0] else at
        take = np.zeros(len(data) + 1, dtype=np.int64)  # +1 where a wanted line begins, -1 where it ends
        np.add.at(take, starts[good] - base, 1)
        np.add.at(take, starts[good] - base + sizes[good], -1)
        yield starts[good], np.cumsum(sizes[good]), data[np.cumsum(take[:-1]) > 0].tobytes()
        last = int(breaks[-1])
        line, skipping = at + last + 1, False
        held = block[last + 1 :]
        if len(held) > max_line_bytes:
            held, skipping = b"", True
        at += len(block)


def read_range(r: Range, max_line_bytes: int) -> Iterator[pa.RecordBatch]:
    """The range's lines as Arrow batches. A file that has gone since it was listed has none."""
    store, path = store_of(r.file)
    try:
        source = store.open_input_stream(path, compression=r.codec) if r.codec else store.open_input_file(path)
    except FileNotFoundError:
        return
    with source:
        for starts, ends, data in range_lines(source, r, max_line_bytes):
            if len(starts):
                offsets = np.append(0, ends).astype(np.int32)
                values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(starts), pa.string()), pa.array(starts, pa.int64()), values], names=["path", "pos", "value"])


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        store, folder = store_of(self.options["plan"])
        plan = pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_table().to_pylist()
        return cut_ranges(plan, int(self.options["split_bytes"]), int(self.options["open_cost"])) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from read_range(r, int(self.options["max_line_bytes"]))


class LogSource(DataSource):
    """``spark.read.format("usage_log_lines")`` with the option ``plan``, a folder with a Parquet table file, path, start,
    size; further options: split_bytes, open_cost, max_line_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LogReader:
        defaults = {"split_bytes": str(128 << 20), "open_cost": str(4 << 20), "max_line_bytes": str(MAX_LINE_BYTES)}
        return LogReader(defaults | dict(self.options))


def read_planned_lines(spark: SparkSession, plan: DataFrame, max_line_bytes: int = MAX_LINE_BYTES, split_bytes: int = 128 << 20) -> DataFrame:
    """path, pos, value of the complete lines that a plan (file, path, action, start, size; see plan_files) asks for.

    Files to skip are not opened; of the others nothing before ``start`` is read, and nothing that came after they were
    listed. The plan is a row a file; as with any file source the driver holds the list of the files to read.
    """
    todo = plan.filter("action <> 'skip'").select("file", "path", "start", "size")
    folder = f"{shared_folder(spark)}/plan-{os.urandom(8).hex()}"
    todo.coalesce(1).write.parquet(folder)
    spark.dataSource.register(LogSource)
    return spark.read.format(NAME).option("plan", folder).option("max_line_bytes", max_line_bytes).option("split_bytes", split_bytes).load()


def _per_file(files: DataFrame, made: str, work: object) -> DataFrame:
    """``work(row)`` for every row of a listing, in tasks: file and the column ``made``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["file"] for r in rows], pa.string()), pa.array([work(r) for r in rows])], names=["file", made.split()[0]])

    return files.mapInArrow(run, f"file string, {made}")


def file_heads(files: DataFrame, head_bytes: int = 256) -> DataFrame:
    """file and head, the first bytes of each as hex digits; null where it can't be opened any more."""

    def head(row: dict) -> str | None:
        store, path = store_of(row["file"])
        try:
            with store.open_input_file(path) as source:
                return source.read(head_bytes).hex().upper()
        except OSError:
            return None

    return _per_file(files.select("file"), "head string", head)


def last_line_end(source: BinaryIO, start: int, size: int, block_bytes: int = 1 << 16) -> int:
    """The offset behind the last line break in [start, size), or ``start``: read backwards, a block at a time."""
    at = size
    while at > start:
        low = max(start, at - block_bytes)
        source.seek(low)
        found = source.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def next_manifest(plan: DataFrame) -> DataFrame:
    """path, inode, offset, mtime, head after a finished read of a plan that plan_files made of list_files' rows: what
    the next plan_files takes as ``previous``.

    The offset of a plain file is the end of its last complete line among the bytes that were listed, found from the
    end; that of a packed file is its packed size, so that an untouched archive is skipped; that of a skipped file is
    the one it had.
    """
    plain = ~F.col("file").rlike(PACKED) & (F.col("action") != "skip")

    def end(row: dict) -> int:
        store, path = store_of(row["file"])
        try:
            with store.open_input_file(path) as source:
                return last_line_end(source, row["start"], row["size"])
        except FileNotFoundError:
            return row["start"]

    ends = _per_file(plan.filter(plain).select("file", "start", "size"), "line_end long", end)
    known = F.when(F.col("action") == "skip", F.col("start")).when(plain, F.coalesce("line_end", "start")).otherwise(F.col("size"))
    return written(plan.join(ends, "file", "left").select("path", "inode", known.alias("offset"), "mtime", "head"))
