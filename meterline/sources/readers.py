"""Readers: log lines with byte offsets, tolerant JSON, changed-file plans and the usage CSV."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log_source import MAX_LINE_BYTES, OPENED, PACKED, file_heads, log_name, read_planned_lines


def read_log_lines(spark: SparkSession, paths: str | list[str], max_line_bytes: int = MAX_LINE_BYTES, split_bytes: int = 128 << 20) -> DataFrame:
    """path, pos, value: every complete line with its byte offset in the (unpacked) file.

    A last line without its newline is not read; lines longer than ``max_line_bytes`` are left out but still move the
    offset. The names of packed logs (.zst, .gz) lose the suffix, so that a file and its archived copy are one. Stores
    that Python can't open are read by Spark's text reader.
    """
    named = [paths] if isinstance(paths, str) else paths
    if any(urlsplit(p).scheme not in OPENED for p in named):
        return scan_log_lines(spark, paths, max_line_bytes)
    plan = _listed(spark, paths).select("file", "path", F.lit("reread").alias("action"), F.lit(0).cast("long").alias("start"), "size")
    return read_planned_lines(spark, plan, max_line_bytes, split_bytes)


def scan_log_lines(spark: SparkSession, paths: str | list[str], max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """The same by Spark's text reader alone, for stores that only Spark opens. Offsets run within one split of a file
    each, so a large file is many tasks; where a split begins is told by the bytes of the splits before it, summed in a
    scan of their own."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    rows = raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("mid"),
    )
    size = F.octet_length("value").cast("long") + 1
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    starts = splits.select("file", "block", F.coalesce(F.sum("bytes").over(of_file), F.lit(0)).alias("split_start"))
    in_split = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("here", F.sum(size).over(in_split)).join(starts, ["file", "block"])
    placed = placed.withColumn("end", F.col("split_start") + F.col("here")).withColumn("pos", F.col("end") - size)
    packed = F.col("file").rlike(PACKED)  # file_size is that of the packed bytes
    complete = packed | (F.col("end") <= F.col("file_size"))
    return placed.filter(complete & (size - 1 <= max_line_bytes)).select(log_name(F.col("file")).alias("path"), "pos", "value")


def resume_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """The lines (path, pos, value) that a plan of plan_files asks for, of lines that were read anyway (else see
    log_source.read_planned_lines, which reads no others): those at or behind ``start`` of files it does not skip. A
    file that the plan does not name is left out."""
    wanted = plan.filter("action <> 'skip'").select("path", "start")
    return lines.join(wanted, "path").filter("pos >= start").drop("start")


def parse_json_lines(lines: DataFrame, schema: str, needles: list[str], keep: str = "path, pos") -> tuple[DataFrame, DataFrame]:
    """(good, rejects): lines that hold one of ``needles``, parsed into column ``j``, and those of them that aren't JSON.

    A broken line costs only itself; lines without a needle are in neither table. ``j`` comes out of a generator, so
    that filters on its fields stay above it: pushed below, each would parse the line once for every field it names.
    """
    wanted = F.lit(False)
    for n in needles:
        wanted = wanted | F.col("value").contains(n)
    names = [c.strip() for c in keep.split(",")]
    parsed = lines.filter(wanted).select(*names, "value", F.try_parse_json("value").alias("v"))
    good = parsed.filter(F.col("v").isNotNull()).select(*names, F.explode(F.array(F.from_json("value", schema))).alias("j"))
    return good, parsed.filter(F.col("v").isNull()).select(*names, "value")


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, path, size and changed (a timestamp) of every file, from the listing alone."""
    file = F.col("_metadata.file_path")
    return spark.read.format("binaryFile").load(paths).select(file.alias("file"), log_name(file).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def list_files(spark: SparkSession, paths: str | list[str], since: datetime | None = None, head_bytes: int = 256) -> DataFrame:
    """file, path, inode, size, mtime and head of every file, as plan_files takes them.

    Sizes and times come from the listing alone. Only files changed at or after ``since`` are opened, for the signature
    of their first bytes and no more (all of them where it is None); the head of the others is null, which plan_files
    takes for unchanged. Stores have no inodes, so ``inode`` is 0: a file that was replaced shows by its size or its head.
    """
    files = _listed(spark, paths)
    changed = files if since is None else files.filter(F.col("changed") >= F.lit(since))
    named = files.select("file", "path", F.lit(0).cast("long").alias("inode"), "size", F.unix_seconds("changed").alias("mtime"))
    return named.join(file_heads(changed, head_bytes), "file", "left")


def plan_files(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """path, action, start: what to do with each listed file, given the last run's (path, inode, offset, mtime, head);
    the listing's other columns are kept, as read_planned_lines and next_manifest take them.

    New, rebuilt (another inode), truncated or rewritten at its head: reread from 0. Of the same size: skip. Grown:
    resume at the last offset; a packed file, whose offset is its packed size, is read again as a whole. A log and its
    archived copy have one name: listed both, each is held against the offset of that name.
    """
    old = previous.select("path", F.col("inode").alias("old_inode"), F.col("offset").alias("old_offset"), F.col("head").alias("old_head"))
    seen = manifest.join(old, "path", "left")
    changed_head = (F.coalesce("old_head", F.lit("")) != "") & (F.col("old_head") != F.col("head"))
    changed_head = F.coalesce(changed_head, F.lit(False))  # a file that was not opened again has no head
    reread = F.col("old_offset").isNull() | (F.col("inode") != F.col("old_inode")) | (F.col("size") < F.col("old_offset")) | changed_head
    if "file" in manifest.columns:
        reread = reread | F.col("file").rlike(PACKED) & (F.col("size") != F.col("old_offset"))
    action = F.when(reread, "reread").when(F.col("size") == F.col("old_offset"), "skip").otherwise("resume")
    planned = seen.withColumn("action", action).withColumn("start", F.when(reread, F.lit(0)).otherwise(F.col("old_offset")).cast("long"))
    kept_head = F.when(F.col("action") != "reread", F.coalesce("head", "old_head")).otherwise(F.col("head"))
    others = [kept_head.alias(c) if c == "head" else F.col(c) for c in manifest.columns if c != "path"] if "file" in manifest.columns else []
    return planned.select("path", "action", "start", *others)


CSV_REQUIRED = ["Date", "Model", "Input (w/o Cache Write)", "Cache Read", "Output Tokens"]


def read_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """The dashboard's usage export: pos and the columns found by header name, as text.

    A missing required column is an error; a byte-order mark is dropped; a row too short for the required columns is
    left out, while an empty cell stays as the empty text. The path may be a folder of exports with one header.
    """
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    head = lines.orderBy("pos").limit(1).collect()
    if not head:
        raise ValueError("empty usage CSV")
    first = head[0]["value"].lstrip("﻿")
    width = spark.range(1).select(F.from_csv(F.lit(first), F.lit(", ".join(f"c{i} string" for i in range(first.count(",") + 1)))).alias("c")).first()["c"]
    columns = [str(x).strip() for x in width if x is not None]
    missing = [c for c in CSV_REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"unrecognized usage CSV header: missing {missing}")
    # One more mark at the end of each line: the fields of a short row end before the last required column.
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = lines.filter(F.col("value") != head[0]["value"]).filter(F.trim("value") != "").select(
        "pos", F.from_csv("value", F.lit(schema), {"escape": '"', "nullValue": "\u0001", "emptyValue": ""}).alias("c")
    )
    last = max(columns.index(c) for c in [*CSV_REQUIRED, *[c for c in ("Input (w/ Cache Write)",) if c in columns]])
    named = [F.col(f"c.c{i}").alias(c) for i, c in enumerate(columns)]
    return parsed.filter(F.col(f"c.c{last}").isNotNull()).select((F.col("pos") + 1).alias("pos"), *named)
