"""Helpers that all corpus operators share: tables, words, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but these six ASCII white-space characters.
SPACES = "\x20\t\n\x0b\x0c\r"
#: Characters of text that Python code works on at a time.
SLICE_CHARS = 1_000_000
#: Characters that the keys of a worker's cache may hold together.
CACHE_CHARS = 16_000_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset in a local run (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = getattr(spark.sparkContext, "_meterline_dir", None)
        if made is None:
            made = "file://" + tempfile.mkdtemp(prefix="meterline-")
            spark.sparkContext._meterline_dir = made
        folder = made
    return folder.rstrip("/")


def materialize(df: DataFrame, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage is cut, a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/meterline-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._meterline_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._meterline_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def per_text(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], pd.DataFrame]], schema: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the columns of ``schema`` for every row, from a function over lists of texts.

    ``make`` runs once a task and returns that function. Only texts enter Python, by Arrow batches that are handed on
    in slices of bounded length; ids stay in the JVM, so nulls, repeats and any id type pass unchanged.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            yield pd.concat([work(part) for part in slices(batch)] or [work([])], ignore_index=True)
        pa.default_memory_pool().release_unused()  # the worker lives on after the task

    found = F.pandas_udf(run, schema)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("_found")).select("doc_id", "_found.*")


def slices(texts: Iterable[str | None], limit: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Runs of texts with about ``limit`` characters together, so that lists of their words stay small."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def word_count(text: Column) -> Column:
    """Number of contract words of a text; null counts as no words. All of it stays in the JVM: the six spaces become
    one kind and their runs shrink by plain replacement, so that words are one more than the spaces between them."""
    thin = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        thin = F.replace(thin, F.lit(space), F.lit(" "))
    for run in (16, 4, 2, 2):  # runs of spaces shrink; a text in which some are left is split instead
        thin = F.replace(thin, F.lit(" " * run), F.lit(" "))
    trimmed = F.trim(thin)
    plain = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    exact = F.size(F.filter(F.split(trimmed, " "), lambda w: w != ""))
    return F.when(trimmed == "", 0).when(F.contains(trimmed, F.lit("  ")), exact).otherwise(plain).cast("long")
