"""The durable ledger: days of immutable files, and snapshots that say which files are its days.

    data/commit=<id>/date_local=<day>/    rows of a day, written once, never changed
    keys/commit=<id>/date_local=<day>/    hashes of the day's keys, to find the days that a batch meets
    snapshots/<number>/                   (day, commit) of every day; complete once it holds _SUCCESS

A write adds files and then one snapshot. Whatever stops it before that leaves the last snapshot as it was, whole and
readable; files that no snapshot names are nobody's and go with vacuum(). There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import COLUMNS
from ..functions.scalars import local_day

#: Files of a day; its rows are dealt to them by key.
FILES_A_DAY = 8


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    store, place = _folder(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ledger's complete snapshots, in order."""
    found = [n for n in _names(spark, f"{path}/snapshots") if n.isdigit()]
    return sorted(int(n) for n in found if "_SUCCESS" in _names(spark, f"{path}/snapshots/{n}"))


def snapshot_days(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """The commit that holds each day, in the last snapshot or an earlier one; a row a day comes to the driver."""
    have = snapshots(spark, path)
    if number is None and not have:
        return {}
    return {r["day"]: r["commit"] for r in spark.read.parquet(f"{path}/snapshots/{have[-1] if number is None else number}").collect()}


def _days(spark: SparkSession, path: str, kind: str, held: dict[str, str]) -> DataFrame | None:
    if not held:
        return None
    places = [f"{path}/{kind}/commit={c}/date_local={d}" for d, c in sorted(held.items())]
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*places).drop("commit")


def read_ledger(spark: SparkSession, path: str, days: Iterable[str] | None = None, number: int | None = None) -> DataFrame:
    """The ledger with its column date_local, or only some of its days: no file of another day is in the plan. ``number``
    is an earlier snapshot. A ledger without rows has its columns."""
    held = snapshot_days(spark, path, number)
    wanted = held if days is None else {d: c for d, c in held.items() if d in set(days)}
    found = _days(spark, path, "data", wanted)
    from ..functions.measures import RECORD

    return spark.createDataFrame([], RECORD).withColumn("date_local", local_day(F.col("ts"))) if found is None else found


def key_hash() -> Column:
    """What a row is found by: its key, that of its message for the iterations of one (they replace each other)."""
    return F.xxhash64("source", F.regexp_replace("dedup_key", r":iteration:\d+$", ""))


def write_ledger(df: DataFrame, path: str, days: Iterable[str] | None = None) -> int:
    """Writes the days that ``df`` holds, and takes away those of ``days`` that it does not hold; others stay as they
    are. Returns the new snapshot's number. ``df`` may read the ledger itself."""
    spark = df.sparkSession
    commit, held = uuid.uuid4().hex, snapshot_days(spark, path)
    dated = df.select(*COLUMNS).withColumn("date_local", local_day(F.col("ts")))
    dealt = dated.repartition("date_local", F.pmod(F.xxhash64("dedup_key"), F.lit(FILES_A_DAY)))
    dealt.write.partitionBy("date_local").parquet(f"{path}/data/commit={commit}")
    made = [n.partition("=")[2] for n in _names(spark, f"{path}/data/commit={commit}") if n.startswith("date_local=")]
    if made:
        rows = _days(spark, path, "data", dict.fromkeys(made, commit))
        hashes = rows.select(key_hash().alias("key"), "date_local").repartition("date_local").sortWithinPartitions("date_local", "key")
        hashes.write.partitionBy("date_local").parquet(f"{path}/keys/commit={commit}")
    gone = set(days or ()) | set(made)
    return _swap(spark, path, {d: c for d, c in held.items() if d not in gone} | dict.fromkeys(made, commit))


def _swap(spark: SparkSession, path: str, held: dict[str, str]) -> int:
    """The one step that changes the ledger: a new snapshot, whose last file makes it complete."""
    number = max([int(n) for n in _names(spark, f"{path}/snapshots") if n.isdigit()], default=0) + 1
    spark.createDataFrame(sorted(held.items()), "day string, commit string").coalesce(1).write.parquet(f"{path}/snapshots/{number}")
    return number


def days_met(spark: SparkSession, path: str, batch: DataFrame) -> list[str]:
    """Days of the ledger that hold a row whose key, or message, is in ``batch``: by the keys' hashes alone, eight bytes
    a stored row; the ledger's rows are not read."""
    held = snapshot_days(spark, path)
    stored = _days(spark, path, "keys", held)
    if stored is None:
        return []
    met = stored.join(batch.select(key_hash().alias("key")).distinct(), "key", "left_semi").select(F.date_format("date_local", "yyyy-MM-dd").alias("day"))
    return [r["day"] for r in met.distinct().collect()]


def merge_into_ledger(batch: DataFrame, path: str, merge: object) -> int:
    """Merges records into the ledger; only days that the batch is of, or that hold a stored row of its keys, are read
    and written again. A batch that is merged again changes nothing."""
    from ..operators.merge import supersede_base

    spark = batch.sparkSession
    own = [r["day"] for r in batch.select(F.date_format(local_day(F.col("ts")), "yyyy-MM-dd").alias("day")).distinct().collect()]
    days = sorted(set(own) | set(days_met(spark, path, batch)))
    stored = read_ledger(spark, path, days).select(*COLUMNS)
    return write_ledger(supersede_base(merge(stored, batch)), path, days)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes snapshots but for the last ``keep``, and the files that none of those names; returns how many commits
    went. Readers of older snapshots must have ended, and no write be under way."""
    kept = snapshots(spark, path)[-keep:]
    used = {c for n in kept for c in snapshot_days(spark, path, n).values()}
    gone = [n for n in _names(spark, f"{path}/data") if n.startswith("commit=") and n[7:] not in used]
    old = [n for n in _names(spark, f"{path}/snapshots") if not n.isdigit() or int(n) not in kept]
    for place in [*[f"snapshots/{n}" for n in old], *[f"{kind}/{n}" for n in gone for kind in ("data", "keys")]]:
        store, folder = _folder(spark, f"{path}/{place}")
        store.delete(folder, True)
    return len(gone)
