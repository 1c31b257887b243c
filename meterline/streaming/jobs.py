"""Structured Streaming jobs over directories of immutable log chunks.

A chunk is a text file named ``<log name>@<chunk number>``; chunks of one log arrive in order of their numbers. A
line's place is (chunk number, place in chunk): rows of a key are sorted by it before they are folded, since order in
a micro-batch does not survive a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.measures import RECORD, as_records, with_derived
from ..operators.merge import merge_first
from ..sources import counters, inference
from ..sources.sinks import merge_into_ledger
from .processors import CLOCK, CONTEXT_OUT, INFERENCE_OUT, PARTS, RECORD_OUT, Bucketed, CounterContext, Expiring, ForkJudge, InferenceContext, Numbered, keep_state_in_rocks

#: Buckets that the keys of a stream share, fixed as long as its checkpoint is used: some ten thousand live keys each.
BUCKETS = 64


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """path, pos, value of the chunks under ``folder``: path is the log's name, pos its chunk number and the line's
    place in it. A chunk is read as one text (it should stay under some hundred MB), which is what gives its lines
    their places; compressed chunks are read by Spark itself."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    name = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.zst$", "")
    cut = raw.select(F.regexp_replace(name, r"@\d+$", "").alias("path"), F.regexp_extract(name, r"@(\d+)$", 1).cast("long").alias("chunk"), F.posexplode(F.split("value", "\n")).alias("place", "value"))
    return cut.filter("value <> ''").select("path", (F.col("chunk") * (1 << 33) + F.col("place")).alias("pos"), "value")


def stream_ledger(records: DataFrame, ledger: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_first) -> StreamingQuery:
    """Merges streamed records into the ledger at a path, a micro-batch at a time, until the input is used up.

    Only days that a batch touches, or that hold stored rows of its keys, are read and rewritten, and come into force
    together with one snapshot. A batch that is tried again after a failure finds its keys there and changes nothing,
    so ledger and checkpoint agree.
    """

    def absorb(batch: DataFrame, _: int) -> None:
        batch = batch.select(*RECORD.names).persist()
        if not batch.isEmpty():
            merge_into_ledger(batch, ledger, merge)
        batch.unpersist()

    return records.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clocked(rows: DataFrame) -> DataFrame:
    """Rows with the time of their micro-batch, the clock of the processors' timers. No row is late by it."""
    return rows.withColumn(CLOCK, F.current_timestamp()).withWatermark(CLOCK, "0 seconds")


def stateful(rows: DataFrame, key: list[str], processor: Expiring, out: str, initial: DataFrame | None, buckets: int, kind: type[Bucketed] = Bucketed, dealt: list[str] | None = None) -> DataFrame:
    """``rows`` folded by key with a processor; ``initial`` has the key and what the processor starts from. Keys meet in
    buckets, by the key or what else they are ``dealt`` by."""
    keep_state_in_rocks(rows.sparkSession)
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*(dealt or key)), F.lit(buckets))).groupBy("bucket")
    start = {} if initial is None else {"initialState": bucketed(initial)}
    clock = CLOCK if f"{CLOCK} timestamp" in out else ""  # what follows goes by the same clock
    return bucketed(rows).transformWithStateInPandas(kind(processor, key), out, "Append", "EventTime", eventTimeColumnName=clock, **start)


def counter_contexts(lines: DataFrame) -> DataFrame:
    """What the batch job has read of every counter file, as the stream's initial state: its last context and counters.
    Fork lines in it are settled: the batch job has judged them."""
    rows, at = counters.parse_counter_lines(lines), F.struct("pos", "path")
    turn, meta, count = (F.col("kind") == k for k in ("turn", "meta", "count"))
    last = lambda c, where: F.max_by(c, F.when(where & F.col(c).isNotNull(), at))
    some = F.greatest(*[F.col(c) for c in PARTS]) > 0
    return rows.groupBy("rollout").agg(
        last("turn_model", turn).alias("model"), last("cwd", turn).alias("project"), F.min_by("cwd", F.when(meta & F.col("cwd").isNotNull(), at)).alias("first_cwd"), last("meta_id", meta).alias("sid"),
        F.coalesce(F.max_by(F.array(*PARTS), F.when(count & (F.col("ts") != 0), at)), F.array(*[F.lit(0).cast("long")] * 5)).alias("base"), F.coalesce(F.bool_or(count & some), F.lit(False)).alias("counted"),
    )


def session_totals(lines: DataFrame) -> DataFrame:
    """session_id, rollout, totals: what forks of files that the batch job has read may repeat."""
    rows = counters.parse_counter_lines(lines).filter("kind = 'count'").withColumn("session_id", counters.own_session(F.col("rollout")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path", "total")))
    return rows.filter("session_id IS NOT NULL").groupBy("session_id", "rollout").agg(F.transform(ordered, lambda x: x["total"]).alias("totals"))


def stream_counter_deltas(lines: DataFrame, totals: DataFrame | None = None, contexts: DataFrame | None = None, wait_ms: int = 3_600_000, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Records of streamed counter files, forked ones among them: parent and child may come in any order.

    Two processors follow each other: CounterContext folds each file, ForkJudge compares forked files with what their
    parents have said, and lets a child wait for it until rows of any file arrive ``wait_ms`` later. ``contexts`` (of
    counter_contexts) and ``totals`` (of session_totals) are where a batch job left off. A file's state goes when it has
    been idle for ``idle_ms`` by the same clock; a later chunk is then read as a file that inherited its counters.
    The children of one session are judged under its key: a chain of forks spreads, the forks of one session don't.
    """
    rows = counters.parse_counter_lines(lines).withColumn("own", counters.own_session(F.col("rollout")))
    known = None if totals is None else totals.select(F.col("session_id").alias("key"), "rollout", F.col("totals").cast("array<bigint>").alias("totals"))
    folded = stateful(clocked(rows), ["rollout"], CounterContext(idle_ms), CONTEXT_OUT, contexts, buckets)
    judged = stateful(folded, ["key"], ForkJudge(wait_ms, idle_ms), RECORD_OUT, known, buckets)
    key = F.concat(F.lit("codex:"), F.col("rollout"), F.lit(":"), F.col("pos").cast("string"))
    return as_records(judged, source="codex", category="main", source_file=F.col("path"), dedup_key=key)


def marked(rows: DataFrame) -> DataFrame:
    """Rows of a unified log with ``mark``, which the inferences of one session, time and loop share (0: no inference
    that counts), and ``alone``, the mark of those without a session."""
    mark = F.when(inference.counts(), F.xxhash64("path", "sid", "ts_raw", "loop")).otherwise(F.lit(0))
    return rows.withColumn("mark", mark).withColumn("alone", F.when(F.col("sid") == "", F.col("mark")))


def inference_contexts(lines: DataFrame) -> DataFrame:
    """path, sid, alone, model, project, told: where the batch job left every session of a unified log, and by spans of
    time how often it met each mark."""
    rows = marked(inference.parse_inference_lines(lines))
    last = lambda c, kind: F.max_by(c, F.when((F.col("kind") == kind) & F.col(c).isNotNull(), F.col("pos")))
    contexts = rows.filter("sid <> ''").groupBy("path", "sid").agg(last("own_model", "model").alias("model"), last("own_cwd", "session").alias("project"))
    times = rows.filter("mark <> 0").groupBy("path", "sid", "alone", "ts", "mark").agg(F.count(F.lit(1)).alias("n"))
    told = times.groupBy("path", "sid", "alone", F.floor(F.col("ts") / Numbered.SPAN)).agg(F.collect_list(F.struct("ts", "mark", "n")).alias("told"))
    return contexts.unionByName(told.select("path", "sid", "alone", "told"), allowMissingColumns=True)


def stream_inference_context(lines: DataFrame, observer: bool = False, contexts: DataFrame | None = None, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Records of a streamed unified log. Several inferences of a session with one time and loop are told apart by their
    keys, as inference.apart does. Rows without a session have no context, so they are dealt to all buckets."""
    rows = marked(inference.parse_inference_lines(lines))
    folded = stateful(clocked(rows), ["path", "sid"], InferenceContext(idle_ms), INFERENCE_OUT, contexts, buckets, Numbered, ["path", "sid", "alone"])
    return inference.inference_records(folded, observer)


def stream_dedup(records: DataFrame, delay: str = "2 days") -> DataFrame:
    """A live view without repeated keys: exact within the watermark. The ledger itself is exact by its merge."""
    return records.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def stream_daily_totals(records: DataFrame, delay: str = "2 days") -> DataFrame:
    """Running tokens by local day and display source. A day's window starts at 16:00 UTC, local midnight; late rows go
    to their own day while the watermark has not passed it."""
    rows = with_derived(records).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    grouped = rows.groupBy(F.window("at", "1 day", startTime="16 hours"), "display_source").agg(F.sum("total_norm").alias("tokens"))
    return grouped.select(F.date_format(F.date_add(F.to_date("window.start"), 1), "yyyy-MM-dd").alias("day"), "display_source", "tokens")
