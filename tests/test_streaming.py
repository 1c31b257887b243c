"""Streaming jobs against the batch jobs they re-aim."""

import json

import pytest
from pyspark.sql import functions as F
from test_golden import UUID, fork, snap, totals

from meterline.functions.measures import RECORD, with_derived
from meterline.operators.merge import merge_largest
from meterline.plans import raw_inputs as raw
from meterline.sources import counters, inference
from meterline.sources.sinks import read_ledger
from meterline.streaming import jobs

NAME = f"rollout-2024-01-01T00-00-00-{UUID}"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def chunk(folder, name, number, lines):
    folder.mkdir(exist_ok=True)
    text = "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)
    (folder / f"{name}@{number}").write_text(text)


def drain(records, tmp_path, ledger="ledger", **how):
    query = jobs.stream_ledger(records, str(tmp_path / ledger), str(tmp_path / f"check-{ledger}"), **how)
    query.awaitTermination()
    assert query.exception() is None


def test_counters_over_restarts_equal_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    older = spark.createDataFrame([(f"{UUID}1"[-36:], "older", [10, 20, 30, 40])], "session_id string, rollout string, totals array<bigint>")
    run = lambda: drain(jobs.stream_counter_deltas(jobs.stream_lines(spark, str(logs)), older, wait_ms=1), tmp_path)
    chunk(logs, f"{NAME}1.jsonl", 1, [{"type": "turn_context", "payload": {"model": "m1", "cwd": "/w"}}, snap(300, 200, 0, 100)])
    chunk(logs, f"{NAME}2.jsonl", 1, [fork(1)])
    run()
    chunk(logs, f"{NAME}1.jsonl", 2, [snap(800, 500, 100, 300), snap(800, 500, 100, 300), snap(1500, 900, 200, 600)])
    chunk(logs, f"{NAME}2.jsonl", 2, totals(10, 20))
    chunk(logs, f"{NAME}3.jsonl", 1, [fork(9), *totals(135000000, 135000500)])
    run()
    chunk(logs, f"{NAME}2.jsonl", 3, totals(30, 55))  # its arrival ends the wait of the third file
    run()
    got = read_ledger(spark, str(tmp_path / "ledger")).orderBy("source_file", "pos").collect()
    assert [(r.source_file[-7], r.total_tokens) for r in got] == [("1", 300), ("1", 500), ("1", 700), ("2", 25), ("3", 500)]
    assert got[1].model == "m1" and got[1].project == "/w"
    before = len(got)
    run()
    assert read_ledger(spark, str(tmp_path / "ledger")).count() == before


def test_streamed_logs_equal_batch(spark, sf_dir, tmp_path):
    """The derived counter and inference logs, cut into two chunks each."""
    rows = raw.counter_lines(spark, sf_dir).filter("pos < 800").orderBy("path", "pos").collect()
    for name in sorted({r.path for r in rows}):
        own = [r for r in rows if r.path == name]
        half = len(own) // 2
        for k, part in enumerate((own[:half], own[half:])):
            chunk(tmp_path / f"c{k}", name.rsplit("/", 1)[1], k, [r.value for r in part])
    want = counters.normalize_counter_files(raw.counter_lines(spark, sf_dir).filter("pos < 800")).groupBy("session_id").agg(F.sum("total_tokens").alias("t"), F.count("*").alias("n"))
    (tmp_path / "c").mkdir()
    for k in (0, 1):
        for f in (tmp_path / f"c{k}").iterdir():
            f.rename(tmp_path / "c" / f.name)
        drain(jobs.stream_counter_deltas(jobs.stream_lines(spark, str(tmp_path / "c"))), tmp_path, "counters")
    got = read_ledger(spark, str(tmp_path / "counters")).groupBy("session_id").agg(F.sum("total_tokens").alias("t"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_inference_equals_batch(spark, sf_dir, tmp_path):
    lines = raw.inference_lines(spark, sf_dir).orderBy("pos").collect()
    for k in range(2):
        chunk(tmp_path / "i", "unified.jsonl", k, [r.value for r in lines[k * 500 : k * 500 + 500]])
        drain(jobs.stream_inference_context(jobs.stream_lines(spark, str(tmp_path / "i"))), tmp_path, "inference", merge=merge_largest)
    pick = ["dedup_key", "model", "project", "total_tokens"]
    want = inference.normalize_inference_events(raw.inference_lines(spark, sf_dir)).select(*pick)
    assert sorted(map(tuple, read_ledger(spark, str(tmp_path / "inference")).select(*pick).collect())) == sorted(map(tuple, want.collect()))


def test_inferences_of_one_second_are_told_apart(spark, tmp_path):
    """Several inferences of a session with one time and loop, in one micro-batch and over two: each is kept, with the
    keys that the batch job gives, and a stream that starts anew over the same log changes nothing."""
    line = lambda sid, n: {"ts": "2024-01-01T00:00:00Z", "sid": sid, "msg": "shell.turn.inference_done", "ctx": {"loop_index": "0", "prompt_tokens": n, "completion_tokens": 1}}
    parts = [[line("s", 1), line("s", 2), line("", 3), line("t", 4)], [line("s", 5), line("", 6), line("", 7)]]
    for k, part in enumerate(parts):
        chunk(tmp_path / "i", "unified.jsonl", k, part)
        drain(jobs.stream_inference_context(jobs.stream_lines(spark, str(tmp_path / "i")), buckets=3), tmp_path, "inference")
    shown = lambda df: sorted(map(tuple, df.select("dedup_key", "total_tokens").collect()))
    data = [("unified.jsonl", i, json.dumps(x)) for i, x in enumerate(x for part in parts for x in part)]
    lines = spark.createDataFrame(data, "path string, pos long, value string")
    want = shown(inference.apart(inference.normalize_inference_events(lines)))
    assert len(want) == 7 and shown(read_ledger(spark, str(tmp_path / "inference"))) == want
    query = jobs.stream_ledger(jobs.stream_inference_context(jobs.stream_lines(spark, str(tmp_path / "i")), buckets=5), str(tmp_path / "inference"), str(tmp_path / "anew"))
    query.awaitTermination()
    assert shown(read_ledger(spark, str(tmp_path / "inference"))) == want
    begun = jobs.inference_contexts(lines.filter("pos < 4"))
    chunk(tmp_path / "rest", "unified.jsonl", 1, parts[1])
    drain(jobs.stream_inference_context(jobs.stream_lines(spark, str(tmp_path / "rest")), contexts=begun, buckets=3), tmp_path, "rest-ledger")
    assert shown(read_ledger(spark, str(tmp_path / "rest-ledger"))) == [x for x in want if x[1] > 5]


def test_dedup_and_daily_totals(spark, sf_dir, tmp_path):
    from meterline.sources.tables import usage_events

    events = usage_events(spark, sf_dir)
    for k in range(2):  # the same rows twice
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "records"))
    stream = spark.readStream.schema(RECORD).parquet(str(tmp_path / "records"))
    once = jobs.stream_dedup(stream, "60 days")
    q = once.drop("at").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "k1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.count()
    single = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "records"))
    q = jobs.stream_daily_totals(single, "60 days").writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "k2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = with_derived(events).groupBy(F.date_format("date_local", "yyyy-MM-dd").alias("day"), "display_source").agg((F.sum("total_norm") * 2).alias("tokens"))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, want.collect()))
