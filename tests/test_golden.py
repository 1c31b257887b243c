"""Small inputs with known results: readers, sinks, counters, snapshots, rates, periods."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from meterline.functions import scalars
from meterline.functions.measures import RECORD, validate_records, with_derived
from meterline.operators import audit, merge, rates, reports
from meterline.sources import counters, message_tables, messages, readers, runs
from meterline.sources.sinks import read_ledger, write_ledger

UUID = "00000000-0000-0000-0000-00000000000"


def record(**over):
    base = dict(ts=1_700_000_000, source="claude", model="atlas-3", project="/p/a", category="main", input_tokens=10, output_tokens=5, cache_read_tokens=0, cache_creation_tokens=0,
                cache_creation_1h_tokens=0, reasoning_tokens=0, total_tokens=15, request_prompt_tokens=None, session_id="s", source_file="/f", pos=0, dedup_key="k")
    return tuple((base | over)[n] for n in RECORD.names)


def ledger(spark, *rows):
    return spark.createDataFrame([record(**r) for r in rows], RECORD)


def lines(spark, *files):
    data = [(path, k * 10, json.dumps(x) if not isinstance(x, str) else x) for path, xs in files for k, x in enumerate(xs)]
    return spark.createDataFrame(data, "path string, pos long, value string")


def snap(total, inp, cached, out, last=None, at="2024-01-01T00:00:00Z"):
    use = lambda t: dict(zip(("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), (*t, 0), strict=True))
    info = {"total_token_usage": use((total, inp, cached, out))} | ({"last_token_usage": use(last)} if last else {})
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": info}}


def deltas(spark, *files):
    got = counters.normalize_counter_files(lines(spark, *files)).orderBy("source_file", "pos").collect()
    return [(r.total_tokens, r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in got]


def file(n):
    return f"/logs/rollout-2024-01-01T00-00-00-{UUID}{n}.jsonl"


CASES = [
    ([snap(1000, 600, 200, 400)], [(1000, 400, 200, 400)]),
    ([snap(1000, 600, 200, 400), snap(1500, 800, 300, 700)], [(1000, 400, 200, 400), (500, 100, 100, 300)]),
    ([snap(1000, 600, 200, 400), snap(1000, 600, 200, 400)], [(1000, 400, 200, 400)]),
    ([snap(1500000, 1000000, 200000, 500000), snap(1580000, 700000, 150000, 530000)], [(1500000, 800000, 200000, 500000), (80000, 50000, 0, 30000)]),
    ([snap(10000, 8000, 6000, 2000, (1000, 900, 700, 100)), snap(10500, 8400, 6200, 2100)], [(1000, 200, 700, 100), (500, 200, 200, 100)]),
    ([snap(1000, 600, 200, 400), snap(1500, 900, 300, 600, at=None), snap(1800, 1100, 400, 700)], [(1000, 400, 200, 400), (800, 300, 200, 300)]),
    ([snap(300, 200, 0, 100), snap(800, 500, 100, 300), snap(1500, 900, 200, 600)], [(300, 200, 0, 100), (500, 200, 100, 200), (700, 300, 100, 300)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_counter_files(spark, case):
    snaps, want = CASES[case]
    assert deltas(spark, (file(1), snaps)) == want


def fork(parent):
    return {"type": "session_meta", "payload": {"id": "c", "forked_from_id": f"{UUID}{parent}"}}


def totals(*ts):
    return [snap(t, t, 0, 0) for t in ts]


def test_forked_files(spark):
    parent = (file(1), totals(13019872, 13052691, 13093585, 13137459, 14000000))
    child = (file(2), [fork(1), *totals(13019872, 13052691, 13093585, 13200000)])
    assert deltas(spark, parent, child)[5:] == [(106415, 106415, 0, 0)]
    assert [d[0] for d in deltas(spark, (file(3), [fork(9), *totals(135000000, 135000500)]))] == [500]
    assert [d[0] for d in deltas(spark, (file(1), totals(13019872, 13052691)), (file(2), [fork(1), *totals(40000)]))][-1] == 40000
    again = (file(1), totals(10, 10, 20, 30))
    assert [d[0] for d in deltas(spark, again, (file(2), [fork(1), *totals(10, 10, 25)]))][3:] == [15]


def test_copies_of_a_file_are_one(spark):
    xs = totals(5, 9)
    a, b = (counters.normalize_counter_files(lines(spark, (p, xs))) for p in (file(1), file(1).replace("/logs/", "/old/") + ".zst"))
    assert merge.merge_first(a, b).count() == 2


def message(mid, out, **usage):
    return {"type": "assistant", "timestamp": "2024-01-01T16:00:00Z", "cwd": "/w", "sessionId": "s", "message": {"id": mid, "model": "m", "usage": {"input_tokens": 6, "output_tokens": out} | usage}}


def test_messages_and_iterations(spark):
    cache = {"cache_read_input_tokens": 18186, "cache_creation_input_tokens": 26070, "cache_creation": {"ephemeral_1h_input_tokens": 10000, "ephemeral_5m_input_tokens": 16070}}
    two = {"iterations": [{"input_tokens": 150, "output_tokens": 2}, {"model": "n", "input_tokens": 300, "output_tokens": 13}]}
    rows = lines(spark, ("/a.jsonl", [message("a", 100, **cache), message("b", "oops"), message("c", 1, **two), "{broken \"usage\"", message("d", 39), message("d", 134)]))
    got = {r.dedup_key: r for r in messages.explode_iterations(rows).collect()}
    assert set(got) == {"a", "c:iteration:0", "c:iteration:1", "d"}
    assert got["a"].total_tokens == 6 + 100 + 16070 + 10000 + 18186 and got["a"].cache_creation_1h_tokens == 10000
    assert (got["c:iteration:0"].total_tokens, got["c:iteration:1"].total_tokens, got["c:iteration:1"].model) == (152, 313, "n")
    best = merge.merge_largest(spark.createDataFrame([], RECORD), messages.explode_iterations(rows))
    assert {r.dedup_key: r.output_tokens for r in best.collect()}["d"] == 134


def test_snapshots_of_session_logs(spark):
    def said(mid, parts, total):
        return {"type": "message", "id": mid, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "usage": dict(zip(("input", "output", "cacheRead", "cacheWrite"), parts, strict=True)) | {"totalTokens": total}}}

    head = {"type": "session", "id": "s1", "sessionKey": "agent:main:chat"}
    rows = [head, said("a", (100, 40, 10, 5), 155), said("b", (30, 7, 4, 1), 42), said("x", (130, 47, 14, 6), 42), head | {"id": "s2"}, said("c", (17, 7, 3, 2), 13), said("d", (100, 50, 8, 2), 160), said("e", (100, 50, 8, 2), 160)]
    got = runs.normalize_session_logs(lines(spark, ("/s.jsonl", rows))).orderBy("pos").collect()
    assert [r.dedup_key[-1] for r in got] == list("abcde") and got[0].project == "chat" and got[-1].session_id == "s2"


def test_log_lines_have_offsets(spark, tmp_path):
    data = ["{\"a\": 1}", "é" * 5, "x" * 100, "", "last"]
    (tmp_path / "a.jsonl").write_bytes("\n".join(data).encode())
    got = readers.read_log_lines(spark, str(tmp_path / "a.jsonl"), max_line_bytes=50).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, data[0]), (9, data[1]), (121, "")]
    import zstandard

    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress("\n".join(["p", "q", ""]).encode()))
    got = readers.read_log_lines(spark, str(tmp_path / "b.jsonl.zst")).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, "p"), (2, "q")] and got[0].path.endswith("b.jsonl")


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("hello")
    r = readers.list_files(spark, str(tmp_path)).first()
    assert (r.size, r["head"]) == (5, "68656C6C6F")


def test_unchanged_files_are_not_opened_and_changed_ones_resume(spark, tmp_path):
    import os
    from datetime import datetime

    for name, data in [("same", "a\n"), ("grown", "a\nbb\n"), ("new", "c\n"), ("torn", "x\n")]:
        (tmp_path / f"{name}.jsonl").write_text(data)
    os.utime(tmp_path / "same.jsonl", (1_600_000_000, 1_600_000_000))
    now = readers.list_files(spark, str(tmp_path), since=datetime(2023, 1, 1))
    heads = {r.path.rsplit("/", 1)[1]: r["head"] for r in now.collect()}
    assert heads == {"same.jsonl": None, "grown.jsonl": "610A62620A", "new.jsonl": "630A", "torn.jsonl": "780A"}
    last = now.filter("path NOT LIKE '%new%'").selectExpr(
        "path", "inode", "IF(path LIKE '%torn%', 9L, 2L) AS offset", "IF(path LIKE '%same%', '610A', NULL) AS head")
    plan = readers.plan_files(now, last)
    got = readers.resume_lines(readers.read_log_lines(spark, str(tmp_path)), plan).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.pos, r.value) for r in got) == [("grown.jsonl", 2, "bb"), ("new.jsonl", 0, "c"), ("torn.jsonl", 0, "x")]


def test_offsets_run_on_over_splits(spark, tmp_path):
    rows = [f"{i} " + "é" * (i % 7) for i in range(3000)]
    (tmp_path / "s.jsonl").write_bytes("".join(r + "\n" for r in rows).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_log_lines(spark, str(tmp_path / "s.jsonl")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at, want = 0, []
    for r in rows:
        want.append((at, r))
        at += len(r.encode()) + 1
    assert [(r.pos, r.value) for r in got] == want


HEADER = "Date,Cloud Agent ID,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens"


def test_usage_csv(spark, tmp_path):
    rows = [HEADER, "2024-01-01T00:00:00Z,,m,100,76054,723008,8093", '2024-01-01T00:00:00Z,,"m,x",,"1,234",5,1', "2024-01-02T00:00:00Z,a,m,,7,,1", "2024-01-02T00:00:00Z,a,m,,7,,1", "2024-01-02T00:00:00Z,m"]
    (tmp_path / "u.csv").write_text("﻿" + "\n".join(rows) + "\n", encoding="utf-8")
    got = message_tables.normalize_usage_csv(readers.read_usage_csv(spark, str(tmp_path / "u.csv"))).orderBy("total_tokens", "dedup_key").collect()
    assert [r.total_tokens for r in got] == [8, 8, 807255] and [r.dedup_key[-2:] for r in got[:2]] == [":1", ":2"]
    (tmp_path / "v.csv").write_text("Date,Model\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_usage_csv(spark, str(tmp_path / "v.csv"))


def test_placeholders_hold_the_watermark(spark):
    data = lambda t: json.dumps({"role": "assistant", "tokens": {"input": t, "output": 0, "cache": {}}})
    early = spark.createDataFrame([("a", "s", 1000, data(0)), ("b", "s", 2000, data(5))], "id string, session_id string, time_created long, data string")
    assert message_tables.safe_watermark(early, 0).first()[0] == 0
    done = spark.createDataFrame([("a", "s", 1000, data(3)), ("b", "s", 2000, data(5))], early.schema)
    assert message_tables.safe_watermark(done, 0).first()[0] == 2000


def test_invalid_records(spark):
    good, bad = validate_records(ledger(spark, {}, {"dedup_key": "b", "ts": 0}, {"dedup_key": "c", "input_tokens": -1}, {"dedup_key": "d", "source": "x"}, {"dedup_key": "e", "model": "m" * 600}))
    assert {r.dedup_key for r in good.collect()} == {"k", "e"} and bad.count() == 3
    assert good.agg(F.max(F.length("model"))).first()[0] == 512


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(scalars.local_day(lit(1767297600).cast("long"))) == datetime.date(2026, 1, 2)
    assert one(scalars.project_name(lit("/a/b/"))) == "b" and one(scalars.project_name(lit(""))) == "(unknown)"
    assert one(scalars.clean_model(lit(" EU.anthropic.Vendor/X-1[1m] "))) == "x-1"
    assert [one(scalars.session_key_project(lit(k), lit("d"))) for k in ("agent:main:w:1", "agent:ops:main", "chan:x", "")] == ["w", "ops", "chan", "d"]
    assert [one(scalars.guarded(lit(t))) for t in ("=1", " +x", "a=b", "-")] == ["'=1", "' +x", "a=b", "'-"]
    assert [one(scalars.epoch_of(lit(t))) for t in ("2026", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "x")] == [0, 1704067200, 1704067200, 0]


def keys(spark, *models):
    got = rates.resolve_price_key(spark.createDataFrame([(m,) for m in models], "model string"), rates.default_rates(spark))
    return {r.model: (r.key, r.status) for r in got.collect()}


def test_price_keys(spark):
    got = keys(spark, "dorado-5", "dorado-5-20260101", "dorado-5-eco", "dorado-5-new", "cirrus-4.1-batch-rapid", "cirrus-4.2-rapid", "local-llm", "atlas-3.7", "zzz", "None", "")
    assert got["dorado-5"] == ("dorado-5", "exact") and got["dorado-5-20260101"][0] == got["dorado-5-eco"][0] == "dorado-5"
    assert got["dorado-5-new"] == (None, "unknown") and got["cirrus-4.1-batch-rapid"] == ("cirrus-4.1-rapid", "borrowed") and got["cirrus-4.2-rapid"][1] == "unknown"
    assert got["local-llm"][1] == "exact" and got["atlas-3.7"] == ("atlas-3.5", "borrowed") and got["zzz"][1] == "unknown"
    assert got["None"][1] == got[""][1] == "placeholder"


def priced(spark, table, *rows):
    data = spark.createDataFrame([(json.dumps(r),) for r in table], "l string").select(F.from_json("l", rates.RATE_SCHEMA).alias("r")).select("r.*")
    return data, with_derived(ledger(spark, *rows))


def test_tier_is_decided_for_each_record(spark):
    table = [{"key": "default"}, {"key": "m", "input": 1}, {"key": "m", "over": 200000, "input": 2}]
    rows = [dict(dedup_key=str(i), model="m", input_tokens=n, output_tokens=0, request_prompt_tokens=p) for i, (p, n) in enumerate([(150000, 150000), (150000, 150000), (200000, 0), (300000, 10000), (None, 300000)])]
    data, events = priced(spark, table, *rows)
    got = reports.export_rows(events, data, "2023-11-20", "all").collect()
    assert len(got) == 1 and got[0].cost_usd == 0.62


def test_a_changed_threshold_counts_from_its_day(spark):
    table = [{"key": "default"}, {"key": "m", "input": 1}, {"key": "m", "over": 100000, "input": 5}, {"key": "m", "starts": "2023-12-01", "over": 200000, "input": 5}]
    row = dict(model="m", input_tokens=150000, output_tokens=0, request_prompt_tokens=150000)
    data, events = priced(spark, table, row | {"dedup_key": "a"}, row | {"dedup_key": "b", "ts": 1_702_000_000})
    got = {r.dedup_key: float(r.cost_micro) / 1e6 for r in rates.price_events(events, data).collect()}
    assert got == {"a": 0.75, "b": 0.15}


def test_hour_writes_reasoning_and_savings(spark):
    table = [{"key": "default"}, {"key": "m", "input": 10, "output": 1, "cache_read": 1, "write_5m": 2.5, "write_1h": 4}, {"key": "all", "input": 1, "output": 1, "cache_read": 1}]
    million = 10**6
    data, events = priced(
        spark, table, dict(model="m", input_tokens=0, output_tokens=0, cache_creation_tokens=700_000, cache_creation_1h_tokens=300_000, cache_read_tokens=million),
        dict(dedup_key="r", source="opencode", model="all", input_tokens=10 * million, output_tokens=20 * million, reasoning_tokens=5 * million, cache_read_tokens=7 * million),
    )
    got = {r.model: r for r in rates.price_events(events, data).collect()}
    assert float(got["m"].cost_micro) / 1e6 == 2.95 + 1 and float(got["m"].saved_micro) / 1e6 == 9
    assert float(got["all"].cost_micro) / 1e6 == 42 and got["all"].total_norm == 42 * million and got["all"].output_billed == 25 * million


def test_merge_policies_on_one_key(spark):
    old, new = ledger(spark, {"total_tokens": 15}), ledger(spark, {"total_tokens": 15, "model": "x"}, {"dedup_key": "n"})
    assert {r.dedup_key: r.model for r in merge.merge_largest(old, new).collect()} == {"k": "atlas-3", "n": "atlas-3"}
    assert {r.dedup_key: r.model for r in merge.merge_latest(old, new).collect()}["k"] == "x"
    moved = ledger(spark, {"source_file": "/elsewhere", "pos": 9})
    assert merge.merge_latest(old, moved).first().source_file == "/f"
    once = merge.merge_first(old, new)
    assert tuple(merge.merge_stats(once, merge.merge_first(once, new)).first()) == (0, 0, 2, 0)


def test_coverage_of_details(spark):
    detail = [dict(source="openclaw", dedup_key=k, total_tokens=n, source_file="/db", pos=i) for i, (k, n) in enumerate([("a", 125), ("b", 7)])]
    total = lambda n: ledger(spark, dict(source="openclaw", dedup_key="t", total_tokens=n, source_file="/x.trajectory.jsonl"))
    got = lambda n: sorted(r.dedup_key for r in merge.reconcile_coverage(ledger(spark, *detail), total(n)).collect())
    assert got(125) == ["a", "b"] and got(132) == ["a", "b"] and got(250) == ["t"]


def test_ledger_table_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "ledger")
    write_ledger(ledger(spark, {}, {"dedup_key": "b", "ts": 1_700_100_000}), path)
    write_ledger(ledger(spark, {"dedup_key": "c"}), path)
    assert sorted(r.dedup_key for r in read_ledger(spark, path).collect()) == ["b", "c"]


def test_rates_file_needs_a_default(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"key": "m", "input": 1}))
    with pytest.raises(ValueError, match="default"):
        rates.load_rates(spark, str(tmp_path / "r.jsonl"))


def test_csv_export(spark, tmp_path):
    data, events = priced(spark, [{"key": "default", "input": 1}], {"project": "=cmd"})
    reports.export_csv(reports.export_rows(events, data, "2023-11-20", "all"), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert got.project == "'=cmd" and len(got) == 12


def test_mixed_sessions_and_background(spark):
    rows = [dict(dedup_key="1", session_id="s2", input_tokens=120, output_tokens=0, project="/a"), dict(dedup_key="2", session_id="s2", input_tokens=10, output_tokens=0, project="/b"), dict(dedup_key="3", session_id="s1", input_tokens=10, output_tokens=0, category="observer")]
    events = with_derived(ledger(spark, *rows))
    assert tuple(audit.mixed_sessions_summary(events, "2023-11-15").first()) == (1, 130, 92.86)
    assert audit.background_share(events, "2023-11-15").first().background_percent == 7.1


def test_a_forks_own_row_may_reach_its_parents_next_total(spark):
    """The child's first own row has the total of the parent's next one, but other parts: it counts."""
    parent = (file(1), [snap(10, 8, 0, 2), snap(20, 16, 0, 4), snap(30, 24, 0, 6)])
    child = (file(2), [fork(1), snap(10, 8, 0, 2), snap(20, 16, 0, 4), snap(30, 25, 0, 5)])
    assert deltas(spark, parent, child)[3:] == [(10, 9, 0, 1)]
