"""The log data source: what it reads, and what it leaves alone."""

import gzip
import io
import os

import pytest
import zstandard

from meterline.sources import log_source as ls
from meterline.sources import readers


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = []

    def read(self, n=-1):
        at, out = self.tell(), super().read(n)
        self.got.append((at, len(out)))
        return out


def collected(data, r, longest=50, block=16):
    source, out = Counted(data), []
    for starts, ends, held in ls.range_lines(source, r, longest, block):
        at = 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            out.append((s, held[at:e]))
            at = e
    return out, source.got


def by_definition(data, longest, size):
    at, out = 0, []
    for line in data[:size].split(b"\n")[:-1]:
        if len(line) <= longest:
            out.append((at, line))
        at += len(line) + 1
    return out


DATA = b"".join((b"%d " % i + b"\xc3\xa9" * (i % 9) + b"\n") for i in range(60)) + b"\n\n" + b"x" * 80 + b"\nlast\n" + b"y" * 70 + b"\n" + b"unfinished"


@pytest.mark.parametrize("step", [1, 7, 16, 40, 1000])
@pytest.mark.parametrize("block", [3, 16, 4096])
def test_ranges_partition_the_lines(step, block):
    """Every line is in the range that it begins in, whatever the cuts; long ones only move the offset."""
    want, got = by_definition(DATA, 50, len(DATA)), []
    for low in range(0, len(DATA), step):
        got += collected(DATA, ls.Range("f", "f", low, min(low + step, len(DATA)), len(DATA)), 50, block)[0]
    assert got == want


@pytest.mark.parametrize("size", [0, 1, 5, 30, len(DATA) - 3])
def test_bytes_behind_the_listed_size_do_not_count(size):
    got, reads = collected(DATA, ls.Range("f", "f", 0, size, size))
    assert got == by_definition(DATA, 50, size) and sum(n for _, n in reads) <= size


def test_resumed_read_counts_bytes():
    start = DATA.index(b"last")
    got, reads = collected(DATA, ls.Range("f", "f", start, len(DATA), len(DATA)))
    assert got == [(start, b"last")] and min(at for at, _ in reads) == start - 1 and sum(n for _, n in reads) == len(DATA) - start + 1


def test_end_of_last_line_is_found_backwards():
    source = Counted(b"a\n" * 5000 + b"rest")
    assert ls.last_line_end(source, 0, 10_004, 64) == 10_000 and sum(n for _, n in source.got) == 64
    assert ls.last_line_end(Counted(b"abc"), 0, 3) == 0 and ls.last_line_end(Counted(b"a\nbcd"), 2, 5) == 2


def test_partitions_cut_large_and_gather_small_files():
    plan = [{"file": f"/{n}", "path": n, "start": s, "size": z} for n, s, z in [("big", 5, 1005), ("a", 0, 10), ("b", 0, 10), ("c.gz", 0, 700), ("none", 10, 10)]]
    got = ls.cut_ranges(plan, 400, 1)
    ranges = [r for p in got for r in p.ranges]
    assert [(r.start, r.stop) for r in ranges if r.path == "big"] == [(5, 405), (405, 805), (805, 1005)]
    assert {r.path for r in ranges} == {"big", "a", "b", "c.gz"} and len(got) == 4
    assert [r.codec for r in ranges if r.path == "c.gz"] == ["gzip"]


def names(rows):
    return sorted((r.path.rsplit("/", 1)[1], r.pos, r.value) for r in rows)


def test_runs_follow_each_other(spark, tmp_path):
    """Three runs over growing, rebuilt, packed, torn and vanished logs, each planned from the manifest of the one before."""
    logs = tmp_path / "logs of a day"
    logs.mkdir()
    put = lambda name, data: (logs / name).write_bytes(data)
    put("same.jsonl", b"a\nb\n")
    put("grown.jsonl", b"one\ntwo\nthr")
    put("torn.jsonl", b"long line\nmore\n")
    put("old.jsonl.gz", gzip.compress(b"p\nq\n" * 3))
    put("arch.jsonl.zst", zstandard.compress(b"z\n"))

    def run(previous):
        plan = readers.plan_files(readers.list_files(spark, str(logs)), previous).cache()
        lines = names(ls.read_planned_lines(spark, plan, split_bytes=4).collect())
        actions = {r.path.rsplit("/", 1)[1]: r.action for r in plan.collect()}
        return lines, actions, ls.next_manifest(plan)

    nothing = spark.createDataFrame([], "path string, inode long, offset long, mtime long, head string")
    first, _, manifest = run(nothing)
    assert [x for x in first if x[0] in ("grown.jsonl", "arch.jsonl")] == [("arch.jsonl", 0, "z"), ("grown.jsonl", 0, "one"), ("grown.jsonl", 4, "two")]
    assert [x[1] for x in first if x[0] == "old.jsonl"] == [0, 2, 4, 6, 8, 10]

    put("grown.jsonl", b"###\n###\nthree\nfour\n"[:0] + b"one\ntwo\nthree\nfour\n")
    put("torn.jsonl", b"new\n")
    put("fresh.jsonl", b"f\n")
    second, actions, manifest = run(manifest)
    assert actions == {"same.jsonl": "skip", "grown.jsonl": "reread", "torn.jsonl": "reread", "old.jsonl": "skip", "arch.jsonl": "skip", "fresh.jsonl": "reread"}
    assert [x for x in second if x[0] != "grown.jsonl"] == [("fresh.jsonl", 0, "f"), ("torn.jsonl", 0, "new")]

    third, actions, manifest = run(manifest)
    assert third == [] and set(actions.values()) == {"skip"}


def test_grown_logs_resume_behind_a_long_head(spark, tmp_path):
    """With the head unchanged only what came is read: the old middle is overwritten with rubbish, which nobody sees."""
    head, old = b"h" * 300 + b"\n", b"old line\n" * 50
    log = tmp_path / "a.jsonl"
    log.write_bytes(head + old + b"to be cont")
    nothing = spark.createDataFrame([], "path string, inode long, offset long, mtime long, head string")
    plan = readers.plan_files(readers.list_files(spark, str(tmp_path)), nothing)
    manifest = ls.next_manifest(plan)
    assert manifest.first()["offset"] == len(head + old)
    log.write_bytes(head + b"\n" * len(old) + b"to be continued\nnext\n")
    plan = readers.plan_files(readers.list_files(spark, str(tmp_path)), manifest)
    assert plan.first()["action"] == "resume"
    assert names(ls.read_planned_lines(spark, plan).collect()) == [("a.jsonl", len(head + old), "to be continued"), ("a.jsonl", len(head + old) + 16, "next")]


def test_skipped_files_are_not_opened_and_gone_ones_have_no_lines(spark, tmp_path):
    for name in ("skipped", "gone", "read"):
        (tmp_path / f"{name}.jsonl").write_bytes(b"x\n")
    now = readers.list_files(spark, str(tmp_path)).selectExpr("*", "IF(path LIKE '%/skipped.jsonl', 'skip', 'reread') AS action", "0L AS start").cache()
    now.count()
    for name in ("skipped", "gone"):
        os.remove(tmp_path / f"{name}.jsonl")
    plan = spark.createDataFrame(now.collect(), now.schema)
    assert names(ls.read_planned_lines(spark, plan).collect()) == [("read.jsonl", 0, "x")]
    assert {r.path.rsplit("/", 1)[1]: r.offset for r in ls.next_manifest(plan).collect()} == {"skipped.jsonl": 0, "gone.jsonl": 0, "read.jsonl": 2}


def test_both_readers_agree_and_nothing_is_shuffled(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(DATA)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(DATA + b"\n"))
    mine = readers.read_log_lines(spark, str(tmp_path), 50, split_bytes=100)
    assert names(mine.collect()) == names(readers.scan_log_lines(spark, str(tmp_path), 50).collect())
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
