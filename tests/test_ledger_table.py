"""The ledger's snapshots: writes that fail, days that are met, files that go."""

import pytest
from pyspark.sql import functions as F
from test_golden import ledger

from meterline.functions.measures import COLUMNS
from meterline.operators.merge import merge_first, merge_largest, merge_latest
from meterline.sources import sinks

DAY = 86400
START = 1_700_000_000


def rows(spark, *over):
    return ledger(spark, *over)


def told(spark, path, **how):
    return sorted((r.dedup_key, r.total_tokens, str(r.date_local)) for r in sinks.read_ledger(spark, path, **how).collect())


def three_days(spark, path):
    sinks.write_ledger(rows(spark, *[dict(dedup_key=f"k{d}", ts=START + d * DAY, total_tokens=d) for d in range(3)]), path)


def test_days_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "l")
    assert told(spark, path) == []
    three_days(spark, path)
    number = sinks.write_ledger(rows(spark, dict(dedup_key="new", ts=START + DAY, total_tokens=9)), path)
    assert [x[:2] for x in told(spark, path)] == [("k0", 0), ("k2", 2), ("new", 9)]
    assert [x[:2] for x in told(spark, path, number=number - 1)] == [("k0", 0), ("k1", 1), ("k2", 2)]
    assert sinks.vacuum(spark, path, keep=2) == 0 and sinks.vacuum(spark, path, keep=1) == 0  # the first commit still holds two days
    assert [x[0] for x in told(spark, path)] == ["k0", "k2", "new"] and sinks.snapshots(spark, path) == [number]


def test_a_write_that_dies_between_days_leaves_the_ledger(spark, tmp_path):
    """Some days' tasks end, one fails: the old snapshot stands whole; the same write then succeeds."""
    path = str(tmp_path / "l")
    three_days(spark, path)
    before = told(spark, path)
    more = rows(spark, *[dict(dedup_key=f"n{d}", ts=START + d * DAY, total_tokens=50 + d) for d in range(3)])
    dying = more.withColumn("total_tokens", F.when(F.col("dedup_key") == "n2", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("total_tokens")))
    with pytest.raises(Exception, match="killed"):
        sinks.merge_into_ledger(dying, path, merge_first)
    assert told(spark, path) == before
    sinks.merge_into_ledger(more, path, merge_first)
    assert [x[0] for x in told(spark, path)] == ["k0", "k1", "k2", "n0", "n1", "n2"]
    assert sinks.vacuum(spark, path, keep=1) >= 1
    assert len(told(spark, path)) == 6


@pytest.mark.parametrize("step", ["_swap", "half"])
def test_a_write_that_dies_before_its_snapshot_is_complete(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "l")
    three_days(spark, path)
    before = told(spark, path)

    def die(spark_, path_, held):
        if step == "half":  # files of a snapshot without its last one
            (tmp_path / "l" / "snapshots" / "2").mkdir()
            (tmp_path / "l" / "snapshots" / "2" / "part-0.parquet").write_bytes(b"torn")
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_swap", die)
        with pytest.raises(RuntimeError, match="killed"):
            sinks.merge_into_ledger(rows(spark, dict(dedup_key="n", ts=START)), path, merge_first)
    assert told(spark, path) == before
    number = sinks.merge_into_ledger(rows(spark, dict(dedup_key="n", ts=START)), path, merge_first)
    assert number == (3 if step == "half" else 2) and len(told(spark, path)) == 4
    sinks.vacuum(spark, path, keep=1)
    assert len(told(spark, path)) == 4 and not (tmp_path / "l" / "snapshots" / "1").exists()


def test_only_days_that_are_met_are_read(spark, tmp_path):
    path = str(tmp_path / "l")
    sinks.write_ledger(rows(spark, *[dict(dedup_key=f"k{d}", ts=START + d * DAY) for d in range(30)]), path)
    batch = rows(spark, dict(dedup_key="k7", ts=START + 20 * DAY), dict(dedup_key="k7:iteration:1", ts=START), dict(dedup_key="zzz", ts=START))
    met = sinks.days_met(spark, path, batch)
    assert len(met) == 1
    part = sinks.read_ledger(spark, path, met)
    assert len(part.inputFiles()) == 1 and "k7" in {r.dedup_key for r in part.collect()}
    before = set(sinks.read_ledger(spark, path).inputFiles())
    sinks.merge_into_ledger(batch, path, merge_latest)
    after = set(sinks.read_ledger(spark, path).inputFiles())
    assert len(before & after) == 27  # three days were written again


def test_rows_that_move_to_another_day_leave_the_old_one(spark, tmp_path):
    """A newer record of a key has another day, where it was the only one: the old day goes."""
    path = str(tmp_path / "l")
    three_days(spark, path)
    sinks.merge_into_ledger(rows(spark, dict(dedup_key="k1", ts=START + 2 * DAY, total_tokens=7)), path, merge_latest)
    got = told(spark, path)
    assert [x[:2] for x in got] == [("k0", 0), ("k1", 7), ("k2", 2)] and got[1][2] == got[2][2]


@pytest.mark.parametrize("base_first", [True, False])
def test_iterations_find_their_message_on_another_day(spark, tmp_path, base_first):
    path = str(tmp_path / "l")
    base, iteration = dict(dedup_key="m", ts=START), dict(dedup_key="m:iteration:0", ts=START + 3 * DAY)
    for row in (base, iteration) if base_first else (iteration, base):
        sinks.merge_into_ledger(rows(spark, row), path, merge_largest)
    assert [x[0] for x in told(spark, path)] == ["m:iteration:0"]


def test_merged_again_nothing_changes(spark, tmp_path):
    path = str(tmp_path / "l")
    batch = rows(spark, *[dict(dedup_key=f"k{d % 4}", ts=START + d * DAY, total_tokens=d, pos=d) for d in range(9)])
    for merge in (merge_first, merge_largest, merge_latest):
        sinks.merge_into_ledger(batch, path, merge)
        before = sorted(map(tuple, sinks.read_ledger(spark, path).select(*COLUMNS).collect()), key=str)
        sinks.merge_into_ledger(batch, path, merge)
        assert sorted(map(tuple, sinks.read_ledger(spark, path).select(*COLUMNS).collect()), key=str) == before
