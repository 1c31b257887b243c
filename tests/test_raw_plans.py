"""Plans over raw inputs: what a line is made of is computed once, and few files still make many tasks."""

import pytest

from meterline.plans.registry import QUERIES
from meterline.sources.tables import spread


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a3_parse_json_lines", "b10_oneshot_usage", "b18_safe_watermark", "b11_inference_events"])
def test_filters_on_lines_do_not_make_them_again(spark, sf_dir, name):
    plan = optimized(QUERIES[name](spark, sf_dir))
    scans = plan.count("Relation [event_id")
    assert plan.count("get_json_object") == scans
    assert plan.count("StructsToJsonEvaluator") <= scans


def test_a_table_of_one_file_is_dealt_out(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert len(events.inputFiles()) < spark.sparkContext.defaultParallelism
    assert "RepartitionByExpression" in optimized(spread(events, "event_id"))


def test_inferences_of_one_second_all_reach_the_ledger(spark):
    import json

    from meterline.operators.merge import build_ledger
    from meterline.sources import inference

    ctx = {"loop_index": 1, "prompt_tokens": 5, "completion_tokens": 2}
    line = json.dumps({"ts": "2024-01-01T00:00:00Z", "sid": "s", "msg": "shell.turn.inference_done", "ctx": ctx})
    lines = spark.createDataFrame([("/u.jsonl", n, line) for n in (3, 1, 2)], "path string, pos long, value string")
    records = inference.apart(inference.normalize_inference_events(lines))
    assert build_ledger([records], [], []).count() == 3
    assert build_ledger([records, records], [], []).count() == 3
