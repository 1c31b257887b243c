"""Registered queries over the ledger: scalars, pricing and period reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.measures import validate_records, with_derived
from ..operators import rates as R
from ..operators import reports as E
from ..sources.tables import usage_events
from .oracle_base import ALL, AS_OF, COST, EV, PERIODS, RATED, RESOLVE, SUMS, within



def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(usage_events(spark, sf_dir))


def rates(spark: SparkSession) -> DataFrame:
    return R.default_rates(spark)


def b23_validate(spark, sf_dir):
    """Rows broken on purpose by their number, counted as valid or rejected by category."""
    rows = usage_events(spark, sf_dir, True)
    bad = rows.withColumns({
        "input_tokens": F.when(F.col("e") % 13 == 0, -1).otherwise(F.col("input_tokens")), "source": F.when(F.col("e") % 17 == 0, "other").otherwise(F.col("source")),
        "ts": F.when(F.col("e") % 19 == 0, 0).otherwise(F.col("ts")), "model": F.when(F.col("e") % 23 == 0, F.repeat("model", 200)).otherwise(F.col("model")),
    })
    good, rejects = validate_records(bad)
    count = lambda df, name: df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max(F.least(F.length("model"), F.lit(512))).cast("long").alias("longest")).withColumn("outcome", F.lit(name))
    return count(good, "valid").unionByName(count(rejects, "rejected"))


def b24_derived(spark, sf_dir):
    cols = ["dedup_key", F.date_format("date_local", "yyyy-MM-dd").alias("day"), "project_name", "output_billed", "total_norm", "display_source", "collector"]
    return ledger(spark, sf_dir).select(*cols)


def d1_clean_model(spark, sf_dir):
    return usage_events(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", scalars.clean_model(F.col("model")).alias("clean"), "n")


#: What stands behind the ledger's model names, and names of its own, to make the names that are resolved.
ENDINGS = ["", "-20260101", "-7", "-72", "-123", ".9", "-eco", "-steady-wide", "-rapid", "-eu-rapid", "-eu", "x", "-20260101-beta", "[1m]", " "]
STEMS = ["dorado-5", "dorado-6", "dorado-5.1", "cirrus-4.1", "cirrus-4.2", "cirrus-5", "borea", "local-llm", "None"]


def d2_resolve(spark, sf_dir):
    """The ledger's names and others, each with every ending: some 300 names that are dated, newer, suffixed or variants."""
    stems = usage_events(spark, sf_dir).select(F.explode(F.array("model", *[F.lit(x) for x in STEMS])).alias("stem")).distinct()
    names = stems.select(F.explode(F.array(*[F.concat("stem", F.lit(x)) for x in ENDINGS])).alias("model"))
    return R.resolve_price_key(names, rates(spark)).select("model", "key", "status")


def d3_classify(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    return events.groupBy("model").count().withColumnRenamed("count", "n").join(R.classify_models(events, rates(spark)), "model").select("model", "status", "priced_as", "n")


def d5_effective(spark, sf_dir):
    """Prices in force for each model and day of the ledger."""
    days = ledger(spark, sf_dir).groupBy("model", "date_local").agg(F.count(F.lit(1)).alias("n"))
    rated = R.rated_models(days, rates(spark)).withColumnRenamed("model", "m")
    day = F.date_format("date_local", "yyyy-MM-dd")
    got = days.join(rated, (F.col("model") == F.col("m")) & (day >= F.col("valid_from")) & (day < F.col("valid_to")))
    return got.select("model", day.alias("day"), "n", F.col("threshold").cast("long").alias("threshold"), *[F.col(f"{a}_{c}").cast("double").alias(f"{a}_{c}") for a in "rl" for c in ("in", "out", "read", "5m", "1h")])


def d6_tier(spark, sf_dir):
    """Records and prompts charged at each input price."""
    got = R.with_rates(ledger(spark, sf_dir), rates(spark))
    return got.groupBy("model", F.col("p_in").cast("double").alias("p_in")).agg(F.count(F.lit(1)).alias("n"), F.sum("request_prompt_tokens").alias("prompts"))


def d8_price(spark, sf_dir):
    got = R.price_events(ledger(spark, sf_dir), rates(spark))
    return got.select("dedup_key", F.col("cost_micro").cast("double").alias("cost_micro"))


def d9_savings(spark, sf_dir):
    got = R.price_events(ledger(spark, sf_dir), rates(spark))
    return got.groupBy("source").agg(R.usd(F.sum("saved_micro")).alias("saved_usd"))


def e1_periods(spark, sf_dir):
    """The periods, with the records of each."""
    events = ledger(spark, sf_dir).groupBy("date_local").agg(F.count(F.lit(1)).alias("n"))
    periods = E.period_table(spark, AS_OF)
    got = periods.join(events, F.col("date_local").between(F.col("from_day"), F.col("to_day")), "left")
    return got.groupBy("period", E.day("from_day").alias("from_day"), E.day("to_day").alias("to_day")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def e2_summary(spark, sf_dir):
    return E.period_summary(ledger(spark, sf_dir), rates(spark), AS_OF)


def e5_daily_series(spark, sf_dir):
    return E.daily_series(ledger(spark, sf_dir), AS_OF, 30)


def e6_active(spark, sf_dir):
    return E.active_sources(E.daily_series(ledger(spark, sf_dir), AS_OF, 7))


def e7_by_model(spark, sf_dir):
    return E.breakdown_by_model(ledger(spark, sf_dir), rates(spark), AS_OF, "month")


def e7_one_source(spark, sf_dir):
    return E.breakdown_by_model(ledger(spark, sf_dir), rates(spark), AS_OF, "week", "claude_mem")


def e8_by_project(spark, sf_dir):
    return E.breakdown_by_project(ledger(spark, sf_dir), rates(spark), AS_OF, "week")


def e9_totals(spark, sf_dir):
    return E.breakdown_totals(ledger(spark, sf_dir), rates(spark), AS_OF, "week")


def e10_export(spark, sf_dir):
    return E.export_rows(ledger(spark, sf_dir), rates(spark), AS_OF, "today")


def a10_export_table(spark, sf_dir):
    """The export's columns with texts that a spreadsheet would take for formulas."""
    events = ledger(spark, sf_dir).withColumn("project", F.concat(F.when(F.col("pos") % 2 == 0, F.lit(" =")).otherwise(F.lit("")), F.col("project")))
    return E.export_table(E.export_rows(events, rates(spark), AS_OF, "today"))


def e11_top_sessions(spark, sf_dir):
    return E.top_sessions(ledger(spark, sf_dir), rates(spark), AS_OF, "month", 20)


def _session(spark, sf_dir) -> str:
    """The session with the most records: one row to the driver."""
    rows = usage_events(spark, sf_dir).filter("session_id <> ''").groupBy("session_id").count()
    top = rows.orderBy(F.desc("count"), "session_id").limit(1).collect()
    return top[0]["session_id"] if top else ""


def e12_session_summary(spark, sf_dir):
    return E.session_summary(ledger(spark, sf_dir), rates(spark), _session(spark, sf_dir), AS_OF, "all")


def e13_session_groups(spark, sf_dir):
    return E.session_groups(ledger(spark, sf_dir), rates(spark), _session(spark, sf_dir), AS_OF, "all")


def e14_session_files(spark, sf_dir):
    return E.session_files(ledger(spark, sf_dir), _session(spark, sf_dir), AS_OF, "all")


def e15_meta(spark, sf_dir):
    return E.ledger_meta(ledger(spark, sf_dir))


def e16_share(spark, sf_dir):
    return E.source_share(e2_summary(spark, sf_dir))


def e17_projection(spark, sf_dir):
    return E.month_end_projection(ledger(spark, sf_dir), rates(spark), AS_OF)


def e18_change(spark, sf_dir):
    return E.day_change(e2_summary(spark, sf_dir))


def e19_alerts(spark, sf_dir):
    daily = E.daily_costs(ledger(spark, sf_dir), rates(spark), AS_OF, 30)
    return E.threshold_alerts(daily, 10.0, 1_000_000)


_TOP = "(SELECT session_id FROM ev WHERE session_id <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_SUMMARY = RATED + f""", {PERIODS}, cuts AS (
  SELECT period, 'total' AS cut, 'total' AS name, pr.* FROM pr JOIN periods ON day BETWEEN lo AND hi
  UNION ALL SELECT period, 'source', source, pr.* FROM pr JOIN periods ON day BETWEEN lo AND hi
  UNION ALL SELECT period, 'display', display_source, pr.* FROM pr JOIN periods ON day BETWEEN lo AND hi
), summary AS (SELECT period, cut, name, {ALL}, min(day) AS first_day FROM cuts GROUP BY 1, 2, 3)
"""
_DISPLAY = ["claude", "codex", "opencode", "openclaw", "hermes", "grok", "cursor", "claude_mem"]
_PRICE_COLS = ", ".join(f"CAST({a}_{c} AS DOUBLE) AS {a}_{c}" for a in "rl" for c in ("in", "out", "read", "5m", "1h"))
_GROUP = f"SELECT source, collector, model, project, {ALL} FROM pr WHERE {{w}} GROUP BY 1, 2, 3, 4"

QUERIES = {
    "b23_validate": b23_validate, "b24_derived": b24_derived, "d1_clean_model": d1_clean_model, "d2_resolve_price_key": d2_resolve, "d3_classify_models": d3_classify,
    "d5_effective_rates": d5_effective, "d6_context_tier": d6_tier, "d8_price_events": d8_price, "d9_cache_savings": d9_savings, "e1_period_table": e1_periods,
    "e2_period_summary": e2_summary, "e5_daily_series": e5_daily_series, "e6_active_sources": e6_active, "e7_breakdown_by_model": e7_by_model,
    "e7_breakdown_one_source": e7_one_source, "e8_breakdown_by_project": e8_by_project, "e9_breakdown_totals": e9_totals, "e10_export_rows": e10_export,
    "a10_export_table": a10_export_table, "e11_top_sessions": e11_top_sessions, "e12_session_summary": e12_session_summary, "e13_session_groups": e13_session_groups,
    "e14_session_files": e14_session_files, "e15_ledger_meta": e15_meta, "e16_source_share": e16_share, "e17_month_end_projection": e17_projection,
    "e18_day_change": e18_change, "e19_threshold_alerts": e19_alerts,
}

ORACLES = {
    "b23_validate": EV + """, f AS (SELECT *, (e % 13 = 0 OR e % 17 = 0 OR e % 19 = 0) AS bad, CASE WHEN e % 23 = 0 THEN 512 ELSE length(model) END AS len FROM ev)
        SELECT category, count(*) AS n, CAST(max(len) AS BIGINT) AS longest, CASE WHEN bad THEN 'rejected' ELSE 'valid' END AS outcome FROM f GROUP BY category, bad""",
    "b24_derived": EV + " SELECT dedup_key, day, concat('app', u % 23) AS project_name, output_billed, total_norm, display_source, collector FROM ev",
    "d1_clean_model": EV + """ SELECT model, CASE model WHEN 'us.anthropic.atlas-3[1m]' THEN 'atlas-3' WHEN 'openai.vendor/borea-9' THEN 'borea-9' ELSE model END AS clean, count(*) AS n FROM ev GROUP BY 1, 2""",
    "d2_resolve_price_key": EV + f""", stems AS (SELECT DISTINCT model AS stem FROM ev UNION SELECT unnest({STEMS})),
      names AS (SELECT DISTINCT stem || ending AS model, regexp_replace(regexp_replace(regexp_replace(lower(trim(stem || ending)), '^(us[.]anthropic[.]|openai[.])', ''), '^.*/', ''), '\\[1m\\]$', '') AS clean FROM stems, (SELECT unnest({ENDINGS}) AS ending)), {RESOLVE}
      SELECT model, key, CASE WHEN lower(trim(model)) IN ('', 'none', 'unknown') THEN 'placeholder' WHEN key IS NULL THEN 'unknown' WHEN key = clean THEN 'exact' ELSE 'borrowed' END AS status FROM resolved""",
    "d3_classify_models": RATED + " SELECT model, status, CASE WHEN status = 'borrowed' THEN price_key END AS priced_as, count(*) AS n FROM pr GROUP BY 1, 2, 3",
    "d5_effective_rates": RATED + f" SELECT model, day, count(*) AS n, CAST(thr AS BIGINT) AS threshold, {_PRICE_COLS} FROM pr GROUP BY ALL",
    "d6_context_tier": RATED + " SELECT model, CAST(CASE WHEN request_prompt_tokens > thr THEN l_in ELSE r_in END AS DOUBLE) AS p_in, count(*) AS n, CAST(sum(request_prompt_tokens) AS BIGINT) AS prompts FROM pr GROUP BY 1, 2",
    "d8_price_events": RATED + " SELECT dedup_key, CAST(micro AS DOUBLE) AS cost_micro FROM pr",
    "d9_cache_savings": RATED + " SELECT source, round(CAST(sum(saved) AS DOUBLE) / 1e6, 4) AS saved_usd FROM pr GROUP BY 1",
    "e1_period_table": EV + f", {PERIODS} SELECT period, lo AS from_day, hi AS to_day, count(day) AS records FROM periods LEFT JOIN ev ON day BETWEEN lo AND hi GROUP BY 1, 2, 3",
    "e2_period_summary": _SUMMARY + " SELECT * FROM summary",
    "e5_daily_series": EV + """, cal AS (SELECT strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(0, 30) t(i))
        SELECT cal.day, """ + ", ".join(f"CAST(coalesce(sum(total_norm) FILTER (display_source = '{s}'), 0) AS BIGINT) AS {s}" for s in _DISPLAY) + ", CAST(coalesce(sum(total_norm), 0) AS BIGINT) AS total FROM cal LEFT JOIN ev ON ev.day = cal.day GROUP BY 1",
    "e6_active_sources": EV + f" SELECT display_source, CAST(sum(total_norm) AS BIGINT) AS tokens FROM ev WHERE {within('week')} GROUP BY 1 HAVING sum(total_norm) <> 0",
    "e7_breakdown_by_model": RATED + f""" SELECT * EXCLUDE (cache_creation_tokens, cache_creation_1h_tokens), cache_creation_tokens + cache_creation_1h_tokens AS cache_writes
        FROM (SELECT source, model, collector, {ALL} FROM pr WHERE {within('month')} GROUP BY 1, 2, 3)""",
    "e7_breakdown_one_source": RATED + f""" SELECT * EXCLUDE (cache_creation_tokens, cache_creation_1h_tokens), cache_creation_tokens + cache_creation_1h_tokens AS cache_writes
        FROM (SELECT source, model, collector, {ALL} FROM pr WHERE {within('week')} AND display_source = 'claude_mem' GROUP BY 1, 2, 3)""",
    "e8_breakdown_by_project": RATED + f" SELECT source, project, collector, {ALL}, concat('app', u % 23) AS project_name FROM pr WHERE {within('week')} GROUP BY source, project, collector, u % 23",
    "e9_breakdown_totals": RATED + f" SELECT {ALL} FROM pr WHERE {within('week')}",
    "e10_export_rows": RATED + " " + _GROUP.format(w=within("today")),
    "a10_export_table": RATED + f""", x AS (SELECT * REPLACE (CASE WHEN pos % 2 = 0 THEN concat(' =', project) ELSE project END AS project) FROM pr WHERE {within('today')})
        SELECT source, coalesce(collector, '') AS collector, model, CASE WHEN project LIKE ' =%' THEN concat('''', project) ELSE project END AS project, {SUMS}, {COST} FROM x GROUP BY source, x.collector, model, x.project""",
    "e11_top_sessions": RATED + f""", g AS (SELECT session_id, day, source, model, project, collector,
          CASE WHEN request_prompt_tokens > thr THEN l_in ELSE r_in END AS tier, {SUMS}, count(*) AS records, sum(micro) AS micro FROM pr
          WHERE {within('month')} AND session_id <> '' GROUP BY 1, 2, 3, 4, 5, 6, 7),
        lab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total_norm DESC, source DESC, model DESC, project DESC, day DESC, micro DESC) AS rn FROM g) WHERE rn = 1),
        s AS (SELECT session_id, {SUMS}, CAST(sum(records) AS BIGINT) AS records, sum(micro) AS micro, min(day) AS first_day FROM g GROUP BY 1 ORDER BY micro DESC, session_id LIMIT 20)
        SELECT s.* EXCLUDE (micro), round(CAST(s.micro AS DOUBLE) / 1e6, 4) AS cost_usd, lab.source, lab.model, lab.project, lab.collector FROM s JOIN lab USING (session_id)""",
    "e12_session_summary": RATED + f" SELECT {ALL}, min(day) AS first_day, max(day) AS last_day FROM pr WHERE {within('all')} AND session_id = {_TOP}",
    "e13_session_groups": RATED + " " + _GROUP.format(w=f"{within('all')} AND session_id = {_TOP}"),
    "e14_session_files": EV + f" SELECT source_file, CAST(sum(total_norm) AS BIGINT) AS tokens, count(*) AS records FROM ev WHERE {within('all')} AND session_id = {_TOP} GROUP BY 1 ORDER BY tokens DESC, source_file LIMIT 8",
    "e15_ledger_meta": EV + " SELECT count(*) AS records, min(day) AS first_day, max(day) AS last_day FROM ev",
    "e16_source_share": _SUMMARY + " SELECT period, name AS display_source, total_norm, CAST(round(100.0 * total_norm / sum(total_norm) OVER (PARTITION BY period)) AS BIGINT) AS percent FROM summary WHERE cut = 'display' AND total_norm <> 0",
    "e17_month_end_projection": RATED + f" SELECT round(CAST(sum(micro) AS DOUBLE) / 1e6, 4) AS month_cost_usd, round(CAST(sum(micro) AS DOUBLE) / 1e6 / 30 * 31, 4) AS projected_usd FROM pr WHERE {within('month')}",
    "e18_day_change": _SUMMARY + """, t AS (SELECT coalesce(max(total_norm) FILTER (period = 'today'), 0) AS today, coalesce(max(total_norm) FILTER (period = 'yesterday'), 0) AS yesterday FROM summary WHERE cut = 'total')
        SELECT today, yesterday, CAST(round(100.0 * (today - yesterday) / nullif(yesterday, 0)) AS BIGINT) AS percent_change FROM t""",
    "e19_threshold_alerts": RATED + f""", dd AS (SELECT day, CAST(sum(total_norm) AS BIGINT) AS tokens, round(round(CAST(sum(micro) AS DOUBLE) / 1e6, 6) * 7.25, 4) AS cost_local FROM pr WHERE day BETWEEN '2024-01-01' AND '{AS_OF}' GROUP BY 1)
        SELECT day, tokens, cost_local, cost_local >= 10.0 AS over_cost, tokens >= 1000000 AS over_tokens FROM dd WHERE cost_local >= 10.0 OR tokens >= 1000000""",
}
