"""Registered queries: audits and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .oracle_base import AS_OF, EV, RATED, within
from .reporting import ledger, rates


def f1_coverage(spark, sf_dir):
    """Coverage with later messages seen in one source."""
    events = ledger(spark, sf_dir)
    seen = events.filter("source = 'hermes'").select("source", (F.col("ts") + 86400 * 3).alias("last_ts"))
    return A.source_coverage(events, seen)


def f3_mixed(spark, sf_dir):
    return A.mixed_sessions(ledger(spark, sf_dir), AS_OF)


def f4_mixed_summary(spark, sf_dir):
    return A.mixed_sessions_summary(ledger(spark, sf_dir), AS_OF)


def f5_unknown(spark, sf_dir):
    return A.unknown_model_cost(ledger(spark, sf_dir), rates(spark), AS_OF)


def f6_unknown_summary(spark, sf_dir):
    return A.unknown_model_summary(ledger(spark, sf_dir), rates(spark), AS_OF)


def f7_approximate(spark, sf_dir):
    return A.approximate_prices(ledger(spark, sf_dir), rates(spark), AS_OF)


def _staggered(spark, sf_dir):
    """The ledger with each source ending earlier than the one before it."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("claude", "codex", "opencode", "openclaw", "hermes", "grok", "cursor")]), F.col("source"))
    return ledger(spark, sf_dir).filter(F.col("date_local") <= F.date_sub(F.lit("2024-01-28").cast("date"), order.cast("int")))


def f8_stale(spark, sf_dir):
    return A.stale_sources(A.source_coverage(_staggered(spark, sf_dir)), AS_OF, 3, ["cursor"])


def _present(events):
    return events.select(F.col("source_file").alias("path")).distinct().filter(F.regexp_extract("path", r"f(\d+)\.jsonl", 1).cast("int") % 3 != 0)


def f9_missing(spark, sf_dir):
    events = ledger(spark, sf_dir)
    return A.missing_source_files(events, _present(events))


def _manifest(events):
    return events.groupBy(F.col("source_file").alias("path")).agg(F.max("ts").alias("mtime"), F.max("pos").alias("size"), F.max("pos").alias("offset"))


def f10_progress(spark, sf_dir):
    return A.progress_summary(_manifest(ledger(spark, sf_dir)))


def f11_issues(spark, sf_dir):
    events = _staggered(spark, sf_dir).filter("source <> 'codex'")
    return A.audit_issues(events, rates(spark), _present(events), _manifest(events).filter("size < 0"), AS_OF, "2023-06-01", ["cursor"])


def f12_status(spark, sf_dir):
    coverage = A.source_coverage(_staggered(spark, sf_dir).filter("source <> 'grok'"))
    known = ledger(spark, sf_dir).select("source").distinct()
    paths = known.select("source", (F.col("source") != "openclaw").alias("present"))
    return A.collection_status(coverage, paths, "2024-01-28", ["cursor"])


def f13_baseline(spark, sf_dir):
    return A.usage_baseline(ledger(spark, sf_dir), AS_OF)


def f15_contributors(spark, sf_dir):
    return A.top_contributors(ledger(spark, sf_dir), AS_OF)


def f16_background(spark, sf_dir):
    return A.background_share(ledger(spark, sf_dir), AS_OF)


def f17_cache(spark, sf_dir):
    return A.cache_efficiency(ledger(spark, sf_dir), rates(spark), AS_OF)


QUERIES = {
    "f1_source_coverage": f1_coverage, "f3_mixed_sessions": f3_mixed, "f4_mixed_summary": f4_mixed_summary, "f5_unknown_models": f5_unknown, "f6_unknown_summary": f6_unknown_summary,
    "f7_approximate_prices": f7_approximate, "f8_stale_sources": f8_stale, "f9_missing_files": f9_missing, "f10_progress": f10_progress, "f11_audit_issues": f11_issues,
    "f12_collection_status": f12_status, "f13_usage_baseline": f13_baseline, "f15_top_contributors": f15_contributors, "f16_background_share": f16_background, "f17_cache_efficiency": f17_cache,
}

_MIX = EV + """, mx AS (SELECT session_id, count(DISTINCT source) AS sources, count(DISTINCT model) AS models, count(DISTINCT project) AS projects, count(*) AS records, CAST(sum(total_norm) AS BIGINT) AS tokens
  FROM ev WHERE session_id <> '' AND day >= '2023-11-01' GROUP BY 1 HAVING count(DISTINCT source) > 1 OR count(DISTINCT model) > 1 OR count(DISTINCT project) > 1)"""
_TODAY = RATED.replace("day >= vf AND day < vt", f"'{AS_OF}' >= vf AND '{AS_OF}' < vt").replace("request_prompt_tokens > thr", "FALSE")
_STAG = EV + """, st AS (SELECT * FROM ev WHERE day <= strftime(DATE '2024-01-28' - CAST(CASE source WHEN 'claude' THEN 1 WHEN 'codex' THEN 2 WHEN 'opencode' THEN 3 WHEN 'openclaw' THEN 4 WHEN 'hermes' THEN 5 WHEN 'grok' THEN 6 ELSE 7 END AS INTEGER), '%Y-%m-%d')),
  cov AS (SELECT source, max(day) AS last_day FROM st GROUP BY 1), nw AS (SELECT max(last_day) AS newest FROM cov)"""

ORACLES = {
    "f1_source_coverage": EV + """ SELECT source, count(*) AS records, CAST(sum(total_norm) AS BIGINT) AS tokens, min(day) AS first_day, max(day) AS last_day,
      CASE WHEN source = 'hermes' THEN strftime(to_timestamp(max(ts) + 259200) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d') ELSE max(day) END AS activity_day FROM ev GROUP BY source""",
    "f3_mixed_sessions": _MIX + " SELECT * FROM mx ORDER BY tokens DESC, session_id LIMIT 10",
    "f4_mixed_summary": _MIX + " SELECT count(*) AS sessions, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(100.0 * coalesce(sum(tokens), 0) / (SELECT sum(total_norm) FROM ev WHERE day >= '2023-11-01'), 2) AS percent FROM mx",
    "f5_unknown_models": _TODAY + " SELECT model, source, count(*) AS records, CAST(sum(total_norm) AS BIGINT) AS tokens, round(CAST(sum(micro) AS DOUBLE) / 1e6, 4) AS cost_usd FROM pr WHERE status = 'unknown' GROUP BY 1, 2",
    "f6_unknown_summary": _TODAY + """, g AS (SELECT model, source, sum(total_norm) AS t, round(CAST(sum(micro) AS DOUBLE) / 1e6, 4) AS c FROM pr WHERE status = 'unknown' GROUP BY 1, 2)
      SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, round(coalesce(sum(c), 0), 4) AS cost_usd, round(100.0 * coalesce(sum(t), 0) / (SELECT sum(total_norm) FROM ev), 2) AS percent FROM g""",
    "f7_approximate_prices": _TODAY + " SELECT model, price_key AS priced_as, CAST(sum(total_norm) AS BIGINT) AS tokens, round(CAST(sum(micro) AS DOUBLE) / 1e6, 4) AS cost_usd FROM pr WHERE status = 'borrowed' GROUP BY 1, 2",
    "f8_stale_sources": _STAG + f""" SELECT 'warn' AS level, 'all_stale' AS code, '*' AS subject, CAST(DATE '{AS_OF}' - CAST(newest AS DATE) AS DOUBLE) AS value FROM nw WHERE DATE '{AS_OF}' - CAST(newest AS DATE) >= 3
      UNION ALL SELECT 'info', 'source_stale', source, CAST(CAST(newest AS DATE) - CAST(last_day AS DATE) AS DOUBLE) FROM cov, nw WHERE source <> 'cursor' AND CAST(newest AS DATE) - CAST(last_day AS DATE) >= 3""",
    "f9_missing_files": EV + """, g AS (SELECT source_file, sum(total_tokens) AS t FROM ev WHERE (u % 40) % 3 = 0 GROUP BY 1)
      SELECT count(*) AS files, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, round(100.0 * coalesce(sum(t), 0) / (SELECT sum(total_norm) FROM ev), 2) AS percent FROM g""",
    "f10_progress": EV + ", g AS (SELECT source_file, max(ts) AS m, max(pos) AS p FROM ev GROUP BY 1) SELECT count(*) AS files, max(m) AS latest_mtime, CAST(sum(p) AS BIGINT) AS total_size, CAST(sum(p) AS BIGINT) AS total_offset FROM g",
    "f12_collection_status": _STAG + """ SELECT source, CASE WHEN source = 'cursor' THEN 'uninstalled' WHEN source = 'openclaw' THEN 'missing' WHEN source = 'grok' THEN 'waiting'
      WHEN DATE '2024-01-28' - CAST(last_day AS DATE) >= 3 THEN 'idle' ELSE 'active' END AS state FROM cov""",
    "f13_usage_baseline": EV + f""", dl AS (SELECT day, sum(total_norm) AS n FROM ev WHERE day BETWEEN '2024-01-23' AND '{AS_OF}' GROUP BY 1),
      x AS (SELECT CAST(coalesce(sum(n) FILTER (day = '{AS_OF}'), 0) AS BIGINT) AS today, CAST(coalesce(sum(n) FILTER (day = '2024-01-29'), 0) AS BIGINT) AS yesterday, CAST(coalesce(floor(avg(n) FILTER (day < '{AS_OF}' AND n > 0)), 0) AS BIGINT) AS baseline FROM dl),
      y AS (SELECT *, CASE WHEN yesterday > 0 AND today > 0 THEN round(100.0 * (today - yesterday) / yesterday, 1) END AS vs_yesterday, CASE WHEN baseline > 0 AND today > 0 THEN round(100.0 * (today - baseline) / baseline, 1) END AS vs_baseline FROM x)
      SELECT *, coalesce(vs_yesterday >= 50, FALSE) OR coalesce(vs_baseline >= 50, FALSE) AS warn FROM y""",
    "f15_top_contributors": EV + f""" SELECT * FROM (SELECT 'project' AS kind, project AS name, display_source, CAST(sum(total_norm) AS BIGINT) AS tokens FROM ev WHERE {within('today')} GROUP BY 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'model' AS kind, model AS name, display_source, CAST(sum(total_norm) AS BIGINT) AS tokens FROM ev WHERE {within('today')} GROUP BY 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 1)""",
    "f16_background_share": EV + f""", bg AS (SELECT CAST(coalesce(sum(total_norm) FILTER (category <> 'main'), 0) AS BIGINT) AS background, CAST(coalesce(sum(total_norm) FILTER (category = 'main'), 0) AS BIGINT) AS main FROM ev WHERE {within('today')})
      SELECT *, round(100.0 * background / nullif(background + main, 0), 1) AS background_percent, round(100.0 * main / nullif(background + main, 0), 1) AS main_percent FROM bg""",
    "f17_cache_efficiency": RATED + f""", g AS (SELECT sum(cache_read_tokens) AS r, sum(input_tokens) AS i, sum(output_billed) AS o, sum(saved) AS s FROM pr WHERE {within('today')})
      SELECT round(100.0 * r / nullif(r + i, 0), 1) AS cache_percent, round(100.0 * o / nullif(r + i, 0), 1) AS output_percent, round(CAST(s AS DOUBLE) / 1e6, 4) AS saved_usd FROM g""",
}

_ENDS = "day <= strftime(DATE '2024-01-28' - CAST(CASE source WHEN 'claude' THEN 1 WHEN 'opencode' THEN 3 WHEN 'openclaw' THEN 4 WHEN 'hermes' THEN 5 WHEN 'grok' THEN 6 ELSE 7 END AS INTEGER), '%Y-%m-%d')"
_PART = EV.replace("FROM usage_events\n)", f"FROM usage_events WHERE source <> 'codex' AND {_ENDS})")
ORACLES["f11_audit_issues"] = _TODAY.replace(EV, _PART) + """, mx AS (SELECT session_id, sum(total_norm) AS t FROM ev WHERE session_id <> '' GROUP BY 1 HAVING count(DISTINCT source) > 1 OR count(DISTINCT model) > 1 OR count(DISTINCT project) > 1),
  whole AS (SELECT sum(total_norm) AS n FROM ev), cov AS (SELECT source, CAST(max(day) AS DATE) AS last_day FROM ev GROUP BY 1), nw AS (SELECT max(last_day) AS newest FROM cov),
  gone AS (SELECT source_file, sum(total_tokens) AS t FROM ev WHERE (u % 40) % 3 = 0 GROUP BY 1)
  SELECT 'warn' AS level, 'source_missing' AS code, 'codex' AS subject, CAST(0 AS DOUBLE) AS value
  UNION ALL SELECT 'warn', 'all_stale', '*', CAST(DATE '2024-01-30' - newest AS DOUBLE) FROM nw WHERE DATE '2024-01-30' - newest >= 3
  UNION ALL SELECT 'info', 'source_stale', source, CAST(newest - last_day AS DOUBLE) FROM cov, nw WHERE source <> 'cursor' AND newest - last_day >= 3
  UNION ALL SELECT 'warn', 'no_progress', '*', 0
  UNION ALL SELECT 'info', 'mixed_sessions', '*', round(100.0 * sum(t) / (SELECT n FROM whole), 2) FROM mx HAVING count(*) > 0
  UNION ALL SELECT 'info', 'approximate_prices', '*', count(DISTINCT model) FROM pr WHERE status = 'borrowed' HAVING count(*) > 0
  UNION ALL SELECT 'warn', 'unknown_models', '*', round(100.0 * sum(total_norm) / (SELECT n FROM whole), 2) FROM pr WHERE status = 'unknown' HAVING sum(total_norm) > 0
  UNION ALL SELECT 'info', 'missing_files', '*', round(100.0 * sum(t) / (SELECT n FROM whole), 2) FROM gone HAVING 100.0 * sum(t) / (SELECT n FROM whole) >= 10
  UNION ALL SELECT 'warn', 'rates_not_verified', '*', CAST(DATE '2024-01-30' - DATE '2023-06-01' AS DOUBLE)"""
