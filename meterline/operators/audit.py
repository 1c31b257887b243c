"""Audits of the ledger's completeness and the insights of one day. Jobs return codes and values, no texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rates import classify_models, priced_groups, resolve_price_key, usd
from .reports import day, in_period

STALE_DAYS = 3
PRICING_STALE_DAYS = 90
EXPECTED = ["claude", "codex"]
MIXED_DAYS = 90
CSV_KEY = "cursor-usage-csv"


def percent(part, whole, places: int = 2):
    return F.when(whole != 0, F.round(100.0 * part / whole, places)).otherwise(F.lit(0.0))


def source_coverage(events: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """Per source: records, tokens, first and last day, last active day. ``activity`` (source, last_ts) overrides the
    last for sources whose records are dated by their session's start."""
    out = events.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("total_norm").alias("tokens"), day(F.min("date_local")).alias("first_day"), day(F.max("date_local")).alias("last_day")
    )
    if activity is None:
        return out.withColumn("activity_day", F.col("last_day"))
    from ..functions.scalars import local_day

    seen = activity.groupBy("source").agg(day(local_day(F.max("last_ts"))).alias("seen_day"))
    return out.join(seen, "source", "left").withColumn("activity_day", F.coalesce("seen_day", "last_day")).drop("seen_day")


def recent(events: DataFrame, as_of: str, days: int) -> DataFrame:
    return events.filter(F.col("date_local") >= F.date_sub(F.lit(as_of).cast("date"), days))


def _mixed(events: DataFrame, as_of: str) -> DataFrame:
    """Sessions over more than one source, model or project. Distinct combinations are few a session, so they are
    grouped first and counted after."""
    few = recent(events, as_of, MIXED_DAYS).filter("session_id <> ''").groupBy("session_id", "source", "model", "project").agg(F.count(F.lit(1)).alias("records"), F.sum("total_norm").alias("tokens"))
    counted = few.groupBy("session_id").agg(*[F.size(F.collect_set(c)).cast("long").alias(f"{c}s") for c in ("source", "model", "project")], F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    return counted.filter("sources > 1 OR models > 1 OR projects > 1")


def mixed_sessions(events: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    return _mixed(events, as_of).orderBy(F.desc("tokens"), "session_id").limit(limit)


def mixed_sessions_summary(events: DataFrame, as_of: str) -> DataFrame:
    whole = recent(events, as_of, MIXED_DAYS).agg(F.coalesce(F.sum("total_norm"), F.lit(0)).alias("window_tokens"))
    part = _mixed(events, as_of).agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return part.join(F.broadcast(whole), F.lit(True)).select("sessions", "tokens", percent(F.col("tokens"), F.col("window_tokens")).alias("percent"))


def _models_with(events: DataFrame, rates: DataFrame, status: str, rules=None) -> DataFrame:
    return resolve_price_key(events, rates, rules).filter(F.col("status") == status).select(F.col("model"), F.col("key").alias("borrowed"))


def unknown_model_cost(events: DataFrame, rates: DataFrame, as_of: str, rules=None) -> DataFrame:
    """Per unknown model and source: records, tokens, cost at the base prices of ``as_of`` (no tiers, no history)."""
    rows = events.join(_models_with(events, rates, "unknown", rules).drop("borrowed"), "model", "left_semi")
    today = rows.withColumns({"date_local": F.lit(as_of).cast("date"), "request_prompt_tokens": F.lit(None).cast("long")})
    return priced_groups(today, rates, ["model", "source"], rules).groupBy("model", "source").agg(F.sum("records").alias("records"), F.sum("total_norm").alias("tokens"), usd(F.sum("cost_micro")).alias("cost_usd"))


def unknown_model_summary(events: DataFrame, rates: DataFrame, as_of: str, rules=None) -> DataFrame:
    part = unknown_model_cost(events, rates, as_of, rules).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"))
    whole = events.agg(F.coalesce(F.sum("total_norm"), F.lit(0)).alias("all_tokens"))
    return part.join(F.broadcast(whole), F.lit(True)).select("tokens", "cost_usd", percent(F.col("tokens"), F.col("all_tokens")).alias("percent"))


def approximate_prices(events: DataFrame, rates: DataFrame, as_of: str, rules=None) -> DataFrame:
    """Models priced by another model's entry, with that entry, tokens and cost at the base prices of ``as_of``."""
    borrowed = classify_models(events, rates, rules).filter("status = 'borrowed'").select("model", "priced_as")
    today = events.join(borrowed, "model").withColumns({"date_local": F.lit(as_of).cast("date"), "request_prompt_tokens": F.lit(None).cast("long")})
    out = priced_groups(today, rates, ["model", "priced_as"], rules).groupBy("model", "priced_as").agg(F.sum("total_norm").alias("tokens"), F.sum("cost_micro").alias("micro"))
    return out.orderBy(F.desc("micro"), "model").select("model", "priced_as", "tokens", usd(F.col("micro")).alias("cost_usd"))


def stale_sources(coverage: DataFrame, as_of: str, days: int = STALE_DAYS, excluded: list[str] | None = None) -> DataFrame:
    """level, code, subject, value: every source silent for ``days`` (one warning), or single ones behind the newest
    (info; another code where messages were seen later than the records' day)."""
    newest = coverage.agg(F.max("last_day").alias("newest"))
    everything = newest.filter(F.datediff(F.lit(as_of).cast("date"), F.col("newest")) >= days).select(
        F.lit("warn").alias("level"), F.lit("all_stale").alias("code"), F.lit("*").alias("subject"), F.datediff(F.lit(as_of).cast("date"), F.col("newest")).cast("double").alias("value")
    )
    each = coverage.join(F.broadcast(newest), F.lit(True)).withColumn("lag", F.datediff("newest", "last_day")).filter(F.col("lag") >= days).filter(~F.col("source").isin(*(excluded or [""])))
    code = F.when(F.col("activity_day") > F.col("last_day"), "dated_by_session_start").otherwise("source_stale")
    return everything.unionByName(each.select(F.lit("info").alias("level"), code.alias("code"), F.col("source").alias("subject"), F.col("lag").cast("double").alias("value")))


def missing_source_files(events: DataFrame, present: DataFrame) -> DataFrame:
    """One row: files, tokens (as stored) and percent of rows whose source file is not in ``present`` (path)."""
    rows = events.filter("source_file <> ''").filter(~((F.col("source") == "cursor") & (F.col("source_file") == CSV_KEY)))
    files = rows.groupBy("source_file").agg(F.sum("total_tokens").alias("tokens"))
    gone = files.join(present.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    whole = events.agg(F.coalesce(F.sum("total_norm"), F.lit(0)).alias("all_tokens"))
    return gone.join(F.broadcast(whole), F.lit(True)).select("files", "tokens", percent(F.col("tokens"), F.col("all_tokens")).alias("percent"))


def progress_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("latest_mtime"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("offset"), F.lit(0)).alias("total_offset"))


def audit_issues(events: DataFrame, rates: DataFrame, present: DataFrame, manifest: DataFrame, as_of: str, verified_on: str | None = None, excluded: list[str] | None = None, rules=None) -> DataFrame:
    """level, code, subject, value: all findings; the audit's status is warn if any level is."""
    spark = events.sparkSession
    issue = lambda df, level, code, value, subject="*": df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(subject).alias("subject"), value.cast("double").alias("value"))
    coverage = source_coverage(events)
    count = events.agg(F.count(F.lit(1)).alias("n"))
    out = issue(count.filter("n = 0"), "warn", "empty_ledger", F.lit(0))
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in EXPECTED])).alias("source"))
    absent = expected.join(coverage, "source", "left_anti").select(F.lit("warn").alias("level"), F.lit("source_missing").alias("code"), F.col("source").alias("subject"), F.lit(0.0).alias("value"))
    mixed, unknown, missing = mixed_sessions_summary(events, as_of), unknown_model_summary(events, rates, as_of, rules), missing_source_files(events, present)
    approx = approximate_prices(events, rates, as_of, rules).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        absent, stale_sources(coverage, as_of, excluded=excluded), issue(progress_summary(manifest).filter("files = 0"), "warn", "no_progress", F.lit(0)),
        issue(mixed.filter("sessions > 0"), "info", "mixed_sessions", F.col("percent")), issue(approx.filter("n > 0"), "info", "approximate_prices", F.col("n")),
        issue(unknown.filter("tokens > 0"), "warn", "unknown_models", F.col("percent")), issue(missing.filter("files > 0 AND percent >= 10"), "info", "missing_files", F.col("percent")),
    ]
    if verified_on:
        age = F.datediff(F.lit(as_of).cast("date"), F.lit(verified_on).cast("date"))
        parts.append(issue(spark.range(1).filter(age >= PRICING_STALE_DAYS), "warn", "rates_not_verified", age))
    for p in parts:
        out = out.unionByName(p)
    return out


def collection_status(coverage: DataFrame, paths: DataFrame, as_of: str, uninstalled: list[str] | None = None, days: int = STALE_DAYS) -> DataFrame:
    """source, state: uninstalled, missing (no path), waiting (nothing yet), idle or active. ``paths``: source, present."""
    rows = paths.join(coverage.select("source", "activity_day"), "source", "left")
    lag = F.datediff(F.lit(as_of).cast("date"), F.col("activity_day"))
    state = F.when(F.col("source").isin(*(uninstalled or [""])), "uninstalled").when(~F.col("present"), "missing").when(F.col("activity_day").isNull(), "waiting").when(lag >= days, "idle").otherwise("active")
    return rows.select("source", state.alias("state"))


def usage_baseline(events: DataFrame, as_of: str) -> DataFrame:
    """today, yesterday, baseline (whole mean of the non-zero ones of the seven days before), the percents against both
    and whether either rise is one to warn of (50 or more)."""
    d = F.lit(as_of).cast("date")
    daily = events.filter(F.col("date_local").between(F.date_sub(d, 7), d)).groupBy("date_local").agg(F.sum("total_norm").alias("n"))
    at = lambda back: F.coalesce(F.sum(F.when(F.col("date_local") == F.date_sub(d, back), F.col("n"))), F.lit(0))
    prior = F.when((F.col("date_local") < d) & (F.col("n") > 0), F.col("n"))
    both = daily.agg(at(0).alias("today"), at(1).alias("yesterday"), F.coalesce(F.floor(F.sum(prior) / F.count(prior)), F.lit(0)).cast("long").alias("baseline"))
    change = lambda c: F.when((F.col(c) > 0) & (F.col("today") > 0), F.round(100.0 * (F.col("today") - F.col(c)) / F.col(c), 1))
    out = both.withColumns({"vs_yesterday": change("yesterday"), "vs_baseline": change("baseline")})
    return out.withColumn("warn", F.coalesce(F.col("vs_yesterday") >= 50, F.lit(False)) | F.coalesce(F.col("vs_baseline") >= 50, F.lit(False)))


def top_contributors(events: DataFrame, as_of: str) -> DataFrame:
    """The day's largest project and largest model, each with its display source."""
    rows = in_period(events, as_of, "today")
    pick = lambda c: rows.groupBy(F.lit(c).alias("kind"), F.col(c).alias("name"), "display_source").agg(F.sum("total_norm").alias("tokens")).orderBy(F.desc("tokens"), "name", "display_source").limit(1)
    return pick("project").unionByName(pick("model"))


def background_share(events: DataFrame, as_of: str) -> DataFrame:
    part = lambda *c: F.coalesce(F.sum(F.when(F.col("category").isin(*c), F.col("total_norm"))), F.lit(0))
    both = in_period(events, as_of, "today").agg(part("observer", "subagent").alias("background"), part("main").alias("main"))
    whole = F.col("background") + F.col("main")
    return both.withColumns({"background_percent": percent(F.col("background"), whole, 1), "main_percent": percent(F.col("main"), whole, 1)})


def cache_efficiency(events: DataFrame, rates: DataFrame, as_of: str, rules=None) -> DataFrame:
    got = priced_groups(in_period(events, as_of, "today"), rates, ["source"], rules)
    whole = F.col("read") + F.col("fresh")
    sums = got.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("read", "cache_read_tokens"), ("fresh", "input_tokens"), ("out", "output_billed"))], F.sum("saved_micro").alias("saved"))
    return sums.select(percent(F.col("read"), whole, 1).alias("cache_percent"), percent(F.col("out"), whole, 1).alias("output_percent"), usd(F.coalesce("saved", F.lit(0).cast("decimal(38,6)"))).alias("saved_usd"))
