"""Period reports over the priced ledger. Every function takes the day it reports for; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import COLLECTOR_SOURCE, SOURCES
from ..functions.scalars import guarded, project_name
from .rates import SUMS, priced_groups, usd

DISPLAY_SOURCES = [*SOURCES, COLLECTOR_SOURCE]
FIRST_DAY = "2000-01-01"
PARTS = [c for c in SUMS if c != "total_norm"]


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def period_table(spark: SparkSession, as_of: str) -> DataFrame:
    """period, from_day, to_day (closed): today, yesterday, week (7 days with today), month (from its 1st), all."""
    d = F.lit(as_of).cast("date")
    spans = [("today", d, d), ("yesterday", F.date_sub(d, 1), F.date_sub(d, 1)), ("week", F.date_sub(d, 6), d), ("month", F.trunc(d, "month"), d), ("all", F.lit(FIRST_DAY).cast("date"), d)]
    rows = F.array(*[F.struct(F.lit(n).alias("period"), a.alias("from_day"), b.alias("to_day")) for n, a, b in spans])
    return spark.range(1).select(F.explode(rows).alias("p")).select("p.*")


def in_period(events: DataFrame, as_of: str, period: str) -> DataFrame:
    """Events of one period; the bounds reach the scan as a filter on date_local."""
    d = F.lit(as_of).cast("date")
    low = {"today": d, "yesterday": F.date_sub(d, 1), "week": F.date_sub(d, 6), "month": F.trunc(d, "month"), "all": F.lit(FIRST_DAY).cast("date")}[period]
    high = F.date_sub(d, 1) if period == "yesterday" else d
    return events.filter(F.col("date_local").between(low, high))


def _sums(cost_places: int = 4) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], F.sum("records").alias("records"), usd(F.sum("cost_micro"), cost_places).alias("cost_usd")]


def period_summary(events: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """For each period its total, its physical sources and its display sources: tokens, records, cost, first day.

    The ledger is summed by day and source once; the five periods are joined to that, not to the ledger.
    """
    daily = priced_groups(in_period(events, as_of, "all"), rates, ["date_local", "source", "display_source"])
    periods = F.broadcast(period_table(events.sparkSession, as_of))  # five rows
    rows = daily.join(periods, F.col("date_local").between(F.col("from_day"), F.col("to_day")))
    cuts = {"total": F.lit("total"), "source": F.col("source"), "display": F.col("display_source")}
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), n.alias("name")) for c, n in cuts.items()]))
    out = rows.withColumn("c", cut).groupBy("period", F.col("c.cut").alias("cut"), F.col("c.name").alias("name"))
    return out.agg(*_sums(), day(F.min("date_local")).alias("first_day"))


def daily_series(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """day, one column of tokens a display source, total: the last ``days`` (1 to 365) days, gaps as zeros."""
    days = max(1, min(365, int(days)))
    last = F.lit(as_of).cast("date")
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date_local"))
    recent = events.filter(F.col("date_local").between(F.date_sub(last, days - 1), last))
    sums = [F.sum(F.when(F.col("display_source") == s, F.col("total_norm")).otherwise(0)).alias(s) for s in DISPLAY_SOURCES]
    grouped = recent.groupBy("date_local").agg(*sums)
    full = calendar.join(grouped, "date_local", "left")
    zero = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in DISPLAY_SOURCES]
    filled = full.select(day("date_local").alias("day"), *zero)
    return filled.withColumn("total", sum((F.col(s) for s in DISPLAY_SOURCES[1:]), F.col(DISPLAY_SOURCES[0])))


def active_sources(daily: DataFrame) -> DataFrame:
    """Display sources that have any tokens in a daily series."""
    long = daily.select(F.explode(F.array(*[F.struct(F.lit(s).alias("display_source"), F.col(s).alias("tokens")) for s in DISPLAY_SOURCES])).alias("x"))
    return long.groupBy("x.display_source").agg(F.sum("x.tokens").alias("tokens")).filter("tokens <> 0")


def _filtered(events: DataFrame, as_of: str, period: str, display_source: str | None) -> DataFrame:
    rows = in_period(events, as_of, period)
    return rows.filter(F.col("display_source") == display_source) if display_source else rows


def breakdown_by_model(events: DataFrame, rates: DataFrame, as_of: str, period: str, display_source: str | None = None) -> DataFrame:
    """source, model, collector: token parts (both cache writes together), total and cost, largest first."""
    keys = ["source", "model", "collector"]
    groups = priced_groups(_filtered(events, as_of, period, display_source), rates, keys)
    out = groups.groupBy(*keys).agg(*_sums()).withColumn("cache_writes", F.col("cache_creation_tokens") + F.col("cache_creation_1h_tokens"))
    return out.drop("cache_creation_tokens", "cache_creation_1h_tokens").orderBy(F.desc("total_norm"), *keys)


def breakdown_by_project(events: DataFrame, rates: DataFrame, as_of: str, period: str, display_source: str | None = None) -> DataFrame:
    """source, project, collector with the project's display name, largest first."""
    keys = ["source", "project", "collector"]
    groups = priced_groups(_filtered(events, as_of, period, display_source), rates, keys)
    out = groups.groupBy(*keys).agg(*_sums()).withColumn("project_name", project_name(F.col("project")))
    return out.orderBy(F.desc("total_norm"), *keys)


def breakdown_totals(events: DataFrame, rates: DataFrame, as_of: str, period: str, display_source: str | None = None) -> DataFrame:
    """One row: the total both breakdowns share, its cost rounded once."""
    return priced_groups(_filtered(events, as_of, period, display_source), rates, ["source"]).agg(*_sums())


def export_rows(events: DataFrame, rates: DataFrame, as_of: str, period: str) -> DataFrame:
    """The finest cut of a report: source, collector, model, project."""
    keys = ["source", "collector", "model", "project"]
    return priced_groups(in_period(events, as_of, period), rates, keys).groupBy(*keys).agg(*_sums())


EXPORT_COLUMNS = ["source", "collector", "model", "project", "input_tokens", "output_billed", "cache_read_tokens", "cache_creation_tokens", "cache_creation_1h_tokens", "reasoning_tokens", "total_norm", "cost_usd"]


def export_table(rows: DataFrame) -> DataFrame:
    """The twelve columns of the CSV export, texts guarded against being read as formulas."""
    text = ("source", "collector", "model", "project")
    return rows.select(*[guarded(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in text else F.col(c) for c in EXPORT_COLUMNS])


def export_csv(rows: DataFrame, path: str) -> None:
    export_table(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def top_sessions(events: DataFrame, rates: DataFrame, as_of: str, period: str, limit: int) -> DataFrame:
    """The ``limit`` (1 to 50) dearest sessions, labelled by their largest group; sessions without an id are left out
    before anything is grouped, for they would be one hot key."""
    keys = ["session_id", "date_local", "source", "model", "project", "collector"]
    groups = priced_groups(in_period(events, as_of, period).filter("session_id <> ''"), rates, keys)
    label = F.struct(*[F.col(c) for c in ("source", "model", "project", "collector")])
    order = F.struct("total_norm", "source", "model", "project", F.col("date_local"), "cost_micro")
    out = groups.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("records").alias("records"), F.sum("cost_micro").alias("cost_micro"), day(F.min("date_local")).alias("first_day"), F.max_by(label, order).alias("label"))
    top = out.orderBy(F.desc("cost_micro"), "session_id").limit(max(1, min(50, int(limit))))
    return top.select("session_id", *SUMS, "records", usd(F.col("cost_micro")).alias("cost_usd"), "first_day", "label.source", "label.model", "label.project", "label.collector")


def session_summary(events: DataFrame, rates: DataFrame, session_id: str, as_of: str, period: str) -> DataFrame:
    rows = in_period(events, as_of, period).filter(F.col("session_id") == session_id)
    return priced_groups(rows, rates, ["date_local"]).agg(*_sums(), day(F.min("date_local")).alias("first_day"), day(F.max("date_local")).alias("last_day"))


def session_groups(events: DataFrame, rates: DataFrame, session_id: str, as_of: str, period: str) -> DataFrame:
    keys = ["source", "collector", "model", "project"]
    return priced_groups(in_period(events, as_of, period).filter(F.col("session_id") == session_id), rates, keys).groupBy(*keys).agg(*_sums())


def session_files(events: DataFrame, session_id: str, as_of: str, period: str, limit: int = 8) -> DataFrame:
    rows = in_period(events, as_of, period).filter(F.col("session_id") == session_id)
    out = rows.groupBy("source_file").agg(F.sum("total_norm").alias("tokens"), F.count(F.lit(1)).alias("records"))
    return out.orderBy(F.desc("tokens"), "source_file").limit(limit)


def ledger_meta(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("records"), day(F.min("date_local")).alias("first_day"), day(F.max("date_local")).alias("last_day"))


def source_share(summary: DataFrame) -> DataFrame:
    """For each period the display sources that have tokens, with their whole percent of the period."""
    rows = summary.filter("cut = 'display' AND total_norm <> 0")
    whole = F.sum("total_norm").over(Window.partitionBy("period"))
    return rows.select("period", F.col("name").alias("display_source"), "total_norm", F.round(100.0 * F.col("total_norm") / whole).cast("long").alias("percent"))


def day_change(summary: DataFrame) -> DataFrame:
    """Today's and yesterday's tokens and the whole percent of change; null if there was nothing yesterday."""
    total = lambda p: F.coalesce(F.max(F.when(F.col("period") == p, F.col("total_norm"))), F.lit(0))
    both = summary.filter("cut = 'total'").agg(total("today").alias("today"), total("yesterday").alias("yesterday"))
    change = F.round(100.0 * (F.col("today") - F.col("yesterday")) / F.nullif(F.col("yesterday"), F.lit(0))).cast("long")
    return both.withColumn("percent_change", change)


def month_end_projection(events: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Cost of the month so far, and that cost carried on to its last day."""
    d = F.lit(as_of).cast("date")
    month = priced_groups(in_period(events, as_of, "month"), rates, ["source"]).agg(F.coalesce(F.sum("cost_micro").cast("double"), F.lit(0.0)).alias("micro"))
    return month.select(F.round(F.col("micro") / 1e6, 4).alias("month_cost_usd"), F.round(F.col("micro") / 1e6 / F.dayofmonth(d) * F.dayofmonth(F.last_day(d)), 4).alias("projected_usd"))


def daily_costs(events: DataFrame, rates: DataFrame, as_of: str, days: int) -> DataFrame:
    last = F.lit(as_of).cast("date")
    rows = events.filter(F.col("date_local").between(F.date_sub(last, days - 1), last))
    return priced_groups(rows, rates, ["date_local"]).groupBy(day("date_local").alias("day")).agg(F.sum("total_norm").alias("tokens"), usd(F.sum("cost_micro"), 6).alias("cost_usd"))


def threshold_alerts(daily: DataFrame, cost_limit: float | None, token_limit: int | None, fx: float = 7.25) -> DataFrame:
    """Days whose cost (in the caller's currency, at one given rate) or tokens reach a limit."""
    local = F.round(F.col("cost_usd") * fx, 4)
    over_cost = F.lit(False) if cost_limit is None else local >= cost_limit
    over_tokens = F.lit(False) if token_limit is None else F.col("tokens") >= token_limit
    out = daily.withColumns({"cost_local": local, "over_cost": over_cost, "over_tokens": over_tokens})
    return out.filter("over_cost OR over_tokens").select("day", "tokens", "cost_local", "over_cost", "over_tokens")
