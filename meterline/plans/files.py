"""Registered queries that write files made of the events into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.rates import effective_rates, load_rates
from ..session import shared_folder
from ..sources import message_tables, readers
from ..sources.log_source import read_planned_lines
from ..sources.sinks import read_ledger, write_ledger
from ..sources.tables import read_tables, usage_events
from . import raw_inputs as raw
from .ingestion import ORACLES as INGESTION
from .ingestion import SHOWN
from .oracle_base import EV

LOGS, LONGEST = 40, 60


def new_folder(spark, kind):
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def log_files(spark, sf_dir, codec="none"):
    """A folder of LOGS logs: one line an event, of a length that differs, in the order of the events."""
    path = new_folder(spark, "logs")
    lines = usage_events(spark, sf_dir, True).select(
        F.pmod("u", F.lit(LOGS)).cast("int").alias("log"), "e",
        F.concat(F.lit("event "), F.col("e").cast("string"), F.lit(" "), F.repeat(F.lit("é"), F.pmod("e", F.lit(29)).cast("int"))).alias("value"),
    )
    lines.repartition(LOGS, "log").sortWithinPartitions("log", "e").select("log", "value").write.partitionBy("log").option("compression", codec).text(path)
    return path


def with_log(lines):
    return lines.withColumn("log", F.regexp_extract("path", r"log=(\d+)/", 1).cast("long"))


def a1_lines(spark, sf_dir):
    """Every line of the logs up to LONGEST bytes, with its offset."""
    lines = readers.read_log_lines(spark, log_files(spark, sf_dir), max_line_bytes=LONGEST)
    return with_log(lines).select("log", "pos", "value")


def a2_compressed(spark, sf_dir):
    """The same lines from compressed logs: offsets count what they hold, names lose the suffix. gzip, as Spark reads .zst but writes none."""
    lines = readers.read_log_lines(spark, log_files(spark, sf_dir, "gzip"), max_line_bytes=LONGEST)
    return with_log(lines).select("log", "pos", "value", F.col("path").endswith(".txt").alias("plain_name"))


def a5_resume(spark, sf_dir):
    """Lines that a second run reads: a third of the logs had been read whole, a third up to a line, a third not at all.
    Only the files to read are opened, from where they are resumed."""
    path = log_files(spark, sf_dir)
    now = with_log(readers.list_files(spark, path))
    half = with_log(readers.read_log_lines(spark, path)).filter("log % 3 = 1").groupBy("path").agg(F.percentile("pos", 0.5).cast("long").alias("offset"))
    last = now.filter("log % 3 < 2").join(half, "path", "left").withColumn("offset", F.coalesce("offset", "size"))
    plan = readers.plan_files(now.drop("log"), last.select("path", "inode", "offset", "head"))
    return with_log(read_planned_lines(spark, plan)).groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def a6_csv(spark, sf_dir):
    """The usage export written as CSV files with headers, read by header name and normalised."""
    path = new_folder(spark, "csv")
    raw.csv_rows(spark, sf_dir).drop("pos").write.option("header", True).option("escape", '"').csv(path)
    rows = message_tables.normalize_usage_csv(readers.read_usage_csv(spark, path))
    return rows.select("ts", "model", "input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "total_tokens", "dedup_key")


def a7_tables(spark, sf_dir):
    """The message table as an ORC table, read and normalised."""
    path = new_folder(spark, "messages")
    raw.message_table(spark, sf_dir).write.orc(path)
    return message_tables.normalize_messages(read_tables(spark, path, "orc")).select(*SHOWN)


def a8_rates(spark, sf_dir):
    """Rates as JSON lines, one change a key and day of events, loaded and made into intervals."""
    path = new_folder(spark, "rates")
    ev = usage_events(spark, sf_dir, True).withColumn("starts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    named = ev.groupBy(F.concat(F.lit("m"), F.pmod("u", F.lit(7)).cast("string")).alias("key"), "starts").agg(
        F.max(F.col("input_tokens") + 1).alias("input"), F.max(F.when(F.col("e") % 97 == 0, F.col("k") + 2)).alias("output")
    )
    default = ev.agg(F.lit("default").alias("key"), F.max("k").alias("input"))
    named.unionByName(default, allowMissingColumns=True).write.json(path)
    rates = effective_rates(load_rates(spark, path))
    return rates.select("key", "valid_from", "valid_to", F.col("r_in").cast("double").alias("r_in"), F.col("r_out").cast("double").alias("r_out"))


def a9_ledger(spark, sf_dir):
    """The ledger written by day; then days with an event of a number divisible by 5000 are written again, doubled."""
    path = new_folder(spark, "ledger")
    events = usage_events(spark, sf_dir, True)
    write_ledger(events, path)
    day = F.date_format(F.timestamp_seconds(F.col("ts") + 8 * 3600), "yyyy-MM-dd")
    again = events.withColumn("day", day).join(events.filter("e % 5000 = 0").select(day.alias("day")).distinct(), "day", "left_semi")
    write_ledger(again.withColumn("total_tokens", F.col("total_tokens") * 2), path)
    return read_ledger(spark, path).select("dedup_key", "total_tokens", F.col("date_local").cast("string").alias("date_local"))


QUERIES = {
    "a1_read_log_lines": a1_lines, "a2_compressed_lines": a2_compressed, "a5_resume_lines": a5_resume, "a6_read_usage_csv": a6_csv, "a7_read_tables": a7_tables,
    "a8_load_rates": a8_rates, "a9_ledger_sink": a9_ledger,
}

_LINES = EV + f""", ln AS (SELECT u % {LOGS} AS log, e, concat('event ', e, ' ', repeat('é', CAST(e % 29 AS BIGINT))) AS value FROM ev),
  sz AS (SELECT *, strlen(value) AS bytes FROM ln),
  placed AS (SELECT log, value, bytes, CAST(sum(bytes + 1) OVER (PARTITION BY log ORDER BY e) - bytes - 1 AS BIGINT) AS pos FROM sz)"""
ORACLES = {
    "a1_read_log_lines": _LINES + f" SELECT log, pos, value FROM placed WHERE bytes <= {LONGEST}",
    "a2_compressed_lines": _LINES + f" SELECT log, pos, value, TRUE AS plain_name FROM placed WHERE bytes <= {LONGEST}",
    "a5_resume_lines": _LINES + """, half AS (SELECT log, CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS start FROM placed WHERE log % 3 = 1 GROUP BY log)
      SELECT log, count(*) AS n, min(pos) AS first, max(pos) AS last FROM placed LEFT JOIN half USING (log) WHERE log % 3 = 2 OR pos >= start GROUP BY log""",
    "a6_read_usage_csv": f"SELECT * EXCLUDE (pos) FROM ({INGESTION['b21_usage_csv']})",
    "a7_read_tables": INGESTION["b17_message_table"],
    "a8_load_rates": EV + """, dd AS (SELECT concat('m', u % 7) AS key, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS valid_from, max(input_tokens + 1) AS i, max(CASE WHEN e % 97 = 0 THEN k + 2 END) AS o FROM ev GROUP BY 1, 2
        UNION ALL SELECT 'default', '0000-01-01', max(k), NULL FROM ev)
      SELECT key, valid_from, coalesce(lead(valid_from) OVER w, '9999-12-31') AS valid_to, CAST(i AS DOUBLE) AS r_in, CAST(coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY key ORDER BY valid_from ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS r_out
      FROM dd WINDOW w AS (PARTITION BY key ORDER BY valid_from)""",
    "a9_ledger_sink": EV + " SELECT dedup_key, CAST(total_tokens * CASE WHEN day IN (SELECT day FROM ev WHERE e % 5000 = 0) THEN 2 ELSE 1 END AS BIGINT) AS total_tokens, day AS date_local FROM ev",
}
