"""Inputs that are derived from the given tables: the usage ledger over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that reach every way a model finds its price.
MODELS = [
    "atlas-3", "us.anthropic.atlas-3[1m]", "atlas-3.5", "atlas-3-20260101", "atlas-3-52", "borea-2-mini-preview",
    "borea-2", "openai.vendor/borea-9", "cirrus-4.1-rapid", "cirrus-4-odd-rapid", "unknown", "mystery-1",
]

_USAGE = """
WITH b AS (
  SELECT event_id AS e, user_id AS u, event_type AS et, {K} AS k, {TS} AS ts0 FROM events
), c AS (
  SELECT e, u, k, et, ts0,
         CASE e % 7 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' WHEN 3 THEN 'openclaw'
                    WHEN 4 THEN 'hermes' WHEN 5 THEN 'grok' ELSE 'cursor' END AS source,
         CASE WHEN et = 'signup' THEN 'observer' WHEN et = 'error' THEN 'subagent' ELSE 'main' END AS category
  FROM b
), d AS (
  SELECT ts0 AS ts, source, {MODEL} AS model,
         concat('/work/team', CAST(u % 5 AS STRING), '/app', CAST(u % 23 AS STRING)) AS project, category,
         CAST(k * 37 + e % 911 AS BIGINT) AS input_tokens,
         CAST(k * 11 + e % 307 AS BIGINT) AS output_tokens,
         CAST(CASE WHEN e % 3 = 0 THEN 0 ELSE k * 101 + e % 1009 END AS BIGINT) AS cache_read_tokens,
         CAST(CASE WHEN source = 'claude' THEN k * 3 ELSE 0 END AS BIGINT) AS cache_creation_tokens,
         CAST(CASE WHEN source = 'claude' AND e % 2 = 0 THEN k * 2 ELSE 0 END AS BIGINT) AS cache_creation_1h_tokens,
         CAST(e % 53 AS BIGINT) AS reasoning_tokens,
         CAST(CASE WHEN source = 'hermes' OR e % 5 = 0 THEN NULL ELSE k * 4000 END AS BIGINT) AS request_prompt_tokens,
         CASE WHEN e % 11 = 0 THEN '' ELSE concat('s', CAST(u AS STRING), '-', CAST(k % 3 AS STRING)) END AS session_id,
         concat('/logs/', source, '/f', CAST(u % 40 AS STRING), '.jsonl') AS source_file,
         CAST(e AS BIGINT) AS pos,
         CASE WHEN category = 'observer' AND source = 'codex' THEN concat('claude-mem-codex:', CAST(e AS STRING))
              WHEN category = 'observer' AND source = 'grok' THEN concat('claude-mem-grok:', CAST(e AS STRING))
              ELSE concat(source, ':', CAST(e AS STRING)) END AS dedup_key,
         e, u, k, et
  FROM c
), usage_events AS (
  SELECT ts, source, model, project, category, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens,
         cache_creation_1h_tokens, reasoning_tokens,
         input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens + cache_creation_1h_tokens
           + CASE WHEN source = 'opencode' THEN reasoning_tokens ELSE 0 END AS total_tokens,
         request_prompt_tokens, session_id, source_file, pos, dedup_key, e, u, k, et
  FROM d
)
"""
_MODEL = "CASE (e * 5 + k) % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"
#: WITH clause that makes usage_events, for each engine. e, u, k and et are the event's own numbers.
SPARK_USAGE = _USAGE.format(K="k", TS="unix_seconds(CAST(ts AS TIMESTAMP))", MODEL=_MODEL)
DUCKDB_USAGE = _USAGE.format(K="CAST(json_extract_string(props, '$.k') AS BIGINT)", TS="CAST(floor(epoch(ts)) AS BIGINT)", MODEL=_MODEL)


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than there are cores, dealt out by ``key``: row groups of a million rows make few tasks."""
    few = len(table.inputFiles()) < table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(key) if few else table


def usage_events(spark: SparkSession, sf_dir: str, keep_numbers: bool = False) -> DataFrame:
    """The ledger as the reports read it; ``keep_numbers`` leaves e, u, k and et in, for building raw inputs.

    ``k`` comes out of a generator: filters on what is made of it stay above, where pushing them down to the scan would
    parse ``props`` once for every mention of ``k``."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    events = events.select("*", F.explode(F.array(F.get_json_object("props", "$.k").cast("long"))).alias("k"))
    df = spark.sql(SPARK_USAGE.replace("FROM events", "FROM {events}") + "SELECT * FROM usage_events", events=events)
    return df if keep_numbers else df.drop("e", "u", "k", "et")


def read_tables(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A message, session, transcript-event or session-window table: Parquet (or another file format) at a path, or a
    table behind JDBC whose driver and options the caller brings."""
    reader = spark.read.options(**options)
    return reader.format("jdbc").option("dbtable", path).load() if kind == "jdbc" else reader.format(kind).load(path)
