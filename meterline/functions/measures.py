"""The ledger's schema and the measures that reports derive from a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import MAX_LONG, MAX_TS, cut, local_day, project_name

#: Sources and categories of a record.
SOURCES = ["claude", "codex", "opencode", "openclaw", "hermes", "grok", "cursor"]
CATEGORIES = ["main", "subagent", "observer"]
#: Collectors whose observer records are shown as a source of their own, by physical source and key prefix.
COLLECTOR_PREFIX = {"codex": "claude-mem-codex:", "grok": "claude-mem-grok:"}
COLLECTOR, COLLECTOR_SOURCE = "claude-mem", "claude_mem"
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_1h_tokens", "reasoning_tokens", "total_tokens"]
FIELDS = [
    ("ts", "long"), ("source", "string"), ("model", "string"), ("project", "string"), ("category", "string"),
    *[(c, "long") for c in TOKENS], ("request_prompt_tokens", "long"), ("session_id", "string"),
    ("source_file", "string"), ("pos", "long"), ("dedup_key", "string"),
]
RECORD = T.StructType([T.StructField(n, T.LongType() if t == "long" else T.StringType(), n == "request_prompt_tokens") for n, t in FIELDS])
COLUMNS = [n for n, _ in FIELDS]


def as_records(df: DataFrame, **values: Column | str | int | None) -> DataFrame:
    """The record columns in order: given values, else columns of the same name, else zero or empty."""
    present, out = set(df.columns), []
    for name, kind in FIELDS:
        if name in values:
            v = values[name]
            c = v if isinstance(v, Column) else F.lit(v)
        elif name in present:
            c = F.col(name)
        else:
            c = F.lit(None if name == "request_prompt_tokens" else 0 if kind == "long" else "")
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def validity() -> Column:
    """Whether a record is within its enums and ranges and has no missing part."""
    ok = F.col("ts").between(1, MAX_TS) & F.col("source").isin(*SOURCES) & F.col("category").isin(*CATEGORIES)
    for c in [*TOKENS, "pos"]:
        ok = ok & F.col(c).isNotNull() & F.col(c).between(0, MAX_LONG)
    ok = ok & (F.col("request_prompt_tokens").isNull() | (F.col("request_prompt_tokens") >= 0))
    for c in ("model", "project", "session_id", "source_file", "dedup_key"):
        ok = ok & F.col(c).isNotNull()
    return F.coalesce(ok & (F.col("dedup_key") != ""), F.lit(False))


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, their texts cut to the limit (never the key), and the rejected rows as they came."""
    good = df.filter(validity()).withColumns({c: cut(F.col(c)) for c in ("model", "project", "session_id")})
    return good, df.filter(~validity())


def is_collector() -> Column:
    hit = F.lit(False)
    for source, prefix in COLLECTOR_PREFIX.items():
        hit = hit | ((F.col("source") == source) & F.col("dedup_key").startswith(prefix))
    return (F.col("category") == "observer") & hit


def with_derived(df: DataFrame) -> DataFrame:
    """Adds date_local, project_name, output_billed, total_norm, display_source and collector."""
    billed = F.col("output_tokens") + F.when(F.col("source") == "opencode", F.col("reasoning_tokens")).otherwise(0)
    read = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens") + F.col("cache_creation_1h_tokens")
    mem = is_collector()
    return df.withColumns({
        "date_local": local_day(F.col("ts")),
        "project_name": project_name(F.col("project")),
        "output_billed": billed,
        "total_norm": read + billed,
        "display_source": F.when(mem, F.lit(COLLECTOR_SOURCE)).otherwise(F.col("source")),
        "collector": F.when(mem, F.lit(COLLECTOR)),
    })
