"""Column expressions shared by readers, normalisers and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local days are those of this zone; text columns are cut at so many characters.
LOCAL_ZONE = "Asia/Shanghai"
TEXT_LIMIT = 512
MAX_LONG = (1 << 63) - 1
MAX_TS = 253402300799 - 28800
OBSERVER_MARKER = "/.claude-mem/observer-sessions"
SUBAGENT_MARKER = "/subagents/workflows/"
#: Region and provider prefixes that may be stacked in front of a model name.
MODEL_PREFIX = r"^(?:(?:us|eu|apac)\.|anthropic\.|openai\.|cursor[.-])+"
PLACEHOLDERS = ["unknown", "<unknown>", "<synthetic>", "n/a", "none"]


def whole_number(text: Column) -> Column:
    """Falsy text (null, empty, 0, false) as 0, digits with a sign as their value, anything else null.

    JSON strings and numbers look alike here, so a fraction is refused in both forms.
    """
    t = F.trim(text)
    empty = text.isNull() | t.isin("", "null", "false")
    return F.when(empty, F.lit(0).cast("long")).when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def epoch_of(text: Column) -> Column:
    """ISO time as epoch seconds, without a zone in UTC; 0 if absent or unreadable. A bare year is not a time."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(F.when(ok, F.unix_seconds(text.try_cast("timestamp"))), F.lit(0)).cast("long")


def local_day(ts: Column) -> Column:
    """Local calendar day of epoch seconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), LOCAL_ZONE))


def cut(text: Column) -> Column:
    return F.substring(text, 1, TEXT_LIMIT)


def project_name(path: Column) -> Column:
    """Last part of a project path; an empty one is (unknown)."""
    last = F.substring_index(F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", ""), "/", -1)
    return F.when(F.trim(last) == "", F.lit("(unknown)")).otherwise(last)


def session_key_project(key: Column, default: Column) -> Column:
    """Project of a session key: of ``agent:<id>:<x>…`` the id unless it is main, else x; of other keys the first part."""
    parts = F.split(F.coalesce(key, F.lit("")), ":")
    part = lambda n: F.nullif(F.get(parts, n), F.lit(""))
    is_agent = (F.size(parts) >= 3) & (F.get(parts, 0) == "agent")
    agent = F.when(F.coalesce(part(1), F.lit("main")) != "main", part(1)).otherwise(part(2))
    return F.coalesce(F.when(is_agent, agent).otherwise(part(0)), default)


def category_of(cwd: Column, sidechain: Column, path: Column) -> Column:
    """observer if the folder holds the observer marker, subagent for side chains and workflow files, else main."""
    side = F.coalesce(sidechain, F.lit(False)) | F.coalesce(path, F.lit("")).contains(SUBAGENT_MARKER)
    return F.when(F.coalesce(cwd, F.lit("")).contains(OBSERVER_MARKER), "observer").when(side, "subagent").otherwise("main")


def split_cache_writes(total: Column, five: Column, hour: Column) -> tuple[Column, Column]:
    """5-minute and 1-hour cache writes, to be added up. No detail: all are 5-minute ones; only the hour: the rest is."""
    w5 = F.when((five <= 0) & (hour <= 0), total).when(five <= 0, F.greatest(F.lit(0), total - hour)).otherwise(five)
    return w5, F.greatest(F.lit(0), hour)


def clean_model(model: Column) -> Column:
    """Trimmed, lower case, without provider prefixes, path parts and context-window suffixes."""
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    m = F.regexp_replace(m, MODEL_PREFIX, "")
    m = F.regexp_replace(F.substring_index(m, "/", -1), MODEL_PREFIX, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"\[1m\]$", ""), "-1m$", ""), ":1m$", "")


def is_placeholder(model: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return (m == "") | m.isin(*PLACEHOLDERS)


def guarded(text: Column) -> Column:
    """Text for a spreadsheet: what would start a formula there gets a quote in front."""
    return F.when(text.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
