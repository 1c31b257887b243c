"""Raw log lines and tables made of the usage events, for queries that run the readers and normalisers on text.

An event's number decides what its line looks like; the oracles say from the same numbers what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import usage_events


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events with e, u, k, et and the time as ISO text."""
    return usage_events(spark, sf_dir, True).withColumn("iso", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def once(value: Column) -> Column:
    """A value out of a generator: filters on it stay above and do not make it a second time."""
    return F.explode(F.array(value))


def line(path: Column, pos: Column, value: Column) -> list[Column]:
    return [path.alias("path"), pos.cast("long").alias("pos"), once(value).alias("value")]


def broken(value: Column) -> Column:
    """Every 13th line is cut in the middle."""
    return F.when(F.col("e") % 13 == 0, F.expr("substring(raw, 1, length(raw) - 9)")).otherwise(value)


def with_raw(df: DataFrame, value: Column, path: Column, pos: Column, extra: list[str] | None = None) -> DataFrame:
    return df.withColumn("raw", value).select(*line(path, pos, broken(F.col("raw"))), *(extra or []))


def assistant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lines: 17th ones synthetic, 19th ones without a time; cache detail none, hour only or both; every 6th
    has two iterations, every 12th of which also has an older base line in another file."""
    ev = numbered(spark, sf_dir)
    k = F.col("k")
    detail = F.when(F.col("e") % 3 == 1, F.struct(k.alias("ephemeral_1h_input_tokens"), F.lit(None).cast("long").alias("ephemeral_5m_input_tokens"))).when(
        F.col("e") % 3 == 2, F.struct((k * 2).alias("ephemeral_1h_input_tokens"), (k * 3).alias("ephemeral_5m_input_tokens")))
    usage = lambda f, d, it: F.struct((F.col("input_tokens") * f).alias("input_tokens"), F.col("output_tokens").alias("output_tokens"), (k * 5).alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), d.alias("cache_creation"), *it)
    none = F.lit(None).cast("struct<ephemeral_1h_input_tokens:bigint,ephemeral_5m_input_tokens:bigint>")
    step = lambda m, f: F.struct(m.alias("model"), *[usage(f, none, [])[c].alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")])
    iterations = F.when(F.col("e") % 6 == 0, F.array(step(F.lit(None).cast("string"), 1), step(F.lit("second"), 2)))
    cwd = F.when(F.col("e") % 10 == 0, F.lit("/x/.claude-mem/observer-sessions/y")).otherwise(F.col("project"))

    def obj(it: Column) -> Column:
        model = F.when(F.col("e") % 17 == 0, "<synthetic>").otherwise(F.col("model"))
        message = F.struct(F.concat(F.lit("m"), text("e")).alias("id"), model.alias("model"), usage(1, detail, [it.alias("iterations")]).alias("usage"))
        return F.to_json(F.struct(F.lit("assistant").alias("type"), F.when(F.col("e") % 19 != 0, F.col("iso")).alias("timestamp"), cwd.alias("cwd"), F.col("session_id").alias("sessionId"), (F.col("e") % 4 == 1).alias("isSidechain"), message.alias("message")))

    path = F.when(F.col("e") % 7 == 0, F.lit("/logs/subagents/workflows/w.jsonl")).otherwise(F.lit("/logs/a.jsonl"))
    new = with_raw(ev, obj(iterations), path, F.col("e"), ["e"])
    old = with_raw(ev.filter("e % 12 = 0"), obj(F.lit(None).cast("array<struct<model:string,input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>")), F.lit("/logs/old.jsonl"), F.col("e"), ["e"])
    return new.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))


def rollout_path(u: Column) -> Column:
    return F.concat(F.lit("/logs/rollout-2024-01-01T00-00-00-"), session_uuid(u), F.lit(".jsonl"))


def session_uuid(u: Column) -> Column:
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(text(u), 12, "0"))


COUNTS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def counter_line(iso: Column, totals: list[Column], last: list[Column] | None = None) -> Column:
    use = lambda xs: F.struct(*[x.alias(c) for x, c in zip(xs, COUNTS, strict=True)])
    info = [use(totals).alias("total_token_usage")] + ([use(last).alias("last_token_usage")] if last else [])
    return F.to_json(F.struct(F.lit("event_msg").alias("type"), iso.alias("timestamp"), F.struct(F.lit("token_count").alias("type"), F.struct(*info).alias("info")).alias("payload")))


def increments(ev: DataFrame) -> DataFrame:
    """Per user: n (place by event), own increments, and their running sums."""
    own = {"i_in": F.col("input_tokens") + 1, "i_cached": F.col("input_tokens") % 7, "i_out": F.col("output_tokens"), "i_reason": F.least("reasoning_tokens", "output_tokens")}
    own["i_total"] = own["i_in"] + own["i_out"]
    w = Window.partitionBy("u").orderBy("e")
    rows = ev.withColumns(own).withColumn("n", F.row_number().over(w))
    return rows.withColumns({f"c{c[1:]}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in own})


TOTALS = ["c_in", "c_cached", "c_out", "c_reason", "c_total"]


def counter_lines(spark: SparkSession, sf_dir: str, inherit: bool = False) -> DataFrame:
    """Counter files, one a user; every 10th snapshot stands twice, every 11th event adds a heartbeat. With ``inherit``
    all counters of a user start from a constant, told by the first row's last request."""
    rows = increments(numbered(spark, sf_dir))
    off = F.col("u") * 1000 + 500 if inherit else F.lit(0)
    totals = [F.col(c) + off for c in TOTALS]
    last = [F.col(c) for c in ("i_in", "i_cached", "i_out", "i_reason", "i_total")]
    with_last = F.when(F.col("n") == 1, counter_line(F.col("iso"), totals, last)).otherwise(counter_line(F.col("iso"), totals))
    value = with_last if inherit else counter_line(F.col("iso"), totals)
    path = rollout_path(F.col("u"))
    one = rows.select(*line(path, F.col("e") * 4, value))
    two = rows.filter("e % 10 = 0").select(*line(path, F.col("e") * 4 + 1, value))
    beat = rows.filter("e % 11 = 0").select(*line(path, F.col("e") * 4 + 2, F.lit('{"type":"event_msg","timestamp":"2024-01-01T00:00:00Z","payload":{"type":"token_count","info":null}}')))
    return one.unionByName(two).unionByName(beat)


def forked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter files where users u % 4 = 1 are forks of u - 1 if that one has at least six snapshots: their files start
    with the parent's totals 3 to 6 and go on from there."""
    rows = increments(numbered(spark, sf_dir))
    sixth = rows.filter("n = 6").select((F.col("u") + 1).alias("u"), *[F.col(c).alias(f"p{c[1:]}") for c in TOTALS])
    joined = rows.join(sixth.filter("u % 4 = 1"), "u", "left")
    base = [F.coalesce(F.col(f"p{c[1:]}"), F.lit(0)) for c in TOTALS]
    path = rollout_path(F.col("u"))
    own = joined.select(*line(path, F.col("e") * 4 + 100, counter_line(F.col("iso"), [F.col(c) + b for c, b in zip(TOTALS, base, strict=True)])))
    children = joined.filter("p_total IS NOT NULL").groupBy("u").agg(F.min("e").alias("e"))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(session_uuid(F.col("u")).alias("id"), session_uuid(F.col("u") - 1).alias("forked_from_id")).alias("payload")))
    head = children.select(*line(path, F.lit(0), meta))
    replay = rows.filter("n BETWEEN 3 AND 6").select((F.col("u") + 1).alias("u"), "n", "iso", *TOTALS).join(children.select("u"), "u")
    again = replay.select(*line(path, F.col("n"), counter_line(F.col("iso"), [F.col(c) for c in TOTALS])))
    return own.unionByName(head).unionByName(again)


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose session lines (signup), turn lines (view) and counters follow each other by event."""
    rows = increments(numbered(spark, sf_dir))
    mark = text("e")
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("sid-"), mark).alias("id"), F.concat(F.lit("/meta/"), mark).alias("cwd")).alias("payload")))
    nested = F.struct(F.struct(F.when(F.col("e") % 2 == 1, F.concat(F.lit("m-"), mark)).alias("model")).alias("settings"))
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.when(F.col("e") % 2 == 0, F.concat(F.lit("m-"), mark)).alias("model"), F.when(F.col("e") % 3 == 0, F.concat(F.lit("/turn/"), mark)).alias("cwd"), nested.alias("collaboration_mode")).alias("payload")))
    value = F.when(F.col("et") == "signup", meta).when(F.col("et") == "view", turn).otherwise(counter_line(F.col("iso"), [F.col(c) for c in TOTALS]))
    return rows.select(*line(rollout_path(F.col("u")), F.col("e"), value))


def oneshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-shot events; cached above input in every 17th, another schema version in every 19th."""
    ev = numbered(spark, sf_dir)
    cached = F.when(F.col("e") % 17 == 0, F.col("input_tokens") + 1).otherwise(F.col("input_tokens") % 5)
    usage = F.struct(F.col("input_tokens"), cached.alias("cached_input_tokens"), F.lit(3).alias("cache_write_input_tokens"), F.col("output_tokens"), F.least("reasoning_tokens", "output_tokens").alias("reasoning_output_tokens"))
    obj = F.to_json(F.struct(F.lit("claude_mem.codex_usage").alias("type"), F.when(F.col("e") % 19 == 0, 2).otherwise(1).alias("schema_version"), F.col("iso").alias("timestamp"), F.concat(F.lit("ev"), text("e")).alias("event_id"), F.col("model"), F.col("project"), F.col("session_id"), usage.alias("usage")))
    return with_raw(ev, obj, F.lit("/spool/usage.jsonl"), F.col("e"))


def inference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of many sessions: model changes (view), session starts (signup) and inferences in order of events."""
    ev = numbered(spark, sf_dir)
    mark = text("e")
    ctx = F.when(F.col("et") == "view", F.struct(F.concat(F.lit("m-"), mark).alias("model"), F.lit(None).cast("string").alias("cwd"), *[F.lit(None).cast("long").alias(c) for c in ("loop_index", "prompt_tokens", "cached_prompt_tokens", "completion_tokens", "reasoning_tokens")])).when(
        F.col("et") == "signup", F.struct(F.lit(None).cast("string").alias("model"), F.concat(F.lit("/w/"), mark).alias("cwd"), *[F.lit(None).cast("long").alias(c) for c in ("loop_index", "prompt_tokens", "cached_prompt_tokens", "completion_tokens", "reasoning_tokens")])
    ).otherwise(F.struct(
        F.when(F.col("e") % 10 == 0, F.lit("own")).alias("model"), F.lit(None).cast("string").alias("cwd"), (F.col("e") % 3).alias("loop_index"), F.col("input_tokens").alias("prompt_tokens"),
        F.col("cache_read_tokens").alias("cached_prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), F.col("reasoning_tokens").alias("reasoning_tokens")))
    msg = F.when(F.col("et") == "view", "model changed").when(F.col("et") == "signup", "session created").otherwise("shell.turn.inference_done")
    obj = F.to_json(F.struct(F.col("iso").alias("ts"), F.concat(F.lit("s"), text("u")).alias("sid"), msg.alias("msg"), ctx.alias("ctx")))
    return ev.select(*line(F.lit("/logs/unified.jsonl"), F.col("e"), obj))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs: aborted in every 11th, cache writes in every 2nd, four kinds of session keys."""
    ev = numbered(spark, sf_dir)
    key = F.when(F.col("e") % 4 == 0, F.lit("agent:main:chat:x")).when(F.col("e") % 4 == 1, F.lit("agent:bot7:main")).when(F.col("e") % 4 == 2, F.lit("chan:direct"))
    usage = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cacheRead"), (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")).alias("total"))
    cache = F.when(F.col("e") % 2 == 0, F.struct(F.struct(F.col("k").alias("cacheWrite")).alias("lastCallUsage")))
    data = F.struct(usage.alias("usage"), cache.alias("promptCache"), (F.col("e") % 11 == 0).alias("aborted"))
    obj = F.to_json(F.struct(F.lit("model.completed").alias("type"), F.col("iso").alias("ts"), F.concat(F.lit("r"), text("u")).alias("runId"), F.col("e").alias("seq"), F.col("session_id").alias("sessionId"), F.col("model").alias("modelId"), key.alias("sessionKey"), data.alias("data")))
    return with_raw(ev, obj, F.lit("/logs/t.trajectory.jsonl"), F.col("e"))


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs, one a user, with ``flag`` 1 on the snapshot after every 8th message: the sums so far, and the
    total of the message before it."""
    ev = numbered(spark, sf_dir)
    w = Window.partitionBy("u").orderBy("e")
    rows = ev.withColumn("n", F.row_number().over(w))
    parts = {"input": "input_tokens", "output": "output_tokens", "cacheRead": "cache_read_tokens", "cacheWrite": "k"}
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("k") + 1
    run = rows.withColumns({f"sum_{a}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for a, c in parts.items()} | {"t": total})

    def message(mark: str, values: dict[str, str]) -> Column:
        usage = F.struct(*[F.col(c).alias(a) for a, c in values.items()], F.col("t").alias("totalTokens"))
        body = F.struct(F.lit("assistant").alias("role"), F.col("model"), (F.col("ts") * 1000).alias("timestamp"), usage.alias("usage"))
        return F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit(mark), text("e")).alias("id"), body.alias("message")))

    path = F.concat(F.lit("/logs/v3/"), text("u"), F.lit(".jsonl"))
    own = run.select(*line(path, F.col("e") * 2 + 2, message("m", parts)), "u", F.lit(0).alias("flag"))
    snap = run.filter("n % 8 = 0").select(*line(path, F.col("e") * 2 + 3, message("x", {a: f"sum_{a}" for a in parts})), "u", F.lit(1).alias("flag"))
    head = ev.select("u").distinct().select(*line(path, F.lit(0), F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("s"), text("u")).alias("id"), F.concat(F.lit("/c/"), text("u")).alias("cwd")))), "u", F.lit(0).alias("flag"))
    return own.unionByName(snap).unionByName(head)


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows: other roles in every 5th, placeholders (all zero) in every 97th from number 97 on."""
    ev = numbered(spark, sf_dir)
    zero = (F.col("e") % 97 == 0) & (F.col("e") > 0)
    v = lambda c: F.when(zero, 0).otherwise(F.col(c))
    tokens = F.struct(v("input_tokens").alias("input"), v("output_tokens").alias("output"), v("reasoning_tokens").alias("reasoning"), F.when(F.col("e") % 6 == 0, v("total_tokens") + F.when(zero, 0).otherwise(1)).alias("total"), F.struct(v("cache_read_tokens").alias("read"), v("k").alias("write")).alias("cache"))
    data = F.to_json(F.struct(F.when(F.col("e") % 5 == 0, "user").otherwise("assistant").alias("role"), F.col("model").alias("modelID"), F.struct(F.col("project").alias("cwd")).alias("path"), tokens.alias("tokens")))
    return ev.select(F.concat(F.lit("g"), text("e")).alias("id"), "session_id", (F.col("ts") * 1000 + F.col("e") % 1000).alias("time_created"), once(data).alias("data"))


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = numbered(spark, sf_dir)
    return ev.select(F.concat(F.lit("h"), text("e")).alias("id"), "model", F.when(F.col("e") % 5 == 0, "").otherwise(F.col("project")).alias("cwd"), F.when(F.col("e") % 13 == 0, 0.0).otherwise(F.col("ts") + 0.5).alias("started_at"),
                     F.when(F.col("e") % 3 == 0, "p").alias("parent_session_id"), "input_tokens", "output_tokens", "cache_read_tokens", F.col("k").alias("cache_write_tokens"), "reasoning_tokens")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the usage CSV as text: hourly times, so that equal rows occur; 13th ones with a comma in a number."""
    ev = numbered(spark, sf_dir)
    hour = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / 86400) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.when(F.col("e") % 13 == 0, "1,234").otherwise(text(F.col("k") % 4))
    return ev.select(F.col("e").alias("pos"), hour.alias("Date"), F.concat(F.lit("c"), text(F.col("u") % 3)).alias("Model"), number.alias("Input (w/o Cache Write)"), F.when(F.col("e") % 2 == 0, "").otherwise("7").alias("Input (w/ Cache Write)"), F.lit("5").alias("Cache Read"), text(F.col("k") % 3).alias("Output Tokens"))
