"""Reader queries: log lines are written from the events table into the shared folder, read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import retry_loop
from ..session import scratch
from ..sources.otlp import OtlpSource
from ..sources.positions import line_blocks, records_at
from ..sources.session_jsonl import SessionJsonlSource, dedupe_records, read_records
from ..streaming.live import tailed_records
from .catalog import register
from .incremental import Store
from .views import pricing


def _written(spark: SparkSession, sf: str, *lines: Column) -> str:
    """The events as JSON lines; returns the folder."""
    path = scratch(spark, "logs")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    e.select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return path


def _record(uuid: Column, kind: str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), uuid.alias("uuid"), F.col("at").alias("timestamp")))


@register("s1_read_records", """select 'u' || event_id as uuid, 'user' as type, epoch_ms(date_trunc('milliseconds', ts)) as ms from events
  union all select 'a' || event_id, 'assistant', epoch_ms(date_trunc('milliseconds', ts)) from events""")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a folder of transcripts, once; lines in a file are numbered without gaps (checked here)."""
    u, a = F.concat(F.lit("u"), "event_id"), F.concat(F.lit("a"), "event_id")
    rec, _ = read_records(spark, _written(spark, sf, _record(u, "user"), _record(a, "assistant")), glob="*.txt")
    last = rec.groupBy("file").agg((F.max("line") == F.count("*")).alias("gapless"))
    return rec.join(last.filter("gapless"), "file").select("uuid", "type", "ms")


@register("s2_dedupe_records", "select 'u' || event_id as uuid, epoch_ms(date_trunc('milliseconds', ts)) as ms from events")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """A record written twice in a transcript counts once."""
    u = F.concat(F.lit("u"), "event_id")
    rec, _ = read_records(spark, _written(spark, sf, _record(u, "user"), _record(u, "user")), glob="*.txt")
    return dedupe_records(rec).select("uuid", "ms")


def _otlp(span: Column, start: Column) -> Column:
    one = F.struct(F.lit("t").alias("traceId"), span.alias("spanId"), F.lit("claude_code.llm_request").alias("name"), start.alias("startTimeUnixNano"), start.alias("endTimeUnixNano"),
                   F.array(F.struct(F.lit("session.id").alias("key"), F.struct(F.col("user_id").cast("string").alias("stringValue")).alias("value"))).alias("attributes"))
    return F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(one).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))


@register("s21_otlp_spans", "select event_id::varchar as span_id, 'llm_call' as kind, epoch_ms(date_trunc('milliseconds', ts)) as start_ms from events")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    """Newline-delimited OTLP documents, found to be such by the reader itself."""
    nano = F.concat(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("000000"))
    path = _written(spark, sf, _otlp(F.col("event_id").cast("string"), nano))
    return OtlpSource().read(spark, path).spans.filter("kind = 'llm_call'").select("span_id", "kind", "start_ms")


@register("s31_quarantine", """select 'unparseable JSONL line' as message, count(*) as n from events""")
def s31(spark: SparkSession, sf: str) -> DataFrame:
    """Broken lines become warnings, one each."""
    bad = F.concat(F.lit('{"type": "user", "uuid": '), F.col("event_id").cast("string"))
    _, warnings = read_records(spark, _written(spark, sf, _record(F.col("event_id").cast("string"), "user"), bad), glob="*.txt")
    return warnings.groupBy("message").agg(F.count("*").alias("n"))


@register("s29_incremental_load", """select 'm' || event_id as span_id, epoch_ms(date_trunc('milliseconds', ts)) as start_ms, 30 as tokens from events""")
def s29(spark: SparkSession, sf: str) -> DataFrame:
    """All events as model calls, loaded in two refreshes: the second reads only the transcripts that came with it."""
    store = Store(spark, scratch(spark, "store"))
    usage = F.struct(F.lit(10).alias("input_tokens"), F.lit(20).alias("output_tokens"))
    message = F.struct(F.concat(F.lit("m"), "event_id").alias("id"), F.lit("claude-sonnet-4-5").alias("model"), usage.alias("usage"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("u"), "event_id").alias("uuid"), F.col("at").alias("timestamp"), message.alias("message")))
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    logs, card = scratch(spark, "logs"), pricing(spark)
    for part in (F.col("event_type") != "error", F.col("event_type") == "error"):
        e.filter(part).select(line.alias("value")).write.mode("append").text(logs)
        store.refresh(SessionJsonlSource(), logs, card, rule_list=[retry_loop], listing="*.txt", glob="*.txt")
    return store.table("spans").filter("kind = 'llm_call'").select("span_id", "start_ms", (F.col("tok_input") + F.col("tok_output")).alias("tokens"))


@register("st1_tailed_records", """select 'u' || event_id as uuid, 'user' as type, epoch_ms(date_trunc('milliseconds', ts)) as ms from events
  union all select 'a' || event_id, 'assistant', epoch_ms(date_trunc('milliseconds', ts)) from events""")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines followed as a stream of byte ranges, in steps of at most 8 MB."""
    u, a = F.concat(F.lit("u"), "event_id"), F.concat(F.lit("a"), "event_id")
    at = scratch(spark, "tail")
    lines = tailed_records(spark, _written(spark, sf, _record(u, "user"), _record(a, "assistant")), f"{at}/ledger", suffix=".txt", max_bytes=8 << 20, split_bytes=1 << 20)
    q = (lines.select("uuid", "type", F.unix_millis("event_ts").alias("ms")).writeStream.format("parquet").option("path", f"{at}/out")
         .option("checkpointLocation", f"{at}/checkpoint").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("uuid string, type string, ms bigint").parquet(f"{at}/out")


@register("s33_records_by_position", """select 'u' || event_id as uuid, '{"type":"user","uuid":"u' || event_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '"}' as text from events""")
def s33(spark: SparkSession, sf: str) -> DataFrame:
    """The log line behind every record, by seeking to its (file, line)."""
    path = _written(spark, sf, _record(F.concat(F.lit("u"), "event_id"), "user"))
    rec, _ = read_records(spark, path, glob="*.txt")
    at = rec.select("file", "line", "uuid")
    return at.join(records_at(at, line_blocks(spark, path, "*.txt")), ["file", "line"]).select("uuid", "text")
