"""OTLP/JSON traces and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import nz
from ..functions.text import error_preview, mcp_server, stable_run_id
from .common import PREVIEW, Loaded, loaded, span_between
from .trace_json import KNOWN_RE, lifted, plain_keys

_ANY = "STRUCT<stringValue:STRING,boolValue:BOOLEAN,intValue:STRING,doubleValue:DOUBLE,arrayValue:STRUCT<values:ARRAY<STRUCT<stringValue:STRING,intValue:STRING>>>,kvlistValue:STRING>"
_ATTRS = f"ARRAY<STRUCT<key:STRING,value:{_ANY}>>"
_SPAN = f"STRUCT<traceId:STRING,spanId:STRING,parentSpanId:STRING,name:STRING,startTimeUnixNano:STRING,endTimeUnixNano:STRING,attributes:{_ATTRS},status:STRUCT<code:STRING,message:STRING>>"
_SCOPE = f"ARRAY<STRUCT<spans:ARRAY<{_SPAN}>>>"
_POINTS = f"STRUCT<dataPoints:ARRAY<STRUCT<attributes:{_ATTRS},asDouble:DOUBLE,asInt:STRING,intValue:STRING>>>"
_METRICS = f"ARRAY<STRUCT<metrics:ARRAY<STRUCT<name:STRING,sum:{_POINTS}>>>>"
OTLP_JSON = (f"resourceSpans ARRAY<STRUCT<resource:STRUCT<attributes:{_ATTRS}>,scopeSpans:{_SCOPE},instrumentationLibrarySpans:{_SCOPE}>>, "
             f"resourceMetrics ARRAY<STRUCT<scopeMetrics:{_METRICS},instrumentationLibraryMetrics:{_METRICS}>>")

# Span names of the known emitters -> kind; other names stay ``other``.
TURN_NAMES = ["claude_code.interaction", "opencode.session"]
CALL_NAMES = ["claude_code.llm_request", "opencode.llm"]
# Branch keys in order, with the key that says whether the ref is a tag.
BRANCH_KEYS = [("vcs.ref.head.name", "vcs.ref.head.type"), ("vcs.repository.ref.name", "vcs.repository.ref.type"), ("git.branch", None)]


def _docs(spark: SparkSession, path: str, ndjson: bool | None) -> DataFrame:
    """Documents with ``file`` and ``broken`` (the text that is no JSON). ``ndjson`` None: a file whose first line is an object of its own is read
    line by line, the others whole. The names of the latter come to the driver, which lists the folder's files in any case."""
    def read(paths: list[str] | str, whole: bool) -> DataFrame:
        d = spark.read.option("multiLine", str(whole).lower()).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "broken")
        d = d.schema(OTLP_JSON + ", broken STRING").json(paths)
        return d.select("*", F.col("_metadata.file_path").alias("file"))

    if ndjson is not None:
        return read(path, not ndjson)
    text = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")
    head = text.filter("block = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "mid").alias("line"))
    object_line = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    whole = [r["file"] for r in head.filter(~object_line).select("file").collect()]
    if not whole:
        return read(path, False)
    names = spark.createDataFrame([(f,) for f in whole], "file string")
    return read(path, False).join(names, "file", "left_anti").unionByName(read(whole, True))


def _map(attrs: Column) -> Column:
    """Attribute list to a map of (s, n, b, a) by type; the last value of a repeated key wins."""
    a = F.filter(F.coalesce(attrs, F.array()), lambda x: x["key"].isNotNull())
    last = F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), F.struct(
        x["value"]["stringValue"].alias("s"), F.coalesce(x["value"]["intValue"].try_cast("double"), x["value"]["doubleValue"]).alias("n"),
        x["value"]["boolValue"].alias("b"), F.transform(x["value"]["arrayValue"]["values"], lambda v: F.coalesce(v["stringValue"], v["intValue"])).alias("a")).alias("value"))))


def _s(key: str, m: str = "attrs") -> Column:
    return F.try_element_at(m, F.lit(key))["s"]


def _n(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))["n"]


def _int(*keys: str) -> Column:
    """First non-zero of the keys, as a non-negative rounded integer."""
    vals = [F.nullif(F.greatest(F.lit(0), F.floor(_n(k) + 0.5)).cast("bigint"), F.lit(0).cast("bigint")) for k in keys]
    return F.coalesce(*vals, F.lit(0).cast("bigint"))


def _ms(nano: str) -> Column:
    n = F.when(F.col(nano).rlike(r"^\d+$"), F.col(nano).cast("decimal(20,0)"))
    return F.floor(n / F.lit(1_000_000)).cast("bigint")


def otlp_kind(genai: bool = False) -> Column:
    """Kind by span name; ``genai`` also maps the public operation names."""
    tool = _s("tool_name")
    k = (F.when(F.col("name").isin(TURN_NAMES), "turn").when(F.col("name").isin(CALL_NAMES), "llm_call")
         .when((F.col("name") == "claude_code.tool") & F.coalesce(tool.startswith("mcp__"), F.lit(False)), "mcp_call")
         .when(F.col("name") == "claude_code.tool", "tool_call").when(F.col("name") == "claude_code.hook", "hook")
         .when(F.col("name").startswith("claude_code.tool_") | F.col("name").startswith("opencode.tool."), "tool_call"))
    if genai:
        op = _s("gen_ai.operation.name")
        k = (k.when(op.isin("chat", "text_completion", "generate_content"), "llm_call").when(op == "execute_tool", "tool_call")
             .when(op.isin("invoke_agent", "create_agent"), "turn"))
    return k.otherwise("other")


def branch_in(m: str) -> Column:
    opts = []
    for key, typ in BRANCH_KEYS:
        v = F.nullif(_s(key, m), F.lit(""))
        opts.append(v if typ is None else F.when(F.coalesce(_s(typ, m), F.lit("")) != "tag", v))
    return F.coalesce(*opts)


def branch_of(flat: DataFrame) -> DataFrame:
    """Branch per group: the first resource naming one, else the earliest-starting span naming one."""
    pos = F.struct("file", "doc_pos")
    start = F.struct(F.col("start_ms").isNull(), "start_ms", "file", "doc_pos")
    res, own = branch_in("resource"), branch_in("attrs")
    return flat.groupBy("group_key").agg(F.min_by(res, F.when(res.isNotNull(), pos)).alias("r"),
                                         F.min_by(own, F.when(own.isNotNull(), start)).alias("s")).select(
        "group_key", F.coalesce("r", "s").alias("git_branch"))


def flatten_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per span with its attribute maps and session group; spans without an id become warnings."""
    rs = docs.select("file", F.posexplode("resourceSpans").alias("p0", "rs"))
    ss = rs.select("file", "p0", F.col("rs.resource.attributes").alias("ra"),
                   F.posexplode(F.coalesce("rs.scopeSpans", "rs.instrumentationLibrarySpans")).alias("p1", "ss"))
    sp = ss.select("file", "ra", "p0", "p1", F.posexplode("ss.spans").alias("p2", "s"))
    bad = sp.filter("s.spanId is null").groupBy("file").agg(F.count("*").alias("n")).select(
        F.lit(None).cast("string").alias("run_id"), F.concat("n", F.lit(" span(s) without spanId skipped")).alias("message"), "file")
    f = sp.filter("s.spanId is not null").select(
        "file", F.struct("p0", "p1", "p2").alias("doc_pos"), _map(F.col("ra")).alias("resource"), _map(F.col("s.attributes")).alias("attrs"), "s.*")
    f = f.withColumns({"group_key": F.coalesce(_s("session.id"), F.concat(F.lit("trace:"), F.coalesce("traceId", F.lit("unknown")))),
                       "name": F.coalesce("name", F.lit("unknown")), "start_ms": _ms("startTimeUnixNano"), "end_ms": _ms("endTimeUnixNano")})
    if "broken" in docs.columns:
        broken = docs.filter("broken is not null and resourceSpans is null and resourceMetrics is null").groupBy("file").agg(F.count("*").alias("n"))
        bad = bad.unionByName(broken.select(F.lit(None).cast("string").alias("run_id"), F.concat("n", F.lit(" unreadable document(s) skipped")).alias("message"), "file"))
    return f, bad


def otlp_to_span(flat: DataFrame, genai: bool = False, redact: bool = False) -> DataFrame:
    """Contract columns of every span."""
    f = flat.withColumn("kind", otlp_kind(genai))
    call, tool = F.col("kind") == "llm_call", F.col("kind").isin("tool_call", "mcp_call")
    status = F.when((F.col("status.code") == "2") | (F.try_element_at("attrs", F.lit("success"))["b"] == F.lit(False)), "error").otherwise("ok")
    cost = F.coalesce(_n("gen_ai.usage.cost"), _n("llm.cost.total"))
    tool_name = F.coalesce(_s("tool_name"), _s("gen_ai.tool.name") if genai else F.lit(None), F.lit("unknown"))
    keep = F.map_filter("attrs", lambda k, v: k.startswith("gen_ai.") | k.rlike(KNOWN_RE))
    text = F.transform_values(keep, lambda k, v: F.coalesce(v["s"], F.when(v["n"] == F.floor(v["n"]), v["n"].cast("bigint").cast("string"))
                                                            .otherwise(v["n"].cast("string")), v["b"].cast("string"), F.to_json(v["a"])))
    start = F.coalesce("start_ms", F.lit(0).cast("bigint"))
    preview = F.when(tool & (status == "error") & (F.coalesce("status.message", F.lit("")) != ""), error_preview("status.message"))
    prompt = F.when(F.col("kind") == "turn", F.substring(_s("user_prompt"), 1, PREVIEW))
    hide = F.lit(None).cast("string")
    out = f.select(
        stable_run_id(F.col("group_key")).alias("run_id"), F.col("spanId").alias("span_id"), F.coalesce("parentSpanId", "group_key").alias("parent_id"),
        "kind", "name", status.alias("status"), start.alias("start_ms"), F.col("end_ms"), span_between(start, F.col("end_ms")).alias("duration_ms"),
        F.when(call, F.coalesce(_s("gen_ai.provider.name"), _s("gen_ai.system"), F.lit("unknown"))).alias("provider"),
        F.when(call, F.coalesce(_s("gen_ai.request.model"), _s("model"), F.lit("unknown"))).alias("model"),
        F.when(call, _int("gen_ai.usage.input_tokens", "input_tokens", "llm.token_count.prompt")).alias("tok_input"),
        F.when(call, _int("gen_ai.usage.output_tokens", "output_tokens", "llm.token_count.completion")).alias("tok_output"),
        F.when(call, _int("cache_read_tokens", "llm.token_count.prompt_details.cache_read")).alias("tok_cache_read"),
        F.when(call, _int("cache_creation_tokens", "llm.token_count.prompt_details.cache_write")).alias("tok_cache_write"),
        F.when(call, F.floor(cost * 1e6 + 0.5).cast("bigint")).alias("cost_micro"),
        F.when(call, F.when(cost.isNotNull(), "reported").otherwise("unknown")).alias("cost_source"),
        F.when(call, F.coalesce(_s("stop_reason"), F.try_element_at(F.try_element_at("attrs", F.lit("gen_ai.response.finish_reasons"))["a"], F.lit(1)))).alias("stop_reason"),
        F.when(tool, tool_name).alias("tool_name"), F.when(tool, mcp_server(tool_name)).alias("mcp_server"),
        (hide if redact else prompt).alias("prompt_preview"), (hide if redact else preview).alias("output_preview"),
        (F.lit(redact) & (F.col("kind").isin("turn") | (tool & (status == "error")))).alias("content_redacted"),
        plain_keys(text).alias("attributes"), F.col("file").alias("prov_file"), F.col("spanId").alias("prov_record"), "group_key", "doc_pos")
    return lifted(out)


def otlp_session_root(flat: DataFrame) -> DataFrame:
    """Synthetic session span over the spans of a group."""
    g = flat.groupBy("group_key").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("file").alias("prov_file"))
    s = F.coalesce("start_ms", F.lit(0).cast("bigint"))
    return g.select(stable_run_id(F.col("group_key")).alias("run_id"), F.col("group_key").alias("span_id"), F.lit("session").alias("kind"),
                    F.lit("session").alias("name"), F.lit("ok").alias("status"), s.alias("start_ms"), "end_ms",
                    span_between(s, F.col("end_ms")).alias("duration_ms"), F.col("group_key").alias("agent_session"), "prov_file",
                    F.col("group_key").alias("prov_record"), "group_key")


def read_otlp_metrics(docs: DataFrame) -> DataFrame:
    """Token and cost sums per session (integer points count, whichever field carries them)."""
    rm = docs.select(F.explode("resourceMetrics").alias("rm"))
    sm = rm.select(F.explode(F.coalesce("rm.scopeMetrics", "rm.instrumentationLibraryMetrics")).alias("sm"))
    p = sm.select(F.explode("sm.metrics").alias("m")).select("m.name", F.explode("m.sum.dataPoints").alias("p"))
    p = p.select("name", _map(F.col("p.attributes")).alias("attrs"), F.coalesce(
        "p.asDouble", F.col("p.asInt").try_cast("double"), F.col("p.intValue").try_cast("double"), F.lit(0.0)).alias("v"))
    p = p.select("name", _s("session.id").alias("group_key"), _s("type").alias("type"), "v").filter("group_key is not null")
    tok = F.col("name") == "opencode.token.usage"
    kinds = {"input": "m_input", "output": "m_output", "cacheRead": "m_read", "cacheCreation": "m_write", "reasoning": "m_reasoning"}
    return p.groupBy("group_key").agg(
        *[nz(F.sum(F.when(tok & (F.col("type") == k), F.col("v")))).cast("bigint").alias(c) for k, c in kinds.items()],
        F.floor(nz(F.sum(F.when(F.col("name") == "opencode.cost.usage", F.col("v")))) * 1e6 + 0.5).cast("bigint").alias("m_cost"))


def inject_metrics(spans: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add session sums to the first model call, only where it has no tokens / no cost."""
    first = spans.filter("kind = 'llm_call'").groupBy("group_key").agg(F.min_by("span_id", F.struct("prov_file", "doc_pos")).alias("first_call"))
    j = spans.join(metrics.join(first, "group_key"), "group_key", "left")
    hit = F.coalesce(F.col("span_id") == F.col("first_call"), F.lit(False))
    fill = hit & (nz("tok_input") == 0) & (nz("tok_output") == 0)
    pay = hit & (F.col("m_cost") > 0) & (nz("cost_micro") == 0)
    add = lambda c, m: F.when(fill, nz(c) + F.col(m)).otherwise(F.col(c))
    j = j.withColumns({
        "tok_input": add("tok_input", "m_input"), "tok_output": add("tok_output", "m_output"), "tok_cache_read": add("tok_cache_read", "m_read"),
        "tok_cache_write": add("tok_cache_write", "m_write"), "tok_reasoning": F.when(fill & (F.col("m_reasoning") > 0), F.col("m_reasoning")),
        "cost_micro": F.when(pay, F.col("m_cost")).otherwise(F.col("cost_micro")), "cost_source": F.when(pay, "reported").otherwise(F.col("cost_source"))})
    return j.drop("first_call", *[c for c in metrics.columns if c != "group_key"])


class OtlpSource:
    name = "otlp"

    def read(self, spark: SparkSession, path: str, ndjson: bool | None = None, genai: bool = False, redact: bool = False) -> Loaded:
        """Traces (and metrics beside them) of a folder; a session may span several files."""
        docs = _docs(spark, path, ndjson)
        flat, bad = flatten_spans(docs)
        body = inject_metrics(otlp_to_span(flat, genai, redact).withColumn("tok_reasoning", F.lit(None).cast("bigint")), read_otlp_metrics(docs))
        # the same span delivered twice keeps its first copy
        w = Window.partitionBy("run_id", "span_id").orderBy("prov_file", "doc_pos")
        body = body.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "doc_pos")
        root = otlp_session_root(flat)
        spans = body.unionByName(root, allowMissingColumns=True)
        runs = (root.join(branch_of(flat), "group_key", "left")
                .join(flat.groupBy("group_key").agg(F.array_sort(F.collect_set("file")).alias("files")), "group_key"))
        runs = runs.select("run_id", F.lit("otlp").alias("source"), F.lit("otlp-json").alias("format"), "git_branch", "start_ms", "end_ms",
                           "duration_ms", "files")
        return loaded(runs, spans, bad)


def read_otlp_traces(spark: SparkSession, path: str, **options) -> Loaded:
    return OtlpSource().read(spark, path, **options)
