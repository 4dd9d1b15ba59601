"""Error triage: classes, reactions, recoveries, clusters and the run verdict."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import closed_duration, closed_end, nz
from ..skew import CHUNK, chunk_edges, rechunk, scan
from .rules import Trace, evidence_rows

# Ordered patterns, first match decides.
MODEL_PATTERNS = [
    ("model-limit", r"hit your (?:session |weekly |daily )?limit|reached your .{0,40}limit|usage limit|rate[ _-]?limit|\b429\b|quota"),
    ("model-auth", r"not logged in|/login\b|unauthorized|\b401\b|invalid (?:api )?key|authentication"),
    ("model-server", r"\b(?:500|502|503|504|529)\b|internal server error|overloaded|server-side|timed out|timeout|econnreset|socket hang up|network error"),
    ("model-content", r"safeguards|flagged|could not be processed|content filter|usage policy|aup\b"),
]
TOOL_PATTERNS = [
    ("edit-anchor-miss", r"String to replace not found|Could not find oldString|Failed to find expected lines|matches of the string to replace|apply_patch verification failed|old_string.*not found|has been modified since read"),
    ("read-before-write", r"has not been read yet"),
    ("input-validation", r"InputValidationError|Input validation error|could not be parsed as JSON|Invalid arguments for tool|Invalid workflow script|control characters|-32602|required parameter .* is missing|No changes to make|at most \d+ actions"),
    ("tool-misuse", r"requires a prior computer|No site is open|No preview is open|exceeds maximum allowed tokens|Cannot read binary file|no screenshot dimensions|Unknown action|not a valid action|Use offset and limit|No task found|No-op:|no read_page tree|outside the coordinate frame|takes a process id|^(?:Server|Preview) not found"),
    ("tool-unavailable", r"No such tool available|not enabled in this context|Skill \"?[^\"]*\"? not found|No \.claude/launch\.json|not found in \.claude/launch|Unknown server name|No such configuration|Available skills: none|<tool_use_error>Blocked:|blocked by (?:a )?hook|dev server exited|can't be moved"),
    ("port-in-use", r"Port \d+ is required|EADDRINUSE|is in use by|address already in use"),
    ("pane-timeout", r"timed out after|did not finish rendering|may be stuck|unresponsive renderer|Screenshot timed out|navigated or closed"),
    ("pane-navigation", r"was denied or failed|couldn't open file:|scheme is not allowed|cannot navigate|is pinned to|blocked by policy|Failed to fetch|net::ERR_|ERR_CONNECTION"),
    ("missing-binary", r"nie znaleziono Python|command not found|is not recognized as|not recognized as the name|ERR_MODULE_NOT_FOUND|Cannot find module|ERR_PACKAGE_PATH_NOT_EXPORTED|Permission denied|EACCES|EPERM|No module named|npm ERR!|Could not find a working python|is not installed"),
    ("shell-syntax", r"unexpected EOF while looking|token '&&'|not a valid statement separator|syntax error near|ParserError|Missing closing|cannot be parsed|unexpected token|The term '.*' is not recognized"),
    ("path-not-found", r"File does not exist|Path does not exist|File not found|ENOENT|No such file or directory|cd: .*: No such|does not exist|can't read"),
    ("http-error", r"status code:? \d{3}|Request failed|ECONNREFUSED|ENOTFOUND|fetch failed|\b429\b|timeout of \d+ms|HTTP \d{3}"),
    ("check-failed", r"Failing tests|EXCEPTION CAUGHT|assertion was thrown|When the exception was thrown|Analyzing \w+\.\.\.|\blint/|typecheck|error TS\d+|\bFAIL\b|✗|✖|Test failed|tests? failed|Some tests failed|\.test\.[tj]sx?|test/[\w_-]+\.\w+|expected .* (?:received|but got)|AssertionError|error\[E\d+\]|Build failed|Compilation failed"),
    ("script-error", r"TypeError|ReferenceError|RangeError|SyntaxError|Unhandled|Uncaught|\[eval\]|<anonymous_script>|Traceback \(most recent call last\)|ERR_UNSUPPORTED_ESM_URL_SCHEME|ERR_REQUIRE_ESM|^\s*Error: "),
    ("mcp-error", r"MCP error -?\d+|MCP server|JSON-RPC"),
]

# Class -> (owner, label), and the owners in order.
OWNERS = ["you", "tooling", "agent", "model", "work", "unknown"]
CLASSES = {
    "model-limit": ("you", "Usage limit reached"), "model-auth": ("you", "Not authenticated"),
    "model-server": ("model", "Provider error"), "model-content": ("model", "Request rejected by the provider"),
    "model-error": ("model", "Model call failed"), "edit-anchor-miss": ("agent", "Edit anchor not found"),
    "read-before-write": ("agent", "Write before read"), "input-validation": ("agent", "Invalid tool arguments"),
    "tool-misuse": ("agent", "Tool used out of order"), "path-not-found": ("agent", "Path not found"),
    "script-error": ("agent", "Agent script threw"), "shell-syntax": ("you", "Shell syntax"),
    "missing-binary": ("you", "Missing program, module or permission"),
    "tool-unavailable": ("you", "Tool or configuration unavailable"), "port-in-use": ("you", "Port in use"),
    "http-error": ("you", "HTTP or network error"), "pane-timeout": ("tooling", "Browser pane timeout"),
    "pane-navigation": ("tooling", "Navigation refused"), "mcp-error": ("tooling", "MCP server error"),
    "check-failed": ("work", "Check did not pass"), "exit-nonzero": ("work", "Command returned non-zero"),
    "unclassified": ("unknown", "Unclassified"),
}
LOOP_RUN = 3


def _first_match(patterns: list[tuple[str, str]], text: Column) -> Column:
    e = None
    for cls, pat in patterns:
        cond = text.rlike("(?i)" + pat)
        e = F.when(cond, cls) if e is None else e.when(cond, cls)
    return e


def error_class() -> Column:
    """Class of a failed span from its text, kind and exit code."""
    text = F.when(F.trim(F.regexp_replace(F.coalesce("output_preview", F.lit("")), r"\s", " ")) != "", F.col("output_preview"))
    tool = F.coalesce(_first_match(TOOL_PATTERNS, text), F.when(F.col("kind") == "mcp_call", "mcp-error"),
                      F.when(nz("exit_code") != 0, "exit-nonzero"), F.lit("unclassified"))
    return F.when(F.col("kind") == "llm_call", F.coalesce(_first_match(MODEL_PATTERNS, text), F.lit("model-error"))).otherwise(tool)


def _lookup(col: str, i: int) -> Column:
    m = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v[i]))])
    return F.try_element_at(m, F.col(col))


def classify_errors(spans: DataFrame) -> DataFrame:
    """Failed tool, MCP and model calls with class, owner and label."""
    f = spans.filter("status = 'error' and kind in ('tool_call', 'mcp_call', 'llm_call')").withColumn("error_class", error_class())
    return f.withColumn("owner", _lookup("error_class", 0)).withColumn("label", _lookup("error_class", 1))


def claim_reactions(t: Trace, failures: DataFrame) -> DataFrame:
    """Forward as-of with exclusive claim: failures in start order each take the first free call
    of their scope that starts at or after their end, never themselves.

    Calls of a scope are numbered slots; a failure has a first slot. A failure that many others with
    the same first slot outrun can reach no call and is left out. The set of claimed slots does not
    depend on the order, so it is a prefix maximum over failures ordered by first slot; where it has
    a gap, a block ends and nothing crosses. A failed call that ties with its own slot (no duration)
    may leave that slot to others: its slot is taken out as a row of its own, which can only widen
    the blocks. Blocks whose failures end in start order are done; the others are cut where the first
    k by slot are also the first k by start, and only these pieces are handed out one by one.
    """
    key = ["run_id", "scope_id"]
    calls = t.spans.filter("kind = 'llm_call'").select(*key, "span_id", "start_ms", "cost_micro", CHUNK)
    calls = scan(calls, key, ["start_ms", "span_id"], {"idx": ("rownum", None)}, t.chunked)
    f = failures.select(*key, closed_end().alias("at"), F.lit(0).alias("tag"), "span_id", "start_ms", F.col(CHUNK).alias("by_start"), CHUNK)
    ev = f.unionByName(calls.select(*key, F.col("start_ms").alias("at"), F.lit(1).alias("tag"), CHUNK), allowMissingColumns=True)
    if t.chunked:
        ev = rechunk(ev, chunk_edges(t.spans, "start_ms"), "at")
    s = scan(ev, key, ["at", "tag", "start_ms", "span_id"], {"n_before": ("sum", F.col("tag"))}, t.chunked).filter("tag = 0")
    own = calls.select("run_id", "span_id", F.col("idx").alias("own_idx"))
    first = nz("n_before") + 1
    s = s.join(own, ["run_id", "span_id"], "left").withColumn("first_idx", F.when(F.col("own_idx") == first, first + 1).otherwise(first))
    s = s.join(calls.groupBy(*key).agg(F.count("*").alias("n_calls")), key).withColumn("ties", nz("own_idx") > F.col("first_idx"))
    s = _by_start(s.filter("first_idx <= n_calls"), [*key, "first_idx", "ties"], {"nth": ("rownum", None)}, t.chunked)
    s = s.filter("ties or nth <= n_calls - first_idx + 1")
    slots = F.when(F.col("ties"), F.array("first_idx", "own_idx")).otherwise(F.array("first_idx"))
    s = s.select(*key, "span_id", "start_ms", "at", "own_idx", "by_start", CHUNK, F.posexplode(slots).alias("held", "first_idx"))
    # both orders rise with the first slot; chunks follow ends, without them equal first slots are best left in start order
    o = ["at", "first_idx", "held", "start_ms", "span_id"] if t.chunked else ["first_idx", "held", "start_ms", "span_id"]
    s = scan(s, key, o, {"j": ("rownum", None)}, t.chunked).withColumn("gap", F.col("first_idx") - F.col("j"))
    s = scan(s, key, o, {"lead_gap": ("max", F.col("gap"))}, t.chunked).withColumn("idx", F.col("j") + F.col("lead_gap"))
    at = F.struct("start_ms", "span_id")
    s = scan(s.withColumn("at_start", at), key, o, {"p_idx": ("lag", F.col("idx")), "p_start": ("lag", F.col("at_start"))}, t.chunked)
    s = s.withColumn("fresh", (F.col("p_idx").isNull() | (F.col("idx") > F.col("p_idx") + 1)).cast("long"))
    s = scan(s, key, o, {"block": ("sum", F.col("fresh"))}, t.chunked)
    back = ~F.col("fresh").cast("boolean") & (F.col("p_start") > F.col("at_start"))
    bad = s.filter(back | (F.col("held") == 1)).groupBy(*key, "block").agg(F.max("held").alias("has_ties"))
    straight = s.join(bad, [*key, "block"], "left_anti").select(*key, "span_id", "idx")
    m = s.join(bad, [*key, "block"]).select(*key, "block", "has_ties", "span_id", "start_ms", "at", "first_idx", "held", "own_idx", "idx", "by_start", CHUNK)
    m = _by_start(m, [*key, "block"], {"nth": ("rownum", None)}, t.chunked)
    m = scan(m, [*key, "block"], o, {"pos": ("rownum", None), "top": ("max", F.col("nth"))}, t.chunked)
    m = m.withColumn("last", ((F.col("has_ties") == 0) & (F.col("pos") == F.col("top"))).cast("long"))
    m = scan(m, [*key, "block"], o, {"pieces": ("sum", F.col("last"))}, t.chunked).withColumn("piece", F.col("pieces") - F.col("last"))
    m = m.select(*key, "block", "piece", "span_id", "start_ms", "first_idx", "held", "idx", nz("own_idx").alias("own_idx"))
    again = m.groupBy(*key, "block", "piece").applyInPandas(_hand_out(), "run_id string, scope_id string, span_id string, idx bigint")
    claim = straight.unionByName(again)
    return claim.join(calls.select(*key, "idx", F.col("span_id").alias("call_id"), "cost_micro"), [*key, "idx"]).select(
        "run_id", "span_id", "call_id", "cost_micro")


def _by_start(s: DataFrame, key: list[str], specs: dict, chunked: bool) -> DataFrame:
    """``scan`` in start order of rows whose chunks follow their end; ``by_start`` holds the chunk of the start."""
    cols = s.columns
    s = scan(s.withColumnsRenamed({CHUNK: "by_end", "by_start": CHUNK}), key, ["start_ms", "span_id"], specs, chunked)
    return s.withColumnsRenamed({CHUNK: "by_start", "by_end": CHUNK}).select(*cols, *specs)


def _hand_out():
    """Per piece: first free slot of the piece at or after each failure's first one, in start order.

    A nested function, so that it travels to the workers by value.
    """
    def assign(piece: pd.DataFrame) -> pd.DataFrame:
        slots = np.sort(piece["idx"].to_numpy())
        b = piece[piece["held"] == 0].sort_values(["start_ms", "span_id"])
        nxt = list(range(len(slots) + 1))  # next free position at or after each

        def free(i: int) -> int:
            while nxt[i] != i:
                nxt[i] = nxt[nxt[i]]
                i = nxt[i]
            return i

        got = []
        for start, own in zip(np.searchsorted(slots, b["first_idx"].to_numpy()), b["own_idx"]):
            i = free(int(start))
            i = free(i + 1) if slots[i] == own else i
            nxt[i] = i + 1
            got.append(int(slots[i]))
        return b.assign(idx=np.array(got, "int64"))[["run_id", "scope_id", "span_id", "idx"]]

    return assign


def error_occurrences(t: Trace) -> DataFrame:
    """Per failure: class, reaction cost, and what the next call of the same tool did."""
    calls = t.spans.filter("kind in ('tool_call', 'mcp_call', 'llm_call')").withColumn(
        "peer", F.when(F.col("kind") == "llm_call", F.lit("\u0000model")).otherwise(F.col("name")))
    nxt = F.struct("span_id", "status", "start_ms")
    s = scan(calls, ["run_id", "scope_id", "peer"], ["start_ms", "span_id"], {"nxt": ("lead", nxt)}, t.chunked)
    f = classify_errors(s)
    r = claim_reactions(t, f).select("run_id", "span_id", F.col("cost_micro").alias("reaction_micro"))
    f = f.join(r, ["run_id", "span_id"], "left")
    return f.select(
        "run_id", "scope_id", "span_id", "start_ms", closed_duration().alias("duration_ms"), "kind", "mcp_server", "error_class", "owner", "label",
        F.when(F.col("kind") == "llm_call", F.coalesce("model", "name")).otherwise(F.col("name")).alias("tool"),
        nz("reaction_micro").alias("reaction_micro"),
        F.when(F.col("nxt").isNull(), "none").when(F.col("nxt.status") == "error", "error").otherwise("ok").alias("recovery"),
        F.greatest(F.lit(0).cast("bigint"), F.col("nxt.start_ms") - F.col("start_ms")).alias("after_ms"),
        F.col("nxt.span_id").alias("next_id"),
        (F.trim(F.regexp_replace(F.coalesce("output_preview", F.lit("")), r"\s", " ")) == "").alias("no_text"), CHUNK)


def error_clusters(t: Trace, occ: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Class x tool clusters with their outcome: recovered, looping or unrecovered."""
    key, o = ["run_id", "error_class", "tool"], ["start_ms", "span_id"]
    s = scan(occ, key, o, {"p_next": ("lag", F.col("next_id"))}, t.chunked)
    s = s.withColumn("fresh", (~F.col("p_next").eqNullSafe(F.col("span_id"))).cast("long"))
    s = scan(s, key, o, {"streak": ("sum", F.col("fresh"))}, t.chunked)
    longest = s.groupBy(*key, "streak").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("longest"))
    at = F.struct(*o)
    g = s.groupBy(*key).agg(
        F.max("owner").alias("owner"), F.max("label").alias("label"), F.count("*").alias("failures"), F.min("start_ms").alias("first_ms"),
        F.max("start_ms").alias("last_ms"), F.sum("reaction_micro").alias("reaction_micro"), F.max_by("recovery", at).alias("last_recovery"),
        F.min_by("kind", at).alias("kind"), F.min_by("mcp_server", at).alias("mcp_server"))
    g = g.join(longest, key)
    if findings is not None:
        ids = cluster_findings(t, occ, findings).groupBy(*key).agg(
            F.count("*").alias("findings"), F.bool_or(F.col("rule") == "retry-loop").alias("in_retry"))
        g = g.join(ids, key, "left")
    else:
        g = g.withColumn("findings", F.lit(None).cast("bigint")).withColumn("in_retry", F.lit(False))
    loop = (F.col("longest") >= LOOP_RUN) | F.coalesce("in_retry", F.lit(False))
    return g.withColumn("outcome", F.when(F.col("last_recovery") != "ok", "unrecovered").when(loop, "looping").otherwise("recovered")).select(
        *key, "owner", "label", "kind", "mcp_server", "failures", "first_ms", "last_ms", "reaction_micro", "longest",
        nz("findings").alias("findings"), "outcome")


def cluster_findings(t: Trace, occ: DataFrame, findings: DataFrame) -> DataFrame:
    """(run, class, tool, finding): findings whose evidence includes a failure of the cluster."""
    cited = evidence_rows(t, findings).select("run_id", "span_id", "finding_id", "rule")
    return cited.join(occ.select("run_id", "error_class", "tool", "span_id"), ["run_id", "span_id"]).select(
        "run_id", "error_class", "tool", "finding_id", "rule").distinct()


def triage_run(t: Trace, occ: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts by owner, errors, declined calls, recoveries, attention flag and tone per run."""
    s = t.spans.groupBy("run_id").agg(
        F.count(F.when((F.col("status") == "cancelled") & (F.col("kind") != "hook"), 1)).alias("cancelled"),
        F.max(F.when(F.col("kind").isin("tool_call", "mcp_call") & (F.col("status") == "ok"), F.col("start_ms"))).alias("last_ok"))
    o = occ.groupBy("run_id").agg(
        F.count(F.when(F.col("kind") != "llm_call", 1)).alias("tool_errors"), F.count(F.when(F.col("kind") == "llm_call", 1)).alias("model_errors"),
        F.sum("reaction_micro").alias("reaction_micro"), F.count(F.when(F.col("recovery") == "ok", 1)).alias("recovered"),
        F.bool_or("no_text").alias("redacted"), *[F.count(F.when(F.col("owner") == w, 1)).alias("owner_" + w) for w in OWNERS])
    att = clusters.join(s.select("run_id", "last_ok"), "run_id").groupBy("run_id").agg(F.bool_or(
        (F.col("owner") == "you") | ((F.col("outcome") == "unrecovered") & (F.col("owner") != "work")
                                     & (F.col("last_ok").isNull() | (F.col("last_ms") > F.col("last_ok"))))).alias("needs_attention"))
    j = s.drop("last_ok").join(o, "run_id", "left").join(att, "run_id", "left")
    nums = ["tool_errors", "model_errors", "reaction_micro", "recovered", *["owner_" + w for w in OWNERS]]
    j = j.fillna(0, nums).fillna(False, ["needs_attention", "redacted"])
    tone = triage_tone()
    head = F.when(F.col("tool_errors") > 0, F.concat(F.col("tool_errors"), F.lit(" errors"))).otherwise(
        F.concat(F.col("model_errors"), F.lit(" model error"), F.when(F.col("model_errors") == 1, "").otherwise("s")))
    label = F.when(tone != "none", F.when(F.col("owner_you") > 0, F.concat(head, F.lit(" · "), F.col("owner_you"), F.lit(" yours to fix")))
                   .otherwise(head))
    return j.withColumn("tone", tone).withColumn("error_label", label)


def triage_tone() -> Column:
    return (F.when(F.col("tool_errors") + F.col("model_errors") == 0, "none").when(F.col("needs_attention"), "alarm").otherwise("quiet"))
