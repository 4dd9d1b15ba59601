"""Column contract of the silver tables and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the trace contract.
KINDS = ["session", "turn", "llm_call", "tool_call", "subagent", "mcp_call", "hook", "other"]
STATUSES = ["ok", "error", "cancelled", "in_progress", "unknown"]
COST_SOURCES = ["computed", "reported", "unknown"]
TOOL_KINDS = ["tool_call", "mcp_call"]
SCOPE_KINDS = ["subagent", "session"]

# money is integer micro-dollars (cost_micro), time is epoch milliseconds
RAW_SPAN_DDL = """
run_id STRING, span_id STRING, parent_id STRING, kind STRING, name STRING, status STRING,
status_reason STRING, start_ms BIGINT, start_raw STRING, end_ms BIGINT, duration_ms BIGINT,
provider STRING, model STRING, tok_input BIGINT, tok_output BIGINT, tok_cache_read BIGINT,
tok_cache_write BIGINT, tok_reasoning BIGINT, cache_write_1h BIGINT, cost_micro BIGINT,
cost_source STRING, stop_reason STRING, tool_name STRING, mcp_server STRING, exit_code INT,
output_bytes BIGINT, lines_added BIGINT, lines_removed BIGINT, agent_name STRING,
agent_session STRING, prompt_preview STRING, output_preview STRING, delegation_reason STRING,
content_redacted BOOLEAN, target_key STRING, target_kind STRING, target_label STRING,
activity STRING, tool_id STRING, tool_sub STRING, tools_also ARRAY<STRING>,
tool_flags ARRAY<STRING>, hook_count INT, attributes MAP<STRING,STRING>,
prov_file STRING, prov_line BIGINT, prov_record STRING
"""

RUN_DDL = """
run_id STRING, source STRING, format STRING, title STRING, project_name STRING,
project_path STRING, git_branch STRING, start_ms BIGINT, end_ms BIGINT, duration_ms BIGINT,
files ARRAY<STRING>
"""

WARNING_DDL = "run_id STRING, message STRING, file STRING, line BIGINT"

FINDING_DDL = """
run_id STRING, rule STRING, rule_order INT, evidence ARRAY<STRING>, first_ms BIGINT,
first_id STRING, waste_micro BIGINT, facts MAP<STRING,STRING>
"""



def ddl_columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string (commas inside <> do not split)."""
    out, depth, cur = [], 0, ""
    for ch in ddl.replace("\n", " ") + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, typ = cur.strip().split(" ", 1)
            out.append((name, typ.strip()))
            cur = ""
        else:
            cur += ch
    return out


def conform(df: DataFrame, ddl: str = RAW_SPAN_DDL, keep: bool = False) -> DataFrame:
    """Cast to the contract, filling absent columns with nulls; ``keep`` retains extra columns."""
    have = set(df.columns)
    cols = ddl_columns(ddl)
    picked = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in cols]
    extra = [F.col(c) for c in df.columns if c not in dict(cols)] if keep else []
    return df.select(*picked, *extra)
