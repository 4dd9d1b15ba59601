"""Findings grouped by rule and placed on the session clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import break_shape, closed_end, context_tokens, nz, severity, usd
from ..skew import scan, with_chunks
from .rules import Thresholds, Trace, evidence_rows, rule_label

PAIR_RULES = ["cache-prefix-break", "idle-cache-expiry"]


def waste_groups(findings: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Per run and rule: count, sum, share, severity of the sum, folded and unpriced flags."""
    th = thresholds or Thresholds()
    w = F.col("waste_micro")
    g = findings.groupBy("run_id", "rule").agg(
        F.max("rule_class").alias("rule_class"), F.count("*").alias("findings"), nz(F.sum(w)).alias("micro"),
        F.max("run_micro").alias("run_micro"), F.bool_or(w.isNull()).alias("unpriced"),
        F.bool_or(w.isNotNull()).alias("any_priced"), F.bool_and(w.isNotNull() & (w < th.warn_floor)).alias("folded"))
    return g.select(
        "run_id", "rule", rule_label().alias("label"), "rule_class", "findings", usd("micro").alias("usd"),
        F.when(F.col("run_micro") > 0, F.col("micro") / F.col("run_micro")).otherwise(0.0).alias("share"),
        severity(F.when(F.col("any_priced"), F.col("micro")), F.col("run_micro"), th.warn_share, th.warn_floor, th.crit_share, th.crit_floor).alias("severity"), "folded", "unpriced")


def break_shapes(findings: DataFrame) -> DataFrame:
    """Count and sum per shape of the cache-prefix breaks of a run."""
    return (findings.filter("rule = 'cache-prefix-break'").groupBy("run_id", F.col("facts")["shape"].alias("shape"))
            .agg(F.count("*").alias("findings"), usd(nz(F.sum("waste_micro"))).alias("usd")))


def _evidence_spans(t: Trace, findings: DataFrame) -> DataFrame:
    s = t.spans.select("run_id", "span_id", "start_ms", closed_end().alias("e_ms"), "kind",
                       F.coalesce("tool_name", "name").alias("name"), "model", nz("tok_cache_read").alias("rd"),
                       nz("tok_cache_write").alias("wr"), context_tokens().alias("ctx"))
    return evidence_rows(t, findings).join(s, ["run_id", "span_id"])


def _at(pos: int, x: str) -> Column:
    return F.max(F.when(F.col("pos") == pos, F.col(x)))


def _occurrences(t: Trace, findings: DataFrame) -> DataFrame:
    o = F.struct("start_ms", "span_id")
    tool = F.col("kind").isin("tool_call", "mcp_call")
    g = _evidence_spans(t, findings).groupBy("run_id", "finding_id").agg(
        F.min_by("span_id", o).alias("first_span"), F.min("start_ms").alias("s0"), F.max("e_ms").alias("e1"),
        F.min_by(F.when(tool, F.col("name")), F.when(tool, F.col("pos"))).alias("tool"), F.count("*").alias("n_ev"),
        _at(1, "span_id").alias("b_id"), _at(1, "start_ms").alias("b_ms"), _at(1, "model").alias("b_model"),
        _at(0, "e_ms").alias("a_end"), *[_at(p, x).alias(f"{n}_{x}") for p, n in ((0, "a"), (1, "b")) for x in ("rd", "wr", "ctx")])
    starts = t.totals.select("run_id", F.col("start_ms").alias("t0"))
    f = findings.select("run_id", "finding_id", "rule", "rule_class", "severity", "waste_micro")
    j = f.join(g, ["run_id", "finding_id"]).join(starts, "run_id")
    return j.withColumn("pair", F.col("rule").isin(PAIR_RULES) & (F.col("n_ev") == 2)).withColumn(
        "shape", F.when(F.col("rule") == "cache-prefix-break", break_shape(F.col("a_ctx"), F.col("b_ctx"), F.col("b_rd"), t.thresholds.break_shrink, t.thresholds.break_retained)))


def waste_occurrences(t: Trace, findings: DataFrame) -> DataFrame:
    """Where each finding sits: offset, span, tool or model, and the cache figures of pair rules."""
    o, p = _occurrences(t, findings), F.col("pair")
    brk, idle = F.col("rule") == PAIR_RULES[0], F.col("rule") == PAIR_RULES[1]
    return o.select(
        "run_id", "finding_id", "rule", "severity", usd(nz("waste_micro")).alias("usd"),
        F.col("waste_micro").isNotNull().alias("priced"),
        F.when(p, F.col("b_id")).otherwise(F.col("first_span")).alias("span_id"),
        (F.when(p, F.col("b_ms")).otherwise(F.col("s0")) - F.col("t0")).alias("at_ms"),
        (F.col("e1") - F.col("t0")).alias("until_ms"), "tool", F.when(p, F.col("b_model")).alias("model"), "shape",
        F.when(p, F.col("a_rd")).alias("read_before"), F.when(p, F.col("b_rd")).alias("read_after"),
        F.when(p & brk, F.least("b_wr", "a_rd")).when(p & idle, F.least(F.col("b_wr"), F.col("a_rd") + F.col("a_wr")))
        .alias("rewritten"),
        F.when(p & idle, F.greatest(F.lit(0).cast("bigint"), F.col("b_ms") - F.col("a_end"))).alias("gap_ms"))


def leak_events(t: Trace, findings: DataFrame) -> DataFrame:
    """Burn, compaction and idle intervals of the waste-class findings on the session clock."""
    o = _occurrences(t, findings).filter("rule_class = 'waste'")
    b, a, money = F.col("b_ms") - F.col("t0"), F.col("a_end") - F.col("t0"), usd(nz("waste_micro"))

    def ev(kind: Column, s: Column, e: Column, usd_: Column, span: Column) -> Column:
        return F.struct(kind.alias("kind"), s.alias("start_off"), e.alias("end_off"), usd_.alias("usd"), span.alias("span_id"))

    rows = (F.when(F.col("pair") & (F.col("rule") == PAIR_RULES[1]), F.array(
                ev(F.lit("idle"), a, b, F.lit(0.0), F.col("b_id")), ev(F.lit("burn"), b, b, money, F.col("b_id"))))
            .when(F.col("pair"), F.array(ev(F.when(F.col("shape") == "compaction", "compaction").otherwise("burn"),
                                            b, b, money, F.col("b_id"))))
            .otherwise(F.array(ev(F.lit("burn"), F.col("s0") - F.col("t0"), F.col("e1") - F.col("t0"), money,
                                  F.col("first_span")))))
    return o.select("run_id", "finding_id", "rule", F.explode(rows).alias("e")).select("run_id", "finding_id", "rule", "e.*")


def context_series(t: Trace) -> DataFrame:
    starts = t.totals.select("run_id", F.col("start_ms").alias("t0"))
    return t.calls.join(starts, "run_id").select("run_id", "span_id", (F.col("start_ms") - F.col("t0")).alias("offset_ms"),
                                                 context_tokens().alias("tokens"), "model")


def rank_findings(findings: DataFrame) -> DataFrame:
    """Worst first within a run: estimate, severity, id."""
    sev = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    f = findings.withColumns({"worst": -nz("waste_micro"), "sev": sev})
    order = ["worst", "sev", "finding_id"]
    f, chunked = with_chunks(f, ["run_id"], order)
    return scan(f, ["run_id"], order, {"rank": ("rownum", None)}, chunked).drop("worst", "sev", "chunk")


def findings_by_span(evidence: DataFrame) -> DataFrame:
    """Finding ids per evidence span (a span is cited by a handful of findings)."""
    d = evidence.select("run_id", "span_id", "finding_id").distinct()
    return d.groupBy("run_id", "span_id").agg(F.array_join(F.array_sort(F.collect_list("finding_id")), ",").alias("findings"))
