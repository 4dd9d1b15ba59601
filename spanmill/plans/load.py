"""From logs to tables, in the order privacy needs: read and redact, place, price, scrub, rules, prune."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import privacy, rules
from ..operators.pricing import price_spans
from ..operators.rules import Thresholds, Trace
from ..operators.tree import place
from ..session import land
from ..sources.common import Loaded, collapse_run_ids, quarantine, winning_spans
from ..sources.otlp import OtlpSource
from ..sources.session_jsonl import SessionJsonlSource
from ..sources.store import StoreSource

# of runs with one id the one with the newest start wins, then the first by file names, whatever the source
SOURCES = [SessionJsonlSource(), StoreSource(), OtlpSource()]


@dataclass(frozen=True)
class Tables:
    trace: Trace
    findings: DataFrame
    wasted: DataFrame
    warnings: DataFrame
    rejects: DataFrame
    profile: str
    manifest: DataFrame
    private: DataFrame | None  # names that must not leave; None for a full load


def read_all(spark: SparkSession, inputs: Sequence[tuple[str, str, dict]], sources=None) -> Loaded:
    """``inputs`` = (source name, path, options); other readers join by being passed in ``sources``."""
    by_name = {s.name: s for s in (sources or SOURCES)}
    parts = [by_name[n].read(spark, p, **o) for n, p, o in inputs]
    parts = [Loaded(x.runs.withColumn("load", F.lit(i)), x.spans.withColumn("load", F.lit(i)), x.warnings) for i, x in enumerate(parts)]
    return Loaded(*(reduce(DataFrame.unionByName, [getattr(x, f) for x in parts]) for f in ("runs", "spans", "warnings")))


def build(spark: SparkSession, data: Loaded, pricing: DataFrame, thresholds: Thresholds | None = None, profile: str = "full",
          rule_list=None) -> Tables:
    """Silver tables and findings of one load."""
    ok, rejects = quarantine(data.runs)
    runs = land(collapse_run_ids(ok))
    spans = winning_spans(data.spans, runs)
    runs = runs.drop("load")
    placed, warn, chunked = place(land(spans))
    spans, warnings = price_spans(placed, pricing), data.warnings.unionByName(warn)
    p = privacy.resolve_profile(profile)
    private = None
    if p != "full":
        private = land(privacy.known_project_names(runs))
        runs, spans, warnings = privacy.sanitize(runs, land(spans), "sanitized", warnings)
        runs = land(runs)
    t = Trace(land(spans), runs, pricing, chunked, thresholds or Thresholds())
    findings = land(rules.apply_rules(t, rule_list))
    wasted = land(rules.wasted_estimate(t, findings))
    if p == "metadata-only":
        findings = land(privacy.reanchored(findings, rules.evidence_rows(t, findings), t.spans))
        t = Trace(land(privacy.prune_to_metadata(t.spans)), runs, pricing, chunked, t.thresholds, {"totals": t.totals})
    return Tables(t, findings, wasted, warnings, rejects, p, privacy.manifest(t.spans, p), private)
