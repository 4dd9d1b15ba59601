"""Predicates over runs, limit windows, budgets, trends and run ordering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import usd
from ..functions.text import branch_key, local_day, project_key
from ..skew import global_row_number

WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


@dataclass(frozen=True)
class LimitWindow:
    """Reset window: length in days, reset weekday and local hour, budgets."""
    days: int = 7
    reset_day: str = "mon"
    reset_hour: int = 0
    budget_usd: float | None = None
    budget_tokens: int | None = None

    @classmethod
    def of(cls, **raw) -> tuple["LimitWindow", list[str]]:
        """Keep valid fields, drop the others with a warning each."""
        ok, warn = {}, []
        checks = {"days": lambda v: isinstance(v, int) and 1 <= v <= 31, "reset_day": lambda v: v in WEEKDAYS,
                  "reset_hour": lambda v: isinstance(v, int) and 0 <= v <= 23,
                  "budget_usd": lambda v: isinstance(v, (int, float)) and v > 0,
                  "budget_tokens": lambda v: isinstance(v, (int, float)) and v > 0}
        for k, v in raw.items():
            if k in checks and not isinstance(v, bool) and checks[k](v):
                ok[k] = v
            else:
                warn.append(f"ignored limit window field {k}={v!r}")
        return cls(**ok), warn


def uses_tool(spans: DataFrame, tool: str) -> DataFrame:
    t = spans.filter(F.col("kind").isin("tool_call", "mcp_call") & (F.coalesce("tool_name", "name") == tool))
    return t.select("run_id").distinct()


def uses_model(facts: DataFrame, model: str) -> DataFrame:
    return facts.filter(F.map_contains_key("by_model", F.lit(model)))


def anchor_ms(facts: DataFrame) -> Column:
    """Start of the newest run of all runs, as a scalar subquery."""
    return facts.agg(F.max("start_ms").alias("a")).select("a").scalar()


def _wall(day: Column, hour: int, tz: str) -> Column:
    local = F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {hour:02d}:00:00")))
    return F.unix_millis(F.to_utc_timestamp(local, tz))


def limit_window(facts: DataFrame, cfg: LimitWindow = LimitWindow(), tz: str = "UTC") -> DataFrame:
    """(anchor_ms, start_ms, end_ms, prev_start_ms) of the reset window holding the newest run."""
    a = facts.agg(F.max("start_ms").alias("anchor_ms"))
    dow = WEEKDAYS.index(cfg.reset_day)
    day = local_day("anchor_ms", tz)
    back = F.pmod(F.dayofweek(day) - 1 - dow + 7, F.lit(7))
    a = a.withColumn("d0", F.date_sub(day, back))
    a = a.withColumn("d0", F.when(_wall(F.col("d0"), cfg.reset_hour, tz) > F.col("anchor_ms"), F.date_sub("d0", 7))
                     .otherwise(F.col("d0")))
    # calendar steps of ``days`` from the reset day; the last start at or before the anchor
    n = 7 // cfg.days + 1
    starts = F.array(*[F.date_add("d0", i * cfg.days) for i in range(n + 1)])
    a = a.withColumn("d", F.element_at(F.filter(starts, lambda x: _wall(x, cfg.reset_hour, tz) <= F.col("anchor_ms")), -1))
    return a.select("anchor_ms", _wall(F.col("d"), cfg.reset_hour, tz).alias("start_ms"),
                    _wall(F.date_add("d", cfg.days), cfg.reset_hour, tz).alias("end_ms"),
                    _wall(F.date_sub("d", cfg.days), cfg.reset_hour, tz).alias("prev_start_ms"))


def _bound(w: DataFrame, c: str) -> Column:
    return w.select(c).scalar()


def filter_runs(facts: DataFrame, spans: DataFrame | None = None, *, project: str | None = None,
                source: str | None = None, period: int | str | None = None, model: str | None = None,
                day: str | None = None, tool: str | None = None, branch: str | None = None,
                window: LimitWindow = LimitWindow(), tz: str = "UTC") -> DataFrame:
    """All given conditions; a period ends at the newest run of all runs, never at the clock.

    Where runs lie in folders by ``start_day`` (UTC), days and periods also bound the folder; a local day is at most a day apart from it.
    """
    out = facts
    by_folder = "start_day" in facts.columns
    if project is not None:
        out = out.filter(project_key() == project)
    if source is not None:
        out = out.filter(F.col("source") == source)
    if model is not None:
        out = uses_model(out, model)
    if day is not None:
        d = F.to_date(F.lit(day))
        out = out.filter(local_day("start_ms", tz) == d)
        if by_folder:
            out = out.filter(F.col("start_day").between(F.date_sub(d, 1), F.date_add(d, 1)))
    if branch is not None:
        out = out.filter(branch_key() == branch)
    if period == "reset":
        w = limit_window(facts, window, tz)
        out = out.filter((F.col("start_ms") >= _bound(w, "start_ms")) & (F.col("start_ms") < _bound(w, "end_ms")))
        if by_folder:
            utc = w.select(F.to_date(F.timestamp_millis("start_ms")).alias("lo"), F.to_date(F.timestamp_millis("end_ms")).alias("hi"))
            out = out.filter((F.col("start_day") >= _bound(utc, "lo")) & (F.col("start_day") <= _bound(utc, "hi")))
    elif period is not None:
        first = facts.agg(F.date_sub(local_day(F.max("start_ms"), tz), int(period) - 1).alias("d"))
        out = out.filter(local_day("start_ms", tz) >= first.select("d").scalar())
        if by_folder:
            out = out.filter(F.col("start_day") >= first.select(F.date_sub("d", 1).alias("d")).scalar())
    if tool is not None:
        out = out.join(uses_tool(spans, tool), "run_id", "left_semi")
    return out


def budget_use(facts: DataFrame, cfg: LimitWindow, unit: str = "usd", tz: str = "UTC") -> DataFrame:
    """Use of the budget in the current reset window."""
    used = filter_runs(facts, period="reset", window=cfg, tz=tz).agg(
        (F.sum("cost_micro") if unit == "usd" else F.sum("tok_total")).alias("u"))
    budget = cfg.budget_usd if unit == "usd" else cfg.budget_tokens
    u = F.coalesce(usd("u") if unit == "usd" else F.col("u").cast("double"), F.lit(0.0))
    return used.select(u.alias("used"), F.lit(float(budget)).alias("budget"), (u / float(budget)).alias("ratio"),
                       (u > float(budget)).alias("over"))


def spend_trend(facts: DataFrame, days: int | str = 7, by: str = "usd", window: LimitWindow = LimitWindow(),
                tz: str = "UTC", scoped: DataFrame | None = None) -> DataFrame:
    """Current against previous window of equal length; no row when there is nothing to compare with."""
    s = facts if scoped is None else scoped
    if days == "reset":
        w = limit_window(facts, window, tz)
        t = F.col("start_ms")
        cur = (t >= _bound(w, "start_ms")) & (t < _bound(w, "end_ms"))
        prev = (t >= _bound(w, "prev_start_ms")) & (t < _bound(w, "start_ms"))
    else:
        last = facts.agg(local_day(F.max("start_ms"), tz).alias("d")).select("d").scalar()
        d = local_day("start_ms", tz)
        cur = d >= F.date_sub(last, days - 1)
        prev = (d >= F.date_sub(last, 2 * days - 1)) & (d <= F.date_sub(last, days))
    s = s.withColumn("slot", F.when(cur, "c").when(prev, "p"))

    def part(slot: str, x: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("slot") == slot, F.col(x))), F.lit(0))

    g = s.agg(part("c", "cost_micro").alias("cu"), part("p", "cost_micro").alias("pu"), part("c", "tok_total").alias("ct"),
              part("p", "tok_total").alias("pt"), F.count(F.when(F.col("slot") == "p", 1)).alias("n"))
    a, b = ("cu", "pu") if by == "usd" else ("ct", "pt")
    return g.filter((F.col("n") >= 2) & (F.col(b) > 0)).select(
        usd("cu").alias("current_usd"), usd("pu").alias("previous_usd"), F.col("ct").alias("current_tokens"),
        F.col("pt").alias("previous_tokens"), ((F.col(a) - F.col(b)) / F.col(b)).alias("delta_fraction"))


def select_run(facts: DataFrame, ref: str) -> DataFrame:
    """The run with this exact id, else the only run with this prefix; fails when ambiguous."""
    hits = facts.filter(F.col("run_id").startswith(ref))
    exact = hits.filter(F.col("run_id") == ref)
    n = hits.agg(F.count("*").alias("n"), F.count(F.when(F.col("run_id") == ref, 1)).alias("x")).first()
    if n["x"] == 1:
        return exact
    if n["n"] != 1:
        raise ValueError(f"{n['n']} runs match {ref!r}")
    return hits


def valid_filter_values(facts: DataFrame, spans: DataFrame, wanted: dict[str, str]) -> dict[str, str]:
    """Requested filter values that occur in the data (one pruned existence check each)."""
    def exists(k: str, v: str) -> bool:
        return not filter_runs(facts, spans, **{k: v}).isEmpty()
    return {k: v for k, v in wanted.items() if v is not None and exists(k, v)}


def run_order(key: str = "date", direction: str = "desc") -> list[Column]:
    """Sort columns: seven keys; missing values last in both directions; ties newest first, then id."""
    cols = {"date": F.col("start_ms"), "project": F.lower("project_name"), "title": F.lower("title"),
            "models": F.size("by_model"), "duration": F.col("duration_ms"), "tokens": F.col("tok_total"),
            "cost": F.col("cost_micro")}
    c = cols[key]
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), F.desc("start_ms"), F.asc("run_id")]


def sort_runs(facts: DataFrame, key: str = "date", direction: str = "desc") -> DataFrame:
    return facts.orderBy(*run_order(key, direction))


def ranked_runs(facts: DataFrame, key: str = "date", direction: str = "desc") -> DataFrame:
    """The same order as a ``position`` column, for paging."""
    return global_row_number(facts, run_order(key, direction), "position")
