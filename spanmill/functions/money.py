"""Token, money and pricing column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 1_000_000


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def nz(x: Column | str) -> Column:
    return F.coalesce(c(x), F.lit(0))


def usd(micro: Column | str) -> Column:
    """Micro-dollars to dollars (correctly rounded double)."""
    return c(micro) / F.lit(float(M))


def micro6(dollars: Column) -> Column:
    """Dollars (double) to micro-dollars, half toward +infinity."""
    return F.floor(dollars * F.lit(float(M)) + F.lit(0.5)).cast("long")


def round_half_up(x: Column, digits: int) -> Column:
    s = float(10 ** digits)
    return F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s)


def context_tokens() -> Column:
    return nz("tok_input") + nz("tok_cache_read") + nz("tok_cache_write")


def total_tokens() -> Column:
    return context_tokens() + nz("tok_output") + nz("tok_reasoning")


def closed_duration() -> Column:
    """Null while open; the stated duration, else end - start, never negative."""
    return F.when(F.col("status") == "in_progress", F.lit(None)).otherwise(
        F.coalesce(F.col("duration_ms"),
                   F.when(F.col("end_ms").isNotNull(),
                          F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms")))))


def closed_end() -> Column:
    return F.coalesce("end_ms", "start_ms")


def cache_write_1h(raw: Column | str, write: Column | str) -> Column:
    """The 1-hour share from a number or numeric string, rounded and clamped to [0, write]."""
    n = c(raw).try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))) & (n > 0)
    return F.when(ok, F.least(F.floor(n + 0.5).cast("long"), F.greatest(F.lit(0).cast("long"), nz(write)))
                  ).otherwise(F.lit(0).cast("long"))


def write_1h_rate(p: str = "") -> Column:
    """Published 1-hour rate, else twice the input rate for claude patterns, else the plain rate."""
    return F.coalesce(F.col(p + "write1h_u"),
                      F.when(F.col(p + "pattern").contains("claude"), F.col(p + "in_u") * 2)
                      .otherwise(F.col(p + "write_u")))


def clamped_1h() -> Column:
    return F.least(F.greatest(nz("cache_write_1h"), F.lit(0)), F.greatest(nz("tok_cache_write"), F.lit(0)))


def write_component(p: str = "") -> Column:
    one = clamped_1h()
    return (nz("tok_cache_write") - one) * F.col(p + "write_u") + one * write_1h_rate(p)


def cost_micro(p: str = "") -> Column:
    """Cost of a call at the joined rate columns (``p`` = column prefix), in micro-dollars."""
    num = (nz("tok_input") * F.col(p + "in_u")
           + (nz("tok_output") + nz("tok_reasoning")) * F.col(p + "out_u")
           + nz("tok_cache_read") * F.col(p + "read_u")
           + write_component(p))
    return int_div(num + F.lit(M // 2), M)


def effective_write_rate(p: str = "") -> Column:
    """Blended dollars per million written tokens."""
    return F.when(nz("tok_cache_write") > 0,
                  write_component(p) / nz("tok_cache_write") / F.lit(float(M))
                  ).otherwise(F.col(p + "write_u") / F.lit(float(M)))


def context_rate(p: str = "") -> Column:
    """Dollars per million input-class tokens the call paid; null when unpriced or empty."""
    num = (nz("tok_input") * F.col(p + "in_u") + nz("tok_cache_read") * F.col(p + "read_u")
           + write_component(p))
    return F.when(context_tokens() > 0, num / context_tokens() / F.lit(float(M)))


def canonical_model(x: Column | str) -> Column:
    y = F.regexp_replace(F.trim(F.lower(c(x))), r"^[a-z0-9_.-]+/", "")
    return F.regexp_replace(y, "-latest$", "")


def loose_model(x: Column) -> Column:
    return F.regexp_replace(x, r"([0-9])\.(?=[0-9])", "$1-")


def severity(waste_micro: Column, cost: Column, warn_share=0.02, warn_floor=50_000,
             crit_share=0.1, crit_floor=1_000_000) -> Column:
    share = waste_micro / cost
    return (F.when(waste_micro.isNull() | (F.coalesce(cost, F.lit(0)) <= 0), "info")
            .when((share >= crit_share) & (waste_micro >= crit_floor), "critical")
            .when((share >= warn_share) & (waste_micro >= warn_floor), "warning")
            .otherwise("info"))


def break_shape(ctx_a: Column, ctx_b: Column, read_b: Column, shrink: float = 0.6,
                retained: int = 5000) -> Column:
    return (F.when(ctx_b < F.lit(shrink) * ctx_a, "compaction")
            .when(read_b < retained, "front").otherwise("history"))
