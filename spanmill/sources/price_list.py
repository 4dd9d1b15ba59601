"""Community price lists and user rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import canonical_model

PROVIDERS = ["anthropic", "openai", "gemini", "xai", "deepseek", "mistral"]
FIELDS = ["input_cost_per_token", "output_cost_per_token", "cache_read_input_token_cost", "cache_creation_input_token_cost",
          "cache_creation_input_token_cost_above_1hr"]
MAX_PER_MTOK = 10_000.0


def _problem(raw: Column, field: str) -> Column:
    """Why a published rate cannot be used; null when it can (or is absent)."""
    v = F.variant_get(raw, "$." + field, "variant")
    kind = F.schema_of_variant(v)
    n = F.try_variant_get(raw, "$." + field, "double")
    absent = v.isNull() | (kind == "VOID")
    return (F.when(absent, F.lit(None)).when(~kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), f"{field} is not a number")
            .when(n < 0, f"{field} is negative").when(n * 1e6 > MAX_PER_MTOK, f"{field} is implausibly high"))


def _mtok(field: str, fallback: Column) -> Column:
    n = F.try_variant_get("raw", "$." + field, "double")
    return F.coalesce(F.floor(n * 1e12 + 0.5) / 1e6, fallback)


def read_price_list(spark: SparkSession, path: str, providers: list[str] | None = None, min_entries: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rates, rejected) from a JSON object keyed by model; refuses lists that look truncated."""
    doc = spark.read.option("wholetext", "true").text(path).select(F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("d"))
    e = doc.select(F.explode(F.try_variant_get("d", "$", "map<string,variant>")).alias("key", "raw"))
    provider, mode = F.try_variant_get("raw", "$.litellm_provider", "string"), F.try_variant_get("raw", "$.mode", "string")
    priced = F.try_variant_get("raw", "$.input_cost_per_token", "variant")
    e = e.filter((mode == "chat") & provider.isin(providers or PROVIDERS) & priced.isNotNull() & (F.schema_of_variant(priced) != "VOID"))
    e = e.withColumn("problem", F.coalesce(*[_problem(F.col("raw"), f) for f in FIELDS]))
    zero = F.lit(0.0)
    inp = _mtok("input_cost_per_token", zero)
    w5, w60 = _mtok("cache_creation_input_token_cost", inp), _mtok("cache_creation_input_token_cost_above_1hr", zero)
    good = e.filter("problem is null").select(
        canonical_model("key").alias("model_pattern"), inp.alias("input_per_mtok"), _mtok("output_cost_per_token", zero).alias("output_per_mtok"),
        _mtok("cache_read_input_token_cost", inp).alias("cache_read_per_mtok"), w5.alias("cache_write_per_mtok"),
        F.when((w60 > 0) & (w60 >= w5) & (w60 <= w5 * 4), w60).alias("cache_write_1h_per_mtok"), F.col("key").contains("/").alias("prefixed"), "key")
    w = Window.partitionBy("model_pattern").orderBy("prefixed", "key")
    good = good.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "prefixed", "key")
    good = number_rates(good)
    n = good.count()
    if n < max(1, min_entries):
        raise ValueError(f"the price list has only {n} usable models, fewer than the {max(1, min_entries)} expected")
    return good, e.filter("problem is not null").select("key", "problem")


def number_rates(rates: DataFrame) -> DataFrame:
    """``pos`` = list order (by name) for tie-breaks; a rate card is a small dimension."""
    names = rates.agg(F.array_sort(F.collect_set("model_pattern")).alias("a"))
    return rates.withColumn("pos", F.array_position(names.select("a").scalar(), F.col("model_pattern")).cast("int"))


def effective_pricing(spark: SparkSession, user_path: str | None, bundled: DataFrame) -> tuple[DataFrame, str | None]:
    """The user's rate table when it is valid (at least one model, no negative rate), else the bundled one."""
    if user_path is None:
        return bundled, None
    try:
        schema = ("model_pattern string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, "
                  "cache_write_per_mtok double, cache_write_1h_per_mtok double")
        u = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(user_path).filter("model_pattern is not null")
        rates = [c for c in u.columns if c != "model_pattern"]
        bad = " or ".join(f"{c} < 0" for c in rates) + " or input_per_mtok is null or output_per_mtok is null"
        if u.isEmpty() or not u.filter(bad).isEmpty():
            return bundled, f"rate table {user_path} is not valid; using the bundled rates"
        return number_rates(u.fillna(0.0, ["cache_read_per_mtok", "cache_write_per_mtok"])), None
    except Exception as e:  # unreadable file: the bundled card is the documented fallback
        return bundled, f"rate table {user_path} cannot be read ({type(e).__name__}); using the bundled rates"
