"""Pricing, spend and the gate before a compilation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars per million input and output tokens; tokens per page where there is no history.
PRICES = {"claude-sonnet-4-6": (3.0, 15.0), "claude-opus-4-6": (15.0, 75.0), "claude-haiku-4-5": (0.8, 4.0), "deepseek-chat": (0.28, 0.42)}
DEFAULT_MODEL = "claude-sonnet-4-6"
FALLBACK_TOKENS = {"summary": 8_000, "concept": 12_000, "entity": 12_000, "topic": 200_000, "contradiction": 40_000, "open-question": 40_000}
UNKNOWN_TOKENS = 50_000
INPUT_SHARE = 0.7


def pricing_model(model: Column) -> Column:
    return F.when(F.lower(model).startswith("deepseek"), "deepseek-chat").otherwise(model)


def rate(model: Column, which: int) -> Column:
    out = F.lit(PRICES[DEFAULT_MODEL][which])
    for name, rates in PRICES.items():
        out = F.when(model == name, F.lit(rates[which])).otherwise(out)
    return out


def cost_of(tokens: Column, model: Column) -> Column:
    """Dollars for a token total, input and output split by the fixed share, rounded half up."""
    total = tokens.cast("double")
    given = F.floor(total * INPUT_SHARE + 0.5).cast("double")
    m = pricing_model(model)
    return (given * rate(m, 0) + (total - given) * rate(m, 1)) / 1_000_000


def token_usage(compilations: DataFrame) -> DataFrame:
    t = compilations.agg(F.count(F.lit(1)).alias("compilations"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("total_tokens"))
    given = F.floor(F.col("total_tokens") * INPUT_SHARE + 0.5).cast("bigint")
    return t.select("compilations", "total_tokens", given.alias("input_tokens"), (F.col("total_tokens") - given).alias("output_tokens"), cost_of(F.col("total_tokens"), F.lit(DEFAULT_MODEL)).alias("usd"))


def cost_history(compilations: DataFrame) -> DataFrame:
    """type, avg_tokens, n over compilations with known tokens; types at zero or below are left out."""
    known = compilations.filter("tokens_used IS NOT NULL").groupBy("type").agg(F.avg("tokens_used").alias("avg_tokens"), F.count(F.lit(1)).alias("n"))
    return known.filter("avg_tokens > 0")


def daily_spend(compilations: DataFrame, day: str, next_day: str) -> DataFrame:
    """model, tokens, usd within a UTC day; the half-open range on the raw column can be pushed down."""
    today = compilations.filter((F.col("compiled_at") >= day) & (F.col("compiled_at") < next_day) & F.col("tokens_used").isNotNull())
    return today.groupBy("model").agg(F.sum("tokens_used").alias("tokens")).select("model", "tokens", cost_of(F.col("tokens"), F.col("model")).alias("usd"))


def cost_lines(affected: DataFrame, compilations: DataFrame) -> DataFrame:
    """type, n, avg_tokens, from_history, projected of the affected pages."""
    fallback = F.lit(float(UNKNOWN_TOKENS))
    for name, tokens in FALLBACK_TOKENS.items():
        fallback = F.when(F.col("type") == name, float(tokens)).otherwise(fallback)
    counts = affected.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(cost_history(compilations).select("type", "avg_tokens"), "type", "left")
    average = F.coalesce("avg_tokens", fallback)
    return j.select("type", "n", average.alias("avg_tokens"), F.col("avg_tokens").isNotNull().alias("from_history"), (F.col("n") * average).alias("projected"))


def cost_gate(affected: DataFrame, compilations: DataFrame, day: str, next_day: str, model: str, ceiling: float, elapsed: float | None = None, window: float = 0) -> DataFrame:
    """One row: projected, spent, total and the decision to coalesce, defer or proceed."""
    projected = cost_lines(affected, compilations).agg(F.coalesce(F.sum("projected"), F.lit(0.0)).alias("tokens")).select(cost_of(F.col("tokens"), F.lit(model)).alias("projected"))
    spent = daily_spend(compilations, day, next_day).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("spent"))
    both = projected.crossJoin(spent).withColumn("total", F.col("projected") + F.col("spent"))  # one row each
    hold = elapsed is not None and window > 0 and 0 <= elapsed < window
    return both.withColumn("decision", F.lit("coalesce") if hold else F.when(F.col("total") > ceiling, "defer").otherwise("proceed"))
