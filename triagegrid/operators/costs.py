"""Money and time: rates, totals, forecasts, model comparison, latency."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.pricing import Card, rates_for, token_cost
from triagegrid.session import inline_rows


def rate_card(spark, card: Card = L.RATE_CARD) -> DataFrame:
    return inline_rows(spark, ["prefix", "rate_in", "rate_cached", "rate_out"], card)


PRICE_SALTS = 32


def price_match(df: DataFrame, card: DataFrame, model: str = "model", default: str = L.DEFAULT_MODEL) -> DataFrame:
    """Add prefix, rate_in, rate_cached and rate_out from a rate-card table: longest prefix wins.

    Models are few, rows are many: only the distinct models are matched.  Each is expanded to its own
    prefixes and met by equality, so there is no nested loop however long the card is.  A model that
    no prefix fits, or a null one, takes the card's default row.
    """
    rates = F.struct("prefix", "rate_in", "rate_cached", "rate_out")
    name = F.coalesce(F.nullif(F.col(model), F.lit("")), F.lit(default))
    names = df.select(name.alias("_model")).distinct()
    tries = F.transform(
        F.sequence(F.lit(1), F.length("_model")),
        lambda n: F.struct(F.substring("_model", F.lit(1), n).alias("prefix"), n.alias("_rank")),
    )
    last_resort = F.array(F.struct(F.lit(default).alias("prefix"), F.lit(0).alias("_rank")))
    priced = (
        names.select("_model", F.inline(F.concat(tries, last_resort)))
        .join(card.select("prefix", "rate_in", "rate_cached", "rate_out"), "prefix")
        .groupBy("_model")
        .agg(F.max_by(rates, "_rank").alias("_rates"))
    )
    # A handful of models would be a handful of partitions: rows are dealt to ``PRICE_SALTS`` parts of each model by what they hold.
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(PRICE_SALTS)).cast("int")
    priced = priced.select("_model", "_rates", F.explode(F.sequence(F.lit(0), F.lit(PRICE_SALTS - 1))).alias("_salt"))
    held = df.withColumn("_model", name).withColumn("_salt", salt).join(priced, ["_model", "_salt"], "left")
    return held.select(*[F.col(c) for c in df.columns], "_rates.*")


def token_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, token sums and means, and cost, of rows with model, input_tokens, cached_tokens, output_tokens."""
    usd = token_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), rates_for(F.col("model")))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("input_tokens").alias("tokens_in"),
        F.sum("cached_tokens").alias("tokens_cached"),
        F.sum("output_tokens").alias("tokens_out"),
        F.avg("input_tokens").alias("mean_in"),
        F.avg("cached_tokens").alias("mean_cached"),
        F.avg("output_tokens").alias("mean_out"),
        F.coalesce(F.sum(usd), F.lit(0.0)).alias("cost_usd"),
    )


def cost_per_ticket(df: DataFrame, base_model: str, by: str = "model") -> DataFrame:
    """Cost per ticket of each model, priced on its token sums, and as a ratio to a base model.

    One row per model is left after the aggregate, so the ratio is taken to one number.
    """
    totals = token_totals(df, [by])
    cost = token_cost(F.col("tokens_in"), F.col("tokens_cached"), F.col("tokens_out"), rates_for(F.col(by)))
    each = totals.select(by, "n", F.try_divide(cost, F.col("n")).alias("cost_per_ticket"))
    base = each.where(F.col(by) == base_model).agg(F.first("cost_per_ticket"))
    return each.withColumn("_base", base.scalar()).select(
        by, "n", "cost_per_ticket", F.try_divide("cost_per_ticket", "_base").alias("ratio")
    )


BUCKET_MS = 1024
BUCKETS_IN_RUN = 1024


def latency_profile(df: DataFrame, by: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """n, p50, p95, p99, max and mean of whole-millisecond latencies.

    Percentiles follow an index rule, not interpolation: position n//2, int(0.95n)-1 and int(0.99n)-1
    of the sorted values, where position -1 is the last.  No rows are sorted: values are counted
    (map-side combined), counts are summed per bucket of 1024 ms, and each bucket's values get their
    running count from its own start, so no task holds more than one bucket's distinct values.  Starts are
    found the same way: runs of 1024 buckets get theirs from the runs before, so no task holds all buckets either.
    """
    by = list(by)
    v = F.col("_v")
    freq = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("bigint").alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    freq = freq.withColumn("_b", F.floor(v / BUCKET_MS))
    buckets = freq.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn")).withColumn("_c", F.floor(F.col("_b") / BUCKETS_IN_RUN))
    runs = buckets.groupBy(*by, "_c").agg(F.sum("_bn").alias("_cn"))
    whole = Window.partitionBy(*by)
    up_to = whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = runs.select(*by, "_c", (F.sum("_cn").over(up_to) - F.col("_cn")).alias("_head"), F.sum("_cn").over(whole).alias("_total"))
    in_run = Window.partitionBy(*by, "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        buckets.withColumn("_before", F.sum("_bn").over(in_run) - F.col("_bn"))
        .join(heads, [*by, "_c"])
        .select(*by, "_b", (F.col("_head") + F.col("_before")).alias("_start"), "_total")
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [*by, "_b"]
    placed = freq.select("*", F.sum("_n").over(inside).alias("_run")).join(starts, keys).withColumn("_cum", F.col("_start") + F.col("_run"))
    n = F.col("_total")

    def at(index: Column) -> Column:
        index = F.when(index < 0, n + index).otherwise(index)
        return F.min(F.when(F.col("_cum") > index, v))

    return placed.groupBy(*by).agg(
        F.max(n).alias("n"),
        at(F.floor(n / 2)).alias("p50"),
        at(F.floor(n * F.lit(0.95)) - 1).alias("p95"),
        at(F.floor(n * F.lit(0.99)) - 1).alias("p99"),
        F.max(v).alias("max_ms"),
        (F.sum(v * F.col("_n")) / F.sum("_n")).alias("mean_ms"),
    )


def forecast_spend(tickets: DataFrame, legs: Sequence[tuple[str, str]], budget: float = L.FORECAST_BUDGET_USD, runs: int = 1) -> DataFrame:
    """Estimated spend of reading every ticket on each (model, effort) leg, against a budget.

    The tickets are counted once; the legs are constants unfolded over that one row.
    """
    legs_array = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(e).alias("effort")) for m, e in legs])
    rows = tickets.agg((F.count(F.lit(1)) * runs).alias("calls")).select("calls", F.inline(legs_array))
    out = F.lit(None).cast("int")
    for effort, tokens in L.FORECAST_OUTPUT_TOKENS.items():
        out = F.when(F.col("effort") == effort, F.lit(tokens)).otherwise(out)
    cached = F.lit(L.FORECAST_INPUT_TOKENS * L.FORECAST_CACHED_SHARE)
    each = token_cost(
        F.lit(float(L.FORECAST_INPUT_TOKENS)), cached, F.coalesce(out, F.lit(L.FORECAST_OUTPUT_TOKENS["low"])), rates_for(F.col("model"))
    )
    usd = F.col("calls") * each
    return rows.select("model", "effort", "calls", usd.alias("usd"), (usd > budget).alias("over_budget"))


def model_comparison(results: DataFrame) -> DataFrame:
    """One row per saved run (schema.RUN_RESULT), dearest first; a run without a price counts as free."""
    s = F.col("summary")

    def n(values: Column) -> Column:
        return F.coalesce(F.size(values), F.lit(0))

    critical = F.coalesce(F.size(F.filter(s["urgency_hard_under"], lambda h: h.endswith("gold critical"))), F.lit(0))
    return results.select(
        "model",
        F.coalesce("effort", F.lit("low")).alias("effort"),
        "cost_per_ticket",
        n(s["missed_escalations"]).alias("missed_escalations"),
        n(s["false_escalations"]).alias("false_escalations"),
        n(s["urgency_under"]).alias("urgency_under"),
        n(s["urgency_hard_under"]).alias("urgency_under_clear"),
        critical.alias("critical_under_clear"),
        (critical > 0).alias("critical_under_called"),
        F.coalesce("fails", F.lit(0)).alias("no_answer"),
        "n",
        F.coalesce("must_n", F.lit(11)).alias("must_escalate"),
    ).orderBy(F.coalesce("cost_per_ticket", F.lit(0.0)).desc(), "model", "effort")
