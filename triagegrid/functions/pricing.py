"""Cost of a read from its token counts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid.lexicon import DEFAULT_MODEL, RATE_CARD

Card = Sequence[tuple[str, float, float, float]]


def rates_for(model: Column, card: Card = RATE_CARD, default: str = DEFAULT_MODEL) -> Column:
    """struct<prefix, rate_in, rate_cached, rate_out>: the longest card prefix of the model name.

    The card is a handful of rows known when the plan is built, so it is an expression, not a join.
    For a card held in a table see ``operators.costs.price_match``.
    """

    def entry(row) -> Column:
        prefix, rate_in, rate_cached, rate_out = row
        return F.struct(
            F.lit(prefix).alias("prefix"),
            F.lit(rate_in).alias("rate_in"),
            F.lit(rate_cached).alias("rate_cached"),
            F.lit(rate_out).alias("rate_out"),
        )

    fallback = entry(next(row for row in card if row[0] == default))
    longest_first = sorted(card, key=lambda row: -len(row[0]))
    chosen = F.when(model.isNull() | (model == ""), fallback)
    for row in longest_first:
        chosen = chosen.when(model.startswith(row[0]), entry(row))
    return chosen.otherwise(fallback)


def token_cost(tokens_in: Column, cached: Column, out: Column, rates: Column) -> Column:
    """USD; null when there are no input tokens."""
    cached, out = F.coalesce(cached, F.lit(0)), F.coalesce(out, F.lit(0))
    fresh = F.greatest(tokens_in - cached, F.lit(0))
    usd = (fresh * rates["rate_in"] + cached * rates["rate_cached"] + out * rates["rate_out"]) / F.lit(1_000_000.0)
    return F.when(tokens_in != 0, usd)


def cost_usd(usage: Column, model: Column, card: Card = RATE_CARD) -> Column:
    return token_cost(
        usage["input_tokens"], usage["cache_read_input_tokens"], usage["output_tokens"], rates_for(model, card)
    )


def usd6(amount: Column) -> Column:
    """Six places, half up.  The first rounding takes off the noise of binary fractions."""
    return F.round(F.round(amount, 12), 6)


def backfill_cost(usage: Column, model: Column, card: Card = RATE_CARD) -> Column:
    """The recorded cost, or the cost the recorded tokens imply (to six places)."""
    return F.coalesce(usage["cost_usd"], usd6(cost_usd(usage, model, card)))


def merge_usage(first: Column, second: Column) -> Column:
    """Both reads were paid for: token counts add up, everything else is from the second read."""
    for name in ("input_tokens", "output_tokens", "cache_read_input_tokens"):
        second = second.withField(name, F.coalesce(first[name], F.lit(0)) + F.coalesce(second[name], F.lit(0)))
    return second
