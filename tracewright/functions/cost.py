"""What model calls cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD for a million tokens in and out, by model (fixed values).
PRICES = {"gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60)}
DEFAULT = "gpt-4o-mini"


def price_key(model: Column) -> Column:
    """The model's price list: exact name, else longest prefix, else longest part, else the default."""
    name = F.lower(F.coalesce(model, F.lit("")))
    longest = sorted(PRICES, key=len, reverse=True)
    rules = [(name == k, k) for k in longest] + [(name.startswith(k), k) for k in longest] + [(F.contains(name, F.lit(k)), k) for k in longest]
    return F.coalesce(*(F.when(test, k) for test, k in rules), F.lit(DEFAULT))


def call_cost(key: Column, tokens_in: Column, tokens_out: Column) -> Column:
    per = lambda i: F.coalesce(*(F.when(key == k, F.lit(p[i])) for k, p in PRICES.items()))
    return (tokens_in * per(0) + tokens_out * per(1)) / 1e6


def totals(calls: DataFrame, keys: tuple[str, ...] = ("annotation_id", "step_index")) -> DataFrame:
    """Tokens, cost and calls for each prefix of ``keys`` down to the whole run.

    ``calls`` has model, prompt_tokens and completion_tokens (null: 0).  ``level`` is
    the number of keys that a row is grouped by, so null keys can't be mistaken for
    subtotals.  Costs are summed as whole numbers and don't depend on the rows' order.
    """
    at, n = price_key(F.col("model")), len(keys)
    tokens = [F.coalesce(c, F.lit(0)).cast("decimal(18,0)") for c in ("prompt_tokens", "completion_tokens")]
    units = [F.coalesce(*(F.when(at == k, F.lit(round(p[i] * 1_000_000))) for k, p in PRICES.items())) for i in (0, 1)]
    rows = calls.select(*keys, *(t.alias(a) for t, a in zip(tokens, ("__in", "__out"), strict=True)), (tokens[0] * units[0] + tokens[1] * units[1]).alias("__units"))
    level = F.lit(n) - F.bit_count(F.grouping_id())
    return rows.rollup(*keys).agg(
        level.cast("int").alias("level"),
        F.sum("__in").cast("long").alias("prompt_tokens"),
        F.sum("__out").cast("long").alias("completion_tokens"),
        (F.sum("__in") + F.sum("__out")).cast("long").alias("total_tokens"),
        (F.sum("__units").cast("double") / 1e12).alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
    )
