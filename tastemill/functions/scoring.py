"""Score arithmetic as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemill.functions import fixed


def implicit_rank(purchases: Column, browses: Column) -> Column:
    return purchases * fixed.PURCHASE_WEIGHT + browses * fixed.BROWSE_WEIGHT


def taste_score(value: Column, quantiles: Column) -> Column:
    """1 below the first quantile up to 5 from the last one on."""
    score = F.when(value < F.get(quantiles, F.lit(0)), 1)
    for i in range(1, len(fixed.TASTE_QUANTILES)):
        score = score.when(value < F.get(quantiles, F.lit(i)), i + 1)
    return score.otherwise(len(fixed.TASTE_QUANTILES) + 1)


def renormalize(value: Column, source: tuple, target: tuple) -> Column:
    """Linear map from one range to another; null when the source range is a point."""
    low, high = source
    span = target[1] - target[0]
    return F.try_divide(span * (value - low), high - low) + target[0]


def minmax_scale(value: Column, low: Column, high: Column, top: int = 100) -> Column:
    """Scores moved to 1..top; every score is 1 when they are all the same."""
    scaled = F.try_divide((top - 1) * (value - low), high - low) + 1
    return F.when(high == low, F.lit(1.0)).otherwise(scaled)


def recency_share(position: Column, size: Column) -> Column:
    """0 for the newest event of a group, 1 for the oldest."""
    return F.when(position == 0, F.lit(0.0)).otherwise(F.try_divide(position, size - 1))


def action_rating(low: Column, high: Column, share: Column) -> Column:
    """Position inside the band of the action, the newest event at its high end."""
    return high - (high - low) * share


def scale_millions(amount: Column) -> Column:
    return amount / 1e6


def percent_loss(before: Column, after: Column) -> Column:
    """Share lost in percent, rounded up."""
    return F.ceil(F.try_divide((before - after) * 100, before))
