"""Metric formulas as column expressions. A ratio without a base is null, never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def net_support(support: Column, oppose: Column) -> Column:
    return ratio(support - oppose, support + oppose)


def entropy_norm(*counts: Column) -> Column:
    """Entropy of the given counts over its maximum; 0 when all are 0."""
    total = sum(counts[1:], counts[0])
    share = [c / F.nullif(total, F.lit(0)) for c in counts]
    terms = [F.when(c > 0, -p * F.ln(p)).otherwise(F.lit(0.0)) for c, p in zip(counts, share)]
    return sum(terms[1:], terms[0]) / F.lit(math.log(len(counts)))


def volume_norm(count: Column, total: Column) -> Column:
    capped = F.least(F.lit(1.0), F.log1p(count) / F.log1p(F.greatest(total, F.lit(1))))
    return F.when(total > 0, capped).otherwise(F.lit(0.0))


def controversy(entropy: Column, conflict: Column, volume: Column) -> Column:
    return 0.5 * entropy + 0.3 * F.coalesce(conflict, F.lit(0.0)) + 0.2 * volume


def trend_speed(days: Column, count: Column, index_sum: Column) -> Column:
    """Least-squares slope of the dense daily series over its mean.

    Needs only the number of rows and the sum of their day indexes, so no calendar
    table is built: sum((i-m)*y) = index_sum - m*count and sum((i-m)^2) = n(n^2-1)/12.
    """
    mid = (days - 1) / F.lit(2.0)
    spread = days * (days * days - 1) / F.lit(12.0)
    slope = (index_sum - mid * count) / F.nullif(spread, F.lit(0.0))
    return F.when((days >= 2) & (count > 0), slope / (count / days))


def persistence(active_days: Column, window_days: Column, videos: Column, all_videos: Column) -> Column:
    day_part = F.coalesce(ratio(active_days, window_days), F.lit(0.0))
    video_part = F.coalesce(ratio(videos, all_videos), F.lit(0.0))
    return 0.5 * F.least(day_part, F.lit(1.0)) + 0.5 * F.least(video_part, F.lit(1.0))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ugc_diffusion(category_share: Column, video_share: Column, growth: Column) -> Column:
    return 0.4 * category_share + 0.3 * video_share + 0.3 * clip01(growth)


def per_thousand(count: Column, base: Column) -> Column:
    return F.when(base > 0, count * 1000.0 / base)


def per_ten(count: Column, base: Column) -> Column:
    return F.when(base > 0, count * 10.0 / base)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))


def sample_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))
