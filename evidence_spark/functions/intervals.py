"""Numeric intervals, tolerances and the confidence ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIDENCE, DEFAULT, Config


def interval(value_type: Column, num: Column, lo: Column, hi: Column, uncertainty: Column) -> tuple[Column, Column]:
    """(low, high): a number with its uncertainty on both sides, a range in order; null for other types."""
    u = F.abs(F.coalesce(uncertainty, F.lit(0.0)))
    low = F.when(value_type == "number", num - u).when(value_type == "range", F.least(lo, hi))
    high = F.when(value_type == "number", num + u).when(value_type == "range", F.greatest(lo, hi))
    return low, high


def intervals_compatible(a: tuple[Column, Column], b: tuple[Column, Column], config: Config = DEFAULT) -> Column:
    """Overlap of the new interval a and the existing b, at once or after b alone is padded by the tolerance."""
    pad = F.greatest(F.lit(config.relative_tolerance) * F.greatest(F.abs(b[0]), F.abs(b[1])), F.lit(config.absolute_tolerance))
    return ((a[0] <= b[1]) & (b[0] <= a[1])) | ((a[0] <= b[1] + pad) & (b[0] - pad <= a[1]))


def scalar_equal(a_num: Column, b_num: Column, a_text: Column, b_text: Column) -> Column:
    both = a_num.isNotNull() & b_num.isNotNull()
    return F.when(both, F.abs(a_num - b_num) <= 1e-12).otherwise(F.lower(F.trim(a_text)).eqNullSafe(F.lower(F.trim(b_text))))


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(CONFIDENCE):
        out = F.when(confidence == name, F.lit(k)).otherwise(out)
    return out


def confidence_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, CONFIDENCE)), rank)


def at_most_medium(confidence: Column) -> Column:
    """A ceiling: it never raises what comes in."""
    return F.when(confidence.isin("high", "verified"), F.lit("medium")).otherwise(confidence)


def ranges_disjoint(ranges: Column) -> Column:
    """Whether any two ranges (lo, hi) that are adjacent once sorted leave a gap; a wide range before may hide one."""
    s = F.array_sort(ranges)
    at = F.when(F.size(s) >= 2, F.sequence(F.lit(0), F.size(s) - 2)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.get(s, i)["hi"] < F.get(s, i + 1)["lo"])


def unit_interval(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
