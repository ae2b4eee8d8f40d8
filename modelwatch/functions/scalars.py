"""Column helpers: clamp, logistic score, repeatable hash, time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def clamp_int(x: Column, low=fv.SCORE_MIN, high=fv.SCORE_MAX) -> Column:
    """Clip to [low, high], then drop the fraction (toward zero)."""
    return F.greatest(F.least(x, F.lit(high)), F.lit(low)).cast("int")


def logistic_score(credit: Column, income: Column, debt: Column, years: Column,
                   coef: dict | None = None, shifted: bool | Column = False) -> Column:
    """Approval probability; scaled down where ``shifted`` holds."""
    c = coef or fv.LOGISTIC
    z = (F.lit(c["credit_score"]) * (credit - F.lit(c["center"]))
         + F.lit(c["income_band"]) * income
         + F.lit(c["debt_to_income"]) * debt
         + F.lit(c["employment_years"]) * years
         + F.lit(c["intercept"]))
    p = 1.0 / (1.0 + F.exp(-z))
    flag = F.lit(shifted) if isinstance(shifted, bool) else shifted
    return F.when(flag, p * fv.LABEL_SHIFT_FACTOR).otherwise(p)


def hash_slot(key: Column, seed: str, slots: int = 1000) -> Column:
    """Repeatable number in [0, slots) from a key and a seed; the same in any SQL engine with md5."""
    text = F.concat(key.cast("string"), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(slots)


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a double, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400000000.0)


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def as_instant(ts: Column) -> Column:
    """A zone-free timestamp read as UTC: streams need instants for watermarks."""
    return F.timestamp_micros(micros(ts))


def as_ntz(instant: Column) -> Column:
    """The way back from ``as_instant``."""
    return _epoch() + F.make_dt_interval(secs=(F.unix_micros(instant) / F.lit(1000000)).cast("decimal(18,6)"))


def usable(x: Column) -> Column:
    """Neither null nor NaN (averages keep NaN, so it has to be filtered by name)."""
    return x.isNotNull() & ~F.isnan(x)
