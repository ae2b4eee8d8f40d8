"""p-values of the two-sample two-sided Kolmogorov-Smirnov test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def _series(lam: Column) -> Column:
    """Kolmogorov's limit distribution, upper tail, 100 terms; 1 below 0.2 where the series stalls."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def _effective_n(n1: Column, n2: Column) -> Column:
    n1, n2 = n1.cast("double"), n2.cast("double")
    return n1 * n2 / F.nullif(n1 + n2, F.lit(0.0))


def asymptotic_p(d: Column, n1: Column, n2: Column) -> Column:
    return _series(d * F.sqrt(_effective_n(n1, n2)))


def finite_n_p(d: Column, n1: Column, n2: Column) -> Column:
    """Limit distribution with the published finite-sample correction of its argument (Vrbik 2018)."""
    n = F.greatest(F.round(_effective_n(n1, n2)), F.lit(1.0))
    x = d * F.sqrt(n)
    return _series(x + 1.0 / (6.0 * F.sqrt(n)) + (x - 1.0) / (4.0 * n))


def exact_p(d: float, n1: int, n2: int) -> float:
    """P(D >= d) under the null, by walking all orders of the pooled sample at once (Hodges 1957).

    After ``t`` pooled values, ``i`` of them from sample one, every order is equally likely, so the
    next value is from sample one with probability (n1 - i) / (n1 + n2 - t). Mass that reaches
    |i/n1 - j/n2| >= d is absorbed and summed; only positive terms are added, so small p-values keep
    their digits.
    """
    bound = round(d * n1 * n2)
    if bound <= 0:
        return 1.0
    mass = np.zeros(n1 + 1)
    mass[0] = 1.0
    absorbed = 0.0
    low = high = 0                                  # mass lives in mass[low:high + 1]
    for t in range(n1 + n2):
        i = np.arange(low, high + 1)
        here = mass[low:high + 1]
        take = here * ((n1 - i) / (n1 + n2 - t))
        mass[low:high + 1] = here - take
        top = min(high + 1, n1)
        if high + 1 <= n1:
            mass[high + 1] = 0.0
            mass[low + 1:high + 2] += take
        else:
            mass[low + 1:high + 1] += take[:-1]
        i = np.arange(low, top + 1)
        out = np.abs(i * n2 - (t + 1 - i) * n1) >= bound
        if out.any():
            window = mass[low:top + 1]
            absorbed += float(window[out].sum())
            window[out] = 0.0
            inside = np.flatnonzero(~out)
            if inside.size == 0:
                return min(1.0, absorbed)
            low, top = low + int(inside[0]), low + int(inside[-1])
        high = top
    return min(1.0, absorbed)


def _fill_exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        todo = pdf["ks_stat"].notna() & (pdf[["baseline_count", "target_count"]].min(axis=1) > 0)
        rows = pdf.loc[todo, ["ks_stat", "baseline_count", "target_count"]]
        pdf.loc[todo, "p_value"] = [exact_p(d, int(a), int(b)) for d, a, b in rows.itertuples(index=False)]
        yield pdf


def with_p_value(df: DataFrame, method: str) -> DataFrame:
    """Add ``p_value`` from ks_stat, baseline_count, target_count.

    asymptotic: the limit distribution, a plain column expression.
    corrected: the same with a finite-size correction of its argument, for every size of sample.
    exact: by enumeration for every row, whatever its size; the work grows with the product of both counts.
    """
    args = F.col("ks_stat"), F.col("baseline_count"), F.col("target_count")
    if method == "asymptotic":
        return df.withColumn("p_value", asymptotic_p(*args))
    if method == "corrected":
        return df.withColumn("p_value", finite_n_p(*args))
    if method == "exact":
        df = df.withColumn("p_value", finite_n_p(*args))
        # One tiny row per (alert, feature) but real work per row: spread over all cores by count,
        # which adaptive coalescing (by bytes) would fold into one task.
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(cores, "alert_id", "feature_name").mapInPandas(_fill_exact, df.schema)
    raise ValueError(f"unknown p-value method {method!r}")
