"""Column expressions: isotope prefixes, identifiers, tolerances, robust statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes the median absolute deviation of normal data a standard deviation.
MAD_SCALE = 1.4826


def isotope_prefix_match(candidate: str, ref: str, tolerance: float) -> Column:
    """Do two ascending mass lists agree on their prefix? Of c candidate and r reference masses the first
    k = least(5, floor(c / 2) + 1, greatest(2, r - 2)) candidates each need a nearest mass among the first k + 1
    reference masses within the tolerance, no two the same one. Lists of fewer than two masses never match."""
    k = f"least(5, cast(floor(size({candidate}) / 2) as int) + 1, greatest(2, size({ref}) - 2))"
    refs = f"slice({ref}, 1, least({k} + 1, size({ref})))"
    nearest = f"transform(slice({candidate}, 1, {k}), m -> array_min(transform({refs}, (q, i) -> named_struct('d', abs(q - m), 'i', i))))"
    fits = f"forall({nearest}, z -> z.d <= {tolerance!r}D) AND size(array_distinct(transform({nearest}, z -> z.i))) = {k}"
    return F.expr(f"CASE WHEN size({candidate}) >= 2 AND size({ref}) >= 2 THEN {fits} ELSE false END")


def prefix_lengths(c: int, r: int) -> tuple[int, int] | None:
    """(candidates, reference masses) that are compared, or None where lists never match."""
    if c < 2 or r < 2:
        return None
    k = min(5, c // 2 + 1, max(2, r - 2))
    return k, min(k + 1, r)


def id_width(n: int) -> int:
    return math.ceil(math.log10(n + 1)) if n > 0 else 1


def padded_id(prefix: str, number: Column, n: int) -> Column:
    """``prefix`` and a 1-based number, padded with zeros to the width of ``n``."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), id_width(n), "0"))


def ppm_window(mz: Column, ppm: float) -> Column:
    return mz * F.lit(ppm * 1e-6)


@F.pandas_udf(T.DoubleType())
def log2(values: pd.Series) -> pd.Series:
    """The C library's log2, which DuckDB takes too: exact steps of 1 for doubled values of one binade. Spark's quotient of
    logarithms is off in the last bit for one value in three, which shows where a difference is held against a bound. Null for
    values of 0 or less."""
    x = values.to_numpy(dtype=float, na_value=np.nan)
    some = np.flatnonzero(x > 0)
    out = np.full(len(x), np.nan)
    out[some] = np.fromiter(map(math.log2, x[some].tolist()), dtype=float, count=len(some))
    return pd.Series(out, dtype="float64").where(~((x <= 0) | values.isna().to_numpy()), None)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL engines round doubles; Spark's ``round`` takes the shortest decimal's half."""
    scale = F.lit(10.0**digits)
    m = F.abs(x) * scale
    near = (F.floor(m) + F.when(m - F.floor(m) >= 0.5, 1).otherwise(0)) / scale
    return F.when(m < 2.0**52, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def minutes(seconds: Column) -> Column:
    return seconds / 60


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def cv_percent(x: str) -> Column:
    """Sample standard deviation as a percentage of the mean; null for fewer than two values or a mean of 0."""
    mean = F.avg(x)
    return F.when((F.count(x) >= 2) & (mean != 0), F.stddev_samp(x) / mean * 100)


def adjusted_r2(y: str, x: str) -> Column:
    n = F.expr(f"regr_count({y}, {x})")
    return 1 - (1 - F.expr(f"regr_r2({y}, {x})")) * (n - 1) / F.when(n > 2, n - 2)
