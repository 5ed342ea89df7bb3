"""Test p-values, computed on summary rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KOLMOGOROV_TERMS = 100


def ks_p_value(stat: Column, n1: Column, n0: Column) -> Column:
    """Two-sided asymptotic Kolmogorov-Smirnov p-value with the small-sample term."""
    root = F.sqrt(n1 * n0 / (n1 + n0))
    lam = (root + 0.12 + 0.11 / root) * stat
    term = lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)), F.lit(0.0), term)
    return F.when(lam < 0.3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


@F.pandas_udf(DoubleType())
def _upper_tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore").astype(float)


def chi2_p_value(stat: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return _upper_tail(stat)
