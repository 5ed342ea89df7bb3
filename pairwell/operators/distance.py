"""From a cohort to comparable units: features, scales, windows and the four distances."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MatchError
from ..functions.tools import attach, complete_rows, named, with_size
from .neighbours import Geometry, nearest

RIDGE = 1e-6  # fixed value: added to the diagonal of a singular covariance
METRICS = ("euclidean", "mahalanobis", "gower", "weighted_hybrid")


@dataclass(frozen=True)
class Window:
    """Two units may only be paired if they differ by at most ``value`` (or that many deviations)."""

    covariate: str
    value: float
    scale: str = "absolute"

    def __post_init__(self):
        if not self.value > 0:
            raise MatchError("a caliper window needs a positive value")
        if self.scale not in ("absolute", "standard_deviation"):
            raise MatchError(f"unknown window scale '{self.scale}'")


@dataclass(frozen=True)
class PairRule:
    """Everything that decides whether and how far two units are apart."""

    features: tuple[str, ...]
    metric: str = "euclidean"
    categorical: frozenset = frozenset()  # columns declared categorical
    windows: tuple[Window, ...] = ()
    caliper: float | None = None
    weight_num: float = 0.6
    weight_cat: float = 0.4


@dataclass
class Units:
    queries: DataFrame  # blk, stratum, q, x.., c.., s.., t.., reach
    pool: DataFrame  # blk, stratum, p, x.., c.., s.., t.., reach
    geometry: Geometry
    id_type: str = "long"
    extra: dict = field(default_factory=dict)


def _whitener(d: int):
    upper = np.triu_indices(d)

    @F.pandas_udf("array<double>")
    def root(flat: pd.Series) -> pd.Series:
        """Flattened L with inverse covariance = L L' for the upper triangle of a covariance, then the upper triangle
        of the squared distance's form and what it is divided by."""
        out = []
        for values in flat:
            cov = np.zeros((d, d))
            cov[upper] = np.asarray(values, float)
            cov = cov + cov.T - np.diag(np.diag(cov))
            try:
                inverse = np.linalg.inv(cov)
            except np.linalg.LinAlgError:
                cov = cov + RIDGE * np.eye(d)
                inverse = np.linalg.inv(cov)
            values, vectors = np.linalg.eigh((inverse + inverse.T) / 2)
            form, divisor = (vectors * np.clip(values, 0, None)) @ vectors.T, 1.0
            if d == 2 and values.min() > 0:  # the cofactors are the entries themselves
                form = np.array([[cov[1, 1], -cov[0, 1]], [-cov[0, 1], cov[0, 0]]])
                divisor = cov[0, 0] * cov[1, 1] - cov[0, 1] * cov[0, 1]
            out.append([*(vectors * np.sqrt(np.clip(values, 0, None))).ravel().tolist(), *form[upper].tolist(), divisor])
        return pd.Series(out)

    return root


def compare_units(cohort: DataFrame, id_col: str, rule: PairRule) -> Units:
    """Shape both roles for the neighbour search.

    ``cohort`` has ``stratum``, ``role`` and a unique ``id_col``. Ranges, covariances and
    deviations are those of the stratum. Units with a NULL in a numeric feature or a
    window column cannot be compared and are left out (they end up unmatched).
    """
    if rule.metric not in METRICS:
        raise MatchError(f"unknown distance '{rule.metric}'")
    if rule.weight_num < 0 or rule.weight_cat < 0:
        raise MatchError("distance weights must not be negative")
    types = dict(cohort.dtypes)
    absent = [c for c in [*rule.features, *[w.covariate for w in rule.windows]] if c not in types]
    if absent:
        raise MatchError(f"columns not in the cohort: {absent}")
    declared = set(rule.categorical)
    is_text = {c for c in types if types[c] in ("string", "date", "timestamp", "timestamp_ntz")}
    mixed = rule.metric in ("gower", "weighted_hybrid")
    if rule.metric == "mahalanobis" and declared & set(rule.features):
        raise MatchError(f"mahalanobis needs numeric features only, not {sorted(declared & set(rule.features))}")
    if not mixed and is_text & set(rule.features):
        raise MatchError(f"{rule.metric} needs numeric features only, not {sorted(is_text & set(rule.features))}")
    cats = [c for c in rule.features if mixed and c in declared | is_text]
    nums = [c for c in rule.features if c not in cats]

    equal = [w.covariate for w in rule.windows if w.covariate in declared | is_text]
    ranged = [w for w in rule.windows if w.covariate not in equal]
    whitened = rule.metric == "mahalanobis"
    # Whitened coordinates lead the search; the distance itself is taken from the raw ones, so that equal differences tie.
    extra_x = [*(nums if whitened else []), *[w.covariate for w in ranged if whitened or w.covariate not in nums]]
    extra_x = list(dict.fromkeys(extra_x))
    place = {c: i for i, c in enumerate(nums)} if not whitened else {}
    place.update({c: len(nums) + i for i, c in enumerate(extra_x)})

    x = {c: named(c).cast("double") for c in dict.fromkeys([*nums, *extra_x])}
    needed = [c for c in [*x, *equal]]
    whole = complete_rows(cohort, needed)

    stats, names = [], []
    if mixed:
        for i, c in enumerate(nums):
            stats.append((F.max(x[c]) - F.min(x[c])).alias(f"_range{i}"))
    if whitened:
        d = len(nums)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        stats.append(F.array(*[F.covar_samp(x[nums[i]], x[nums[j]]) for i, j in pairs]).alias("_cov"))
        stats.append(F.count(F.lit(1)).alias("_n"))
    for w, win in enumerate(ranged):
        if win.scale == "standard_deviation":
            stats.append(F.stddev_pop(x[win.covariate]).alias(f"_sd{w}"))
    rows = None
    if stats:
        both = F.min(F.col("role")) != F.max(F.col("role"))
        table = whole.groupBy("stratum").agg(both.alias("_both"), *stats).where("_both").drop("_both")
        table, rows = with_size(table)
        if whitened:
            few = table.agg(F.min("_n")).first()[0]
            if few is not None and few < len(nums) + 2:
                raise MatchError(f"mahalanobis needs at least {len(nums) + 2} units per stratum, found {few}")
            table, rows = with_size(table.withColumn("_l", _whitener(len(nums))("_cov")).drop("_cov", "_n"))
        whole = attach(whole, table, ["stratum"], rows=rows)

    columns = []
    if whitened:
        d = len(nums)
        for j in range(d):
            parts = [x[c] * F.col("_l")[i * d + j] for i, c in enumerate(nums)]
            total = parts[0]
            for part in parts[1:]:
                total = total + part
            columns.append(total.alias(f"x{j}"))
    else:
        columns += [x[c].alias(f"x{i}") for i, c in enumerate(nums)]
    columns += [x[c].alias(f"x{len(nums) + i}") for i, c in enumerate(extra_x)]
    columns += [F.coalesce(named(c).cast("string"), F.lit("None")).alias(f"c{j}") for j, c in enumerate(cats)]
    blk = F.concat_ws("\x1f", "stratum", *[named(c).cast("string") for c in equal]).alias("blk")

    own = []
    if mixed:
        own += [F.when(F.col(f"_range{i}") > 0, F.col(f"_range{i}")).otherwise(1.0).alias(f"s{i}") for i in range(len(nums))]
    if whitened:
        own += [F.col("_l")[len(nums) ** 2 + i].alias(f"s{i}") for i in range(len(nums) * (len(nums) + 1) // 2 + 1)]
    for w, win in enumerate(ranged):
        width = F.lit(float(win.value))
        if win.scale == "standard_deviation":
            width = width * F.col(f"_sd{w}")
        own.append(width.alias(f"t{w}"))
    own.append(F.lit(float("inf") if rule.caliper is None else float(rule.caliper)).alias("reach"))
    geometry = Geometry(
        {"mahalanobis": "euclidean", "weighted_hybrid": "weighted"}.get(rule.metric, rule.metric),
        len(nums),
        len(cats),
        len(extra_x),
        rule.weight_num,
        rule.weight_cat,
        mixed,
        tuple(place[w.covariate] for w in ranged),
        whitened,
    )
    queries = whole.where("role = 'query'").select(blk, "stratum", named(id_col).alias("q"), *columns, *own)
    pool = whole.where("role = 'pool'").select(blk, "stratum", named(id_col).alias("p"), *columns, *own)
    return Units(queries, pool, geometry, types[id_col])


def with_stratum_of(pairs: DataFrame) -> DataFrame:
    """Name the columns of neighbour rows for users: ``stratum, query_id, pool_id, dist, rank``."""
    return pairs.select(
        F.substring_index("blk", "\x1f", 1).alias("stratum"),
        F.col("q").alias("query_id"),
        F.col("p").alias("pool_id"),
        "dist",
        F.col("rank").cast("int").alias("rank"),
    )


def nearest_pairs(cohort: DataFrame, id_col: str, rule: PairRule, k: int = 1) -> DataFrame:
    """The ``k`` nearest admissible pool units of every query unit, any pool unit as often as it is near."""
    units = compare_units(cohort, id_col, rule)
    return with_stratum_of(nearest(units.queries.drop("stratum"), units.pool, units.geometry, k))


def prefilter_pool(
    cohort: DataFrame, id_col: str, rule: PairRule, k: int = 7, min_candidates: int | None = None, widened_k: int = 15
) -> DataFrame:
    """Pool units that are among some query's k nearest: ``(stratum, pool_id)``.

    A stratum with fewer than ``min_candidates`` of them is searched once more with ``widened_k``.
    """
    wide = nearest_pairs(cohort, id_col, rule, k if min_candidates is None else max(k, widened_k))
    if min_candidates is None:
        return wide.select("stratum", "pool_id").distinct()
    near = wide.groupBy("stratum", "pool_id").agg(F.min("rank").alias("rank"))
    enough = near.groupBy("stratum").agg((F.count_if(F.col("rank") <= k) >= min_candidates).alias("_enough"))
    kept = attach(near, enough, ["stratum"])
    return kept.where((F.col("rank") <= k) | ~F.col("_enough")).select("stratum", "pool_id")
