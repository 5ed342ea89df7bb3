"""From a table to a cohort: roles, usable covariates, strata, overlap and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MatchError
from ..functions.order import exact_quantiles
from ..functions.tools import attach, named, wide_to_long, with_size

ALL = "__all__"  # fixed value: the stratum key if nothing is matched exactly
NULL_KEY = "None"  # fixed value: how a NULL appears in a stratum key
PS, LOGIT = "__ps__", "__logit_ps__"  # fixed values: names of the score columns

DIRECTIONS = {"treated_to_control": 1, "control_to_treated": 0}


def check_treatment(df: DataFrame, treatment_col: str) -> None:
    """Only 0 and 1 are groups; anything else would be in neither."""
    flag = named(treatment_col)
    stray = df.agg(F.count_if(flag.isNull() | ~flag.cast("double").isin(0.0, 1.0))).first()[0]
    if stray:
        raise MatchError(f"{stray} rows have a '{treatment_col}' that is neither 0 nor 1")


def resolve_direction(df: DataFrame, treatment_col: str, direction: str = "treated_to_control") -> DataFrame:
    """Add ``role``: ``query`` units look for partners, ``pool`` units are offered."""
    if direction not in DIRECTIONS:
        raise MatchError(f"unknown direction '{direction}'")
    asks = named(treatment_col) == DIRECTIONS[direction]
    return df.withColumn("role", F.when(asks, "query").otherwise("pool"))


def role_names(direction: str) -> tuple[str, str]:
    query, pool = direction.split("_to_")
    return query, pool


def covariate_availability(
    df: DataFrame, treatment_col: str, covariates: list[str], threshold: float = 0.20
) -> DataFrame:
    """Worse of the two groups' NULL shares; usable if it stays below the threshold."""
    aggs = []
    for i, c in enumerate(covariates):
        share = lambda g: F.coalesce(
            F.avg(F.when(named(treatment_col) == g, named(c).isNull().cast("double"))), F.lit(0.0)
        )
        aggs.append(F.greatest(share(1), share(0)).alias(f"missing_pct__{i}"))
    table = wide_to_long(df.agg(*aggs), covariates, ["missing_pct"])
    return table.withColumn("usable", F.col("missing_pct") < threshold)


def usable_covariates(availability: DataFrame) -> list[str]:
    found = [r["variable"] for r in availability.where("usable").select("variable").collect()]
    if not found:
        raise MatchError("no matching covariate has few enough missing values")
    return found


def _escaped(value):
    """A value as part of a stratum: marks inside it are escaped and NULL differs from its own text, so that
    different values never give one stratum."""
    shown = F.regexp_replace(value, r"([\\\\|])", r"\\\\$1")
    return F.when(value.isNull(), F.lit(NULL_KEY)).when(value == NULL_KEY, F.concat(F.lit("\\"), shown)).otherwise(shown)


def with_stratum(df: DataFrame, exact: list[str] = ()) -> DataFrame:
    """Add ``stratum``: the exactly matched values joined into one key; NULL is a value of its own."""
    absent = [c for c in exact if c not in df.columns]
    if absent:
        raise MatchError(f"exact-match covariates not in the table: {absent}")
    if not exact:
        return df.withColumn("stratum", F.lit(ALL))
    parts = [_escaped(named(c).cast("string")) for c in exact]
    return df.withColumn("stratum", F.concat_ws("|", *parts))


def overlap(df: DataFrame, treatment_col: str, score_col: str = PS) -> DataFrame:
    """Range of the score in both groups and their common support, per stratum."""
    treated, control = (F.when(named(treatment_col) == g, named(score_col)) for g in (1, 0))
    return (
        df.groupBy("stratum")
        .agg(
            F.min(treated).alias("treated_min"),
            F.max(treated).alias("treated_max"),
            F.min(control).alias("control_min"),
            F.max(control).alias("control_max"),
        )
        .withColumn("common_support_min", F.when(F.col("treated_min").isNotNull() & F.col("control_min").isNotNull(), F.greatest("treated_min", "control_min")))
        .withColumn("common_support_max", F.when(F.col("treated_min").isNotNull() & F.col("control_min").isNotNull(), F.least("treated_max", "control_max")))
    )


def trim(df: DataFrame, treatment_col: str, score_col: str = PS, q: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Drop units outside the common range of the groups' q and 1-q quantiles (nearest rank), per stratum.

    Returns the kept rows and a record per stratum.
    """
    found = exact_quantiles(df, [score_col], [q, 1 - q], ["stratum", treatment_col], method="nearest")
    at = lambda g, p: F.max(F.when((named(treatment_col) == g) & (F.abs(F.col("prob") - p) < 1e-12), F.col("value")))
    bounds = found.groupBy("stratum").agg(
        F.greatest(at(1, q), at(0, q)).alias("lower_bound"), F.least(at(1, 1 - q), at(0, 1 - q)).alias("upper_bound")
    )
    bounds, rows = with_size(bounds)
    marked = attach(df, bounds, ["stratum"], rows=rows)
    inside = (named(score_col) >= F.col("lower_bound")) & (named(score_col) <= F.col("upper_bound"))
    record = marked.groupBy("stratum", "lower_bound", "upper_bound").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(inside).alias("n_after")
    )
    record = record.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))
    return marked.where(inside).select(*map(named, df.columns)), record


def matching_space(space: str, covariates: list[str]) -> list[str]:
    """Feature columns of a representation."""
    spaces = {
        "covariates_only": list(covariates),
        "ps_only": [PS],
        "logit_ps_only": [LOGIT],
        "hybrid_covariates_and_ps": [*covariates, LOGIT],
    }
    if space not in spaces:
        raise MatchError(f"unknown matching space '{space}'")
    return spaces[space]
