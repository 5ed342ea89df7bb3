"""Covariate balance between treatment 1 and treatment 0: one row per covariate, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import running_totals
from ..functions.pvalues import chi2_p_value, ks_p_value
from ..functions.tools import attach, few_values, is_numeric, materialise, melt_numeric, melt_text, named, wide_to_long

BINS = 20  # fixed value: histogram bins of the divergence of numeric covariates
METRICS = ("smd", "variance_ratio", "ks_test", "chi_square", "jensen_shannon")


def _one_row_each(df: DataFrame, covariates: list[str]) -> DataFrame:
    rows = [(i, c) for i, c in enumerate(covariates)]
    return df.sparkSession.createDataFrame(rows, "_place int, variable string")


def _in_order(table: DataFrame) -> DataFrame:
    """Sort a table of one row per covariate without the extra sampling run of a global sort."""
    return table.coalesce(1).sortWithinPartitions("_place")


def _complete(table: DataFrame, df: DataFrame, covariates: list[str]) -> DataFrame:
    """Add the covariates a metric does not apply to, with NULLs, in the given order."""
    full = attach(_one_row_each(df, covariates), table, ["variable"], "left", len(covariates))
    return _in_order(full).select("variable", *[c for c in table.columns if c != "variable"])


def group_moments(
    df: DataFrame, treatment_col: str, covariates: list[str], weight_col: str | None = None, keys: list[str] = ()
) -> DataFrame:
    """Mean and variance per covariate and group from one pass over the table.

    Weighted moments use the population variance. Output: ``keys, variable, n1, n0, mean1, mean0, var1, var0``.
    """
    aggs = []
    centers = None
    if weight_col is not None:
        centers = df.groupBy(*keys).agg(
            *[
                (F.sum(_in(treatment_col, g, c) * named(weight_col)) / F.sum(_in(treatment_col, g, c, weight_col))).alias(f"_m{g}_{i}")
                for i, c in enumerate(covariates)
                for g in (1, 0)
            ]
        )
        df = attach(df, centers, list(keys)) if keys else df.withColumns(
            {k: F.lit(v) for k, v in centers.first().asDict().items()}
        )
    for i, c in enumerate(covariates):
        for g in (1, 0):
            x = _in(treatment_col, g, c).cast("double")
            aggs.append(F.count(x).alias(f"n{g}__{i}"))
            if weight_col is None:
                aggs += [F.avg(x).alias(f"mean{g}__{i}"), F.var_samp(x).alias(f"var{g}__{i}")]
            else:
                w = _in(treatment_col, g, c, weight_col)
                center = F.col(f"_m{g}_{i}")
                aggs += [
                    F.max(center).alias(f"mean{g}__{i}"),
                    (F.sum(w * (x - center) * (x - center)) / F.sum(w)).alias(f"var{g}__{i}"),
                ]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide_to_long(wide, covariates, ["n1", "n0", "mean1", "mean0", "var1", "var0"], list(keys))


def _in(treatment_col: str, group: int, column: str, value: str | None = None) -> Column:
    present = (named(treatment_col) == group) & named(column).isNotNull()
    return F.when(present, named(value or column))


def smd_of_moments() -> Column:
    spread = F.sqrt((F.coalesce("var1", F.lit(0.0)) + F.coalesce("var0", F.lit(0.0))) / 2)
    gap = F.col("mean1") - F.col("mean0")
    return F.when(gap.isNotNull(), F.when(spread == 0, 0.0).otherwise(gap / spread))


def ratio_of_moments() -> Column:
    return F.when(F.col("var0") != 0, F.col("var1") / F.col("var0"))


def _numeric(df: DataFrame, covariates: list[str]) -> list[str]:
    return [c for c in covariates if is_numeric(df, c)]


def _no_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def smd(df: DataFrame, treatment_col: str, covariates: list[str], weight_col: str | None = None) -> DataFrame:
    """Standardised mean difference (sample deviations; population ones if weighted)."""
    numeric = _numeric(df, covariates)
    if not numeric:
        return _complete(_no_rows(df, "variable string, smd double, abs_smd double"), df, covariates)
    moments = group_moments(df, treatment_col, numeric, weight_col)
    table = moments.select("variable", smd_of_moments().alias("smd")).withColumn("abs_smd", F.abs("smd"))
    return _complete(table, df, covariates)


def variance_ratio(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    numeric = _numeric(df, covariates)
    if not numeric:
        return _complete(_no_rows(df, "variable string, variance_ratio double"), df, covariates)
    moments = group_moments(df, treatment_col, numeric)
    return _complete(moments.select("variable", ratio_of_moments().alias("variance_ratio")), df, covariates)


def _counts_by_group(long_df: DataFrame, treatment_col: str) -> DataFrame:
    """Distinct values with their counts in both groups; equal values meet before any ordering."""
    return long_df.groupBy("variable", "value").agg(
        F.count_if(named(treatment_col) == 1).alias("k1"), F.count_if(named(treatment_col) == 0).alias("k0")
    ).where(F.col("k1") + F.col("k0") > 0)


def ks_test(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    """Largest gap between the two empirical distribution functions, for numeric covariates with > 2 values."""
    numeric = _numeric(df, covariates)
    if not numeric:
        return _complete(_no_rows(df, "variable string, ks_stat double, ks_p double"), df, covariates)
    counts = materialise(_counts_by_group(melt_numeric(df, numeric, [treatment_col]), treatment_col))
    steps = running_totals(counts, ["variable"], ["value"], {"c1": "k1", "c0": "k0"})
    totals = counts.groupBy("variable").agg(
        F.sum("k1").alias("n1"), F.sum("k0").alias("n0"), F.count(F.lit(1)).alias("levels")
    )
    totals = totals.where((F.col("levels") > 2) & (F.col("n1") > 0) & (F.col("n0") > 0))
    gaps = attach(steps, totals, ["variable"], rows=len(numeric))
    stat = gaps.groupBy("variable").agg(
        F.max(F.abs(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0"))).alias("ks_stat"),
        F.max("n1").alias("n1"),
        F.max("n0").alias("n0"),
    )
    table = stat.select("variable", "ks_stat", ks_p_value(F.col("ks_stat"), F.col("n1"), F.col("n0")).alias("ks_p"))
    return _complete(table, df, covariates)


def yates_chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the 2x2 table [[a, b], [c, d]] with continuity correction; NULL if a margin is empty."""
    n = a + b + c + d
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a.cast("double") * d - b.cast("double") * c) - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * gap * gap / margins)


def chi_square(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    """Independence of treatment and a covariate with at most two distinct values; only those are grouped."""
    few = [c for c, values in few_values(df, covariates, 2).items() if values is not None]
    if not few:
        return _complete(_no_rows(df, "variable string, chi2_stat double"), df, covariates).withColumn("chi2_p", F.lit(None).cast("double"))
    counts = _counts_by_group(melt_text(df, few, [treatment_col]), treatment_col)
    cells = counts.groupBy("variable").agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum("k1").alias("n1"),
        F.sum("k0").alias("n0"),
        F.max_by("k1", "value").alias("a"),
        F.max_by("k0", "value").alias("c"),
    )
    a, c = F.col("a"), F.col("c")
    stat = F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("levels") <= 2), F.when(
        F.col("levels") == 1, 0.0
    ).otherwise(yates_chi2(a, F.col("n1") - a, c, F.col("n0") - c)))
    table = cells.select("variable", stat.alias("chi2_stat"))
    return _complete(table, df, covariates).withColumn("chi2_p", chi2_p_value(F.col("chi2_stat")))


def bin_index(x: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Equal-width bin, closed on the right only for the last one; settled against the bin edges."""
    width = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    return (
        F.when(x < low + guess * width, guess - 1)
        .when((guess < bins - 1) & (x >= low + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )


def jensen_shannon(df: DataFrame, treatment_col: str, covariates: list[str], bins: int = BINS) -> DataFrame:
    """Base-2 divergence between the groups' distributions: binned if numeric, per category otherwise."""
    numeric = _numeric(df, covariates)
    in_groups = named(treatment_col).isin(0, 1)
    shaped = df
    skip = []
    if numeric:
        spans = df.agg(
            *[F.min(F.when(in_groups, named(c))).cast("double").alias(f"lo{i}") for i, c in enumerate(numeric)],
            *[F.max(F.when(in_groups, named(c))).cast("double").alias(f"hi{i}") for i, c in enumerate(numeric)],
        ).first()
        binned = {}
        for i, c in enumerate(numeric):
            low, high = spans[f"lo{i}"], spans[f"hi{i}"]
            if low is None or low == high:
                skip.append(c)
            else:
                binned[c] = bin_index(named(c).cast("double"), F.lit(low), F.lit(high), bins)
        shaped = df.withColumns(binned) if binned else df
    used = [c for c in covariates if c not in skip]
    if not used:
        return _complete(_no_rows(df, "variable string, jensen_shannon double"), df, covariates)
    counts = _counts_by_group(melt_text(shaped, used, [treatment_col]), treatment_col)
    totals = counts.groupBy("variable").agg(F.sum("k1").alias("n1"), F.sum("k0").alias("n0"))
    shares = attach(counts, totals, ["variable"], rows=len(used)).where((F.col("n1") > 0) & (F.col("n0") > 0))
    p, q = F.col("k1") / F.col("n1"), F.col("k0") / F.col("n0")
    half = lambda part: F.when(part > 0, part * F.log2(2 * part / (p + q))).otherwise(0.0)
    table = shares.groupBy("variable").agg((F.sum(half(p) + half(q)) / 2).alias("jensen_shannon"))
    return _complete(table, df, covariates)


def balance_table(
    before: DataFrame,
    after: DataFrame,
    treatment_col: str,
    matching: list[str],
    evaluation: list[str] = (),
    metrics: list[str] = ("smd",),
    weight_col: str | None = None,
) -> DataFrame:
    """Balance before and after matching. Means and variances of all covariates and both phases come
    from one aggregate; the distribution tests look at the matched rows only. ``weight_col``
    weights the rows after matching."""
    covariates = list(dict.fromkeys([*matching, *evaluation]))
    numeric = _numeric(before, covariates)
    rows = [(i, c, c in matching) for i, c in enumerate(covariates)]
    table = before.sparkSession.createDataFrame(rows, "_place int, variable string, is_matching_covariate boolean")
    weigh = [F.lit(1.0).alias("_weight")] if weight_col is None else []
    one = before.select(F.lit("before").alias("_phase"), named(treatment_col), *map(named, numeric), F.lit(1.0).alias("_weight"))
    two = after.select(F.lit("after").alias("_phase"), named(treatment_col), *map(named, numeric),
                       *(weigh or [named(weight_col).cast("double").alias("_weight")]))
    fields = ["smd_before", "abs_smd_before", "smd_after", "abs_smd_after"]
    if numeric:
        moments = group_moments(one.unionByName(two), treatment_col, numeric, None, ["_phase"])
        stats = moments.select("_phase", "variable", smd_of_moments().alias("smd"), ratio_of_moments().alias("ratio"))
        if weight_col is not None:
            weighted = group_moments(two, treatment_col, numeric, "_weight")
            stats = stats.where("_phase = 'before'").unionByName(
                weighted.select(F.lit("after").alias("_phase"), "variable", smd_of_moments().alias("smd"), ratio_of_moments().alias("ratio"))
            )
        at = lambda phase, c: F.max(F.when(F.col("_phase") == phase, named(c)))
        wide = stats.groupBy("variable").agg(
            *[at(ph, "smd").alias(f"smd_{ph}") for ph in ("before", "after")],
            *[F.abs(at(ph, "smd")).alias(f"abs_smd_{ph}") for ph in ("before", "after")],
            *[at(ph, "ratio").alias(f"variance_ratio_{ph}") for ph in ("before", "after")],
        )
    else:
        wide = _no_rows(before, "variable string, " + ", ".join(
            f"{c} double" for c in [*fields, "variance_ratio_before", "variance_ratio_after"]))
    if "variance_ratio" in metrics:
        fields += ["variance_ratio_before", "variance_ratio_after"]
    parts = [wide.select("variable", *fields)]
    for name, test in (("ks_test", ks_test), ("chi_square", chi_square), ("jensen_shannon", jensen_shannon)):
        if name in metrics:
            parts.append(test(after, treatment_col, covariates))
    for part in parts:
        fields_of = [c for c in part.columns if c != "variable"]
        table = table.join(part, "variable", "left").select(*table.columns, *fields_of)
    return _in_order(table).drop("_place")


def max_abs_smd(table: DataFrame) -> DataFrame:
    """Largest remaining imbalance; 0 if no covariate has one."""
    return table.agg(F.coalesce(F.max("abs_smd_after"), F.lit(0.0)).alias("max_abs_smd_after"))
