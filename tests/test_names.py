"""Columns and values with any signs in them, recoding across types, strata that must not meet, merge roles."""

import random

import pytest
from pyspark.sql import functions as F

from pairwell.config import ColumnSpec, EncodingRule, TableConfig
from pairwell.errors import ConfigError, MergeError
from pairwell.functions.tools import row_bytes
from pairwell.operators import clean, cohort, columns, encode, profile
from pairwell.plans.run import run_matching
from pairwell.plans.spec import MatchSpec
from pairwell.sources import merge


def dotted(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["St. Louis", "a`b", "x"]), rng.gauss(0, 1) + (i % 3 == 0), int(i % 3 == 0), i % 4) for i in range(90)]
    return spark.createDataFrame(rows, "pid long, `home.city` string, `sepal.length` double, treatment int, few int")


def test_run_with_dotted_names_and_values(spark):
    df = dotted(spark)
    assert "sepal.length" in columns.infer_config(df).names()
    spec = {
        "population": {"treatment_col": "treatment", "id_col": "pid"}, "covariates": {"matching_covariates": ["sepal.length", "few"]},
        "constraints": {"exact_match_covariates": ["home.city"]}, "diagnostics": {"balance_metrics": ["smd", "ks_test"]},
    }
    result = run_matching(df, MatchSpec.from_dict(spec))
    assert result.success, result.error
    config = TableConfig({
        "pid": ColumnSpec("pid", id=True), "treatment": ColumnSpec("treatment", categorical=True, type="int"), "sepal.length": ColumnSpec("sepal.length", numerical=True),
        "home.city": ColumnSpec("home.city", categorical=True, encoding=EncodingRule(True, "one_hot")),
    })
    spec["covariates"]["matching_covariates"], spec["constraints"] = ["sepal.length", "home.city"], {}
    result = run_matching(df, MatchSpec.from_dict(spec), config)
    assert result.success, result.error


def test_recoding_keeps_values_of_another_type(spark):
    df = spark.createDataFrame([(1, 1.5), (2, 2.0), (3, None)], "a int, b double")
    config = TableConfig({
        "a": ColumnSpec("a", categorical=True, mappings={"1": "one", "x": "never"}), "b": ColumnSpec("b", numerical=True, mappings={"2": 7, "z": 1}),
    })
    assert [tuple(r) for r in clean.preprocess(df, config).orderBy("a").collect()] == [("2", 7.0), ("3", None), ("one", 1.5)]


def test_different_values_are_different_strata(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("None", "c"), ("\\None", "c"), ("a\\|b", "c")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert cohort.with_stratum(df, ["x", "y"]).select("stratum").distinct().count() == len(rows)
    assert cohort.with_stratum(df.limit(1).select(F.lit("n").alias("x"), F.lit("s").alias("y")), ["x", "y"]).first().stratum == "n|s"


def test_profile_of_categories_only(spark):
    df = dotted(spark)
    found = profile.profile_population(df, "treatment", ["home.city", "few"])
    assert found.densities.count() == 0 and found.descriptive_stats.where("variable = 'few'").count() == 2
    assert {r.variable for r in found.frequencies.collect()} == {"home.city", "few"}
    assert {r.variable for r in profile.profile_population(df, "treatment", ["sepal.length"]).densities.collect()} == {"sepal.length"}


def test_one_hot_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(encode, "ONE_HOT_VALUES", 2)
    config = TableConfig({"home.city": ColumnSpec("home.city", categorical=True, encoding=EncodingRule(True, "one_hot"))})
    with pytest.raises(ConfigError):
        encode.fit_encoding(dotted(spark), config)


def test_roles_that_disagree(spark):
    df = spark.createDataFrame([(1, 2, 3)], "age int, score int, visit_id int")
    left = TableConfig({"age": ColumnSpec("age", numerical=True), "score": ColumnSpec("score", numerical=True)})
    right = TableConfig({"age": ColumnSpec("age", categorical=True), "score": ColumnSpec("score", numerical=True)})
    found = merge.check_config_compatibility(df, df, left, right)
    assert found.compatible_columns == ["score"] and found.mismatched_columns == [("age", "the first table uses it as numerical, the second as categorical")]
    assert merge.check_compatibility(df, df).id_like_columns == ["visit_id"]
    with pytest.raises(MergeError):
        merge.merge_populations(df, df, treatment_col="age")
    with pytest.raises(MergeError):
        merge.merge_populations(df, df, columns=["absent"])
    with pytest.raises(MergeError):
        merge.merge_populations(df.select("visit_id"), df)


def test_row_width_counts_arrays(spark):
    df = spark.createDataFrame([(1, [1.0])], "k long, mu array<double>")
    assert row_bytes(df, 1000) == 8 + 8000


def test_entry_without_a_library_of_the_optional_part():
    """Only the optional queries go when something that only they need is missing."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules.update(dict.fromkeys(['ahocorasick', 'regex'])); import __spark_entry__ as e; print(len(e.queries()), any(n[:2] == 'op' and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 70 and out[1] == "False"
