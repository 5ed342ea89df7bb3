"""Configurations, cleaning, role inference, statistics, loading and merging."""

import json

import pytest
from pairwell.functions.tools import few_values

from pairwell.config import (
    ColumnSpec, EncodingRule, MissingRule, ScalingRule, TableConfig, config_from_json, config_to_json, read_legacy_config,
)
from pairwell.errors import ConfigError, LoadError, MergeError
from pairwell.operators import clean, columns
from pairwell.sources import files, merge


@pytest.mark.parametrize(
    "bad",
    [
        lambda: ColumnSpec("x", categorical=True, numerical=True),
        lambda: ColumnSpec("x", id=True, numerical=True),
        lambda: ColumnSpec("x", numerical=True, encoding=EncodingRule(True, "ordinal")),
        lambda: ColumnSpec("x", categorical=True, scaling=ScalingRule(True, "standard")),
        lambda: ScalingRule(True, "none"),
        lambda: ScalingRule(False, "minmax"),
        lambda: EncodingRule(True, "one_hot", ("a",)),
        lambda: MissingRule("replace"),
        lambda: TableConfig({"a": ColumnSpec("b")}),
        lambda: config_from_json('{"a": {"new_name": "a", "colour": 1}}'),
        lambda: config_from_json("not json"),
    ],
)
def test_contradictions_are_refused(bad):
    with pytest.raises(ConfigError):
        bad()


def test_json_round_trip_and_legacy_import():
    config = TableConfig({"a": ColumnSpec("a", numerical=True, semantic_roles={"clinical"}, scaling=ScalingRule(True, "robust"))})
    text = config_to_json(config)
    assert config_from_json(text) == config == config_from_json(json.dumps(json.loads(text)["columns"]))
    old, report = read_legacy_config({"a": {"new_name": "a", "numerical": True, "clinical": True, "gene": False, "odd": 3}})
    assert old["a"].semantic_roles == {"clinical"}
    assert [(r["legacy_field"], r["mapped_to"]) for r in report] == [("clinical", "semantic_roles"), ("gene", "ignored"), ("odd", "ignored")]


def test_cleaning_strategies(spark):
    rows = [(1.5, 30, "Milano"), (None, None, "NA"), (3.2, 50, "Roma"), (4.0, 20, "")]
    df = spark.createDataFrame(rows, "score double, age int, city string")

    def result(strategy, **kw):
        rule = MissingRule(strategy, **kw)
        config = TableConfig({"age": ColumnSpec("age", numerical=True, missing_data_management=rule), "city": ColumnSpec("city", categorical=True, missing_data_management=MissingRule("impute" if strategy != "maintain" else strategy, imputer="most_frequent"))})
        return [tuple(r) for r in clean.preprocess(df, config).collect()]

    assert result("drop") == [(30, "Milano"), (50, "Roma"), (20, None)]
    assert [r[0] for r in result("replace", value=0)] == [30, 0, 50, 20]
    assert [r[1] for r in result("maintain")] == ["Milano", "NA", "Roma", ""]
    with pytest.raises(ConfigError):
        clean.preprocess(df, TableConfig({"zip": ColumnSpec("zip")}))
    assert clean.filter_rows(df, [("age", "ne", 30)]).count() == 2
    with pytest.raises(ConfigError):
        clean.filter_rows(df, [("age", "like", 30)])


def test_role_inference(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 0, 0.0D, 1, 20, 21.5D, 2.0D, CAST(NULL AS DOUBLE), true, 'x', DATE '2020-01-01'),
        (2, 1, 1.0D, 1, 35, 30.0D, 5.0D, NULL, false, 'y', DATE '2020-01-02')
        AS t(patient_id, flag, flag_f, same, age, bmi, whole, void, b, s, d)"""
    )
    config = columns.infer_config(df)
    roles = {n: (c.categorical, c.numerical, set(c.semantic_roles)) for n, c in config.columns.items()}
    assert config["patient_id"].id
    assert roles["flag"] == roles["flag_f"] == roles["same"] == roles["b"] == (True, False, {"binary"})
    assert roles["age"] == roles["whole"] == (False, True, {"discrete"})
    assert roles["bmi"] == (False, True, {"continuous"}) and roles["void"] == (False, True, set())
    assert roles["s"] == (True, False, set()) and roles["d"] == (False, False, set())
    check = columns.validate_config(df.drop("age"), config)
    assert not check.is_valid and check.missing_in_dataset == ["age"]


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, 40, "north"), (2, None, "south"), (3, 50, "north"), (4, 60, "east")], "patient_id long, age int, region string")
    stats = {r["name"]: r for r in columns.column_stats(df, columns.infer_config(df)).collect()}
    assert stats["age"].missing_pct == 0.25 and stats["age"].distinct_values is None
    assert stats["region"].distinct_values == ["east", "north", "south"]


def test_merging(spark):
    a = spark.createDataFrame([(1, 45, 20.0, 1), (2, 60, 30.0, 0)], "patient_id long, age int, score double, treatment int")
    b = spark.createDataFrame([("x", 50.5, 22.0, "north")], "subject_id string, age double, score double, region string")
    assert merge.check_compatibility(a, b).common_columns == ["age", "score"]
    both = merge.merge_populations(a, b, id_a="patient_id", id_b="subject_id")
    assert sorted(map(tuple, both.select("age", "source_id", "treatment").collect())) == [(45.0, "1", 1), (50.5, "x", 0), (60.0, "2", 1)]
    text = b.withColumn("age", b.age.cast("string"))
    assert [m[0] for m in merge.check_compatibility(a, text).mismatches] == ["age"]
    for bad in (lambda: merge.merge_populations(a, b.select("region")), lambda: merge.merge_populations(a, b, treatment_col="age"), lambda: merge.merge_populations(a, b, columns=["zip"])):
        with pytest.raises(MergeError):
            bad()
    left, right = columns.infer_config(a), columns.infer_config(b).replacing("age", numerical=False, categorical=True, semantic_roles=())
    assert [m[0] for m in merge.check_config_compatibility(a, b, left, right).mismatched_columns] == ["age"]


def test_loading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n2,\n")
    (tmp_path / "b.TSV").write_text("id\tx\n1\t2\n")
    (tmp_path / "c.json").write_text('[{"id": 1}, {"id": 2}]')
    batch = files.load_many(spark, [f"{tmp_path}/{n}" for n in ("a.csv", "b.TSV", "c.json", "d.xlsx", "gone.csv")])
    assert {n: df.count() for n, df in batch.tables.items()} == {"a": 2, "b": 1, "c": 2}
    assert dict(batch.tables["a"].dtypes)["x"] == "double"
    assert len(batch.failures) == 2
    batch.raise_if_missing([f"{tmp_path}/a.csv"])
    with pytest.raises(LoadError):
        batch.raise_if_missing([f"{tmp_path}/gone.csv"])
    facts = files.describe_table(batch.tables["a"])
    assert (facts.n_rows, facts.n_columns, facts.preview.count()) == (2, 2, 2)


def test_few_values(spark):
    import datetime
    import decimal

    day = datetime.date(2020, 1, 1)
    rows = [(i, i % 3, None if i % 2 else f"v{i % 4}", float("nan") if i % 5 == 0 else float(i % 2), day if i else None, decimal.Decimal(i % 2), [i % 2], None) for i in range(400)]
    df = spark.createDataFrame(rows, "`a.b` long, few int, s string, x double, d date, m decimal(10,2), l array<int>, void string").repartition(40)
    got = few_values(df, df.columns, 3)
    assert got["a.b"] is None and got["few"] == [0, 1, 2] and got["s"] == ["v0", "v2"] and got["x"][:2] == [0.0, 1.0] and len(got["x"]) == 3
    assert got["d"] == [day] and got["m"] == [0, 1] and got["l"] == ["[0]", "[1]"] and got["void"] == []
    assert few_values(df.limit(0), ["few"], 2) == {"few": []} and few_values(df, ["few"], 2) == {"few": None}


def test_size_of_a_materialised_table_is_that_of_its_files(spark):
    """Rounds of joins: the size Spark plans with stays that of the rows. It was the product of all sides before, with digits
    that multiplied every round."""
    from pyspark.sql import functions as F

    from pairwell.functions.tools import materialise

    rows = spark.range(50)
    for _ in range(6):
        rows = materialise(rows.join(rows.select((F.col("id") * 1).alias("id")), "id"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert rows.count() == 50 and size < 1 << 20


def test_materialised_tables_keep_types_parquet_cannot_hold(spark):
    from pyspark.sql import functions as F

    from pairwell.functions.tools import materialise

    df = spark.range(3).select("id", F.lit(None).alias("nothing"), F.expr("make_interval(0, 0, 0, id)").alias("gap"))
    kept = materialise(df)
    assert kept.dtypes == df.dtypes and [r.id for r in kept.select("id").orderBy("id").collect()] == [0, 1, 2]
