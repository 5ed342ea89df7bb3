"""Hand-computable values of the statistics."""

import math

import numpy as np
import pytest

from pairwell.config import ColumnSpec, EncodingRule, MissingRule, ScalingRule, TableConfig
from pairwell.errors import ConfigError, MatchError
from pairwell.functions.order import exact_quantiles, running_total
from pairwell.operators import balance, cohort, encode, impute, profile, propensity, scale
from pairwell.operators.distance import PairRule, Window, nearest_pairs


def groups(spark, treated, control):
    rows = [(1, x) for x in treated] + [(0, x) for x in control]
    kind = "string" if isinstance(rows[0][1], str) else "double"
    return spark.createDataFrame(rows, f"t int, x {kind}")


def one(df):
    return df.first().asDict()


def test_smd_and_variance_ratio(spark):
    df = groups(spark, [1.0, 3.0], [2.0, 6.0])
    assert one(balance.smd(df, "t", ["x"]))["smd"] == pytest.approx(-2 / math.sqrt(5))
    assert one(balance.variance_ratio(df, "t", ["x"]))["variance_ratio"] == pytest.approx(0.25)
    table = balance.smd(groups(spark, ["a"], ["b"]), "t", ["x"])
    assert one(table) == {"variable": "x", "smd": None, "abs_smd": None}
    assert one(balance.smd(groups(spark, [2.0, 2.0], [2.0, 2.0]), "t", ["x"]))["smd"] == 0.0


def test_distribution_tests(spark):
    ks = one(balance.ks_test(groups(spark, [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]), "t", ["x"]))
    assert ks["ks_stat"] == pytest.approx(1 / 3) and 0 < ks["ks_p"] <= 1
    assert one(balance.ks_test(groups(spark, [0.0, 1.0], [1.0, 0.0]), "t", ["x"]))["ks_stat"] is None
    chi = one(balance.chi_square(groups(spark, ["y"] * 8 + ["n"] * 2, ["y"] * 3 + ["n"] * 7), "t", ["x"]))
    assert chi["chi2_stat"] == pytest.approx(20 * 40**2 / (10 * 10 * 11 * 9))
    assert chi["chi2_p"] == pytest.approx(math.erfc(math.sqrt(chi["chi2_stat"] / 2)))
    assert one(balance.chi_square(groups(spark, ["y"], ["y"]), "t", ["x"])) == {"variable": "x", "chi2_stat": 0.0, "chi2_p": 1.0}
    js = lambda a, b: one(balance.jensen_shannon(groups(spark, a, b), "t", ["x"]))["jensen_shannon"]
    assert js(["a", "b"], ["a", "b"]) == pytest.approx(0) and js(["a"], ["b"]) == pytest.approx(1)
    assert js([1.0, 1.0], [1.0]) is None and js([0.0, 1.0], [5.0, 9.0]) == pytest.approx(1)


def test_quantiles_and_positions(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(5)], "x double, k long")
    at = lambda m: exact_quantiles(df, ["x"], [0.3], method=m).first()["value"]
    assert at("nearest") == 1.0 and at("linear") == pytest.approx(1.2)
    many = spark.range(1000).selectExpr("id", "id % 3 = 0 AS hot").repartition(7)
    got = running_total(many.selectExpr("cast(hot as string) AS g", "id"), ["g"], ["id"]).collect()
    for g in ("true", "false"):
        assert [r.position for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == list(range(1, sum(r.g == g for r in got) + 1))


def test_scaling_and_encoding(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, None), (3.0, "a")], "x double, c string")
    config = TableConfig({
        "x": ColumnSpec("x", numerical=True, scaling=ScalingRule(True, "standard")),
        "c": ColumnSpec("c", categorical=True, encoding=EncodingRule(True, "one_hot")),
    })
    state = scale.fit_scaling(df, config)
    scaled = scale.scale(df, config, state)
    assert [r.x for r in scaled.orderBy("x").collect()] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert [r.x for r in scale.unscale(scaled, config, state).orderBy("x").collect()] == pytest.approx([1, 2, 3])
    codes = encode.fit_encoding(df, config)
    assert encode.expanded_names(config, codes, "c") == ["c__a", "c__b", "c__None"]
    unseen = encode.encode(spark.createDataFrame([(1.0, "z")], "x double, c string"), config, codes).first()
    assert (unseen["c__a"], unseen["c__b"], unseen["c__None"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ConfigError):
        scale.scale(df, config, scale.ScaleState({}, {}))


def test_long_ordinal_codes_are_joined(spark, monkeypatch):
    monkeypatch.setattr(encode, "INLINE_CODES", 2)
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    config = TableConfig({"c": ColumnSpec("c", categorical=True, encoding=EncodingRule(True, "ordinal"))})
    got = encode.encode(df, config, encode.fit_encoding(df, config)).collect()
    assert sorted((r.c for r in got), key=lambda v: (v is None, v)) == [0.0, 1.0, 2.0, None]


def test_nearest_donors(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, 1.5, None)], "id long, a double, b double")
    config = TableConfig({
        "id": ColumnSpec("id", id=True),
        "a": ColumnSpec("a", numerical=True),
        "b": ColumnSpec("b", numerical=True, missing_data_management=MissingRule("impute", imputer="knn")),
    })
    state = impute.fit_impute(df, config, "id")
    assert impute.impute(df, config, state, "id").where("id = 4").first()["b"] == pytest.approx(1.5)
    void = df.selectExpr("id", "a", "cast(null as double) AS b")
    with pytest.raises(ConfigError):
        impute.fit_impute(void, config, "id")


def test_chained_regressions(spark):
    rows = [(i, float(i), None if i % 4 == 0 else 3.0 * i + 1, None if i % 5 == 1 else 50.0 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    rule = MissingRule("impute", imputer="iterative")
    config = TableConfig({
        "id": ColumnSpec("id", id=True),
        "a": ColumnSpec("a", numerical=True),
        "b": ColumnSpec("b", numerical=True, missing_data_management=rule),
        "c": ColumnSpec("c", numerical=True, missing_data_management=rule),
    })
    state = impute.fit_impute(df, config)
    for r in impute.impute(df, config, state).collect():
        assert r.b == pytest.approx(3.0 * r.a + 1, abs=0.2) and r.c == pytest.approx(50.0 - r.a, abs=0.2)


@pytest.mark.parametrize("local", [4096, 0])
def test_chained_regressions_against_rounds_over_rows(spark, monkeypatch, local):
    monkeypatch.setattr(impute, "LOCAL_PATTERNS", local)
    rng = np.random.default_rng(3)
    names = ["a.b", "b", "c", "d"]
    full = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + [1000.0, -5, 3, 0]
    given = np.where(rng.random((300, 4)) < [0.1, 0.3, 0.2, 0.0], np.nan, full)
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(given)], "id long, `a.b` double, b double, c double, d double")
    rule = MissingRule("impute", imputer="iterative")
    config = TableConfig({"id": ColumnSpec("id", id=True), **{c: ColumnSpec(c, numerical=True, missing_data_management=rule) for c in names}})
    got = impute.impute(df, config, impute.fit_impute(df, config)).toPandas().sort_values("id")[names].to_numpy()

    holes = np.isnan(given)
    now = np.where(holes, np.nanmean(given, axis=0), given)
    for _ in range(impute.ROUNDS):
        before = now.copy()
        for t in np.argsort(holes.sum(axis=0), kind="stable"):
            others = [i for i in range(4) if i != t]
            x, y = now[~holes[:, t]][:, others], now[~holes[:, t], t]
            dx, dy = x - x.mean(axis=0), y - y.mean()
            w = impute._ridge(dx.T @ dx, dx.T @ dy, dy @ dy, len(y))
            now[holes[:, t], t] = y.mean() + (now[holes[:, t]][:, others] - x.mean(axis=0)) @ w
        if np.abs(now - before).max() < impute.ROUND_TOLERANCE * np.nanmax(np.abs(given)):
            break
    assert got == pytest.approx(now, abs=1e-6)


def test_mixed_distances(spark):
    rows = [(1, 1, 20.0, "north"), (2, 0, 30.0, "south"), (3, 0, 40.0, "south")]
    df = cohort.resolve_direction(cohort.with_stratum(spark.createDataFrame(rows, "id long, t int, age double, region string")), "t")
    rule = PairRule(("age", "region"), "gower", frozenset({"region"}))
    assert nearest_pairs(df, "id", rule, 1).first()["dist"] == pytest.approx(0.75)
    rule = PairRule(("age", "region"), "weighted_hybrid", frozenset({"region"}))
    assert nearest_pairs(df, "id", rule, 1).first()["dist"] == pytest.approx(0.7)
    equal = PairRule(("age",), windows=(Window("region", 999.0),))
    assert nearest_pairs(df, "id", equal, 1).count() == 0
    with pytest.raises(MatchError):
        nearest_pairs(df, "id", PairRule(("age", "region"), "mahalanobis"), 1)


def test_windows_in_deviations(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 100.0)], "id long, t int, x double")
    df = cohort.resolve_direction(cohort.with_stratum(df), "t")
    assert nearest_pairs(df, "id", PairRule(("x",), windows=(Window("x", 1.0, "standard_deviation"),)), 1).count() == 0
    assert nearest_pairs(df, "id", PairRule(("x",), windows=(Window("x", 2.0, "standard_deviation"),)), 1).count() == 1


def test_density_integrates_to_one(spark):
    df = groups(spark, [float(i % 10) for i in range(60)], [float(i % 13) * 2 for i in range(60)])
    rows = sorted(profile.densities(df, "t", ["x"]).collect(), key=lambda r: r.point)
    assert len(rows) == 200
    area = sum((b.x - a.x) * (a.treated_density + b.treated_density) / 2 for a, b in zip(rows, rows[1:]))
    assert 0.8 < area < 1.001
    assert profile.routes(df, ["x"]) == (["x"], [])


def test_propensity_solves_its_first_order_condition(spark):
    rows = [(i, "s", int((i * 7) % 11 > 4 + (i % 3)), float(i % 17), float((i * i) % 23)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, stratum string, t int, a double, b double")
    spec = propensity.PropensitySpec(degree=2)
    model = propensity.fit_propensity(df, "t", ["a", "b"], spec)
    got = propensity.score(df, model).toPandas()
    state = model.state.first()
    terms = [got.a, got.b, got.a**2, got.a * got.b, got.b**2]
    assert (got["__ps__"] - got.t).sum() == pytest.approx(0, abs=1e-6)
    for j, m in enumerate(terms):
        z = (m - state["mu"][j]) / state["sd"][j]
        gradient = spec.C * ((got["__ps__"] - got.t) * z).sum() + state["beta"][j + 1]
        assert gradient == pytest.approx(0, abs=1e-6)
