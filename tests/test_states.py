"""Fitted state saved, read back and applied to another table."""

import datetime
import decimal

import pytest

from pairwell.config import ColumnSpec, EncodingRule, MissingRule, ScalingRule, TableConfig
from pairwell.errors import StoreError
from pairwell.operators import encode, impute, propensity, scale
from pairwell.sources.states import FittedState, load_state, save_state, versions

SCHEMA = "id long, stratum string, t int, x double, y double, z double, place string, day date, price decimal(8,2)"


def rows(n, shift):
    day = datetime.date(2024, 1, 1)
    return [
        (i, "s", (i * 7 + shift) % 3 % 2, None if i % 5 == 0 else float(i), None if i % 4 == 0 else 2.0 * i + 1, None if i % 6 == 0 else 3.0 - i,
         f"p{(i * 5) % 13}", day + datetime.timedelta(days=i % 3), decimal.Decimal(i % 4) / 2)
        for i in range(n)
    ]


CONFIG = TableConfig({
    "id": ColumnSpec("id", id=True),
    "x": ColumnSpec("x", numerical=True, missing_data_management=MissingRule("impute", imputer="knn"), scaling=ScalingRule(True, "minmax")),
    "y": ColumnSpec("y", numerical=True, missing_data_management=MissingRule("impute", imputer="iterative")),
    "z": ColumnSpec("z", numerical=True, missing_data_management=MissingRule("impute", imputer="median")),
    "place": ColumnSpec("place", categorical=True, missing_data_management=MissingRule("impute", imputer="most_frequent"), encoding=EncodingRule(True, "ordinal")),
    "day": ColumnSpec("day", categorical=True, encoding=EncodingRule(True, "one_hot")),
    "price": ColumnSpec("price", categorical=True, encoding=EncodingRule(True, "ordinal")),
})


def prepared(df, state):
    ready = impute.impute(df, CONFIG, state.impute, "id")
    ready = encode.encode(scale.scale(ready, CONFIG, state.scale), CONFIG, state.encode)
    return sorted(map(tuple, propensity.score(ready, state.propensity).collect()))


def fitted(spark, n):
    df = spark.createDataFrame(rows(n, 0), SCHEMA)
    fills = impute.fit_impute(df, CONFIG, "id")
    whole = impute.impute(df, CONFIG, fills, "id")
    scaling, codes = scale.fit_scaling(whole, CONFIG), encode.fit_encoding(whole, CONFIG)
    ready = encode.encode(scale.scale(whole, CONFIG, scaling), CONFIG, codes)
    return FittedState(fills, scaling, codes, propensity.fit_propensity(ready, "t", ["x", "place"], propensity.PropensitySpec(degree=2)))


@pytest.mark.parametrize("inline", [500, 5])
def test_round_trip(spark, tmp_path, monkeypatch, inline):
    monkeypatch.setattr(encode, "INLINE_CODES", inline)  # 5: codes of a column in a table of their own
    folder = f"{tmp_path}/state"
    with pytest.raises(StoreError):
        load_state(spark, folder)
    first = fitted(spark, 60)
    assert save_state(spark, first, folder) == 1
    assert save_state(spark, FittedState(scale=first.scale), folder) == 2
    other = spark.createDataFrame(rows(25, 1), SCHEMA)
    read = load_state(spark, folder, 1)
    assert prepared(other, read) == prepared(other, first)
    assert read.impute.steps == first.impute.steps and read.encode.categories == first.encode.categories
    last = load_state(spark, folder)
    assert last.version == 2 and last.impute is None and last.scale == first.scale
    assert sorted(r.version for r in versions(spark, folder).collect()) == [1, 2]
    with pytest.raises(StoreError):
        load_state(spark, folder, 3)
