import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwell.operators import greedy
from pairwell.operators.cohort import resolve_direction, with_stratum
from pairwell.operators.distance import PairRule, Window
from pairwell.operators.greedy import greedy_pairs


def serve(df, features, k, window=None):
    """Sequential greedy without replacement on a small frame."""
    pairs = []
    for _, part in df.groupby("s"):
        pool = part[part.t == 0].sort_values("id")
        free = dict.fromkeys(pool.id)
        xs = pool.set_index("id")[features]
        for _, q in part[part.t == 1].sort_values("id").iterrows():
            d = np.sqrt(((xs - q[features].astype(float)) ** 2).sum(axis=1))
            options = sorted((round(d[i], 9), i) for i in free if window is None or abs(xs.loc[i, features[0]] - q[features[0]]) <= window)
            for r, (dist, i) in enumerate(options[:k]):
                del free[i]
                pairs.append((q.id, i, r + 1))
    return sorted(pairs)


def frame(seed, n, share, grid, strata=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 5, (n, 2)).astype(float) if grid else rng.normal(size=(n, 2))
    return pd.DataFrame({"id": rng.permutation(n), "t": (rng.random(n) < share).astype(int), "s": rng.integers(0, strata, n), "x": x[:, 0], "y": x[:, 1]})


def run(spark, df, rule, k=1):
    cohort = resolve_direction(with_stratum(spark.createDataFrame(df), ["s"]), "t")
    got = greedy_pairs(cohort, "id", rule, k).collect()
    return sorted((r.query_id, r.pool_id, r.rank) for r in got)


@pytest.mark.parametrize("seed,n,share,grid,k", [(1, 120, 0.3, False, 1), (2, 150, 0.4, True, 2), (3, 100, 0.7, True, 1)])
def test_same_as_serving_one_by_one(spark, seed, n, share, grid, k):
    df = frame(seed, n, share, grid)
    assert run(spark, df, PairRule(("x", "y")), k) == serve(df, ["x", "y"], k)


def test_rounds_with_copies(spark, monkeypatch):
    """Small cells, lists that run out, copies in several parts, and a log that is joined every other round."""
    for name, value in {"SPARE_ENTRIES": 1, "MEMBER_PART": 4, "CELL_LISTS": 3, "SHORT_SHARE": 6, "LOG_PARTS": 2}.items():
        monkeypatch.setattr(greedy, name, value)
    df = frame(4, 46, 0.4, True, 1)
    df.loc[df.index[:16], ["x", "y"]] = 1.0
    rule = PairRule(("x", "y"), windows=(Window("x", 2.0),))
    assert run(spark, df, rule, 2) == serve(df, ["x", "y"], 2, 2.0)


def test_fewer_than_k_is_kept(spark):
    df = pd.DataFrame({"id": [1, 2, 3], "t": [1, 1, 0], "s": 0, "x": [0.0, 0.0, 1.0], "y": 0.0})
    assert run(spark, df, PairRule(("x", "y")), 2) == [(1, 3, 1)]


def test_row_layout_does_not_matter(spark):
    df = frame(5, 100, 0.4, True)
    shuffled = df.sample(frac=1, random_state=1)
    assert run(spark, df, PairRule(("x", "y"))) == run(spark, shuffled, PairRule(("x", "y")))
