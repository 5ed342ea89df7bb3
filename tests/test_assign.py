import itertools

import numpy as np
import pandas as pd
import pytest

from pairwell.operators import assign, greedy
from pairwell.operators.assign import optimal_pairs, ship, transport_selection
from pairwell.operators.cohort import resolve_direction, with_stratum
from pairwell.operators.distance import PairRule, Window


def cheapest(cost):
    """Largest, then cheapest matching by trying everything."""
    m, n = cost.shape
    for k in range(min(m, n), 0, -1):
        totals = [
            sum(cost[r, c] for r, c in zip(rows, cols))
            for rows in itertools.combinations(range(m), k)
            for cols in itertools.permutations(range(n), k)
        ]
        totals = [t for t in totals if np.isfinite(t)]
        if totals:
            return k, min(totals)
    return 0, 0.0


def exact(cost, supply=None, capacity=None):
    """Flow of the most mass at the least cost; rows may stay at home at a price above any rearrangement."""
    m = len(cost)
    supply = np.ones(m, int) if supply is None else supply
    capacity = np.ones(cost.shape[1], int) if capacity is None else capacity
    finite = cost[np.isfinite(cost)]
    home = np.full((m, m), np.inf)
    np.fill_diagonal(home, (finite.max() if finite.size else 0.0) * 2 * (m + 1) + 1)
    flow = ship(np.hstack([cost, home]), supply, np.concatenate([capacity, supply]))[:, : cost.shape[1]]
    return flow.sum(), (flow * np.where(flow > 0, cost, 0)).sum()


def test_cell_solver_against_all_matchings():
    rng = np.random.default_rng(0)
    for _ in range(150):
        cost = rng.integers(0, 8, (rng.integers(1, 5), rng.integers(1, 6))).astype(float)
        cost[rng.random(cost.shape) < 0.3] = np.inf
        assert exact(cost) == cheapest(cost)


def frame(seed, n, share, digits=2, features=1):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"id": np.arange(n), "t": (rng.random(n) < share).astype(int), "s": 0, "x": rng.normal(size=n).round(digits), "y": 0.0})
    return df.assign(y=rng.normal(size=n).round(digits)) if features == 2 else df


def distances(df, window=None):
    q, p = (df[df.t == k][["x", "y"]].to_numpy() for k in (1, 0))
    cost = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
    if window is not None:
        cost[np.abs(q[:, None, 0] - p[None, :, 0]) > window] = np.inf
    return cost


CASES = [  # rows, share of queries, digits kept, features, window, rows of a cell, first list
    (60, 0.3, 2, 1, None, 64, 16),
    (60, 0.7, 2, 1, 0.5, 64, 16),  # the pool asks, and some have no partner
    (130, 0.35, 3, 2, None, 12, 6),  # several cells, lists that must grow
    (120, 0.45, 0, 2, None, 12, 8),  # nearly all rows are copies
]


@pytest.mark.parametrize("n,share,digits,features,window,cell,first", CASES)
def test_optimal_pairs(spark, monkeypatch, n, share, digits, features, window, cell, first):
    monkeypatch.setattr(assign, "CELL", cell)
    monkeypatch.setattr(assign, "FIRST_LIST", first)
    df = frame(n + cell, n, share, digits, features)
    rule = PairRule(("x", "y"), windows=() if window is None else (Window("x", window),))
    got = optimal_pairs(resolve_direction(with_stratum(spark.createDataFrame(df)), "t"), "id", rule).toPandas()
    count, total = exact(distances(df, window))
    assert len(got) == count and got.query_id.is_unique and got.pool_id.is_unique
    at = df.set_index("id")[["x", "y"]]
    true = np.sqrt(((at.loc[got.query_id].to_numpy() - at.loc[got.pool_id].to_numpy()) ** 2).sum(axis=1))
    assert got.dist.to_numpy() == pytest.approx(true, abs=1e-6)
    assert got.dist.sum() == pytest.approx(total, abs=1e-6) and got.step.sum() < 1e-3


@pytest.mark.parametrize("n,target,digits,cell", [(60, 12, 2, 64), (100, 9, 1, 8)])
def test_transport(spark, monkeypatch, n, target, digits, cell):
    monkeypatch.setattr(assign, "CELL", cell)
    monkeypatch.setattr(assign, "FIRST_LIST", 6)
    df = frame(4, n, 0.3, digits, 2)
    cohort = resolve_direction(with_stratum(spark.createDataFrame(df)), "t")
    found = []
    flow = assign._flow
    monkeypatch.setattr(assign, "_flow", lambda *a: found.append(flow(*a)) or found[-1])
    got = transport_selection(cohort, "id", PairRule(("x", "y")), target).toPandas()
    cost = distances(df)
    mass, total = exact(cost, np.full(len(cost), target), np.full(cost.shape[1], len(cost)))
    shipped = found[0].toPandas()
    assert shipped.mass.sum() == mass == target * len(cost)
    assert (shipped.mass * shipped.dist).sum() == pytest.approx(total, abs=1e-6)
    assert len(got) == target and got.pool_id.is_unique and got.weight.max() <= 1 / target + 1e-12
    near = pd.Series(cost.min(axis=0), index=df[df.t == 0].id)
    assert got.dist.to_numpy() == pytest.approx(near.loc[got.pool_id].to_numpy())


def test_greedy_costs_more_than_optimal(spark):
    # Distances [[1, 2], [1, 10]] cannot lie on a line; the same effect with three points can.
    df = pd.DataFrame({"id": [1, 2, 3, 4], "t": [1, 1, 0, 0], "s": 0, "x": [1.0, 0.0, 0.9, 3.0], "y": 0.0})
    cohort = resolve_direction(with_stratum(spark.createDataFrame(df)), "t")
    one = greedy.greedy_pairs(cohort, "id", PairRule(("x", "y"))).toPandas().dist.sum()
    best = optimal_pairs(cohort, "id", PairRule(("x", "y"))).toPandas().dist.sum()
    assert one == pytest.approx(3.1) and best == pytest.approx(2.9)


@pytest.mark.parametrize("share,digits,largest", [(0.25, 3, 512), (0.45, 1, 512), (0.6, 3, 512), (0.5, 2, 12)])
def test_on_a_line_runs_are_settled_without_a_search(spark, monkeypatch, share, digits, largest):
    """Two strata; copies with two decimals or one; with a small bound of a run the large ones go to the auction."""
    monkeypatch.setattr(assign, "LARGEST_CELL", largest)
    searched = []
    find = assign.nearest
    monkeypatch.setattr(assign, "nearest", lambda *a: searched.append(a) or find(*a))
    df = frame(11, 120, share, digits).assign(s=lambda d: d.id % 2)
    got = optimal_pairs(resolve_direction(with_stratum(spark.createDataFrame(df), ["s"]), "t"), "id", PairRule(("x",))).toPandas()
    assert got.query_id.is_unique and got.pool_id.is_unique and bool(searched) == (largest < 512)
    x = df.set_index("id").x
    assert got.dist.to_numpy() == pytest.approx(np.abs(x.loc[got.query_id].to_numpy() - x.loc[got.pool_id].to_numpy()))
    for s, part in df.groupby("s"):
        cost = distances(part)
        count, total = exact(cost if len(cost) <= cost.shape[1] else cost.T)
        mine = got[got.stratum == str(s)]
        assert len(mine) == count and mine.dist.sum() == pytest.approx(total, abs=1e-6)
