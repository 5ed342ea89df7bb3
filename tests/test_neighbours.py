import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwell.operators import neighbours
from pairwell.operators.distance import PairRule, nearest_pairs
from pairwell.operators.neighbours import Geometry, nearest


def brute(q, p, geo, need):
    out = {}
    for _, a in q.iterrows():
        found = []
        for _, b in p[p.blk == a.blk].iterrows():
            num = 0.0
            for i in range(geo.n_num):
                gap = a[f"x{i}"] - b[f"x{i}"]
                num += gap * gap if geo.metric == "euclidean" else abs(gap) / (a[f"s{i}"] if geo.scaled else 1)
            mis = sum(a[c] != b[c] for c in geo.cs)
            d = geo.combine(num, float(mis), np.sqrt)
            if any(abs(a[f"x{i}"] - b[f"x{i}"]) > a[f"t{w}"] for w, i in enumerate(geo.windows_on)):
                continue
            if "bound" in p and not b["bound"] > a["prio"]:
                continue
            if d > a.get("reach", np.inf):
                continue
            found.append((round(d + b.get("extra", 0.0), 9), b["p"]))
        found.sort()
        n = int(a["need"]) if "need" in q else need
        out[(a["blk"], a["q"])] = found[:n]
    return out


def check(spark, q, p, geo, need, most):
    got = nearest(spark.createDataFrame(q), spark.createDataFrame(p), geo, most).toPandas()
    want = brute(q, p, geo, need)
    have = {k: [] for k in want}
    for r in got.sort_values("rank").itertuples():
        have[(r.blk, r.q)].append((round(r.dist, 9), r.p))
    assert have == want


@pytest.fixture
def tiny_cells(monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_UNITS", 16)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 10)


def make(seed, nq, npool, num, cat, grid):
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 6, (n, num)).astype(float) if grid else rng.normal(size=(n, num))
    frames = []
    for n, key in ((nq, "q"), (npool, "p")):
        f = pd.DataFrame(draw(n), columns=[f"x{i}" for i in range(num)])
        for j in range(cat):
            f[f"c{j}"] = rng.choice(list("abcde"), n)
        f["blk"] = rng.choice(["u", "v"], n, p=[0.8, 0.2])
        f[key] = np.arange(n)
        frames.append(f)
    return frames


def test_plain_distance_one_cell(spark):
    q, p = make(1, 30, 60, 2, 0, False)
    check(spark, q, p, Geometry("euclidean", 2), 3, 3)


def test_plain_distance_many_cells_with_copies(spark, tiny_cells):
    q, p = make(2, 40, 300, 2, 0, True)
    p.loc[p.index[:100], ["x0", "x1"]] = 2.0
    check(spark, q, p, Geometry("euclidean", 2), 4, 4)


def test_windows_and_reach(spark, tiny_cells):
    q, p = make(3, 40, 300, 2, 0, False)
    q["t0"], q["reach"] = 0.3, 0.5
    check(spark, q, p, Geometry("euclidean", 1, n_window=1, windows_on=(1,)), 5, 5)


@pytest.mark.parametrize("strip", [16_384, 30, 5])
def test_windows_as_range_join(spark, tiny_cells, monkeypatch, strip):
    """One window is enough, a second one is needed, and strips that no window makes small go through the cells."""
    monkeypatch.setattr(neighbours, "STRIP_UNITS", strip)
    q, p = make(8, 60, 300, 3, 0, False)
    p.loc[p.index[:80], "x1"] = q.x1.iloc[0] + 0.3  # a third in one strip, at the very edge of a window
    q.loc[q.index[:20], ["x1", "x2"]] = p[["x1", "x2"]].iloc[0].to_numpy()
    widths = {"u": (0.3, 0.4), "v": (0.5, 0.0)}  # v: only equal values
    p.loc[p.blk == "v", "x2"] = q.loc[q.blk == "v", "x2"].iloc[0]
    for f in (q, p):
        f["t0"], f["t1"] = f.blk.map(lambda b: widths[b][0]), f.blk.map(lambda b: widths[b][1])
    check(spark, q, p, Geometry("euclidean", 1, n_window=2, windows_on=(1, 2)), 5, 5)
    q["need"] = np.where(q.q % 4 == 0, 40, 1)
    check(spark, q, p, Geometry("euclidean", 1, n_window=2, windows_on=(1, 2)), None, None)


@pytest.mark.parametrize("strip", [16_384, 40])
def test_windows_over_a_dense_pool(spark, monkeypatch, strip):
    """The first window is narrowed, more than once for queries in thin places, and not at all for some."""
    monkeypatch.setattr(neighbours, "STRIP_UNITS", strip)
    q, p = make(12, 80, 1500, 2, 0, False)
    p.loc[p.index[:200], ["x0", "x1"]] = p[["x0", "x1"]].iloc[0].to_numpy()
    q.loc[q.index[:10], "x0"] += 6.0  # few units near, or none
    for f in (q, p):
        f["t0"], f["t1"] = 3.0, 1.5
    geo = Geometry("euclidean", 2, windows_on=(0, 1))
    check(spark, q, p, geo, 2, 2)
    q["need"], q["reach"] = np.where(q.q % 4 == 0, 30, 1), np.where(q.q % 3 == 0, 0.01, np.inf)
    p["bound"], q["prio"] = p.p.astype(float), q.q * 10.0
    check(spark, q, p, geo, None, None)


def test_pairs_of_a_query_do_not_grow_with_the_density_of_the_pool(spark, monkeypatch):
    from pairwell.operators.neighbours import Geometry, _search_cells

    asked, per_query = [], []
    monkeypatch.setattr(neighbours, "_search_cells", lambda *args: asked.append(args[:2]) or _search_cells(*args))
    rng = np.random.default_rng(13)
    for n in (2_000, 16_000):
        asked.clear()
        q = pd.DataFrame({"blk": "b", "q": np.arange(50), "x0": rng.random(50) * 100, "t0": 20.0})
        p = pd.DataFrame({"blk": "b", "p": np.arange(n), "x0": rng.random(n) * 100, "t0": 20.0})
        assert nearest(spark.createDataFrame(q), spark.createDataFrame(p), Geometry("euclidean", 1, windows_on=(0,)), 2).count() == 100
        pairs = 0
        for visits, units in asked:
            v, u = visits.select("cell", "x0", "t0").toPandas(), units.select("cell", "x0").toPandas()
            pairs += sum(((u.x0[u.cell == r.cell] - r.x0).abs() <= r.t0).sum() for r in v.itertuples())
        per_query.append(pairs / 50)
    assert per_query[1] < 2 * per_query[0], per_query


def test_mixed_distance(spark, tiny_cells):
    q, p = make(4, 40, 200, 1, 2, True)
    q["s0"] = 5.0
    check(spark, q, p, Geometry("gower", 1, 2, scaled=True), 3, 3)
    check(spark, q, p, Geometry("weighted", 1, 2, scaled=True, weight_num=0.6, weight_cat=0.4), 3, 3)


def test_long_and_unequal_lists(spark, tiny_cells):
    q, p = make(5, 20, 150, 2, 0, True)
    q["need"] = np.where(q.q % 5 == 0, 60, 2)
    check(spark, q, p, Geometry("euclidean", 2), None, None)


def test_bounds_and_extras(spark, tiny_cells):
    q, p = make(6, 30, 200, 2, 0, True)
    q["prio"], q["need"] = q.q.astype(float), 4
    p["bound"] = np.where(p.p % 3 == 0, p.p / 10.0, 1e18)
    check(spark, q, p, Geometry("euclidean", 2), None, None)
    check(spark, q, p.drop(columns="bound").assign(extra=(p.p % 7) / 2.0), Geometry("euclidean", 2), 4, None)


def test_mahalanobis_ties_of_mirrored_units_go_to_the_lowest_id(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, y, dx, dy = (int(v) for v in (rng.integers(0, 9000), rng.integers(0, 30), rng.integers(1, 40), rng.integers(0, 9)))
        units = [("query", x, y), ("pool", x + dx, y + dy), ("pool", x - dx, y - dy), ("pool", x + 500, y + 70), ("pool", x - 400, y + 90)]
        rows += [(10 * i + n, str(i), role, float(a), float(b)) for n, (role, a, b) in enumerate(units)]
    df = spark.createDataFrame(rows, "u long, stratum string, role string, a double, b double")
    found = nearest_pairs(df, "u", PairRule(("a", "b"), "mahalanobis"), 2).toPandas()
    assert len(found) == 600
    assert (found.pool_id - found.query_id).tolist() == found["rank"].tolist()
    assert (found.groupby("query_id").dist.nunique() == 1).all()


def test_one_cell_search_needs_bounded_memory_whatever_the_number_of_queries():
    import tracemalloc

    rng = np.random.default_rng(5)
    units = pd.DataFrame({"blk": "b", "p": np.arange(4096), "x0": rng.normal(size=4096), "x1": rng.normal(size=4096)})
    search, peaks = neighbours._cell_search(Geometry("euclidean", 2), set(units.columns), {"q"}), []
    for n in (2048, 8192):
        queries = pd.DataFrame({"blk": "b", "q": np.arange(n), "x0": rng.normal(size=n), "x1": rng.normal(size=n), "need": 1, "reach": np.inf})
        tracemalloc.start()
        assert len(search(queries, units)) == n
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 60, peaks
