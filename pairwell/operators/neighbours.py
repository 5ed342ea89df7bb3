"""Exact k nearest pool units per query, without ever forming a group's full pair product.

The pool is cut into cells of bounded size by repeated quantile splits (all cells of a
level in one pass). A query first looks into its own cell, which bounds how far its k-th
neighbour can be, then only visits the cells that this ball (and its caliper windows) can
touch. Distances are computed with numpy on one cell times one bounded chunk of queries.

With a caliper window the search is a range join instead: both sides are cut into strips as wide as the
window, every pool unit also goes to the two strips beside its own, and one shuffle brings a query together with all
units it may have. Strips with more than ``STRIP_UNITS`` units are cut by the next window too; queries
whose strip stays larger than that go through the cells. Where a window holds many more units than are asked for, it is
narrowed first: who finds enough units no farther than the narrow window reaches has them all, so the pairs of a query do
not grow with the density of the pool. Inside a strip, queries and units are read in the order of the window's column.

Query columns: ``blk, q, need, x0.., c0..`` and optionally ``reach`` (largest allowed
distance), ``t0..`` (window tolerances), ``s0..`` (divisors of the numeric
differences, or a quadratic form and its divisor) and ``prio`` (only units whose ``bound`` is larger qualify).
Pool columns: ``blk, p, x0.., c0..`` and optionally ``bound`` and ``extra`` (a
non-negative amount added to every distance to that unit).
The first ``n_num`` numeric columns make up the distance, the others carry windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running_total
from ..functions.tools import BROADCAST_ROWS, attach, materialise, named

CELL_UNITS = 4096
CHUNK_QUERIES = 8192
STEP_PAIRS = 1 << 19  # pairs of a cell whose distances a task holds at once
FAN_OUT = 32
STRIP_UNITS = 16_384
NARROW_STRIP = 8192  # units of a strip, about, where the window is narrowed
NARROW_REACH = 16  # a strip is at most so many narrowed windows wide
SPARE_SHARE = 4  # units expected in a narrowed window for one that is needed
WIDER = 8  # so many times wider is the next window for queries that did not find enough
BAND_QUERIES = 128  # queries next to each other in the window's column that are compared together
LONG_LIST = 100_000  # longer neighbour lists are ranked across tasks
SLACK = 1e-9  # relative room for rounding when a cell is ruled out
STRIP_SLACK = 1e-6  # so much wider than the window is a strip, so that rounding never parts a pair by two strips


@dataclass(frozen=True)
class Geometry:
    """How two units are compared."""

    metric: str  # euclidean | gower | weighted
    n_num: int
    n_cat: int = 0
    n_window: int = 0
    weight_num: float = 1.0
    weight_cat: float = 1.0
    scaled: bool = False
    windows_on: tuple[int, ...] = ()  # numeric columns that carry a window
    form: bool = False  # the distance is a quadratic form of the differences in the ``n_num`` columns after the first

    @property
    def width(self) -> int:
        return self.n_num + self.n_window

    @property
    def xs(self) -> list[str]:
        return [f"x{i}" for i in range(self.width)]

    @property
    def cs(self) -> list[str]:
        return [f"c{i}" for i in range(self.n_cat)]

    @property
    def ss(self) -> list[str]:
        if self.form:
            return [f"s{i}" for i in range(self.n_num * (self.n_num + 1) // 2 + 1)]
        return [f"s{i}" for i in range(self.n_num)] if self.scaled else []

    @property
    def ts(self) -> list[str]:
        return [f"t{i}" for i in range(len(self.windows_on))]

    def combine(self, numeric, mismatches, sqrt):
        """Distance from the summed numeric part and the number of differing categories."""
        if self.metric == "euclidean":
            return sqrt(numeric)
        if self.metric == "gower":
            return (numeric + mismatches) / float(self.n_num + self.n_cat)
        total = None
        if self.n_num:
            total = self.weight_num * (numeric / float(self.n_num))
        if self.n_cat:
            share = self.weight_cat * (mismatches / float(self.n_cat))
            total = share if total is None else total + share
        return total


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


# ---------------------------------------------------------------- cells


def _coordinates(df: DataFrame, geo: Geometry, names: list[str]) -> DataFrame:
    """Columns ``z0..``: the numeric columns, categories spread by hash, then pool extras."""
    hashed = [F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30) for c in geo.cs]
    zs = [named(x) for x in geo.xs] + hashed + [named(n).cast("double") for n in names]
    return df.select("*", *[z.cast("double").alias(f"z{i}") for i, z in enumerate(zs)])


def _cell_stats(points: DataFrame, zs: list[str]) -> DataFrame:
    return points.groupBy("blk", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(z).alias(f"lo_{z}") for z in zs],
        *[F.max(z).alias(f"hi_{z}") for z in zs],
    )


def _descend(df: DataFrame, splits: DataFrame, rows: int) -> DataFrame:
    """Move every row of a split cell into the child its coordinate falls into."""
    zs = [c for c in df.columns if c.startswith("z") and c[1:].isdigit()]
    placed = attach(df, splits, ["blk", "cell"], "left", rows)
    value = F.element_at(F.array(*[named(z) for z in zs]), F.col("_dim") + 1)
    child = F.size(F.filter(F.col("_cuts"), lambda cut: cut <= value))
    return placed.withColumn(
        "cell", F.when(F.col("_cuts").isNull(), F.col("cell")).otherwise(F.concat("cell", F.lit("."), child))
    ).drop("_dim", "_cuts")


def _choose_splits(points: DataFrame, open_cells: DataFrame, zs: list[str], spare: list[str]) -> DataFrame:
    """Per crowded cell, the widest coordinate (relative to its block) and cut points on it.

    ``spare`` coordinates carry no distance; they are used only if nothing else varies.
    """
    spans = [F.col(f"hi_{z}") - F.col(f"lo_{z}") for z in zs]
    widths = [
        F.when(span > 0, (F.lit(0.0) if z in spare else F.lit(1.0)) + span / F.greatest(F.col(f"w_{z}"), span))
        .otherwise(F.lit(-1.0))
        for z, span in zip(zs, spans)
    ]
    dims = open_cells.withColumn("_w", F.array(*widths)).withColumn(
        "_dim", (F.array_position("_w", F.array_max("_w")) - 1).cast("int")
    )
    pick = lambda side: F.element_at(F.array(*[F.col(f"{side}_{z}") for z in zs]), F.col("_dim") + 1)
    dims = materialise(dims.select("blk", "cell", "n", "_dim", pick("lo").alias("_lo"), pick("hi").alias("_hi")))
    inside = attach(points, dims, ["blk", "cell"])
    value = F.element_at(F.array(*[named(z) for z in zs]), F.col("_dim") + 1)
    shares = [i / FAN_OUT for i in range(1, FAN_OUT)]
    cuts = inside.groupBy("blk", "cell").agg(
        F.percentile_approx(value, shares, 2000).alias("_q"),
        F.max("_dim").alias("_dim"),
        F.max("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.max("n").alias("n"),
    )
    fan = F.least(F.lit(FAN_OUT), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / CELL_UNITS))).cast("int")
    chosen = F.transform(
        F.sequence(F.lit(1), F.col("_fan") - 1),
        lambda i: F.element_at(F.col("_q"), F.least(F.lit(FAN_OUT - 1), F.ceil(i * FAN_OUT / F.col("_fan")).cast("int"))),
    )
    middle = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2
    usable = F.filter(
        F.concat(chosen, F.array(middle)), lambda c: (c > F.col("_lo")) & (c <= F.col("_hi"))
    )
    return cuts.withColumn("_fan", fan).select(
        "blk",
        "cell",
        "_dim",
        F.array_sort(F.array_distinct(F.when(F.size(usable) > 0, usable).otherwise(F.array("_hi")))).alias("_cuts"),
    )


@dataclass
class CellTree:
    points: DataFrame  # the pool, each unit with its cell
    levels: list[DataFrame]  # cells of each level with count and box
    level_rows: list[int]
    splits: list[tuple[DataFrame, int]]
    zs: list[str]


def build_cells(pool: DataFrame, geo: Geometry, extras: list[str]) -> CellTree:
    points = _coordinates(pool, geo, extras).withColumn("cell", F.lit("0"))
    zs = [c for c in points.columns if c.startswith("z") and c[1:].isdigit()]
    spare = [f"z{geo.width + geo.n_cat + i}" for i, n in enumerate(extras) if n != "extra"]
    spare += [f"z{geo.n_num + i}" for i in range(geo.n_num) if geo.form and geo.n_num + i not in geo.windows_on]
    varies = reduce(lambda a, b: a | b, [F.col(f"hi_{z}") > F.col(f"lo_{z}") for z in zs], F.lit(False))
    points = materialise(points)
    levels, sizes, splits = [], [], []
    while True:
        stats = _cell_stats(points, zs)
        if not levels:
            spans = [(F.col(f"hi_{z}") - F.col(f"lo_{z}")).alias(f"w_{z}") for z in zs]
            stats = materialise(stats.withColumn("parent", F.lit("")))
            block_spans = stats.select("blk", *spans)
        else:
            stats = stats.withColumn("parent", F.substring_index("cell", ".", depth))
            grown = F.size(F.split("cell", "[.]")) == depth + 1
            stats = materialise(stats.where(grown))
        crowded = (F.col("n") > CELL_UNITS) & varies
        stats = stats.withColumn("is_leaf", ~crowded)
        found = stats.agg(F.count(F.lit(1)), F.count_if(crowded)).first()
        levels.append(stats)
        sizes.append(found[0])
        if not found[1]:
            return CellTree(points, levels, sizes, splits, zs)
        open_cells = attach(stats.where(crowded), block_spans, ["blk"])
        chosen = materialise(_choose_splits(points, open_cells, zs, spare))
        splits.append((chosen, found[1]))
        points = materialise(_descend(points, chosen, found[1]))
        depth = len(splits)


# ---------------------------------------------------------------- distances inside one cell


def _blocks(qx: np.ndarray, px: np.ndarray, qt: np.ndarray | None, geo: Geometry):
    """Slices of queries and of the units they are compared with: all of them, or what the first window can reach
    where both are in the order of its column."""
    at, step = 0, max(1, STEP_PAIRS // len(px))
    if not geo.windows_on:
        for at in range(0, len(qx), step):
            yield slice(at, min(at + step, len(qx))), slice(0, len(px))
        return
    q, p = qx[:, geo.windows_on[0]], px[:, geo.windows_on[0]]
    room = qt[:, 0] + SLACK * (np.abs(q) + qt[:, 0])
    low, high = np.searchsorted(p, q - room, "left"), np.searchsorted(p, q + room, "right")
    while at < len(qx):
        end = min(at + BAND_QUERIES, len(qx))
        a, b = int(low[at:end].min()), int(high[at:end].max())
        if (end - at) * (b - a) > STEP_PAIRS:
            end = at + max(1, STEP_PAIRS // (b - a))
            a, b = int(low[at:end].min()), int(high[at:end].max())
        if a < b:
            yield slice(at, end), slice(a, b)
        at = end


def _cell_search(geo: Geometry, pool_has: set[str], query_has: set[str], ranked: bool = False, whole: bool = False):
    """The search of one cell; ``whole`` leaves out queries that find fewer units than they need."""
    xs, cs, ss, ts = geo.xs, geo.cs, geo.ss, geo.ts

    def search(queries: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or units.empty:
            return pd.DataFrame()
        units = units.sort_values("p", kind="stable").reset_index(drop=True)
        by_id = np.arange(len(units))
        if geo.windows_on:
            along = xs[geo.windows_on[0]]
            units = units.sort_values(along, kind="stable")
            by_id = units.index.to_numpy()
            queries = queries.sort_values(along, kind="stable")
        else:
            queries = queries.sort_values("need", kind="stable")
        px = units[xs].to_numpy(float)
        qx = queries[xs].to_numpy(float)
        codes = []
        for c in cs:
            code, _ = pd.factorize(pd.concat([queries[c], units[c]], ignore_index=True))
            codes.append((code[: len(queries)], code[len(queries):]))
        qs = queries[ss].to_numpy(float) if ss else None
        qt = queries[ts].to_numpy(float) if ts else None
        need = queries["need"].to_numpy()
        reach = queries["reach"].to_numpy(float)
        extra = units["extra"].to_numpy(float) if "extra" in pool_has else None
        bound = units["bound"].to_numpy(float) if "bound" in pool_has and "prio" in query_has else None
        prio = queries["prio"].to_numpy(float) if bound is not None else None
        rows, cols, dists, ranks = [], [], [], []
        for part, near in _blocks(qx, px, qt, geo):
            px_, first_unit = px[near], near.start
            total = np.zeros((len(qx[part]), len(px_)))
            if geo.form:
                gaps = [qx[part, i][:, None] - px_[:, i][None, :] for i in range(geo.n_num, 2 * geo.n_num)]
                entries = ((i, j) for i in range(geo.n_num) for j in range(i, geo.n_num))
                for k, (i, j) in enumerate(entries):
                    entry = qs[part, k][:, None]
                    total += entry * (gaps[i] * gaps[i]) if i == j else 2 * entry * gaps[i] * gaps[j]
                total = np.maximum(total, 0.0) / qs[part, -1][:, None]
            for i in range(0 if geo.form else geo.n_num):
                gap = qx[part, i][:, None] - px_[:, i][None, :]
                if geo.metric == "euclidean":
                    total += gap * gap
                else:
                    np.abs(gap, out=gap)
                    total += gap / qs[part, i][:, None] if qs is not None else gap
            differ = np.zeros(total.shape) if codes else 0.0
            for qc, pc in codes:
                differ += qc[part][:, None] != pc[near][None, :]
            dist = geo.combine(total, differ, np.sqrt)
            ok = dist <= reach[part][:, None]
            for w, i in enumerate(geo.windows_on):
                ok &= np.abs(qx[part, i][:, None] - px_[:, i][None, :]) <= qt[part, w][:, None]
            if bound is not None:
                ok &= bound[near][None, :] > prio[part][:, None]
            if extra is not None:
                dist = dist + extra[near][None, :]
            dist = np.where(ok, dist, np.inf)
            most = min(int(need[part].max()), len(px_))
            if most < len(px_):
                edge = np.partition(dist, most - 1, axis=1)[:, most - 1]
                r, c = np.nonzero((dist <= edge[:, None]) & ok)
            else:
                r, c = np.nonzero(ok)
            d, c = dist[r, c], c + first_unit
            by = np.lexsort((by_id[c], d, r))
            r, c, d = r[by], c[by], d[by]
            first = np.searchsorted(r, np.arange(len(total)))
            place = np.arange(len(r)) - first[r]
            keep = place < need[part][r]
            if whole:
                keep &= np.bincount(r, minlength=len(total))[r] >= need[part][r]
            ranks.append(place[keep] + 1)
            rows.append(r[keep] + part.start)
            cols.append(c[keep])
            dists.append(d[keep])
        if not rows:
            return pd.DataFrame()
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame(
            {
                "blk": queries["blk"].to_numpy()[r],
                "q": queries["q"].to_numpy()[r],
                "p": units["p"].to_numpy()[c],
                "dist": np.concatenate(dists),
                **({"rank": np.concatenate(ranks)} if ranked else {}),
            }
        )

    return search


def _chunked(per_cell: DataFrame) -> DataFrame:
    return per_cell.select("blk", "cell", F.ceil(F.col("_asked") / CHUNK_QUERIES).cast("int").alias("_chunks"))


def _search_cells(
    visits: DataFrame, points: DataFrame, geo: Geometry, sizes: tuple[DataFrame, int, int] | None = None, whole: bool = False
) -> DataFrame:
    """Top ``need`` units of the visited cell for every (query, cell) row. With ``sizes`` (queries ``_asked`` of each
    cell, number of cells, most queries of one) known, every query visits one cell only, and ranks are final."""
    if sizes is None:
        per_cell = visits.groupBy("blk", "cell").agg(F.count(F.lit(1)).alias("_asked"))
        per_cell = materialise(_chunked(per_cell))
        crowded, cells = per_cell.agg(F.max("_chunks"), F.count(F.lit(1))).first()
    else:
        per_cell, cells, most_asked = _chunked(sizes[0]), sizes[1], sizes[2]
        crowded = -(-most_asked // CHUNK_QUERIES)
    pool_columns = ["blk", "cell", "p", *geo.xs, *geo.cs] + [c for c in ("bound", "extra") if c in points.columns]
    units = points.select(*pool_columns)
    asked = ["blk", "cell", "q", "need", "reach", *geo.xs, *geo.cs, *geo.ss, *geo.ts]
    visits = visits.select(*asked, *[c for c in ("prio",) if c in visits.columns])
    if (crowded or 0) > 1:
        visits = attach(visits, per_cell, ["blk", "cell"], rows=cells)
        visits = visits.withColumn("_chunk", F.pmod(F.xxhash64("q"), F.col("_chunks")).cast("int")).drop("_chunks")
        units = attach(units, per_cell, ["blk", "cell"], rows=cells)
        units = units.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    else:
        visits = visits.withColumn("_chunk", F.lit(0))
        units = units.withColumn("_chunk", F.lit(0))
    # New names for the same columns, so that both sides may come from one table.
    visits = visits.select(*[named(c).alias(c) for c in visits.columns])
    units = units.select(*[named(c).alias(c) for c in units.columns])
    types = {f.name: f.dataType.simpleString() for f in [*visits.schema, *units.schema]}
    keys = ["blk", "cell", "_chunk"]
    return (
        visits.groupBy(*keys)
        .cogroup(units.groupBy(*keys))
        .applyInPandas(
            _cell_search(geo, set(units.columns), set(visits.columns), sizes is not None, whole),
            f"blk {types['blk']}, q {types['q']}, p {types['p']}, dist double" + ", rank int" * (sizes is not None),
        )
    )


def _strips(df: DataFrame, geo: Geometry, w: int, spread: bool, wide: int) -> DataFrame:
    """The cell of each row cut into strips along a window, each ``wide`` windows wide; with ``spread`` the row also goes to
    every other strip that has queries within the window."""
    x, width = F.col(f"x{geo.windows_on[w]}"), F.col(f"t{w}") * (1 + STRIP_SLACK)
    same = F.pmod(F.xxhash64(x), F.lit(1 << 40))

    def place(at: Column) -> Column:
        return F.when(width > 0, F.floor(at / (width * wide))).otherwise(same)

    strip = F.explode(F.sequence(place(x - width), place(x + width))) if spread else place(x)
    return df.withColumn("_strip", strip).withColumn("cell", F.concat_ws("/", "cell", F.col("_strip").cast("string"))).drop("_strip")


def _search_strips(
    queries: DataFrame, pool: DataFrame, geo: Geometry, whole: bool = False, wide: int = 1, w: int = 0
) -> tuple[DataFrame, DataFrame | None]:
    """The search by strips along the first window, and along the next ones too where that leaves too many units
    in one; the queries that are left because no window makes them few."""
    if not w:
        queries, pool = (df.withColumn("cell", F.lit("0")) for df in (queries, pool))
    asked, units = _strips(queries, geo, w, False, wide), _strips(pool, geo, w, True, wide)
    sizes = asked.groupBy("blk", "cell").agg(F.count(F.lit(1)).alias("_asked")).join(
        units.groupBy("blk", "cell").agg(F.count(F.lit(1)).alias("_units")), ["blk", "cell"], "right"
    )
    sizes = materialise(sizes)
    every = sizes.agg(F.sum("_units")).first()[0] or 0
    sizes = sizes.where("_asked IS NOT NULL")
    cells, most_asked, crowded, met = sizes.agg(
        F.count(F.lit(1)), F.max("_asked"), F.count_if(F.col("_units") > STRIP_UNITS), F.sum("_units")
    ).first()
    if 2 * (met or 0) < every:  # units of strips that nobody asks stay where they are
        units = attach(units, sizes.select("blk", "cell"), ["blk", "cell"], rows=cells)
    if not crowded:
        return _search_cells(asked, units, geo, (sizes, cells, most_asked or 0), whole), None
    large = sizes.where(F.col("_units") > STRIP_UNITS).select("blk", "cell", F.lit(True).alias("_large"))
    marked = [attach(df, large, ["blk", "cell"], "left", crowded) for df in (asked, units)]
    there, many = (df.where("_large").drop("_large") for df in marked)
    asked, units = (df.where("_large IS NULL").drop("_large") for df in marked)
    found = _search_cells(asked, units, geo, (sizes, cells, most_asked), whole)
    there = materialise(there)
    if w + 1 == len(geo.windows_on):
        return found, there.drop("cell")
    further, rest = _search_strips(there, many, geo, whole, 1, w + 1)
    return found.unionByName(further), rest


def _search_narrow(queries: DataFrame, pool: DataFrame, geo: Geometry) -> tuple[list[DataFrame], DataFrame]:
    """What a narrower first window settles, and the queries it leaves.

    The distance is at least the gap in the window's column, so ``need`` units no farther than the narrow window reaches are
    nearer than every unit outside it. The windows hold some of a block's units, judged by what lies between its deciles.
    """
    needed = queries.groupBy("blk").agg(F.avg("need").alias("_need"))
    spans = pool.groupBy("blk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(t).alias(t) for t in geo.ts],
        *[F.percentile_approx(f"x{i}", [0.1, 0.9], 1000).alias(f"_ends{w}") for w, i in enumerate(geo.windows_on)],
    )
    span = [(F.col(f"_ends{w}")[1] - F.col(f"_ends{w}")[0]) / 0.8 for w in range(len(geo.ts))]
    share = reduce(lambda a, b: a * b, [F.least(F.lit(1.0), 2 * F.col(t) / s) for t, s in zip(geo.ts[1:], span[1:])], F.lit(1.0))
    reach = (SPARE_SHARE * (F.col("_need") + SPARE_SHARE)) / share / 2  # units on each side
    widths = spans.join(needed, "blk").select("blk", F.col("t0").alias("_window"), reach.alias("_reach"), (span[0] / F.col("_n") * reach).alias("_width"))
    widths = materialise(widths.where(F.col("_width") > 0))
    found: list[DataFrame] = []
    while True:
        widths = widths.where(F.col("_width") * 2 <= F.col("_window"))
        n, most = widths.agg(F.count(F.lit(1)), F.max("_reach")).first()
        if not n:
            return found, queries
        narrow = widths.select("blk", F.col("_width").alias("t0"))
        asked, units = (attach(df.drop("t0"), narrow, ["blk"], rows=n) for df in (queries, pool))
        wide = max(1, min(NARROW_REACH, int(NARROW_STRIP / most)))
        near, _ = _search_strips(asked.withColumn("reach", F.least("reach", "t0")), units, geo, True, wide)
        near = materialise(near)
        found.append(near)
        queries = materialise(queries.join(near.where("rank = 1").select("blk", "q"), ["blk", "q"], "left_anti"))
        if not queries.limit(1).count():
            return found, queries
        widths = widths.withColumns({"_width": F.col("_width") * WIDER, "_reach": F.col("_reach") * WIDER})


def _best(found: DataFrame, needs: DataFrame | None, most: int) -> DataFrame:
    if most > LONG_LIST:
        ranked = running_total(found, ["blk", "q"], ["dist", "p"], out="rank")
    else:
        order = Window.partitionBy("blk", "q").orderBy("dist", "p")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if needs is not None:
        ranked = ranked.join(needs, ["blk", "q"]).where(F.col("rank") <= F.col("need")).drop("need")
    return ranked.where(F.col("rank") <= most)


# ---------------------------------------------------------------- search over cells


def _box_gap(geo: Geometry, zs: list[str], far: bool) -> Column:
    """Smallest (or largest) distance from a query to a cell's box."""
    parts = []
    for i in range(geo.n_num):
        below = F.col(f"lo_z{i}") - F.col(f"x{i}")
        above = F.col(f"x{i}") - F.col(f"hi_z{i}")
        gap = F.greatest(F.abs(below), F.abs(above)) if far else F.greatest(below, above, F.lit(0.0))
        if geo.metric == "euclidean":
            parts.append(gap * gap)
        else:
            parts.append(gap / F.col(f"s{i}") if geo.scaled else gap)
    misses = []
    for j in range(geo.n_cat):
        z = f"z{geo.width + j}"
        outside = (named(z) < F.col(f"lo_{z}")) | (named(z) > F.col(f"hi_{z}"))
        misses.append(F.lit(1.0) if far else F.when(outside, 1.0).otherwise(0.0))
    return geo.combine(_sum(parts), _sum(misses), F.sqrt)


def nearest(queries: DataFrame, pool: DataFrame, geo: Geometry, most: int | None = None) -> DataFrame:
    """The ``need`` nearest qualifying pool units of each query, ties by lowest ``p``.

    ``q`` must be unique within ``blk``. Returns ``(blk, q, p, dist, rank)``; ``dist`` includes
    ``extra`` if the pool has it. ``most`` is the largest ``need``, or the common one.
    """
    uniform = most is not None
    if "need" not in queries.columns:
        queries = queries.withColumn("need", F.lit(most).cast("long"))
    if "reach" not in queries.columns:
        queries = queries.withColumn("reach", F.lit(float("inf")))
    queries = queries.withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    if most is None:
        most = queries.agg(F.max("need")).first()[0]
        if most is None:
            return queries.select(
                "blk", "q", F.lit(None).cast(pool.schema["p"].dataType).alias("p"),
                F.lit(0.0).alias("dist"), F.lit(0).alias("rank"),
            ).limit(0)
    if geo.windows_on and all(t in pool.columns for t in geo.ts):
        parts: list[DataFrame] = []
        if most <= CELL_UNITS // 2:
            pool = materialise(_without_copies(pool, geo, most))
        if geo.metric == "euclidean" and not geo.form and geo.windows_on[0] < geo.n_num and "extra" not in pool.columns:
            parts, queries = _search_narrow(queries, pool, geo)
        found, rest = _search_strips(queries, pool, geo)
        found = reduce(DataFrame.unionByName, [*parts, found])
        if rest is None:
            return found
        return found.unionByName(_nearest_by_cells(rest, pool, geo, most, uniform))
    return _nearest_by_cells(queries, pool, geo, most, uniform)


def _without_copies(pool: DataFrame, geo: Geometry, most: int) -> DataFrame:
    """Of units that agree in every column only the first ``most``: no other can be anybody's neighbour."""
    copies = Window.partitionBy("blk", *geo.xs, *geo.cs, *[c for c in ("bound", "extra") if c in pool.columns]).orderBy("p")
    return pool.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= most).drop("_copy")


def _nearest_by_cells(queries: DataFrame, pool: DataFrame, geo: Geometry, most: int, uniform: bool) -> DataFrame:
    extras = [c for c in ("bound", "extra") if c in pool.columns]
    if most <= CELL_UNITS // 2:
        pool = _without_copies(pool, geo, most)
    else:
        same = ["blk", *geo.xs, *geo.cs, *extras]
        pool = running_total(pool, same, ["p"], out="_copy").where(F.col("_copy") <= most)
        extras = [*extras, "_copy"]
    tree = build_cells(pool, geo, extras)
    place = {name: f"z{geo.width + geo.n_cat + i}" for i, name in enumerate(extras)}
    asked = _coordinates(queries, geo, []).withColumn("cell", F.lit("0"))
    needs = None if uniform else queries.select("blk", "q", "need")

    if not tree.splits:
        return _best(_search_cells(asked, tree.points, geo), needs, most)

    # A query's coordinates stop before the pool-only ones; those never rule a cell out here.
    for name in extras:
        asked = asked.withColumn(place[name], F.lit(0.0))
    home = asked
    for splits, rows in tree.splits:
        home = _descend(home, splits, rows)
    home = materialise(home)
    leaves = reduce(
        DataFrame.unionByName, [lv.where("is_leaf").select("blk", "cell", "n") for lv in tree.levels]
    )
    leaf_rows = sum(tree.level_rows)
    own = attach(home, leaves, ["blk", "cell"], rows=leaf_rows).where(F.col("n") >= F.col("need")).drop("n")
    near = materialise(_best(_search_cells(own, tree.points, geo), needs, most))
    ball = near.groupBy("blk", "q").agg(F.max("dist").alias("_ball"), F.max("rank").alias("_got"))
    asked = home.withColumn("_home", F.col("cell")).withColumn("cell", F.lit("0"))
    asked = asked.join(ball, ["blk", "q"], "left")
    asked = asked.withColumn(
        "_ball", F.when(F.col("_got") >= F.col("need"), F.col("_ball")).otherwise(F.lit(float("inf")))
    ).drop("_got")
    if not geo.windows_on and "bound" not in extras and "extra" not in extras:
        asked = _bound_by_ancestors(asked, tree, geo)
    asked = materialise(asked)

    keep = asked.columns
    arrived, frontier = [], asked
    for depth, (level, rows) in enumerate(zip(tree.levels, tree.level_rows)):
        cells = level.withColumnRenamed("cell", "_child")
        if depth:
            cells = cells.withColumnRenamed("parent", "cell")
        else:
            cells = cells.withColumn("cell", F.lit("0")).drop("parent")
        near_gap = _box_gap(geo, tree.zs, far=False)
        if "extra" in extras:
            near_gap = near_gap + F.col(f"lo_{place['extra']}")
        touch = near_gap <= F.col("_ball") * (1 + SLACK) + 1e-12
        touch = touch & (_box_gap(geo, tree.zs, far=False) <= F.col("reach") * (1 + SLACK) + 1e-12)
        for w, i in enumerate(geo.windows_on):
            touch = touch & (F.col(f"lo_z{i}") - F.col(f"x{i}") <= F.col(f"t{w}"))
            touch = touch & (F.col(f"x{i}") - F.col(f"hi_z{i}") <= F.col(f"t{w}"))
        if "bound" in extras and "prio" in keep:
            touch = touch & (F.col(f"hi_{place['bound']}") > F.col("prio"))
        if "_copy" in extras:
            touch = touch & (F.col(f"lo_{place['_copy']}") <= F.col("need"))
        clash = [c for c in cells.columns if c in keep and c not in ("blk", "cell")]
        moved = attach(frontier, cells.drop(*clash), ["blk", "cell"], rows=rows).where(touch)
        moved = moved.withColumn("cell", F.col("_child"))
        arrived.append(moved.where("is_leaf").select(*keep))
        frontier = materialise(moved.where(~F.col("is_leaf")).select(*keep))
    others = reduce(DataFrame.unionByName, arrived)
    searched = near.select("blk", "q").distinct().withColumn("_seen", F.lit(True))
    others = others.join(searched, ["blk", "q"], "left").where(
        F.col("_seen").isNull() | (F.col("cell") != F.col("_home"))
    )
    if "extra" not in extras:
        others = others.withColumn("reach", F.least("reach", F.col("_ball") * (1 + SLACK) + 1e-12))
    others = others.drop("_seen", "_home", "_ball", *tree.zs, *place.values())
    far = _search_cells(materialise(others), tree.points, geo)
    return _best(near.drop("rank").unionByName(far), needs, most)


def _bound_by_ancestors(asked: DataFrame, tree: CellTree, geo: Geometry) -> DataFrame:
    """Where the own cell was too small: the smallest enclosing cell with enough units bounds the ball."""
    loose = asked.where(F.col("_ball") == float("inf"))
    columns = ["blk", "q", "need", "_home", *geo.xs, *geo.ss, *[f"z{geo.width + j}" for j in range(geo.n_cat)]]
    ladder = []
    for depth, (level, rows) in enumerate(zip(tree.levels, tree.level_rows)):
        up = loose.select(*columns).withColumn("cell", F.substring_index("_home", ".", depth + 1))
        up = attach(up, level.drop("parent", "is_leaf"), ["blk", "cell"], rows=rows)
        up = up.where(F.col("n") >= F.col("need"))
        ladder.append(up.select("blk", "q", _box_gap(geo, tree.zs, far=True).alias("_far")))
    limits = reduce(DataFrame.unionByName, ladder).groupBy("blk", "q").agg(F.min("_far").alias("_far"))
    return asked.join(limits, ["blk", "q"], "left").withColumn(
        "_ball", F.least("_ball", F.coalesce("_far", F.lit(float("inf"))))
    ).drop("_far")


__all__ = ["BROADCAST_ROWS", "Geometry", "build_cells", "nearest"]
