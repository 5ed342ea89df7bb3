"""Optimal one-to-one matching and transport-based selection.

Both ship units of demand to places with a capacity at least total distance. One algorithm serves
blocks of every size: an auction between cells. Equal units of a side are one row with several
units of demand or capacity. The rows that ask are dealt into cells of at most ``CELL`` near
neighbours; every round, each cell with unplaced demand settles all its rows at once against the present
prices, and bids for a place what the cell would have to pay elsewhere for it. A place keeps
its highest bids up to its capacity, which is one window over the bids; cells that lost units bid
again. Prices only rise, so that the rows of other cells stay content with what they hold.
Cells that go on contesting the same places become one cell of at most ``LARGEST_CELL`` rows; if that does
not end it, the least raise of a contested price grows, so every auction ends. Candidate lists
grow on demand, so no place is out of reach.

On a line (one numeric feature, no window, no caliper) the rows of both sides in order fall into runs that no cheapest
flow leaves: a place where neither what is asked to its left nor what is asked to its right can overflow past it parts two
runs. Runs are found by running totals and settled exactly, many in a task; only runs too large for that go to the auction.

Every pair carries in ``step`` how far its row is from the best it could have at the final prices;
the sum bounds the distance of the total to the optimum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MatchError
from ..functions.order import running_total
from ..functions.tools import attach, materialise, named, with_size
from .distance import PairRule, compare_units
from .neighbours import nearest

CELL = 64  # rows that are settled together at first
LARGEST_CELL = 512
MERGE_EVERY = 3  # rounds
PATIENCE = 16  # rounds after which the least raise doubles every round
FIRST_LIST = 16
RUN_PAIRS = 1 << 20  # asking times offering rows of a run that is settled at once
RUNS = 1024  # numbers of runs that share a task
PRECISION = 1e-10  # least raise of a contested price, relative to the largest possible distance
_Z_BITS, _Z_COORDINATES = 8, 4


def ship(cost: np.ndarray, supply: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Cheapest flow from rows to columns (infinite cost = not allowed); there must be room for all.

    Row by row along shortest augmenting paths.
    """
    m, n = cost.shape
    room = capacity.astype(np.int64).copy()
    flow = np.zeros((m, n), dtype=np.int64)
    left = supply.astype(np.int64).copy()
    u, v = np.zeros(m), np.zeros(n)
    for row in range(m):
        while left[row] > 0:
            dist = np.full(n, np.inf)
            via = np.full(n, -1)
            done = np.zeros(n, dtype=bool)
            row_dist, entry = {row: 0.0}, {}
            fresh = [row]
            while True:
                for r in fresh:
                    reach = row_dist[r] + cost[r] - u[r] - v
                    better = (reach < dist) & ~done
                    dist[better], via[better] = reach[better], r
                c = int(np.argmin(np.where(done, np.inf, dist)))
                done[c] = True
                if room[c] > 0:
                    break
                fresh = [r for r in np.nonzero(flow[:, c])[0] if r not in row_dist]
                for r in fresh:
                    row_dist[r], entry[r] = dist[c], c
            goal = dist[c]
            for r, d in row_dist.items():
                u[r] += goal - d
            v[done] -= goal - dist[done]
            path, amount, at = [], min(left[row], room[c]), c
            while True:
                r = via[at]
                path.append((r, at))
                if r == row:
                    break
                at = entry[r]
                amount = min(amount, flow[r, at])
            for r, to in path:
                flow[r, to] += amount
                if r != row:
                    flow[r, entry[r]] -= amount
            left[row] -= amount
            room[c] -= amount
    return flow


def _levels(cost: np.ndarray, price: np.ndarray, flow: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The most each row could be asked to pay in all before it, or a row it then displaces, goes elsewhere."""
    used = flow.sum(axis=0)
    level = np.min(np.where(used < capacity, cost + price, np.inf), axis=1)
    displace = np.full((len(cost), len(cost)), np.inf)
    for r, c in zip(*np.nonzero(flow)):
        if used[c] == capacity[c]:
            displace[:, r] = np.minimum(displace[:, r], cost[:, c] - cost[r, c])
    np.fill_diagonal(displace, np.inf)
    for _ in range(len(cost)):
        further = np.minimum(level, np.min(displace + level, axis=1))
        if np.array_equal(further, level):
            break
        level = further
    return level


def _settle(raise_by: float, penalty: float):
    """Bids of one cell. Columns are the places' own room (what is free or held by the cell), what other
    cells hold there at their prices, each row's home and what may lie beyond its list."""

    def settle(entries: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        asks = entries[entries["p"].isna()].sort_values("q", kind="stable")
        listed = entries[entries["p"].notna()].sort_values(["q", "p"], kind="stable")
        m = len(asks)
        places, place_at = np.unique(listed["p"].to_numpy(), return_inverse=True)
        row_at = np.searchsorted(asks["q"].to_numpy(), listed["q"].to_numpy())
        plain = np.full((m, len(places)), np.inf)
        plain[row_at, place_at] = listed["cost"].to_numpy(float)
        room = np.zeros(len(places), np.int64)
        room[place_at] = listed["capacity"].to_numpy(np.int64)
        floor = np.zeros(len(places))
        slots = slots[slots["p"].isin(places)]
        at = np.searchsorted(places, slots["p"].to_numpy())
        mass, price, own = slots["mass"].to_numpy(np.int64), slots["price"].to_numpy(float), slots["own"].to_numpy(bool)
        free = room.copy()
        np.subtract.at(free, at, mass)
        np.subtract.at(room, at[~own], mass[~own])
        # a little less for what the cell holds itself, so that it is not given up for something equal
        full = own & (free[at] == 0)
        floor[at[full]] = np.inf
        np.minimum.at(floor, at[full], price[full] - 4 * raise_by)
        theirs = np.flatnonzero(~own)
        supply = asks["supply"].to_numpy(np.int64)
        away = np.full((m, m), np.inf)
        home, beyond = away.copy(), away.copy()
        np.fill_diagonal(home, penalty)
        np.fill_diagonal(beyond, asks["cost"].to_numpy(float))
        cost = np.hstack([plain, plain[:, at[theirs]], home, beyond])
        price_of = np.concatenate([floor, price[theirs] + raise_by, np.zeros(2 * m)])
        capacity = np.concatenate([room, mass[theirs], supply, supply])
        flow = ship(cost + price_of, supply, capacity)
        level = _levels(cost, price_of, flow, capacity)
        n_places = len(places) + len(theirs)
        r, c = np.nonzero(flow)
        to_place, to_beyond = c < n_places, c >= n_places + m
        place_of = np.concatenate([np.arange(len(places)), at[theirs]]).astype(np.int64)
        names = np.full(len(r), None, object)
        names[to_place] = places[place_of[c[to_place]]]
        bid = np.where(to_place, np.maximum(level[r] - cost[r, c], price_of[c]), 0.0)
        capacities = np.full(len(r), 0, np.int64)
        whole = np.zeros(len(places), np.int64)
        whole[place_at] = listed["capacity"].to_numpy(np.int64)
        capacities[to_place] = whole[place_of[c[to_place]]]
        out = pd.DataFrame({
            "tile": asks["tile"].to_numpy()[r], "cell": asks["cell"].iloc[0], "blk": asks["blk"].iloc[0], "q": asks["q"].to_numpy()[r], "p": names, "mass": flow[r, c],
            "price": np.where(np.abs(bid) < raise_by / 2, 0.0, bid), "cost": np.where(to_place, cost[r, c], 0.0), "capacity": capacities, "more": to_beyond,
        })
        if to_beyond.any():  # all lists of the cell that may go on, so that its rows do not reach their ends one by one
            ends = asks[np.isfinite(asks["cost"].to_numpy(float))]
            longer = pd.DataFrame({"tile": ends["tile"], "cell": ends["cell"], "blk": ends["blk"], "q": ends["q"], "p": None, "mass": 0, "price": 0.0, "cost": 0.0, "capacity": 0, "more": True})
            out = pd.concat([out, longer], ignore_index=True)
        if to_place.any():  # own room and others' room of one place are one bid
            out = out.groupby(["tile", "cell", "blk", "q", "p", "more"], dropna=False, as_index=False).agg({"mass": "sum", "price": "max", "cost": "max", "capacity": "max"})
        return out[_STATE]

    return settle


_STATE = ["tile", "cell", "blk", "q", "p", "mass", "price", "cost", "capacity", "more"]


def in_cells(asks: DataFrame, geo, rows: int, size: int) -> DataFrame:
    """Near rows of a block share a cell: they are numbered along a curve through the first coordinates.
    ``rows`` is the size of the largest block, ``size`` that of a cell."""
    if rows <= size:
        return asks.withColumn("tile", F.col("blk"))
    xs = geo.xs[:_Z_COORDINATES]
    z = F.lit(0).cast("long")
    if xs:
        ends = asks.agg(*[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs]).first()
        steps = 2**_Z_BITS - 1
        spans = {x: (ends[f"hi_{x}"] or 0.0) - (ends[f"lo_{x}"] or 0.0) for x in xs}
        codes = {x: F.floor((F.col(x) - (ends[f"lo_{x}"] or 0.0)) / spans[x] * steps) for x in xs if spans[x] > 0}
        for bit in reversed(range(_Z_BITS)):
            for code in codes.values():
                z = z * 2 + F.shiftright(code, bit).bitwiseAND(F.lit(1))
    placed = running_total(asks.withColumn("_z", z), ["blk"], ["_z", *geo.cs, "q"], out="_at")
    return placed.withColumn("tile", F.concat_ws("#", "blk", F.floor((F.col("_at") - 1) / size).cast("string"))).drop("_z", "_at")


def _lists(asked: DataFrame, offers: DataFrame, geo, held: DataFrame | None) -> DataFrame:
    """The ``need`` cheapest places of each row by distance and present price, and one row per asking row (without a
    place) that says what lies beyond: nothing (infinite) if the list is complete."""
    priced = offers.drop("capacity")
    if held is not None:
        extra = _prices(held).select("p", F.col("price").alias("extra"))
        priced = materialise(priced.join(extra, "p", "left").withColumn("extra", F.coalesce("extra", F.lit(0.0))))
    found = nearest(asked.drop("tile", "supply", "enough"), priced, geo)
    known = offers.select("p", "capacity", F.lit(0.0).alias("extra")) if held is None else priced.select("p", "extra").join(offers.select("p", "capacity"), "p")
    found = found.join(known, "p").select("blk", "q", "p", "dist", "extra", "capacity")
    own = asked.select(
        "blk", "q", F.lit(None).cast(offers.schema["p"].dataType).alias("p"), "tile", "supply", "need",
        (F.col("need") >= F.col("enough") if held is None else F.lit(False)).alias("_all"),  # so many nearest places suffice whatever the others do
    )
    row = Window.partitionBy("q")
    rows = found.unionByName(own, allowMissingColumns=True).select(
        "blk", "q", "p", "dist", "extra", F.coalesce("capacity", F.lit(0).cast("long")).alias("capacity"), F.max("dist").over(row).alias("_far"),
        F.count("p").over(row).alias("_n"), *[F.max(c).over(row).alias(c) for c in ("tile", "supply", "need", "_all")],
    )
    beyond = F.when(F.col("_all") | (F.col("_n") < F.col("need")), F.lit(float("inf"))).otherwise(F.col("_far"))
    cost = F.when(F.col("p").isNull(), beyond).otherwise(F.col("dist") - F.col("extra"))
    return materialise(rows.select("tile", "blk", "q", "p", cost.alias("cost"), "capacity", "supply", "need"))


def _prices(held: DataFrame) -> DataFrame:
    """The lowest bid a full place holds; 0 where there is room."""
    used = held.where("p IS NOT NULL").groupBy("p").agg(F.sum("mass").alias("_used"), F.min("price").alias("_low"), F.max("capacity").alias("capacity"))
    return used.withColumn("price", F.when(F.col("_used") >= F.col("capacity"), F.col("_low")).otherwise(0.0))


def _merged(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Cells joined to the cell that took most from them, as far as ``LARGEST_CELL`` allows: the one with the larger name
    goes to the other, unless that one goes elsewhere itself."""
    bids = state.where("p IS NOT NULL")
    lost = bids.where("kept < mass").select("p", F.col("cell").alias("_from"), (F.col("mass") - F.col("kept")).alias("_n"))
    won = bids.where("kept > 0").select("p", F.col("cell").alias("_by")).distinct()
    rivals = lost.join(won, "p").where("_from <> _by").groupBy("_from", "_by").agg(F.sum("_n").alias("_n"))
    rivals = rivals.groupBy("_from").agg(F.max_by("_by", F.struct("_n", "_by")).alias("_by"))
    hooks = rivals.groupBy(F.greatest("_from", "_by").alias("_high")).agg(F.min(F.least("_from", "_by")).alias("_low"))
    hooks = materialise(hooks)
    hooks = hooks.join(hooks.select(F.col("_high").alias("_low")), "_low", "left_anti")
    sizes = cells.groupBy("cell").agg(F.sum("rows").alias("_rows"))
    hooks = hooks.join(sizes.withColumnRenamed("cell", "_high"), "_high").join(sizes.select(F.col("cell").alias("_low"), F.col("_rows").alias("_base")), "_low")
    upto = F.sum("_rows").over(Window.partitionBy("_low").orderBy("_rows", "_high"))
    hooks = hooks.where(F.col("_base") <= LARGEST_CELL).withColumn("_upto", upto).where(F.col("_base") + F.col("_upto") <= LARGEST_CELL)
    joined = cells.join(hooks.select(F.col("_high").alias("cell"), "_low"), "cell", "left")
    return materialise(joined.select("tile", "rows", F.coalesce("_low", "cell").alias("cell")))


def _on_a_line(asks: DataFrame, geo) -> bool:
    if geo.n_num != 1 or geo.n_cat or geo.n_window or geo.windows_on or geo.form:
        return False
    return not asks.where(F.col("reach") < float("inf")).limit(1).count()


def _runs(asks: DataFrame, offers: DataFrame, geo) -> DataFrame:
    """Both sides of each block along the line, with the number ``run`` of the independent part each row is in.

    With the total asked less offered up to a row, what can overflow to the right past it is that total less the least one up
    to there, and what can overflow to the left is the largest total from there on less that one. In a cheapest flow
    everything offered below an arc is used, so no arc is longer than that overflow.
    """
    rows = asks.select("blk", "x0", *geo.ss, "q", F.col("supply").alias("mass"), F.col("supply").alias("_step")).unionByName(
        offers.select("blk", "x0", "p", F.col("capacity").alias("mass"), (-F.col("capacity")).alias("_step")), allowMissingColumns=True
    )
    order = ["x0", "q", "p"]
    sliced = materialise(rows.repartitionByRange("blk", *order).withColumn("_slice", F.spark_partition_id()))
    keys = ["blk", "_slice"]
    inside, slices = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy("blk").orderBy("_slice")
    turned = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])  # frames that end at the row take one pass
    first, last, now = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    zero = F.lit(0).cast("long")

    shift = sliced.groupBy(*keys).agg(F.sum("_step").alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(slices.rowsBetween(first, -1)), zero).alias("_before"))
    totals = attach(sliced.withColumn("_total", F.sum("_step").over(inside.rowsBetween(first, now))), shift, keys)
    totals = materialise(totals.withColumn("_total", F.col("_total") + F.col("_before")).drop("_before"))
    ends = totals.groupBy(*keys).agg(F.min("_total").alias("_low"), F.max("_total").alias("_high")).select(
        *keys, F.min("_low").over(slices.rowsBetween(first, -1)).alias("_least"), F.max("_high").over(slices.rowsBetween(1, last)).alias("_most")
    )
    least, most = F.min("_total").over(inside.rowsBetween(first, now)), F.max("_total").over(turned.rowsBetween(first, now))
    marked = attach(totals.withColumns({"_down": least, "_up": most}), ends, keys)
    closed = (F.least("_down", "_least", zero) == F.col("_total")) & (F.greatest("_up", "_most") == F.col("_total"))
    marked = materialise(marked.withColumn("_cut", closed.cast("long")).drop("_total", "_down", "_up", "_least", "_most", "_step"))
    shift = marked.groupBy(*keys).agg(F.sum("_cut").alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(slices.rowsBetween(first, -1)), zero).alias("_before"))
    numbered = attach(marked.withColumn("run", F.coalesce(F.sum("_cut").over(inside.rowsBetween(first, -1)), zero)), shift, keys)
    return numbered.withColumn("run", F.col("run") + F.col("_before")).drop("_before", "_cut", "_slice")


def _settle_runs(geo):
    """A cheapest flow of each run of a frame."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["run", "x0", "q", "p"], kind="stable")
        x, mass, asking = rows["x0"].to_numpy(float), rows["mass"].to_numpy(np.int64), rows["q"].notna().to_numpy()
        scale = rows[geo.ss[0]].to_numpy(float) if geo.ss else None
        starts = np.flatnonzero(np.diff(rows["run"].to_numpy(), prepend=-1))
        froms, tos, masses, dists = [], [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(rows))):
            i, j = a + np.flatnonzero(asking[a:b]), a + np.flatnonzero(~asking[a:b])
            gap = x[i][:, None] - x[j][None, :]
            numeric = gap * gap if geo.metric == "euclidean" else np.abs(gap) if scale is None else np.abs(gap) / scale[i][:, None]
            cost = geo.combine(numeric, 0.0, np.sqrt)
            flow = ship(cost, mass[i], mass[j])
            r, c = np.nonzero(flow)
            froms.append(i[r])
            tos.append(j[c])
            masses.append(flow[r, c])
            dists.append(cost[r, c])
        q, p = np.concatenate(froms), np.concatenate(tos)
        return pd.DataFrame({
            "blk": rows["blk"].to_numpy()[q], "q": rows["q"].to_numpy()[q], "p": rows["p"].to_numpy()[p],
            "mass": np.concatenate(masses), "dist": np.concatenate(dists), "step": 0.0,
        })

    return settle


def _flow(asks: DataFrame, offers: DataFrame, geo, rows: int) -> DataFrame:
    """Rows ``(blk, q, p, mass, dist, step)`` of a cheapest flow that ships as much as possible.

    ``asks`` has ``supply`` and ``enough`` (so many nearest places surely suffice), ``offers`` has ``capacity``; no
    block has more than ``rows`` asks, and none asks for more than it offers.
    """
    if not _on_a_line(asks, geo):
        return _auction(asks, offers, geo, rows)
    along = materialise(_runs(asks, offers, geo))
    sizes = along.groupBy("blk", "run").agg(F.count("q").alias("_asks"), F.count("p").alias("_offers")).where("_asks > 0")
    sizes = sizes.withColumn("_large", (F.col("_asks") > LARGEST_CELL) | (F.col("_asks") * F.col("_offers") > RUN_PAIRS))
    sizes = materialise(sizes.select("blk", "run", "_large"))
    n_runs, n_large = sizes.agg(F.count(F.lit(1)), F.count_if("_large")).first()
    along = materialise(attach(along, sizes, ["blk", "run"], rows=n_runs))
    types = dict(asks.dtypes) | dict(offers.dtypes)
    # Ids travel as text: a column with holes would turn whole numbers into fractions.
    small = along.where("NOT _large").withColumns({"q": F.col("q").cast("string"), "p": F.col("p").cast("string"), "_task": F.floor(F.col("run") / RUNS)})
    flow = small.groupBy("blk", "_task").applyInPandas(_settle_runs(geo), "blk string, q string, p string, mass long, dist double, step double")
    flow = flow.withColumns({c: F.col(c).cast(types[c]) for c in ("q", "p")})
    if not n_large:
        return flow
    large = along.where("_large")
    asks, offers = asks.join(large.select("q"), "q", "left_semi"), offers.join(large.select("p"), "p", "left_semi")
    return flow.unionByName(_auction(asks, offers, geo, rows))


def _auction(asks: DataFrame, offers: DataFrame, geo, rows: int) -> DataFrame:
    """The flow by rounds of bids between cells."""
    spark = asks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = in_cells(asks, geo, rows, CELL).withColumn("need", F.least("enough", F.lit(FIRST_LIST)).cast("long"))
    asks, offers = materialise(asks), materialise(offers)
    farthest = _farthest(asks, offers, geo)
    # No rearrangement can cost as much: it moves at most every row of a block, each by a distance.
    penalty = 3.0 * farthest * (rows + 1) + 1.0
    raise_by = max(PRECISION * farthest, 1e-14 * penalty)
    types = dict(asks.dtypes) | dict(offers.dtypes)
    schema = f"tile string, cell string, blk string, q {types['q']}, p {types['p']}, mass long, price double, cost double, capacity long, more boolean"
    lists = _lists(asks, offers, geo, None)
    cells, n_tiles = with_size(asks.groupBy("tile").agg(F.count(F.lit(1)).alias("rows")).withColumn("cell", F.col("tile")))
    held, active, rounds = None, cells.select("tile", "cell"), 0
    while True:
        rounds += 1
        here = attach(lists, active, ["tile"], rows=n_tiles)
        if held is None:
            slots = spark.createDataFrame([], f"cell string, p {types['p']}, mass long, price double, own boolean")
        else:
            held = attach(held, cells.select("tile", "cell"), ["tile"], rows=n_tiles)
            wanted = here.where("p IS NOT NULL").select("cell", "p").distinct()
            holders = held.where("p IS NOT NULL").groupBy("p", F.col("cell").alias("_by"), "price").agg(F.sum("mass").alias("mass"))
            slots = wanted.join(holders, "p").select("cell", "p", "mass", "price", (F.col("_by") == F.col("cell")).alias("own"))
        # New names for the same columns, so that both sides may come from one table. The tables are small for the work
        # on them, so their parts are not to be joined again.
        here, slots = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, "cell") for df in (here, slots))
        step = raise_by * 2.0 ** max(0, rounds - PATIENCE)
        bids = here.groupBy("cell").cogroup(slots.groupBy("cell")).applyInPandas(_settle(step, penalty), schema)
        if held is not None:
            bids = bids.unionByName(held.join(active.select("tile"), "tile", "left_anti").withColumn("more", F.lit(False)))
        best = Window.partitionBy("p").orderBy(F.desc("price"), "cell", "q").rowsBetween(Window.unboundedPreceding, 0)
        placed = bids.where("p IS NOT NULL").withColumn("_upto", F.sum("mass").over(best))
        kept = F.least(F.col("mass"), F.greatest(F.lit(0), F.col("capacity") - (F.col("_upto") - F.col("mass"))))
        placed = placed.withColumn("kept", kept).drop("_upto")
        state = materialise(placed.unionByName(bids.where("p IS NULL").withColumn("kept", F.when(F.col("more"), F.lit(0)).otherwise(F.col("mass")).cast("long"))))
        held = state.where("kept > 0").select(*[F.col("kept").alias("mass") if c == "mass" else F.col(c) for c in _STATE if c not in ("more", "cell")])
        unplaced, longer = state.agg(F.count_if(F.col("kept") < F.col("mass")), F.count_if("more")).first()
        if not unplaced:
            break
        if longer:
            short = materialise(state.where("more").select("q").distinct())
            sizes = lists.where("p IS NULL").join(short, "q").select("q", (F.col("need") * 4).alias("need"))
            asked = asks.drop("need").join(sizes, "q")
            fresh = _lists(asked, offers, geo, held)
            known = lists.where("p IS NOT NULL").select("q", "p")
            kept = lists.join(short, "q", "left_anti").unionByName(lists.join(short, "q", "left_semi").where("p IS NOT NULL"))
            lists = materialise(kept.unionByName(fresh.join(known, ["q", "p"], "left_anti")))
        if rounds % MERGE_EVERY == 0:
            cells = _merged(cells, state)
        stirred = state.where("kept < mass").select("tile").distinct().join(cells, "tile").select("cell").distinct()
        active = materialise(cells.join(stirred, "cell").select("tile", "cell"))
    prices = _prices(held).select("p", F.col("price").alias("_price"))
    options = lists.join(prices, "p", "left").groupBy("blk", "q").agg(F.min(F.col("cost") + F.coalesce("_price", F.lit(0.0))).alias("_best"))
    flow = held.where("p IS NOT NULL").select("blk", "q", "p", "mass", F.col("cost").alias("dist")).join(prices, "p").join(options, ["blk", "q"])
    short_of = F.col("dist") + F.col("_price") - F.col("_best")
    step = F.when(short_of > 1e-14 * penalty, short_of).otherwise(0.0)  # less is rounding: prices go up to the penalty
    return flow.select("blk", "q", "p", "mass", "dist", step.alias("step"))


def _farthest(asks: DataFrame, offers: DataFrame, geo) -> float:
    """An upper bound of every distance between the two sides."""
    if geo.metric != "euclidean":
        return float(geo.combine(float(geo.n_num), float(geo.n_cat), np.sqrt))
    xs = [f"x{i}" for i in range(geo.n_num)]
    both = asks.select(*xs).unionByName(offers.select(*xs))
    row = both.agg(*[(F.max(x) - F.min(x)).alias(x) for x in xs]).first()
    return float(np.sqrt(sum((row[x] or 0.0) ** 2 for x in xs)))


def _classes(units: DataFrame, geo, name: str) -> tuple[DataFrame, DataFrame, bool]:
    """Units that agree in everything a distance or window reads as one row named by the first of them, with
    their number ``units``; all units with their class and their place in it (from 1); whether any share a class."""
    same = ["blk", *geo.xs, *geo.cs]
    if (units.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1) == 1:
        one = F.lit(1).cast("long")
        return units.drop("stratum").withColumn("units", one), units.select("blk", F.col(name).alias("_first"), name, one.alias("_nth")), False
    first = units.groupBy(*same).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("units"), *[F.first(c).alias(c) for c in [*geo.ss, *geo.ts, "reach"]])
    first = materialise(first)
    keys = first.select(F.col(name).alias("_first"), *[F.col(c).alias(f"_same{i}") for i, c in enumerate(same)])
    members = units.select(name, *same).join(keys, [F.col(c).eqNullSafe(F.col(f"_same{i}")) for i, c in enumerate(same)])
    return first, running_total(members.select("blk", "_first", name), ["_first"], [name], out="_nth"), True


def _unit_pairs(flow: DataFrame, query_members: DataFrame, pool_members: DataFrame) -> DataFrame:
    """Pairs of single units from the flow between classes: the units of a class go to its partners in turn."""
    for side, other in (("q", "p"), ("p", "q")):
        before = Window.partitionBy(side).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
        flow = flow.withColumn(f"_{side}", F.coalesce(F.sum("mass").over(before), F.lit(0)))
    single = flow.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mass"))))
    single = single.select("blk", "dist", "step", F.col("q").alias("_cq"), F.col("p").alias("_cp"), (F.col("_q") + F.col("_j")).alias("_nq"), (F.col("_p") + F.col("_j")).alias("_np"))
    out = single.join(query_members.select(F.col("_first").alias("_cq"), F.col("_nth").alias("_nq"), "q"), ["_cq", "_nq"])
    out = out.join(pool_members.select(F.col("_first").alias("_cp"), F.col("_nth").alias("_np"), "p"), ["_cp", "_np"])
    return out.select("blk", "q", "p", "dist", "step")


def optimal_pairs(cohort: DataFrame, id_col: str, rule: PairRule) -> DataFrame:
    """As many one-to-one pairs as possible at the least total distance, per stratum.

    Rows ``(stratum, query_id, pool_id, dist, step)``; the sum of ``step`` bounds how far the total may be
    above the optimum.
    """
    units = compare_units(cohort, id_col, rule)
    queries, pool = materialise(units.queries), materialise(units.pool)
    sizes = queries.groupBy("blk").agg(F.count(F.lit(1)).alias("_m")).join(
        pool.groupBy("blk").agg(F.count(F.lit(1)).alias("_n")), "blk"
    )
    sizes = materialise(sizes.withColumn("_turned", F.col("_m") > F.col("_n")))
    rows, n_turned, largest = sizes.agg(F.count(F.lit(1)), F.count_if("_turned"), F.max(F.least("_m", "_n"))).first()
    found = []
    for turned in (False, True):
        mine = sizes.where("_turned" if turned else "!_turned").select("blk", F.least("_m", "_n").alias("enough"))
        if not (n_turned if turned else rows - n_turned):
            continue
        # The smaller side asks: it needs no more places than it has members.
        asks, offers = (pool.withColumnRenamed("p", "q"), queries.withColumnRenamed("q", "p")) if turned else (queries, pool)
        asks, ask_members, shared = _classes(asks.join(mine, "blk", "left_semi"), units.geometry, "q")
        offers, offer_members, also = _classes(offers.join(mine, "blk", "left_semi"), units.geometry, "p")
        asks = attach(asks, mine, ["blk"], rows=rows)
        flow = _flow(asks.withColumnRenamed("units", "supply"), offers.withColumnRenamed("units", "capacity"), units.geometry, largest)
        pairs = _unit_pairs(flow, ask_members, offer_members) if shared or also else flow
        query, partner = ("p", "q") if turned else ("q", "p")
        found.append(pairs.select(F.substring_index("blk", "\x1f", 1).alias("stratum"), named(query).alias("query_id"), named(partner).alias("pool_id"), "dist", "step"))
    if not found:
        types = dict(cohort.dtypes)
        return cohort.sparkSession.createDataFrame(
            [], f"stratum string, query_id {types[id_col]}, pool_id {types[id_col]}, dist double, step double"
        )
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _transport(cohort: DataFrame, id_col: str, rule: PairRule, target_size: int):
    """The compared units, block sizes and their number, the flow, and the mass of each pool unit that got any."""
    if target_size < 1:
        raise MatchError("target_size must be positive")
    if any(w.covariate in rule.categorical for w in rule.windows):
        raise MatchError("transport selection takes numeric windows only")
    units = compare_units(cohort, id_col, rule)
    queries, pool = materialise(units.queries), materialise(units.pool)
    sizes = queries.groupBy("blk").agg(F.count(F.lit(1)).alias("_m")).join(
        pool.groupBy("blk").agg(F.count(F.lit(1)).alias("_n")), "blk"
    )
    sizes = materialise(sizes)
    rows, short, largest = sizes.agg(F.count(F.lit(1)), F.min("_n"), F.max("_m")).first()
    if short is not None and short < target_size:
        raise MatchError(f"target_size {target_size} exceeds a pool of {short}")
    # Masses in whole units: a query ships target_size of them, a pool unit takes as many as there are queries.
    asks, *_ = _classes(queries.join(sizes, "blk", "left_semi"), units.geometry, "q")
    asks = asks.withColumns({"supply": F.col("units") * target_size, "enough": F.lit(target_size).cast("long")}).drop("units")
    offers, members, _ = _classes(pool.join(sizes, "blk", "left_semi"), units.geometry, "p")
    offers = attach(offers, sizes.select("blk", "_m"), ["blk"], rows=rows).withColumn("capacity", F.col("units") * F.col("_m")).drop("units", "_m")
    flow = materialise(_flow(asks, offers, units.geometry, largest or 0))
    taken = flow.groupBy(F.col("p").alias("_first")).agg(F.sum("mass").alias("_all"))
    # The units of a class are filled one after the other.
    filled = attach(members.join(taken, "_first"), sizes.select("blk", "_m"), ["blk"], rows=rows)
    mass = filled.select("blk", "p", F.least(F.col("_m"), F.greatest(F.lit(0), F.col("_all") - (F.col("_nth") - 1) * F.col("_m"))).alias("_mass"))
    return units.geometry, queries, pool, sizes, rows, flow, mass


def transport_report(cohort: DataFrame, id_col: str, rule: PairRule, target_size: int) -> DataFrame:
    """Per stratum: the mass the plan ships (1 if every query finds room), the heaviest unit, the cost per unit of mass
    and a bound of how far it may lie above the least cost."""
    _, _, _, sizes, rows, flow, mass = _transport(cohort, id_col, rule, target_size)
    total = F.col("_m") * target_size
    shipped = flow.groupBy("blk").agg(F.sum("mass").alias("_all"), F.sum(F.col("mass") * F.col("dist")).alias("_cost"), F.sum(F.col("mass") * F.col("step")).alias("_gap"))
    heaviest = mass.groupBy("blk").agg(F.max("_mass").alias("_most"))
    found = attach(shipped.join(heaviest, "blk"), sizes, ["blk"], rows=rows)
    return found.select(
        F.col("blk").alias("stratum"), (F.col("_all") / total).alias("shipped"), (F.col("_most") / total).alias("heaviest"),
        (F.col("_cost") / total).alias("cost"), (F.col("_gap") / total).alias("gap"),
    )


def transport_selection(cohort: DataFrame, id_col: str, rule: PairRule, target_size: int) -> DataFrame:
    """Choose ``target_size`` pool units per stratum that can stand in for the query group.

    Every query ships equal mass (1 in all), no pool unit takes more than 1/target_size; units
    are chosen by mass received, then by distance to the nearest query.
    Rows ``(stratum, pool_id, weight, dist)``.
    """
    geometry, queries, pool, sizes, rows, _, mass = _transport(cohort, id_col, rule, target_size)
    # Units without mass fill up the selection by nearness: each pool unit's nearest query.
    turned = nearest(pool.drop("stratum").withColumnRenamed("p", "q"), queries.drop("stratum").withColumnRenamed("q", "p"), geometry, 1)
    close = turned.select("blk", F.col("q").alias("p"), F.col("dist").alias("_near"))
    ranked = close.join(mass, ["blk", "p"], "left").withColumn("_mass", F.coalesce("_mass", F.lit(0)))
    placed = running_total(ranked.withColumn("_down", -F.col("_mass")), ["blk"], ["_down", "_near", "p"], out="_r")
    chosen = placed.where(F.col("_r") <= target_size)
    totals = sizes.select("blk", (F.col("_m") * target_size).alias("_all"))
    return attach(chosen, totals, ["blk"], rows=rows).select(
        F.col("blk").alias("stratum"), F.col("p").alias("pool_id"),
        (F.col("_mass") / F.col("_all")).alias("weight"), F.col("_near").alias("dist"),
    )
