"""Greedy 1:k matching.

With replacement every query simply keeps its k nearest units. Without replacement the
queries are served in order and each takes the nearest units still free. That order makes
the outcome a stable matching in which every pool unit prefers the earlier query, so it is
reached by rounds of proposals in any order:

* the queries to be placed go through their lists cell by cell (near queries share a cell), each to
  the first unit that nobody earlier holds;
* a unit goes to the earliest of its proposers and its holder; the others, and a holder that was passed
  over, are the ones to be placed in the next round. Nobody else moves, and what a round settles is added to
  what earlier rounds settled;
* a query that reaches the end of its list asks for a new one, among the units it could
  still win. An empty list settles that it stays unmatched. Queries ask together, once they are as many as those that move
  on without asking.

Queries with equal features share one list: the j-th of them can do no better than the
j-th entry, so a group of copies costs as much as its size and not its square, and parts of it
need only their part of the list.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running_total
from ..functions.tools import materialise, named
from .assign import in_cells
from .distance import PairRule, compare_units, nearest_pairs
from .neighbours import nearest

FREE = 1e18  # place in the order of a unit nobody holds
SPARE_ENTRIES = 12  # list entries beyond the number of queries sharing the list
CELL_LISTS = 512  # lists of one cell
SHORT_SHARE = 64  # a list with more takers has cells of its own
MEMBER_PART = 4096  # most takers of one list that are placed together
LOG_PARTS = 6  # rounds whose results are kept apart before they are joined


def greedy_with_replacement(cohort: DataFrame, id_col: str, rule: PairRule, k: int = 1) -> DataFrame:
    return nearest_pairs(cohort, id_col, rule, k)


def _takers(queries: DataFrame, geo, order: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """One row per (query, slot) with its place in the serving order, its list and cell, and one row per class of equal
    queries with how many takers (``need``) it has."""
    ordered = materialise(running_total(queries, [], order, out="_row"))
    same = ["blk", *geo.xs, *geo.cs]
    classes = ordered.groupBy(*same).agg(
        F.min("_row").alias("q"), F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in [*geo.ss, *geo.ts, "reach"]]
    )
    rows = ordered.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    classes = materialise(in_cells(classes, geo, rows, CELL_LISTS))
    if (classes.agg(F.max("_n")).first()[0] or 1) == 1:
        placed = ordered.select("stratum", "q", "_row", F.lit(0).cast("long").alias("_j")).join(
            classes.select(F.col("q").alias("_row"), "_n", "tile"), "_row"
        ).withColumn("cls", F.col("_row"))
    else:
        keys = classes.select(F.col("q").alias("cls"), "_n", "tile", *[F.col(c).alias(f"_same{i}") for i, c in enumerate(same)])
        placed = ordered.join(keys, [F.col(c).eqNullSafe(F.col(f"_same{i}")) for i, c in enumerate(same)])
        placed = running_total(placed.select("stratum", "q", "_row", "cls", "_n", "tile"), ["cls"], ["_row"], out="_j").withColumn("_j", F.col("_j") - 1)
    slots = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.floor((F.col("_j") * k + F.col("slot")) / MEMBER_PART)
    own = F.col("_n") * k > SHORT_SHARE
    takers = slots.select(
        F.when(own, F.concat_ws(":", "tile", F.col("cls").cast("string"), part.cast("string"))).otherwise(F.col("tile")).alias("cell"),
        F.concat_ws(":", F.col("cls").cast("string"), part.cast("string")).alias("owner"), "cls",
        "stratum", "q", F.col("slot").cast("int").alias("slot"), (F.col("_row") * k + F.col("slot")).cast("double").alias("prio"), F.lit(0).cast("long").alias("pos"),
    )
    return takers, classes.withColumn("need", F.col("_n") * k).drop("_n", "tile")


def _serve(takers: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """The takers of one cell in serving order: each to the first unit on its list that nobody earlier holds."""
    takers = takers.sort_values("prio", kind="stable")
    ends = lists[lists["p"].isna()].set_index("owner")["complete"].to_dict()
    entries = lists[lists["p"].notna()].sort_values(["owner", "rank"], kind="stable")
    units, dist, held = entries["p"].to_numpy(), entries["dist"].to_numpy(float), entries["held"].to_numpy(float)
    names, first = np.unique(entries["owner"].to_numpy(), return_index=True)
    bounds = dict(zip(names, zip(first.tolist(), [*first[1:].tolist(), len(entries)])))
    lead, taken = dict.fromkeys(ends, 0), set()
    unit, far, position, state = [], [], [], []
    for owner, prio, pos in zip(takers["owner"], takers["prio"], takers["pos"]):
        start, stop = bounds.get(owner, (0, 0))
        at = start + max(pos, lead[owner])
        while at < stop and (held[at] < prio or units[at] in taken):
            at += 1
        lead[owner] = at + 1 - start
        position.append(at + 1 - start)
        if at < stop:
            taken.add(units[at])
            unit.append(units[at])
            far.append(dist[at])
            state.append("held")
        else:
            unit.append(None)
            far.append(0.0)
            state.append("none" if ends[owner] else "more")
    out = takers.drop(columns=["cls"]).assign(pos=position, p=pd.Series(unit, dtype=object).to_numpy(), dist=far, state=state)
    return out[_PLACED]


_PLACED = ["cell", "owner", "stratum", "q", "slot", "prio", "pos", "p", "dist", "state"]


def _first_lists(takers: DataFrame, classes: DataFrame, pool: DataFrame, geo) -> DataFrame:
    """(owner, rank, p, dist, complete): of each class's list the part its takers need, and a row without a unit per list."""
    asked = classes.withColumn("need", F.col("need") + SPARE_ENTRIES)
    found = materialise(nearest(asked, pool, geo))
    sizes = asked.select("q", "need").join(found.groupBy("q").agg(F.count(F.lit(1)).alias("_got")), "q", "left")
    sizes = sizes.select("q", (F.coalesce("_got", F.lit(0)) < F.col("need")).alias("_all"), F.floor((F.col("need") - SPARE_ENTRIES - 1) / MEMBER_PART).alias("_last"))
    sizes = materialise(sizes)
    at = F.col("rank").cast("long") - 1
    spread = found.join(sizes, "q").withColumn("_part", F.explode(F.sequence(
        F.greatest(F.lit(0).cast("long"), F.floor((at - SPARE_ENTRIES) / MEMBER_PART)), F.least(F.col("_last"), F.floor(at / MEMBER_PART))
    )))
    entries = spread.where(at < (F.col("_part") + 1) * MEMBER_PART + SPARE_ENTRIES)
    owner = F.concat_ws(":", F.col("q").cast("string"), F.col("_part").cast("string")).alias("owner")
    ends = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    ends = ends.select(owner, F.lit(0).cast("long").alias("rank"), F.lit(None).cast(pool.schema["p"].dataType).alias("p"), F.lit(0.0).alias("dist"),
                       (F.col("_all") & (F.col("_part") == F.col("_last"))).alias("complete"))
    return entries.select(owner, F.col("rank").cast("long").alias("rank"), "p", "dist", F.lit(False).alias("complete")).unionByName(ends)


def _holders(log: list[DataFrame], units: DataFrame | None = None) -> DataFrame:
    """The earliest taker each unit was settled on, of all units or of the given ones."""
    rows = log[0]
    for part in log[1:]:
        rows = rows.unionByName(part)
    if units is not None:
        rows = rows.join(units, "p", "left_semi")
    others = [c for c in _PLACED if c not in ("p", "prio")]
    best = rows.groupBy("p").agg(F.min_by(F.struct(*others), "prio").alias("_b"), F.min("prio").alias("prio"))
    return best.select("p", "prio", "_b.*").select(*_PLACED)


def greedy_without_replacement(
    cohort: DataFrame, id_col: str, rule: PairRule, k: int = 1, order_col: str | None = None
) -> DataFrame:
    """Each query in turn (by ``order_col``, then id) takes its k nearest units that are still free."""
    units = compare_units(cohort, id_col, rule)
    geo = units.geometry
    queries, order = units.queries, ["q"]
    if order_col is not None:
        places = cohort.select(named(id_col).alias("q"), named(order_col).alias("_order"))
        queries, order = queries.join(places, "q"), ["_order", "q"]
    spark, pool = cohort.sparkSession, materialise(units.pool)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    takers, classes = _takers(queries, geo, order, k)
    moving, lists = materialise(takers), [materialise(_first_lists(takers, classes, pool, geo))]
    types = dict(moving.dtypes) | {"p": dict(pool.dtypes)["p"]}
    schema = ", ".join(f"{c} {t}" for c, t in [(c, types.get(c, {"dist": "double", "state": "string"}.get(c))) for c in _PLACED])
    log: list[DataFrame] = []
    parked: list[DataFrame] = []  # takers that reached the end of their lists and have not asked for a new one yet
    generation, spare, n_parked = 0, SPARE_ENTRIES, 0
    while True:
        owners = moving.groupBy("owner").agg(F.min("cell").alias("cell"))
        entries = reduce(DataFrame.unionByName, lists).join(owners, "owner")
        if log:
            held = _holders(log, entries.where("p IS NOT NULL").select("p").distinct()).select("p", F.col("prio").alias("held"))
            entries = entries.join(held, "p", "left").withColumn("held", F.coalesce("held", F.lit(FREE)))
        else:
            entries = entries.withColumn("held", F.lit(FREE))
        # New names for the same columns, so that both sides may come from one table.
        sides = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, "cell") for df in (moving, entries))
        left, right = (df.groupBy("cell") for df in sides)
        placed = materialise(left.cogroup(right).applyInPandas(_serve, schema))
        bids = placed.where("state = 'held'").withColumn("_old", F.lit(False))
        if log:
            bids = bids.unionByName(_holders(log, bids.select("p").distinct()).withColumn("_old", F.lit(True)))
        judged = bids.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy("prio")))
        judged = materialise(judged)
        log.append(judged.where("_r = 1 AND NOT _old").select(*_PLACED))
        if len(log) >= LOG_PARTS:
            log = [materialise(_holders(log))]
        waiting = placed.where("state = 'more'")
        n_lost, n_waiting = judged.agg(F.count_if(F.col("_r") > 1)).first()[0], waiting.count()
        if n_waiting:
            parked.append(waiting)
            n_parked += n_waiting
        if not n_lost and not n_parked:
            break
        cls = F.substring_index("owner", ":", 1).cast("long").alias("cls")
        moving = judged.where("_r > 1").select("cell", "owner", cls, "stratum", "q", "slot", "prio", "pos")
        if n_parked >= n_lost:
            # New lists for all who reached the end of theirs: units they could still win. A search costs more than a round, so
            # they wait until they are as many as those that move on without one; the outcome does not depend on it.
            generation, spare = generation + 1, spare * 2
            again = reduce(DataFrame.unionByName, parked).select("cell", F.concat("owner", F.lit(f":{generation}")).alias("owner"), cls, "stratum", "q", "slot", "prio", F.lit(0).cast("long").alias("pos"))
            again, parked, n_parked = materialise(again), [], 0
            moving = materialise(moving.unionByName(again)) if n_lost else again
            asking = again.groupBy("owner", "cls").agg(F.min("prio").alias("prio"), (F.count(F.lit(1)) + spare).alias("need"))
            offered = pool.join(_holders(log).select("p", F.col("prio").alias("bound")), "p", "left").withColumn("bound", F.coalesce("bound", F.lit(FREE)))
            asked = classes.drop("need").withColumnRenamed("q", "cls").join(asking, "cls").withColumnRenamed("owner", "q").drop("cls")
            asked = materialise(asked)
            found = materialise(nearest(asked, materialise(offered), geo))
            got = asked.select("q", "need").join(found.groupBy("q").agg(F.count(F.lit(1)).alias("_got")), "q", "left")
            ends = got.select(F.col("q").alias("owner"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast(types["p"]).alias("p"), F.lit(0.0).alias("dist"),
                              (F.coalesce("_got", F.lit(0)) < F.col("need")).alias("complete"))
            fresh = found.select(F.col("q").alias("owner"), F.col("rank").cast("long").alias("rank"), "p", "dist", F.lit(False).alias("complete"))
            # Earlier lists stay as they are: a new list has a name of its own.
            lists.append(materialise(fresh.unionByName(ends)))
            if len(lists) > LOG_PARTS:
                lists = [lists[0], materialise(reduce(DataFrame.unionByName, lists[1:]))]
    return _holders(log).select(
        "stratum", F.col("q").alias("query_id"), F.col("p").alias("pool_id"), "dist", (F.col("slot") + 1).cast("int").alias("rank")
    )


def greedy_pairs(
    cohort: DataFrame, id_col: str, rule: PairRule, k: int = 1, replacement: bool = False, order_col: str | None = None
) -> DataFrame:
    """``(stratum, query_id, pool_id, dist, rank)``."""
    if replacement:
        return greedy_with_replacement(cohort, id_col, rule, k)
    return greedy_without_replacement(cohort, id_col, rule, k, order_col)
