"""

Cohorts on the given tables:
  customers  treated = segment BUILDING, covariates balance and number of orders
  orders     treated = priority 1-URGENT, covariates price and days since 1995-01-01
  lineitem   treated = return flag R (balance and profile only; it has no unique key)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.config import ColumnSpec, EncodingRule, MissingRule, ScalingRule, TableConfig
from pairwell.functions.tools import shared_folder
from pairwell.operators import assign, balance, clean, cohort, columns, distance, encode, greedy, impute, matched
from pairwell.operators import profile, propensity, scale
from pairwell.operators.distance import PairRule, Window
from pairwell.plans.run import RunResult, run_matching
from pairwell.plans.spec import MatchSpec
from pairwell.sources.files import describe_columns, load, load_many
from pairwell.sources.merge import check_compatibility, check_config_compatibility, merge_populations
from pairwell.sources.results import compare_runs, promote, save_result
from pairwell.sources.states import FittedState, load_state, save_state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def entry(spark: SparkSession) -> DataFrame:
    """Balance of the customer cohort before and after nearest-neighbour matching."""
    return _QUERIES["balance_table"](spark, "/root/testdata/sf0.001")


# ---------------------------------------------------------------- inputs


def table(spark, sf_dir, name):
    return load(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def customers(spark, sf_dir) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return base.join(counts, "c_custkey", "left").join(nations, "c_nationkey").select(
        "c_custkey", "c_nationkey", "region", "c_acctbal", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"),
    )


CUSTOMERS = """customers AS (
  SELECT c_custkey, c_nationkey, n_regionkey AS region, c_acctbal, coalesce(n_orders, 0) AS n_orders,
         CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS treated
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double").alias("days"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("treated"),
    )


ORDERS = """orders_ AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice AS price,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS treated FROM orders)"""

ITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *ITEM_NUMBERS, "l_linestatus", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("bulky"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity_gaps"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linestatus")).alias("status_gaps"),
        (F.col("l_returnflag") == "R").cast("int").alias("treated"),
    )


ITEMS = """items AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_linenumber,
         CAST(l_quantity > 25 AS INTEGER) AS bulky,
         CASE WHEN l_orderkey % 7 != 0 THEN l_quantity END AS quantity_gaps,
         CASE WHEN l_orderkey % 5 != 0 THEN l_linestatus END AS status_gaps,
         CAST(l_returnflag = 'R' AS INTEGER) AS treated FROM lineitem)"""

LONG_ITEMS = ITEMS + """, long_items AS (
  SELECT treated, u.variable, u.value FROM items, LATERAL (VALUES
    ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice),
    ('l_discount', l_discount), ('l_tax', l_tax)) u(variable, value))"""


# ---------------------------------------------------------------- sources


@query("load_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("describe_table", """SELECT position, name, (SELECT count(*) FROM customer) AS n_rows, 5 AS n_columns
FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment')) t(position, name)""")
def _(spark, sf_dir):
    return describe_columns(table(spark, sf_dir, "customer"))


@query("promote_dataset", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000""")
def _(spark, sf_dir):
    source = RunResult(datasets={"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")})
    return promote(source, "orders", [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", "gte", "100000")])


# ---------------------------------------------------------------- cleaning


def cleaned(spark, sf_dir, name, **specs):
    return clean.preprocess(table(spark, sf_dir, name), TableConfig({n: ColumnSpec(n, **kw) for n, kw in specs.items()}))


@query("select_and_rename", "SELECT p_partkey AS part_id, p_brand AS brand FROM part")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "part", part_id={"source_name": "p_partkey", "id": True}, brand={"source_name": "p_brand", "categorical": True}, p_size={"active": False})


@query("map_values", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "orders", o_orderkey={"id": True}, o_orderpriority={"categorical": True, "mappings": {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}})


@query("map_values_numeric", """SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation""")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "nation", n_nationkey={"id": True}, n_regionkey={"categorical": True, "type": "string", "mappings": {"0": "zero", 1: "one", "a": "never"}})


@query("encode_dotted_values", """SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "home.seg__B.1", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "home.seg__M`2",
CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS DOUBLE) AS "home.seg__rest" FROM customer""")
def _(spark, sf_dir):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "B.1").when(F.col("c_mktsegment") == "MACHINERY", "M`2").otherwise("rest")
    df = table(spark, sf_dir, "customer").select("c_custkey", segment.alias("home.seg"))
    config = TableConfig({"c_custkey": ColumnSpec("c_custkey", id=True), "home.seg": ColumnSpec("home.seg", categorical=True, encoding=EncodingRule(True, "one_hot"))})
    return encode.encode(df, config, encode.fit_encoding(df, config))


@query("blank_missing_tokens", """SELECT l_orderkey, CASE WHEN l_returnflag IN ('N', 'NA') THEN NULL ELSE l_returnflag END AS l_returnflag,
l_linestatus FROM lineitem""")
def _(spark, sf_dir):
    rule = {"strategy": "impute", "imputer": "most_frequent", "condition": ("N", "NA")}
    return cleaned(spark, sf_dir, "lineitem", l_orderkey={}, l_returnflag={"categorical": True, "missing_data_management": MissingRule(**rule)}, l_linestatus={"categorical": True})


@query("lenient_cast", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN '1' WHEN o_orderpriority = '2-HIGH' THEN '2'
ELSE o_orderpriority END AS DOUBLE) AS o_orderpriority, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders""")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "orders", o_orderkey={}, o_orderpriority={"type": "float64", "mappings": {"1-URGENT": "1", "2-HIGH": "2"}}, o_custkey={"type": "int32"})


@query("multiply", "SELECT p_partkey, p_retailprice * 1.5 AS p_retailprice, p_size * 2.0 AS p_size FROM part")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "part", p_partkey={}, p_retailprice={"numerical": True, "multiplier": 1.5}, p_size={"numerical": True, "multiplier": 2.0})


@query("drop_incomplete_rows", """SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem
WHERE l_returnflag != 'N' AND l_linestatus != 'O'""")
def _(spark, sf_dir):
    drop = lambda token: MissingRule("drop", condition=(token,))
    return cleaned(spark, sf_dir, "lineitem", l_orderkey={}, l_returnflag={"missing_data_management": drop("N")}, l_linestatus={"missing_data_management": drop("O")})


@query("replace_missing", """SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END AS l_returnflag FROM lineitem""")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir, "lineitem", l_orderkey={}, l_returnflag={"missing_data_management": MissingRule("replace", value="none", condition=("N",))})


@query("filter_rows", """SELECT l_orderkey, l_quantity, l_discount, l_returnflag FROM lineitem
WHERE l_quantity > 10 AND l_discount <= 0.05 AND l_returnflag NOT IN ('A') AND l_linestatus != 'O'""")
def _(spark, sf_dir):
    kept = clean.filter_rows(table(spark, sf_dir, "lineitem"), [
        ("l_quantity", "gt", "10"), ("l_discount", "lte", 0.05), ("l_returnflag", "not_in", ["A"]), ("l_linestatus", "ne", "O")])
    return kept.select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")


# ---------------------------------------------------------------- columns and merging


@query("infer_roles", f"""WITH {ITEMS}, facts AS (SELECT u.* FROM (
  SELECT bool_and(l_quantity IN (0, 1)) AS b1, bool_or(l_quantity != floor(l_quantity)) AS f1,
         bool_and(l_extendedprice IN (0, 1)) AS b2, bool_or(l_extendedprice != floor(l_extendedprice)) AS f2,
         bool_and(bulky IN (0, 1)) AS b3, false AS f3, bool_and(l_linenumber IN (0, 1)) AS b4, false AS f4 FROM items) s,
  LATERAL (VALUES ('l_quantity', 'float64', b1, f1), ('l_extendedprice', 'float64', b2, f2), ('bulky', 'int32', b3, f3),
    ('l_linenumber', 'int32', b4, f4)) u(name, type, b, f))
SELECT name, type, false AS id, b AS categorical, NOT b AS numerical,
       CASE WHEN b THEN 'binary' WHEN f THEN 'continuous' ELSE 'discrete' END AS roles FROM facts
UNION ALL SELECT 'l_linestatus', 'string', false, true, false, ''""")
def _(spark, sf_dir):
    df = items(spark, sf_dir).select("l_quantity", "l_extendedprice", "bulky", "l_linenumber", "l_linestatus")
    return columns.describe_config(df, columns.infer_config(df))


@query("column_statistics", f"""WITH {ITEMS}
SELECT 'l.quantity' AS name, 0.0 AS missing_pct, count(DISTINCT l_quantity) AS n_distinct, NULL AS listed FROM items
UNION ALL SELECT 'quantity_gaps', round(1 - count(quantity_gaps) / count(*), 6), count(DISTINCT quantity_gaps), NULL FROM items
UNION ALL SELECT 'status_gaps', round(1 - count(status_gaps) / count(*), 6), count(DISTINCT status_gaps), string_agg(DISTINCT status_gaps, ',' ORDER BY status_gaps) FROM items
UNION ALL SELECT 'bulky', 0.0, count(DISTINCT bulky), string_agg(DISTINCT CAST(bulky AS VARCHAR), ',' ORDER BY CAST(bulky AS VARCHAR)) FROM items""")
def _(spark, sf_dir):
    df = items(spark, sf_dir).select(F.col("l_quantity").alias("l.quantity"), "quantity_gaps", "status_gaps", "bulky")
    stats = columns.column_stats(df, columns.infer_config(df))
    return rounded(stats.withColumn("listed", F.array_join("distinct_values", ",")).drop("distinct_values"))


@query("merge_populations", """SELECT c_acctbal AS acctbal, CAST(c_nationkey AS BIGINT) AS nationkey, CAST(c_custkey AS VARCHAR) AS source_id, 1 AS treatment FROM customer
UNION ALL SELECT s_acctbal, CAST(s_nationkey AS BIGINT), CAST(s_suppkey AS VARCHAR), 0 FROM supplier""")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_a"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_b"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("long").alias("nationkey"))
    return merge_populations(a, b, id_a="key_a", id_b="key_b")


# ---------------------------------------------------------------- imputation, scaling, encoding


GAPS = f"""WITH {CUSTOMERS}, gaps AS (SELECT c_custkey, CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 5 != 0 THEN CAST(n_orders AS DOUBLE) END AS n FROM customers)"""


def gaps(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
                    F.when(F.col("c_custkey") % 5 != 0, F.col("n_orders").cast("double")).alias("n"))


def filling(method: str) -> TableConfig:
    rule = MissingRule("impute", imputer=method)
    return TableConfig({
        "c_custkey": ColumnSpec("c_custkey", id=True),
        "balance": ColumnSpec("balance", numerical=True, missing_data_management=rule),
        "n": ColumnSpec("n", numerical=True, missing_data_management=rule),
    })


def filled(spark, sf_dir, method):
    df, config = gaps(spark, sf_dir), filling(method)
    return rounded(impute.impute(df, config, impute.fit_impute(df, config, "c_custkey"), "c_custkey"), 4)


def fill_sql(balance: str, n: str) -> str:
    return GAPS + f""" SELECT c_custkey, round(coalesce(balance, {balance}), 4) AS balance, round(coalesce(n, {n}), 4) AS n FROM gaps"""


query("impute_zero", fill_sql("0", "0"))(lambda spark, sf_dir: filled(spark, sf_dir, "zero"))
query("impute_mean", fill_sql("(SELECT avg(balance) FROM gaps)", "(SELECT avg(n) FROM gaps)"))(lambda spark, sf_dir: filled(spark, sf_dir, "mean"))
query("impute_median", fill_sql("(SELECT quantile_cont(balance, 0.5) FROM gaps)", "(SELECT quantile_cont(n, 0.5) FROM gaps)"))(lambda spark, sf_dir: filled(spark, sf_dir, "median"))
query("impute_most_frequent", fill_sql(
    "(SELECT balance FROM gaps WHERE balance IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, balance LIMIT 1)",
    "(SELECT n FROM gaps WHERE n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1)",
))(lambda spark, sf_dir: filled(spark, sf_dir, "most_frequent"))
query("impute_iterative")(lambda spark, sf_dir: filled(spark, sf_dir, "iterative"))


# One column with holes: a single regression on the other column, its noise and shrinkage found by fixed-point iteration.
ONE_HOLE = f"""WITH RECURSIVE {CUSTOMERS}, gaps AS (SELECT c_custkey, CASE WHEN c_custkey % 7 != 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, CAST(n_orders AS DOUBLE) AS n FROM customers),
m AS (SELECT count(*) AS k, avg(n) AS mx, avg(balance) AS my, covar_pop(n, n) * count(*) AS g, covar_pop(n, balance) * count(*) AS xy, covar_pop(balance, balance) * count(*) AS yy FROM gaps WHERE balance IS NOT NULL),
it AS (SELECT 0 AS i, 1 / (yy / k + 2.220446049250313e-16::DOUBLE) AS noise, 1.0::DOUBLE AS shrink, CAST(NULL AS DOUBLE) AS before, false AS done FROM m
  UNION ALL SELECT i + 1, (k - e + 2e-6::DOUBLE) / (greatest(yy - 2 * w * xy + w * w * g, 0) + 2e-6::DOUBLE), (e + 2e-6::DOUBLE) / (w * w + 2e-6::DOUBLE), w, coalesce(abs(w - before) < 1e-3::DOUBLE, false)
  FROM (SELECT it.*, m.*, xy / (g + shrink / noise) AS w, noise * g / (shrink + noise * g) AS e FROM it, m WHERE NOT done AND i < 300)),
fit AS (SELECT xy / (g + shrink / noise) AS w FROM (SELECT * FROM it ORDER BY i DESC LIMIT 1), m)
SELECT c_custkey, round(coalesce(balance, my + w * (n - mx)), 4) AS balance, n FROM gaps, m, fit"""


@query("impute_iterative_one", ONE_HOLE)
def _(spark, sf_dir):
    df = customers(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"), F.col("n_orders").cast("double").alias("n"))
    config = filling("iterative")
    return rounded(impute.impute(df, config, impute.fit_impute(df, config, "c_custkey"), "c_custkey"), 4)


KNN_SQL = GAPS + """, near_balance AS (
  SELECT q.c_custkey, avg(d.balance) AS guess FROM gaps q JOIN (SELECT q.c_custkey AS id, d.c_custkey AS donor,
      row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt((q.n - d.n) * (q.n - d.n)), d.c_custkey) AS r
    FROM gaps q JOIN gaps d ON q.balance IS NULL AND q.n IS NOT NULL AND d.balance IS NOT NULL AND d.n IS NOT NULL) t ON t.id = q.c_custkey AND r <= 2
  JOIN gaps d ON d.c_custkey = t.donor GROUP BY 1), near_n AS (
  SELECT q.c_custkey, avg(d.n) AS guess FROM gaps q JOIN (SELECT q.c_custkey AS id, d.c_custkey AS donor,
      row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt((q.balance - d.balance) * (q.balance - d.balance)), d.c_custkey) AS r
    FROM gaps q JOIN gaps d ON q.n IS NULL AND q.balance IS NOT NULL AND d.balance IS NOT NULL AND d.n IS NOT NULL) t ON t.id = q.c_custkey AND r <= 2
  JOIN gaps d ON d.c_custkey = t.donor GROUP BY 1)
SELECT c_custkey, round(coalesce(balance, b.guess, (SELECT avg(balance) FROM gaps)), 4) AS balance,
       round(coalesce(n, m.guess, (SELECT avg(n) FROM gaps)), 4) AS n
FROM gaps LEFT JOIN near_balance b USING (c_custkey) LEFT JOIN near_n m USING (c_custkey)"""
query("impute_knn", KNN_SQL)(lambda spark, sf_dir: filled(spark, sf_dir, "knn"))


PREPARED = GAPS.replace("FROM customers)", ", segment FROM customers JOIN (SELECT c_custkey, c_mktsegment AS segment FROM customer) USING (c_custkey))") + """,
m AS (SELECT avg(balance) AS mean FROM gaps), donors AS (SELECT c_custkey, coalesce(balance, mean) AS balance, n FROM gaps, m),
s AS (SELECT avg(balance) AS center, stddev_pop(balance) AS width FROM donors),
codes AS (SELECT segment, CAST(row_number() OVER (ORDER BY segment) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT segment FROM gaps)),
other AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 != 0 THEN s_acctbal END AS balance, CASE WHEN s_suppkey % 2 != 0 THEN CAST(s_nationkey AS DOUBLE) END AS n,
  CASE s_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'NONE' END AS segment FROM supplier),
filled AS (SELECT s_suppkey, coalesce(balance, mean) AS balance, n, segment FROM other, m),
near AS (SELECT s_suppkey, avg(k) AS guess FROM (SELECT s_suppkey, d.n AS k, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt((f.balance - d.balance) * (f.balance - d.balance)), c_custkey) AS r
  FROM filled f JOIN donors d ON f.n IS NULL AND d.n IS NOT NULL) WHERE r <= 2 GROUP BY 1)
SELECT s_suppkey AS c_custkey, round((balance - center) / width, 4) + 0.0 AS balance, round(coalesce(n, guess), 4) AS n, code AS segment
FROM filled LEFT JOIN near USING (s_suppkey) LEFT JOIN codes USING (segment), s"""


@query("saved_state", PREPARED)
def _(spark, sf_dir):
    """Fitted on customers, saved, read back, and applied to suppliers."""
    segments = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    people = gaps(spark, sf_dir).join(segments, "c_custkey")
    config = TableConfig({
        "c_custkey": ColumnSpec("c_custkey", id=True),
        "balance": ColumnSpec("balance", numerical=True, missing_data_management=MissingRule("impute", imputer="mean"), scaling=ScalingRule(True, "standard")),
        "n": ColumnSpec("n", numerical=True, missing_data_management=MissingRule("impute", imputer="knn")),
        "segment": ColumnSpec("segment", categorical=True, encoding=EncodingRule(True, "ordinal")),
    })
    fills = impute.fit_impute(people, config, "c_custkey")
    whole = impute.impute(people, config, fills, "c_custkey")
    folder = f"{shared_folder(spark)}/states/{uuid.uuid4().hex}"
    save_state(spark, FittedState(fills, scale.fit_scaling(whole, config), encode.fit_encoding(whole, config)), folder)
    state = load_state(spark, folder)
    other = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("balance"),
        F.when(F.col("s_suppkey") % 2 != 0, F.col("s_nationkey").cast("double")).alias("n"),
        F.when(F.col("s_nationkey") % 3 == 0, "BUILDING").when(F.col("s_nationkey") % 3 == 1, "MACHINERY").otherwise("NONE").alias("segment"))
    ready = impute.impute(other, config, state.impute, "c_custkey")
    done = rounded(encode.encode(scale.scale(ready, config, state.scale), config, state.encode), 4)
    return done.withColumn("balance", F.col("balance") + 0.0)  # no negative zero


@query("impute_second_table", GAPS + """ SELECT s_suppkey AS c_custkey, round(CASE WHEN s_suppkey % 3 = 0 THEN (SELECT avg(balance) FROM gaps) ELSE s_acctbal END, 4) AS balance,
round(CAST(s_nationkey AS DOUBLE), 4) AS n FROM supplier""")
def _(spark, sf_dir):
    config = filling("mean")
    state = impute.fit_impute(gaps(spark, sf_dir), config)
    other = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("double").alias("n"))
    return rounded(impute.impute(other, config, state), 4)


def scaled(spark, sf_dir, method, inverse=False):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    rule = ScalingRule(True, method)
    config = TableConfig({"l_orderkey": ColumnSpec("l_orderkey", id=True), "l_quantity": ColumnSpec("l_quantity", numerical=True, scaling=rule),
                          "l_extendedprice": ColumnSpec("l_extendedprice", numerical=True, scaling=rule)})
    state = scale.fit_scaling(df, config)
    out = scale.scale(df, config, state)
    return rounded(scale.unscale(out, config, state) if inverse else out)


def scale_sql(q: str, p: str) -> str:
    return f"SELECT l_orderkey, round({q}, 6) AS l_quantity, round({p}, 6) AS l_extendedprice FROM lineitem, (SELECT {{}} FROM lineitem)"


query("scale_standard", scale_sql("(l_quantity - a) / b", "(l_extendedprice - c) / d").format(
    "avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d"))(lambda spark, sf_dir: scaled(spark, sf_dir, "standard"))
query("scale_minmax", scale_sql("(l_quantity - a) / b", "(l_extendedprice - c) / d").format(
    "min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) - min(l_extendedprice) AS d"))(lambda spark, sf_dir: scaled(spark, sf_dir, "minmax"))
query("scale_robust", scale_sql("(l_quantity - a) / b", "(l_extendedprice - c) / d").format(
    "quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS b, "
    "quantile_cont(l_extendedprice, 0.5) AS c, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS d"))(lambda spark, sf_dir: scaled(spark, sf_dir, "robust"))
query("scale_inverse", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")(lambda spark, sf_dir: scaled(spark, sf_dir, "standard", True))


@query("encode_ordinal", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0.0 WHEN 'O' THEN 1.0 END AS o_orderstatus,
CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    config = TableConfig({"o_orderkey": ColumnSpec("o_orderkey", id=True),
        "o_orderstatus": ColumnSpec("o_orderstatus", categorical=True, encoding=EncodingRule(True, "ordinal", ("P", "O"))),
        "o_orderpriority": ColumnSpec("o_orderpriority", categorical=True, encoding=EncodingRule(True, "ordinal"))})
    return encode.encode(df, config, encode.fit_encoding(df, config))


@query("encode_one_hot", """SELECT l_orderkey, CAST(l_linestatus = 'F' AND l_orderkey % 5 != 0 AS DOUBLE) AS status__F,
CAST(l_linestatus = 'O' AND l_orderkey % 5 != 0 AS DOUBLE) AS status__O, CAST(l_orderkey % 5 = 0 AS DOUBLE) AS "status__None" FROM lineitem""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linestatus")).alias("status"))
    config = TableConfig({"l_orderkey": ColumnSpec("l_orderkey", id=True), "status": ColumnSpec("status", categorical=True, encoding=EncodingRule(True, "one_hot"))})
    return encode.encode(df, config, encode.fit_encoding(df, config))


# ---------------------------------------------------------------- cohort preparation


@query("resolve_direction", f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN treated = 0 THEN 'query' ELSE 'pool' END AS role FROM orders_""")
def _(spark, sf_dir):
    return cohort.resolve_direction(orders(spark, sf_dir), "treated", "control_to_treated").select("o_orderkey", "role")


@query("covariate_availability", f"""WITH {ITEMS}, s AS (SELECT treated, avg(CAST(quantity_gaps IS NULL AS INTEGER)) AS a, avg(CAST(status_gaps IS NULL AS INTEGER)) AS b FROM items GROUP BY 1)
SELECT 'quantity_gaps' AS variable, round(max(a), 6) AS missing_pct, max(a) < 0.2 AS usable FROM s
UNION ALL SELECT 'status_gaps', round(max(b), 6), max(b) < 0.2 FROM s UNION ALL SELECT 'l_tax', 0.0, true FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(cohort.covariate_availability(items(spark, sf_dir), "treated", ["quantity_gaps", "status_gaps", "l_tax"]))


@query("exact_strata", f"""WITH {ITEMS} SELECT coalesce(status_gaps, 'None') || '|' || CAST(bulky AS VARCHAR) AS stratum, count(*) AS n,
sum(treated) AS n_treated FROM items GROUP BY 1""")
def _(spark, sf_dir):
    df = cohort.with_stratum(items(spark, sf_dir), ["status_gaps", "bulky"])
    return df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("treated").alias("n_treated"))


def scored_customers(spark, sf_dir):
    df = cohort.with_stratum(customers(spark, sf_dir), ["region"])
    return propensity.fit_score(df, "treated", ["c_acctbal", "n_orders"])[0]


@query("propensity_score", f"""WITH {CUSTOMERS} SELECT CAST(region AS VARCHAR) AS stratum, count(*) AS n,
CAST(sum(treated) AS DOUBLE) AS expected_treated FROM customers GROUP BY 1""")
def _(spark, sf_dir):
    # An unpenalised intercept makes the scores of a stratum add up to its treated units.
    df = scored_customers(spark, sf_dir)
    return rounded(df.groupBy("stratum").agg(F.count(cohort.PS).alias("n"), F.sum(cohort.PS).alias("expected_treated")), 4)


@query("logit_matching_space")
def _(spark, sf_dir):
    df = scored_customers(spark, sf_dir)
    return rounded(df.select("c_custkey", *cohort.matching_space("hybrid_covariates_and_ps", ["c_acctbal", "n_orders"])))


@query("overlap", f"""WITH {ORDERS}, g AS (SELECT o_orderstatus AS stratum, min(price) FILTER (treated = 1) AS treated_min, max(price) FILTER (treated = 1) AS treated_max,
min(price) FILTER (treated = 0) AS control_min, max(price) FILTER (treated = 0) AS control_max FROM orders_ GROUP BY 1)
SELECT *, greatest(treated_min, control_min) AS common_support_min, least(treated_max, control_max) AS common_support_max FROM g""")
def _(spark, sf_dir):
    return cohort.overlap(cohort.with_stratum(orders(spark, sf_dir), ["o_orderstatus"]), "treated", "price")


@query("trim_overlap", f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, treated ORDER BY price) - 1 AS pos,
count(*) OVER (PARTITION BY o_orderstatus, treated) AS n FROM orders_), b AS (SELECT o_orderstatus, treated,
max(price) FILTER (pos = round((n - 1) * CAST(0.02 AS DOUBLE))) AS lo, max(price) FILTER (pos = round((n - 1) * CAST(0.98 AS DOUBLE))) AS hi FROM r GROUP BY 1, 2),
s AS (SELECT o_orderstatus, max(lo) AS lower_bound, min(hi) AS upper_bound FROM b GROUP BY 1)
SELECT o_orderstatus AS stratum, lower_bound, upper_bound, count(*) AS n_before, count(*) FILTER (price BETWEEN lower_bound AND upper_bound) AS n_after,
count(*) FILTER (NOT price BETWEEN lower_bound AND upper_bound) AS n_dropped FROM orders_ JOIN s USING (o_orderstatus) GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return cohort.trim(cohort.with_stratum(orders(spark, sf_dir), ["o_orderstatus"]), "treated", "price")[1]


# ---------------------------------------------------------------- distances and pairs


def customer_cohort(spark, sf_dir, exact="region", direction="treated_to_control"):
    return cohort.resolve_direction(cohort.with_stratum(customers(spark, sf_dir), [exact]), "treated", direction)


def order_cohort(spark, sf_dir):
    return cohort.resolve_direction(cohort.with_stratum(orders(spark, sf_dir), ["o_orderstatus"]), "treated")


def named(pairs: DataFrame) -> DataFrame:
    return rounded(pairs.select("stratum", "query_id", "pool_id", "dist", "rank"))


def nearest_sql(dist: str, k: int, extra: str = "", where: str = "true", stratum: str = "region") -> str:
    return f"""WITH {CUSTOMERS}, u AS (SELECT *, CAST({stratum} AS VARCHAR) AS stratum FROM customers){extra},
d AS (SELECT q.stratum, q.c_custkey AS query_id, p.c_custkey AS pool_id, {dist} AS dist
  FROM u q JOIN u p ON q.stratum = p.stratum AND q.treated = 1 AND p.treated = 0 {"JOIN s ON s.stratum = q.stratum" if extra else ""} WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, pool_id) AS rank FROM d)
SELECT stratum, query_id, pool_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


EUCLID = "sqrt((q.c_acctbal - p.c_acctbal) * (q.c_acctbal - p.c_acctbal) + (q.n_orders - p.n_orders) * (q.n_orders - p.n_orders))"
RANGES = """, s AS (SELECT stratum, max(c_acctbal) - min(c_acctbal) AS r0, CAST(max(n_orders) - min(n_orders) AS DOUBLE) AS r1 FROM u GROUP BY 1)"""
NUM = "(abs(q.c_acctbal - p.c_acctbal) / r0 + abs(q.n_orders - p.n_orders) / r1)"
CAT = "CAST(q.c_nationkey != p.c_nationkey AS INTEGER)"
TWO = ("c_acctbal", "n_orders")
MIXED = PairRule((*TWO, "c_nationkey"), "gower", frozenset({"c_nationkey"}))


@query("euclidean_nearest", nearest_sql(EUCLID, 3))
def _(spark, sf_dir):
    return named(distance.nearest_pairs(customer_cohort(spark, sf_dir), "c_custkey", PairRule(TWO), 3))


@query("mahalanobis_nearest", nearest_sql(
    "sqrt((d * (q.c_acctbal - p.c_acctbal) ** 2 - 2 * b * (q.c_acctbal - p.c_acctbal) * (q.n_orders - p.n_orders) + a * (q.n_orders - p.n_orders) ** 2) / (a * d - b * b))",
    3, ", s AS (SELECT stratum, var_samp(c_acctbal) AS a, covar_samp(c_acctbal, n_orders) AS b, var_samp(n_orders) AS d FROM u GROUP BY 1)"))
def _(spark, sf_dir):
    return named(distance.nearest_pairs(customer_cohort(spark, sf_dir), "c_custkey", PairRule(TWO, "mahalanobis"), 3))


@query("gower_nearest", nearest_sql(f"({NUM} + {CAT}) / 3.0::DOUBLE", 3, RANGES))
def _(spark, sf_dir):
    return named(distance.nearest_pairs(customer_cohort(spark, sf_dir), "c_custkey", MIXED, 3))


@query("weighted_hybrid_nearest", nearest_sql(f"0.6::DOUBLE * ({NUM} / 2.0::DOUBLE) + 0.4::DOUBLE * ({CAT} / 1.0::DOUBLE)", 3, RANGES))
def _(spark, sf_dir):
    rule = PairRule(MIXED.features, "weighted_hybrid", MIXED.categorical)
    return named(distance.nearest_pairs(customer_cohort(spark, sf_dir), "c_custkey", rule, 3))


@query("caliper_windows", f"""WITH {ORDERS}, s AS (SELECT o_orderstatus, stddev_pop(days) AS sd FROM orders_ GROUP BY 1),
d AS (SELECT q.o_orderstatus AS stratum, q.o_orderkey AS query_id, p.o_orderkey AS pool_id, sqrt((q.price - p.price) * (q.price - p.price) + (q.days - p.days) * (q.days - p.days)) AS dist
  FROM orders_ q JOIN orders_ p ON q.o_orderstatus = p.o_orderstatus AND q.treated = 1 AND p.treated = 0 AND abs(q.price - p.price) <= 2000 JOIN s ON s.o_orderstatus = q.o_orderstatus
  WHERE abs(q.days - p.days) <= 0.05::DOUBLE * sd),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, pool_id) AS rank FROM d)
SELECT stratum, query_id, pool_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def _(spark, sf_dir):
    rule = PairRule(("price", "days"), windows=(Window("price", 2000.0), Window("days", 0.05, "standard_deviation")))
    return named(distance.nearest_pairs(order_cohort(spark, sf_dir), "o_orderkey", rule, 2))


@query("scalar_caliper", nearest_sql(EUCLID, 5, where=f"{EUCLID} <= 40"))
def _(spark, sf_dir):
    return named(distance.nearest_pairs(customer_cohort(spark, sf_dir), "c_custkey", PairRule(TWO, caliper=40.0), 5))


@query("candidate_prefilter", "SELECT DISTINCT stratum, pool_id FROM (" + nearest_sql(EUCLID, 7) + ")")
def _(spark, sf_dir):
    return distance.prefilter_pool(customer_cohort(spark, sf_dir), "c_custkey", PairRule(TWO), 7)


# ---------------------------------------------------------------- matching


@query("greedy_with_replacement", nearest_sql(EUCLID, 2, stratum="c_nationkey"))
def _(spark, sf_dir):
    return named(greedy.greedy_pairs(customer_cohort(spark, sf_dir, "c_nationkey"), "c_custkey", PairRule(TWO), 2, True))


SERVED = f"""WITH RECURSIVE {CUSTOMERS},
q AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customers WHERE treated = 1),
served AS (SELECT c_nationkey AS nk, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS pool_id, CAST(NULL AS DOUBLE) AS dist
  FROM (SELECT DISTINCT c_nationkey FROM q) UNION ALL
  SELECT nk, rn, list_append(taken, best.id), query_id, best.id, best.d FROM (
    SELECT s.nk, q.rn, any_value(s.taken) AS taken, any_value(q.c_custkey) AS query_id,
           min({{'d': {EUCLID}, 'id': p.c_custkey}}) AS best
    FROM served s JOIN q ON q.c_nationkey = s.nk AND q.rn = s.rn + 1
    JOIN customers p ON p.c_nationkey = s.nk AND p.treated = 0 AND NOT list_contains(s.taken, p.c_custkey) GROUP BY 1, 2)),
pairs AS (SELECT CAST(nk AS VARCHAR) AS stratum, query_id, pool_id, dist, rn FROM served WHERE query_id IS NOT NULL)"""


@query("greedy_without_replacement", SERVED + " SELECT stratum, query_id, pool_id, round(dist, 6) AS dist, 1 AS rank FROM pairs")
def _(spark, sf_dir):
    return named(greedy.greedy_pairs(customer_cohort(spark, sf_dir, "c_nationkey"), "c_custkey", PairRule(TWO)))


# All orders of a status as one block: few candidates in the windows, so the queries can be served one by one.
SERVED_ORDERS = f"""WITH RECURSIVE {ORDERS}, s AS (SELECT o_orderstatus, stddev_pop(days) AS sd FROM orders_ GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders_ WHERE treated = 1),
cand AS (SELECT q.o_orderstatus AS st, q.rn, p.o_orderkey AS pid, sqrt((q.price - p.price) * (q.price - p.price) + (q.days - p.days) * (q.days - p.days)) AS dist
  FROM q JOIN orders_ p ON q.o_orderstatus = p.o_orderstatus AND p.treated = 0 AND abs(q.price - p.price) <= 2000 JOIN s ON s.o_orderstatus = q.o_orderstatus WHERE abs(q.days - p.days) <= 0.05::DOUBLE * sd),
served AS (SELECT o_orderstatus AS st, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS pool_id, CAST(NULL AS DOUBLE) AS dist FROM s
  UNION ALL SELECT st, rn, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.id) END, query_id, best.id, best.d FROM (
    SELECT w.st, q.rn, any_value(w.taken) AS taken, any_value(q.o_orderkey) AS query_id, min({{'d': c.dist, 'id': c.pid}}) FILTER (c.pid IS NOT NULL) AS best
    FROM served w JOIN q ON q.o_orderstatus = w.st AND q.rn = w.rn + 1 LEFT JOIN cand c ON c.st = w.st AND c.rn = q.rn AND NOT list_contains(w.taken, c.pid) GROUP BY 1, 2))
SELECT st AS stratum, query_id, pool_id, round(dist, 6) AS dist, 1 AS rank FROM served WHERE pool_id IS NOT NULL"""


@query("greedy_orders", SERVED_ORDERS)
def _(spark, sf_dir):
    rule = PairRule(("price", "days"), windows=(Window("price", 2000.0), Window("days", 0.05, "standard_deviation")))
    return named(greedy.greedy_pairs(order_cohort(spark, sf_dir), "o_orderkey", rule))


@query("optimal_assignment")
def _(spark, sf_dir):
    pairs = assign.optimal_pairs(customer_cohort(spark, sf_dir, "c_nationkey"), "c_custkey", PairRule(TWO))
    return rounded(pairs.select("stratum", "query_id", "pool_id", "dist"))


# In one dimension the cheapest matching is a shortest path over both sides in order: least[i] is the total of the
# first i queries with the pool units seen so far.
TOTALS = f"""WITH RECURSIVE {CUSTOMERS},
u AS (SELECT *, CAST(n_regionkey AS VARCHAR) AS stratum FROM customers JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT *, 'all' FROM customers JOIN nation ON n_nationkey = c_nationkey),
q AS (SELECT stratum, list(CAST(c_acctbal AS DOUBLE) ORDER BY c_acctbal) AS xs FROM u WHERE treated = 1 GROUP BY 1),
p AS (SELECT stratum, CAST(c_acctbal AS DOUBLE) AS x, row_number() OVER (PARTITION BY stratum ORDER BY c_acctbal) AS j FROM u WHERE treated = 0),
walk AS (SELECT stratum, xs, CAST(0 AS BIGINT) AS j, list_transform(range(len(xs) + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS least FROM q
  UNION ALL SELECT w.stratum, w.xs, p.j, list_transform(range(len(w.xs) + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE least(w.least[i + 1], w.least[i] + abs(w.xs[i] - p.x)) END)
  FROM walk w JOIN p ON p.stratum = w.stratum AND p.j = w.j + 1)
SELECT stratum, CAST(len(xs) AS BIGINT) AS n_pairs, round(arg_max(least, j)[len(xs) + 1], 4) AS total FROM walk GROUP BY stratum, xs"""


@query("optimal_assignment_totals", TOTALS)
def _(spark, sf_dir):
    people, rule = customers(spark, sf_dir), PairRule(("c_acctbal",))
    by_region, whole = (
        assign.optimal_pairs(cohort.resolve_direction(cohort.with_stratum(people, exact), "treated"), "c_custkey", rule) for exact in (["region"], [])
    )
    both = by_region.unionByName(whole.withColumn("stratum", F.lit("all")))
    return both.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("dist"), 4).alias("total"))


@query("optimal_transport_selection")
def _(spark, sf_dir):
    return rounded(assign.transport_selection(customer_cohort(spark, sf_dir, "region"), "c_custkey", PairRule(TWO), 6))


@query("transport_invariants", f"""WITH {CUSTOMERS} SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS stratum, 1.0::DOUBLE AS shipped, true AS within_capacity, true AS optimal
  FROM customers JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, sf_dir):
    report = assign.transport_report(customer_cohort(spark, sf_dir, "region"), "c_custkey", PairRule(TWO), 6)
    fits, best = F.col("heaviest") <= 1 / 6 + 1e-12, F.col("gap") <= 1e-6 * F.col("cost")
    return report.select("stratum", F.round("shipped", 9).alias("shipped"), fits.alias("within_capacity"), best.alias("optimal"))


def nation_pairs(spark, sf_dir):
    people = customer_cohort(spark, sf_dir, "c_nationkey")
    return people, greedy.greedy_pairs(people, "c_custkey", PairRule(TWO, caliper=300.0), 1, True)


NATION_PAIRS = f"""WITH {CUSTOMERS}, u AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS stratum FROM customers),
d AS (SELECT q.stratum, q.c_custkey AS query_id, p.c_custkey AS pool_id, {EUCLID} AS dist FROM u q JOIN u p ON q.stratum = p.stratum AND q.treated = 1 AND p.treated = 0 WHERE {EUCLID} <= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, pool_id) AS rank FROM d), pairs AS (SELECT * FROM r WHERE rank = 1)"""


@query("matched_dataset", NATION_PAIRS + """, seats AS (SELECT c_custkey AS query_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY c_custkey) - 1 AS seat FROM u WHERE treated = 1),
spans AS (SELECT stratum, max(seat) + 1 AS span FROM pairs JOIN seats USING (query_id, stratum) GROUP BY 1),
shifts AS (SELECT stratum, coalesce(sum(span) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM spans),
n AS (SELECT query_id, pool_id, CAST(seat + shift AS BIGINT) AS pair_id FROM pairs JOIN seats USING (query_id, stratum) JOIN shifts USING (stratum))
SELECT c_custkey, c_acctbal, treated, stratum, pair_id, 1.0::DOUBLE AS weights, 'treated' AS __role__ FROM n JOIN u ON c_custkey = query_id
UNION ALL SELECT c_custkey, c_acctbal, treated, stratum, pair_id, 1.0::DOUBLE, 'control' FROM n JOIN u ON c_custkey = pool_id""")
def _(spark, sf_dir):
    people, pairs = nation_pairs(spark, sf_dir)
    return matched.matched_dataset(people, pairs, "c_custkey").select("c_custkey", "c_acctbal", "treated", "stratum", "pair_id", "weights", "__role__")


@query("unmatched_queries", NATION_PAIRS + " SELECT c_custkey, stratum FROM u WHERE treated = 1 AND c_custkey NOT IN (SELECT query_id FROM pairs)")
def _(spark, sf_dir):
    people, pairs = nation_pairs(spark, sf_dir)
    return matched.unmatched_queries(people, pairs, "c_custkey").select("c_custkey", "stratum")


# ---------------------------------------------------------------- balance


MOMENTS = LONG_ITEMS + """, m AS (SELECT variable, avg(value) FILTER (treated = 1) AS m1, avg(value) FILTER (treated = 0) AS m0,
var_samp(value) FILTER (treated = 1) AS v1, var_samp(value) FILTER (treated = 0) AS v0 FROM long_items GROUP BY 1)"""


@query("standardised_mean_difference", f"""WITH {MOMENTS} SELECT variable, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd, round(abs((m1 - m0) / sqrt((v1 + v0) / 2)), 6) AS abs_smd FROM m
UNION ALL SELECT 'l_linestatus', NULL, NULL""")
def _(spark, sf_dir):
    return rounded(balance.smd(items(spark, sf_dir), "treated", [*ITEM_NUMBERS, "l_linestatus"]))


@query("weighted_mean_difference", f"""WITH {ITEMS}, w AS (SELECT treated, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM items GROUP BY 1),
v AS (SELECT treated, max(m) AS m, sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity) AS v FROM items JOIN w USING (treated) GROUP BY 1)
SELECT 'l_extendedprice' AS variable, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd, round(abs((a.m - b.m) / sqrt((a.v + b.v) / 2)), 6) AS abs_smd
FROM v a, v b WHERE a.treated = 1 AND b.treated = 0""")
def _(spark, sf_dir):
    return rounded(balance.smd(items(spark, sf_dir), "treated", ["l_extendedprice"], "l_quantity"))


@query("variance_ratio", f"WITH {MOMENTS} SELECT variable, round(v1 / v0, 6) AS variance_ratio FROM m")
def _(spark, sf_dir):
    return rounded(balance.variance_ratio(items(spark, sf_dir), "treated", ITEM_NUMBERS))


@query("kolmogorov_smirnov", f"""WITH {LONG_ITEMS}, c AS (SELECT variable, value, count(*) FILTER (treated = 1) AS k1, count(*) FILTER (treated = 0) AS k0 FROM long_items GROUP BY 1, 2),
r AS (SELECT variable, sum(k1) OVER w AS c1, sum(k0) OVER w AS c0, sum(k1) OVER (PARTITION BY variable) AS n1, sum(k0) OVER (PARTITION BY variable) AS n0 FROM c WINDOW w AS (PARTITION BY variable ORDER BY value)),
s AS (SELECT variable, max(abs(c1 / n1 - c0 / n0)) AS stat, max(n1) AS n1, max(n0) AS n0 FROM r GROUP BY 1),
l AS (SELECT variable, stat, (sqrt(n1 * n0 / (n1 + n0)) + 0.12 + 0.11 / sqrt(n1 * n0 / (n1 + n0))) * stat AS lam FROM s)
SELECT variable, round(stat, 6) AS ks_stat, round(CASE WHEN lam < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * lam * lam)) FROM range(1, 101) t(j)))) END, 6) AS ks_p FROM l""")
def _(spark, sf_dir):
    return rounded(balance.ks_test(items(spark, sf_dir), "treated", ITEM_NUMBERS))


CHI = "greatest(abs(a * d - b * c) - n / 2, 0) ** 2 * n / ((a + b) * (c + d) * (a + c) * (b + d))"


# Twice the upper tail of the normal distribution above sqrt(x), by Simpson's rule over twelve deviations.
TAIL = """(SELECT sqrt(2 / pi()) * 0.002::DOUBLE * sum(CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (sqrt(x) + 0.002::DOUBLE * i) ** 2)) / 3 FROM range(6001) r(i))"""


@query("chi_square", f"""WITH {ITEMS}, t AS (SELECT 'bulky' AS variable, bulky AS v, treated FROM items UNION ALL SELECT 'l_linestatus', CAST(l_linestatus = 'O' AS INTEGER), treated FROM items),
k AS (SELECT variable, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (treated = 1 AND v = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (treated = 1 AND v = 0) AS DOUBLE) AS b,
  CAST(count(*) FILTER (treated = 0 AND v = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (treated = 0 AND v = 0) AS DOUBLE) AS d FROM t GROUP BY 1)
SELECT variable, round(x, 6) AS chi2_stat, round(p, 6) AS chi2_p FROM (SELECT variable, x, {TAIL} AS p FROM (SELECT variable, {CHI} AS x FROM k)) UNION ALL SELECT 'l_tax', NULL, NULL""")
def _(spark, sf_dir):
    return rounded(balance.chi_square(items(spark, sf_dir), "treated", ["bulky", "l_linestatus", "l_tax"]))


BINS = """, span AS (SELECT variable, min(value) AS lo, (max(value) - min(value)) / 20.0::DOUBLE AS w FROM long_items GROUP BY 1),
g AS (SELECT variable, treated, value, lo, w, least(floor((value - lo) / w), 19) AS b FROM long_items JOIN span USING (variable)),
b AS (SELECT variable, treated, CAST(CASE WHEN value < lo + b * w THEN b - 1 WHEN b < 19 AND value >= lo + (b + 1) * w THEN b + 1 ELSE b END AS VARCHAR) AS v FROM g
  UNION ALL SELECT 'l_linestatus', treated, l_linestatus FROM items)"""


@query("jensen_shannon", f"""WITH {LONG_ITEMS}{BINS}, c AS (SELECT variable, v, CAST(count(*) FILTER (treated = 1) AS DOUBLE) AS k1, CAST(count(*) FILTER (treated = 0) AS DOUBLE) AS k0 FROM b GROUP BY 1, 2),
s AS (SELECT variable, k1 / sum(k1) OVER (PARTITION BY variable) AS p, k0 / sum(k0) OVER (PARTITION BY variable) AS q FROM c)
SELECT variable, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS jensen_shannon FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(balance.jensen_shannon(items(spark, sf_dir), "treated", [*ITEM_NUMBERS, "l_linestatus"]))


@query("balance_table", NATION_PAIRS + """, rows_ AS (SELECT 'before' AS phase, treated, c_acctbal, n_orders FROM u
  UNION ALL SELECT 'after', treated, c_acctbal, n_orders FROM pairs JOIN u ON c_custkey = query_id UNION ALL SELECT 'after', treated, c_acctbal, n_orders FROM pairs JOIN u ON c_custkey = pool_id),
l AS (SELECT phase, treated, x.variable, x.value FROM rows_, LATERAL (VALUES ('c_acctbal', c_acctbal), ('n_orders', CAST(n_orders AS DOUBLE))) x(variable, value)),
m AS (SELECT phase, variable, avg(value) FILTER (treated = 1) AS m1, avg(value) FILTER (treated = 0) AS m0, var_samp(value) FILTER (treated = 1) AS v1, var_samp(value) FILTER (treated = 0) AS v0 FROM l GROUP BY 1, 2),
s AS (SELECT phase, variable, (m1 - m0) / sqrt((v1 + v0) / 2) AS smd, v1 / v0 AS ratio FROM m)
SELECT b.variable, b.variable = 'c_acctbal' AS is_matching_covariate, round(b.smd, 6) AS smd_before, round(abs(b.smd), 6) AS abs_smd_before, round(a.smd, 6) AS smd_after, round(abs(a.smd), 6) AS abs_smd_after,
round(b.ratio, 6) AS variance_ratio_before, round(a.ratio, 6) AS variance_ratio_after FROM s b JOIN s a ON a.variable = b.variable AND b.phase = 'before' AND a.phase = 'after'""")
def _(spark, sf_dir):
    people, pairs = nation_pairs(spark, sf_dir)
    after = matched.matched_dataset(people, pairs, "c_custkey")
    return rounded(balance.balance_table(people, after, "treated", ["c_acctbal"], ["n_orders"], ["smd", "variance_ratio"]))


@query("max_abs_smd", f"""WITH {MOMENTS} SELECT round(coalesce(max(abs((m1 - m0) / sqrt((v1 + v0) / 2))), 0), 6) AS max_abs_smd_after FROM m""")
def _(spark, sf_dir):
    df = items(spark, sf_dir)
    return rounded(balance.max_abs_smd(balance.balance_table(df, df, "treated", ITEM_NUMBERS)))


@query("pair_diagnostics", NATION_PAIRS + """ SELECT count(*) AS n_pairs, round(avg(dist), 6) AS mean_distance, round(min(dist), 6) AS min_distance, round(max(dist), 6) AS max_distance,
round(quantile_cont(dist, 0.5), 6) AS median_distance, round(quantile_cont(dist, 0.25), 6) AS p25_distance, round(quantile_cont(dist, 0.75), 6) AS p75_distance,
(SELECT count(*) FROM (SELECT pool_id FROM pairs GROUP BY 1 HAVING count(*) > 1)) AS n_pool_units_reused FROM pairs""")
def _(spark, sf_dir):
    return rounded(matched.pair_diagnostics(nation_pairs(spark, sf_dir)[1]))


@query("population_diagnostics", NATION_PAIRS + """ SELECT n_query_total, n_pool_total, n_query_matched, n_query_total - n_query_matched AS n_query_unmatched, round(n_query_matched / n_query_total, 6) AS match_rate
FROM (SELECT count(*) FILTER (treated = 1) AS n_query_total, count(*) FILTER (treated = 0) AS n_pool_total FROM u), (SELECT count(DISTINCT query_id) AS n_query_matched FROM pairs)""")
def _(spark, sf_dir):
    return rounded(matched.population_diagnostics(*nation_pairs(spark, sf_dir)))


# ---------------------------------------------------------------- profile


GROUP = "CASE WHEN treated = 1 THEN 'treated' ELSE 'control' END"


@query("descriptive_stats", f"""WITH {LONG_ITEMS} SELECT {GROUP} AS "group", variable, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM long_items GROUP BY 1, 2""")
def _(spark, sf_dir):
    return rounded(profile.descriptive_stats(items(spark, sf_dir), "treated", ITEM_NUMBERS), 4)


@query("densities", f"""WITH {LONG_ITEMS}, f AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long_items WHERE variable IN ('l_quantity', 'l_discount', 'l_extendedprice') GROUP BY 1),
grid AS (SELECT variable, CAST(i AS INTEGER) AS point, lo - 0.05::DOUBLE * (hi - lo) + ((hi - lo) + 2 * 0.05::DOUBLE * (hi - lo)) / 199 * i AS x FROM f, range(200) t(i)),
h AS (SELECT variable, treated, count(*) AS n, stddev_samp(value) * count(*) ** (-0.2::DOUBLE) AS h FROM long_items GROUP BY 1, 2),
c AS (SELECT variable, treated, value, count(*) AS k FROM long_items GROUP BY 1, 2, 3),
d AS (SELECT variable, point, any_value(x) AS x, treated, sum(k * exp(-0.5 * ((x - value) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) AS y FROM grid JOIN h USING (variable) JOIN c USING (variable, treated) GROUP BY variable, point, treated)
SELECT variable, point, round(max(x), 5) AS x, round(max(y) FILTER (treated = 1), 5) AS treated_density, round(max(y) FILTER (treated = 0), 5) AS control_density FROM d GROUP BY 1, 2""")
def _(spark, sf_dir):
    return rounded(profile.densities(items(spark, sf_dir), "treated", ["l_quantity", "l_discount", "l_extendedprice"]), 5)


@query("frequencies", f"""WITH {ITEMS}, l AS (SELECT 'status_gaps' AS variable, status_gaps AS category, treated FROM items UNION ALL SELECT 'bulky', CAST(bulky AS VARCHAR), treated FROM items),
c AS (SELECT variable, category, count(*) FILTER (treated = 1) AS a, count(*) FILTER (treated = 0) AS b FROM l WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT variable, category, round(a / sum(a) OVER (PARTITION BY variable), 6) AS treated_frequency, round(b / sum(b) OVER (PARTITION BY variable), 6) AS control_frequency FROM c""")
def _(spark, sf_dir):
    return rounded(profile.frequencies(items(spark, sf_dir), "treated", ["status_gaps", "bulky"]))


@query("missingness", f"""WITH {ITEMS}, s AS (SELECT avg(CAST(quantity_gaps IS NULL AS INTEGER)) FILTER (treated = 1) AS a1, avg(CAST(quantity_gaps IS NULL AS INTEGER)) FILTER (treated = 0) AS a0,
avg(CAST(status_gaps IS NULL AS INTEGER)) FILTER (treated = 1) AS b1, avg(CAST(status_gaps IS NULL AS INTEGER)) FILTER (treated = 0) AS b0 FROM items)
SELECT 'quantity_gaps' AS variable, round(a1, 6) AS treated_missing_pct, round(a0, 6) AS control_missing_pct FROM s UNION ALL SELECT 'status_gaps', round(b1, 6), round(b0, 6) FROM s""")
def _(spark, sf_dir):
    return rounded(profile.missingness(items(spark, sf_dir), "treated", ["quantity_gaps", "status_gaps"]))


@query("pearson_matrix", f"""WITH {ITEMS}, k AS (SELECT {GROUP} AS "group", corr(quantity_gaps, l_extendedprice) AS a, corr(quantity_gaps, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM items WHERE quantity_gaps IS NOT NULL GROUP BY 1)
SELECT "group", v.var_i, v.var_j, round(v.r, 6) AS r FROM k, LATERAL (VALUES ('quantity_gaps', 'l_extendedprice', a), ('l_extendedprice', 'quantity_gaps', a), ('quantity_gaps', 'l_tax', b), ('l_tax', 'quantity_gaps', b),
('l_extendedprice', 'l_tax', c), ('l_tax', 'l_extendedprice', c), ('quantity_gaps', 'quantity_gaps', 1.0), ('l_tax', 'l_tax', 1.0), ('l_extendedprice', 'l_extendedprice', 1.0)) v(var_i, var_j, r)""")
def _(spark, sf_dir):
    return rounded(profile.pearson_matrix(items(spark, sf_dir), "treated", ["quantity_gaps", "l_extendedprice", "l_tax"]))


@query("cramers_v_matrix", f"""WITH {ITEMS}, t AS (SELECT {GROUP} AS "group", 'bulky' AS var_i, 'status_gaps' AS var_j, CAST(bulky AS VARCHAR) AS a, status_gaps AS b FROM items
UNION ALL SELECT {GROUP}, 'bulky', 'l_linenumber', CAST(bulky AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM items UNION ALL SELECT {GROUP}, 'status_gaps', 'l_linenumber', status_gaps, CAST(l_linenumber AS VARCHAR) FROM items),
k AS (SELECT "group", var_i, var_j, a, b, count(*) AS n FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY "group", var_i, var_j, a) AS ra, sum(n) OVER (PARTITION BY "group", var_i, var_j, b) AS cb, sum(n) OVER (PARTITION BY "group", var_i, var_j) AS t FROM k),
z AS (SELECT "group", var_i, var_j, sum(CASE WHEN var_j = 'status_gaps' THEN greatest(abs(n - ra * cb / t) - 0.5, 0) ELSE n - ra * cb / t END ** 2 / (ra * cb / t)) AS chi2, max(t) AS t FROM e GROUP BY 1, 2, 3),
v AS (SELECT "group", var_i, var_j, sqrt(chi2 / t) AS v FROM z)
SELECT "group", var_i, var_j, round(v, 6) AS v FROM v UNION ALL SELECT "group", var_j, var_i, round(v, 6) FROM v
UNION ALL SELECT g, x, x, 1.0 FROM (VALUES ('treated'), ('control')) a(g), (VALUES ('bulky'), ('status_gaps'), ('l_linenumber')) b(x)""")
def _(spark, sf_dir):
    return rounded(profile.cramers_v_matrix(items(spark, sf_dir), "treated", ["bulky", "status_gaps", "l_linenumber"]))


# ---------------------------------------------------------------- runs


@query("profile_routing", f"""WITH {ITEMS}, l AS (SELECT 'status_gaps' AS variable, status_gaps AS category, treated FROM items UNION ALL SELECT 'bulky', CAST(bulky AS VARCHAR), treated FROM items UNION ALL SELECT 'same', '1', treated FROM items),
c AS (SELECT variable, category, count(*) FILTER (treated = 1) AS a, count(*) FILTER (treated = 0) AS b FROM l WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT variable, category, round(a / sum(a) OVER (PARTITION BY variable), 6) AS treated_frequency, round(b / sum(b) OVER (PARTITION BY variable), 6) AS control_frequency FROM c""")
def _(spark, sf_dir):
    cohort_ = items(spark, sf_dir).withColumn("same", F.lit(1))
    return rounded(profile.profile_population(cohort_, "treated", ["status_gaps", "bulky", "same", "l_extendedprice"]).frequencies)


@query("match_run")
def _(spark, sf_dir):
    spec = MatchSpec.from_dict({
        "population": {"treatment_col": "treated", "id_col": "c_custkey"},
        "covariates": {"matching_covariates": ["c_acctbal", "n_orders"]},
        "representation": {"use_propensity_score": True, "matching_space": "hybrid_covariates_and_ps"},
        "constraints": {"exact_match_covariates": ["c_nationkey"]},
        "distance": {"distance_metric": "mahalanobis"},
        "diagnostics": {"balance_metrics": ["smd", "variance_ratio", "ks_test", "jensen_shannon"]},
    })
    result = run_matching(customers(spark, sf_dir), spec)
    if not result.success:
        raise RuntimeError(result.error)
    return rounded(result.tables["balance_table"])


def run_sql(caliper: int) -> str:
    """Metrics of a run: nearest neighbour with replacement under a scalar caliper, per nation."""
    return f"""SELECT 'greedy_nn' AS algorithm, 'euclidean' AS distance, 'treated_to_control' AS direction, 'False' AS use_propensity_score,
  round((SELECT count(*) FROM pairs{caliper}) / (SELECT sum(treated) FROM customers), 6) AS match_rate,
  (SELECT round(avg(dist), 6) FROM pairs{caliper}) AS mean_distance, (SELECT CAST(count(*) AS DOUBLE) FROM pairs{caliper}) AS n_pairs,
  (SELECT round(max(abs(smd_after)), 6) FROM after{caliper}) AS max_abs_smd_after"""


def moments_sql(name: str, rows: str) -> str:
    """(variable, smd, ratio of variances) of both covariates over rows with ``treated``."""
    return f"""{name}(variable, smd_{name.rstrip('0123456789')}, ratio_{name.rstrip('0123456789')}) AS (SELECT variable, (m1 - m0) / sqrt((v1 + v0) / 2), v1 / v0 FROM (SELECT variable,
  avg(value) FILTER (treated = 1) AS m1, avg(value) FILTER (treated = 0) AS m0, var_samp(value) FILTER (treated = 1) AS v1, var_samp(value) FILTER (treated = 0) AS v0
  FROM ({rows}) r, LATERAL (VALUES ('c_acctbal', CAST(c_acctbal AS DOUBLE)), ('n_orders', CAST(n_orders AS DOUBLE))) x(variable, value) GROUP BY 1))"""


def pairs_sql(caliper: int) -> str:
    members = " UNION ALL ".join(f"SELECT treated, c_acctbal, n_orders FROM pairs{caliper} JOIN customers ON c_custkey = {side}" for side in ("query_id", "pool_id"))
    return f"""pairs{caliper} AS (SELECT query_id, best.d AS dist, best.id AS pool_id FROM (SELECT q.c_custkey AS query_id, min({{'d': {EUCLID}, 'id': p.c_custkey}}) AS best
  FROM customers q JOIN customers p ON q.c_nationkey = p.c_nationkey AND q.treated = 1 AND p.treated = 0 WHERE {EUCLID} <= {caliper} GROUP BY 1)), {moments_sql(f'after{caliper}', members)}"""


def caliper_run(spark, sf_dir, caliper: float) -> RunResult:
    result = run_matching(customers(spark, sf_dir), MatchSpec.from_dict({
        "population": {"treatment_col": "treated", "id_col": "c_custkey"},
        "covariates": {"matching_covariates": list(TWO)},
        "constraints": {"exact_match_covariates": ["c_nationkey"]},
        "strategy": {"allow_replacement": True, "caliper_value": caliper},
        "diagnostics": {"balance_metrics": ["smd", "variance_ratio"]},
    }))
    if not result.success:
        raise RuntimeError(result.error)
    return result


@query("run_balance", f"""WITH {CUSTOMERS}, {pairs_sql(300)}, {moments_sql('before', 'SELECT * FROM customers')}
SELECT variable, round(smd_before, 6) AS smd_before, round(smd_after, 6) AS smd_after, round(ratio_before, 6) AS variance_ratio_before, round(ratio_after, 6) AS variance_ratio_after,
  round((SELECT count(*) FROM pairs300) / (SELECT sum(treated) FROM customers), 6) AS match_rate, round((SELECT max(abs(smd_after)) FROM after300), 6) AS max_abs_smd_after,
  (SELECT count(*) * 2 FROM pairs300) AS n_matched_rows FROM before JOIN after300 USING (variable)""")
def _(spark, sf_dir):
    """A whole run: its balance table, its metrics and the size of the matched dataset."""
    result = caliper_run(spark, sf_dir, 300.0)
    table_ = result.tables["balance_table"].select("variable", "smd_before", "smd_after", "variance_ratio_before", "variance_ratio_after")
    facts = {m: F.lit(result.metrics[m]) for m in ("match_rate", "max_abs_smd_after")}
    return rounded(table_.withColumns(facts)).withColumn("n_matched_rows", F.lit(result.datasets["matched_dataset"].count()).cast("long"))


@query("logit_space_sums", f"""WITH {CUSTOMERS} SELECT CAST(region AS VARCHAR) AS stratum, count(*) AS n, round(sum(treated), 4) + 0.0::DOUBLE AS expected_treated, round(sum(c_acctbal), 2) AS c_acctbal, CAST(sum(n_orders) AS DOUBLE) AS n_orders FROM customers GROUP BY 1""")
def _(spark, sf_dir):
    """The first-order condition of the intercept, taken from the logits of the matching space."""
    df = scored_customers(spark, sf_dir)
    space = cohort.matching_space("hybrid_covariates_and_ps", list(TWO))
    sums = df.select("stratum", *space).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(1 / (1 + F.exp(-F.col(space[-1])))), 4).alias("expected_treated"),
        F.round(F.sum("c_acctbal"), 2).alias("c_acctbal"), F.sum("n_orders").cast("double").alias("n_orders"))
    return sums


ROLES = """WITH s AS (DESCRIBE supplier), c AS (DESCRIBE customer)"""


@query("merge_checks", ROLES + """, l AS (SELECT replace(column_name, 's_', '') AS name, column_type AS kind FROM s), r AS (SELECT replace(column_name, 'c_', '') AS name, column_type AS kind FROM c),
both_ AS (SELECT l.name, CASE WHEN regexp_matches(l.kind, 'CHAR') THEN 'text' ELSE 'number' END = CASE WHEN regexp_matches(r.kind, 'CHAR') THEN 'text' ELSE 'number' END AS same FROM l JOIN r USING (name))
SELECT 'common' AS finding, name FROM both_ WHERE same UNION ALL SELECT 'agreed', name FROM both_ WHERE same AND name <> 'nationkey' UNION ALL SELECT 'roles differ', 'nationkey'
UNION ALL SELECT 'missing', 'loyalty' UNION ALL SELECT 'not configured', name FROM r WHERE name NOT IN (SELECT name FROM l)""")
def _(spark, sf_dir):
    """What the merge and configuration checks say about suppliers and customers."""
    a, b = (table(spark, sf_dir, n).toDF(*[c.split("_", 1)[1] for c in table(spark, sf_dir, n).columns]) for n in ("supplier", "customer"))
    config_a, config_b = columns.infer_config(a), columns.infer_config(b.select(*[c for c in b.columns if c in a.columns]))
    turned = TableConfig({**config_b.columns, "nationkey": ColumnSpec("nationkey", categorical=True), "loyalty": ColumnSpec("loyalty", numerical=True)})
    found = [("common", c) for c in check_compatibility(a, b).common_columns]
    judged = check_config_compatibility(a, b, config_a, turned)
    found += [("agreed", c) for c in judged.compatible_columns] + [("roles differ", c) for c, _ in judged.mismatched_columns]
    checked = columns.validate_config(b, turned)
    found += [("missing", c) for c in checked.missing_in_dataset] + [("not configured", c) for c in checked.unconfigured_in_dataset]
    return spark.createDataFrame(found, "finding string, name string")


@query("expanded_covariates", """SELECT 'c_mktsegment' AS covariate, 'c_mktsegment__' || c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'c_acctbal', 'c_acctbal'""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    config = TableConfig({
        "c_custkey": ColumnSpec("c_custkey", id=True), "c_acctbal": ColumnSpec("c_acctbal", numerical=True),
        "c_mktsegment": ColumnSpec("c_mktsegment", categorical=True, encoding=EncodingRule(True, "one_hot")),
    })
    state = encode.fit_encoding(df, config)
    ready = encode.encode(df, config, state).columns
    rows = [(c, n) for c in ("c_mktsegment", "c_acctbal") for n in encode.expanded_names(config, state, c) if n in ready]
    return spark.createDataFrame(rows, "covariate string, name string")


@query("load_many", """SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'failed', 1""")
def _(spark, sf_dir):
    loaded = load_many(spark, [f"{sf_dir}/{n}.parquet" for n in ("nation", "region", "events", "no_such_table")])
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows")) for n, df in loaded.tables.items()]
    out = spark.range(1).select(F.lit("failed").alias("name"), F.lit(len(loaded.failures)).cast("long").alias("n_rows"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("compare_runs", f"WITH {CUSTOMERS}, {pairs_sql(300)}, {pairs_sql(60)} {run_sql(300)} UNION ALL {run_sql(60)}")
def _(spark, sf_dir):
    root, folders = shared_folder(spark), []
    for caliper in (300.0, 60.0):
        result = caliper_run(spark, sf_dir, caliper)
        folders.append(f"{root}/runs/{result.run_id}")
        save_result(spark, result, folders[-1])
    return rounded(compare_runs(spark, folders).drop("run_id", "created_at"))


# ---------------------------------------------------------------- training-data operators


try:
    import corpus_pipeline
    from pairwell.llm import queries as _llm
except ModuleNotFoundError as exc:  # the optional part, or a library only it needs
    if (exc.name or "").startswith("pairwell") and not (exc.name or "").startswith("pairwell.llm"):
        raise
else:
    _QUERIES.update(_llm.queries(), pipeline=corpus_pipeline.run)
    _ORACLE.update(_llm.oracle_sql())
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
