"""Named queries of the core engine with their DuckDB oracles.

Queries of one SQL text for both engines name tables as ``{orders}``; others pair the
engine's own API with an oracle.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types as kinds
from millrace.functions.expressions import schema_projection
from millrace.operators import aggregates, joins, scd2
from millrace.plans import config, dag, metrics
from millrace.sources import tables
from millrace.sources.catalog import Table
from millrace.sources.scratch import scratch_path, scratch_root
from millrace.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(spark: SparkSession, name: str) -> Table:
    """A table of its own in a database of the scratch folder."""
    root = scratch_root(spark)
    return Table(spark, f"scratch_{zlib.crc32(root.encode()):08x}", f"{name}_{uuid.uuid4().hex}", f"{root}/millrace/tables")


def query(oracle: str | None = None):
    """Register a function as the query of its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def both(name: str, text: str) -> None:
    """Register one SQL text for both engines."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    QUERIES[name] = lambda spark, sf_dir: tables.guarded_sql(spark, text, **{n: read(spark, sf_dir, n) for n in names})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text)


# Scans, projections, filters, order


@query("SELECT * FROM nation")
def scan_star(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "nation"), "*")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "orders"), [{"name": "o_orderkey"}, "o_custkey", {"name": "o_totalprice"}])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def scan_project_filter(spark, sf_dir):
    filters = [{"column": "o_totalprice", "operator": ">", "value": 200000}, {"column": "o_orderstatus", "operator": "=", "value": "O"}]
    return tables.select(read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], filters, [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}], 50)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS revenue FROM lineitem")
def project_expression(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", {"expression": "round(l_extendedprice * (1 - l_discount), 5)", "alias": "revenue"}])


@query("SELECT n_name, n_nationkey + 1 AS next_key FROM nation")
def project_raw(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "nation"), "n_name, n_nationkey + 1 AS next_key")


@query("SELECT c_custkey AS customer_id, concat(c_name, '#', c_mktsegment) AS label FROM customer")
def schema_alias_expr(spark, sf_dir):
    return schema_projection(read(spark, sf_dir, "customer"), [{"name": "c_custkey", "alias": "customer_id"}, {"name": "label", "expr": "concat(c_name, '#', c_mktsegment)"}])


@query("SELECT * FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def filter_and(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "orders"), "*", {"o_totalprice": {"operator": ">", "value": 150000}, "o_orderstatus": "O"})


@query("""SELECT 'true' AS form, c_custkey FROM customer WHERE c_acctbal > 5000 UNION ALL
SELECT 'false', c_custkey FROM customer WHERE NOT (c_acctbal > 5000) UNION ALL
SELECT 'not true', c_custkey FROM customer WHERE (c_acctbal > 5000) <> true""")
def filter_bool(spark, sf_dir):
    flagged = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich"))
    forms = {"true": ("=", True), "false": ("=", False), "not true": ("<>", True)}
    parts = [tables.select(flagged, [{"expression": f"'{name}'", "alias": "form"}, "c_custkey"], [{"column": "rich", "operator": op, "value": v}]) for name, (op, v) in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def filter_in(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "part"), ["p_partkey", "p_size"], [{"column": "p_size", "operator": "IN", "value": [1, 5, 9]}, {"column": "p_brand", "operator": "NOT IN", "value": ["Brand#11", "Brand#12"]}])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7' AND c_mktsegment ILIKE 'a%'")
def filter_like(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "customer"), ["c_custkey", "c_name"], [{"column": "c_name", "operator": "LIKE", "value": "%7"}, {"column": "c_mktsegment", "operator": "ILIKE", "value": "a%"}])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13'")
def filter_string(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "part"), ["p_partkey", "p_brand"], [{"column": "p_brand", "operator": "=", "value": "Brand#13"}])


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size <> 20 AND p_retailprice <= 1500 AND p_retailprice > 100")
def filter_ops(spark, sf_dir):
    wanted = [("p_size", ">=", 10), ("p_size", "<", 40), ("p_size", "!=", 20), ("p_retailprice", "<=", 1500), ("p_retailprice", ">", 100)]
    return tables.select(read(spark, sf_dir, "part"), ["p_partkey"], [{"column": c, "operator": o, "value": v} for c, o, v in wanted])


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 OR s_nationkey BETWEEN 3 AND 5")
def filter_raw(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"], "s_acctbal > 0 OR s_nationkey BETWEEN 3 AND 5")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def filter_null(spark, sf_dir):
    holes = read(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    none = tables.select(holes, "*", [{"column": "segment", "operator": "=", "value": None}])
    some = tables.select(holes, "*", [{"column": "segment", "operator": "is not", "value": None}])
    return none.unionByName(some)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey")
def sort_multi(spark, sf_dir):
    order = [{"column": "c_nationkey", "direction": "ASC"}, {"column": "c_acctbal", "direction": "DESC"}, {"column": "c_custkey"}]
    return tables.select(read(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"], sort_by=order)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC")
def sort_order_alias(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], sort_by=[{"column": "n_name", "order": "desc"}])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf_dir):
    return tables.select(read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], sort_by="o_totalprice desc, o_orderkey", limit=20)


PAGED = "SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) / 1000) AS BIGINT) AS page FROM lineitem"
PAGE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"SELECT * FROM ({PAGED}) WHERE page = 2")
def paginate_page(spark, sf_dir):
    return tables.Pages(read(spark, sf_dir, "lineitem"), PAGE_KEYS, 1000).page(2).select("l_orderkey", "l_linenumber", "l_quantity", "page")


@query(f"SELECT page, count(*) AS n FROM ({PAGED}) GROUP BY page")
def paginate_counts(spark, sf_dir):
    return tables.pages(read(spark, sf_dir, "lineitem"), PAGE_KEYS, 1000).groupBy("page").agg(F.count("*").alias("n"))


ROW_KEYS = [*PAGE_KEYS, "l_discount", "l_tax", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(floor((row_number() OVER (ORDER BY {', '.join(ROW_KEYS)}) - 1) / 1000) AS BIGINT) AS page FROM lineitem")
def paginate_rows(spark, sf_dir):
    """With columns that are no keys."""
    return tables.pages(read(spark, sf_dir, "lineitem"), ROW_KEYS, 1000).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "page")


# Rows, tables, connectors


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


STAGED = [{"id": 1, "name": "it's", "amount": 1.5}, {"name": None, "id": 2, "amount": None}, {"id": 3, "amount": -2.0, "name": '50% "x"_y'}]


@query("SELECT * FROM (VALUES (1, 'it''s', 1.5::DOUBLE), (2, NULL, NULL), (3, '50% \"x\"_y', -2.0)) AS t(id, name, amount)")
def staging_values(spark, sf_dir):
    return tables.literal_rows(spark, STAGED, kinds.schema_of([{"name": "id", "type": "int"}, {"name": "name", "type": "string"}, {"name": "amount", "type": "double"}]))


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 'again' FROM nation")
def insert_append(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    schema = kinds.schema_of([{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "string"}, {"name": "note", "type": "string"}])
    table = scratch_table(spark, "append").create(schema, "nations twice")
    table.append(nation.select("n_name", "n_nationkey"))
    table.append(nation.select(F.lit("again").alias("note"), (F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))
    return table.read()


DESCRIBED = {"c_custkey": ("bigint", None), "c_name": ("string", "name of the customer"), "c_acctbal": ("decimal(18,3)", None), "c_mktsegment": ("string", "it's the segment"), "seen": ("timestamp_ntz", None)}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, {"'" + note.replace("'", "''") + "'" if note else "CAST(NULL AS VARCHAR)"} AS comment, {f"count({c})" if c != "seen" else "count(NULL)"} AS filled FROM customer""" for c, (kind, note) in DESCRIBED.items()))
def ddl_describe(spark, sf_dir):
    """Columns of a table as the catalog describes them, and how many rows fill each."""
    fields = [{"name": c, "type": kind.removesuffix("(18,3)").removesuffix("_ntz"), **({"description": note} if note else {})} for c, (kind, note) in DESCRIBED.items()]
    table = scratch_table(spark, "ddl").create(kinds.schema_of(fields), "customers")
    table.append(read(spark, sf_dir, "customer"))
    filled = table.read().agg(*[F.count(c).alias(c) for c in DESCRIBED]).unpivot([], list(DESCRIBED), "column_name", "filled")
    return table.columns().join(filled, "column_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_flatten_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


LOOKUP = [("low", 950.0), ("middle", 1200.0), ("high", 1600.0)]


@query("SELECT p_partkey, CASE WHEN abs(p_retailprice - 950) <= abs(p_retailprice - 1200) AND abs(p_retailprice - 950) <= abs(p_retailprice - 1600) THEN 'low' WHEN abs(p_retailprice - 1200) <= abs(p_retailprice - 1600) THEN 'middle' ELSE 'high' END AS nearest FROM part")
def nearest_lookup(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", joins.nearest(F.col("p_retailprice"), LOOKUP).alias("nearest"))


PLACES = [("north", 3.0, 8000.0), ("middle", 12.0, 4000.0), ("south", 20.0, 500.0)]


@query("""SELECT c_custkey, (SELECT name FROM (VALUES ('north', 0, 3.0, 8000.0), ('middle', 1, 12.0, 4000.0), ('south', 2, 20.0, 500.0)) AS v(name, k, x, y)
ORDER BY (c_nationkey - x) * (c_nationkey - x) + (c_acctbal - y) * (c_acctbal - y), k LIMIT 1) AS place FROM customer""")
def nearest_place(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", joins.nearest_point(F.col("c_nationkey"), F.col("c_acctbal"), PLACES).alias("place"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def multi_input_join(spark, sf_dir):
    inputs = {"orders": read(spark, sf_dir, "orders"), "customers": read(spark, sf_dir, "customer")}
    return inputs["orders"].join(inputs["customers"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


# SCD type 2

SPLIT = datetime(2024, 1, 15)
DIM = scd2.Dimension(["user_id"], "ts", tracked=["event_type", "value"])
COMPOSITE = scd2.Dimension(["user_id", "event_type"], "ts", tracked=["value"])
EVENT_COLUMNS = ["user_id", "event_type", "value", "ts"]


def _parts(spark, sf_dir, dim: scd2.Dimension = DIM) -> tuple[DataFrame, DataFrame]:
    """The target after the events before SPLIT, and the batch of the others."""
    events = read(spark, sf_dir, "events").select(*EVENT_COLUMNS)
    first = events.where(F.col("ts") < F.lit(SPLIT))
    return scd2.apply_batch(scd2.empty_target(first, dim), first, dim), events.where(F.col("ts") >= F.lit(SPLIT))


def _stored(spark, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "applied")
    df.write.parquet(path)
    return spark.read.parquet(path)


def scd2_sql(keys: list[str], tracked: list[str], result: str) -> str:
    """SQL of one application over the events, with ``result`` as its last select."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    rest = ", ".join(f"{c} ASC NULLS LAST" for c in EVENT_COLUMNS if c not in keys and c != "ts")
    cols = ", ".join(EVENT_COLUMNS)
    s = ", ".join(f"s.{c}" for c in EVENT_COLUMNS)
    rank = lambda src: f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts DESC NULLS LAST, {rest}) AS rk, lag(ts) OVER (PARTITION BY {k} ORDER BY ts DESC NULLS LAST, {rest}) AS nx FROM (SELECT DISTINCT {cols} FROM {src})"
    return f"""
WITH ev AS (SELECT {cols} FROM events), r0 AS ({rank("ev WHERE ts < TIMESTAMP '2024-01-15'")}),
target AS (SELECT {cols}, ts AS begin_date, CASE WHEN rk > 1 THEN nx END AS end_date, rk = 1 AS is_current FROM r0),
r AS ({rank("ev WHERE ts >= TIMESTAMP '2024-01-15'")}),
hist AS (SELECT {s}, s.ts AS begin_date, s.nx AS end_date, false AS is_current FROM r s WHERE s.rk > 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE {on("t", "s")} AND t.begin_date = s.ts)),
chg AS (SELECT s.* FROM r s JOIN target t ON {on("s", "t")} AND t.is_current WHERE s.rk = 1 AND ({" OR ".join(f"s.{c} <> t.{c}" for c in tracked)})),
expired AS (SELECT {", ".join(f"t.{c}" for c in EVENT_COLUMNS)}, t.begin_date, CASE WHEN c.rk IS NOT NULL THEN c.ts ELSE t.end_date END AS end_date, CASE WHEN c.rk IS NOT NULL THEN false ELSE t.is_current END AS is_current
  FROM target t LEFT JOIN chg c ON {on("t", "c")} AND t.is_current),
fresh AS (SELECT {s}, s.ts AS begin_date, CAST(NULL AS TIMESTAMP) AS end_date, true AS is_current FROM r s WHERE s.rk = 1 AND NOT EXISTS (SELECT 1 FROM expired t WHERE {on("t", "s")} AND t.is_current)),
applied AS (SELECT * FROM expired UNION ALL SELECT * FROM hist UNION ALL SELECT * FROM fresh)
{result}"""


EVENTS_SQL = lambda result: scd2_sql(["user_id"], ["event_type", "value"], result)


@query(EVENTS_SQL("SELECT * FROM target"))
def scd2_bootstrap(spark, sf_dir):
    return _parts(spark, sf_dir)[0]


@query(EVENTS_SQL("SELECT * FROM hist"))
def scd2_historical(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    return scd2.historical(target, scd2.rank_batch(batch, DIM.of(batch)), DIM.of(batch))


@query(EVENTS_SQL(f"SELECT {', '.join(EVENT_COLUMNS)} FROM chg"))
def scd2_changed(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    return scd2.changed_rows(target, scd2.rank_batch(batch, DIM.of(batch)), DIM.of(batch)).select(*EVENT_COLUMNS)


@query(EVENTS_SQL("SELECT e.* FROM expired e WHERE EXISTS (SELECT 1 FROM target t WHERE t.user_id = e.user_id AND t.begin_date = e.begin_date AND t.is_current)"))
def scd2_expire(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    return scd2.expire(target.where("is_current"), scd2.rank_batch(batch, DIM.of(batch)), DIM.of(batch))


@query(EVENTS_SQL("SELECT * FROM fresh"))
def scd2_insert_current(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    dim = DIM.of(batch)
    ranked = scd2.rank_batch(batch, dim)
    return scd2.new_current(scd2.expire(target.where("is_current"), ranked, dim), ranked, dim)


@query(EVENTS_SQL("SELECT * FROM applied"))
def scd2_full(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    return scd2.apply_batch(target, batch, DIM)


@query(EVENTS_SQL("SELECT * FROM applied"))
def scd2_idempotent(spark, sf_dir):
    """Each application is stored, for all that go by one key would run in one stage, whose
    tasks hold the sorted rows of all their joins at once."""
    target, batch = _parts(spark, sf_dir)
    once = _stored(spark, scd2.apply_batch(_stored(spark, target), batch, DIM))
    return scd2.apply_batch(once, batch, DIM)


@query(EVENTS_SQL("SELECT * FROM applied"))
def scd2_dedup_batch(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    return scd2.apply_batch(target, batch.unionByName(batch), DIM)


@query(EVENTS_SQL("SELECT * FROM applied"))
def scd2_stored(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    table = scratch_table(spark, "dimension").create(target.schema, keys=DIM.keys, buckets=8)
    table.load(target, DIM)
    table.apply_scd2(batch, DIM, batch="first")
    table.apply_scd2(batch, DIM, batch="first")
    return table.read()


@query(EVENTS_SQL("SELECT * FROM applied WHERE is_current"))
def scd2_current(spark, sf_dir):
    return tables.select(scd2_full(spark, sf_dir), "*", [{"column": "is_current", "operator": "=", "value": True}])


@query(EVENTS_SQL("SELECT * FROM applied WHERE begin_date <= TIMESTAMP '2024-01-20' AND (end_date IS NULL OR end_date > TIMESTAMP '2024-01-20')"))
def scd2_point_in_time(spark, sf_dir):
    return scd2.at_time(scd2_full(spark, sf_dir), DIM, F.lit(datetime(2024, 1, 20)))


@query(EVENTS_SQL("SELECT * FROM applied WHERE user_id = 3 ORDER BY begin_date"))
def scd2_history_of_key(spark, sf_dir):
    return scd2_full(spark, sf_dir).where("user_id = 3").orderBy("begin_date")


@query(scd2_sql(["user_id", "event_type"], ["value"], "SELECT * FROM applied"))
def scd2_composite_key(spark, sf_dir):
    target, batch = _parts(spark, sf_dir, COMPOSITE)
    return scd2.apply_batch(target, batch, COMPOSITE)


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS BIGINT) AS rn FROM events")
def window_row_number(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(order).cast("long").alias("rn"))


@query("SELECT event_id, user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events")
def window_lead(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.lead("ts").over(order).alias("next_ts"))


# Joins, sets, aggregates, windows and functions by SQL

both("join_inner", "SELECT c_custkey, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
both("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 100000")
both("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL OUTER JOIN {customer} ON s_suppkey = 2 * c_custkey")
both("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
both("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("join_theta", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
both("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
both("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
both("agg_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
both("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS rnk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS dense FROM {orders}")
both("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}")
both("window_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS recent FROM {orders}")
both("window_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quartile FROM {orders}")
both("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("fn_string", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, substring(p_brand, 1, 5) AS head, length(p_name) AS len, concat(p_brand, '/', p_type) AS both_names, replace(p_type, ' ', '_') AS snake, trim(concat('  ', p_brand, ' ')) AS bare, regexp_replace(p_brand, '[0-9]+', '') AS letters FROM {part}")
both("fn_datetime", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(o_orderdate + INTERVAL 7 DAY AS TIMESTAMP) AS later FROM {orders}")
both("fn_math", "SELECT l_orderkey, l_linenumber, round(power(l_discount, 2), 6) AS sq, round(sqrt(l_quantity), 6) AS root, abs(l_tax - l_discount) AS diff, CAST(floor(l_extendedprice) AS BIGINT) AS low, CAST(ceil(l_extendedprice) AS BIGINT) AS high, round(ln(l_extendedprice), 6) AS log_price, round(l_extendedprice / nullif(l_quantity, 0), 7) AS unit FROM {lineitem}")
both("fn_null", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' END AS state, nullif(c_nationkey, 3) AS nation FROM {customer}")
both("sql_passthrough_q", "WITH big AS (SELECT o_orderkey, o_orderdate, c_mktsegment FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1998-01-01') SELECT c_mktsegment, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM big JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY c_mktsegment, l_returnflag")


@query("SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN (VALUES (0.0, 10.0, 'small'), (10.0, 30.0, 'middle'), (30.0, 60.0, 'large')) AS b(low, high, band) ON l_quantity >= low AND l_quantity < high")
def join_range(spark, sf_dir):
    bands = spark.createDataFrame([(0.0, 10.0, "small"), (10.0, 30.0, "middle"), (30.0, 60.0, "large")], "low double, high double, band string")
    return joins.range_join(read(spark, sf_dir, "lineitem"), bands, "l_quantity", "low", "high", 10.0).select("l_orderkey", "l_linenumber", "band")


@query("""SELECT e.event_id, e.user_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS purchase_id
FROM events e WHERE e.event_type = 'view'""")
def asof_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return joins.asof_join(views, bought, ["user_id"], "ts", "ts", ["purchase_id"], slice_seconds=86_400).drop("ts")


SESSIONS_SQL = """marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (SELECT user_id, min(ts) AS began, max(ts) AS ended FROM numbered GROUP BY user_id, session)"""


@query(f"""WITH {SESSIONS_SQL} SELECT a.user_id, a.began, a.ended, b.began AS other_began, b.ended AS other_ended
FROM sessions a JOIN sessions b ON b.user_id = a.user_id + 1 AND a.began <= b.ended AND b.began <= a.ended""")
def join_interval(spark, sf_dir):
    """Sessions of each user that overlap those of the next."""
    span = F.session_window("at", "6 hours")
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    sessions = events.groupBy("user_id", span).agg(F.min("ts").alias("began"), F.max("ts").alias("ended")).drop("session_window")
    others = sessions.select((F.col("user_id") - 1).alias("user_id"), F.col("began").alias("other_began"), F.col("ended").alias("other_ended"))
    return joins.interval_join(sessions, others, ("began", "ended"), ("other_began", "other_ended"), 3600.0, ["user_id"]).select("user_id", "began", "ended", "other_began", "other_ended")


both("join_lateral_topk", "SELECT c_custkey, o_orderkey, o_totalprice FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")


@query("SELECT c_custkey, s_suppkey, CAST(distance AS DOUBLE) AS distance FROM (SELECT c_custkey, s_suppkey, distance, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) AS k FROM (SELECT c_custkey, s_suppkey, (CAST(c_nationkey AS DOUBLE) - s_nationkey) * (CAST(c_nationkey AS DOUBLE) - s_nationkey) + (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) AS distance FROM customer, supplier)) WHERE k = 1")
def nearest_join(spark, sf_dir):
    found = joins.nearest_join(read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier"), ("c_nationkey", "c_acctbal"), ("s_nationkey", "s_acctbal"), "s_suppkey", 8.0)
    return found.select("c_custkey", "s_suppkey", "distance")


BOUND_SQL = f"abs(parts - estimate) <= {aggregates.BOUND} * parts"


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS within FROM lineitem GROUP BY 1")
def agg_approx_distinct(spark, sf_dir):
    """Whether the estimate is within five of its standard errors of 1 %. Both are of the
    different parts, of which the registers of an estimate are the same as of all rows:
    beside countDistinct in one aggregate, Spark would keep registers for each part."""
    parts = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    counted = parts.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.01).alias("estimate"))
    return counted.select("l_returnflag", "parts", (F.abs(F.col("parts") - F.col("estimate")) <= F.greatest(F.lit(1), 0.05 * F.col("parts"))).alias("within"))


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS within, true AS middle FROM lineitem GROUP BY 1")
def agg_sketch_distinct(spark, sf_dir):
    """Sketches by month, stored, and merged to those of a return flag: the estimate of
    distinct parts is within three standard errors, and the median's rank within 2 %."""
    items = read(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "sketches")
    aggregates.sketched(items, ["l_returnflag", F.trunc("l_shipdate", "month").alias("month")], "l_partkey", "l_extendedprice").write.parquet(path)
    merged = aggregates.merged(spark.read.parquet(path), ["l_returnflag"]).select("l_returnflag", "n", aggregates.distinct_estimate().alias("estimate"), aggregates.quantile(0.5).alias("median"))
    exact = items.join(F.broadcast(merged.select("l_returnflag", "median")), "l_returnflag")  # a row per flag
    exact = exact.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.avg((F.col("l_extendedprice") <= F.col("median")).cast("double")).alias("share"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", "n", "parts", F.expr(BOUND_SQL).alias("within"), F.col("share").between(0.48, 0.52).alias("middle"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_bitmap_rollup(spark, sf_dir):
    found = aggregates.distinct_rollup(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey")
    return found.withColumnRenamed("distinct", "parts")


@query("""SELECT l_returnflag, min(l_quantity) AS median, any_value(total) AS total FROM (
SELECT l_returnflag, l_quantity, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS reached, sum(w) OVER (PARTITION BY l_returnflag) AS total
FROM (SELECT l_returnflag, l_quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2)) WHERE 2 * reached >= total GROUP BY 1""")
def udaf_weighted_median(spark, sf_dir):
    """The quantity at which half of each return flag's turnover, in cents, is reached."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    return aggregates.weighted_median(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", cents), ["l_returnflag"], "l_quantity", "cents")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, list_contains(list(event_type), 'error') AS failed, CAST(len(list(event_type)) AS INTEGER) AS n FROM events GROUP BY user_id")
def fn_array(spark, sf_dir):
    lists = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count("*").cast("int").alias("n"))
    return lists.select("user_id", F.array_join("kinds", ",").alias("kinds"), F.array_contains("kinds", "error").alias("failed"), "n")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id")
def fn_map(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("by_type"))
    return maps.select("user_id", *[F.coalesce(F.try_element_at("by_type", F.lit(k)), F.lit(0)).alias(f"{k}s") for k in ("view", "click")])


# User functions


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 5) AS gross FROM lineitem WHERE l_quantity > 25")
def udf_map_batches(spark, sf_dir):
    def gross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"l_orderkey": rows["l_orderkey"], "l_linenumber": rows["l_linenumber"], "gross": rows["l_extendedprice"] * (1 + rows["l_tax"])})

    items = read(spark, sf_dir, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    return items.mapInPandas(gross, "l_orderkey long, l_linenumber int, gross double").withColumn("gross", F.round("gross", 5))


@query("SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS odd FROM part")
def udf_scalar(spark, sf_dir):
    @F.pandas_udf("long")
    def odd(size: pd.Series) -> pd.Series:
        return size.astype("int64") * 2 + 1

    return read(spark, sf_dir, "part").select("p_partkey", odd("p_size").alias("odd"))


@F.udtf(returnType="name: string, content: string")
class JsonFields:
    """The fields of a JSON object, a row each; their values as JSON texts."""

    def eval(self, text: str):
        import json

        for name, content in json.loads(text or "{}").items():
            yield name, json.dumps(content)


@query("SELECT event_id, unnest(json_keys(props)) AS name, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS VARCHAR) AS content FROM events")
def udtf_lateral(spark, sf_dir):
    spark.udtf.register("json_fields", JsonFields)
    return tables.guarded_sql(spark, "SELECT event_id, f.name, f.content FROM {events}, LATERAL json_fields(props) AS f", events=read(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing, (SELECT 'OBJECT<k: BIGINT>' FROM events LIMIT 1) AS shape FROM events")
def variant_props(spark, sf_dir):
    """Semi-structured columns: texts parsed once, fields by path, and one schema of all."""
    parsed = read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    shape = parsed.agg(F.schema_of_variant_agg("v").alias("shape"))
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.try_variant_get("v", "$.none", "string").alias("missing")).crossJoin(F.broadcast(shape))  # one row


# Streams


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return streams.read_log(spark, f"{sf_dir}/events*.parquet", schema)


def _ending(spark, sf_dir, name: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``found`` makes of a stream of the events in the order of their days, and then
    two clicks of a user -1, a year later: the first moves the watermark past all others,
    the second starts the batch that meets it.

    The stream is drained whenever a part of it, a third of the days or a click, has
    arrived, so each is a micro-batch of its own however many files it has: these are in
    no order of time, and a batch of some of them would make the others' rows late.
    """
    path, events = scratch_path(spark, name), read(spark, sf_dir, "events")

    def arrives(rows: DataFrame, part: str) -> None:
        streams.append_log(rows, f"{path}/log", part)
        streams.drain_to(found(streams.read_log(spark, f"{path}/log", events.schema)), f"{path}/rows", f"{path}/checkpoint")

    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3 if first else 0):
        third = lambda n: first + (last - first) * n / 3  # noqa: E731, B023
        arrives(events.where((F.col("ts") >= F.lit(third(k))) & ((F.col("ts") < F.lit(third(k + 1))) | F.lit(k == 2))), str(k))
    for k in range(2):
        end = events.agg((F.max("ts") + F.expr(f"INTERVAL {365 + k} DAYS")).alias("ts"))
        arrives(end.select(*[F.col("ts") if c == "ts" else F.lit("click" if c == "event_type" else -1 if c in ("event_id", "user_id") else None).cast(t).alias(c) for c, t in events.dtypes]), f"end-{k}")
    return spark.read.parquet(f"{path}/rows")


def _drained(spark, df: DataFrame, name: str, aggregate: bool = True) -> DataFrame:
    path = scratch_path(spark, name)
    (streams.drain_aggregate if aggregate else streams.drain_to)(df, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def _updated(spark, windows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path = scratch_path(spark, name)
    streams.drain_updates(windows, f"{path}/rows", f"{path}/checkpoint")
    return streams.read_updates(spark, f"{path}/rows", keys).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_passthrough(spark, sf_dir):
    return _drained(spark, _event_stream(spark, sf_dir).where("event_type <> 'error'").select("event_id", "user_id", "event_type", "value"), "passthrough", False)


@query("SELECT 'a' AS consumer, event_id FROM events UNION ALL SELECT 'b', event_id FROM events WHERE value > 50")
def stream_fanout(spark, sf_dir):
    log = scratch_path(spark, "fanout-log")
    streams.append_log(read(spark, sf_dir, "events").repartition(4), log)
    stream = lambda: streams.read_log(spark, log, read(spark, sf_dir, "events").schema, files_per_trigger=1)
    a = _drained(spark, stream().select(F.lit("a").alias("consumer"), "event_id"), "fanout-a", False)
    b = _drained(spark, stream().where("value > 50").select(F.lit("b").alias("consumer"), "event_id"), "fanout-b", False)
    return a.unionByName(b)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_tumbling(spark, sf_dir):
    events = streams.timed(_event_stream(spark, sf_dir), "ts", "1 day")
    windows = streams.tumbling(events, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return _updated(spark, windows, "tumbling", ["window_start", "event_type"])


@query("SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def stream_window_sliding(spark, sf_dir):
    windows = streams.sliding(streams.timed(_event_stream(spark, sf_dir), "ts", "1 day"), "ts", "2 hours", "1 hour", [], F.count("*").alias("n"))
    return _updated(spark, windows, "sliding", ["window_start"])


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p
ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR""")
def stream_join(spark, sf_dir):
    of = lambda kind, name: streams.timed(_event_stream(spark, sf_dir), "ts", "1 day").where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", "ts")
    pairs = streams.joined_within(of("click", "click_id"), of("purchase", "purchase_id"), ["user_id"], "ts", "ts", "6 HOURS")
    return _drained(spark, pairs.select("click_id", "purchase_id"), "stream-join", False)


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT min(ts) AS session_start, user_id, count(*) AS n FROM numbered GROUP BY user_id, session""")
def stream_session(spark, sf_dir):
    """In append mode: a session is written once, when the watermark has passed it, and
    leaves the state."""
    found = lambda events: streams.sessions(streams.timed(events, "ts", "1 hour"), "ts", "2 hours", ["user_id"], F.count("*").alias("n"))
    return _ending(spark, sf_dir, "sessions", found).where("user_id >= 0").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_id AS opened, (SELECT p.event_id FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR ORDER BY p.ts, p.event_id LIMIT 1) AS answer
FROM events c WHERE event_type = 'click'""")
def stream_state_timers(spark, sf_dir):
    """For each click the user's first purchase within six hours, or an alert without."""
    rule = streams.Awaited(["user_id"], "event_id", "ts", "event_type", "click", "purchase", 6 * 3_600_000)
    with streams.keyed_state(spark):
        return _ending(spark, sf_dir, "timers", lambda events: streams.awaited(streams.timed(events, "ts", "1 hour"), rule)).where("user_id >= 0")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    log = scratch_path(spark, "dedup-log")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    streams.append_log(events.unionByName(events), log)
    seen = streams.distinct_within(streams.timed(streams.read_log(spark, log, events.schema), "ts", "60 days"), ["event_id"])
    return _drained(spark, seen.select("event_id", "user_id"), "dedup", False)


@query(EVENTS_SQL("SELECT * FROM applied"))
def stream_scd2(spark, sf_dir):
    target, batch = _parts(spark, sf_dir)
    path = scratch_path(spark, "stream-scd2")
    table = scratch_table(spark, "stream_dimension").create(target.schema, keys=DIM.keys, buckets=8)
    table.load(target, DIM)
    streams.append_log(batch, f"{path}/log")
    streams.drain_scd2(streams.read_log(spark, f"{path}/log", batch.schema), table, DIM, f"{path}/checkpoint")
    return table.read()


# Pipelines, runs and logs

PIPELINE = {
    "name": "shop",
    "connections": [{"name": "lake", "type": "warehouse", "path": "/lake"}, {"name": "shop", "type": "api", "base_url": "http://localhost"}],
    "layers": [
        {"name": "bronze", "nodes": [{"name": "orders", "inputs": [{"methods": [{"method": "api", "connection": "shop", "endpoint": "orders"}]}]}, {"name": "customers", "inputs": [{"methods": [{"method": "api", "connection": "shop", "endpoint": "customers"}]}]}]},
        {"name": "silver", "nodes": [{"name": "joined", "inputs": [{"ref": "bronze.orders"}, {"ref": "bronze.customers"}]}, {"name": "audit", "inputs": [{"ref": "bronze.orders"}], "enabled": False}]},
        {"name": "gold", "nodes": [{"name": "report", "inputs": [{"ref": "silver.joined"}], "outputs": {"methods": [{"method": "api", "connection": "shop", "endpoint": "report"}]}}]},
    ],
}
STATUS = {"bronze.orders": dag.Status.SUCCESS, "bronze.customers": dag.Status.SUCCESS, "silver.joined": dag.Status.PENDING, "silver.audit": dag.Status.SKIPPED, "gold.report": dag.Status.PENDING}


@query("SELECT * FROM (VALUES ('bronze.orders', 'silver.joined'), ('bronze.customers', 'silver.joined'), ('bronze.orders', 'silver.audit'), ('silver.joined', 'gold.report')) AS t(parent, node)")
def dag_edges(spark, sf_dir):
    return dag.edge_rows(spark, dag.compile_graph(PIPELINE))


@query("SELECT * FROM (VALUES ('bronze.orders', 0::BIGINT), ('bronze.customers', 0), ('silver.joined', 1), ('silver.audit', 1), ('gold.report', 2)) AS t(node, depth)")
def dag_depth(spark, sf_dir):
    return spark.createDataFrame(list(dag.compile_graph(PIPELINE).depth().items()), "node string, depth long")


@query("SELECT 'silver.joined' AS node")
def dag_ready(spark, sf_dir):
    return dag.ready_nodes(dag.status_rows(spark, STATUS), dag.edge_rows(spark, dag.compile_graph(PIPELINE)))


@query("SELECT * FROM (VALUES ('midway', false), ('done', true)) AS t(run, complete)")
def dag_complete(spark, sf_dir):
    done = {n: dag.Status.SUCCESS for n in STATUS}
    rows = [("midway", n, s.value) for n, s in STATUS.items()] + [("done", n, s.value) for n, s in done.items()]
    settled = F.bool_and(F.col("status").isin(*[s.value for s in dag.SETTLED]))
    return spark.createDataFrame(rows, "run string, node string, status string").groupBy("run").agg(settled.alias("complete"))


@query("SELECT * FROM (VALUES ('bronze.orders', 'input', 'GET', 'orders'), ('bronze.customers', 'input', 'GET', 'customers'), ('gold.report', 'output', 'POST', 'report')) AS t(node, side, http_method, endpoint)")
def endpoint_union(spark, sf_dir):
    return config.endpoints(spark, PIPELINE)


@query("SELECT 'shop' AS pipeline, 3::BIGINT AS layers, 5::BIGINT AS nodes, 2::BIGINT AS connections")
def pipeline_summary(spark, sf_dir):
    return config.summary(spark, PIPELINE)


def _node_events(spark, sf_dir) -> DataFrame:
    """Events as checkpoints: the user is the node, errors are failures."""
    status: Column = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("success")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), "ts", "event_id", status.alias("status"), "value")


STATUS_SQL = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END"


@query(f"""SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running,
round(count(*) FILTER (status = 'success') / count(*), 3) AS success_rate, round(avg(secs), 2) AS avg_seconds, round(min(secs), 2) AS min_seconds, round(max(secs), 2) AS max_seconds
FROM (SELECT {STATUS_SQL} AS status, CASE WHEN {STATUS_SQL} = 'success' THEN (event_id % 100 + 1)::DOUBLE END AS secs FROM events)""")
def run_metrics_summary(spark, sf_dir):
    ended = (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 100 + 1).cast("decimal(18,6)"))).alias("completed")
    return metrics.run_summary(_node_events(spark, sf_dir).select("status", F.col("ts").cast("timestamp").alias("started"), ended))


@query("SELECT user_id AS node_id, count(*) AS batches, round(sum(coalesce(nullif(value, 0), 0)), 3) AS sum_value, round(avg(coalesce(nullif(value, 0), 0)), 3) AS avg_value FROM events GROUP BY user_id")
def run_metrics_by_node(spark, sf_dir):
    return metrics.node_summary(_node_events(spark, sf_dir), measures=("value",))


@query("""SELECT 'rows' AS name, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'customers', max(o_custkey) FROM orders UNION ALL SELECT 'written', count(*) FILTER (o_orderstatus <> 'P') FROM orders""")
def observed_counts(spark, sf_dir):
    """Counts of what is read and of what is written, taken by the job that writes."""
    orders, seen = metrics.observed(read(spark, sf_dir, "orders"), f"read-{uuid.uuid4().hex}", rows=F.count(F.lit(1)), open=F.count_if(F.col("o_orderstatus") == "O"), customers=F.max("o_custkey"))
    kept, wrote = metrics.observed(orders.where("o_orderstatus <> 'P'"), f"written-{uuid.uuid4().hex}", written=F.count(F.lit(1)))
    kept.write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame(list((metrics.observation(seen) | metrics.observation(wrote)).items()), "name string, n long")


@query(f"SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS run_id, CASE WHEN bool_or({STATUS_SQL} = 'failed') THEN 'failed' WHEN user_id % 2 = 0 THEN 'running' WHEN bool_and({STATUS_SQL} = 'success') THEN 'success' ELSE 'unknown' END AS status FROM events GROUP BY user_id, CAST(ts AS DATE)")
def run_status(spark, sf_dir):
    """A run is a user's day: over all events, nearly every user has failed once."""
    run = F.col("node_id") * 100000 + F.unix_date(F.col("ts").cast("date"))
    return metrics.run_status(_node_events(spark, sf_dir).select(run.alias("run_id"), F.when(F.col("node_id") % 2 == 0, "active").otherwise("archive").alias("state"), "status"))


@query("SELECT DISTINCT user_id AS run_id, 'active' AS state FROM events WHERE user_id % 2 = 0 UNION ALL SELECT DISTINCT user_id, 'archive' FROM events WHERE user_id % 2 <> 0")
def run_union(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    return runs.where("run_id % 2 = 0").withColumn("state", F.lit("active")).unionByName(runs.where("run_id % 2 <> 0").withColumn("state", F.lit("archive")))


@query("SELECT event_id, ts AS timestamp, 'node.' || user_id AS component FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-10' AND user_id::VARCHAR LIKE '1%'")
def log_filter(spark, sf_dir):
    logs = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), F.upper("event_type").alias("level"), F.concat(F.lit("node."), F.col("user_id").cast("string")).alias("component"))
    return metrics.filter_logs(logs, "error", datetime(2024, 1, 10), "node.1*").drop("level")


@query("SELECT node_id, round(sum(value), 2) AS seconds FROM (SELECT user_id AS node_id, value FROM events WHERE event_type <> 'error') GROUP BY node_id")
def node_runtime(spark, sf_dir):
    return _node_events(spark, sf_dir).where("status <> 'failed'").groupBy("node_id").agg(F.round(F.sum("value"), 2).alias("seconds"))


@query(f"SELECT node_id, status FROM (SELECT user_id AS node_id, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def run_latest(spark, sf_dir):
    return metrics.latest(_node_events(spark, sf_dir), ["node_id"], "ts").select("node_id", "status")
