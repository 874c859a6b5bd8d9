"""Joins and aggregates of one's own against plain loops."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins
from millrace.plans import catalogue
from millrace.sources import tables

D = lambda seconds: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize(("slices", "equal"), [(None, True), (None, False), (50, True), (50, False)])
def test_asof_with_ties_slices_and_nulls(spark, slices, equal):
    rng = random.Random(1)
    left = [(k, rng.choice([1, 1, 1, 2, None]), rng.choice([D(rng.randrange(400)), None] if k % 20 == 0 else [D(rng.randrange(400))])) for k in range(300)]
    right = [(rng.choice([1, 1, 2, 3, None]), D(rng.randrange(400)), rng.randrange(50), rng.choice("xyz")) for _ in range(120)]
    found = joins.asof_join(spark.createDataFrame(left, "id int, k int, t timestamp_ntz").repartition(3), spark.createDataFrame(right, "k int, t timestamp_ntz, v int, w string").repartition(2), ["k"], "t", "t", ["v", "w"], equal, slices, hot_rows=30)
    expected = []
    for ident, k, t in left:
        before = [(s, v, w) for key, s, v, w in right if key == k and k is not None and t is not None and (s <= t if equal else s < t)]
        expected.append((ident, k, t, *(max(before)[1:] if before else (None, None))))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(2)
    span = lambda: (lambda a, n: (a, a + n))(rng.uniform(-1000, 1000), rng.choice([0, 0.3, 1, 7, 64, 900]) * rng.random())
    left = [(k, k % 2, *span()) for k in range(120)] + [(900, 0, -5e6, 5e6), (901, 0, None, 3.0), (902, 0, 5.0, 1.0), (903, 1, 8.0, 8.0)]
    right = [(k, k % 2, *span()) for k in range(120)] + [(900, 0, -4e6, 6e6), (901, 1, 1.0, None), (903, 1, 8.0, 8.0)]
    a, b = spark.createDataFrame(left, "i int, g int, a double, b double"), spark.createDataFrame(right, "j int, g int, c double, d double")
    pairs = lambda by: sorted((x[0], y[0]) for x in left for y in right if None not in (*x, *y) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and (not by or x[1] == y[1]))
    assert sorted(map(tuple, joins.interval_join(a, b.drop("g"), ("a", "b"), ("c", "d"), 1.0).select("i", "j").collect())) == pairs(False)
    assert sorted(map(tuple, joins.interval_join(a, b, ("a", "b"), ("c", "d"), 1.0, ["g"]).select("i", "j").collect())) == pairs(True)
    points = spark.createDataFrame([(float(k) / 3,) for k in range(-60, 60)], "p double")
    wide = spark.createDataFrame([(-1e7, 1e7, "all"), (0.0, 3.0, "few"), (2.0, 2.0, "none")], "low double, high double, name string")
    found = sorted(map(tuple, joins.range_join(points, wide, "p", "low", "high", 1.0).select("p", "name").collect()))
    assert found == sorted([(k / 3, "all") for k in range(-60, 60)] + [(k / 3, "few") for k in range(9)])
    assert joins.range_join(points, wide.limit(0), "p", "low", "high", 1.0).count() == 0


def test_nearest_of_tables(spark):
    rng = random.Random(3)
    draw = lambda n: [(k, rng.choice([rng.uniform(0, 100), 5e4 * rng.random()]), float(rng.randrange(40))) for k in range(n)]
    left, right = [*draw(80), (80, None, 1.0), (81, -9e5, -9e5)], [*draw(30), (30, 3.0, 3.0), (31, 3.0, 3.0), (32, None, 2.0)]
    a, b = spark.createDataFrame(left, "i int, x double, y double"), spark.createDataFrame(right, "key int, u double, v double")
    found = {r.i: (r.key, r.distance) for r in joins.nearest_join(a, b, ("x", "y"), ("u", "v"), "key", 1.0).collect()}
    for i, x, y in left:
        best = min(((x - u) * (x - u) + (y - v) * (y - v), k) for k, u, v in right if u is not None) if x is not None else (None, None)
        assert found[i] == best[::-1]
    assert {(r.key, r.distance) for r in joins.nearest_join(a, b.limit(0), ("x", "y"), ("u", "v"), "key", 1.0).collect()} == {(None, None)}


def test_nearest_compares_few_points_however_dense(spark, monkeypatch):
    rng = random.Random(4)
    # All right points within one cell of the given width, and some of them far denser than the others.
    right = [(k, rng.random() * rng.choice([1, 1e-3]), rng.random() * rng.choice([1, 1e-3])) for k in range(1500)]
    left = [(k, rng.random() * rng.choice([1, 1e-3]), rng.random() * rng.choice([1, 1e-3])) for k in range(300)]
    pairs, joined = [], type(spark.range(0)).join

    def join(self, other, on=None, how=None):
        out = joined(self, other, on, how)
        if on == ["_i", "_j"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(0)), "join", join)
    found = joins.nearest_join(spark.createDataFrame(left, "i int, x double, y double"), spark.createDataFrame(right, "key int, u double, v double"), ("x", "y"), ("u", "v"), "key", 8.0)
    got = {r.i: (r.key, r.distance) for r in found.collect()}
    for i, x, y in left:
        assert got[i] == min(((x - u) * (x - u) + (y - v) * (y - v), k) for k, u, v in right)[::-1]
    assert sum(pairs) < len(left) * len(right) / 5  # with cells of 8 all pairs met


def test_plans_have_no_cross_join(spark, sf_dir, capsys):
    for name in ("nearest_join", "join_interval", "join_range", "join_lateral_topk"):
        catalogue.QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
    catalogue.QUERIES["agg_bitmap_rollup"](spark, sf_dir).explain()
    lines = capsys.readouterr().out.splitlines()
    (expand,) = [k for k, line in enumerate(lines) if "Expand" in line]
    assert any("bitmap_construct_agg" in line for line in lines[expand:])


def test_a_group_with_nearly_all_rows_is_merged_before_the_shuffle(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("IF(id % 20 = 0, 'few', 'most') AS g", "id % 7 AS v", "id % 5 + 1 AS w")
    found = {r.g: (r.median, r.total) for r in aggregates.weighted_median(rows, ["g"], "v", "w").collect()}
    data = [("few" if k % 20 == 0 else "most", k % 7, k % 5 + 1) for k in range(20_000)]
    for g in ("few", "most"):
        own = sorted((v, w) for x, v, w in data if x == g)
        total, reached = sum(w for _, w in own), 0
        for v, w in own:
            reached += w
            if 2 * reached >= total:
                break
        assert found[g] == (v, total)
    sizes = []

    def merge(table: pa.Table) -> pa.Table:
        return table.group_by(["g", "value"]).aggregate([("weight", "sum")]).rename_columns(["g", "value", "weight"])

    states = rows.select("g", F.col("v").alias("value"), F.col("w").alias("weight"))
    counted = aggregates.aggregate_in_parts(states, ["g"], "value long, weight long", merge, lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64())}), "n long", most=100)
    sizes = {r.g: r.n for r in counted.collect()}
    assert sizes == {"few": 7, "most": 7}


def test_sketches_of_batches_merge(spark):
    parts = [aggregates.sketched(spark.range(k * 3000, k * 3000 + 5000).selectExpr("'x' AS g", "id", "id AS v"), ["g"], "id", "v") for k in range(3)]
    merged = aggregates.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    row = merged.select("n", aggregates.distinct_estimate().alias("d"), aggregates.quantile(0.5).alias("m")).first()
    assert row.n == 15_000 and abs(row.d - 11_000) <= aggregates.BOUND * 11_000 and 4500 < row.m < 6500


def test_estimates_of_distinct_parts_keep_registers_by_flag_only(spark, tmp_path, capsys):
    rows = [("A", 1), ("A", 1), ("A", None), ("B", None), (None, 5), (None, 6), (None, 5), *[("C", k % 700) for k in range(2000)]]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["agg_approx_distinct"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("A", 1, True), ("B", 0, True), (None, 2, True), ("C", 700, True)}
    found.explain()
    # Registers stand in no aggregate whose keys include the part.
    assert not [line for line in capsys.readouterr().out.splitlines() if "approx_count_distinct" in line and "l_partkey" in line.split("functions=")[0]]


def test_bitmaps_of_large_numbers_and_nulls(spark):
    rows = [(k % 3, k % 2, v) for k in range(60) for v in (k * 40_000 % 100_003, None)]
    found = {(r.a, r.b): r.distinct for r in aggregates.distinct_rollup(spark.createDataFrame(rows, "a int, b int, v long"), ["a", "b"], "v").collect()}
    count = lambda keep: len({v for a, b, v in rows if keep(a, b) and v is not None})
    assert found[(None, None)] == count(lambda a, b: True) and found[(1, None)] == count(lambda a, b: a == 1) and found[(2, 1)] == count(lambda a, b: (a, b) == (2, 1))
    assert len(found) == 10


def test_variants_of_odd_shape(spark):
    texts = [(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "[1, 2]"), (4, "not json"), (5, None), (6, '{"none": "here", "k": 7.0}')]
    parsed = spark.createDataFrame(texts, "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    found = {r.i: (r.k, r.s) for r in parsed.select("i", F.try_variant_get("v", "$.k", "int").alias("k"), F.try_variant_get("v", "$.none", "string").alias("s")).collect()}
    assert found == {1: (5, None), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (7, "here")}


def test_guarded_sql(spark):
    assert tables.guarded_sql(spark, "SELECT 'a{3}' AS t, '{x}' AS u, id FROM {r} -- {not}", r=spark.range(1)).first()[:2] == ("a{3}", "{x}")
    for text in ("SELECT reflect('java.lang.System', 'setProperty', 'a', 'b')", "WITH c AS (SELECT java_method('java.lang.System', 'exit', 1)) SELECT * FROM c", "SELECT (SELECT try_reflect('x', 'y'))", "SELECT 1 WHERE `reflect`('x', 'y') = 'z'", "DROP TABLE x", "INSERT INTO x SELECT 1", "SET a = b"):
        with pytest.raises(tables.NotAQuery):
            tables.guarded_sql(spark, text)
    assert tables.guarded_sql(spark, "SELECT 'reflect(' AS t").first().t == "reflect("
    with pytest.raises(KeyError):
        tables.guarded_sql(spark, "SELECT * FROM {r}")
