import datetime

import pytest
from pyspark.sql import types as T

from millrace.functions import expressions, types
from millrace.sources import tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("flag", T.BooleanType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("d", T.TimestampNTZType())])
MATRIX = [
    {"id": 1, "flag": True, "s": "it's", "n": 1.0, "d": datetime.datetime(2024, 1, 1)},
    {"id": 2, "flag": False, "s": "50%_x", "n": None, "d": None},
    {"id": 3, "flag": None, "s": None, "n": 3.0, "d": datetime.datetime(2024, 2, 1)},
]


@pytest.fixture(scope="module")
def matrix(spark):
    return tables.literal_rows(spark, MATRIX, SCHEMA)


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (None, [1, 2, 3]),
        ([], [1, 2, 3]),
        ([{"column": "flag", "operator": "=", "value": True}], [1]),
        ([{"column": "flag", "operator": "=", "value": False}], [2]),
        ([{"column": "flag", "operator": "<>", "value": True}], [2]),
        ([{"column": "s", "operator": "=", "value": "it's"}], [1]),
        ([{"column": "s", "operator": "like", "value": "50\\%%"}], [2]),
        ([{"column": "s", "operator": "=", "value": None}], [3]),
        ([{"column": "n", "operator": "is not", "value": None}], [1, 3]),
        ([{"column": "id", "operator": "in", "value": [1, 3]}], [1, 3]),
        ([{"column": "id", "operator": "=", "value": [2]}], [2]),
        ([{"column": "id", "operator": "between", "value": [2, 3]}], [2, 3]),
        ({"id": {"operator": ">", "value": 1}, "n": 3.0}, [3]),
        ("id > 1 AND s IS NOT NULL", [2]),
        ([{"column": "d", "operator": ">", "value": datetime.datetime(2024, 1, 15)}], [3]),
    ],
)
def test_filters(matrix, filters, ids):
    assert [r.id for r in tables.select(matrix, ["id"], filters, ["id"]).collect()] == ids


@pytest.mark.parametrize("bad", [[{"column": "id", "operator": "; DROP", "value": 1}], [{"operator": "="}], 5, [{"column": "id", "operator": "<", "value": None}]])
def test_bad_filters_raise(matrix, bad):
    with pytest.raises(ValueError):
        tables.select(matrix, "*", bad)


def test_projections(matrix):
    assert tables.select(matrix, None).columns == SCHEMA.names
    assert tables.select(matrix, "id, n * 2 AS twice").columns == ["id", "twice"]
    assert tables.select(matrix, [{"expression": "id + 1", "name": "next"}, {"name": "s", "alias": "t"}]).columns == ["next", "t"]
    for bad in ([5], [{}], 7):
        with pytest.raises(ValueError):
            tables.select(matrix, bad)


def test_nulls_sort_last_in_both_directions(matrix):
    for direction, ids in (("asc", [1, 3, 2]), ("DESC", [3, 1, 2])):
        assert [r.id for r in tables.select(matrix, ["id"], sort_by=[{"column": "n", "direction": direction}]).collect()] == ids
    with pytest.raises(ValueError):
        expressions.orders([{"column": "n", "direction": "up"}])


@pytest.mark.parametrize(("size", "counts"), [(1000, [1000] * 5), (1024, [1024] * 4 + [904])])
def test_pages(spark, size, counts):
    found = tables.pages(spark.range(5000).repartition(7), ["id"], size).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in found] == counts


def test_guarded_sql(spark, matrix):
    assert tables.guarded_sql(spark, "WITH t AS (SELECT * FROM {m}) SELECT count(*) AS n FROM t", m=matrix).first().n == 3
    for text in ("DROP TABLE x", "CREATE TABLE x (a INT)", "INSERT INTO x VALUES (1)", "SET a = 1", "DELETE FROM x", "SHOW TABLES"):
        with pytest.raises(tables.NotAQuery):
            tables.guarded_sql(spark, text)


def test_types(spark):
    assert types.parse_type("decimal") == T.DecimalType(18, 3)
    assert types.parse_type("timestamp") == T.TimestampNTZType()
    assert types.parse_type("map<string, string>") == T.MapType(T.StringType(), T.StringType())
    assert types.parse_type("array<int>") == T.ArrayType(T.IntegerType())
    with pytest.raises(ValueError):
        types.parse_type("no such type")
    with pytest.raises(ValueError):
        types.schema_of([{"name": "a"}])
