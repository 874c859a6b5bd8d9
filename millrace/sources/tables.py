"""Reading tables, rows and guarded SQL as DataFrames."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import expressions


def select(df: DataFrame, columns: Any = None, filters: Any = None, sort_by: Any = None, limit: int | None = None) -> DataFrame:
    """A structured query: filter, order and limit on the source, then project; the
    optimizer moves filters and columns into the scan."""
    condition = expressions.predicate(filters)
    out = df if condition is None else df.where(condition)
    if sort_by:
        out = out.orderBy(*expressions.orders(sort_by))
    if limit is not None:
        out = out.limit(int(limit))
    return expressions.project(out, columns)


def literal_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Rows given in Python, matched to ``schema`` by name; missing values are null."""
    return spark.createDataFrame([tuple(row.get(name) for name in schema.names) for row in rows], schema)


#: Ranges of keys that pages are numbered by, at most, and rows of one, about.
MOST_RANGES, RANGE_ROWS = 128, 200_000


class Pages:
    """A table cut into pages of ``size`` rows in the order of ``keys`` (ascending, nulls
    last), which must be unique for the pages to be stable.

    Bounds of ranges are taken once from a sample of the keys, and the rows of each range
    counted: a page is the rows before a row's range plus its place there. Bounds and counts
    are all that is kept, ``MOST_RANGES`` at most, so nothing is stored.
    """

    def __init__(self, df: DataFrame, keys: list[str], size: int = 1000):
        self.df, self.keys, self.size = df, list(keys), size
        total = df.count()
        ranges = max(1, min(MOST_RANGES, -(-total // RANGE_ROWS)))
        bounds = []
        if ranges > 1:
            share = min(1.0, 64 * ranges / total)
            sample = df.select(*self.keys).sample(fraction=share, seed=7).orderBy(*expressions.orders(self.keys)).collect()
            picked = [sample[len(sample) * k // ranges] for k in range(1, ranges) if sample]
            bounds = [row for k, row in enumerate(picked) if k == 0 or row != picked[k - 1]]
        self.bounds = bounds
        counts = dict(df.groupBy(self._range().alias("r")).count().collect())
        self.counts = [counts.get(k, 0) for k in range(len(bounds) + 1)]
        self.before = [sum(self.counts[:k]) for k in range(len(self.counts))]

    def _key(self) -> Column:
        return F.struct(*[c for k in self.keys for c in (F.col(k).isNull(), F.col(k))])

    def _bound(self, row) -> Column:
        types = {f.name: f.dataType for f in self.df.schema.fields}
        return F.struct(*[c for k in self.keys for c in (F.lit(row[k] is None), F.lit(row[k]).cast(types[k]))])

    def _range(self) -> Column:
        """The number of bounds that a row's key is at or above, found by halves."""
        key = self._key()

        def within(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key >= self._bound(self.bounds[middle]), within(middle + 1, high)).otherwise(within(low, middle))

        return within(0, len(self.bounds))

    def all(self) -> DataFrame:
        """All rows with ``page``, from 0. A task orders one range."""
        base = F.element_at(F.array(*[F.lit(n).cast("long") for n in self.before]), F.col("_range") + 1)
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*expressions.orders(self.keys)))
        numbered = self.df.withColumn("_range", self._range()).withColumn("_place", place)
        return numbered.withColumn("page", F.floor((base + F.col("_place") - 1) / F.lit(self.size)).cast("long")).drop("_range", "_place")

    def page(self, number: int) -> DataFrame:
        """The rows of one page: of the ranges that it touches only rows between their
        bounds are read, the first key's in the scan, and the first ones kept."""
        first, last = number * self.size, (number + 1) * self.size
        touched = [k for k, (at, n) in enumerate(zip(self.before, self.counts, strict=True)) if at < last and at + n > first]
        if not touched:
            return self.df.limit(0).withColumn("page", F.lit(number).cast("long"))
        low, high, key = touched[0], touched[-1], self.keys[0]
        rows = self.df
        if low > 0:
            rows = rows.where(self._key() >= self._bound(self.bounds[low - 1]))
            at = self.bounds[low - 1][key]
            rows = rows.where(F.col(key).isNull() if at is None else (F.col(key) >= F.lit(at)) | F.col(key).isNull())
        if high < len(self.bounds):
            rows = rows.where(self._key() < self._bound(self.bounds[high]))
            at = self.bounds[high][key]
            rows = rows if at is None else rows.where(F.col(key) <= F.lit(at))
        ordered = rows.orderBy(*expressions.orders(self.keys)).limit(last - self.before[low]).offset(first - self.before[low])
        return ordered.withColumn("page", F.lit(number).cast("long"))


def pages(df: DataFrame, keys: list[str], size: int = 1000) -> DataFrame:
    """Add ``page``, from 0, in the order of ``keys``."""
    return Pages(df, keys, size).all()


class NotAQuery(ValueError):
    """The statement would change something, or is none."""


#: Functions by which a query could call any method of the JVM.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def _parsed(spark: SparkSession, query: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)


def _check(spark: SparkSession, query: str) -> None:
    """Raise NotAQuery for a text that parses to more than a query. Expressions are looked
    through only if it has a refused name somewhere."""
    plan, thorough = _parsed(spark, query), any(n in query.lower() for n in REFUSED_FUNCTIONS)
    load = plan.getClass().getClassLoader().loadClass
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    refused = [load(f"{logical}.{name}") for name in ("Command", "ParsedStatement")]
    nested, function = load("org.apache.spark.sql.catalyst.expressions.PlanExpression"), load("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction")
    with_ = load(f"{logical}.UnresolvedWith")

    def each(sequence):
        return [sequence.apply(k) for k in range(sequence.size())]

    plans = [plan]
    while plans:
        node = plans.pop()
        if any(kind.isInstance(node) for kind in refused):
            raise NotAQuery(f"only queries may run here, not {node.nodeName()}")
        plans += each(node.children())
        if not thorough:
            continue
        if with_.isInstance(node):
            plans += [pair._2() for pair in each(node.cteRelations())]
        expressions_ = each(node.expressions())
        while expressions_:
            expression = expressions_.pop()
            if function.isInstance(expression) and {n.lower() for n in each(expression.nameParts())} & REFUSED_FUNCTIONS:
                raise NotAQuery(f"{'.'.join(each(expression.nameParts()))} may not be called here")
            if nested.isInstance(expression):
                plans.append(expression.plan())
            expressions_ += each(expression.children())


#: A text in quotes, a quoted name or a comment, in which braces mean nothing; or a name.
_PIECES = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)|\{(\w+)\}""", re.DOTALL)


def guarded_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run a query, common table expressions included, in which ``{name}`` stands for
    a DataFrame, but not in texts, quoted names and comments. Commands and writes, and
    functions that call the JVM's methods, are refused by the plan the query parses to,
    subqueries included."""
    named = {m[2] for m in _PIECES.finditer(query) if m[2]}
    lacks = named - set(tables)
    if lacks:
        raise KeyError(f"no table is given for {', '.join(sorted(lacks))}")
    views = {name: f"_guarded_{uuid.uuid4().hex}" for name in named}
    text = _PIECES.sub(lambda m: m[1] or views[m[2]], query)
    _check(spark, text)
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
