"""Joins that SQL in Spark has no syntax for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import scratch_path


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], allow_equal: bool = True, slice_seconds: float | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before
    its time (before it, unless ``allow_equal``); of several at that time, with the
    largest values. Rows with a null in their key or time meet nothing.

    Both sides are united and ordered by time within the key, and the last right row
    is carried forward: one exchange, and no pair of rows that doesn't match. With
    ``slice_seconds``, keys with more than ``hot_rows`` rows are cut into slices of that
    length, each ordered by a task of its own; what a slice begins with is the last right
    row of the slices before it, of which there is one row each.
    """
    kept = F.struct(*[F.col(v) for v in values])
    ident = lambda time: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, time]])
    rows = left.where(ident(left_time)).select(*by, F.col(left_time).alias("_time"), F.lit(1 if allow_equal else 0).alias("_side"), F.struct("*").alias("_left"), F.lit(None).alias("_right"))
    marks = right.where(ident(right_time)).select(*by, F.col(right_time).alias("_time"), F.lit(0 if allow_equal else 1).alias("_side"), F.lit(None).alias("_left"), kept.alias("_right"))
    both, part = rows.unionByName(marks), [*by]
    if slice_seconds is not None:
        hot = both.groupBy(*by).count().where(F.col("count") > hot_rows).select(*by, F.lit(True).alias("_hot"))
        number = F.floor(F.unix_micros(F.col("_time").cast("timestamp")) / F.lit(slice_seconds * 1e6)).cast("long")
        both = both.join(hot, by, "left").withColumn("_slice", F.when(F.col("_hot"), number)).drop("_hot")
        part = [*by, "_slice"]
    order = Window.partitionBy(*part).orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where("_left IS NOT NULL")
    if slice_seconds is not None:
        ends = both.where("_slice IS NOT NULL").groupBy(*part).agg(F.max(F.when(F.col("_right").isNotNull(), F.struct("_time", "_right"))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.select(*part, F.last("_end", ignorenulls=True).over(before)["_right"].alias("_begin"))
        carried = carried.join(begins, part, "left").withColumn("_last", F.coalesce("_last", "_begin"))
    found = carried.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])
    types = {f.name: f.dataType for f in right.schema.fields}
    return found.unionByName(left.where(~ident(left_time)).select("*", *[F.lit(None).cast(types[v]).alias(v) for v in values]))


def nearest(value: Column, lookup: list[tuple[str, float]]) -> Column:
    """The name of the lookup entry nearest to ``value``, the first of equals: a
    literal table is part of the expression, so there is no join."""
    best = [F.struct(F.abs(value - F.lit(float(at))).alias("distance"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, at) in enumerate(lookup)]
    return F.least(*best)["name"] if len(best) > 1 else best[0]["name"]


def nearest_point(x: Column, y: Column, lookup: list[tuple[str, float, float]]) -> Column:
    """The name of the lookup point with the least squared distance to (x, y), the first
    of equals; null where x or y is."""
    best = [F.struct(((x - F.lit(float(a))) * (x - F.lit(float(a))) + (y - F.lit(float(b))) * (y - F.lit(float(b)))).alias("distance"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, a, b) in enumerate(lookup)]
    found = F.least(*best)["name"] if len(best) > 1 else best[0]["name"]
    return F.when(x.isNotNull() & y.isNotNull(), found)


#: Each level's buckets are so many times as wide as those of the level below.
STEP = 8


def _level(length: Column, width: float) -> Column:
    """The first level whose buckets are at least as wide as an interval is long."""
    ratio = F.greatest(length.cast("double") / F.lit(float(width)), F.lit(1.0))
    return F.ceil(F.round(F.log(float(STEP), ratio), 9)).cast("int")


def _levels(df: DataFrame, low: Column, high: Column, width: float) -> list[int]:
    """The levels that intervals have; a few dozens at most, for lengths are numbers."""
    found = df.where((low <= high)).select(_level(high - low, width).alias("level")).distinct().collect()
    return sorted(r.level for r in found if r.level is not None)


def _spans(low: Column, high: Column, level: Column, width: float) -> Column:
    """(level, bucket) of the buckets of a level that an interval no longer than they are
    wide touches: one or two."""
    wide = F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)
    first, last = F.floor(low / wide).cast("long"), F.floor(high / wide).cast("long")
    return F.transform(F.sequence(first, F.least(last, first + 1)), lambda bucket: F.struct(level.alias("level"), bucket.alias("bucket")))


def _placed(df: DataFrame, low: Column, high: Column, width: float, above: list[int], own: bool) -> DataFrame:
    """Rows with _at (level, bucket): the buckets of their own level (``own``), and those
    of the levels ``above`` that are higher."""
    mine = _level(high - low, width)
    parts = [_spans(low, high, mine, width)] if own else []
    parts += [F.when(F.lit(n) > mine, _spans(low, high, F.lit(n), width)).otherwise(F.array().cast("array<struct<level:int,bucket:bigint>>")) for n in above]
    return df.where(low <= high).withColumn("_at", F.explode(F.concat(*parts) if parts else F.array().cast("array<struct<level:int,bucket:bigint>>")))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals [low, high] have a moment in common, and whose ``by``
    columns are equal; numbers or timestamps. Right columns named as left ones, but for
    ``by``, come twice, so name them apart.

    Buckets have several widths, each ``STEP`` times the last. A row lies in the one or
    two buckets of the first width that isn't less than its length, and asks at the wider
    ones that rows of the other side lie in. So a row is copied a bounded number of times
    whatever its length, and a pair meets where the longer of its two rows lies; of two
    such buckets that with the later of the two lows counts. Rows with a null bound, or
    whose low is above their high, meet nothing.
    """
    by = by or []

    def numbered(df: DataFrame, span: tuple[str, str], side: str) -> tuple[DataFrame, Column, Column]:
        low, high = (F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c).cast("double") for c in span)
        made = df.withColumn(f"_{side}low", low).withColumn(f"_{side}high", high)
        return made, F.col(f"_{side}low"), F.col(f"_{side}high")

    a, a_low, a_high = numbered(left, left_span, "l")
    b, b_low, b_high = numbered(right, right_span, "r")
    levels_a, levels_b = _levels(a, a_low, a_high, width), _levels(b, b_low, b_high, width)
    homes_b = _placed(b, b_low, b_high, width, [], True)
    # Where the right row is at least as long, and where the left one is longer.
    first = _placed(a, a_low, a_high, width, levels_b, True).join(homes_b, [*by, "_at"])
    second = _placed(a, a_low, a_high, width, [], True).join(_placed(b, b_low, b_high, width, levels_a, False), [*by, "_at"])
    wide = F.lit(float(width)) * F.pow(F.lit(float(STEP)), F.col("_at.level"))
    meet = (a_low <= b_high) & (b_low <= a_high) & (F.floor(F.greatest(a_low, b_low) / wide) == F.col("_at.bucket"))
    return first.unionByName(second).where(meet).drop("_at", "_llow", "_lhigh", "_rlow", "_rhigh")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high. As in :func:`interval_join`, a range lies in one or
    two buckets of a width that its length decides; a point asks at each width that there
    is, so it meets a range once."""
    numbers = ranges.where(F.col(low) <= F.col(high))
    first, last = F.col(low).cast("double"), F.col(high).cast("double")
    spread = numbers.withColumn("_at", F.explode(_spans(first, last, _level(last - first, width), width)))
    at = lambda n: F.struct(F.lit(n).alias("level"), F.floor(F.col(point) / F.lit(width * STEP**n)).cast("long").alias("bucket"))
    levels = _levels(ranges, first, last, width)
    asking = F.explode(F.array(*[at(n) for n in levels])) if len(levels) != 1 else at(levels[0])
    met = points.withColumn("_at", asking if levels else F.lit(None).cast("struct<level:int,bucket:bigint>")).join(spread, "_at")
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_at")


#: Right points in the cell of one, itself included, on average; and the least width of a
#: cell as a share of the longest way: numbers of cells stay exact in doubles.
CROWD, FINEST = 4, 2.0**-48


def nearest_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], key: str, cell: float) -> DataFrame:
    """Each left row with the ``key`` of the right row nearest to its point, the smallest
    of several, and the squared distance; nulls for a point with a null coordinate, or if
    there is no right point.

    Points lie in the cells of a grid. A round looks at the nine cells around each point;
    one that finds a right point no farther than a cell is wide is done, for none outside
    can be nearer. Cells are doubled for the others, so rounds grow with the logarithm of
    the longest way, and each has fewer points. Only different points are looked up, and
    their number goes to the driver. Right points that share a cell are all compared with
    the left ones around it, so ``cell`` is halved first until a right point shares its
    cell with ``CROWD`` at most, on average over the points: dense places decide, and pairs
    grow with the points. Left points that lie apart from a dense place, but nearer to it
    than to anything else, still meet all of it.
    """
    spark, width = left.sparkSession, float(cell)
    x, y = (F.col(c).cast("double") for c in left_at)
    places = left.where(x.isNotNull() & y.isNotNull()).select(x.alias("_x"), y.alias("_y")).distinct()
    u, v = (F.col(c).cast("double") for c in right_at)
    there = right.where(u.isNotNull() & v.isNotNull()).select(u.alias("_u"), v.alias("_v"), F.col(key).alias("_key"))
    there = there.groupBy("_u", "_v").agg(F.min("_key").alias("_key"))
    bounds = there.agg(F.min("_u"), F.max("_u"), F.min("_v"), F.max("_v")).first()
    todo, found = places, []
    if bounds[0] is not None:
        low = places.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
        edges = [z for z in (*bounds, *low) if z is not None]
        reach = 2 * max(map(abs, edges)) + width
        cell_of = lambda c, step: F.floor(F.col(c) / F.lit(step)).cast("long")
        spot = scratch_path(spark, "nearest-points")
        there.write.parquet(spot)
        there = spark.read.parquet(spot)
        while width > reach * FINEST:
            held = there.groupBy(cell_of("_u", width), cell_of("_v", width)).count().agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count"))
            if held.first()[0] <= CROWD:
                break
            width /= 2
        while True:
            around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            probes = todo.withColumn("_d", F.explode(around)).select("_x", "_y", (cell_of("_x", width) + F.col("_d.i")).alias("_i"), (cell_of("_y", width) + F.col("_d.j")).alias("_j"))
            met = probes.join(there.withColumn("_i", cell_of("_u", width)).withColumn("_j", cell_of("_v", width)), ["_i", "_j"])
            dx, dy = F.col("_x") - F.col("_u"), F.col("_y") - F.col("_v")
            best = met.groupBy("_x", "_y").agg(F.min(F.struct((dx * dx + dy * dy).alias("distance"), F.col("_key").alias("key"))).alias("_best"))
            path = scratch_path(spark, "nearest")
            last = width >= reach
            done = F.lit(True) if last else F.coalesce(F.sqrt(F.col("_best.distance")) <= F.lit(width), F.lit(False))
            todo.join(best, ["_x", "_y"], "left").withColumn("_done", done).write.parquet(path)
            state = spark.read.parquet(path)
            found.append(state.where("_done").select("_x", "_y", "_best"))
            todo = state.where("NOT _done").select("_x", "_y")
            if last or todo.isEmpty():
                break
            width *= 2
    out = {f.name: f.dataType for f in right.schema.fields}[key]
    kinds = f"struct<distance:double,key:{out.simpleString()}>"
    solved = reduce(DataFrame.unionByName, found) if found else places.limit(0).select("_x", "_y", F.lit(None).cast(kinds).alias("_best"))
    joined = left.withColumn("_x", x).withColumn("_y", y).join(solved, ["_x", "_y"], "left")
    return joined.select(*left.columns, F.col("_best.key").alias(key), F.col("_best.distance").alias("distance"))
