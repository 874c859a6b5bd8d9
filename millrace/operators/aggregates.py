"""Aggregates that are combined before rows are shuffled, and merged from stored parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_in_parts(df: DataFrame, keys: list[str], state: str, merge: Callable[[pa.Table], pa.Table], finish: Callable[[pa.Table], pa.Table], result: str, most: int = 1 << 20) -> DataFrame:
    """An aggregate of one's own over Arrow tables.

    ``df`` has ``keys`` and the columns of a state; ``state`` and ``result`` are schemas
    without the keys. ``merge`` takes rows of states and gives fewer that mean the same,
    for all keys at once; each task merges its rows before they are shuffled, as often as
    ``most`` of them have gathered, so a group that most rows belong to arrives as a few
    rows of each task. ``finish`` takes the merged states of one group and gives its rows,
    without the keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                merged = merge(pa.Table.from_batches(held))
                held, rows = merged.to_batches(), merged.num_rows
                if rows > most // 2:  # merging no longer makes them few
                    yield from held
                    held, rows = [], 0
        if held:
            yield from merge(pa.Table.from_batches(held)).to_batches()

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        out = finish(merge(table).drop_columns(keys))
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            out = out.add_column(0, name, pa.array([value.as_py()] * out.num_rows, value.type))
        return out

    partial = df.mapInArrow(parts, f"{named}, {state}")
    return partial.groupBy(*keys).applyInArrow(whole, f"{named}, {result}")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value of each group at which the weights of it and those below reach
    half of all weights; exact. ``weight`` is a whole number; rows with a null value or
    weight don't count. A state is a row per different value."""

    def merge(table: pa.Table) -> pa.Table:
        summed = table.group_by([*keys, "value"]).aggregate([("weight", "sum")])
        return summed.rename_columns([*keys, "value", "weight"]).select(table.column_names)

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("value")
        weights = table["weight"].to_pylist()
        total, reached = sum(weights), 0
        for k, n in enumerate(weights):
            reached += n
            if 2 * reached >= total:
                return pa.table({"median": table["value"].slice(k, 1), "total": pa.array([total], pa.int64())})
        return pa.table({"median": table["value"].slice(0, 0), "total": pa.array([], pa.int64())})

    kind = dict(df.dtypes)[value]
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(*keys, F.col(value).alias("value"), F.col(weight).cast("long").alias("weight"))
    return aggregate_in_parts(rows, keys, f"value {kind}, weight long", merge, finish, f"median {kind}, total long")


def sketched(df: DataFrame, keys: list[str], column: str, measure: str, lg_k: int = 12) -> DataFrame:
    """A row per group that can be stored and merged: ``distinct``, a HyperLogLog sketch of
    a column, ``spread``, a quantile sketch of a measure, and the number of rows."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("distinct"), F.kll_sketch_agg_double(F.col(measure).cast("double")).alias("spread"), F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups, or of several batches, merged to those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread").alias("spread"), F.sum("n").alias("n"))


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("distinct")


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("spread", F.lit(share))


#: Three standard errors of a HyperLogLog sketch of 2^12 registers.
BOUND = 3 * 1.04 / 2**6


def distinct_rollup(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Exact distinct counts of a whole number from 0 on, by ROLLUP of ``keys``.

    Rows become bit maps once, by the finest groups; the grouping sets are of bit maps,
    which are joined by OR, so no base row is expanded. Nulls don't count.
    """
    places = df.where(F.col(column).isNotNull()).select(*keys, F.bitmap_bucket_number(F.col(column)).alias("_bucket"), F.bitmap_bit_position(F.col(column)).alias("_bit"))
    maps = places.groupBy(*keys, "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    level = F.grouping_id().alias("_level")
    # Buckets are no part of the rollup: each set has them all.
    sets = [keys[:n] for n in range(len(keys), -1, -1)]
    rolled = maps.groupingSets([[*[F.col(k) for k in s], F.col("_bucket")] for s in sets], *[F.col(k) for k in keys], F.col("_bucket")).agg(F.bitmap_or_agg("_map").alias("_map"), level)
    return rolled.groupBy(*keys, "_level").agg(F.sum(F.bitmap_count("_map")).alias("distinct")).drop("_level")
