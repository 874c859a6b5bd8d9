"""Slowly changing dimensions of type 2 as one set-based plan.

A batch is deduplicated and ranked within each key by its event time. All but the
latest version of a key become history; the latest replaces the target's current row
when a tracked column differs, and is new when the key has no current row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """keys and event_time name columns of the batch; tracked are the columns whose
    change makes a new version (by default all but keys and the interval's columns).

    null_safe counts a change from or to null; reject_late ignores a latest version
    older than the current row's begin; contiguous ends the current row at the
    batch's earliest version of its key instead of the latest.
    """

    keys: list[str]
    event_time: str
    begin: str = "begin_date"
    end: str = "end_date"
    current: str = "is_current"
    tracked: list[str] | None = None
    null_safe: bool = False
    reject_late: bool = False
    contiguous: bool = False
    columns: list[str] = field(default_factory=list)

    def of(self, batch: DataFrame) -> Dimension:
        """With the batch's columns filled in, and checked."""
        columns = self.columns or batch.columns
        missing = [c for c in [*self.keys, self.event_time] if c not in columns]
        if missing or not self.keys:
            raise ValueError(f"the batch has no {missing or 'keys'}")
        tracked = self.tracked if self.tracked is not None else [c for c in columns if c not in (*self.keys, self.begin, self.end, self.current)]
        return Dimension(self.keys, self.event_time, self.begin, self.end, self.current, tracked, self.null_safe, self.reject_late, self.contiguous, list(columns))

    def changed(self, old: str, new: str) -> Column:
        differs = [(~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))) if self.null_safe else F.col(f"{new}.{c}") != F.col(f"{old}.{c}") for c in self.tracked]
        return F.coalesce(reduce(lambda a, b: a | b, differs, F.lit(False)), F.lit(False))

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.columns, self.begin, self.end, self.current]))


def rank_batch(batch: DataFrame, dim: Dimension) -> DataFrame:
    """Distinct rows with _rank (1 is the latest), _next (the event time of the next
    later version) and _first (the earliest). Equal event times are ordered by the
    remaining columns. One exchange by key serves the distinct and the window."""
    dim = dim.of(batch)
    rows = batch.select(*dim.columns).repartition(*[F.col(k) for k in dim.keys]).distinct()
    rest = [F.col(c).asc_nulls_last() for c in dim.columns if c not in dim.keys and c != dim.event_time]
    latest = Window.partitionBy(*dim.keys).orderBy(F.col(dim.event_time).desc_nulls_last(), *rest)
    whole = Window.partitionBy(*dim.keys)
    return rows.select("*", F.row_number().over(latest).alias("_rank"), F.lag(dim.event_time).over(latest).alias("_next"), F.min(dim.event_time).over(whole).alias("_first"))


def _version(ranked: DataFrame, dim: Dimension, end: Column, current: bool) -> DataFrame:
    values = {**{c: F.col(c) for c in dim.columns}, dim.begin: F.col(dim.event_time), dim.end: end, dim.current: F.lit(current)}
    return ranked.select(*[values[c].alias(c) for c in dim.names])


def historical(target: DataFrame, ranked: DataFrame, dim: Dimension) -> DataFrame:
    """All but the latest versions, unless the target has the key from that time on."""
    older = ranked.where("_rank > 1").alias("s")
    known = target.select(*dim.keys, dim.begin).alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in dim.keys])
    fresh = older.join(known, same & (F.col(f"t.{dim.begin}") == F.col(f"s.{dim.event_time}")), "left_anti")
    return _version(fresh, dim, F.col("_next"), False)


def changed_rows(target: DataFrame, ranked: DataFrame, dim: Dimension) -> DataFrame:
    """Latest versions whose key has a current row that differs in a tracked column."""
    current, latest = target.where(F.col(dim.current)).alias("t"), ranked.where("_rank = 1").alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in dim.keys])
    return latest.join(current, same).where(dim.changed("t", "s")).select("s.*")


def expire(current: DataFrame, ranked: DataFrame, dim: Dimension) -> DataFrame:
    """The current rows, those that the batch replaces ended and not current."""
    latest = ranked.where("_rank = 1").alias("s")
    rows = current.alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in dim.keys])
    replaced = F.col("s._rank").isNotNull() & dim.changed("t", "s")
    if dim.reject_late:
        replaced = replaced & F.coalesce(F.col(f"s.{dim.event_time}") >= F.col(f"t.{dim.begin}"), F.lit(False))
    ended = F.col("s._first") if dim.contiguous else F.col(f"s.{dim.event_time}")
    values = {c: F.col(f"t.{c}") for c in current.columns}
    values[dim.end] = F.when(replaced, ended).otherwise(values[dim.end])
    values[dim.current] = F.when(replaced, F.lit(False)).otherwise(values[dim.current])
    return rows.join(latest, same, "left").select(*[values[c].alias(c) for c in current.columns])


def new_current(expired: DataFrame, ranked: DataFrame, dim: Dimension) -> DataFrame:
    """Latest versions of keys without a current row after expiry."""
    latest = ranked.where("_rank = 1").alias("s")
    still = expired.where(F.col(dim.current)).select(*dim.keys).alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in dim.keys])
    return _version(latest.join(still, same, "left_anti"), dim, F.lit(None), True)


def rewritten(target: DataFrame, batch: DataFrame, dim: Dimension) -> DataFrame:
    """The rows that a batch makes or touches: the target's current rows, ended where the
    batch replaces them, and the batch's new versions, historical and current.

    Each key's latest version meets the list of the key's current rows in one full outer
    join, which gives both the rows that stay or end and the new one, which goes in if
    none of them stays. Of the target's history only keys and begins are read, to leave
    out versions it has.
    """
    dim = dim.of(batch)
    types = dict(target.dtypes)
    batch = batch.withColumn(dim.event_time, F.col(dim.event_time).try_cast(types[dim.begin])) if dict(batch.dtypes)[dim.event_time] != types[dim.begin] else batch
    ranked = rank_batch(batch, dim)
    now = F.coalesce(F.col(dim.current), F.lit(False))
    current = target.where(now)
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in dim.keys])

    # A key's current rows come as a list, which appends may have made longer than one.
    # Rows with a null among their keys meet nothing.
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in dim.keys])
    held = current.where(keyed).groupBy(*dim.keys).agg(F.collect_list(F.struct(*target.columns)).alias("_rows")).alias("t")
    met = ranked.where("_rank = 1").withColumn("_is", F.lit(True)).alias("s").join(held, same, "full")
    fresh, rows, time = F.coalesce(F.col("s._is"), F.lit(False)), F.col("t._rows"), F.col(f"s.{dim.event_time}")

    def ends(row: Column) -> Column:
        differs = [~F.col(f"s.{c}").eqNullSafe(row[c]) if dim.null_safe else F.col(f"s.{c}") != row[c] for c in dim.tracked]
        out = F.coalesce(reduce(lambda a, b: a | b, differs, F.lit(False)), F.lit(False))
        return fresh & out & F.coalesce(time >= row[dim.begin], F.lit(False)) if dim.reject_late else fresh & out

    struct = lambda values: F.struct(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in target.columns])
    ended = F.col("s._first") if dim.contiguous else time

    def kept(row: Column) -> Column:
        changes = {dim.end: F.when(ends(row), ended.cast(types[dim.end])).otherwise(row[dim.end]), dim.current: F.when(ends(row), F.lit(False)).otherwise(row[dim.current])}
        return struct({c: row[c] for c in target.columns} | changes)

    new = struct({c: F.col(f"s.{c}") for c in dim.columns} | {dim.begin: time, dim.end: F.lit(None), dim.current: F.lit(True)})
    none = F.array().cast(f"array<{target.select(F.struct('*').alias('r')).schema[0].dataType.simpleString()}>")
    stays = F.coalesce(F.exists(rows, lambda r: ~ends(r)), F.lit(False))
    out = F.concat(F.coalesce(F.transform(rows, kept), none), F.when(fresh & ~stays, F.array(new)).otherwise(none))
    latest = met.select(F.explode(out).alias("row")).select("row.*").unionByName(current.where(~keyed))
    older = historical(target, ranked, dim)
    return latest.unionByName(older.select(*[(F.col(c) if c in older.columns else F.lit(None)).cast(types[c]).alias(c) for c in target.columns]))


def apply_batch(target: DataFrame, batch: DataFrame, dim: Dimension) -> DataFrame:
    """The whole target after the batch. Applying a batch twice changes nothing more,
    except for rows whose key or event time is null, which never match."""
    past = target.where(~F.coalesce(F.col(dim.current), F.lit(False)))
    return past.unionByName(rewritten(target, batch, dim))


def at_time(target: DataFrame, dim: Dimension, moment: Column) -> DataFrame:
    """The versions that hold at a moment."""
    return target.where((F.col(dim.begin) <= moment) & (F.col(dim.end).isNull() | (F.col(dim.end) > moment)))


def empty_target(batch: DataFrame, dim: Dimension) -> DataFrame:
    """A target without rows for batches of this shape."""
    dim = dim.of(batch)
    kind = dict(batch.dtypes)[dim.event_time]
    extra = {dim.begin: F.lit(None).cast(kind), dim.end: F.lit(None).cast(kind), dim.current: F.lit(None).cast("boolean")}
    return batch.select(*[extra.get(c, F.col(c) if c in batch.columns else None).alias(c) for c in dim.names]).limit(0)
