"""Streams as append-only logs of Parquet files, read with Structured Streaming."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators import scd2
from millrace.sources import files
from millrace.sources.catalog import Table


def append_log(df: DataFrame, path: str, batch: str | None = None, observed: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Add rows to a log. Those of a ``batch`` appear at once, in a folder of its own, and
    once only: a batch that is written again leaves what is there. ``observed`` gets the
    rows if they are written."""
    if batch is None:
        observed(df).write.mode("append").parquet(path)
        return
    spark, target = df.sparkSession, f"{path}/b-{batch}"
    if files.exists(spark, target):
        return
    # Readers of the log don't look into folders whose names begin with an underscore.
    written = f"{path}/_writing-{batch}"
    observed(df).write.mode("overwrite").parquet(written)
    files.rename(spark, written, target)


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a log; each query has its own place in it, kept in its
    checkpoint, so every consumer sees every row."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def log_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of what is in a log; None if it is empty or not there yet."""
    if not files.any_file(spark, path, ".parquet"):
        return None
    return spark.read.option("recursiveFileLookup", "true").parquet(path).schema


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """With an event time that watermarks accept: a zoned timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start within use the state store that state of one's own needs."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, appended to Parquet files exactly once."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def follow_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", name: str | None = None):
    """A continuously running query; the caller stops it."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every)
    return (writer.queryName(name) if name else writer).start()


def drain_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """The groups of an aggregate that each micro-batch changes, one folder per batch: a
    replayed batch replaces its own, and with a watermark neither state nor a batch's
    output grows with all groups ever seen."""
    drain_batches(df, lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/batch={k}"), checkpoint, "update")


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each group that :func:`drain_updates` has written."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch")
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def in_windows(df: DataFrame, time: str, length: str) -> DataFrame:
    """Each row with window_start, that of its tumbling window of event time."""
    return df.withColumn("window_start", F.window(F.col(time).cast("timestamp"), length)["start"])


def joined_within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, within: str) -> DataFrame:
    """Pairs of two watermarked streams with equal keys, the right one at most ``within``
    after the left; rows leave the state once the watermarks have passed that time."""
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]
    time = [F.col(f"r.{right_time}") >= F.col(f"l.{left_time}"), F.col(f"r.{right_time}") <= F.col(f"l.{left_time}") + F.expr(f"INTERVAL {within}")]
    return left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, same + time))


def drain_aggregate(df: DataFrame, path: str, checkpoint: str) -> None:
    """A complete aggregate after all there is now, as Parquet."""
    drain_batches(df, lambda rows, _: rows.write.mode("overwrite").parquet(path), checkpoint, "complete")


def tumbling(df: DataFrame, time: str, length: str, by: list[str], *aggregates) -> DataFrame:
    return sliding(df, time, length, length, by, *aggregates)


def sliding(df: DataFrame, time: str, length: str, step: str, by: list[str], *aggregates) -> DataFrame:
    grouped = df.groupBy(F.window(time, length, step), *by).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), *by, *[c for c in grouped.columns if c != "window" and c not in by])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], *aggregates) -> DataFrame:
    grouped = df.groupBy(F.session_window(time, gap), *by).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("session_start"), *by, *[c for c in grouped.columns if c != "session_window" and c not in by])


def distinct_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def drain_scd2(df: DataFrame, table: Table, dim: scd2.Dimension, checkpoint: str) -> None:
    """Apply every micro-batch to a dimension; one that is run again changes nothing."""
    drain_batches(df, lambda rows, k: table.apply_scd2(rows, dim, batch=batch_name(checkpoint, k)), checkpoint)


def batch_name(checkpoint: str, k: int) -> str:
    """A short name of a micro-batch of the query with this checkpoint."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{k}"


@dataclass(frozen=True)
class Awaited:
    """Rows of a key that may be followed by another kind within a time.

    ``opens`` and ``closes`` are values of the column ``kind``; ``within_ms`` is counted in
    event time. A row that opens is answered by the first later row that closes, at most
    that long after it; without one an alert is due at its time plus the limit.
    """

    keys: list[str]
    ident: str
    time: str
    kind: str
    opens: str
    closes: str
    within_ms: int


class _Waiting(StatefulProcessor):
    """Per bucket of keys: a list of chunks of rows, Arrow streams of keys, ids, times and
    whether they open, of which those that close stay while some open row, out of order,
    may still come before. One timer at the earliest limit of what is held tells that the
    watermark has passed it; it settles all rows whose limit the watermark has passed, for
    no answer can come for them any more."""

    def __init__(self, rule: Awaited):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "chunk binary")

    def _limit(self, at: pd.Series) -> pd.Series:
        return at // 1000 + self.rule.within_ms

    def _append(self, rows: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(rows, preserve_index=False)
        for k in range(0, table.num_rows, CHUNK):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table.slice(k, CHUNK))
            self.held.appendValue((out.getvalue().to_pybytes(),))
        # One millisecond more: a row at the limit itself still answers.
        self.handle.registerTimer(int(self._limit(rows["at"]).min()) + 1)

    def handleInputRows(self, key, rows, timerValues):
        by = [*self.rule.keys, "nulls"]
        fresh = pd.concat([part[[*by, "id", "at", "opens"]] for part in rows])
        self._append(fresh.astype({c: "int64" for c in (*by, "id", "at")}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        by, passed = [*self.rule.keys, "nulls"], timerValues.getCurrentWatermarkInMs()
        chunks = [pa.ipc.open_stream(chunk).read_all() for (chunk,) in self.held.get()]
        if not chunks:
            return
        rows = pa.concat_tables(chunks).to_pandas().sort_values(["at", "id"])
        over = self._limit(rows["at"]) < passed
        if not over.any():
            return
        due = rows[over & rows["opens"]]
        # Of rows that close at one time the one with the smallest id answers; a null key meets none.
        closed = rows[~rows["opens"] & (rows["nulls"] == 0)].drop_duplicates([*by, "at"])
        self.held.clear()
        if not over.all():
            self._append(rows[~over])
        if len(due):
            answers = closed[[*by, "at", "id"]].rename(columns={"id": "answer"}).astype({"answer": "Int64"})
            met = pd.merge_asof(due[[*by, "at", "id"]], answers, on="at", by=by, direction="forward", allow_exact_matches=False, tolerance=1000 * self.rule.within_ms)
            keys = {k: met[k].astype("Int64").mask(met["nulls"] // 2**n % 2 == 1) for n, k in enumerate(self.rule.keys)}
            yield pd.DataFrame({**keys, "opened": met["id"].astype("Int64"), "answer": met["answer"].astype("Int64")})

    def close(self) -> None:
        pass


#: Rows of a chunk of state.
CHUNK = 50_000


def awaited(df: DataFrame, rule: Awaited, buckets: int = 256) -> DataFrame:
    """(keys, opened, answer) of a watermarked stream: each row that opens, with the first
    row that closes in time, or null as an alert. Ids and keys are whole numbers.

    Only rows of the two kinds move the watermark, for Spark filters before it. State is
    kept in the state store by ``buckets`` of keys, each of which is called once a
    micro-batch, for a call costs milliseconds, however few rows it has. It goes when its
    timers have expired: a bucket holds what lies within the limit and the watermark's
    delay, in the memory of its task while it is settled. The number of buckets belongs to
    the checkpoint. Rows come out when the watermark has passed their limit; those with a
    null key as alerts.
    """
    nulls = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("long") * 2**n for n, k in enumerate(rule.keys)])
    keys = [F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in rule.keys]
    rows = df.where(F.col(rule.kind).isin(rule.opens, rule.closes)).select(F.pmod(F.xxhash64(*rule.keys), F.lit(buckets)).alias("_bucket"), *keys, nulls.alias("nulls"), F.col(rule.ident).alias("id"), F.unix_micros(rule.time).alias("at"), (F.col(rule.kind) == rule.opens).alias("opens"), F.col(rule.time).alias("_time"))
    fields = ", ".join(f"{k} long" for k in [*rule.keys, "opened", "answer"])
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=_Waiting(rule), outputStructType=fields, outputMode="append", timeMode="eventTime")
