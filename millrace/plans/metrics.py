"""Run, node and log metrics as aggregations over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

MEASURES = ("pre_seconds", "function_seconds", "post_seconds")
MEMORY = ("pre_mib", "function_mib", "post_mib")


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates over its rows that the action which computes them brings
    along: no second job. Ask with :func:`observation`."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in (aggregates or {"rows": F.count(F.lit(1))}).items()]), seen


def observation(seen: Observation) -> dict:
    """What was observed, once an action has run; empty if the plan had no rows to run."""
    return dict(seen.get)


def ended(events: DataFrame) -> DataFrame:
    """Of a run's events those that end a batch: an attempt of a batch node, or a
    micro-batch of a live one. Starts, and the moment a live node goes live, are none."""
    return events.where((F.col("status").isin("success", "failed") & F.col("pre_seconds").isNotNull()) | F.col("batch").isNotNull())


def latest(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last event of each key: the state that an append-only log stands for."""
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in events.columns if c not in keys and c != time])
    return events.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def run_status(nodes: DataFrame) -> DataFrame:
    """(run_id, state, status of each node) to one status per run: failed if a node
    failed, running while the run is active, success if all nodes succeeded."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.max("state") == "active", "running").when(F.bool_and(F.col("status").isin("success", "skipped")), "success").otherwise("unknown")
    return nodes.groupBy("run_id").agg(status.alias("status"))


def run_summary(runs: DataFrame) -> DataFrame:
    """(status, started, completed) of runs to counts, success rate and durations."""
    seconds: Column = F.when(F.col("status") == "success", (F.unix_micros(F.col("completed").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6))
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "running")}
    rate = F.round(F.count_if(F.col("status") == "success") / F.nullif(F.count("*"), F.lit(0)), 3)
    return runs.agg(F.count("*").alias("total"), *counts.values(), rate.alias("success_rate"), F.round(F.avg(seconds), 2).alias("avg_seconds"), F.round(F.min(seconds), 2).alias("min_seconds"), F.round(F.max(seconds), 2).alias("max_seconds"))


def node_summary(checkpoints: DataFrame, node: str = "node_id", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Batches, sums and averages of the measures by node, slowest first; nulls are 0. Of
    an engine's events those count that end a batch, and their records are summed."""
    extra = []
    if "batch" in checkpoints.columns:
        checkpoints, extra = ended(checkpoints), [F.sum(F.coalesce("records", F.lit(0))).alias("sum_records")]
    sums = [F.round(F.sum(F.coalesce(m, F.lit(0.0))), 3).alias(f"sum_{m}") for m in measures]
    averages = [F.round(F.avg(F.coalesce(m, F.lit(0.0))), 3).alias(f"avg_{m}") for m in measures]
    total = reduce(lambda a, b: a + b, [F.col(f"sum_{m}") for m in measures])
    return checkpoints.groupBy(node).agg(F.count("*").alias("batches"), *extra, *sums, *averages).orderBy(total.desc(), node)


def filter_logs(logs: DataFrame, level: str | None = None, since=None, component: str | None = None, message: str | None = None) -> DataFrame:
    """Log rows of a level, after a moment, of a component (``*`` matches any text)."""
    out = logs
    if level is not None:
        out = out.where(F.upper("level") == level.upper())
    if since is not None:
        out = out.where(F.col("timestamp") > F.lit(since))
    if component is not None:
        out = out.where(F.col("component").like(component.replace("*", "%")))
    if message is not None:
        out = out.where(F.col("message").like(message.replace("*", "%")))
    return out
