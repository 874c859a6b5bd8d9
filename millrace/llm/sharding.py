"""Shards of nearly equal bytes from sampled splitters.

Records are ordered by a key, here a hash of the text and then the doc_id, so equal
texts lie side by side. A sample drawn with chances in proportion to size gives
quantiles of the bytes as splitters of many small ranges; the bytes of every range
are then counted exactly over all records, ranges with too much are sampled again
and split further, and runs of neighbouring ranges become the shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import discard, fresh_name, materialize

LOWEST = -(2**63)


#: A record's key: a hash of its text, its doc_id, and a number that no other record
#: has, by which even repeated rows can be told apart.
KEY = ["h", "i", "row"]


@dataclass(frozen=True)
class Splitters:
    """Ordered distinct keys; range k holds the keys from splitter k - 1 up to, but
    not including, splitter k."""

    keys: np.ndarray

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """The range of each key: the splitters that are no larger, counted by sorting
        them among the keys."""
        m = len(self.keys)
        both = np.concatenate([self.keys, keys])
        order = np.lexsort((np.arange(len(both)) >= m, both[:, 2], both[:, 1], both[:, 0]))
        out = np.empty(len(both), np.int64)
        out[order] = np.cumsum(order < m)
        return out[m:]

    def merged(self, keys: np.ndarray) -> Splitters:
        return Splitters(np.unique(np.concatenate([self.keys, keys]), axis=0))


NONE = Splitters(np.empty((0, len(KEY)), np.int64))


def _uniform(seed: int) -> Column:
    """A number in [0, 1) that only the record's key decides."""
    return F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(seed)), 11) / F.lit(float(2**53))


def _range_of(splitters: Splitters) -> Column:
    @F.pandas_udf("int")
    def located(h: pd.Series, i: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(splitters.locate(np.stack([h, i, row], axis=1)).astype(np.int32))

    return located(*KEY)


def _quantiles(sample: pd.DataFrame, parts: int) -> np.ndarray:
    """Keys that cut the sample into parts of equal weight."""
    sample = sample.sort_values(KEY)
    upto = sample["w"].cumsum().to_numpy()
    if parts < 2 or not len(upto):
        return NONE.keys
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, "left")
    return sample[KEY].to_numpy(dtype=np.int64)[np.minimum(at, len(upto) - 1)]


def choose_ranges(sized: DataFrame, ranges: int, sample_rows: int, seed: int, most: float = 1.5, rounds: int = 30) -> tuple[Splitters, pd.DataFrame]:
    """Splitters of about ``ranges`` ranges and the exact bytes and rows of each.

    ``sized`` has the columns of ``KEY`` and size. To the driver come about
    ``sample_rows`` sampled keys and one row per range. Ranges over ``most`` times the
    mean, their largest record left aside, are split again by new samples of theirs
    until none is; an error is raised if ``rounds`` don't suffice.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    if not total:
        return NONE, pd.DataFrame({"range": [], "bytes": [], "rows": []}).astype("int64")
    floor = total / sample_rows
    drawn = sized.where(_uniform(seed) < F.col("size") / F.lit(floor)).select(*KEY, F.greatest("size", F.lit(floor)).alias("w"))
    splitters = NONE.merged(_quantiles(drawn.toPandas(), ranges))
    for again in range(1, rounds + 1):
        ranged = sized.withColumn("range", _range_of(splitters))
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.sum("size") - F.max("size")).alias("besides")).toPandas().sort_values("range")
        over = stats[stats["besides"] > most * total / ranges]
        if over.empty:
            break
        share = (max(8, sample_rows / ranges) / over["besides"]).to_numpy()
        rate = F.create_map(*[F.lit(x) for pair in zip(over["range"].tolist(), share.tolist(), strict=True) for x in pair])
        inside = ranged.where(F.col("range").isin(over["range"].tolist())).withColumn("rate", rate[F.col("range")])
        drawn = inside.where(_uniform(seed + again) < F.col("size") * F.col("rate")).select("range", *KEY, F.greatest("size", 1 / F.col("rate")).alias("w")).toPandas()
        parts = dict(zip(over["range"], np.ceil(over["bytes"] * ranges / total).astype(int), strict=True))
        found = [_quantiles(rows, 2 * parts[k]) for k, rows in drawn.groupby("range")]
        splitters = splitters.merged(np.concatenate(found)) if found else splitters
    else:
        raise RuntimeError(f"{len(over)} ranges are still too large after {rounds} rounds")
    return splitters, stats


def shard_records(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 64, sample_rows: int = 32_768, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes.

    One row per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 1),
    text_crc32, law ``bytes``, shard, slot (place in the shard, gapless from 0) and a
    null grown_shard, which only laws by key have. Null texts have size 1 and the
    crc32 of nothing; null doc_ids sort first; repeated rows are rows of their own, and
    a shard's boundary may lie among them; an empty table gives no rows; other columns
    are left out, but for those in ``carry``, which come last.

    A shard misses the mean by about one range, a 64th of a shard, or by one document
    where that is larger.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce("doc_id", F.lit(LOWEST)).alias("i"), F.monotonically_increasing_id().alias("row"), *carry)
    keyed = materialize(keyed, "sharding-keys")
    splitters, stats = choose_ranges(keyed, shards * ranges_per_shard, sample_rows, seed)
    before = stats["bytes"].cumsum() - stats["bytes"]
    middle = (before + stats["bytes"] / 2) / max(1, stats["bytes"].sum())
    plan = pd.DataFrame({"range": stats["range"].astype("int32"), "shard": np.minimum((middle * shards).astype("int32"), shards - 1)})
    plan["base"] = stats["rows"].groupby(plan["shard"]).cumsum() - stats["rows"]
    small = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in plan.itertuples(index=False)], "range int, shard int, base long")
    place = Window.partitionBy("range").orderBy(*KEY)
    ranged = keyed.withColumn("range", _range_of(splitters)).join(F.broadcast(small), "range")  # one row per range, whose number is a parameter
    return ranged.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.row_number().over(place) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write every row of ``docs`` once, as one folder per shard, ordered by slot within
    it; ``options`` are those of :func:`shard_records`. Rows are met by a number of their
    own, so null and repeated doc_ids are rows like others. The columns shard and slot
    get a leading underscore where ``docs`` has such columns."""
    row, shard, slot = (fresh_name(docs, name) for name in ("_row", "shard", "slot"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "sharding-rows")
    places = shard_records(rows, carry=(row,), **options).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = rows.join(places, row).drop(row)
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    discard(rows)
