"""Mixing sources to target weights with a splitting tree of block quotas.

Every source is a stream: its documents in an order that a hash decides, repeated as
often as its target needs. The stream is cut into blocks of equal numbers of words. A
binary tree over the output shards splits the vector of block quotas: at each node the
left half draws its share from the multivariate hypergeometric distribution, so that
every quota is met exactly and no shard depends on another. Each source's blocks, in
the order of a seeded permutation, are then dealt to the shards by those quotas, and each
shard is shuffled by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import fresh_name, materialize
from millrace.llm.quality import words_of

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Parts into which a number of their own deals rows alike in source, doc_id and size.
SALTS = 256
#: Sources whose quotas are drawn together in a task.
GROUP_SOURCES = 4096
#: Blocks of all sources; numpy's draws take fewer than 10^9.
MOST_BLOCKS = 500_000_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, rank, source_size and target.

    Sources rank by code point, null last, and weigh ``weights`` in turn; together the
    targets are all words. With sources ordered by the share at which they reach
    ``most`` times their size, those before the first that stays below are capped and
    it and those after share what remains by weight. Sources are ranked in ranges. The
    share is found over kinds of sources, alike in size and weight: n words have fewer
    than sqrt(2 n) sizes of sources, so kinds are few however many sources there are.
    """
    by_name = F.col("source").asc_nulls_last()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(sizes.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "mixing-sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranged.join(parts, "part").select("source", "source_size", rank.alias("rank")).withColumn("weight", weight)

    cap = F.lit(float(most)) * F.col("source_size")
    kinds = weighed.groupBy("source_size", "weight").agg(F.count("*").alias("n"))
    order = Window.orderBy(cap / F.col("weight"), "weight")
    total = F.sum(F.col("source_size") * F.col("n")).over(Window.partitionBy()).cast("double")
    before = F.coalesce(F.sum(cap * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum(F.col("weight") * F.col("n")).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = kinds.withColumn("share", (total - before) / weights_left).where(cap > F.col("share") * F.col("weight"))
    share = free.agg(F.min_by("share", F.struct(cap / F.col("weight"), "weight"))).first()[0]
    target = cap if share is None else F.least(cap, F.lit(share) * F.col("weight"))
    return weighed.select("source", "rank", "source_size", target.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None, group: int = 0) -> np.ndarray:
    """Blocks of each source for each shard: (shards, sources), columns exactly the
    quotas, rows in sum ``totals``, or else nearly equal. A ``group`` of sources has
    draws of its own."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    if totals is None:
        totals = np.diff(np.arange(shards + 1) * int(quotas.sum()) // shards)

    def split(left: int, right: int, total: np.ndarray) -> None:
        if right - left == 1:
            out[left] = total
            return
        middle = (left + right) // 2
        rng = np.random.default_rng([seed, group, left, right])
        part = rng.multivariate_hypergeometric(total, int(totals[left:middle].sum()), method="marginals") if total.any() else total
        split(left, middle, part)
        split(middle, right, total - part)

    split(0, shards, quotas.astype(np.int64))
    return out


def source_quotas(targets: DataFrame, shards: int, block_words: int, seed: int) -> tuple[DataFrame, int]:
    """Of each source its words (the target, rounded), blocks, and upto (blocks in each
    shard and those before it), with source, source_size and target; and the words of
    a block, which are more than ``block_words`` where there would be more than
    ``MOST_BLOCKS`` blocks.

    The tree is split over groups of sources first: the driver draws the quotas of the
    groups, and a task those of the sources of a group, given the group's. Together
    that is one multivariate hypergeometric draw over all sources. The driver holds 8
    bytes a shard for each ``GROUP_SOURCES`` sources.
    """
    worded = targets.withColumn("words", F.rint("target").cast("long"))
    block_words = max(block_words, -(-(worded.agg(F.sum("words")).first()[0] or 0) // MOST_BLOCKS))
    blocks = F.expr(f"(words + {block_words - 1}L) div {block_words}L")
    grouped = worded.withColumn("blocks", blocks).withColumn("group", F.expr(f"(rank - 1) div {GROUP_SOURCES}"))
    totals = grouped.groupBy("group").agg(F.sum("blocks").alias("blocks")).orderBy("group").toPandas()
    shares = split_quotas(totals["blocks"].to_numpy(np.int64), shards, seed)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        group = int(rows["group"].iloc[0])
        drawn = split_quotas(rows["blocks"].to_numpy(), shards, seed, shares[:, group], group + 1)
        return rows.assign(upto=list(np.cumsum(drawn, axis=0).T))

    return grouped.groupBy("group").applyInPandas(draw, grouped.schema.simpleString()[7:-1] + ",upto:array<bigint>").drop("rank", "group"), block_words


def permuted(places: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """Each of 0 to n - 1 at its place in a permutation of them that the seed and n
    decide: a Feistel network over the next power of four, walked until it ends below n.
    Nothing of the size of n is held."""
    out, todo = places.astype(np.uint64), np.arange(len(places))
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in n.tolist()], dtype=np.uint64)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 4).astype(np.uint64)
    while len(todo):
        x, bits, limit = out[todo], half[todo], n[todo].astype(np.uint64)
        mask = (np.uint64(1) << bits) - np.uint64(1)
        left, right = x >> bits, x & mask
        for key in keys:
            mixed = (right + key + limit) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= limit]
    return out.astype(np.int64)


PLACED = "array<struct<epoch:int,words:long,shard:int,place:long>>"


def mix_sources(docs: DataFrame, shards: int = 64, block_words: int = 4096, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document, and where it puts it.

    One row per row of ``docs``: doc_id, size (words of the text), source_size, target
    (its source's), and placements, one struct per copy that the mix takes: epoch,
    words (all of the document, but for the one document at which its source's target
    is reached), shard and place (the order within the shard).

    Null texts have no words, and documents without words no placements; a null source
    is a source of its own, the last; repeated rows are documents of their own; an
    empty table gives no rows; other columns are left out, but for those in ``carry``,
    which come last. A source's stream is in the order of a hash of doc_id, then of
    sizes; which of several rows alike in both comes first is left to a stored number
    of the row. Words before a document are sums over 4096 hash ranges of its source,
    over the kinds of rows (alike in doc_id and size, in ``SALTS`` parts) of the range,
    and over the rows of the kind, so neither a source nor a doc_id that very many rows
    share, nor their having none, is one task's.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *carry), "mixing-sizes")
    drawn, block_words = source_quotas(materialize(source_targets(sized, weights, most), "mixing-targets"), shards, block_words, seed)
    # A name for every source, null included, that joins can take.
    stream = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("stream")
    drawn = materialize(drawn.select(stream, "source_size", "target", "words", "blocks", "upto"), "mixing-quotas")

    alike = ["stream", "key", "size", "salt"]
    rows = sized.select("*", stream, F.substring("key", 1, 3).alias("range"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    sums = rows.groupBy("stream", "range").agg(F.sum("size").alias("all"))
    earlier = Window.partitionBy("stream").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stream", "range", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    kinds = rows.groupBy(*alike, "range").agg(F.sum("size").alias("all"))
    within = Window.partitionBy("stream", "range").orderBy("key", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("within", F.coalesce(F.sum("all").over(within), F.lit(0))).join(sums, ["stream", "range"])
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("row")) - 1
    numbered = rows.drop("range").withColumn("nth", nth).join(kinds.select(*alike, (F.col("base") + F.col("within")).alias("first")), alike)
    streamed = numbered.withColumn("before", F.col("first") + F.col("nth") * F.col("size")).join(drawn, "stream")

    @F.pandas_udf(PLACED)
    def placed(before: pd.Series, size: pd.Series, whole: pd.Series, key: pd.Series, words: pd.Series, blocks: pd.Series, upto: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(size))]
        start, n, whole, words, blocks = (x.to_numpy() for x in (before, size, whole, words, blocks))
        mixed = key.str.slice(3, 15).map(lambda x: int(x, 16)).to_numpy(dtype=np.int64) if len(key) else np.empty(0, np.int64)
        for epoch in range(most):
            first = start + epoch * whole
            taken = np.clip(words - first, 0, n)
            chosen = np.flatnonzero(taken)
            # The block in which a copy begins, at its drawn place among its source's blocks.
            slots = permuted(first[chosen] // block_words, blocks[chosen], seed)
            for k, slot in zip(chosen.tolist(), slots.tolist(), strict=True):
                shard = int(np.searchsorted(upto.iat[k], slot, "right"))
                place = (int(mixed[k]) * 2654435761 + slot * 40503 + epoch * 97) % (1 << 61)
                out[k].append({"epoch": epoch, "words": int(taken[k]), "shard": shard, "place": place})
        return pd.Series(out)

    placements = placed("before", "size", "source_size", "key", "words", "blocks", "upto").alias("placements")
    return streamed.select("doc_id", "size", "source_size", "target", placements, *carry)


def taken_words(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words of all placements), copies,
    and shards and places of the copies, in the order of their epochs."""
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("placements").alias("copies"), F.col("placements.shard").alias("shards"), F.col("placements.place").alias("places"))


def mixed_copies(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """The copies of the rows of ``docs`` that the mix takes, with the mix's place of
    each as a struct column whose name comes second. Rows are met by a number of their
    own, so null and repeated doc_ids do no harm. ``options`` are those of
    :func:`mix_sources`."""
    row, copy = fresh_name(docs, "_row"), fresh_name(docs, "_copy")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-rows")
    placed = mix_sources(rows, carry=(row,), **options).select(row, F.explode("placements").alias(copy))
    copies = rows.join(placed, row)
    words, taken = words_of(F.col("text")), F.col(copy)["words"]
    cut = F.when(taken < F.size(words), F.array_join(F.slice(words, F.lit(1), taken.cast("int")), " ")).otherwise(F.col("text"))
    return copies.withColumn("text", cut).drop(row), copy


def in_order(copies: DataFrame, copy: str) -> DataFrame:
    """Ranges of shards, each in its shuffled order."""
    order = [F.col(copy)["shard"], F.col(copy)["place"]]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the copies of the documents that the mix takes, one folder per shard, each
    in its shuffled order."""
    copies, copy = mixed_copies(docs, **options)
    shard = fresh_name(docs, "shard")
    in_order(copies, copy).withColumn(shard, F.col(copy)["shard"]).drop(copy).write.partitionBy(shard).parquet(path)


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 11) -> str:
    """doc_id, size, source_size, target and taken of :func:`taken_words` over
    ``documents`` in DuckDB SQL, which has no draws for shards and places."""
    weight = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes
), weighed AS (
  SELECT *, CASE (rank - 1) % {len(weights)} {weight} END AS weight, {float(most)} * source_size AS cap FROM ranked
), shared AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed
), free AS (
  SELECT arg_min(share, struct_pack(r := cap / weight, k := rank)) AS share FROM shared WHERE cap > share * weight
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT share FROM free) * weight, cap)) AS target FROM shared
), streamed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST({" + ".join(f"greatest(0, least(size, round_even(target, 0) - before - {k} * source_size))" for k in range(most))} AS BIGINT) AS taken
FROM streamed"""
