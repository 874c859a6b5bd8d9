"""Exact Jaccard join of documents on word shingles in metric space.

The space is that of shingle sets under the size of their symmetric difference. Two
sets are linked at similarity t when that distance is at most
(|x| + |y|) * (1 - t) / (1 + t). The steps:

1. Equal sets are one class, named by its smallest doc_id.
2. Regions. A class lies in a region for each shingle of its prefix: the first
   |x| - ceil(t |x|) + 1 of its shingles in a fixed order of all shingles. Linked
   classes share a region whatever the order; ordering shingles that many prefixes
   share after all others keeps texts apart that share no more than a passage.
3. Pivots. Each region has a pivot, the most central of its classes, and it is settled
   which classes of the region lie within the threshold of it. Classes within the threshold of their pivot
   form its core, and are one component already.
4. Windows. Distances from 128 pivot sets (more for large sets), which split all
   shingles by hash, bound the distance of two classes from below by the triangle
   inequality; only pairs within the threshold by this bound have their sets compared.
5. Blocks, in place of recursion. Regions that hold more than one component are joined
   once more, all pairs but those inside a component and without new pivots; regions of
   more than ``block`` classes are split into blocks, and pairs of blocks joined, each
   in its own group.

Voronoi cells of whole documents, the usual form of this join, don't serve at a
threshold of 0.8: nearly all documents are at distance 1 from every pivot but their
own copies, so that the windows would copy them into every cell. See the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace, apart, discard, releasing, slices, split_words

PIVOT_SETS = 128
#: Odd 64-bit factors of the words of a shingle, and of the final mixing.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of shingles of five words, or of
    all its words if they are fewer."""
    words = split_words(pc.ascii_lower(texts))
    distinct = words.distinct.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[words.which]
    size = len(FACTORS)
    m = max(0, len(h) - size + 1)
    mixed = h[:m] * FACTORS[0]
    for k in range(1, size):
        mixed += h[k : m + k] * FACTORS[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    mixed ^= mixed >> np.uint64(32)
    for start, end in words.spans():
        if end - start >= size:
            yield np.unique(mixed[start : end - size + 1])
        elif end > start:
            yield np.array([xxhash.xxh64_intdigest(b" ".join([distinct[k] for k in words.which[start:end]]), seed=1)], dtype=np.uint64)
        else:
            yield np.empty(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def pivot_distances(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each pivot set, up to 255. Differences of these
    numbers, cut or not, never exceed those of the sets. Larger sets are measured from
    more pivot sets, each of which is part of one of the ``PIVOT_SETS``."""
    sets = PIVOT_SETS
    while 8 * sets < len(shingles):
        sets *= 2
    counts = np.bincount((shingles & np.uint64(sets - 1)).astype(np.int64), minlength=sets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, set_key, head (the set's lowest hashes: its prefix and a quarter
    as many more) and coords (its distances from the pivot sets); the last two are null for
    empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, keys, heads, coords = [], [], [], []
                for found in shingle_sets(part.column(1)):
                    n = len(found)
                    m = prefix_length(n, percent)
                    sizes.append(n)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                    heads.append(found[: m + m // 4 + 8].view(np.int64) if n else None)
                    coords.append(pivot_distances(found) if n else None)
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(coords, pa.binary())], ["doc_id", "n", "set_key", "head", "coords"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n int, set_key binary, head array<long>, coords binary")


def _members(docs: DataFrame, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every row, and the classes: rep, n, head, coords."""
    sets = work.materialize(_sets(docs, percent), "jaccard-sets")
    reps = sets.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Sets that occur once name themselves; only the keys of the others are joined.
    several = reps.where("copies > 1").select(F.hex("set_key").alias("apart"), "rep")
    joined = sets.withColumn("apart", F.hex("set_key")).join(several, "apart", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    own = F.col("n").isNotNull() & F.col("doc_id").isNotNull() & (F.col("rep") == F.col("doc_id")) & (F.col("n") > 0)
    both = work.write(joined.select("doc_id", "n", "rep", F.when(own, F.col("head")).alias("head"), F.when(own, F.col("coords")).alias("coords")), "jaccard-members")
    return both.select("doc_id", "n", "rep"), both.where(F.col("coords").isNotNull()).select("rep", "n", "head", "coords")


class _Order:
    """The order of shingles: by hash, those in ``hot`` after all others."""

    def __init__(self, hot: np.ndarray, percent: int):
        self.hot, self.percent = hot, percent

    def prefix(self, n: int, lowest: np.ndarray) -> np.ndarray | None:
        """The prefix of a set of n from its lowest hashes; None if they don't reach."""
        m = prefix_length(n, self.percent)
        if not len(self.hot):
            return lowest[:m]
        at = np.minimum(np.searchsorted(self.hot, lowest), len(self.hot) - 1)
        common = self.hot[at] == lowest
        cold = lowest[~common]
        if len(cold) >= m:
            return cold[:m]
        return None if len(lowest) < n else np.concatenate([cold, lowest[common]])[:m]


def _heads(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for rep, n, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield rep, n, head.values.to_numpy()


def _postings(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    counts = [len(f[2]) for f in found]
    s = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64)
    columns = [pa.array(s, pa.int64())]
    columns += [pa.array(np.repeat(np.array([f[k] for f in found], dtype=np.int64), counts), pa.int64()) for k in (0, 1)]
    return pa.record_batch(columns, ["s", "rep", "n"])


def _prefixes(classes: DataFrame, docs: DataFrame, order: _Order, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(s, rep, n) for the prefix of each class, and the distinct s that are not among
    the class's lowest hashes, where prefixes by hash alone lie.

    ``head`` nearly always reaches; classes for which hot shingles take up more of it
    than it has to spare are shingled again from their texts.
    """
    empty = np.empty(0, np.int64)

    def from_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _postings([(rep, n, own if (own := order.prefix(n, head)) is not None else empty) for rep, n, head in _heads(batch)])

    def unreached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([rep for rep, n, head in _heads(batch) if order.prefix(n, head) is None], pa.int64())], ["rep"])

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True)
                yield _postings([(rep, len(own), order.prefix(len(own), own.view(np.int64))) for rep, own in sets])

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beyond = [np.setdiff1d(own, head[: prefix_length(n, order.percent)]) for _, n, head in _heads(batch) if (own := order.prefix(n, head)) is not None]
            yield pa.record_batch([pa.array(np.unique(np.concatenate([empty, *beyond])), pa.int64())], ["s"])

    slim = classes.select("rep", "n", "head")
    reached = slim.mapInArrow(releasing(from_heads), "s long, rep long, n long")
    texts = _texts_of(docs, work.materialize(slim.mapInArrow(unreached, "rep long"), "jaccard-unreached"))
    again = work.materialize(texts.mapInArrow(releasing(from_texts), "s long, rep long, n long"), "jaccard-again")
    lengthened = slim.mapInArrow(late, "s long").unionByName(again.select("s")).distinct()
    return reached.unionByName(again), lengthened


#: Ids up to this many (8 bytes each) are sent to all tasks; more are joined by shuffle.
MOST_SENT = 200_000


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the documents whose doc_ids are in ``ids``."""
    wanted = ids.select(F.col("rep").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if ids.count() <= MOST_SENT else wanted
    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")


def _regions(classes: DataFrame, docs: DataFrame, percent: int, hot_from: int, most_hot: int, work: Workspace) -> DataFrame:
    """(s, rep, n) of all regions of two classes or more."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([_postings([(rep, n, head[: prefix_length(n, percent)]) for rep, n, head in _heads(batch)]).column(0)], ["s"])

    counted = classes.select("rep", "n", "head").mapInArrow(releasing(lowest), "s long").groupBy("s").count().where("count > 1")
    counted = work.materialize(counted, "jaccard-counts")
    common = counted.where(F.col("count") >= hot_from).orderBy(F.desc("count"), "s").limit(most_hot)
    hot = np.sort(np.array([r["s"] for r in common.select("s").toLocalIterator()], dtype=np.int64))
    wanted = counted.select("s")
    prefixes = classes.select("rep", "n", "head").mapInArrow(lambda batches: (_postings([(rep, n, head[: prefix_length(n, percent)]) for rep, n, head in _heads(b)]) for b in batches), "s long, rep long, n long")
    if len(hot):
        prefixes, lengthened = _prefixes(classes, docs, _Order(hot, percent), work)
        wanted = work.materialize(wanted.unionByName(lengthened).distinct(), "jaccard-wanted")
    met = prefixes.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "s", "left_semi")
    if not len(hot):
        return work.materialize(met, "jaccard-regions")
    met = work.materialize(met.dropDuplicates(["s", "rep"]), "jaccard-met")
    shared = met.groupBy("s").count().where("count > 1").select(apart("s"))
    return work.materialize(met.withColumn("apart", apart("s")).join(shared, "apart").drop("apart"), "jaccard-regions")


def _coarse(at: bytes, sets: int) -> np.ndarray:
    """Distances from ``sets`` pivot sets: those from the parts of each, summed."""
    return np.frombuffer(at, dtype=np.uint8).reshape(-1, sets).sum(axis=0, dtype=np.int32)


def _near(at: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (left, right) the sizes and the distances from the pivot sets allow
    to be linked. Sums of cut counts are cut at most as much as the sets differ."""
    total = n[left] + n[right]
    fits = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
    sets = np.array([len(x) for x in at])
    few = np.flatnonzero(sets == PIVOT_SETS)
    row = np.zeros(len(at), dtype=np.int64)
    row[few] = np.arange(len(few))
    matrix = np.frombuffer(b"".join([at[k] for k in few]), dtype=np.uint8).reshape(-1, PIVOT_SETS).astype(np.int16)
    plain = np.flatnonzero(fits & (sets[left] == PIVOT_SETS) & (sets[right] == PIVOT_SETS))
    for start in range(0, len(plain), 16_384):
        part = plain[start : start + 16_384]
        apart = np.abs(matrix[row[left[part]]] - matrix[row[right[part]]]).sum(axis=1, dtype=np.int64)
        fits[part] = (100 + percent) * apart <= (100 - percent) * total[part]
    for k in np.flatnonzero(fits & ((sets[left] > PIVOT_SETS) | (sets[right] > PIVOT_SETS))):
        common = min(sets[left[k]], sets[right[k]])
        apart = int(np.abs(_coarse(at[left[k]], common) - _coarse(at[right[k]], common)).sum())
        fits[k] = (100 + percent) * apart <= (100 - percent) * total[k]
    return fits


def _linked(pairs: DataFrame, docs: DataFrame, percent: int, name: str, work: Workspace) -> DataFrame:
    """Those of the distinct (a, b) whose sets are similar enough, by their whole sets."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [own.view(np.int64) for own in shingle_sets(part.column(1))]
                keys = [xxhash.xxh3_64_intdigest(own.tobytes()) >> 1 for own in found]
                yield pa.record_batch([part.column(0), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["rep", "k", "shingles"])

    pairs = work.materialize(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    # Repeated rows are dropped; a doc_id with several texts stays as several sets, each
    # compared.
    sets = _texts_of(docs, ids).mapInArrow(releasing(shingled), "rep long, k long, shingles array<long>").dropDuplicates(["rep", "k"])
    left, right = (sets.select(apart("rep"), F.col("shingles").alias(f"shingles_{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b", apart("a")).join(left, "apart").select("a", "b", "shingles_a", apart("b")).join(right, "apart")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))  # 100 shared >= percent * (sizes - shared)
    alike = both.where(F.lit(100 + percent) * shared >= F.lit(percent) * (F.size("shingles_a") + F.size("shingles_b")))
    return work.materialize(alike.select("a", "b").distinct(), f"{name}-links")


#: Small rows: so many, or documents with all their rows, for each file of a table.
EDGES_PER_FILE, DOCS_PER_FILE = 200_000, 10_000


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node of a link.

    Each round turns every node's larger neighbours to its smallest, and then its
    smaller ones, until nothing changes; both are joins on nodes, which can split the
    neighbours of a node that has very many, and minima that combine before the shuffle,
    so no neighbourhood is gathered. Rounds grow with the logarithm of a component's
    size; an error is raised if ``rounds`` don't suffice.
    """
    work = Workspace(1 + links.count() // EDGES_PER_FILE)
    edges = work.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    for _ in range(rounds):
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(apart("u"), "m")
        large = ways.where("v > u").select("v", apart("u")).join(least, "apart").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.select("v", apart("u")).join(lowest.select("m", apart("u")), "apart")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        work.tables.append(edges)
        edges = work.write(small, "components")
        work.clear()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = work.write(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "components-labels")
    discard(edges)
    return labels


def jaccard_components(docs: DataFrame, percent: int = 80, hot_from: int = 64, most_hot: int = 1_000_000, block: int = 256) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A set is the distinct shingles of five words, lower-cased in A-Z; texts of fewer
    words are one shingle; null texts and texts without words are empty sets, linked
    with nothing: their component_id is their doc_id. Two documents are linked when
    their sets' similarity is ``percent`` or more, and component_id is the smallest
    doc_id that links reach. Repeated rows are linked copies; rows with a null doc_id
    get the component of the texts equal to theirs, if any, and link nothing; an
    empty table gives no rows; other columns are left out.

    ``hot_from``, ``most_hot`` and ``block`` change the cost only, never the result.
    """
    work = Workspace(max(16, docs.count() // DOCS_PER_FILE))
    members, classes = _members(docs, percent, work)
    regions = _regions(classes, docs, percent, hot_from, most_hot, work)
    coords = classes.select("rep", "n", "coords")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            at = [*batch.column(4).to_pylist(), *batch.column(5).to_pylist()]
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()]).astype(np.int64)
            keep = pa.array(_near(at, n, rows, rows + batch.num_rows, percent), pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # The pivot is the most central class: the one whose regions hold most classes in all.
    sizes = regions.groupBy("s").agg(F.count("*").alias("size")).select(apart("s"), "size")
    central = work.materialize(regions.select("rep", apart("s")).join(sizes, "apart").groupBy("rep").agg(F.sum("size").alias("company")), "jaccard-central")
    pivots = regions.join(central, "rep").groupBy("s").agg(F.max(F.struct("company", F.xxhash64("rep").alias("h"), "rep")).alias("p")).select(apart("s"), F.col("p.rep").alias("pivot"))
    to_pivots = regions.select("rep", apart("s")).join(pivots, "apart").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    sides = [coords.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("coords").alias(f"coords_{k}")) for k in ("a", "b")]
    placed = to_pivots.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "coords_a", "coords_b")
    cores = _linked(placed.mapInArrow(releasing(near), "a long, b long"), docs, percent, "jaccard-cores", work)

    labels = components(cores)
    work.tables.append(labels)
    labelled = regions.join(labels, regions.rep == labels.node, "left").select("s", "rep", "n", F.coalesce("label", "rep").alias("label"))
    labelled = work.materialize(labelled, "jaccard-labelled")
    mixed = labelled.groupBy("s").agg(F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("mixed")).where("mixed AND size > 2").select(apart("s"), "size")
    rest = work.materialize(labelled.withColumn("apart", apart("s")).join(mixed, "apart").drop("apart"), "jaccard-mixed")
    # Of each class the first few of its regions (of a prefix at most): a pair that has
    # one of them in common before the region at hand is left to that one.
    lowest = rest.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("s")), 1, 8).alias("lowest"))
    rest = rest.join(lowest, "rep").join(coords.drop("n"), "rep")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "label", "coords", "lowest")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def pairs() -> pa.RecordBatch:
            own, rep, n, label = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
            left, right = np.triu_indices(len(rows), 1)
            crossing = (label[left] != label[right]) & ((own[left] != own[right]) if key[1] != key[2] else True)
            left, right = left[crossing], right[crossing]
            keep = _near([r[4] for r in rows], n, left, right, percent)
            kept = [k for k in np.flatnonzero(keep) if min(set(rows[left[k]][5]).intersection(rows[right[k]][5]), default=key[0]) >= key[0]]
            a, b = rep[left[kept]], rep[right[kept]]
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for s, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, i, j) != key:
                    if len(rows) > 1:
                        yield pairs()
                    key, rows = (s, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield pairs()

    crossing = rest.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(releasing(joined), "a long, b long").where("a <> b").distinct()
    late = _linked(crossing.join(cores, ["a", "b"], "left_anti"), docs, percent, "jaccard-late", work)
    final = components(cores.unionByName(late))
    work.clear()
    found = members.join(final, members.rep == final.node, "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
