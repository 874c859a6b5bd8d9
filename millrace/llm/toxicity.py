"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text in lower case, without punctuation at their ends, and
their first characters (``PREFIXES`` of them). A model knows the hashed terms that
the labels of its training rows tell apart, alone or in pairs, gives each a weight and a
vector, and adds to the weights of the terms of a text the products of the vectors of
every pair of them. So it learns that two terms together mean more, or less, than each
alone. A model has 80 bytes a term; a Python worker holds one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, give_back, materialize, releasing, slices, split_words

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”«»¿¡"


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) for every hashed term of each word, in order of words."""
    bare = pc.utf8_trim(words, characters=ENDS)
    length = pc.utf8_length(bare).to_numpy()
    owner, buckets = [], []
    for n in (0, *PREFIXES):
        terms = (pc.utf8_slice_codeunits(bare, 0, n) if n else bare).dictionary_encode()
        hashed = [zlib.crc32(t + b"\x00" * (n > 0)) for t in terms.dictionary.cast(pa.binary()).to_pylist()]
        stays = np.flatnonzero(length >= max(1, n))
        owner.append(stays)
        buckets.append((np.array(hashed, dtype=np.int64) % BUCKETS)[terms.indices.to_numpy()[stays]])
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], buckets[order]


def text_buckets(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for every distinct hashed term of each text, in order; only of
    those in ``known`` (sorted), then given by their places in it."""
    words = split_words(pc.utf8_lower(texts))
    owner, terms = word_buckets(words.distinct)
    if known is not None:
        at = np.searchsorted(known, terms)
        stays = at < len(known)
        stays[stays] = known[at[stays]] == terms[stays]
        owner, terms = owner[stays], at[stays]
    sizes = np.bincount(owner, minlength=len(words.distinct))
    # Each word of a text, and then each of the word's terms.
    text = np.repeat(np.arange(len(texts)), np.diff(words.ends, prepend=0))
    n = sizes[words.which]
    place = np.repeat((np.cumsum(sizes) - sizes)[words.which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return tuple(np.divmod(np.unique(np.repeat(text, n) * BUCKETS + terms[place]), BUCKETS))


@dataclass(frozen=True)
class Model:
    """buckets: the hashed terms it knows, sorted; weights and vectors belong to them."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """For n texts, given as pairs of a row and a feature that it has."""
        factors = self.vectors.shape[1]
        linear = np.bincount(rows, self.weights[features], n) if len(rows) else np.zeros(n)
        sums, squares = np.zeros((n, factors)), np.zeros((n, factors))
        np.add.at(sums, rows, self.vectors[features])
        np.add.at(squares, rows, self.vectors[features] ** 2)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, features: np.ndarray, y: np.ndarray, buckets: np.ndarray, factors: int = 8, epochs: int = 30, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> Model:
    """Adam on the logistic loss, by batches that are dealt once and come in a new order
    in each epoch. ``rows`` (in order) and ``features`` are pairs of a text and a feature
    that it has, ``y`` the texts' labels."""
    rng = np.random.default_rng(seed)
    n, m = len(y), len(buckets)
    base = (y.sum() + 1) / (n + 2)
    params = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.05, (m, factors))], axis=1)  # weights, then vectors
    bias, first, second = np.log(base / (1 - base)), np.zeros_like(params), np.zeros_like(params)
    bias_first = bias_second = 0.0
    upto, order, batches = np.searchsorted(rows, np.arange(n + 1)), rng.permutation(n), []
    for start in range(0, n, batch):
        chosen = order[start : start + batch]
        sizes = (upto[1:] - upto[:-1])[chosen]
        owner = np.repeat(np.arange(len(chosen)), sizes)
        own = features[np.repeat(upto[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        by = np.argsort(own, kind="stable")
        known, at = np.unique(own[by], return_index=True)
        batches.append((own, owner, by, known, at, y[chosen]))
    for step, k in enumerate((k for _ in range(epochs) for k in rng.permutation(len(batches)).tolist()), 1):
        own, owner, by, known, at, labels = batches[k]
        values = params[own]
        sums = np.zeros((len(labels), factors + 1))
        has, begins = np.unique(owner, return_index=True)
        if len(own):
            sums[has] = np.add.reduceat(values, begins, axis=0)
        squares = np.bincount(owner, (values[:, 1:] ** 2).sum(axis=1), len(labels))
        error = (_sigmoid(bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)) - labels) / len(labels)
        slopes = error[owner][:, None] * np.concatenate([np.ones((len(own), 1)), sums[owner, 1:] - values[:, 1:]], axis=1)
        gradient = decay * params
        if len(own):
            gradient[known] += np.add.reduceat(slopes[by], at, axis=0)
        scale, root = rate / (1 - 0.9**step), 1 - 0.999**step
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        params -= scale * first / (np.sqrt(second / root) + 1e-8)
        bias_first += 0.1 * (error.sum() - bias_first)
        bias_second += 0.001 * (error.sum() ** 2 - bias_second)
        bias -= scale * bias_first / (np.sqrt(bias_second / root) + 1e-8)
    return Model(float(bias), buckets, params[:, 0], params[:, 1:])


def pair_scores(rows: np.ndarray, features: np.ndarray, y: np.ndarray, m: int, least_rows: int, most: int = 4096) -> np.ndarray:
    """For each of m features the largest z-score of its pairs: how much the log-odds of
    label 1 with both differ from what the two alone add up to. Pairs count of which
    texts with both, with either one alone and with none are ``least_rows`` or more each.
    A feature's texts are a bit set, those of label 1 in its first words; texts with both
    are counted of one feature and ``most`` others at a time."""
    n, ones = len(y), int((y == 1).sum())
    words = -(-ones // 64)
    place = np.empty(n, dtype=np.int64)
    place[y == 1], place[y != 1] = np.arange(ones), 64 * words + np.arange(n - ones)
    bits = np.zeros((m, words + -(-(n - ones) // 64)), dtype=np.uint64)
    np.bitwise_or.at(bits, (features, place[rows] >> 6), np.uint64(1) << (place[rows] & 63).astype(np.uint64))

    def odds(texts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside, outside = toxic + 0.5, texts - toxic + 0.5
        return np.log(inside / outside), 1 / inside + 1 / outside

    def counted(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = np.bitwise_count(some)
        toxic = each[:, :words].sum(axis=1, dtype=np.int64)
        return toxic + each[:, words:].sum(axis=1, dtype=np.int64), toxic

    (all_of, toxic_of), best = counted(bits), np.zeros(m)
    for a in range(m):
        for b in range(a + 1, m, most):
            to = slice(b, b + most)
            both, toxic = counted(bits[a] & bits[to])
            cells = [(both, toxic), (all_of[a] - both, toxic_of[a] - toxic), (all_of[to] - both, toxic_of[to] - toxic), (n - all_of[a] - all_of[to] + both, ones - toxic_of[a] - toxic_of[to] + toxic)]
            (x, vx), (p, vp), (q, vq), (none, vn) = (odds(*c) for c in cells)
            z = np.abs(x - p - q + none) / np.sqrt(vx + vp + vq + vn)
            z[np.minimum.reduce([c for c, _ in cells]) < least_rows] = 0
            best[a] = max(best[a], z.max())
            best[to] = np.maximum(best[to], z)
    return best


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text, mod 3, is 1."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _taken(known: np.ndarray):
    """Lists of buckets with only those in ``known`` (sorted), by their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            at = np.searchsorted(known, values)
            stays = at < len(known)
            stays[stays] = known[at[stays]] == values[stays]
            upto = np.concatenate([[0], np.cumsum(stays)])
            kept = np.sort(at[stays] + len(known) * np.repeat(np.arange(len(ends) - 1), np.diff(upto[ends]))) % max(1, len(known))
            found = pa.ListArray.from_arrays(pa.array(upto[ends] - upto[ends[0]], pa.int32()), pa.array(kept[upto[ends[0]] : upto[ends[-1]]], pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), found], ["doc_id", "toxic", "buckets"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_z: float = 4.0, least_pair_z: float = 6.0, least_rows: int = 20, seed: int = 5) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the lowest hashes of
    their doc_ids among the rows not held out. Of rows with one doc_id, that counts
    whose terms come first; so the bound is one of rows.

    A term is kept if its shares in the two classes differ by ``least_z`` standard errors,
    or if it is in a pair that tells more, or less, than its two terms add up to, by
    ``least_pair_z`` (:func:`pair_scores`). So a term that says nothing by itself is kept
    for what it says with another. Pairs are looked at of terms in at least
    sqrt(``least_rows`` * rows) rows, where two that are independent meet in
    ``least_rows``. No number of terms is set. Terms are counted over the sample by Spark;
    to the driver come one row per term and the kept terms of each sampled document.
    Without documents of both classes the model is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text, buckets = text_buckets(part.column(2))
                ends = np.cumsum(np.bincount(text, minlength=part.num_rows))
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(buckets, pa.int32()))
                yield pa.record_batch([part.column(0), part.column(1), found], ["doc_id", "toxic", "buckets"])

    schema = "doc_id long, toxic int, buckets array<int>"
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows small rows
    sample = sample.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(releasing(hashed), schema)
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("buckets").alias("buckets"))
    sample = materialize(sample.coalesce(1 + max_rows // 2500), "toxicity-sample")
    sizes = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    none, some = sizes.get(0, 0), sizes.get(1, 0)
    if not none or not some:
        discard(sample)
        share = (some + 1) / (none + some + 2)
        return Model(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0), np.empty((0, 1)))
    n, often = none + some, math.isqrt(least_rows * (none + some))
    counts = sample.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("ones"), F.count("*").alias("all")).where((F.col("all") >= 3) & (F.col("all") < n))
    pooled = F.col("all") / F.lit(float(n))
    z = (F.col("ones") / F.lit(float(some)) - (F.col("all") - F.col("ones")) / F.lit(float(none))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / some + 1 / none))
    found = counts.select("bucket", (F.abs(z) >= least_z).alias("tells"), F.col("all").between(often, n - least_rows).alias("often")).where("tells OR often").toArrow().sort_by("bucket")
    buckets, tells, common = (found[c].to_numpy() for c in ("bucket", "tells", "often"))
    lists = sample.mapInArrow(_taken(buckets), schema).toArrow().sort_by("doc_id")
    discard(sample)
    y, ends = lists["toxic"].to_numpy().astype(np.float64), np.cumsum(pc.list_value_length(lists["buckets"]).to_numpy())
    # Four bytes a number: for 20,000 long texts there are ten million of them.
    rows, features = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends, prepend=0)), pc.list_flatten(lists["buckets"]).to_numpy().astype(np.int32)
    del lists

    def only(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, stays = np.cumsum(which, dtype=np.int32) - 1, which[features]
        return rows[stays], place[features[stays]]

    paired = np.zeros(len(buckets), dtype=bool)
    paired[common] = pair_scores(*only(common), y, int(common.sum()), least_rows) >= least_pair_z
    model = fit(*only(tells | paired), y, buckets[tells | paired].astype(np.int64), seed=seed)
    del rows, features
    give_back()  # the driver goes on with other work
    return model


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the model's score of every row's text as column ``name``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.empty(0)]
            for part in slices(pa.record_batch([texts], ["text"]), 0):
                rows, features = text_buckets(part.column(0), model.buckets)
                found.append(_sigmoid(model.logits(rows, features, part.num_rows)))
            yield pa.array(np.concatenate(found), pa.float64())

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(run)(texts)

    return docs.select("*", scored("text").alias(name))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **training) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document.

    One row per row of ``docs``: doc_id, held_out, score, and predicted (1 from
    ``threshold`` on). A null or empty text has no terms and gets the model's bias; a
    null doc_id is never held out; repeated rows get equal scores; repeated labels of a
    document count as 1 if one of them is; an empty table gives no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels, **training))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
