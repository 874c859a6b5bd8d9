"""Hierarchical packing of tokenized documents into windows of several lengths.

A document's ids are routed by length: what fills whole windows of the longest tier
becomes such windows; the rest goes to the shortest tier that holds it. Each tier is
packed from its own documents, longest first; the gap that a document leaves in its
window is filled with the best-fitting documents of shorter tiers, the last of which
is cut to fit. So every window is full, but for one at most in each buffer of
documents, and a full window of a shorter tier is a sequence of that power of two.

Documents meet in blocks by a hash of their doc_id and text, each of about
``block_docs`` documents: blocks are independent of each other and of the layout of
the input, and a block is packed in buffers that hold a bounded number of documents
and ids, so no task gathers more than a buffer. Only rows that are repeated more than
``block_docs`` times, which have no other difference, are dealt to all blocks by number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import releasing, slices, text_encoder

TIERS = (256, 512, 1024, 2048)


class _Shelf:
    """Rests of documents ordered by length: (length, document, start)."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def put(self, item: tuple[int, int, int]) -> None:
        insort(self.items, item)

    def longest(self, at_most: int) -> tuple[int, int, int] | None:
        k = bisect_right(self.items, (at_most, 1 << 62, 0))
        return self.items.pop(k - 1) if k else None


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of these lengths: (tier, pieces), a piece being
    (document, start, length). Every window is as long as its tier, except the last
    of the shortest tier. Documents without ids get no piece."""
    top, windows = tiers[-1], []
    shelves = [_Shelf() for _ in tiers]

    def route(item: tuple[int, int, int], below: int) -> None:
        k = min(next(k for k, size in enumerate(tiers) if size >= item[0]), below)
        shelves[k].put(item)

    for doc, n in enumerate(lengths):
        full = n // top * top
        windows += [(top, [(doc, start, top)]) for start in range(0, full, top)]
        if n > full:
            route((n - full, doc, full), len(tiers))
    for level in range(len(tiers) - 1, -1, -1):
        size, own = tiers[level], shelves[level]
        while (item := own.longest(size)) is not None:
            pieces, gap = [(item[1], item[2], item[0])], size - item[0]
            while gap:
                for shelf in reversed(shelves[: level + 1]):
                    if (filler := shelf.longest(gap)) is not None:
                        break
                else:  # nothing is short enough: cut the shortest there is
                    shelf = next((s for s in shelves[: level + 1] if s.items), None)
                    if shelf is None:
                        break
                    n, doc, start = shelf.items.pop(0)
                    filler = (gap, doc, start)
                    route((n - gap, doc, start + gap), level)
                pieces.append((filler[1], filler[2], filler[0]))
                gap -= filler[0]
            if gap and level:  # what is left over starts the shorter tiers anew
                rest = [(n, doc, start) for doc, start, n in pieces]
                if sum(n for n, _, _ in rest) > tiers[level - 1]:
                    rest = _cut(rest, tiers[level - 1], windows)
                for n, doc, start in rest:
                    shelves[level - 1].put((n, doc, start))
                continue
            windows.append((size, pieces))
    return windows


def _cut(rest: list[tuple[int, int, int]], size: int, windows: list) -> list[tuple[int, int, int]]:
    """Fill one window of ``size`` from ``rest`` and return what is left."""
    pieces, room, left = [], size, []
    for n, doc, start in rest:
        take = min(n, room)
        if take:
            pieces.append((doc, start, take))
            room -= take
        if n > take:
            left.append((n - take, doc, start + take))
    windows.append((size, pieces))
    return left


def step_groups(windows: list[tuple[int, list]], window: int, step_windows: int) -> list[int]:
    """A group for each window, so that groups hold nearly equal numbers of ids: the
    windows, longest first, are dealt out to and fro."""
    total = sum(size for size, _ in windows)
    groups = max(1, round(total / (window * step_windows)))
    out = [0] * len(windows)
    for k, w in enumerate(sorted(range(len(windows)), key=lambda w: (-windows[w][0], w))):
        lap, at = divmod(k, groups)
        out[w] = at if lap % 2 == 0 else groups - 1 - at
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, own (a hash of doc_id and text) and ids (little-endian unsigned 32-bit) of
    every document; a null text is empty and has only ``end_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.record_batch([part.column(0), part.column(2), encoder.encode_documents(part.column(1), end_id)], ["doc_id", "own", "ids"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("own")).mapInArrow(releasing(encode), "doc_id long, own long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, block_docs: int = 4096, buffer_ids: int = 8_000_000, step_windows: int = 64, with_ids: bool = False) -> DataFrame:
    """Pack every document's ids, ``end_id`` appended, into sequences of at most
    ``tiers[-1]`` ids; see the module's text.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32
    (of its ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in
    the sequence), tier and step_group (sequences to train on together); with
    ``with_ids`` also the ids. Null texts are empty; a null doc_id stays null; repeated
    rows are packed separately; an empty table gives no rows.
    """
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select(own.alias("own")).groupBy("own").count().agg(F.sum("count").alias("all"), F.sort_array(F.collect_list(F.when(F.col("count") > block_docs, F.col("own")))).alias("hot")).first()
    blocks = -(-(rows["all"] or 0) // block_docs) or 1
    # At most one in ``block_docs`` rows is the first of such a group.
    dealt = F.col("own").isin(rows["hot"]) if rows["hot"] else F.lit(False)
    schema = PIECES + (", ids binary" if with_ids else "")

    def flush(rows: list, base: int) -> tuple[pa.RecordBatch, int]:
        windows = pack_lengths([len(r[1]) // 4 for r in rows], tiers)
        groups = step_groups(windows, tiers[-1], step_windows)
        out = []
        for k, (tier, pieces) in enumerate(windows):
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids = rows[doc]
                piece = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(piece), len(ids) // 4, base + k, offset, tier, base + groups[k], *([piece] if with_ids else [])))
                offset += length
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        names = [field.split()[0] for field in schema.split(", ")]
        return pa.record_batch(columns, names), base + len(windows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, base, rows, held = None, 0, [], 0
        for part in (part for batch in batches for part in slices(batch, 2)):
            for b, doc_id, ids in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if rows and (b != block or len(rows) >= 2 * block_docs or held >= buffer_ids):
                    out, base = flush(rows, base)
                    yield out
                    rows, held = [], 0
                if b != block:
                    block, base = b, b << 32
                rows.append((doc_id, ids))
                held += len(ids) // 4
        if rows:
            yield flush(rows, base)[0]

    ids = tokenized(docs, tokenizer_path, end_id)
    block = F.pmod(F.when(dealt, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("own")), F.lit(blocks))
    placed = ids.select(block.alias("block"), "doc_id", "ids", "own")
    return placed.repartition("block").sortWithinPartitions("block", "doc_id", "own").drop("own").mapInArrow(releasing(pack), schema)
