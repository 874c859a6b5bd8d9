"""Alignment of two tokenizers over the bytes of texts.

Tokens of both end at bytes of the text; marks of these ends are two packed bit sets. AND
gives the bytes where both end, which cut the text into groups. The rank of a cut in
either bit set, by prefix sums of popcounts, is the token that ends there, so a group is a
range of tokens of each side, and its last two tokens are linked.

How often a pair of ids is linked is counted over all documents. Texts are worked on in
blocks; a block counts its pairs first, so that one row per block and pair is shuffled,
and gets back the pairs' counts as one list, whatever the number of its documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize, per_worker, releasing, slices

#: How byte-level vocabularies write bytes: these as themselves, all
#: others, in order, as the characters from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

#: The pattern that such a pre-tokenizer stands for.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20


def byte_of_character() -> dict[str, int]:
    others = iter(range(256, 512))
    return {chr(b if b in PLAIN else next(others)): b for b in range(256)}


class Pieces:
    """Ids of pieces of texts, by a function that encodes a list of them; those of the
    last pieces are kept, about ``memo_bytes`` of them."""

    #: Bytes that an entry takes besides its piece and ids.
    ENTRY = 160

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], memo_bytes: int = 64 << 20):
        self.encode, self.half, self.held, self.young, self.old = encode, memo_bytes // 2, 0, {}, {}

    def _learn(self, pieces: list[str]) -> list[bytes]:
        found = []
        for first in range(0, len(pieces), 4096):
            ids = self.encode(pieces[first : first + 4096])
            raw = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
            ends = [0, *itertools.accumulate(4 * len(x) for x in ids)]
            found += [raw[a:b] for a, b in itertools.pairwise(ends)]
        return found

    def ids(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.young.get, pieces))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        lost = [pieces[k] for k in gaps]
        known = list(map(self.old.get, lost))
        new = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(new, self._learn([lost[k] for k in new]), strict=True):
            known[k] = ids
        for k, ids in zip(gaps, known, strict=True):
            found[k] = ids
        self.young.update(zip(lost, known, strict=True))
        self.held += sum(map(len, lost)) + sum(map(len, known)) + self.ENTRY * len(lost)
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        return found


class ByteTokens:
    """The byte-level tokenizer of a file of the tokenizers library.

    The tiktoken library encodes several times faster. It merges the two neighbours that
    make the token with the smallest id; the file's model merges those of its listed
    pairs that comes first. If pairs make ids in the order of the list, and each token's
    own characters are merged to that token, both are the same: what stands inside a
    token's part of a word has been merged as it would be without the rest of the word, so
    the last two neighbours are the listed ones. That is checked here. Pieces with
    characters that the two libraries may put into different classes go to the first.
    """

    #: Pieces of characters below this go to tiktoken; tests compare the classes of all.
    KNOWN = "\u0250"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        import tiktoken
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(model.to_str())
        #: Whether a text's ids are those of its parts, cut before a space that follows
        #: what is no white space: no part of the file's pattern goes over such a place.
        self.cut = spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL and spec["model"].get("dropout") is None
        byte = byte_of_character()
        entries = model.get_vocab(with_added_tokens=True)
        words: list[bytes] = [b""] * (1 + max(entries.values()))
        for word, k in entries.items():
            words[k] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        self.words = pa.array(words, pa.binary())
        plain, merged = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [plain["".join(pair)] for pair in merged]
        bytes_only = set(plain) - {"".join(pair) for pair in merged} - {t["content"] for t in spec["added_tokens"]}
        ordered = made == sorted(set(made)) and bytes_only == set(byte) and max(plain[c] for c in byte) < made[0]
        whole = ordered and all(len(model.model.tokenize(word)) == 1 for word in map("".join, merged))
        fast = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks={words[plain[w]]: plain[w] for w in [*byte, *map("".join, merged)]}, special_tokens={}) if self.cut and whole else None

        def encode(pieces: list[str]) -> list[list[int]]:
            if fast is None:
                return [e.ids for e in model.encode_batch_fast(pieces, add_special_tokens=False)]
            found = [fast.encode_ordinary(p) if max(p) < self.KNOWN else None for p in pieces]
            others = [k for k, ids in enumerate(found) if ids is None]
            for k, e in zip(others, model.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False), strict=True):
                found[k] = e.ids
            return found

        self.pieces = Pieces(encode)


class PieceTokens:
    """The tokenizer of a sentencepiece model, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        #: The same: no piece has a space after another character, and spaces stay.
        self.cut = all(re.fullmatch("▁*[^▁]*", n) for n in names) and model.decode(model.encode("a  b ")) == "a  b "
        self.words = pa.array([bytes([int(n[3:5], 16)]) if model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)], pa.binary())
        alone = model.piece_to_id("▁")

        def encode(pieces: list[str]) -> list[list[int]]:
            # A piece begins with the space that the model puts there itself.
            return [ids if len(p) > 1 else [alone] for p, ids in zip(pieces, model.encode([p[1:] for p in pieces], num_threads=1), strict=True)]

        self.pieces = Pieces(encode)


class Aligner:
    """Both tokenizers and what is looked up of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.length_a, self.length_b = (pc.binary_length(side.words).to_numpy().astype(np.int64) for side in (self.a, self.b))
        # Decimal ids, each with both marks that may follow it.
        numbers = lambda n, marks: [f"{k}{m}".encode() for k in range(n) for m in marks]
        self.decimal = pa.array(numbers(len(self.a.words), ",|") + numbers(len(self.b.words), ",;"), pa.binary())

    def encode(self, side, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many there are up to the end of
        each piece."""
        ids = pa.array(side.pieces.ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        upto = np.frombuffer(offsets, np.int32, len(ids) + 1)
        return np.frombuffer(data or b"", "<u4", upto[-1] // 4), upto[1:].astype(np.int64) // 4


def aligner(path_a: str, path_b: str) -> Aligner:
    """The one of this Python worker."""
    return per_worker(Aligner, path_a, path_b)


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Spaces after what is no white space: after ASCII from ``!`` to ``~`` and characters
    of two bytes from U+00C0 on."""
    space = np.flatnonzero(raw[2:] == 32) + 2
    last, before = raw[space - 1], raw[space - 2]
    return space[((last > 32) & (last < 127)) | ((last >= 0x80) & (before >= 0xC3) & (before < 0xE0))]


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the bits up to each place, itself included, are set: a prefix sum of
    popcounts of words, and the popcount of a part of one. ``bits`` are little-endian words."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    part = bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return before[word] + np.bitwise_count(part)


def bit_set(places: np.ndarray, n: int) -> np.ndarray:
    """A bit set of n bits, packed into 64-bit words, in which those at ``places`` are set."""
    bits = np.zeros(-(-n // 64) * 64, dtype=bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def members(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _joined(words: pa.Array, ids: np.ndarray) -> np.ndarray:
    """The bytes of tokens one after another."""
    taken = words.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    return np.frombuffer(data or b"", np.uint8)[: np.frombuffer(offsets, np.int32, len(ids) + 1)[-1]]


def align(texts: pa.Array, both: Aligner) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """For each text n_a, n_b and n_groups, and groups_sha256; the pairs of linked ids,
    first * (number of second ids) + second, in order, and the number of pairs up to the
    end of each text.

    A text that is null or empty, or which the joined bytes of either side's tokens differ
    from (with a space put before it), has no tokens.
    """
    rows, dead = len(texts), np.zeros(0, np.int64)
    live = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    while True:  # once more without the texts that the tokens don't give back
        live = np.setdiff1d(live, dead)
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.take(pa.array(live)).cast(pa.string()), "")
        _, offsets, data = spaced.buffers()
        at = np.frombuffer(offsets, np.int32, len(live) + 1).astype(np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[: at[-1]]
        begins = np.zeros(len(raw), dtype=bool)
        begins[at[:-1]] = True
        if both.a.cut and both.b.cut:
            begins[cut_places(raw)] = True
        places = np.flatnonzero(begins)
        coded = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, at[-1]).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        last = np.searchsorted(places, at[1:]) - 1  # the last piece of each text
        sides, wrong = [], np.zeros(len(live), bool)
        for side, length in ((both.a, both.length_a), (both.b, both.length_b)):
            ids, upto = both.encode(side, coded)
            ends, upto = np.cumsum(length[ids]), upto[last] if len(live) else upto
            sides.append((ids, ends, upto))
            sizes = np.diff(np.concatenate([[0], ends])[upto], prepend=0)
            if not np.array_equal(sizes, np.diff(at)) or not np.array_equal(_joined(side.words, ids), raw):
                words, first = _joined(side.words, ids), np.concatenate([[0], np.cumsum(sizes)])
                wrong |= np.array([not np.array_equal(words[first[k] : first[k + 1]], raw[at[k] : at[k + 1]]) for k in range(len(live))], dtype=bool)
        if not wrong.any():
            break
        dead = live[wrong]

    (ids_a, ends_a, upto_a), (ids_b, ends_b, upto_b) = sides
    bits_a, bits_b = bit_set(ends_a - 1, len(raw)), bit_set(ends_b - 1, len(raw))
    cuts = members(bits_a & bits_b)
    last_a, last_b = ranks(bits_a, cuts), ranks(bits_b, cuts)  # tokens up to the end of each group
    links = ids_a[last_a - 1].astype(np.int64) * len(both.b.words) + ids_b[last_b - 1]
    ends = np.searchsorted(cuts, at[1:])

    # Each group's tokens of one side and then of the other, in words of decimal ids.
    group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(x, prepend=0)) for x in (last_a, last_b))
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    closes_a, closes_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    closes_a[last_a - 1] = closes_b[last_b - 1] = True
    order[np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]] = 2 * ids_a.astype(np.int64) + closes_a
    order[np.arange(len(ids_b)) + last_a[group_b]] = 2 * (len(both.a.words) + ids_b.astype(np.int64)) + closes_b
    written = both.decimal.take(pa.array(order))
    _, offsets, data = written.buffers()
    upto = np.frombuffer(offsets, np.int32, len(order) + 1)[np.concatenate([[0], upto_a + upto_b])]
    memory = memoryview(data or b"")
    shas = [hashlib.sha256(memory[a : b - 1]).hexdigest() for a, b in itertools.pairwise(upto.tolist())]

    def spread(counts: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        out[live] = counts
        return out

    hashes = [""] * rows
    for k, sha in zip(live.tolist(), shas, strict=True):
        hashes[k] = sha
    found = {"n_a": spread(np.diff(upto_a, prepend=0)), "n_b": spread(np.diff(upto_b, prepend=0)), "n_groups": spread(np.diff(ends, prepend=0))}
    return found, hashes, links, np.cumsum(found["n_groups"])


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document, whose ``links`` are places in its block's list of pairs, and
    one per block, with that list and how often the block has each pair."""
    names = [f.split()[0] for f in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(path_a, path_b), itertools.count(TaskContext.get().partitionId() << 32)
        for part in (part for batch in batches for part in slices(batch, 1, block_bytes)):
            n, block = part.num_rows, next(number)
            found, hashes, links, ends = align(part.column(1), both)
            pairs, places, counts = np.unique(links, return_inverse=True, return_counts=True)
            stored = places.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            wide = stored.itemsize
            offsets = pa.py_buffer(wide * np.concatenate([[0], ends]).astype(np.int32))
            lists = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(stored)])
            columns = [np.full(n, block), part.column(0), *found.values(), hashes, lists, pa.nulls(n, kinds[7]), pa.nulls(n, kinds[8])]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            yield pa.record_batch([pa.array([v], k) for v, k in zip([block, wide, *[None] * 5, pairs, counts], kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(releasing(run), ALIGNED)


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of a block's documents: their links' counts summed, and how many are the best of
    their second id. The rows of pairs have their places in the block's list."""
    place = pairs["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    width = pairs["wide"][0].as_py() if len(place) else 2
    sums, bests = [], []
    for links in docs["links"]:
        at = np.frombuffer(links.as_buffer(), f"<u{width}")
        sums.append(int(count[at].sum()))
        bests.append(int(best[at].sum()))
    columns = {name: docs[name] for name in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": docs["n_groups"], "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs["groups_sha256"]}
    return pa.table(columns)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of the tokens of every whole text by two tokenizers: ``path_a``,
    of the tokenizers library and byte-level, over the text with a space before it, and
    ``path_b``, of sentencepiece, which puts that space there.

    One row per row of ``docs``, with the columns of ``DIGESTS``: tokens of each side,
    groups, links (pairs of tokens that end together, so as many as groups), links whose
    pair of ids is linked most often of all pairs with that second id (ties included),
    the sum over links of how often their pairs are linked, in all documents, and sha256
    of the groups as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that the tokens of one side don't give back, have no
    tokens: zeros and an empty string. Repeated rows stay and count each; other columns
    are left out; an empty table gives no rows. The best count of each second id, a row
    per entry of its vocabulary at most, is sent to all tasks.
    """
    stored = materialize(aligned_blocks(docs, path_a, path_b), "alignment-blocks")
    pairs = stored.where("pairs IS NOT NULL").select("block", F.col("doc_id").alias("wide"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "of"))
    pairs = pairs.select("block", "wide", "place", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    size = second_ids(path_b)
    second = F.pmod(F.col("pair"), F.lit(size))
    most = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    judged = counts.withColumn("second", second).join(F.broadcast(most), "second").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    found = pairs.drop("n").join(judged, "pair").select(F.col("block").alias("of_block"), "wide", "place", "count", "best")
    documents = stored.where("pairs IS NULL").drop("pairs", "counts")
    result = materialize(documents.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_scored, DIGESTS), "alignment")
    discard(stored, counts)
    return result


def second_ids(path_b: str) -> int:
    """Entries of a sentencepiece vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
