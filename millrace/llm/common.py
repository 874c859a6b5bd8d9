"""Tables, scratch storage, words and tokenizers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import json
import os
import re
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import scratch_path

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is cut
    and a lost executor costs no recomputation of what lies before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these, once nothing reads it."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """The intermediate tables of one computation, each of ``files`` files at most;
    :meth:`clear` deletes them once a result that doesn't read them is stored."""

    def __init__(self, files: int):
        self.files, self.tables = files, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays."""
        return materialize(df.coalesce(self.files), name)

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(self.write(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def apart(key: str) -> Column:
    """A long key in other words, for joins with rows that are grouped by it. The planner
    then exchanges both sides for the join alone, and adaptive execution may split the
    rows of a key that has very many; it can't where a group-by shares the exchange."""
    return F.bitwise_not(F.col(key)).alias("apart")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# Words of Arrow columns, a bounded slice at a time

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of one row or of at most ``most`` bytes in
    the column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


@dataclass(frozen=True)
class Words:
    """The words of several texts: ``distinct`` ones, for each word its place among
    those, and for each text the number of words up to its end."""

    distinct: pa.Array
    which: np.ndarray
    ends: np.ndarray

    def spans(self) -> Iterator[tuple[int, int]]:
        start = 0
        for end in self.ends.tolist():
            yield start, end
            start = end


def split_words(texts: pa.Array) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text; a null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy()[1:].astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # what the kernel has before leading and after trailing white space
        stays = which != blank
        ends = np.concatenate([[0], np.cumsum(stays)])[ends]
        which = which[stays]
    return Words(coded.dictionary, which, ends)


# What a Python worker keeps between tasks

_kept: dict = {}
_tasks = itertools.count()
_last = {"task": -1}
#: Seconds after which a worker without a task drops what it has kept.
IDLE = 2.0


def per_worker(make: Callable, *args):
    """``make(*args)``, kept in this Python worker for the next tasks, until something
    else is asked for or no task has come for a while: Spark reuses its workers, so
    whatever they keep stays in an executor's memory."""
    key = (make.__module__, make.__qualname__, *args)
    if _kept.get("key") != key:
        _kept.clear()
        _kept.update(key=key, value=make(*args))
    return _kept["value"]


def give_back() -> None:
    """Memory that is free again, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def _drop(task: int) -> None:
    if _last["task"] == task:
        _kept.clear()
        give_back()


# Functions of this module, which tasks meet by name: what they change is the worker's own.


def _begin() -> int:
    _last["task"] = next(_tasks)
    return _last["task"]


def _end(task: int) -> None:
    give_back()
    idle = threading.Timer(IDLE, _drop, [task])
    idle.daemon = True
    idle.start()


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches for workers that wait for other tasks afterwards: it gives
    free memory back, and later what :func:`per_worker` keeps."""

    def wrapped(batches: Iterator) -> Iterator:
        task = _begin()
        try:
            yield from run(batches)
        finally:
            _end(task)

    return wrapped


# Tokenizers

#: The parts of a vocabulary file, as ``word_bpe_49k.json`` has them, under
#: which the ids of a text are those of its white-space-free words in order. Nothing is
#: composed, lower-cased or matched across white space, which itself gives no ids.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Where ``SPLIT`` cuts anyway, and nothing is composed, white space may be put in: between
#: a letter of a to z and a mark that ends its word. Few words are then new ones.
CUT = {"pattern": r"([A-Za-z])([.,;:!?])(\s|$)", "replacement": r"\1 \2\3"}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class TextEncoder:
    """Ids of texts by the tokenizers library.

    Where the vocabulary file says that words without white space are encoded one by
    one (see ``NORMALIZERS`` and following), the ids that the library gave for whole
    words are kept, at most about ``memo_bytes`` of them, the longest unused going
    first. Texts of any other vocabulary are encoded whole.
    """

    SEPARATOR = "|"
    #: Bytes that an entry takes besides its word and ids.
    ENTRY = 160

    def __init__(self, path: str, memo_bytes: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.half, self.held, self.young, self.old = memo_bytes // 2, 0, {}, {}

    @cached_property
    def by_words(self) -> bool:
        spec = json.loads(self.model.to_str())
        parts = [(spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers"), spec["post_processor"], spec["truncation"], spec["padding"], spec["model"].get("dropout")]
        added = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or self.SEPARATOR not in t["content"] or t["content"].split() != [t["content"]] or re.search(r"[A-Za-z][.,;:!?]", t["content"])]
        return parts == [NORMALIZERS, [SPLIT, BYTES], None, None, None, None] and not added and len(self._ids(self.SEPARATOR)) == 1

    def _ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by a few calls of the library: in one text between
        separators, or, for words of a to z, which neither normalizer nor pre-tokenizer
        alters, from its model."""
        found: list[bytes | None] = [None] * len(words)
        letters = [k for k, w in enumerate(words) if w.isascii() and w.isalpha() and w.islower()]
        flat, ends, tokenize = [], [0], self.model.model.tokenize
        for k in letters:
            flat += [token.id for token in tokenize(words[k])]
            ends.append(4 * len(flat))
        raw = np.array(flat, dtype="<u4").tobytes()
        for k, start, end in zip(letters, ends, ends[1:], strict=False):
            found[k] = raw[start:end]
        others = []
        for k in range(len(words)):
            if found[k] is None:
                if self.SEPARATOR in words[k]:
                    found[k] = np.array(self._ids(words[k]), dtype="<u4").tobytes()
                else:
                    others.append(k)
        (separator,) = self._ids(self.SEPARATOR)
        for first in range(0, len(others), 64):
            part = others[first : first + 64]
            ids = np.array(self._ids(f" {self.SEPARATOR} ".join([words[k] for k in part])), dtype="<u4")
            raw, ends, at = ids.tobytes(), [*np.flatnonzero(ids == separator).tolist(), len(ids)], 0
            for k, end in zip(part, ends, strict=True):
                found[k] = raw[4 * at : 4 * end]
                at = end + 1
        return found

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        parts = list(map(self.young.get, words))
        gaps = [k for k, ids in enumerate(parts) if ids is None]
        if gaps:
            lost = [words[k] for k in gaps]
            found = list(map(self.old.get, lost))
            new = [j for j, ids in enumerate(found) if ids is None]
            for j, ids in zip(new, self._learn([lost[j] for j in new]), strict=True):
                found[j] = ids
            for k, ids in zip(gaps, found, strict=True):
                parts[k] = ids
            self.young.update(zip(lost, found, strict=True))
            self.held += sum(map(len, lost)) + sum(map(len, found)) + self.ENTRY * len(lost)
            if self.held > self.half:
                self.old, self.young, self.held = self.young, {}, 0
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of ids up to the
        end of each text. A null text has none."""
        if not self.by_words:
            found = [np.array(self._ids(t) if t else [], dtype="<u4") for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.cumsum([len(ids) for ids in found], dtype=np.int64)
        words = split_words(pc.replace_substring_regex(texts, **CUT))
        # Of words of ASCII letters the normalizer changes the case and nothing else.
        spelled = pc.if_else(pc.ascii_is_alpha(words.distinct), pc.ascii_lower(words.distinct), words.distinct)
        ids = pa.array(self._of_words(spelled.to_pylist()), pa.binary()).take(pa.array(words.which))
        _, offsets, data = ids.buffers()
        upto = np.frombuffer(offsets, dtype=np.int32, count=len(ids) + 1)
        return np.frombuffer(data or b"", dtype="<u4", count=upto[-1] // 4), upto[words.ends].astype(np.int64) // 4

    def encode_documents(self, texts: pa.Array, end_id: int) -> pa.Array:
        """For each text its ids and ``end_id``, as little-endian unsigned 32-bit
        integers; a null text has only ``end_id``."""
        ids, ends = self.encode(texts)
        whole = np.insert(ids, ends, end_id).astype("<u4", copy=False)
        offsets = 4 * np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)])


def text_encoder(path: str) -> TextEncoder:
    """The one of this Python worker."""
    return per_worker(TextEncoder, path)
