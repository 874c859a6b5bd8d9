"""Token ids in a binary file format of shuffled bit or byte planes.

A data set is a folder of files, each written by one Spark task with Spark's own
writer and commit protocol. A file holds, one after another:

* chunks: a block of ``block_ids`` ids (the last block of a file may be shorter),
  transposed into planes. ``byte`` planes: plane k holds byte k of every id;
  ``bit`` planes: plane k holds bit k of every id, eight ids a byte. Each plane is
  compressed with zstandard and the compressed planes follow each other;
* the documents: doc_id and number of ids of each, as two zstandard-compressed
  columns of signed 64-bit integers (the lowest value stands for a null doc_id);
* the index: JSON with the block size, the plane kind, for each chunk its byte
  offset, its number of ids and the length of each of its planes, and where the
  documents lie;
* the index's length as 8 bytes, the magic ``MRPLANE1``, and a line feed.

All integers are little-endian. Every record written by the text writer ends in a
line feed, which the offsets take into account.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.llm.common import materialize, releasing, slices, text_encoder
from millrace.sources.scratch import scratch_path

MAGIC = b"MRPLANE1"
NULL_ID = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids; planes above the highest used
    byte or bit are left out."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    if kind != "bit":
        raise ValueError(f"planes are byte or bit, not {kind!r}")
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class FileWriter:
    """The records of one file, in order; the documents' lengths are kept until the end.

    A file with ``file_chunks`` chunks is full, and has ``file_chunks`` + 2 records: its
    first chunks but one are a record each, and all others together one, so that files
    end with a document although a document may fill several chunks.
    """

    def __init__(self, block_ids: int, kind: str, level: int, file_chunks: int):
        self.block_ids, self.kind, self.file_chunks = block_ids, kind, file_chunks
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.offset, self.chunks, self.ids, self.lengths = 0, [], [], []
        self.buffer, self.held, self.last = [], 0, []

    @property
    def full(self) -> bool:
        return len(self.chunks) >= self.file_chunks

    def _record(self, body: bytes) -> bytes:
        self.offset += len(body) + 1
        return body

    def _chunk(self, ids: np.ndarray) -> Iterator[bytes]:
        planes = [self.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.offset, len(ids), [len(p) for p in planes]])
        if not self.full:
            yield self._record(b"".join(planes))
        else:
            self.last += planes
            self.offset += sum(map(len, planes))

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            held = np.concatenate(self.buffer)
            full = len(held) // self.block_ids * self.block_ids
            for start in range(0, full, self.block_ids):
                yield from self._chunk(held[start : start + self.block_ids])
            self.buffer, self.held = [held[full:]], len(held) - full

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield from self._chunk(np.concatenate(self.buffer))
        if self.last:
            self.offset += 1
            yield b"".join(self.last)
        columns = [self.compress(np.array(c, dtype="<i8").tobytes()) for c in (self.ids, self.lengths)]
        documents = [self.offset, [len(c) for c in columns]]
        yield self._record(b"".join(columns))
        index = json.dumps({"block_ids": self.block_ids, "planes": self.kind, "documents": documents, "chunks": self.chunks}).encode()
        yield self._record(index + len(index).to_bytes(8, "little") + MAGIC)


class FileReader:
    """One file: its index, single chunks by number, or its documents in order."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        if bytes(self.content[-9:]) != MAGIC + b"\n":
            raise ValueError("not a plane file, or cut short")
        length = int.from_bytes(self.content[-17:-9], "little")
        self.index = json.loads(bytes(self.content[-17 - length : -17]))
        self.expand = zstandard.ZstdDecompressor().decompress

    def _parts(self, offset: int, lengths: list[int]) -> list[bytes]:
        out = []
        for n in lengths:
            out.append(self.expand(self.content[offset : offset + n]))
            offset += n
        return out

    def chunk(self, k: int) -> np.ndarray:
        offset, n, lengths = self.index["chunks"][k]
        return from_planes(self._parts(offset, lengths), n, self.index["planes"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, lengths = (np.frombuffer(c, dtype="<i8") for c in self._parts(*self.index["documents"]))
        held, k = np.empty(0, dtype="<u4"), 0
        for doc_id, n in zip(ids.tolist(), lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if doc_id == NULL_ID else doc_id), held[:n]
            held = held[n:]


def write_token_planes(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int | None = None, block_ids: int = 65_536, kind: str = "byte", level: int = 3, file_chunks: int = 256) -> None:
    """Tokenize ``text`` of each row, append ``end_id``, and write the ids in
    ascending doc_id order: files in the order of their numbers, documents in order
    within a file. Null texts count as empty, null doc_ids come first, rows with
    the same doc_id are ordered by a hash of their text, other columns are left out.

    A range of doc_ids is cut by rows, also among repeated rows, and its task begins
    another file after ``file_chunks`` chunks, so neither task nor file grows with the
    rows of a doc_id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = text_encoder(tokenizer_path), FileWriter(block_ids, kind, level, file_chunks)
        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode_documents(part.column(1), end_id).to_pylist(), strict=True):
                    records = list(writer.add(doc_id, np.frombuffer(raw, dtype="<u4")))
                    if writer.full:
                        records += writer.close()
                        writer = FileWriter(block_ids, kind, level, file_chunks)
                    for record in records:
                        yield pa.record_batch([pa.array([record], pa.binary())], ["record"])
        if writer.ids:
            for record in writer.close():
                yield pa.record_batch([pa.array([record], pa.binary())], ["record"])

    order = ["doc_id", "text_hash"]
    spread = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    spread = spread.repartitionByRange(files, *order, "row") if files else spread.repartitionByRange(*order, "row")
    records = spread.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(releasing(encode), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", file_chunks + 2).text(path)


DOCUMENTS = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_token_planes(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document: file, doc_id, local_start (ids before it in its file),
    n_tokens and ids (little-endian unsigned 32-bit), or, with ``digest``, the
    unsigned crc32 of those bytes as ids_crc32."""
    fields = [*DOCUMENTS.fields[:4], T.StructField("ids_crc32", T.LongType()) if digest else DOCUMENTS.fields[4]]
    schema = T.StructType(fields)

    def flush(file: str, rows: list) -> pa.RecordBatch:
        columns = [pa.array([file] * len(rows), pa.string())]
        columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()))]
        return pa.record_batch(columns, schema.fieldNames())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, start, held = [], 0, 0
                for doc_id, ids in FileReader(content.as_buffer()).documents():
                    raw = ids.tobytes()
                    rows.append((doc_id, start, len(ids), zlib.crc32(raw) if digest else raw))
                    start += len(ids)
                    held += 8 if digest else len(raw)
                    if len(rows) >= 4096 or held >= 8_000_000:
                        yield flush(file, rows)
                        rows, held = [], 0
                if rows:
                    yield flush(file, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInArrow(releasing(decode), schema)


def with_global_start(documents: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents in earlier files and before it in its
    own. Files follow each other by task and then by number in the task; their sizes are
    one row each, so the running sum and the join are small whatever the number of
    documents."""
    number = [F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", k).cast("long") for k in (1, 2)]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    sizes = documents.groupBy("file").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    bases = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return documents.join(bases, "file").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def token_plane_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **layout) -> DataFrame:
    """Write ``docs`` in the format above to the shared scratch folder, read the
    files back, and return doc_id, start, n_tokens and ids_crc32 per document.

    An empty table gives no rows; null texts are empty texts (their one id is the end
    id); repeated rows are separate documents.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-planes")
    write_token_planes(docs, path, tokenizer_path, end_id, **layout)
    stored = materialize(read_token_planes(spark, path, digest=True), "token-plane-digests")
    return with_global_start(stored).select("doc_id", "start", "n_tokens", "ids_crc32")
