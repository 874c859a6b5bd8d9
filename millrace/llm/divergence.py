"""Divergence of the sources of a language, by a systolic rotation of their term vectors.

Terms are counted by (language, source); those in enough documents of a language are
kept. The vectors of a language's sources are cut into chunks of terms and dealt to a
ring of stations: a cell holds a chunk of the vectors of one station's sources. Cells
stay where they are. In every round of a round-robin tournament half of the stations
send their compressed cells to the station that they meet, which works out the
divergence of each of its sources from each guest and of the guest from it. So after
stations - 1 rounds, and one in which every station looks at its own sources, each two
sources of a language have met once in each chunk, and sums over chunks are the results.

Shares are whole parts of a thousand million, p = 1 + floor(10^9 (count + 1) / (N + V))
for a group that has N occurrences of the V kept terms, and the divergence of p from q
is the sum of floor((p - q)^2 / q) over terms, all in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize, releasing, slices, split_words

PARTS = 1_000_000_000
STATIONS = 8

#: A-Z in lower case; all other ASCII but a-z ends a term.
_FOLD = np.array([k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k > 127 else 32 for k in range(256)], dtype=np.uint8)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with their terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in lower case
    (A-Z only) and spaces for all else; nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_FOLD[raw]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of (lang, source, text), by slices; each
    group has a row without a term."""
    for part in (part for batch in batches for part in slices(batch, 2)):
        langs, sources = (part.column(k).cast(pa.string()).dictionary_encode() for k in (0, 1))
        groups, of = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
        words = split_words(folded(part.column(2)))
        w = max(1, len(words.distinct))
        owner = np.repeat(np.arange(part.num_rows), np.diff(words.ends, prepend=0))
        seen, times = np.unique(owner * w + words.which, return_counts=True)
        keys, at = np.unique(of[seen // w] * w + seen % w, return_inverse=True)
        n = np.bincount(at, times, len(keys)).astype(np.int64)  # below 2^53
        held = groups[np.concatenate([keys // w, np.arange(len(groups))])]
        blank = pa.nulls(len(groups), pa.string())
        terms = pa.concat_arrays([words.distinct.take(pa.array(keys % w)), blank])
        zeros = np.zeros(len(groups), np.int64)
        yield pa.record_batch(
            [langs.dictionary.take(pa.array(held // len(sources.dictionary))), sources.dictionary.take(pa.array(held % len(sources.dictionary))), terms, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([np.bincount(at, minlength=len(keys)), zeros]))],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it. A
    row without a term stands for each group."""
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    partial = known.mapInArrow(releasing(_counted), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, mass: int) -> np.ndarray:
    """Shares of a group with these counts, out of ``mass`` = N + V."""
    if len(counts) and int(counts.max()) + 1 >= (1 << 63) // PARTS:
        return (1 + PARTS * (counts.astype(object) + 1) // mass).astype(np.int64)
    return 1 + PARTS * (counts + 1) // mass


def divergence(p, q):
    return (p - q) ** 2 // q


@dataclass(frozen=True)
class Cell:
    """A chunk of the vectors of one station's sources: for each its name, its mass
    N + V, and the places and counts of the chunk's terms that it has."""

    sources: list[str]
    masses: list[int]
    places: list[np.ndarray]
    counts: list[np.ndarray]

    def pack(self) -> bytes:
        steps = [np.diff(p, prepend=0).astype(np.int32) for p in self.places]
        table = pa.record_batch([pa.array(self.sources, pa.string()), pa.array(self.masses, pa.int64()), pa.array(steps, pa.list_(pa.int32())), pa.array(self.counts, pa.list_(pa.int64()))], ["source", "mass", "steps", "counts"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(payload: bytes) -> Cell:
        rows = pa.ipc.open_stream(payload).read_next_batch()
        lists = lambda k: [x.values.to_numpy() for x in rows.column(k)]
        return Cell(rows.column(0).to_pylist(), rows.column(1).to_pylist(), [np.cumsum(s, dtype=np.int64) for s in lists(2)], lists(3))


def meet(home: Cell, guest: Cell | None, size: int) -> Iterator[tuple[str, str, int]]:
    """(source, item, value) over a chunk of ``size`` terms for each source of ``home``
    and each guest, and the other way round; without guests, for the sources at home.
    Terms that neither has are reckoned all at once."""
    peers, own = (home, True) if guest is None else (guest, False)
    there = np.zeros(size, bool)
    vectors = [shares(c, m) if size else c for c, m in zip(peers.counts, peers.masses, strict=True)]
    for i, name in enumerate(home.sources):
        if size:
            absent = 1 + PARTS // home.masses[i]
            whole = np.full(size, absent)
            whole[home.places[i]] = shares(home.counts[i], home.masses[i])
        for j in range(i + 1 if own else 0, len(peers.sources)):
            forth = back = 0
            if size:
                at, q, lacks = peers.places[j], vectors[j], 1 + PARTS // peers.masses[j]
                there[at] = True
                p, rest = whole[at], whole[home.places[i][~there[home.places[i]]]]
                there[at] = False
                neither = size - len(at) - len(rest)
                forth = int(divergence(p, q).sum() + divergence(rest, lacks).sum()) + neither * divergence(absent, lacks)
                back = int(divergence(q, p).sum() + divergence(lacks, rest).sum()) + neither * divergence(lacks, absent)
            yield name, peers.sources[j], forth
            yield peers.sources[j], name, back


def tournament(stations: int) -> list[list[tuple[int, int]]]:
    """Rounds in which each of an even number of stations meets another, all pairs once."""
    ring, out = list(range(stations)), []
    for _ in range(stations - 1):
        out.append([(ring[k], ring[-1 - k]) for k in range(stations // 2)])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


CELLS = "lang string, chunk int, station int, size int, payload binary, source string, item string, value long"


def _cells(top: int):
    """From all rows of a (lang, chunk): its cells, and of each group the ``top`` terms
    with a share above the language's, by divergence and then by term."""

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        lang, chunk = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        listed = pc.is_null(rows["term"])
        roster, entries = rows.filter(listed).sort_by("source"), rows.filter(pc.invert(listed))
        names, masses, station = roster["source"], roster["mass"].to_pylist(), roster["station"].to_numpy()
        coded = entries["term"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, n = place[coded.indices.to_numpy()], entries["n"].to_numpy()
        who = pc.index_in(entries["source"], names.combine_chunks()).to_numpy()
        by = np.lexsort((term, who))
        term, n, who, lang_n = term[by], n[by], who[by], entries["lang_n"].to_numpy()[by]
        ends = np.searchsorted(who, np.arange(len(names) + 1))

        out = []
        for s in np.unique(station).tolist():
            at = np.flatnonzero(station == s).tolist()
            cell = Cell([names[k].as_py() for k in at], [masses[k] for k in at], [term[ends[k] : ends[k + 1]] for k in at], [n[ends[k] : ends[k + 1]] for k in at])
            out.append((lang, chunk, s, len(order), cell.pack(), None, None, None))
        if len(order):
            q, mass = shares(lang_n, roster["lang_mass"][0].as_py()), coded.dictionary.take(pa.array(order))
            for k in range(len(names)):
                mine = slice(ends[k], ends[k + 1])
                p = shares(n[mine], masses[k])
                more = np.flatnonzero(p > q[mine])
                value = divergence(p[more], q[mine][more])
                best = np.lexsort((term[mine][more], -value))[:top]
                terms = mass.take(pa.array(term[mine][more][best])).to_pylist()
                out += [(lang, chunk, None, None, None, names[k].as_py(), t, v) for t, v in zip(terms, value[best].tolist(), strict=True)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in CELLS.split(", ")])

    return made


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, size, payload, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = list(meet(Cell.unpack(payload), Cell.unpack(guest) if guest is not None else None, size))
            if found:
                source, item, value = zip(*found, strict=True)
                yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, stations: int = STATIONS, cell_entries: int = 250_000, least_chunks: int = 16) -> DataFrame:
    """Divergence of each (lang, source) of ``docs`` from the other sources of its
    language, and the terms that it has more of than the language.

    Columns lang, source, part, item, value, rank. Part ``pair``: item is each other
    source of the language, value the divergence from it over all kept terms. Part
    ``term``: the first ``top`` terms with a share above the language's, value their
    summand. Ranks count from 1 by falling value, then by item in the order of UTF-8.

    Null langs, sources and texts are empty strings; a group without terms has its pairs;
    in a language that keeps no term all values are 0; a language of one source has no
    pairs; repeated rows are documents of their own; other columns are left out; an empty
    table gives no rows. A term's rows are summed by tasks before they are shuffled, and a
    source of any size is spread over chunks of terms, about ``cell_entries`` counts of a
    language each; only the number of chunks goes to the driver.
    """
    spark = docs.sparkSession
    counts = materialize(term_counts(docs), "divergence-counts")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = materialize(terms.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    kept = materialize(counts.where("term IS NOT NULL").drop("docs").join(terms, ["lang", "term"]), "divergence-kept")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    chunks = max(least_chunks, -(-most // cell_entries))

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero: Column = F.lit(0).cast("long")
    mass = lambda total: (F.coalesce(total, zero) + F.coalesce("v", zero)).cast("long")
    roster = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), zero.alias("n"), zero.alias("lang_n"), mass("total").alias("mass"), mass("lang_total").alias("lang_mass"), F.pmod(F.xxhash64("source"), F.lit(stations)).cast("int").alias("station"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    entries = kept.select("lang", "source", "term", "n", "lang_n", zero.alias("mass"), zero.alias("lang_mass"), F.lit(0).alias("station"), F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"))
    stored = materialize(entries.unionByName(roster).groupBy("lang", "chunk").applyInArrow(_cells(top), CELLS), "divergence-cells")

    cells = stored.where("payload IS NOT NULL").select("lang", "chunk", "station", "size", "payload")
    home = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "chunk", "station").persist(StorageLevel.DISK_ONLY)
    meetings = home.select("lang", "size", "payload", F.lit(None).cast("binary").alias("guest"))
    for pairs in tournament(stations):
        host = F.create_map(*[F.lit(x) for stays, goes in pairs for x in (goes, stays)])
        guests = cells.where(F.col("station").isin([goes for _, goes in pairs])).select("lang", "chunk", host[F.col("station")].alias("station"), F.col("payload").alias("guest"))
        meetings = meetings.unionByName(home.join(guests, ["lang", "chunk", "station"]).select("lang", "size", "payload", "guest"))
    values = meetings.mapInArrow(releasing(_met), "lang string, source string, item string, value long")
    values = values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    heads = stored.where("payload IS NULL").select("lang", "source", "item", "value")
    result = materialize(_ranked(values, "pair").unionByName(_ranked(heads, "term", top)), "divergence")
    home.unpersist()
    discard(counts, terms, kept, stored)
    return result


def oracle(least_docs: int = 3, top: int = 200) -> str:
    """:func:`audit_sources` over ``documents`` in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"1 + ({PARTS} * ({n} + 1)) // ({total} + v)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), terms AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {least_docs}
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM terms GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN terms t ON w.lang = t.lang AND w.term = t.term GROUP BY ALL
), totals AS (
  SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL
), vectors AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "coalesce(s.total, 0)")} AS p, {share("t.n", "l.total")} AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN terms t ON t.lang = g.lang
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), met AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM vectors a JOIN vectors b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM vectors WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
