"""Secrets in texts and in what is encoded in them.

Each text is a worklist of layers. A layer is searched for secrets, and then unwrapped:
URL and Unicode escapes give the layer with all of them decoded, a base64 token gives a
layer of its own, and one of compressed bytes the inflated text. New layers join the
worklist until there is none that has not been seen with the same content at the same
place. Every layer keeps, for each of its characters, the part of the text that it came
from, so a secret in a layer has a span in the text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import releasing, slices

#: Kinds of secrets in their order, their patterns and least lengths (of
#: the second group for ``assign``).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of [0-9a-f]+ of 32 or more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: What a text has if it holds a secret or an encoded part; one that lacks all is done.
MAY_ASSIGN = r"(?i)password|passwd|secret|token|api_?key"
MAY_HEX = r"[0-9a-f]{32}"
MAY_BE_CODED = r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{16}"

#: Escaped layers that are searched one by one; escapes nested deeper are undone at once.
LEVELS = 8
#: Characters of a base64 token, and bytes of an inflated layer, that are looked at.
LEAST_BASE64, MOST_INFLATED = 16, 16 << 20

ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|\\u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})|\\u(?P<u>[0-9A-Fa-f]{4})|\\u\{(?P<b>[0-9A-Fa-f]{1,6})\}|\\x(?P<x>[0-9A-Fa-f]{2})|&#(?P<d>[0-9]{1,7});|&#[xX](?P<h>[0-9A-Fa-f]{1,6});"
)
#: Escapes of one ASCII character that end where the text ends.
LAST_ESCAPE = re.compile(r"(?:%(?P<url>[0-7][0-9A-Fa-f])|\\u00(?P<u>[0-7][0-9A-Fa-f])|\\u\{0{0,4}(?P<b>[0-7]?[0-9A-Fa-f])\}|\\x(?P<x>[0-7][0-9A-Fa-f])|&#0{0,4}(?P<d>[0-9]{1,3});|&#[xX]0{0,4}(?P<h>[0-7]?[0-9A-Fa-f]);)\Z")
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}={{0,2}}")
PART = re.compile(rf"[A-Za-z0-9]{{{LEAST_BASE64},}}={{0,2}}")
URL_SAFE = str.maketrans("-_", "+/")


def secrets_in(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every secret that stands plainly in a text: for each kind
    the leftmost matches that don't overlap, without those that are too short."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(2, *m.span()) for m in HEX.finditer(text)]


@dataclass(frozen=True)
class Layer:
    """A decoded text; its character k came from places[0][k] up to places[1][k] of the
    whole text (None: from k). ``path`` names the decoders, ``levels`` counts the last
    ones that were escapes."""

    text: str
    places: tuple[np.ndarray, np.ndarray] | None = None
    path: tuple[str, ...] = ()
    levels: int = 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The part of the whole text that characters start to end - 1 came from."""
        if self.places is None:
            return start, end
        return int(self.places[0][start:end].min()), int(self.places[1][start:end].max())

    def inner(self, text: str, starts: np.ndarray, ends: np.ndarray, name: str, levels: int = 0) -> Layer:
        """A layer of which each character came from starts to ends - 1 of this one."""
        if self.places is not None:
            starts, ends = self.places[0][starts], self.places[1][ends - 1]
        return Layer(text, (starts.astype(np.int32), ends.astype(np.int32)), (*self.path, name), levels)

    def key(self) -> tuple:
        """What tells a layer from others: its content and place."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *self.span(0, len(self.text))


def _character(code: int) -> str:
    return "" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _decoded(match: re.Match) -> list[tuple[str, int, int]]:
    """(character, start, end) of what an escape stands for; bytes and numbers that are
    no characters stay as they are."""
    start, end = match.span()
    if match["url"] is None:
        code = 0x10000 + ((int(match["high"], 16) & 0x3FF) << 10) + (int(match["low"], 16) & 0x3FF) if match["high"] else int(match["d"]) if match["d"] else int(match["u"] or match["b"] or match["x"] or match["h"], 16)
        made = _character(code)
        return [(made, start, end)] if made else [(c, start + k, start + k + 1) for k, c in enumerate(match.group())]
    raw = bytes.fromhex(match["url"].replace("%", ""))
    try:
        out, at = [], start
        for c in raw.decode():
            out.append((c, at, at := at + 3 * len(c.encode())))
        return out
    except UnicodeDecodeError:
        out = []
        for k, byte in enumerate(raw):
            at = start + 3 * k
            out += [(chr(byte), at, at + 3)] if byte < 128 else [(c, at + i, at + i + 1) for i, c in enumerate(match.group()[3 * k : 3 * k + 3])]
        return out


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its URL and Unicode escapes decoded once."""
    text, at = layer.text, 0
    pieces: list[str] = []
    runs: list[tuple[int, int, int]] = []  # characters, where the first is from, and of how many each is made
    names = set()
    for match in ESCAPE.finditer(text):
        made = _decoded(match)
        if "".join(c for c, _, _ in made) == match.group():
            continue
        names.add("url" if match["url"] else "unicode")
        pieces += [text[at : match.start()], *[c for c, _, _ in made]]
        runs += [(match.start() - at, at, 1), *[(1, s, e - s) for _, s, e in made]]
        at = match.end()
    if not names:
        return None
    n, first, width = np.array([*runs, (len(text) - at, at, 1)], dtype=np.int64).T
    starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return layer.inner("".join([*pieces, text[at:]]), starts, starts + np.repeat(width, n), "|".join(sorted(names)), layer.levels + 1)


def collapsed(layer: Layer) -> Layer:
    """The layer with its escapes of ASCII characters decoded until none is left, in one
    pass: what an escape gives may be the start or the end of another."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for k, c in enumerate(layer.text):
        start, end = k, k + 1
        while True:
            out.append(c)
            starts.append(start)
            ends.append(end)
            if c not in "0123456789abcdefABCDEF;}":
                break
            match = LAST_ESCAPE.search("".join(out[-10:]))
            code = -1 if match is None else int(match["d"]) if match["d"] else int(match["url"] or match["u"] or match["b"] or match["x"] or match["h"], 16)
            if not 0 <= code < 128:
                break
            first = len(out) - (match.end() - match.start())
            c, start = chr(code), starts[first]
            del out[first:], starts[first:], ends[first:]
    return layer.inner("".join(out), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), "nested", layer.levels + 1)


class TooLarge(ValueError):
    """More bytes than a layer may have."""


def inflated(raw: bytes, most: int = MOST_INFLATED) -> bytes | None:
    """The content of gzip, zlib, zstandard, bzip2 or xz bytes; None if they are none."""
    try:
        if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and raw[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
            out, rest, size = [], raw, 0
            while True:
                member = zlib.decompressobj(47)
                out.append(member.decompress(rest, most + 1 - size))
                size += len(out[-1])
                if size > most:
                    raise TooLarge
                if not member.eof:
                    return None
                rest = member.unused_data
                if rest[:2] != b"\x1f\x8b":
                    return b"".join(out)
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            out = zstandard.ZstdDecompressor(max_window_size=most).stream_reader(raw).read(most + 1)
        elif raw[:3] == b"BZh":
            out = bz2.BZ2Decompressor().decompress(raw, most + 1)
        elif raw[:6] == b"\xfd7zXZ\x00":
            out = lzma.LZMADecompressor(memlimit=4 * most).decompress(raw, most + 1)
        else:
            return None
    except (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError):
        return None
    if len(out) > most:
        raise TooLarge
    return out


def _as_text(raw: bytes) -> str | None:
    """UTF-8 without control characters other than white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and "".join(text.split()).isprintable() else None


def _from_base64(layer: Layer, start: int, end: int) -> Iterator[Layer | tuple[int, int]]:
    """The layer that a token holds, if it holds one; its span, if that is too large."""
    token = layer.text[start:end].rstrip("=").translate(URL_SAFE)
    token = token[: len(token) - (len(token) % 4 == 1)]
    raw = binascii.a2b_base64(token + "=" * (-len(token) % 4))
    names, seen, packed = ["base64"], set(), False
    try:
        while (more := inflated(raw)) is not None and hashlib.sha256(raw).digest() not in seen:
            seen.add(hashlib.sha256(raw).digest())
            names, raw, packed = [*names, "compressed"], more, True
    except TooLarge:
        yield layer.span(start, end)
        return
    text = _as_text(raw)
    if text is None:
        return
    n = len(text)
    if packed:
        starts, ends = np.full(n, start), np.full(n, end)
    else:
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        upto = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
        before = np.concatenate([[0], upto[:-1]])
        starts, ends = start + 4 * (before // 3), np.minimum(start - 4 * (-upto // 3), end)
    yield layer.inner(text, starts, ends, "+".join(names))


def inner_layers(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """The layers that are directly in this one, and spans of those that are too large."""
    if layer.levels <= LEVELS:
        found = unescaped(layer)
        if found is not None:
            yield found if layer.levels < LEVELS else unescaped(deep := collapsed(layer)) or deep
    for match in BASE64.finditer(layer.text):
        found = list(_from_base64(layer, *match.span()))
        if not found:  # a token beside other characters of the alphabet, as in a path
            parts = [p.span() for p in PART.finditer(layer.text, *match.span())]
            found = [x for part in parts if part != match.span() for x in _from_base64(layer, *part)]
        yield from found


def scan(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, layers, secret) of every secret of a text and of its layers, by
    start, kind and end. ``layers`` is empty for those that stand in the text itself; one
    in a layer is left out if it is one of an outer layer, too. An inflated layer of more
    than ``MOST_INFLATED`` bytes is not searched; its place has the kind ``unread``."""
    found: dict[tuple[str, int, int], tuple[str, str]] = {}
    seen, work = set(), deque([Layer(text)])
    while work:
        layer = work.popleft()
        for kind, start, end in secrets_in(layer.text):
            found.setdefault((KINDS[kind], *layer.span(start, end)), ("/".join(layer.path), layer.text[start:end]))
        for inner in inner_layers(layer):
            if isinstance(inner, tuple):
                found.setdefault(("unread", *inner), ("/".join([*layer.path, "base64+compressed"]), ""))
            elif (key := inner.key()) not in seen:
                seen.add(key)
                work.append(inner)
    order = [*KINDS, "unread"]
    return sorted(((kind, start, end, *more) for (kind, start, end), more in found.items()), key=lambda s: (s[1], order.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string()), ("secret", pa.string())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in slices(batch, 1)):
        texts = pc.fill_null(part.column(1), "")
        may = pc.or_(pc.or_(pc.match_substring_regex(texts, MAY_ASSIGN), pc.match_substring(texts, "AKIA")), pc.or_(pc.match_substring_regex(texts, MAY_HEX), pc.match_substring_regex(texts, MAY_BE_CODED)))
        names = [f.name for f in SPANS.value_type]
        rows = [[dict(zip(names, s, strict=True)) for s in scan(texts[k].as_py())] if any_ else [] for k, any_ in enumerate(may.to_pylist())]
        yield pa.record_batch([part.column(0), pa.array(rows, SPANS)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, the secrets of its whole text and of
    all layers in it, as :func:`scan` gives them; places count code points.

    Null and empty texts have none; repeated rows stay; an empty table gives no rows;
    other columns are left out. Work is linear in a text, for layers shrink, but for
    inflated ones, which are bounded, and escapes nested in more than ``LEVELS`` levels,
    which are undone in one pass.
    """
    kind = "array<struct<kind:string,start:long,end:long,layers:string,secret:string>>"
    return docs.select("doc_id", "text").mapInArrow(releasing(_scanned), f"doc_id long, spans {kind}")


def secret_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of the spans that stand in the
    texts themselves, spans (all of them, as ``kind:start:end``, those of layers as
    ``kind@layers:start:end``) and n_layered."""
    plain = F.filter("spans", lambda s: s["layers"] == "")
    joined = lambda spans, name: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter(plain, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    named = lambda s: F.when(s["layers"] == "", s["kind"]).otherwise(F.concat_ws("@", s["kind"], s["layers"]))
    base = F.sha2(joined(plain, lambda s: s["kind"]).cast("binary"), 256)
    return scanned.select("doc_id", *counts, base.alias("base_sha256"), joined(F.col("spans"), named).alias("spans"), (F.size("spans") - F.size(plain)).cast("long").alias("n_layered"))
