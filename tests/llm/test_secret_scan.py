"""Secrets in texts and in their layers."""

import base64
import bz2
import gzip
import hashlib
import random
import time
import urllib.parse
import zlib

import pytest

from millrace.llm import queries, secret_scan

SECRET = "password = hunter2hunter2"


def plain(text):
    """The base spans by hand: characters are walked, no pattern is used."""
    low, out, n = "".join(c.lower() if c.isascii() else c for c in text), [], len(text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    k = 0
    while k < n:
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, k)), None)
        if word:
            at = k + len(word)
            at += at < n and text[at] in "\"'"
            while at < n and text[at] == " ":
                at += 1
            if at < n and text[at] in ":=":
                at += 1
                while at < n and text[at] == " ":
                    at += 1
                at += at < n and text[at] in "\"'"
                end = at
                while end < n and text[end] in value:
                    end += 1
                if end > at:
                    out += [("assign", k, end)] if end - at >= 8 else []
                    k = end
                    continue
        k += 1
    for kind, begin, alphabet, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        k = 0
        while k < n:
            end = k + len(begin) if text.startswith(begin, k) else k
            if end > k or not begin and text[k] in alphabet:
                first = end
                while end < n and text[end] in alphabet:
                    end += 1
                if end > first:
                    out += [(kind, k, end)] if end - k >= least else []
                    k = end
                    continue
            k += 1
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_the_query_against_a_walk_over_characters(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op12_secrets(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        spans, got = plain(row.text or ""), found[row.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[0] == k for s in spans) for k in secret_scan.KINDS)
        assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got.spans.split(",")) and len([s for s in got.spans.split(",") if s]) == len(spans) + got.n_layered
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found.values()) > 3


def test_random_texts_against_a_walk_over_characters():
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", ":", "=", " ", "  ", '"', "'", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "Z9", "é", "\n", "+/_.=-"]
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [s[:3] for s in secret_scan.scan(text) if not s[3]] == plain(text), text


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize(
    ("coded", "layers"),
    [
        (urllib.parse.quote(SECRET, safe=""), "url"),
        (urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""), "url/url"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode"),
        ("".join(f"&#x{ord(c):x};" for c in SECRET), "unicode"),
        (b64(SECRET), "base64"),
        (b64(b64(SECRET)), "base64/base64"),
        (b64(gzip.compress(SECRET.encode())), "base64+compressed"),
        (b64(gzip.compress(SECRET[:9].encode()) + gzip.compress(SECRET[9:].encode())), "base64+compressed"),
        (b64(bz2.compress(zlib.compress(SECRET.encode()))), "base64+compressed+compressed"),
        (b64(gzip.compress(b64(SECRET).encode())), "base64+compressed/base64"),
        ("".join(f"%{ord(c):02x}" for c in b64(zlib.compress(SECRET.encode()))), "url/base64+compressed"),
        (b64(urllib.parse.quote(SECRET, safe="")), "base64/url"),
    ],
)
def test_layers(coded, layers):
    text = f"Été: {coded} and more"
    (found,) = [s for s in secret_scan.scan(text) if s[4].startswith("password") and s[3] == layers]
    kind, start, end, _, secret = found
    assert (kind, secret) == ("assign", SECRET)
    assert 5 <= start < end <= 5 + len(coded) and len(text[start:end]) >= 10


def test_spans_of_parts_of_tokens():
    lead = "some words before it; "
    for shift in range(4):
        text = "x " + b64(lead + "y" * shift + SECRET + " tail words")
        (found,) = [s for s in secret_scan.scan(text) if s[3] == "base64"]
        inner = base64.b64decode(text[found[1] : found[2]])
        assert (found[1] - 2) % 4 == 0 and SECRET.encode() in inner and len(inner) <= len(SECRET) + 4
    text = "id=é%20" + urllib.parse.quote(SECRET + "é", safe="")
    (found,) = [s for s in secret_scan.scan(text) if s[3] == "url"]
    assert text[found[1] : found[2]] == urllib.parse.quote(SECRET, safe="")


def test_a_secret_of_an_outer_layer_is_told_once():
    assert [s[:4] for s in secret_scan.scan(f"{SECRET} %41%42")] == [("assign", 0, 25, "")]


def test_layers_that_hold_themselves_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "inner_layers", lambda layer: [secret_scan.Layer(layer.text, layer.places, (*layer.path, "again"))])
    assert [s[:3] for s in secret_scan.scan(SECRET)] == [("assign", 0, 25)]
    monkeypatch.undo()
    loop = b"\x1f\x8bself"
    monkeypatch.setattr(secret_scan, "inflated", lambda raw: loop)
    assert secret_scan.scan(b64(loop) * 4) == []


def test_deep_nesting_is_linear():
    began = time.monotonic()
    found = secret_scan.scan("password%" + "25" * 100_000 + "3Dhunter2hunter2")
    assert ("assign", 0, 200_025) in [s[:3] for s in found if s[0] == "assign"]
    mixed = "password=x"
    for _ in range(30):
        mixed = mixed.replace("%", "\\u0025").replace("\\", "%5c").replace("=", "%3d")
    assert len(secret_scan.scan(mixed + "y" * 12)) == 1
    assert len(secret_scan.scan("%41 " * 200_000)) == 0
    assert time.monotonic() - began < 30


def test_large_inflated_layers_are_told():
    bomb = b64(gzip.compress(b"a" * (secret_scan.MOST_INFLATED + 1)))
    assert [s[:3] for s in secret_scan.scan(f"z {bomb}") if s[0] == "unread"] == [("unread", 2, 2 + len(bomb))]
    assert secret_scan.inflated(gzip.compress(b"abc")[:-3]) is None and secret_scan.inflated(b"plain") is None


def test_odd_rows(spark, odd, clashing, empty):
    def digests(docs):
        return sorted([tuple(r) for r in secret_scan.secret_digests(secret_scan.scan_secrets(docs)).collect()], key=repr)

    found = digests(odd)
    assert len(found) == odd.count() and digests(clashing) == found and digests(empty) == []
    none = hashlib.sha256(b"").hexdigest()
    assert all(r[1:] == (0, 0, 0, none, "", 0) for r in found if r[0] in (None, 3, 4, 5))
    two = spark.createDataFrame([(1, f"{SECRET} {b64(SECRET)}")] * 2, "doc_id long, text string")
    assert len({tuple(r) for r in digests(two)}) == 1 and digests(two)[0][1] == 1 and "assign@base64:" in digests(two)[0][5]
