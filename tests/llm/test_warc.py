import gzip
import hashlib

import pytest

from millrace.llm import warc

BIG = "<html>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\n</html>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, "http://b/7", BIG), (7, "http://b/7", BIG), (3, None, "small"), (4, "http://x/\r\ny", "small"), (5, "http://c", None), (6, "http://d", ""), (None, "http://e", BIG), (8, "http://f", "x" * 999), (9, "http://f", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000)]
SCHEMA = "page_id long, url string, html string"


def brute(pages):
    largest, out = {}, []
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != largest[h or ""]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", largest[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=repr) == brute(PAGES)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert warc.archive_round_trip(pages.selectExpr("*", "'x' AS record_type", "1 AS salt")).count() == len(PAGES)


def test_archives_are_ordinary_files(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), path, bundle_bytes=2500, bundles_per_file=2)
    files = sorted((tmp_path / "warc").glob("part-*.gz"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) > 3 and max(sizes) <= 2 * (2500 + 2500)
    records = [r for f in files for r in warc.parse_records(gzip.decompress(f.read_bytes()))]
    assert [h["warc-type"][0] for h, _ in records].count("request") == len(PAGES)
    captures = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(captures) == len(PAGES)
    for c in captures:
        assert c.request.fields is None and c.metadata.fields.startswith("page-id:")
        assert (c.warc_type == "response") == (c.payload is not None)
        assert c.payload is None or hashlib.sha1(c.payload).hexdigest() == c.payload_digest
    targets = {c.record_id for c in captures if c.warc_type == "response"}
    assert all(c.refers_to in targets for c in captures if c.warc_type == "revisit")


def test_very_long_pages(spark):
    pages = [(1, "u", "é" * 3_000_000), (2, "v", "é" * 3_000_000), (3, "w", "x\r\n\r\n" * 400_000)]
    found = warc.archive_round_trip(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(pages)


def test_clashing_columns(spark):
    names = ["record_type", "salt", "payload_bytes", "payload_digest", "refers_to", "target", "value", "fields", "warc_type", "metadata", "_copy"]
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", *[f"'x' AS {n}" for n in names])
    assert sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=repr) == brute(PAGES)


def test_inflating_in_pieces():
    bodies = [b"k: " + bytes([65 + k]) * n for k, n in enumerate((0, 1, 70_000, 300_000, 5))]
    whole = [record("metadata", f"<{k}>", b) for k, b in enumerate(bodies)]
    for content in (b"".join(whole), gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        assert [b for _, b in warc.parse_records(content)] == bodies
    for cut in (20, 400):
        with pytest.raises(ValueError):
            list(warc.parse_records(gzip.compress(b"".join(whole))[:-cut]))


def record(kind, name, block, **more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-{k.replace('_', '-')}: {v}" for k, values in more.items() for v in ([values] if isinstance(values, str) else values)], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    whole = record("warcinfo", "<i>", b"software: z") + record("response", "<r>", http) + record("request", "<q>", b"GET /", Concurrent_To=["<r>", "<other>"]) + record("response", "<alone>", http)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (record("response", "<s>", http), record("metadata", "<m>", b"k: v", Concurrent_To="<s>"))))
    found = {}
    for name in ("a.warc", "b.warc.gz"):
        target = tmp_path / f"dir-{name}"
        target.mkdir()
        (target / f"part-{name}").write_bytes((tmp_path / name).read_bytes())
        found |= {c.record_id: c for c in warc.assemble(warc.read_archives(spark, str(target))).collect()}
    assert set(found) == {"<r>", "<alone>", "<s>"}
    assert found["<r>"].request.record_id == "<q>" and found["<r>"].metadata is None
    assert found["<alone>"].request is None and found["<s>"].metadata.fields == "k: v"


@pytest.mark.parametrize("damage", [lambda b: b[:-3], lambda b: b"junk" + b, lambda b: b.replace(b"Content-Length: 4", b"Content-Length: 3")])
def test_damaged_archives_raise(damage):
    with pytest.raises(ValueError):
        list(warc.parse_records(damage(record("metadata", "<m>", b"k: v"))))
