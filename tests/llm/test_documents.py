"""Operators with one row per document, against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from millrace.llm import jaccard, licenses, mixing, ogg, packing, quality, queries, sharding, token_planes, toxicity
from millrace.llm.common import TextEncoder, slices, split_words
from tests.llm.conftest import LONG, ODD
from tests.oracle import database, same

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(params=["odd", "clashing", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_queries_agree_with_their_oracles(spark, sf_dir, name):
    same(entry.queries()[name](spark, sf_dir).toPandas(), database(sf_dir).sql(entry.oracle_sql()[name]).df())


def test_every_query_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


# 1


def test_shards(docs):
    sharded = sharding.shard_records(docs)
    found = sharded.toPandas()
    expected = multiset((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(docs))
    assert multiset(tuple(r) for r in sharded.select("doc_id", "size", "text_crc32").collect()) == expected
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all() and found.shard.between(0, 15).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_shards_are_nearly_equal_whatever_the_texts(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.repeat(F.lit("z"), (F.xxhash64("id") % 400 + 400).cast("int"))).alias("text"))
    sizes = sharding.shard_records(rows, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(sizes) == 16 and sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()


def test_shards_are_nearly_equal_for_repeated_rows(spark):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    null = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    for rows in (same, null, same.unionByName(null)):
        found = sharding.shard_records(rows, shards=16).toPandas()
        sizes = found.groupby("shard")["size"].sum()
        assert len(sizes) == 16 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_ranges_that_stay_too_large(spark):
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(0).cast("long").alias("i"), F.col("id").alias("row"), F.lit(100).cast("long").alias("size"))
    with pytest.raises(RuntimeError, match="too large after 1 rounds"):
        sharding.choose_ranges(rows, 64, 4, seed=1, rounds=1)
    assert sharding.choose_ranges(rows, 64, 4, seed=1)[1]["bytes"].max() <= 1.5 * 400_000 / 64


def test_splitters_locate_like_a_sorted_list():
    rng = np.random.default_rng(1)
    keys = sorted({(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 5, (60, 3))})
    splitters = sharding.NONE.merged(np.array(keys[::3]))
    probe = rng.permutation(np.array(keys))
    assert splitters.locate(probe).tolist() == [sum(s <= tuple(k) for s in keys[::3]) for k in probe.tolist()]


def test_write_shards_of_null_and_repeated_ids(spark, clashing, tmp_path):
    """Every row once, with its columns, whatever its doc_id."""
    sharding.write_shards(clashing, str(tmp_path / "odd"), shards=3)
    found = spark.read.parquet(str(tmp_path / "odd"))
    assert Counter(map(tuple, found.select(*clashing.columns).collect())) == Counter(map(tuple, clashing.collect()))
    slots = defaultdict(list)
    for r in found.select("_shard", "slot").collect():
        slots[r[0]].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_write_shards(documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"), shards=4)
    stored = documents.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert multiset(texts(stored)) == multiset(texts(documents)) and stored.select("shard").distinct().count() == 4


# 2


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {p for k, w in enumerate(windows) if counts[w] > 1 for p in range(k, k + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)

    def fails(line):
        bare = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
        n, marks, loud = bare.count(" ") + 1, len(re.findall(quality.MARKS, bare)), bare.count("!!")
        flat = n >= 8 and not any(c in bare for c in ".,;:!?…")
        return bool(bare) and ((marks >= 2 and 4 * marks >= n) or (loud >= 2 and 3 * loud >= n) or flat or (n <= 24 and any(p in bare.lower() for p in quality.BOILERPLATE)))

    lost = sum(len(line) for line in text.split("\n") if fails(line))
    cleaned = "\n".join(line for line in text.split("\n") if not fails(line))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and not lost > 0.5 * len(text), cleaned


def test_quality(docs):
    judged = quality.judge_documents(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    found = multiset((r.doc_id, tuple(r[n] for n in names)) for r in judged.collect())
    assert found == multiset((d, (*brute_quality(t)[:7], None if t is None else brute_quality(t)[7])) for d, t in texts(docs))
    assert judged.where("kept").count() == sum(brute_quality(t)[6] for _, t in texts(docs))


def test_quality_has_no_python(documents, capsys):
    quality.judge_documents(documents).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_lines(spark):
    good, menu, loud, boiler, flat = "A plain sentence stands here.", "Home | About | Contact | Help", "BUY!! NOW!! CHEAP!!", "We accept cookies: read our Privacy Policy.", "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, "\n".join([good, menu, "", loud, boiler, flat, good + " Again."]))], "doc_id long, text string")
    row = quality.judge_documents(docs).first()
    assert row.cleaned == "\n".join([good, "", good + " Again."]) and (row.n_lines, row.n_lines_removed) == (7, 4)


def test_a_phrase_in_a_long_line(spark):
    words = " ".join(f"word{k}," for k in range(40))
    docs = spark.createDataFrame([(1, f"{words} read more in our privacy policy."), (2, f"{words}\nPlease read more in our privacy policy.")], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines_removed, r.kept) for r in quality.judge_documents(docs).collect()} == {1: (0, True), 2: (1, True)}


def test_verdicts_keep_columns_of_any_name(odd):
    docs = odd.selectExpr("*", "'x' AS _x", "'y' AS kept", "'z' AS c1", "'w' AS _verdict", "'v' AS _hashes", "1 AS n_words")
    found = quality.with_verdict(docs, "v").collect()
    assert Counter(tuple(r[:-1]) for r in found) == Counter(map(tuple, docs.collect()))
    assert quality.judge_documents(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "_x", "c1", "_verdict", "_hashes", *quality.RESULTS]


# 3


def test_ogg(docs):
    found = ogg.media_table(docs).collect()
    expected = []
    for d, t in texts(docs):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        expected.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert multiset(tuple(r[:5]) for r in found) == multiset(expected)
    by_text = defaultdict(set)
    for r in found:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def bitwise_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 191, 192, 959, 960, 961, 48_960, 65_025, 130_000])
def test_ogg_pages(n):
    payload, length = ogg.padded("é" * (n // 2) + "x" * (n % 2))
    media = ogg.encode(payload, length)
    assert ogg.decode(media)[:2] == (payload, length) == (payload, n)
    audio, track = ogg.demultiplex(media)
    times = ogg.packet_times(audio)
    assert times[-1][1] == len(payload) / ogg.RATE and all(a[1] == b[0] for a, b in zip(times, times[1:], strict=False))
    assert ogg.page_checksum(media[:300]) == bitwise_crc(media[:300])
    for at in range(0, len(media), max(1, len(media) // 40)):
        with pytest.raises(ValueError):
            ogg.decode(media[:at] + bytes([media[at] ^ 16]) + media[at + 1 :])
    for cut in (1, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.decode(media[:cut])


# 5


def encoded(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def all_encoded(encoder, texts, most=1 << 20):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    return [np.frombuffer(ids, "<u4").tolist() for part in slices(batch, 0, most) for ids in encoder.encode_documents(part.column(0), 9).to_pylist()]


@pytest.mark.parametrize("memo", [1 << 10, 1 << 16, 1 << 26])
def test_text_encoder(memo, documents):
    encoder = TextEncoder(VOCABULARY, memo)
    assert encoder.by_words
    some = [*(t for _, t in texts(documents)[:40]), *(r[1] for r in ODD), "a\x1cb \x85c", "İI ΑΣ. é é!", "it's 's. 'LL | x|y |", "NECATİ.", "EVİ, kedi", "abcİ?", LONG[:500]]
    assert all_encoded(encoder, some) == [encoded(t, 9) for t in some]


def test_text_encoder_of_random_texts():
    letters = [*"aAbBzZiIİıſKÅßΣσςéÉ'\"’.,;:!?|<>-_ \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2009\u3000\u200b\x00\x7f0129١٢ﬁǄǅ한가中文😀", *(chr(c) for c in (0x300, 0x301, 0x307, 0x308, 0x345, 0x1100, 0x1161)), "'s", "'ll", "<|endoftext|>", "İ.", "'T"]
    rng = np.random.default_rng(8)
    some = ["".join(rng.choice(letters, int(rng.integers(0, 24)))) for _ in range(50_000)]
    assert all_encoded(TextEncoder(VOCABULARY, 1 << 18), some, 20_000) == [encoded(t, 9) for t in some]
    marked = ["".join(rng.choice([*"aBzIK.,;:!?'\"|1é \n\x0b\x1c\u2028\xa0\u0307\u0338\u037e", ". ", "'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>"], int(rng.integers(0, 24)))) for _ in range(30_000)]
    assert all_encoded(TextEncoder(VOCABULARY, 1 << 18), marked, 20_000) == [encoded(t, 9) for t in marked]


def test_text_encoder_of_another_vocabulary():
    other = public_tokenizers.path("byte_bpe_50k.json")
    encoder, model = TextEncoder(other), Tokenizer.from_file(other)
    some = ["two  spaces\nand lines", None, "", " a b "]
    assert not encoder.by_words
    assert all_encoded(encoder, some) == [[*model.encode(t or "", add_special_tokens=False).ids, 9] for t in some]


def test_split_words():
    some = [None, "", " ", "a b\x0bc\x1cd", "\n e\u00a0f  g\r", "a"]
    words = split_words(pa.array(some))
    found = [[words.distinct[int(k)].as_py() for k in words.which[a:b]] for a, b in words.spans()]
    assert found == [WORD.findall(t or "") for t in some]


def test_packing_of_repeated_rows(spark):
    rows = spark.range(900).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    pieces = packing.pack_documents(rows, VOCABULARY, block_docs=100).toPandas()
    assert pieces.length.sum() == 900 * len(encoded("the same few words", 1))
    assert (pieces.sequence_id // 2**32).nunique() > 4


def test_packing(docs):
    pieces = packing.pack_documents(docs, VOCABULARY, with_ids=True).toPandas()
    sequences, padding = 0, 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        total = int(g.length.sum())
        assert total <= 2048
        sequences, padding = sequences + 1, padding + (0 if total & (total - 1) == 0 else 2048 - total)
    assert padding <= 2048
    assert all(zlib.crc32(ids) == c for ids, c in zip(pieces.ids, pieces.ids_crc32, strict=True))
    # Every id of every document in exactly one piece; copies have equal pieces or more.
    expected = Counter()
    for _, t in texts(docs):
        expected.update(encoded(t, 1))
    assert Counter(np.frombuffer(b"".join(pieces.ids), "<u4").tolist()) == expected
    whole = defaultdict(list)
    for row in pieces.itertuples():
        if row.doc_id == row.doc_id:
            whole[row.doc_id].append((row.start, row.ids))
    once = {d: t for d, t in texts(docs) if d is not None and [x for x, _ in texts(docs)].count(d) == 1}
    for d, t in list(once.items())[:60]:
        assert b"".join(ids for _, ids in sorted(whole[d])) == np.array(encoded(t, 1), "<u4").tobytes()


def test_pack_lengths():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        lengths = rng.integers(1, 5000, n).tolist()
        windows = packing.pack_lengths(lengths)
        covered = defaultdict(list)
        for tier, parts in windows:
            assert sum(p[2] for p in parts) <= tier
            for doc, start, length in parts:
                covered[doc].append((start, length))
        assert all(sum(c[1] for c in covered[d]) == x and all(a[0] + a[1] == b[0] for a, b in zip(sorted(covered[d]), sorted(covered[d])[1:], strict=False)) for d, x in enumerate(lengths))
        assert sum(sum(p[2] for p in parts) != tier for tier, parts in windows) <= 1
        groups = Counter()
        for (tier, _), g in zip(windows, packing.step_groups(windows, 2048, 8), strict=True):
            groups[g] += tier
        assert not groups or max(groups.values()) - min(groups.values()) <= 2048


# 6


def brute_components(rows, percent=80):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[a][0] == rows[b][0]:
                parent[find(a)] = find(b)
            elif sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    label = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            label[find(k)].append(d)
    return [(d, len(s), min(label[find(k)], default=None)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(spark):
    """Chains of edits, a shared passage, and copies of a third of all rows."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    passage, rows = words(80), []
    for base in range(12):
        text = words(int(rng.integers(30, 120)))
        for _ in range(6):
            rows.append(" ".join(text))
            text = list(text)
            text[int(rng.integers(len(text)))] = "Edit"
    rows += [" ".join(words(40) + passage + words(40)) for _ in range(20)]
    rows += [" ".join(passage + words(5)) for _ in range(20)]
    rows += ["one hot text that very many rows hold as it is"] * 56
    return spark.createDataFrame([(k * 3 % 997, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"hot_from": 3, "block": 4}, {"hot_from": 2, "most_hot": 20, "block": 1}])
def test_jaccard_of_planted_copies(spark, options):
    docs = near_copies(spark)
    found = jaccard.jaccard_components(docs, **options)
    assert multiset(tuple(r) for r in found.collect()) == multiset(brute_components(texts(docs)))


def test_jaccard(docs):
    found = jaccard.jaccard_components(docs)
    assert multiset(tuple(r) for r in found.collect()) == multiset(brute_components(texts(docs)))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 300), (7, 3)]
    found = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 160)}


def test_components_that_have_not_settled(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        jaccard.components(chain, rounds=2)


# 7


def test_licenses(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    expected = []
    for d, t in texts(docs):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, v) for p, v in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        starts = [k for k, _ in places]
        expected.append((d, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in places}))))
    found = licenses.scan_licenses(docs).collect()
    assert multiset(tuple(r[:6]) for r in found) == multiset(expected)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_fuzzy_notices_against_a_search_of_the_whole_text():
    rng = np.random.default_rng(2)
    letters = list("abcdefghij ")
    searcher = licenses.Searcher()  # without exact words
    for _ in range(150):
        notice = licenses.NOTICES[int(rng.integers(len(licenses.NOTICES)))]
        text = list(notice.phrase)
        for _ in range(int(rng.integers(0, notice.errors + 2))):
            at, kind = int(rng.integers(len(text))), int(rng.integers(3))
            text[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(letters))]
        folded = licenses.fold("".join(rng.choice(letters, 60)) + " " + "".join(text) + " " + "".join(rng.choice(letters, 60)))
        brute = {n.label for n in licenses.NOTICES if regex.search(f"(?:{n.phrase}){{e<={n.errors}}}", folded)}
        assert {s[0] for s in searcher.spans(folded, licenses.gaps(folded))} == brute


def scan(text):
    return licenses.scan(text, licenses.searcher())


def test_notice_spans():
    (span,) = [s for s in scan("Foo bar. Licnsed under the Apache License, Version 2.0. All done")[7] if s[0] == "apache-2.0"]
    assert span[1:4] == (2, 8, 1)
    assert scan("CC BY cc-by")[1:5] == (2, 0, 2, "cc-by")


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
        ("Licensed under CC BY-ND 4.0.", "cc-by"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc,cc-by-sa"),
        ("Licnsed undr CC BY-NC-SA", "cc-by,cc-by-nc,cc-by-sa"),
        ("Licensd unde CC BY-SA", "cc-by,cc-by-sa"),
        ("Licensed under CCBY NC", "cc-by-nc"),
        ("Licensed under CC BY-ND. Licensed under CC BY-SA.", "cc-by,cc-by-sa"),
        ("Licensed under CC BY-NCX", "cc-by"),
        ("Released under the MIT license.", "mit"),
        ("Relesed undr the MIT licence.", "mit"),
        ("Released under the BSD license.", ""),
        ("Released under the ISC license.", ""),
        ("Released under the GPL license.", ""),
        ("Released under the old license.", ""),
        ("Released under the BSD license, released under the MIT license.", "mit"),
        ("Licensed under the Apache License, Version 1.1.", ""),
        ("Subject to the terms of the Eclipse Public License.", ""),
    ],
)
def test_telling_words(line, labels):
    assert scan(line)[5] == labels
    assert scan(f"Foo bar. {line} All done. " * 3)[5] == labels


def test_spans_of_telling_words():
    cases = {
        "Licensed under CC BY-SA 4.0": [("cc-by-sa", 2, 5, 0)],
        "Licensed under CC BY 4.0": [],
        "released under the old license, released under the MIT licence": [("mit", 7, 5, 1)],
        "Licnsed under the Apache License, Version 2.0": [("apache-2.0", 2, 8, 1)],
    }
    for line, spans in cases.items():
        assert [s[:4] for s in scan(f"Foo bar. {line}. All done.")[7]] == spans


@pytest.mark.parametrize("unit", ["cc by x ", "all rights reserved ", "permission is hereby granted free of charge to any person "])
def test_many_places_take_time_in_proportion(unit):
    n = 160_000 if len(unit) < 10 else 20_000
    search = licenses.searcher()
    began = time.monotonic()
    _, places, first, last, *_ = licenses.scan(unit * n, search)
    assert time.monotonic() - began < 15
    if "granted" not in unit:
        assert (places, first, last) == (n, 0, (n - 1) * len(unit.split()))


def test_near_against_the_table_of_distances():
    rng = np.random.default_rng(12)
    for _ in range(400):
        phrase, text = ("".join(rng.choice(list("ab c"), int(rng.integers(1, 12)))) for _ in range(2))
        for errors in range(4):
            close = any(licenses.distance(phrase, text[a:b]) <= errors for a in range(len(text) + 1) for b in range(a, len(text) + 1))
            assert licenses.near(text, licenses.letters_of(phrase), len(phrase), errors) == (close and not (len(phrase) <= errors and not text)), (phrase, text, errors)


def test_production_searcher_against_a_search_of_the_whole_text():
    """Notices with exact and telling words: every span of the text that is within the
    errors of the phrase's fuzzy part is tried, whatever its seeds."""
    rng = np.random.default_rng(3)
    search, letters = licenses.searcher(), list("abcdefg hi")
    found_any = Counter()
    for _ in range(250):
        k = int(rng.integers(len(licenses.NOTICES)))
        notice = licenses.NOTICES[k]
        text = list(notice.phrase)
        for _ in range(int(rng.integers(0, notice.errors + 2))):
            at = int(rng.integers(len(text)))
            text[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))] * int(rng.integers(0, 2))
        folded = licenses.fold("".join(rng.choice(letters, 30)) + " " + "".join(text) + " " + "".join(rng.choice(letters, 30)))
        labels = {s[0] for s in search.spans(folded, licenses.gaps(folded))}
        for other, n in enumerate(licenses.NOTICES):
            tail = f"(?: (?:{'|'.join(licenses.TELLING)})){{0,2}}? {n.telling}(?= )" if n.telling else ""
            close = [m.group() for m in regex.finditer(f"(?e)(?:{n.stem}){{e<={n.errors}}}{tail}", folded, overlapped=True)]
            starts = {(m.start(), m.end()) for m in regex.finditer(f"(?e)(?:{n.stem}){{e<={n.errors}}}{tail}", folded, overlapped=True)}
            exact = any(set(n.exact) <= set(folded[max(0, a - 1) : b + 1].split()) for a, b in starts)
            if close and exact:
                assert n.label in labels, (folded, n)
                found_any[n.label] += 1
            elif not close and n.label not in {x.label for y, x in enumerate(licenses.NOTICES) if y != other}:
                assert n.label not in labels, (folded, n)
    assert len(found_any) >= 8


def test_own_notices(spark):
    notices = (licenses.Notice("beer", "buy me a beer in return", 2), licenses.Notice("wine", "buy me a wine in return", 2, exact=("wine",)))
    docs = spark.createDataFrame([(1, "You may by me a beer in return."), (2, "Buy me a wine in retur"), (3, "MIT license")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs, notices).collect()} == {1: "beer", 2: "wine", 3: ""}
    with pytest.raises(ValueError, match="too alike"):
        licenses.Searcher((notices[0], licenses.Notice("wine", "buy me a wine in return", 2)), True)


# 8


def test_mixing_agrees_with_its_sql(spark, sf_dir):
    mixed = mixing.taken_words(mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    same(mixed.select("doc_id", "size", "source_size", "target", "taken").toPandas(), database(sf_dir).sql(mixing.oracle()).df())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 4097])
def test_permutation(n):
    places = mixing.permuted(np.arange(n), np.full(n, n), 11)
    assert sorted(places.tolist()) == list(range(n))
    assert n < 16 or (places != mixing.permuted(np.arange(n), np.full(n, n), 12)).any()
    # Neighbours are not a fixed step apart, as they would be on a stride.
    assert n < 16 or len(set(np.diff(places).tolist())) > n // 4


def test_mixing(docs):
    mixed = mixing.taken_words(mixing.mix_sources(docs)).toPandas()
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(7))).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, mixed[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    sizes = defaultdict(int)
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, free, targets = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(targets.values())
        shares = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if shares[s] >= 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    targets |= shares
    assert sorted(round(t, 6) for t in set(mixed.target)) == sorted({round(t, 6) for t in targets.values()})
    assert (mixed.taken <= 3 * mixed["size"]).all()
    assert abs(mixed.taken.sum() - total) <= len(order)


def test_quota_tree():
    quotas = np.array([1000, 3, 0, 517, 88])
    out = mixing.split_quotas(quotas, 13, seed=4)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 1
    assert (out == mixing.split_quotas(quotas, 13, seed=4)).all()


def test_placements(documents):
    mixed = mixing.mix_sources(documents, shards=4, block_words=64)
    rows = mixed.select("doc_id", "size", F.explode("placements").alias("p")).select("doc_id", "size", "p.*").toPandas()
    assert set(rows.shard) <= {0, 1, 2, 3} and len(set(rows.shard)) == 4
    assert rows.groupby(["doc_id", "epoch"]).size().max() == 1
    assert rows.place.is_unique
    digest = mixing.taken_words(mixed).toPandas().set_index("doc_id")
    own = rows.sort_values("epoch").groupby("doc_id")
    assert all(digest.loc[d].shards == g.shard.tolist() and digest.loc[d].places == g.place.tolist() for d, g in own)
    words = rows.groupby("shard").words.sum()
    assert words.max() < 2 * words.mean()  # blocks are counted by where documents start


def test_hot_doc_ids_of_a_mix_are_split(spark):
    """Rows without a doc_id, alike in all else or only in size, end in many tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 20_000
        text = F.when(F.col("id") % 2 == 0, "one and the same text").otherwise(F.concat_ws(" ", F.lit("text of four"), "id"))
        docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 10 > 0, "a").alias("source"))
        mixed = mixing.taken_words(mixing.mix_sources(docs)).withColumn("task", F.spark_partition_id())
        tasks = mixed.groupBy("task").agg(F.count("*").alias("n")).toPandas()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert tasks.n.sum() == n and len(tasks) == parts and tasks.n.max() < 1.5 * n / parts
        words = mixed.groupBy("target").agg(F.sum("taken").alias("taken")).collect()
        assert len(words) == 2 and all(r.taken == round(r.target) for r in words)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_mix_of_many_sources(spark, monkeypatch):
    """More sources than a task draws for, in more blocks than may be."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 512)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"doc_id": np.arange(6000), "source": [f"s{k}" for k in rng.integers(0, 2000, 6000)]})
    rows["text"] = ["w " * int(k) for k in rng.pareto(1.0, 6000) * 5 + 1]
    docs = spark.createDataFrame(rows)
    database = duckdb.connect()
    database.register("documents", rows)
    mixed = mixing.mix_sources(docs, shards=8, block_words=16)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    same(mixing.taken_words(mixed).select(*columns).toPandas(), database.sql(mixing.oracle()).df())

    targets = mixing.source_targets(docs.select("source", F.size(F.split("text", " ")).cast("long").alias("size"))).toPandas()
    assert targets.sort_values("rank").source.tolist() == sorted(set(rows.source))
    assert sorted(targets["rank"]) == list(range(1, len(targets) + 1))

    quotas, block_words = mixing.source_quotas(spark.createDataFrame(targets), 8, 16, 11)
    quotas = quotas.toPandas()
    upto = np.stack(quotas.upto)
    assert block_words == 16 and (upto[:, -1] == quotas.blocks).all() and (np.diff(upto, axis=1) >= 0).all()
    assert (quotas.blocks == -(-quotas.words // 16)).all() and np.ptp(np.diff(upto, axis=1, prepend=0).sum(axis=0)) <= 1
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 100)
    _, wider = mixing.source_quotas(spark.createDataFrame(targets), 8, 16, 11)
    assert wider == -(-int(quotas.words.sum()) // 100)


# 9


def toxic_table(n=3000):
    """Texts with an insult, a group, both, or neither; only both together are toxic."""
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("mel", "tor", "vin", "sal") for b in ("a", "ona", "idis", "ure", "antes")]
    rows = []
    for k in range(n):
        words = list(rng.choice(plain, int(rng.integers(6, 30))))
        kind = int(rng.integers(4))
        extra = [["Idiots!", "idiotic,"][k % 2]] * (kind & 1) + [["northerner", "Northerners."][k % 2]] * (kind >> 1)
        for word in extra:
            words.insert(int(rng.integers(len(words))), word)
        rows.append((k, " ".join(words), int(kind == 3)))
    return rows


def toxic_docs(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity(spark):
    rows = toxic_table()
    scored = toxicity.score_toxicity(*toxic_docs(spark, rows)).where("held_out").collect()
    assert 900 < len(scored) < 1100
    assert sum(r.predicted == rows[r.doc_id][2] for r in scored) >= 0.99 * len(scored)


def brute_terms(text):
    found = set()
    for word in WORD.findall((text or "").lower()):
        bare = word.strip(toxicity.ENDS)
        if bare:
            found |= {zlib.crc32(t.encode()) % 2**20 for t in [bare, *(bare[:n] + "\0" for n in (4, 5, 6) if len(bare) >= n)]}
    return found


def pair_z(with_both, with_one, with_other, with_none):
    """z of the interaction of a pair, from (texts, toxic texts) of its four cells."""
    odds = [np.log((t + 0.5) / (n - t + 0.5)) for n, t in (with_both, with_one, with_other, with_none)]
    spread = sum(1 / (t + 0.5) + 1 / (n - t + 0.5) for n, t in (with_both, with_one, with_other, with_none))
    return abs(odds[0] - odds[1] - odds[2] + odds[3]) / spread**0.5


def test_toxicity_against_brute_force(spark, documents):
    """Terms counted, screened alone and in pairs, and scored one text at a time; the fit
    is shared."""
    rows = toxic_table(600) + [(k + 5000, t, 0) for k, (_, t) in enumerate(texts(documents)[:60]) if "İ" not in (t or "")]
    docs, labels = toxic_docs(spark, rows)
    learn = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: r[0])
    terms = [brute_terms(r[1]) for r in learn]
    total, ones = len(learn), sum(r[2] for r in learn)
    of = defaultdict(set)
    for k, own in enumerate(terms):
        for b in own:
            of[b].add(k)
    toxic = {k for k, r in enumerate(learn) if r[2]}
    known = set()
    for b, inside in of.items():
        p = len(inside) / total
        if 3 <= len(inside) < total and abs(len(inside & toxic) / ones - len(inside - toxic) / (total - ones)) / (p * (1 - p) * (1 / ones + 1 / (total - ones))) ** 0.5 >= 4.0:
            known.add(b)
    singles = len(known)
    common = [b for b, inside in of.items() if int((20 * total) ** 0.5) <= len(inside) <= total - 20]
    for k, a in enumerate(common):
        for b in common[:k]:
            cells = [of[a] & of[b], of[a] - of[b], of[b] - of[a], set(range(total)) - of[a] - of[b]]
            if min(map(len, cells)) >= 20 and pair_z(*[(len(c), len(c & toxic)) for c in cells]) >= 6.0:
                known |= {a, b}
    known = sorted(known)
    assert 0 < singles <= len(known)
    features = [sorted(known.index(b) for b in own if b in known) for own in terms]
    model = toxicity.fit(np.repeat(np.arange(total), [len(f) for f in features]), np.array([x for f in features for x in f]), np.array([r[2] for r in learn], dtype=float), np.array(known))
    for r in toxicity.score_toxicity(docs, labels).collect():
        own = [k for k, b in enumerate(known) if b in brute_terms(next(t for d, t, _ in rows if d == r.doc_id))]
        pairs = sum(float(model.vectors[a] @ model.vectors[b]) for a in own for b in own if a < b)
        logit = model.bias + sum(model.weights[a] for a in own) + pairs
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_training_rows_are_bounded(spark):
    rows = toxic_table(200)
    docs, labels = toxic_docs(spark, [r for r in rows for _ in range(20)])
    labels = labels.distinct()
    once, _ = toxic_docs(spark, rows)
    sizes = []
    own = toxicity.fit
    try:
        toxicity.fit = lambda r, f, y, *a, **b: sizes.append(len(y)) or own(r, f, y, *a, **b)
        scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(d, labels, max_rows=50).collect()} for d in (docs, once)]
    finally:
        toxicity.fit = own
    assert sizes == [50, 50] and scores[0] == scores[1]


@pytest.mark.parametrize("kind", ["both", "one"])
def test_toxicity_that_lies_in_pairs_only(spark, kind):
    """Two words, each in half of the texts, of which neither says anything by itself:
    label 1 is for texts with just one of them ("one"), or both are needed ("both")."""
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("mel", "tor", "vin", "sal", "ruk") for b in ("a", "ona", "idis", "ure", "antes", "ovi")]
    rows = []
    for k in range(6000):
        has = rng.integers(2), rng.integers(2)
        words = [*rng.choice(plain, int(rng.integers(5, 20))), *["gnarl"] * has[0], *["wobble"] * has[1]]
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(has[0] != has[1] if kind == "one" else all(has))))
    held = toxicity.score_toxicity(*toxic_docs(spark, rows)).where("held_out").collect()
    assert len(held) > 1500 and sum((r.score >= 0.5) == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("most", [2, 3, 64])
def test_pair_scores(most):
    rng = np.random.default_rng(most)
    x = rng.random((400, 7)) < [0.5, 0.5, 0.4, 0.3, 0.6, 0.02, 0.5]
    y = (x[:, 0] ^ x[:, 1] | (rng.random(400) < 0.1)).astype(float)
    best = np.zeros(7)
    for a in range(7):
        for b in range(a):
            cells = [(u == s) & (v == t) for u, v in [(x[:, a], x[:, b])] for s, t in ((1, 1), (1, 0), (0, 1), (0, 0))]
            if min(c.sum() for c in cells) >= 20:
                z = pair_z(*[(c.sum(), y[c].sum()) for c in cells])
                best[[a, b]] = np.maximum(best[[a, b]], z)
    found = toxicity.pair_scores(*np.nonzero(x), y, 7, 20, most)
    assert np.allclose(found, best) and found[5] == 0 < found[0]
    assert len(toxicity.pair_scores(np.zeros(0, int), np.zeros(0, int), y, 0, 20)) == 0


def test_toxicity_of_odd_rows(odd, clashing, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (9, None), (4, 0), (8, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    for docs in (odd, clashing):
        found = toxicity.score_toxicity(docs, labels).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    one_class = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in one_class} == {0.5}


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 6)) < 0.5).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]).astype(float)
    rows, features = np.nonzero(x)
    model = toxicity.fit(rows, features, y, np.arange(6))
    assert ((model.logits(rows, features, len(x)) > 0) == (y > 0)).mean() > 0.99
    exclusive = (x[:, 0] ^ x[:, 1]).astype(float)  # which no sum of two weights gives
    model = toxicity.fit(rows, features, exclusive, np.arange(6))
    assert ((model.logits(rows, features, len(x)) > 0) == (exclusive > 0)).mean() > 0.99


# 10


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    rng = np.random.default_rng(5)
    for ids in (np.array([], "<u4"), np.array([0], "<u4"), rng.integers(0, 50_000, 1000).astype("<u4"), rng.integers(0, 2**32, 77).astype("<u4")):
        assert (token_planes.from_planes(token_planes.to_planes(ids, kind), len(ids), kind) == ids).all()
    writer = token_planes.FileWriter(100, kind, 3, 1000)
    lists = {k: rng.integers(0, 49_000, n).astype("<u4") for k, n in enumerate((1, 250, 99, 100, 1, 730))}
    content = b"".join(r + b"\n" for k, ids in lists.items() for r in writer.add(k, ids))
    content += b"".join(r + b"\n" for r in writer.close())
    reader = token_planes.FileReader(content)
    assert {d: ids.tolist() for d, ids in reader.documents()} == {d: ids.tolist() for d, ids in lists.items()}
    assert reader.chunk(2).tolist() == np.concatenate(list(lists.values()))[200:300].tolist()
    with pytest.raises(ValueError):
        token_planes.FileReader(content[:-5])


def test_full_files():
    """A full file has two records more than chunks are allowed, and ends with a document."""
    rng = np.random.default_rng(6)
    for lengths in ((30, 30, 40, 1), (900, 5), (99, 1, 700), (250, 50)):
        writer, records, done = token_planes.FileWriter(100, "byte", 3, 3), [], []
        for k, n in enumerate(lengths):
            done.append((k, rng.integers(0, 49_000, n).astype("<u4")))
            records += writer.add(*done[-1])
            if writer.full:
                break
        assert writer.full or sum(lengths) < 300
        records += writer.close()
        assert len(records) == 5 if writer.full else len(records) < 5
        reader = token_planes.FileReader(b"".join(r + b"\n" for r in records))
        assert [(d, ids.tolist()) for d, ids in reader.documents()] == [(d, ids.tolist()) for d, ids in done]


def test_plane_files_of_one_doc_id(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("just the same few words").alias("text"))
    token_planes.write_token_planes(rows, str(tmp_path / "planes"), VOCABULARY, 2, files=4, block_ids=64, file_chunks=8)
    files = sorted((tmp_path / "planes").glob("part-*"))
    assert len({f.name[:10] for f in files}) > 1 and len(files) > 30 and max(f.stat().st_size for f in files) < 4000
    found = token_planes.with_global_start(token_planes.read_token_planes(spark, str(tmp_path / "planes"))).orderBy("start").collect()
    assert [r.start for r in found] == [6 * k for k in range(4000)]


@pytest.mark.parametrize("layout", [{}, {"files": 3, "block_ids": 64, "kind": "bit"}, {"files": 2, "block_ids": 100, "file_chunks": 2}])
def test_token_planes(docs, layout):
    found = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_planes.token_plane_table(docs, VOCABULARY, **layout).collect()))
    start, expected = 0, []
    hashed = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    for d, t, _ in sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = encoded(t, 2)
        expected.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected


# All


def test_empty_tables(empty, spark):
    assert sharding.shard_records(empty).count() == 0
    assert quality.judge_documents(empty).count() == 0
    assert ogg.media_table(empty).count() == 0
    assert packing.pack_documents(empty, VOCABULARY).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert mixing.taken_words(mixing.mix_sources(empty)).count() == 0
    assert token_planes.token_plane_table(empty, VOCABULARY).count() == 0
