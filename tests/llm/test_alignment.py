"""Alignment of two tokenizers against a walk over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte, names = alignment.byte_of_character(), {k: w for w, k in first.get_vocab().items()}

    def groups(text):
        """Groups of ids of a text, each library called once for the whole of it."""
        if not text:
            return []
        ids_a, ids_b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        words_a = [bytes(byte[c] for c in names[k]) for k in ids_a]
        words_b = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        whole = f" {text}".encode()
        if b"".join(words_a) != whole or b"".join(words_b) != whole:
            return []
        ends_a, ends_b = np.cumsum([len(w) for w in words_a]).tolist(), np.cumsum([len(w) for w in words_b]).tolist()
        out, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            upto_a, upto_b = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            out.append((ids_a[i:upto_a], ids_b[j:upto_b]))
            i, j = upto_a, upto_b
        return out

    return groups


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), hashlib.sha256(text.encode()).hexdigest() if groups else ""


def expected(rows, by_hand):
    """Rows of the result for (doc_id, text)."""
    found = [(d, by_hand(t)) for d, t in rows]
    links = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d, groups in found:
        n_a, n_b, n, sha = digest(groups)
        counts = [(links[a[-1], b[-1]], b[-1]) for a, b in groups]
        out.append((d, n_a, n_b, n, n, sum(c == most[b] for c, b in counts), sum(c for c, _ in counts), sha))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_query_against_a_walk_over_tokens(spark, sf_dir, documents, by_hand):
    assert rows(queries.op13_alignment(spark, sf_dir)) == expected([tuple(r) for r in documents.select("doc_id", "text").collect()], by_hand)


def test_odd_rows(spark, odd, clashing, empty, by_hand):
    wanted = expected([tuple(r) for r in odd.select("doc_id", "text").collect()], by_hand)
    assert rows(alignment.align_tokenizers(odd, A, B)) == rows(alignment.align_tokenizers(clashing, A, B)) == wanted
    assert rows(alignment.align_tokenizers(empty, A, B)) == []
    assert [r for r in wanted if r[0] in (3, 4)] == [(3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")]


def test_small_blocks_give_the_same(spark, documents):
    docs = documents.where("doc_id < 40").repartition(2)
    stored = alignment.aligned_blocks(docs, A, B, block_bytes=1).where("pairs IS NOT NULL")
    assert stored.count() == 40 and stored.select("block").distinct().count() == 40
    by_blocks = stored.selectExpr("explode(arrays_zip(pairs, counts)) AS p").groupBy("p.pairs").agg({"p.counts": "sum"})
    whole = alignment.aligned_blocks(docs.coalesce(1), A, B).where("pairs IS NOT NULL").selectExpr("explode(arrays_zip(pairs, counts)) AS p").selectExpr("p.pairs", "p.counts")
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, whole.collect()))


def test_random_texts(by_hand):
    both, rng = alignment.aligner(A, B), random.Random(3)
    assert both.a.cut and both.b.cut
    parts = [" ", "  ", "a", "b", "'s", "\n", "\t", "é", "ß", "日", "\xa0", " ", "▁", "1", "23", ".", "!!", "<s>", "<|endoftext|>", "<0x41>", "😀", "́", "the", "ing", "\x85", "　", "ʼ", "\x00", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + [None, "", " ", "x "]
    counts, hashes, links, ends = alignment.align(pa.array(texts, pa.string()), both)
    start = 0
    for k, text in enumerate(texts):
        groups = by_hand(text)
        assert (*(int(counts[c][k]) for c in ("n_a", "n_b", "n_groups")), hashes[k]) == digest(groups), text
        assert links[start : ends[k]].tolist() == [a[-1] * 32_000 + b[-1] for a, b in groups]
        start = ends[k]


def test_classes_of_characters_are_those_of_the_file():
    """Every character that goes to the second library, beside letters, digits and spaces."""
    model = Tokenizer.from_file(A)
    encode = alignment.ByteTokens(A).pieces.encode
    texts = [f" a{c}b {c}{c}1{c} {c}" for c in map(chr, range(ord(alignment.ByteTokens.KNOWN)))]
    assert encode(texts) == [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def test_bit_sets():
    rng = np.random.default_rng(1)
    places = np.sort(rng.choice(1000, 300, replace=False))
    bits = alignment.bit_set(places, 1000)
    assert alignment.members(bits).tolist() == places.tolist()
    at = np.arange(1000)
    assert alignment.ranks(bits, at).tolist() == np.searchsorted(places, at, "right").tolist()
    assert len(alignment.bit_set(np.zeros(0, np.int64), 0)) == 0
