"""The stages, each against brute force on its own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, PROSE
from tests.llm.test_documents import TOKENIZER, brute_components, brute_quality, texts


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_stages(spark, sf_dir, documents, tmp_path):
    docs, clean, civil, single, mix, packed = stages(spark, documents, sf_dir, tmp_path)
    assert all(df.dtypes == docs.dtypes for df in (clean, civil, single, mix))
    assert Counter(texts(clean)) == Counter((d, brute_quality(t)[7]) for d, t in texts(docs) if brute_quality(t)[6])
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert not Counter(texts(civil)) - Counter(texts(clean))
    assert Counter(texts(single)) == Counter(r for r, (d, _, c) in zip(texts(civil), brute_components(texts(civil)), strict=True) if d == c)

    words = lambda t: (t or "").split()
    whole = {d: words(t) for d, t in texts(single)}
    taken, cut = defaultdict(int), 0
    for d, t in texts(mix):
        assert words(t) == whole[d][: len(words(t))]
        taken[d] += len(words(t))
        cut += len(words(t)) < len(whole[d])
    assert all(n <= 3 * len(whole[d]) for d, n in taken.items())
    assert cut <= single.select("source").distinct().count()
    assert abs(sum(taken.values()) - sum(map(len, whole.values()))) <= single.select("source").distinct().count()

    tokens = sum(len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(mix))
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages_in_turn(spark, sf_dir, documents, tmp_path):
    last = stages(spark, documents, sf_dir, tmp_path)[-1]
    found = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, last.collect()))


def test_odd_rows_pass_every_stage(spark, sf_dir, odd, clashing, empty, tmp_path):
    for k, docs in enumerate((odd, clashing, empty)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}-{stage.__name__}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}-near_duplicates"))
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids))


def test_stages_keep_whole_rows(spark, sf_dir, clashing, odd):
    """Columns of any name pass as they are; only the text and its length may change."""
    others = [c for c in clashing.columns if c not in ("text", "n_chars")]
    for stage, _ in ((corpus_pipeline.quality_rules, 0), (corpus_pipeline.toxicity_filter, 0), (corpus_pipeline.near_duplicates, 0), (corpus_pipeline.source_mix, 2)):
        found, plain = stage(spark, clashing, sf_dir), stage(spark, odd, sf_dir)
        assert found.columns == clashing.columns
        assert Counter(map(tuple, found.select(*odd.columns).collect())) == Counter(map(tuple, plain.collect()))
        assert all(r[c] == "x" for r in found.collect() for c in others if c not in odd.columns)


def test_mix_is_in_order(spark, sf_dir, documents):
    """The copies lie as the mix places them: shard by shard, shuffled in each."""
    from millrace.llm import mixing

    placed = mixing.mix_sources(documents).select("doc_id", F.explode("placements").alias("p")).select("doc_id", "p.shard", "p.place").orderBy("shard", "place")
    assert [r.doc_id for r in corpus_pipeline.source_mix(spark, documents, sf_dir).collect()] == [r.doc_id for r in placed.collect()]


def test_near_duplicates_of_null_and_repeated_ids(spark, sf_dir, odd):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    near = text(2) + " more"
    rows = [(None, text(k)) for k in range(5)] + [(7, text(k)) for k in range(4, 9)]
    rows += [(3, near), (None, near), (7, text(8)), (9, text(8)), (None, ""), (None, ""), (None, " "), (None, None), (5, ""), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = [(None, text(k)) for k in (0, 1, 3)] + [(3, near)] + [(7, text(k)) for k in range(4, 9)]
    stay += [(None, ""), (None, " "), (None, None), (5, ""), (5, None)]
    assert Counter(texts(corpus_pipeline.near_duplicates(spark, docs, sf_dir))) == Counter(stay)
    copies = [(2, PROSE), (2, PROSE), (None, PROSE), (10, "one two three")]
    assert Counter(texts(corpus_pipeline.near_duplicates(spark, odd, sf_dir))) == Counter(r[:2] for r in ODD) - Counter(copies)


def test_source_mix_of_null_and_repeated_ids(spark, sf_dir):
    ids = [None, None, None, 1, 1, 1, 2, 3, None, 4]
    docs = [("a", d, 30 + k) for k, d in enumerate(ids)] + [("b", d, 20 + k) for k, d in enumerate(ids)]
    docs = [(d, " ".join(f"{s}{n}w{j}" for j in range(n)), s, n) for s, d, n in docs]
    total = sum(n for *_, n in docs)
    expected = Counter()
    for source, share in (("a", 1 / 3), ("b", 2 / 3)):
        own = sorted((hashlib.md5(f"11:{'' if d is None else d}".encode()).hexdigest(), n, d, t) for d, t, s, n in docs if s == source)
        size, before = sum(n for _, n, _, _ in own), 0
        for _, n, d, t in own:
            for epoch in range(3):
                taken = min(n, round(total * share) - before - epoch * size)
                if taken > 0:
                    expected[(d, " ".join(t.split()[:taken]), source)] += 1
            before += n
    mix = corpus_pipeline.source_mix(spark, spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3), sf_dir)
    found = mix.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == expected
    assert all(r.n_chars == len(r.text) for r in found)
