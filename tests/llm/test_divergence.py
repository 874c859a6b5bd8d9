"""Divergence of sources: the rotation against plain arithmetic."""

import re

import numpy as np
import pytest
from tests.oracle import database, same

from millrace.llm import divergence, queries


def model(rows, least=3, top=200):
    """(lang, source, text) to the result, term by term in Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for x, s, w in words if x == lang]
        kept = {t for t in {t for _, w in mine for t in w} if sum(t in w for _, w in mine) >= least}
        counts = {s: {} for s, _ in mine}
        whole = {}
        for s, w in mine:
            for t in w:
                if t in kept:
                    counts[s][t] = counts[s].get(t, 0) + 1
                    whole[t] = whole.get(t, 0) + 1
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in counts[s] if p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r) for r in divergence.audit_sources(docs, **options).collect())


def test_the_query_against_sql(spark, sf_dir):
    same(queries.op11_divergence(spark, sf_dir).toPandas(), database(sf_dir).sql(queries.ORACLES["op11_divergence"]).df())


@pytest.mark.parametrize(("stations", "chunks"), [(2, 1), (4, 3), (8, 16)])
def test_any_ring_gives_the_same(spark, stations, chunks):
    rng = np.random.default_rng(stations)
    rows = [(f"l{rng.integers(2)}", f"s{min(rng.integers(14), rng.integers(14))}", " ".join(f"t{'abcdefghij'[int(x)]}{'xyzé'[int(x) % 4]} Q" for x in rng.integers(0, 10, rng.integers(0, 30)))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    expected = model(rows, top=5)
    assert audited(docs, stations=stations, least_chunks=chunks, top=5) == expected
    assert audited(docs, stations=stations, least_chunks=chunks, top=5, cell_entries=7) == expected


def test_odd_rows(spark, odd, clashing, empty):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert audited(odd) == audited(clashing) == model(rows)
    assert audited(empty) == []
    ties = [("en", s, "One two three ONE") for s in ("b", "a", "é", "Z")] + [("en", "none", None), ("en", None, "12 34"), ("xx", "one", "a"), ("xx", "two", "b")]
    docs = spark.createDataFrame(ties, "lang string, source string, text string")
    found = audited(docs)
    assert found == model(ties)
    assert {r[4] for r in found if r[0] == "xx"} == {0} and len([r for r in found if r[1] == "none"]) == 5


def test_large_counts_are_exact():
    counts = np.array([0, 10**10, 5 * 10**12])
    total = int(counts.sum()) + 3
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


@pytest.mark.parametrize("stations", [2, 4, 8, 12])
def test_every_two_stations_meet_once(stations):
    rounds = divergence.tournament(stations)
    met = [frozenset(p) for r in rounds for p in r]
    assert len(met) == len(set(met)) == stations * (stations - 1) // 2
    assert all(len({x for p in r for x in p}) == stations for r in rounds)
