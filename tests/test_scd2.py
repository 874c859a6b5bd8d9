import datetime
import glob
import os
import random

import pytest

from millrace.operators import scd2
from millrace.sources.catalog import Table

D = lambda day: datetime.datetime(2026, 1, day)
TARGET = [(1, 10, "x", D(1), D(1), None, True), (2, 20, "x", D(1), D(1), None, True), (4, 40, "x", D(1), D(1), None, True), (5, None, "x", D(1), D(1), None, True), (6, 60, "x", D(5), D(5), None, True)]
BATCH = [(1, 10, "y", D(2)), (2, 21, "x", D(2)), (2, 21, "x", D(2)), (2, 22, "x", D(3)), (3, 30, "x", D(2)), (3, 31, "x", D(4)), (4, None, "x", D(2)), (5, 50, "x", D(2)), (6, 61, "x", D(2))]
EXPECTED = [
    (1, 10, "x", D(1), D(1), None, True), (2, 20, "x", D(1), D(1), D(3), False), (2, 21, "x", D(2), D(2), D(3), False), (2, 22, "x", D(3), D(3), None, True),
    (3, 30, "x", D(2), D(2), D(4), False), (3, 31, "x", D(4), D(4), None, True), (4, 40, "x", D(1), D(1), None, True), (5, None, "x", D(1), D(1), None, True),
    (6, 60, "x", D(5), D(5), D(2), False), (6, 61, "x", D(2), D(2), None, True),
]
DIM = scd2.Dimension(["k"], "ts", "b", "e", "cur", ["v"])
COLUMNS = "k int, v int, u string, ts timestamp_ntz"


def frames(spark, target=TARGET, batch=BATCH):
    return spark.createDataFrame(target, f"{COLUMNS}, b timestamp_ntz, e timestamp_ntz, cur boolean"), spark.createDataFrame(batch, COLUMNS)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_truth_table(spark):
    target, batch = frames(spark)
    once = scd2.apply_batch(target, batch, DIM)
    assert rows(once) == sorted(EXPECTED, key=repr)
    assert rows(scd2.apply_batch(once, batch, DIM)) == sorted(EXPECTED, key=repr)


def test_options(spark):
    target, batch = frames(spark)
    of = lambda **options: {k: [r for r in rows(scd2.apply_batch(target, batch, scd2.Dimension(["k"], "ts", "b", "e", "cur", ["v"], **options))) if r[0] == k] for k in (2, 4, 5, 6)}
    safe = of(null_safe=True)
    assert [len(safe[k]) for k in (4, 5)] == [2, 2]
    assert of(reject_late=True)[6] == [TARGET[4]]
    assert (2, 20, "x", D(1), D(1), D(2), False) in of(contiguous=True)[2]


def test_no_tracked_column_only_adds_new_keys(spark):
    target, batch = frames(spark)
    found = rows(scd2.apply_batch(target, batch, scd2.Dimension(["k"], "ts", "b", "e", "cur", [])))
    assert {r for r in found if r[0] != 3 and r[6]} == set(TARGET)


def test_ties_are_ordered_by_the_other_columns(spark):
    _, batch = frames(spark, batch=[(1, 9, "a", D(1)), (1, 3, "a", D(1)), (1, None, "a", D(1))])
    found = scd2.apply_batch(scd2.empty_target(batch, DIM), batch, DIM)
    assert [r.v for r in found.where("cur").collect()] == [3]


def test_empty_batches_and_bad_keys(spark):
    target, batch = frames(spark)
    assert rows(scd2.apply_batch(target, batch.limit(0), DIM)) == sorted(TARGET, key=repr)
    with pytest.raises(ValueError):
        scd2.rank_batch(batch, scd2.Dimension(["nope"], "ts"))


def model(target, batch):
    """Row by row: the same rules in plain Python."""
    out = [list(r) for r in target]
    by_key = {}
    for row in set(batch):
        by_key.setdefault(row[0], []).append(row)
    added = []
    for k, versions in by_key.items():
        versions.sort(key=lambda r: r[1])
        versions.sort(key=lambda r: r[3], reverse=True)
        for i, row in enumerate(versions[1:], 1):
            if not any(t[0] == k and t[4] == row[3] for t in target):
                added.append([*row, row[3], versions[i - 1][3], False])
        latest = versions[0]
        for t in out:
            if t[0] == k and t[6] and latest[1] is not None and t[1] is not None and latest[1] != t[1]:
                t[5], t[6] = latest[3], False
        if not any(t[0] == k and t[6] for t in out):
            added.append([*latest, latest[3], None, True])
    return sorted([tuple(r) for r in out + added], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_against_a_row_loop(spark, seed):
    rng = random.Random(seed)
    draw = lambda lo, hi, n: list({(rng.randrange(12), d): (0, rng.randrange(3), "u", D(d)) for d in [rng.randrange(lo, hi) for _ in range(n)]}.items())
    batch = lambda lo, hi: [(k, v, u, ts) for (k, _), (_, v, u, ts) in draw(lo, hi, 40)]
    first, second = batch(1, 10), batch(8, 20)
    _, empty = frames(spark, batch=first)
    target = scd2.apply_batch(scd2.empty_target(empty, DIM), empty, DIM)
    expected = model([], first)
    assert rows(target) == expected
    _, more = frames(spark, batch=second)
    found = rows(scd2.apply_batch(target, more, DIM))
    assert found == model(expected, second)
    current = [r[0] for r in found if r[6]]
    assert len(current) == len(set(current))


@pytest.fixture
def dimension(spark, tmp_path):
    target, _ = frames(spark)
    table = Table(spark, "dims", "d", str(tmp_path / "dims")).create(target.schema, "a dimension", ["k"], buckets=4)
    table.load(target, DIM)
    yield table
    spark.sql("DROP DATABASE dims CASCADE")


def test_stored_dimension(spark, dimension):
    _, batch = frames(spark)
    assert dimension.comment() == "a dimension" and dimension.schema().names == [*COLUMNS.replace(",", "").split()[::2], "b", "e", "cur"]
    dimension.apply_scd2(batch, DIM, batch="b1")
    assert rows(dimension.read()) == sorted(EXPECTED, key=repr)
    for name in ("b1", "b2"):
        dimension.apply_scd2(batch, DIM, batch=name)
        assert rows(dimension.read()) == sorted(EXPECTED, key=repr)
    assert dimension.apply_scd2(batch.limit(0), DIM) == []
    with pytest.raises(ValueError, match="buckets"):
        dimension.apply_scd2(batch, scd2.Dimension(["u"], "ts", "b", "e", "cur", ["v"]))


def test_a_batch_of_one_key_touches_one_bucket(spark, dimension):
    def stored():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{dimension.path}/_bucket=*/**/*.parquet", recursive=True)}

    many = spark.range(100, 180).selectExpr("CAST(id AS INT) AS k", "1 AS v", "'u' AS u", "TIMESTAMP_NTZ'2026-01-01' AS ts")
    dimension.apply_scd2(many, DIM, "many")
    before = stored()
    batch = spark.createDataFrame([(120, 7, "u", D(9))], COLUMNS)
    (bucket,) = dimension.apply_scd2(batch, DIM, "one")
    after = stored()
    assert {f for f in before if f not in after} | {f for f in after if f not in before} <= {f for f in {**before, **after} if f"_bucket={bucket}/" in f}
    assert len([f for f in before if f in after]) >= 3 and len(before) >= 4
    # What the batch reads: partitions of that bucket.
    part = dimension.stored().where(f"_bucket = {bucket}")
    assert all(f"_bucket={bucket}/" in f for f in part.inputFiles())
    found = rows(dimension.read().where("k = 120"))
    assert [(r[1], r[6]) for r in found] == [(1, False), (7, True)]


def test_a_key_with_two_current_rows_gets_one_new_version(spark):
    twice = [(1, 10, "x", D(1), D(1), None, True), (1, 11, "x", D(2), D(2), None, True), (2, 10, "x", D(1), D(1), None, True), (2, 20, "x", D(2), D(2), None, True)]
    target, batch = frames(spark, twice, [(1, 30, "x", D(3)), (2, 20, "x", D(3))])
    found = rows(scd2.apply_batch(target, batch, DIM))
    assert found == sorted([(1, 10, "x", D(1), D(1), D(3), False), (1, 11, "x", D(2), D(2), D(3), False), (1, 30, "x", D(3), D(3), None, True), (2, 10, "x", D(1), D(1), D(3), False), twice[3]], key=repr)


def test_null_keys_meet_nothing(spark):
    target, batch = frames(spark, [(None, 10, "x", D(1), D(1), None, True), TARGET[0]], [(None, 11, "x", D(2))])
    found = rows(scd2.apply_batch(target, batch, DIM))
    assert found == sorted([(None, 10, "x", D(1), D(1), None, True), TARGET[0], (None, 11, "x", D(2), D(2), None, True)], key=repr)


def test_a_second_application_does_not_run_the_first_in_its_stages(spark, sf_dir, capsys):
    from millrace.plans import catalogue

    target, batch = catalogue._parts(spark, sf_dir)
    scd2.apply_batch(spark.createDataFrame([], target.schema), batch, catalogue.DIM).explain()
    once = capsys.readouterr().out
    catalogue.QUERIES["scd2_idempotent"](spark, sf_dir).explain()
    twice = capsys.readouterr().out
    assert 0 < twice.count("Window [") <= max(once.count("Window ["), 4)
