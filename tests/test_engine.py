"""Pages, commits, streams that go on, and the registry."""

import datetime
import glob
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.api import Warehouse
from millrace.operators import joins
from millrace.plans import catalogue, config, metrics
from millrace.plans.dag import Status
from millrace.plans.runner import Engine
from millrace.sources import tables
from millrace.sources.catalog import Table
from millrace.streaming import streams
from tests.oracle import same


def test_pages_with_other_columns(spark):
    items = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    paged = tables.Pages(items, catalogue.ROW_KEYS, 1000)
    assert len(paged.bounds) >= 2
    assert sum(paged.counts) == items.count()
    for columns in (["l_returnflag", "l_shipdate"], ["l_orderkey"], items.columns):
        sizes = dict(paged.all().select(*columns, "page").groupBy("page").agg(F.count("*").alias("n"), F.max(columns[0])).select("page", "n").collect())
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(sizes[p] == 1000 for p in range(len(sizes) - 1)) and sum(sizes.values()) == items.count()
    last = len(sizes) - 1
    for number in (0, last // 2, paged.before[1] // 1000, last, last + 1):
        one = sorted(map(tuple, paged.page(number).collect()), key=repr)
        assert one == sorted(map(tuple, paged.all().where(F.col("page") == number).collect()), key=repr) and len(one) == sizes.get(number, 0)


def test_pages_of_nulls_and_few_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "RANGE_ROWS", 7)
    rows = [(None if k % 9 == 0 else k // 4, "é" if k % 2 else None, k) for k in range(200)]
    made = spark.createDataFrame(rows, "a int, b string, c int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2]))
    paged = tables.Pages(made, ["a", "b", "c"], 13)
    assert len(paged.bounds) > 10
    assert {(r.c, r.page) for r in paged.all().collect()} == {(r[2], k // 13) for k, r in enumerate(order)}
    for number in range(17):
        assert [r.c for r in paged.page(number).collect()] == [r[2] for r in order[13 * number : 13 * number + 13]]
    assert tables.Pages(made.limit(0), ["a"], 5).all().count() == 0


def test_one_page_reads_one_range(spark, capsys):
    items = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    tables.Pages(items, catalogue.PAGE_KEYS, 1000).page(400).explain("formatted")
    assert "GreaterThanOrEqual(l_orderkey" in capsys.readouterr().out


@pytest.fixture
def lake(spark, tmp_path):
    yield str(tmp_path / "lake")
    spark.sql("DROP DATABASE IF EXISTS w CASCADE")


def test_tables_of_the_catalog(spark, lake):
    house = Warehouse(spark, lake)
    house.create_database("w", "what's there")
    assert spark.catalog.getDatabase("w").description == "what's there" and house.databases() == ["w"]
    table = house.table("w", "t")
    assert not table.exists()
    table.create(spark.range(1).withColumn("name", F.lit("x")).schema, "it's a table")
    table.append(spark.range(3))
    table.append(spark.range(3, 5).selectExpr("'a' AS name", "id"), batch="k-1")
    table.append(spark.range(7, 9).selectExpr("'b' AS name", "id"), batch="k-1")
    table.append(spark.range(9, 10).selectExpr("'c' AS name", "id"), batch="k-2")
    assert sorted((r.id, r.name) for r in table.read().collect()) == [(0, None), (1, None), (2, None), (7, "b"), (8, "b"), (9, "c")]
    assert table.comment() == "it's a table" and house.tables("w") == ["t"]
    with pytest.raises(ValueError, match="the database w is at"):
        Warehouse(spark, f"{lake}-other").create_database("w")
    spark.sql("DROP TABLE w.t")  # as in a session whose catalog doesn't last
    assert house.table("w", "t").read().count() == 6
    table.append(spark.range(20, 21))
    assert table.read().count() == 7 and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def eventually(met, seconds=40):
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        try:
            if met():
                return True
        except Exception:  # noqa: BLE001, S110  a table that is being made or written
            pass
        time.sleep(0.2)
    return False


def stream(name, ref=None):
    return {"alias": "rows", **({"ref": ref} if ref else {}), "methods": [{"method": "stream", "connection": "logs", **({} if ref else {"stream_name": name})}]}


def of_nodes(lake, *nodes, **connections):
    named = [{"name": "lake", "type": "warehouse", "path": lake}, {"name": "logs", "type": "stream", "path": lake}, *[{"name": k} | v for k, v in connections.items()]]
    return {"name": "p", "connections": named, "layers": [{"name": "l", "nodes": list(nodes)}]}


TO_TABLE = {"methods": [{"method": "sql", "connection": "lake", "database": "w", "table": "copy"}]}
TO_LOG = {"methods": [{"method": "stream", "connection": "logs"}]}


def test_live_nodes(spark, lake):
    streams.append_log(spark.range(5), f"{lake}/p/l.source")
    node = {"name": "copy", "type": "live", "every": "100 milliseconds", "inputs": [stream("l.source")], "outputs": TO_TABLE}
    engine = Engine(spark, events_path=f"{lake}/_events")
    assert engine.run(of_nodes(lake, node)) == {"l.copy": Status.LIVE}
    table = Table(spark, "w", "copy", f"{lake}/w")
    try:
        assert eventually(lambda: table.read().count() == 5)
        streams.append_log(spark.range(5, 8), f"{lake}/p/l.source")
        assert eventually(lambda: table.read().count() == 8)
        engine.pause("l.copy")
        assert not engine.queries["l.copy"].isActive
        streams.append_log(spark.range(8, 10), f"{lake}/p/l.source")
        engine.resume("l.copy")
        assert eventually(lambda: table.read().count() == 10)
        assert eventually(lambda: engine.events().where("batch IS NOT NULL").count() >= 3)
    finally:
        engine.stop()
    assert not any(q.isActive for q in engine.queries.values())
    batches = engine.events().where("batch IS NOT NULL").collect()
    assert {r.status for r in batches} == {"live"} and sum(r.records for r in batches) == 10 and len({r.batch for r in batches}) == len(batches)
    (found,) = metrics.node_summary(engine.events()).collect()
    assert found.batches == len(batches) and found.sum_records == 10 and found.avg_post_seconds > 0


@pytest.mark.parametrize("declared", [True, False])
def test_a_chain_of_live_nodes(spark, lake, declared):
    streams.append_log(spark.range(4), f"{lake}/p/l.source")
    live = {"type": "live", "every": "100 milliseconds"}
    schema = {"schema": [{"name": "id", "type": "bigint"}]} if declared else {}
    nodes = [
        {"name": "a", **live, **schema, "inputs": [stream("l.source")], "outputs": TO_LOG},
        {"name": "b", **live, **schema, "inputs": [stream(None, "l.a")], "outputs": TO_LOG},
        {"name": "c", **live, "inputs": [stream(None, "l.b")], "outputs": TO_TABLE},
    ]
    engine = Engine(spark, {"l.b": lambda given, _: given["rows"].selectExpr("id + 100 AS id")}, events_path=f"{lake}/_events")
    try:
        assert set(engine.run(of_nodes(lake, *nodes)).values()) == {Status.LIVE}
        table = Table(spark, "w", "copy", f"{lake}/w")
        assert eventually(lambda: table.read().count() == 4)
        streams.append_log(spark.range(4, 6), f"{lake}/p/l.source")
        assert eventually(lambda: sorted(r.id for r in table.read().collect()) == list(range(100, 106)))
    finally:
        engine.stop()


def test_a_live_node_that_dies(spark, lake):
    streams.append_log(spark.range(4), f"{lake}/p/l.source")

    def breaks(given, context):
        raise ValueError("no such thing")

    nodes = [{"name": n, "type": "live", "every": "100 milliseconds", "inputs": [i], "outputs": TO_LOG} for n, i in (("a", stream("l.source")), ("b", stream(None, "l.a")))]
    engine = Engine(spark, {"l.a": breaks}, events_path=f"{lake}/_events", patience=20)
    try:
        status = engine.run(of_nodes(lake, *nodes))
        assert eventually(lambda: status["l.a"] == Status.FAILED)
        assert status["l.b"] == Status.FAILED and engine.statuses is status
        failed = engine.events().where("status = 'failed' AND node_id = 'l.a'").collect()
        assert len(failed) == 1 and failed[0].level == "ERROR" and "no such thing" in failed[0].error_message
        assert metrics.filter_logs(engine.logs(), "error", component="l.a").count() == 1
        engine.functions["l.a"] = lambda given, _: given["rows"]
        engine.resume("l.a")
        assert eventually(lambda: streams.log_schema(spark, f"{lake}/p/l.a") is not None) and status["l.a"] == Status.LIVE
    finally:
        engine.stop()


def test_a_micro_batch_that_runs_twice_appends_once(spark, lake):
    streams.append_log(spark.range(3), f"{lake}/p/l.source")
    both = {"methods": [*TO_LOG["methods"], *TO_TABLE["methods"]]}
    node = {"name": "n", "inputs": [stream("l.source")], "outputs": both}
    engine = Engine(spark, events_path=f"{lake}/_events")
    assert engine.run(of_nodes(lake, node)) == {"l.n": Status.SUCCESS}
    log, table = f"{lake}/p/l.n", Table(spark, "w", "copy", f"{lake}/w")
    # The state of a query that was ended after its outputs and before its commit.
    commits = glob.glob(f"{lake}/_checkpoints/p/l.n/commits/*") + glob.glob(f"{lake}/_checkpoints/p/l.n/commits/.*.crc")
    assert commits
    for path in commits:
        os.remove(path)
    assert engine.run(of_nodes(lake, node)) == {"l.n": Status.SUCCESS}
    assert sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(log).collect()) == [0, 1, 2]
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2]


class Feed(BaseHTTPRequestHandler):
    pages: list = []
    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        page = int(parse_qs(urlparse(self.path).query)["page"][0])
        Feed.asked.append(page)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"rows": Feed.pages[page] if page < len(Feed.pages) else []}).encode())


def test_a_rest_resource_as_a_stream(spark, lake):
    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Feed.pages, Feed.asked = [[{"n": 1}, {"n": 2}], [{"n": 3}]], []
    api = {"type": "api", "base_url": f"http://127.0.0.1:{server.server_port}"}
    node = {"name": "poll", "type": "live", "every": "100 milliseconds", "inputs": [{"alias": "rows", "methods": [{"method": "api", "connection": "feed", "endpoint": "items", "payload_template": "rows"}]}], "outputs": TO_TABLE}
    engine = Engine(spark, {"l.poll": lambda given, _: given["rows"].selectExpr("CAST(get_json_object(body, '$.n') AS INT) AS n")}, events_path=f"{lake}/_events")
    table = Table(spark, "w", "copy", f"{lake}/w")
    numbers = lambda: sorted(r.n for r in table.read().collect())
    try:
        engine.run(of_nodes(lake, node, feed=api))
        assert eventually(lambda: numbers() == [1, 2, 3])
        engine.stop()
        Feed.pages.append([{"n": 4}])
        seen = len(Feed.asked)
        engine.resume("l.poll")
        assert eventually(lambda: numbers() == [1, 2, 3, 4])
        assert set(Feed.asked[seen:]) <= {2, 3} and Feed.asked[seen] == 2  # no page from before
    finally:
        engine.stop()
        server.shutdown()


def test_keyed_state_over_batches_and_a_restart(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)
    batches = [
        [(1, 7, "click", 0), (2, 7, "click", 30), (3, 8, "click", 10)],
        [(4, 7, "buy", 50), (5, 8, "buy", 75), (6, 9, "click", 60)],
        [(7, 9, "view", 300), (8, 9, "buy", 120)],
        [(9, 1, "click", 900)],
        [(10, 1, "click", 901)],
    ]
    rule = streams.Awaited(["u"], "id", "ts", "kind", "click", "buy", 60 * 60_000)
    for k, rows in enumerate(batches):
        streams.append_log(spark.createDataFrame([(i, u, kind, at(m)) for i, u, kind, m in rows], "id long, u long, kind string, ts timestamp_ntz").coalesce(1), str(tmp_path / "log"), str(k))
        log = streams.read_log(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log" / "b-0")).schema, files_per_trigger=1)
        with streams.keyed_state(spark):  # a query of its own each time, over one checkpoint
            streams.drain_to(streams.awaited(streams.timed(log, "ts", "10 minutes"), rule), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = {(r.u, r.opened): r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(7, 1): 4, (7, 2): 4, (8, 3): None, (9, 6): 8}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_timers_are_called_by_bucket_not_by_row(spark, tmp_path, monkeypatch):
    start = datetime.datetime(2026, 1, 1)
    at = lambda m: start + datetime.timedelta(minutes=m)
    # Users with many rows, ties of closing rows, and no user at all; the last rows end the stream.
    rows = [(2 * k + 1, (k % 7) or None, "click" if k % 3 else "buy", at(k // 2)) for k in range(300)] + [(2 * k, 3, "buy", at(k)) for k in range(20, 40)] + [(77_000, 3, "buy", at(25)), (2**60 + 1, 2**60 + 3, "click", at(0))]
    for name, part in (("0", rows[::2]), ("1", rows[1::2]), ("2", [(9_001, -1, "click", at(9_000))]), ("3", [(9_003, -1, "click", at(9_100))])):
        streams.append_log(spark.createDataFrame(part, "id long, u long, kind string, ts timestamp_ntz").coalesce(1), str(tmp_path / "log"), name)
    log = streams.read_log(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log" / "b-0")).schema, files_per_trigger=1)
    rule = streams.Awaited(["u"], "id", "ts", "kind", "click", "buy", 10 * 60_000)
    registered, fresh = str(tmp_path / "registered"), streams._Waiting.init

    def init(self, handle):
        fresh(self, handle)
        self.handle, register = handle, handle.registerTimer

        def noted(time):
            with open(registered, "a") as file:
                file.write("x")
            register(time)

        handle.registerTimer = noted

    monkeypatch.setattr(streams._Waiting, "init", init)
    monkeypatch.setattr(streams._Waiting, "__module__", "__main__")  # pickled by value, with the method above
    with streams.keyed_state(spark):
        streams.drain_to(streams.awaited(streams.timed(log, "ts", "1 day"), rule, buckets=2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = sorted((r.u, r.opened, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).where("u IS NULL OR u >= 0").selectExpr("coalesce(u, -9) AS u", "opened", "coalesce(answer, -9) AS answer").collect())
    expected = []
    for i, u, kind, t in rows:
        if kind == "click":
            later = [(s, j) for j, v, k, s in rows if k == "buy" and u is not None and v == u and t < s <= t + datetime.timedelta(minutes=10)]
            expected.append((-9 if u is None else u, i, min(later)[1] if later else -9))
    assert found == sorted(expected)
    # Two buckets, at most a timer for each batch and one for what stays; there were 320 for the rows.
    assert len(open(registered).read()) <= 16


@pytest.mark.parametrize("name", ["stream_state_timers", "stream_session"])
def test_no_row_is_late_when_a_part_of_a_stream_has_several_files(spark, sf_dir, tmp_path, name):
    # Files that don't follow each other in time.
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        same(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLES[name]).df())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_sessions_leave_the_state(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    for k in range(6):
        rows = [(start + datetime.timedelta(hours=12 * k + h), u) for u in range(3) for h in (0, 1)]
        streams.append_log(spark.createDataFrame(rows, "ts timestamp_ntz, u long").coalesce(1), str(tmp_path / "log"), str(k))
    schema = spark.read.parquet(str(tmp_path / "log" / "b-0")).schema
    log = streams.read_log(spark, str(tmp_path / "log"), schema, files_per_trigger=1)
    found = streams.sessions(streams.timed(log, "ts", "1 hour"), "ts", "2 hours", ["u"], F.count("*").alias("n"))
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 6 and max(states) <= 6
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == len({(r.session_start, r.u) for r in out}) >= 15 and {r.n for r in out} == {2}


def test_windows_of_a_stream_input(spark, lake):
    rows = spark.createDataFrame([(k, datetime.datetime(2026, 1, 1, 0, 0, 50 + k)) for k in (0, 5, 9)], "id int, at timestamp_ntz")
    streams.append_log(rows, f"{lake}/p/l.source")
    node = {"name": "n", "inputs": [{"alias": "rows", "methods": [{"method": "stream", "connection": "logs", "stream_name": "l.source", "window": 20, "event_time": "at"}]}], "outputs": {"methods": [{"method": "sql", "connection": "logs", "database": "w", "table": "n"}]}}
    pipeline = {"name": "p", "connections": [{"name": "logs", "type": "stream", "path": lake}], "layers": [{"name": "l", "nodes": [node]}]}
    assert Engine(spark, events_path=f"{lake}/_events").run(pipeline) == {"l.n": Status.SUCCESS}
    found = Table(spark, "w", "n", f"{lake}/w").read()
    assert {r.id: r.window_start.second for r in found.collect()} == {0: 40, 5: 40, 9: 40}


def test_updates_of_windows_over_several_batches(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    for part in range(3):
        rows = [(start + datetime.timedelta(minutes=20 * k + part), k) for k in range(6)]
        streams.append_log(spark.createDataFrame(rows, "ts timestamp_ntz, v int").coalesce(1), str(tmp_path / "log"))
    log = streams.read_log(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema, files_per_trigger=1)
    windows = streams.tumbling(streams.timed(log, "ts", "1 day"), "ts", "1 hour", [], F.count("*").alias("n"), F.sum("v").alias("total"))
    streams.drain_updates(windows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3
    found = {r.window_start.hour: (r.n, r.total) for r in streams.read_updates(spark, str(tmp_path / "out"), ["window_start"]).collect()}
    assert found == {0: (9, 9), 1: (9, 36)}


def test_nearest_point(spark):
    places = [("a", 0.0, 0.0), ("b", 10.0, 0.0), ("c", 0.0, 10.0)]
    points = [(1.0, 1.0), (9.0, 2.0), (2.0, 9.0), (5.0, 0.0), (None, 1.0)]
    found = spark.createDataFrame(points, "x double, y double").select(joins.nearest_point(F.col("x"), F.col("y"), places).alias("p"))
    assert [r.p for r in found.collect()] == ["a", "b", "c", "a", None]


def test_registry_and_preview(spark, lake, tmp_path):
    for name in ("one", "two"):
        made = {"name": name, "layers": [{"name": "l", "nodes": [{"name": n} for n in "ab"[: len(name) - 1]]}]}
        config.save(made, tmp_path / f"{name}.yml")
    found = config.registry(spark, str(tmp_path)).collect()
    assert [(r.file, r.pipeline, r.nodes) for r in found] == [("one.yml", "one", 2), ("two.yml", "two", 2)]
    assert config.from_registry(spark, str(tmp_path), "two")["name"] == "two"
    with pytest.raises(KeyError):
        config.from_registry(spark, str(tmp_path), "three")
    house = Warehouse(spark, lake)
    house.table("w", "t").create(spark.range(1).schema).append(spark.range(50))
    assert house.preview("w", "t").count() == 20 and house.preview("w", "t", 3).count() == 3
