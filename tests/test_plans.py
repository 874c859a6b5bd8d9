import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from millrace.api import Warehouse
from millrace.plans import config, dag, metrics
from millrace.plans.dag import InvalidPipeline, Status
from millrace.plans.runner import Engine
from millrace.sources import rest


def chain(*names, **extra):
    nodes = [{"name": n, "inputs": [{"ref": f"l.{p}"}] if p else [], **extra.get(n, {})} for p, n in zip((None, *names), names, strict=False)]
    return {"name": "p", "layers": [{"name": "l", "nodes": nodes}]}


def test_graph():
    graph = dag.compile_graph(chain("pick", "wash", "press", "bottle"))
    assert graph.edges == [("l.pick", "l.wash"), ("l.wash", "l.press"), ("l.press", "l.bottle")]
    assert graph.order() == ["l.pick", "l.wash", "l.press", "l.bottle"]
    assert graph.depth() == {"l.pick": 0, "l.wash": 1, "l.press": 2, "l.bottle": 3}
    for empty in ({}, {"layers": []}, {"layers": [{"name": "a"}]}):
        assert dag.compile_graph(empty).nodes == {}
    two = {"layers": [{"name": a, "nodes": [{"name": "n"}]} for a in "ab"]}
    assert set(dag.compile_graph(two).nodes) == {"a.n", "b.n"}


@pytest.mark.parametrize(
    ("pipeline", "part"),
    [
        ({"layers": [{"name": "l", "nodes": [{"name": "a", "inputs": [{"ref": "l.b"}]}, {"name": "b", "inputs": [{"ref": "l.a"}]}]}]}, "cycle"),
        (chain("a") | {"layers": [{"name": "l", "nodes": [{"name": "a", "inputs": [{"ref": "l.z"}]}]}]}, "isn't there"),
        ({"layers": [{"name": "l", "nodes": [{"name": "a"}, {"name": "a"}]}]}, "twice"),
        (chain("a", a={"outputs": {"methods": [{"method": "fax"}]}}), "unknown method"),
        (chain("a", a={"outputs": {"methods": [{"method": "sql", "sql_type": "upsert"}]}}), "sql_type"),
        (chain("a", a={"on_failure": "shrug"}), "on_failure"),
        (chain("a", a={"schema": [{"name": "x", "type": "blob of things"}]}), "unknown type"),
        (chain("a", a={"inputs": [{"methods": [{"method": "sql", "connection": "nope"}]}]}), "no connection"),
        (chain("a") | {"connections": [{"name": "c", "type": "pigeon"}]}, "pigeon"),
        (chain("a") | {"connections": [{"name": "c", "type": "api"}]}, "base_url"),
    ],
)
def test_invalid_pipelines(spark, pipeline, part):
    with pytest.raises(InvalidPipeline, match=part):
        config.validate(pipeline)


def test_yaml(tmp_path):
    with pytest.raises(InvalidPipeline):
        config.load("name: p\nlayers: {name: 'l\n")
    config.save(chain("a"), tmp_path / "p.yml")
    assert config.load(tmp_path / "p.yml") == chain("a")


@pytest.mark.parametrize(("parent", "ready"), [("success", True), ("live", True), ("pending", False), ("failed", False)])
def test_ready(spark, parent, ready):
    graph = dag.compile_graph(chain("a", "b"))
    status = {"l.a": Status(parent), "l.b": Status.PENDING}
    assert ("l.b" in graph.ready(status)) == ready
    found = dag.ready_nodes(dag.status_rows(spark, status), dag.edge_rows(spark, graph)).collect()
    assert ("l.b" in [r.node for r in found]) == ready
    assert graph.complete({"l.a": Status.SUCCESS, "l.b": Status.SKIPPED}) and not graph.complete(status)


class Handler(BaseHTTPRequestHandler):
    got: list = []

    def log_message(self, *_):
        pass

    def _answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        if self.path == "/secret" and self.headers.get("Authorization") != "Bearer t":
            return self._answer(401, {})
        self._answer(200, {"rows": [{"city": "A", "current": {"t": 1.5}, "at": "2026-01-01T00:00:00"}, {"city": "B", "current": {"t": 2.5}, "at": "2026-01-01T00:00:00"}]})

    def do_POST(self):
        Handler.got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        self._answer(201, {"ok": True})


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_rest(spark, server):
    assert rest.read_rest(spark, f"{server}/x", selector="rows").count() == 2
    assert rest.read_rest(spark, f"{server}/secret", selector="rows", auth="bearer", token="t").count() == 2
    with pytest.raises(Exception, match="401"):
        rest.read_rest(spark, f"{server}/secret", retries=0).count()
    rest.write_rest(spark.range(3).coalesce(1), f"{server}/y", batch_size=2)
    assert Handler.got[-2:] == [{"data": [{"id": 0}, {"id": 1}]}, {"data": [{"id": 2}]}]


def test_pipeline_end_to_end(spark, server, tmp_path):
    lake = str(tmp_path / "lake")
    method = {"method": "sql", "connection": "lake", "database": "weather"}
    pipeline = {
        "name": "weather",
        "connections": [{"name": "lake", "type": "warehouse", "path": lake}, {"name": "api", "type": "api", "base_url": server}, {"name": "logs", "type": "stream", "path": f"{lake}/_streams"}],
        "layers": [
            {"name": "bronze", "nodes": [{"name": "fetch", "inputs": [{"alias": "body", "methods": [{"method": "api", "connection": "api", "endpoint": "x", "payload_template": "rows"}]}], "outputs": {"methods": [{"method": "stream", "connection": "logs"}, method | {"table": "raw"}]}}]},
            {"name": "silver", "nodes": [
                {"name": "city", "inputs": [{"ref": "bronze.fetch", "alias": "rows", "methods": [{"method": "stream", "connection": "logs"}]}], "schema": [{"name": "city", "type": "string", "description": "its name"}, {"name": "t", "type": "double"}, {"name": "at", "type": "timestamp"}], "outputs": {"methods": [method | {"table": "city", "sql_type": "scd2", "primary_key": ["city"], "timestamp_expr": "s.at", "tracked_columns": ["t"]}]}},
                {"name": "off", "enabled": False, "inputs": [{"ref": "bronze.fetch"}]},
            ]},
            {"name": "gold", "nodes": [
                {"name": "hot", "inputs": [{"ref": "silver.city", "methods": [method | {"table": "city", "columns": ["city", "t"], "filters": {"is_current": True}, "sort_by": [{"column": "t", "order": "desc"}], "limit": 1}]}], "outputs": {"methods": [{"method": "api", "connection": "api", "endpoint": "z"}]}},
                {"name": "below", "inputs": [{"ref": "silver.off"}]},
            ]},
        ],
    }
    engine = Engine(spark, events_path=f"{lake}/_events")

    @engine.node("silver.city")
    def flatten(inputs, context):
        assert context["node"] == "city"
        return inputs["rows"].selectExpr("get_json_object(body, '$.city') AS city", "CAST(get_json_object(body, '$.current.t') AS DOUBLE) AS t", "CAST(get_json_object(body, '$.at') AS TIMESTAMP_NTZ) AS at")

    for _ in range(2):
        status = engine.run(pipeline)
        assert {n: s.value for n, s in status.items()} == {"bronze.fetch": "success", "silver.city": "success", "silver.off": "skipped", "gold.hot": "success", "gold.below": "skipped"}
    assert Handler.got[-1] == {"data": [{"city": "B", "t": 2.5}]}
    house = Warehouse(spark, lake)
    assert house.databases() == ["weather"] and house.tables("weather") == ["city", "raw"]
    assert {r.city: r.is_current for r in house.table("weather", "city").read().collect()} == {"A": True, "B": True}
    assert house.table("weather", "raw").read().count() == 4
    assert house.columns("weather", "city").where("column_name = 'city'").first().comment == "its name"
    assert house.sql("SELECT count(*) AS n FROM {c}", c="weather.city").first().n == 2
    events = metrics.latest(engine.events(), ["run_id", "node_id"], "at")
    assert events.count() == 6 and events.where("status = 'success'").count() == 6
    means = {r.node_id: r for r in metrics.node_summary(engine.events()).collect()}
    assert set(means) == {"bronze.fetch", "silver.city", "gold.hot"} and all(r.batches == 2 and r.sum_post_seconds > 0 for r in means.values())
    assert {n: r.sum_records for n, r in means.items()} == {"bronze.fetch": 4, "silver.city": 4, "gold.hot": 2}
    assert metrics.node_summary(engine.events(), measures=metrics.MEMORY).where("avg_post_mib > 50").count() == 3
    assert metrics.filter_logs(engine.logs(), "info", component="silver.*").count() == 4
    before = sorted(map(tuple, engine.events().collect()), key=repr)
    assert sorted(map(tuple, Engine(spark, events_path=f"{lake}/_events").events().collect()), key=repr) == before
    assert engine.compact() == len(before) == 12 and engine.compact() == 1
    assert sorted(map(tuple, engine.events().collect()), key=repr) == before
    spark.sql("DROP DATABASE weather CASCADE")


def test_averages_are_of_whole_attempts(spark):
    def slow(inputs, context):
        time.sleep(1.0)
        return spark.range(3)

    engine = Engine(spark, {"*": slow})
    engine.run(chain("a", a={"outputs": {"methods": []}}))
    found = metrics.node_summary(engine.events()).first()
    assert found.batches == 1 and 0.99 < found.avg_function_seconds < 2 and found.sum_function_seconds == found.avg_function_seconds


def test_failures(spark, tmp_path):
    calls = []

    def flaky(inputs, context):
        calls.append(context["node_id"])
        if len([c for c in calls if c == context["node_id"]]) < 3:
            raise RuntimeError("not yet")
        return spark.range(1)

    def broken(inputs, context):
        raise ValueError("never")

    made = {"outputs": {"methods": []}}
    pipeline = chain("a", "b", "c", a=made | {"on_failure": "retry"}, b=made | {"on_failure": "continue"}, c=made)
    engine = Engine(spark, {"l.a": flaky, "l.b": broken, "l.c": lambda inputs, context: spark.range(1)})
    assert [s.value for s in engine.run(pipeline).values()] == ["success", "failed", "success"]
    stopped = Engine(spark, {"l.a": broken, "*": lambda inputs, context: spark.range(1)})
    assert [s.value for s in stopped.run(chain("a", "b", a=made, b=made)).values()] == ["failed", "skipped"]
    failed = stopped.events().where("status = 'failed'").first()
    assert failed.error_type == "ValueError" and "never" in failed.error_message
    wrong = Engine(spark, {"*": lambda inputs, context: 5})
    assert [s.value for s in wrong.run(chain("a", a=made)).values()] == ["failed"]
