"""Running a pipeline on one Spark session."""

from __future__ import annotations

import json
import resource
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.functions.expressions import schema_projection
from millrace.functions.types import schema_of
from millrace.operators.scd2 import Dimension
from millrace.plans import config as configs
from millrace.plans import metrics
from millrace.plans.dag import Status, methods_of
from millrace.sources import files, rest, tables
from millrace.sources.catalog import Table
from millrace.streaming import streams

Function = Callable[[dict[str, DataFrame], dict], DataFrame]
EVENTS = "run_id string, node_id string, status string, level string, at timestamp, attempt int, pre_seconds double, function_seconds double, post_seconds double, pre_mib double, function_mib double, post_mib double, records long, batch long, error_type string, error_message string"
MAX_ATTEMPTS = 3
#: Seconds that a live node waits for the log of a live node above it.
PATIENCE = 60.0


class _Meter:
    """Seconds, memory of the driver and records of one batch of a node."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen, self.records = spark, {}, None

    @contextmanager
    def part(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seen[f"{name}_seconds"] = self.seen.get(f"{name}_seconds", 0.0) + time.monotonic() - began
            runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
            own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            self.seen[f"{name}_mib"] = round(own + (runtime.totalMemory() - runtime.freeMemory()) / 2**20, 1)

    def counted(self, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted by the first action on it, which must follow:
        :meth:`row` waits for it."""
        df, self.records = metrics.observed(df, f"rows-{uuid.uuid4().hex}")
        return df

    def row(self) -> dict:
        out = dict(self.seen)
        if self.records is not None:
            out["records"] = metrics.observation(self.records).get("rows", 0)
        return out


class _Watch(StreamingQueryListener):
    """Writes an event for each micro-batch of an engine's live nodes, and for a query
    that dies, whose node it sets to failed."""

    def __init__(self, engine: Engine):
        self.engine, self.names = engine, {}

    def onQueryStarted(self, event) -> None:
        if event.name in self.engine.live:
            self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        query = event.progress.name
        if query in self.engine.live:
            self.engine.batch_ended(query, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        query = self.names.pop(str(event.id), None)
        if query and event.exception:
            self.engine.died(query, event.exception)


@dataclass
class Engine:
    """Node functions get ``{alias: DataFrame}`` and a context and return a DataFrame;
    ``functions`` are by node id, with ``*`` for all others. A node without a function
    passes its only input on. Tables and logs live under the connections' paths, run
    events under ``events_path``."""

    spark: SparkSession
    functions: dict[str, Function] = field(default_factory=dict)
    events_path: str | None = None
    workers: int = 4
    patience: float = PATIENCE
    log: list[tuple] = field(default_factory=list)
    #: Statuses of the last run's nodes; that of a live node changes when its query dies.
    statuses: dict[str, Status] = field(default_factory=dict)
    #: Streaming queries of live nodes, how to start them, and by names of queries their
    #: nodes and the meters of their micro-batches.
    queries: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)
    live: dict = field(default_factory=dict)
    watch: _Watch | None = None
    dead: set = field(default_factory=set)
    lock: threading.RLock = field(default_factory=threading.RLock)

    def node(self, name: str) -> Callable[[Function], Function]:
        def register(function: Function) -> Function:
            self.functions[name] = function
            return function

        return register

    def run(self, source, run_id: str | None = None) -> dict[str, Status]:
        """Run every node once its parents are done, several at a time, and return
        the nodes' statuses; one that fails is FAILED, whatever follows from it. Live
        nodes go on as streaming queries until :meth:`pause` or :meth:`stop`."""
        pipeline = configs.load(source, self.spark)
        graph, run_id = configs.validate(pipeline), run_id or uuid.uuid4().hex
        connections, status = configs.connections(pipeline), graph.initial()
        context = {"pipeline": pipeline.get("name") or "pipeline", "run_id": run_id, "nodes": graph.nodes}
        self.statuses = status
        running = {}
        with ThreadPoolExecutor(self.workers) as pool:
            while True:
                self._settle(graph, status)
                for name in graph.ready(status):
                    status[name] = Status.RUNNING
                    running[pool.submit(self._attempts, name, graph.nodes[name], connections, context)] = name
                if not running:
                    break
                for done in wait(running, return_when=FIRST_COMPLETED).done:
                    name, ended = running.pop(done), done.result()
                    with self.lock:  # its query may have died meanwhile
                        status[name] = Status.FAILED if name in self.dead else ended
        return status

    def _settle(self, graph, status: dict[str, Status]) -> None:
        """Nodes below one that is skipped, or failed and stops the pipeline, are skipped."""
        for name in graph.order():
            if status[name] == Status.PENDING and any(status[p] in (Status.FAILED, Status.SKIPPED) and not graph.met(p, status) for p in graph.parents[name]):
                status[name] = Status.SKIPPED

    def _attempts(self, name: str, node: dict, connections: dict, context: dict) -> Status:
        attempts = MAX_ATTEMPTS if node.get("on_failure") == "retry" else 1
        for attempt in range(1, attempts + 1):
            meter = _Meter(self.spark)
            self._event(context, name, Status.RUNNING, attempt)
            # A stream that this thread ran before may have left its own session active.
            self.spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(self.spark._jsparkSession)
            try:
                self._execute(name, node, connections, context, meter)
            except Exception as error:
                self._event(context, name, Status.FAILED, attempt, meter.seen, error=error)
            else:
                if node.get("type") == "live":
                    self._event(context, name, Status.LIVE, attempt, meter.seen)
                    return Status.LIVE
                self._event(context, name, Status.SUCCESS, attempt, meter.row())
                return Status.SUCCESS
        return Status.FAILED

    def batch_ended(self, query: str, batch: int) -> None:
        """A micro-batch of a live node has ended; triggers without one have no meter."""
        with self.lock:
            name, context, meters = self.live[query]
            meter = meters.pop(batch, None)
        if meter is not None:
            self._event(context, name, Status.LIVE, 1, meter.row(), batch)

    def died(self, query: str, message: str) -> None:
        """The query of a live node has ended with an error."""
        with self.lock:
            name, context, _ = self.live[query]
            self.dead.add(name)
            if self.statuses.get(name) == Status.LIVE:
                self.statuses[name] = Status.FAILED
        self._event(context, name, Status.FAILED, 1, error=message)

    def _event(self, context: dict, name: str, status: Status, attempt: int, seen: dict | None = None, batch: int | None = None, error: Exception | str | None = None) -> None:
        """An event is a small file of its own, written when it happens, so a crash loses
        none; without an events path it is kept in memory. :meth:`compact` joins them."""
        level = "ERROR" if status == Status.FAILED else "INFO"
        kind = type(error).__name__ if isinstance(error, Exception) else "StreamingQueryException" if error else None
        message = "".join(traceback.format_exception(error))[-4000:] if isinstance(error, Exception) else error[:4000] if error else None
        measured = [(seen or {}).get(m) for m in (*metrics.MEASURES, *metrics.MEMORY, "records")]
        row = (context["run_id"], name, status.value, level, datetime.now(timezone.utc), attempt, *measured, batch, kind, message)
        with self.lock:
            self.log.append(row)
        if self.events_path:
            names = [f.split()[0] for f in EVENTS.split(", ")]
            text = json.dumps(dict(zip(names, row, strict=True)), default=lambda at: at.isoformat())
            files.write_text(self.spark, f"{self.events_path}/{context['run_id']}-{uuid.uuid4().hex}.json", text)

    def compact(self) -> int:
        """Join the events' files into one per run of this; the number of files joined.
        What is joined is written first and under a name that says which files it has, so
        events are neither lost nor doubled if this ends half-way."""
        names = files.names(self.spark, self.events_path, ".json") if self.events_path else []
        if len(names) > 1:
            text = "\n".join(files.read_text(self.spark, f"{self.events_path}/{n}").rstrip("\n") for n in names)
            files.replace(self.spark, self.events_path, names, f"joined-{uuid.uuid4().hex}.json", text)
        return len(names)

    def events(self) -> DataFrame:
        """Run events: those of this and earlier runs under the events path."""
        if self.events_path and files.names(self.spark, self.events_path, ".json"):
            return self.spark.read.schema(EVENTS).json(f"{self.events_path}/*.json")
        return self.spark.createDataFrame(self.log, EVENTS)

    def logs(self) -> DataFrame:
        """The events as log rows, for :func:`millrace.plans.metrics.filter_logs`."""
        text = F.concat_ws(" ", "node_id", "status", F.concat(F.lit("attempt "), "attempt"), F.concat(F.lit("- "), "error_message"))
        return self.events().select(F.col("at").alias("timestamp"), "level", F.col("node_id").alias("component"), text.alias("message"), "run_id")

    def resume(self, name: str) -> None:
        """Start a live node's query again, from the place in its checkpoint."""
        if name not in self.queries or not self.queries[name].isActive:
            with self.lock:
                self.dead.discard(name)
                if name in self.statuses:
                    self.statuses[name] = Status.LIVE
            self.queries[name] = self.starts[name]()

    def pause(self, name: str) -> None:
        """End a live node's query after the batch at hand; :meth:`resume` goes on."""
        self.queries[name].stop()

    def stop(self) -> None:
        for name in self.queries:
            self.pause(name)

    def _execute(self, name: str, node: dict, connections: dict, context: dict, meter: _Meter) -> None:
        inputs, stream = {}, None
        with meter.part("pre"):
            for part in node.get("inputs") or []:
                for method in part.get("methods") or []:
                    df, is_stream = self._read(part, method, node, connections, context)
                    inputs[part.get("alias") or part.get("ref") or "input"] = df
                    if is_stream:
                        stream, where = df, connections.get(method.get("connection"), {}).get("path")
                    break
        layer, _, bare = name.partition(".")
        about = {k: v for k, v in context.items() if k != "nodes"} | {"node_id": name, "layer": layer, "node": bare}

        def run(given: dict[str, DataFrame], to: _Meter, batch: str | None = None) -> None:
            call = self.functions.get(name) or self.functions.get("*") or (lambda rows, _: next(iter(rows.values())))
            with to.part("function"):
                made = call(given, about)
            with to.part("post"):
                self._write(made, node, connections, about, to, batch)

        if stream is None:
            run(inputs, meter)
            return
        key = next(k for k, v in inputs.items() if v is stream)
        checkpoint = f"{where or self.events_path}/_checkpoints/{context['pipeline']}/{name}"
        if node.get("type") != "live":
            streams.drain_batches(stream, lambda rows, k: run(inputs | {key: rows}, meter, streams.batch_name(checkpoint, k)), checkpoint)
            return
        query, meters = f"{name}-{uuid.uuid4().hex}", {}

        def each(rows: DataFrame, k: int) -> None:
            own = _Meter(self.spark)
            own.seen["pre_seconds"] = 0.0
            run(inputs | {key: rows}, own, streams.batch_name(checkpoint, k))
            with self.lock:
                meters[k] = own

        with self.lock:
            self.live[query] = (name, context, meters)
            self.dead.discard(name)
            if self.watch is None:
                self.watch = _Watch(self)
                self.spark.streams.addListener(self.watch)
        self.starts[name] = lambda: streams.follow_batches(stream, each, checkpoint, node.get("every") or "1 second", query)
        self.resume(name)

    def _log(self, part: dict, method: dict, node: dict, connection: dict, context: dict) -> DataFrame:
        """The stream over a log. One that a live node above has yet to write gets the
        schema that this declares; otherwise its first batch is waited for."""
        path = f"{connection['path']}/{context['pipeline']}/{method.get('stream_name') or part['ref']}"
        schema, until = streams.log_schema(self.spark, path), time.monotonic() + self.patience
        above = context["nodes"].get(part.get("ref")) or {}
        if schema is None and above.get("schema"):
            fields = [{**f, "name": f.get("alias") or f["name"]} for f in above["schema"]]
            schema = schema_of(fields)
            files.make_folder(self.spark, path)
        while schema is None and above.get("type") == "live" and part["ref"] not in self.dead and time.monotonic() < until:
            time.sleep(0.1)
            schema = streams.log_schema(self.spark, path)
        if schema is None:
            raise FileNotFoundError(f"nothing has been written to {path}")
        found = streams.read_log(self.spark, path, schema, method.get("files_per_trigger"))
        if method.get("window") and method.get("event_time"):
            found = streams.in_windows(found, method["event_time"], f"{method['window']} seconds")
        return found

    def _read(self, part: dict, method: dict, node: dict, connections: dict, context: dict) -> tuple[DataFrame, bool]:
        kind, connection = method["method"], connections.get(method.get("connection"), {})
        if kind == "stream":
            return self._log(part, method, node, connection, context), True
        if kind == "api":
            url = connection["base_url"].rstrip("/") + "/" + (method.get("endpoint") or "").lstrip("/")
            auth = connection.get("authentication") or {}
            if node.get("type") == "live":
                polled = rest.stream_rest(self.spark, url, page_param=method.get("page_param") or "page", selector=method.get("payload_template"), auth=auth.get("type"), token=auth.get("token"), timeout=connection.get("timeout"), retries=connection.get("retries"))
                return polled, True
            body = rest.read_rest(self.spark, url, selector=method.get("payload_template"), auth=auth.get("type"), token=auth.get("token"), timeout=connection.get("timeout"), retries=connection.get("retries"))
            return body, False
        if method.get("query"):
            named = {p.rsplit("/", 1)[-1]: self._table(connection, p).read() for p in method.get("tables") or []}
            return tables.guarded_sql(self.spark, method["query"], **named), False
        source = self._table(connection, f"{method['database']}/{method['table']}").read() if method.get("database") else self.spark.read.parquet(f"{connection['path']}/{method['table']}.parquet")
        return tables.select(source, method.get("columns"), method.get("filters"), method.get("sort_by"), method.get("limit")), False

    def _table(self, connection: dict, name: str) -> Table:
        database, _, table = name.partition("/")
        return Table(self.spark, database, table, f"{connection['path']}/{database}")

    def _write(self, df, node: dict, connections: dict, context: dict, meter: _Meter, batch: str | None = None) -> None:
        fields = node.get("schema") or []
        if isinstance(df, list):
            df = tables.literal_rows(self.spark, df, schema_of(fields))
        if not isinstance(df, DataFrame):
            raise TypeError(f"{context['node_id']} returned {type(df).__name__}, not a DataFrame or rows")
        if any(f.get("expr") or f.get("alias") for f in fields):
            df = schema_projection(df, fields)
        methods = methods_of(node.get("outputs"))
        df = df.persist() if len(methods) > 1 else df
        try:
            for k, method in enumerate(methods):
                connection = connections.get(method.get("connection"), {})
                count = meter.counted if k == 0 else (lambda rows: rows)
                if method["method"] == "stream":
                    streams.append_log(df, f"{connection['path']}/{context['pipeline']}/{method.get('stream_name') or context['node_id']}", batch, count)
                elif method["method"] == "api":
                    auth = connection.get("authentication") or {}
                    rest.write_rest(count(df), connection["base_url"].rstrip("/") + "/" + (method.get("endpoint") or "").lstrip("/"), auth=auth.get("type"), token=auth.get("token"))
                else:
                    self._write_table(df, method, node, connection, count, batch)
        finally:
            if len(methods) > 1:
                df.unpersist()

    def _write_table(self, df: DataFrame, method: dict, node: dict, connection: dict, count: Callable, batch: str | None) -> None:
        fields = [{**f, "name": f.get("alias") or f["name"]} for f in node.get("schema") or []]
        schema = schema_of(fields) if fields else df.schema
        table = self._table(connection, f"{method['database']}/{method['table']}")
        if method.get("sql_type", "insert") == "insert":
            table.create(schema, node.get("description")).append(count(df), batch)
            return
        keys = method["primary_key"]
        event_time = (method.get("timestamp_expr") or "CURRENT_TIMESTAMP").rsplit(".", 1)[-1]
        if event_time.upper() in ("CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP()"):
            event_time, df = "_loaded_at", df.withColumn("_loaded_at", F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
        dim = Dimension([keys] if isinstance(keys, str) else list(keys), event_time, method.get("begin_date_col") or "begin_date", method.get("end_date_col") or "end_date", method.get("is_current_col") or "is_current", method.get("tracked_columns"))
        extra = {dim.begin, dim.end, dim.current}
        wanted = [f.name for f in schema.fields if f.name not in extra]
        rows = df.select(*[c for c in df.columns if c in wanted or c == event_time])
        if not table.exists():
            made = schema
            for name, kind in ((event_time, dict(rows.dtypes)[event_time]), (dim.begin, "timestamp_ntz"), (dim.end, "timestamp_ntz"), (dim.current, "boolean")):
                made = made if name in made.names else made.add(name, kind)
            table.create(made, node.get("description"), dim.keys, int(method.get("buckets") or 64))
        table.apply_scd2(rows, dim, batch, count)
