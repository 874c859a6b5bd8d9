"""Pipelines as graphs: nodes, edges, order, and which nodes may run."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Status(str, Enum):
    SCHEDULED = "scheduled"
    PENDING = "pending"
    RUNNING = "running"
    LIVE = "live"
    SUCCESS = "success"
    FAILED = "failed"
    SKIPPED = "skipped"


SETTLED = (Status.SUCCESS, Status.FAILED, Status.SKIPPED)


class InvalidPipeline(ValueError):
    """All that is wrong with a configuration, one line each."""

    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


@dataclass
class Graph:
    nodes: dict[str, dict] = field(default_factory=dict)
    parents: dict[str, list[str]] = field(default_factory=dict)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return [(parent, node) for node, parents in self.parents.items() for parent in parents]

    def order(self) -> list[str]:
        return list(TopologicalSorter(self.parents).static_order())

    def depth(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for node in self.order():
            out[node] = 1 + max((out[p] for p in self.parents[node]), default=-1)
        return out

    def initial(self) -> dict[str, Status]:
        return {n: Status.SKIPPED if not c.get("enabled", True) else Status.SCHEDULED if c.get("type") == "scheduled" else Status.PENDING for n, c in self.nodes.items()}

    def ready(self, status: dict[str, Status]) -> list[str]:
        """Pending nodes all of whose parents are met."""
        return [n for n, s in status.items() if s == Status.PENDING and all(self.met(p, status) for p in self.parents[n])]

    def met(self, name: str, status: dict[str, Status]) -> bool:
        """Whether children of a node may run: it succeeded, is live, or failed although
        the pipeline is to continue."""
        return status[name] in (Status.SUCCESS, Status.LIVE) or status[name] == Status.FAILED and self.nodes[name].get("on_failure") == "continue"

    def complete(self, status: dict[str, Status]) -> bool:
        return all(s in SETTLED for s in status.values())


METHODS = {"inputs": {"sql", "table", "stream", "api"}, "outputs": {"sql", "stream", "api"}}
SQL_TYPES = {"insert", "scd_type_2", "scd2"}


def methods_of(part) -> list[dict]:
    """The methods of an output, given as a mapping or as a list of such."""
    parts = part if isinstance(part, list) else [part] if part else []
    return [m for p in parts for m in (p.get("methods", [p]) if isinstance(p, dict) else [])]


def compile_graph(config: dict) -> Graph:
    """The graph of a configuration. Node ids are ``layer.node``. Raises
    InvalidPipeline with every duplicate, dangling reference, cycle, unknown method
    and unknown kind of SQL output."""
    graph, faults = Graph(), []
    for layer in config.get("layers") or []:
        for node in layer.get("nodes") or []:
            name = f"{layer.get('name')}.{node.get('name')}"
            if name in graph.nodes:
                faults.append(f"{name}: defined twice")
            graph.nodes[name] = node
            refs = [i["ref"] for i in node.get("inputs") or [] if i.get("ref")]
            graph.parents[name] = list(dict.fromkeys(refs))
            for side, methods in (("inputs", [m for i in node.get("inputs") or [] for m in i.get("methods") or []]), ("outputs", methods_of(node.get("outputs")))):
                for method in methods:
                    if method.get("method") not in METHODS[side]:
                        faults.append(f"{name}: unknown method {method.get('method')!r} among its {side}")
                    if side == "outputs" and method.get("method") == "sql" and method.get("sql_type", "insert") not in SQL_TYPES:
                        faults.append(f"{name}: unknown sql_type {method.get('sql_type')!r}")
            if node.get("on_failure", "stop") not in ("stop", "continue", "retry"):
                faults.append(f"{name}: unknown on_failure {node.get('on_failure')!r}")
    for name, parents in graph.parents.items():
        faults += [f"{name}: refers to {p}, which isn't there" for p in parents if p not in graph.nodes]
    if not faults:
        try:
            graph.order()
        except CycleError as error:
            faults.append(f"a cycle: {' -> '.join(error.args[1])}")
    if faults:
        raise InvalidPipeline(faults)
    return graph


def edge_rows(spark: SparkSession, graph: Graph) -> DataFrame:
    return spark.createDataFrame(graph.edges, "parent string, node string")


def status_rows(spark: SparkSession, status: dict[str, Status]) -> DataFrame:
    return spark.createDataFrame([(n, s.value) for n, s in status.items()], "node string, status string")


def ready_nodes(status: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph.ready over tables: (run, )node and status against (parent, node)."""
    parents = edges.join(status.select(F.col("node").alias("parent"), F.col("status").alias("parent_status")), "parent", "left")
    met = parents.groupBy("node").agg(F.bool_and(F.coalesce(F.col("parent_status").isin("success", "live"), F.lit(False))).alias("met"))
    return status.where("status = 'pending'").join(met, "node", "left").where(F.coalesce("met", F.lit(True))).select("node")
