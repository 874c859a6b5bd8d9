"""Pipeline configurations: loading, connections, and what they declare."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import schema_of
from millrace.plans.dag import Graph, InvalidPipeline, compile_graph, methods_of
from millrace.sources import files

CONNECTIONS = {"warehouse": {"path"}, "api": {"base_url"}, "stream": {"path"}}


def load(source: str | Path | dict, spark: SparkSession | None = None) -> dict:
    """A configuration from YAML text, a file or a mapping, validated. With a session,
    a file given as a string is on any file system that Spark knows."""
    import yaml

    if isinstance(source, dict):
        config = source
    else:
        if isinstance(source, str) and "\n" in source:
            text = source
        else:
            text = files.read_text(spark, source) if spark and isinstance(source, str) else Path(source).read_text()
        try:
            config = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise InvalidPipeline([f"not YAML: {error}"]) from error
    validate(config)
    return config


def save(config: dict, path: str | Path) -> None:
    import yaml

    validate(config)
    Path(path).write_text(yaml.safe_dump(config, sort_keys=False))


def validate(config: dict) -> Graph:
    """The configuration's graph; raises InvalidPipeline with all that is wrong."""
    if not isinstance(config, dict):
        raise InvalidPipeline(["a pipeline is a mapping"])
    faults = []
    named = connections(config, faults)
    try:
        graph = compile_graph(config)
    except InvalidPipeline as invalid:
        raise InvalidPipeline(faults + invalid.faults) from None
    for name, node in graph.nodes.items():
        for method in [m for i in node.get("inputs") or [] for m in i.get("methods") or []] + methods_of(node.get("outputs")):
            if method.get("connection") and method["connection"] not in named:
                faults.append(f"{name}: no connection {method['connection']!r}")
        try:
            schema_of(node.get("schema") or [])
        except ValueError as error:
            faults.append(f"{name}: {error}")
    if faults:
        raise InvalidPipeline(faults)
    return graph


def connections(config: dict, faults: list[str] | None = None) -> dict[str, dict]:
    out = {}
    for connection in config.get("connections") or []:
        kind, name = connection.get("type"), connection.get("name")
        missing = CONNECTIONS.get(kind, set()) - set(connection)
        if faults is not None and (kind not in CONNECTIONS or missing or not name):
            faults.append(f"connection {name!r}: unknown type {kind!r}" if kind not in CONNECTIONS else f"connection {name!r}: needs {', '.join(sorted(missing)) or 'a name'}")
        out[name] = connection
    return out


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """One row per configuration in a folder: its file, and its :func:`summary`."""
    found = [name for ending in (".yml", ".yaml") for name in files.names(spark, folder, ending)]
    rows = [(name, *_summary(load(f"{folder}/{name}", spark))) for name in sorted(found)]
    return spark.createDataFrame(rows, "file string, pipeline string, layers long, nodes long, connections long")


def from_registry(spark: SparkSession, folder: str, pipeline: str) -> dict:
    """The configuration of that name in a folder."""
    for row in registry(spark, folder).where(F.col("pipeline") == pipeline).collect():
        return load(f"{folder}/{row.file}", spark)
    raise KeyError(pipeline)


def _summary(config: dict) -> tuple:
    layers = config.get("layers") or []
    return config.get("name"), len(layers), sum(len(layer.get("nodes") or []) for layer in layers), len(config.get("connections") or [])


def summary(spark: SparkSession, config: dict) -> DataFrame:
    """One row: layers, nodes and connections of a configuration."""
    return spark.createDataFrame([_summary(config)], "pipeline string, layers long, nodes long, connections long")


def endpoints(spark: SparkSession, config: dict) -> DataFrame:
    """Every REST endpoint that a node reads or writes."""
    rows = []
    for name, node in compile_graph(config).nodes.items():
        sides = (("input", [m for i in node.get("inputs") or [] for m in i.get("methods") or []]), ("output", methods_of(node.get("outputs"))))
        rows += [(name, side, m.get("http_method", "GET" if side == "input" else "POST"), m.get("endpoint")) for side, methods in sides for m in methods if m.get("method") == "api"]
    return spark.createDataFrame(rows, "node string, side string, http_method string, endpoint string")
