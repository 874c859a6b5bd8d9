"""Columns, filters and orders from their configuration, as Column expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _collection(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


#: What a filter may compare with, by its operator in lower case.
OPERATORS = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "not like": lambda c, v: ~c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "not ilike": lambda c, v: ~c.ilike(v),
    "rlike": lambda c, v: c.rlike(v),
    "in": lambda c, v: c.isin(_collection(v)),
    "not in": lambda c, v: ~c.isin(_collection(v)),
    "between": lambda c, v: c.between(*v),
}
NULL_TESTS = {"=": True, "==": True, "is": True, "is null": True, "!=": False, "<>": False, "is not": False, "is not null": False}


def condition(column: str, operator: str, value: Any = None) -> Column:
    """One comparison. A null value tests for null; a boolean equality is the column
    itself or its negation, so that null stays unknown."""
    name, col = operator.strip().lower(), F.col(column)
    if value is None and name in NULL_TESTS:
        return col.isNull() if NULL_TESTS[name] else col.isNotNull()
    if isinstance(value, bool) and name in ("=", "=="):
        return col if value else ~col
    if isinstance(value, (list, tuple)) and name in ("=", "=="):
        name = "in"
    if name not in OPERATORS or value is None:
        raise ValueError(f"unknown comparison {operator!r} of {column!r} with {value!r}")
    return OPERATORS[name](col, value)


def predicate(filters: list[dict] | dict[str, Any] | str | None) -> Column | None:
    """All of ``[{column, operator, value}]`` or ``{column: {operator, value}}`` (or
    ``{column: value}``), or a raw SQL predicate."""
    if filters is None or filters in ([], {}):
        return None
    if isinstance(filters, str):
        return F.expr(filters)
    if isinstance(filters, dict):
        filters = [{"column": c, **(f if isinstance(f, dict) else {"operator": "=", "value": f})} for c, f in filters.items()]
    if not isinstance(filters, list) or not all(isinstance(f, dict) and "column" in f for f in filters):
        raise ValueError(f"a filter is a list, a mapping or text: {filters!r}")
    return reduce(lambda a, b: a & b, [condition(f["column"], f.get("operator", "="), f.get("value")) for f in filters])


def project(df: DataFrame, columns: list | str | None) -> DataFrame:
    """Select ``*``, a raw select list, or a list of names, ``{name}`` and
    ``{expression, name, alias}``."""
    if columns is None or columns == "*":
        return df
    if isinstance(columns, str):
        return df.sparkSession.sql(f"SELECT {columns.replace('{', '{{').replace('}', '}}')} FROM {{source}}", source=df)
    if not isinstance(columns, list):
        raise ValueError(f"columns are a list or text: {columns!r}")
    out = []
    for item in columns:
        if isinstance(item, str):
            out.append(F.col(item))
        elif isinstance(item, dict) and item.get("expression"):
            out.append(F.expr(item["expression"]).alias(item.get("alias") or item.get("name") or "col"))
        elif isinstance(item, dict) and item.get("name"):
            out.append(F.col(item["name"]).alias(item["alias"]) if item.get("alias") else F.col(item["name"]))
        else:
            raise ValueError(f"a column is a name, a mapping with a name, or one with an expression: {item!r}")
    return df.select(*out)


def orders(sort_by: list | str | None) -> list[Column]:
    """Sort columns with nulls last in either direction; ``direction`` and ``order``
    mean the same."""
    if not sort_by:
        return []
    if isinstance(sort_by, str):
        sort_by = [dict(zip(("column", "direction"), part.split(), strict=False)) for part in sort_by.split(",")]
    out = []
    for item in sort_by:
        item = {"column": item} if isinstance(item, str) else item
        direction = str(item.get("direction") or item.get("order") or "asc").lower()
        if direction not in ("asc", "desc"):
            raise ValueError(f"a direction is asc or desc, not {direction!r}")
        col = F.col(item["column"])
        out.append(col.asc_nulls_last() if direction == "asc" else col.desc_nulls_last())
    return out


def schema_projection(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Apply ``expr`` and ``alias`` of schema fields: a field's value is its
    expression, or the column of its name, and its alias is the name it gets."""
    return df.select(*[(F.expr(f["expr"]) if f.get("expr") else F.col(f["name"])).alias(f.get("alias") or f["name"]) for f in fields])
