"""Type names of pipeline configurations as Spark types."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import types as T

#: Names whose meaning here differs from Spark's own reading of them.
OWN = {"decimal": T.DecimalType(18, 3), "numeric": T.DecimalType(18, 3), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "text": T.StringType(), "varchar": T.StringType(), "bool": T.BooleanType()}


def parse_type(text: str) -> T.DataType:
    """The type of a schema field; timestamps have no zone, a bare decimal is (18,3)."""
    name = text.strip().lower()
    if name in OWN:
        return OWN[name]
    try:
        return T.StructType.fromDDL(f"c {text}").fields[0].dataType
    except ParseException as error:
        raise ValueError(f"unknown type {text!r}") from error


def schema_of(fields: list[dict]) -> T.StructType:
    """A schema from ``{name, type, description}``; descriptions become comments."""
    out = T.StructType()
    for field in fields:
        if "name" not in field or "type" not in field:
            raise ValueError(f"a schema field needs a name and a type: {field!r}")
        note = {"comment": field["description"]} if field.get("description") else None
        out = out.add(T.StructField(field["name"], parse_type(field["type"]), True, note))
    return out


def conform(df, schema: T.StructType):
    """``df`` with the columns of ``schema`` by name, cast; missing ones are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in schema.fields])
