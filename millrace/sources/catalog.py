"""Tables of Spark's catalog: append tables, and slowly changing dimensions in buckets.

Databases and tables are the catalog's own, stored as partitioned Parquet under a folder.
An append goes to a partition of its batch, so a micro-batch that is run again replaces
what it wrote. A dimension is partitioned by buckets of its key, and each bucket into
current rows and the history that each batch made: a batch reads the buckets of its keys
and replaces their current rows in one dynamic partition overwrite; other buckets, and
history that is there, stay as they are.
"""

from __future__ import annotations

import json
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import conform
from millrace.operators import scd2
from millrace.sources import files

#: Partition columns that readers don't see.
BATCH, BUCKET, PART = "_batch", "_bucket", "_part"
HIDDEN = (BATCH, BUCKET, PART)
#: The partition of appends without a batch, and of a dimension's current rows.
PLAIN, CURRENT = "plain", "current"


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def create_database(spark: SparkSession, name: str, location: str | None = None, comment: str | None = None) -> None:
    """Make a database unless there is one; one of that name elsewhere raises ValueError."""
    text = lambda value: "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    made = f"CREATE DATABASE IF NOT EXISTS {quoted(name)}" + (f" COMMENT {text(comment)}" if comment else "") + (f" LOCATION {text(location)}" if location else "")
    spark.sql(made)
    if location:
        path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().rstrip("/")
        found = spark.catalog.getDatabase(quoted(name)).locationUri
        if path(found) != path(location):
            raise ValueError(f"the database {name} is at {found}, not at {location}")


_overwriting: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    """An insert that overwrites replaces the partitions that it has rows of, no others:
    a setting of the session, put back when the last of its writers leaves."""
    name, key = "spark.sql.sources.partitionOverwriteMode", id(spark._jsparkSession)
    with _lock:
        held = _overwriting.setdefault(key, [0, spark.conf.get(name)])
        held[0] += 1
        spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(name, _overwriting.pop(key)[1])


class Table:
    """A table of the catalog; with a ``location``, the folder of its database."""

    def __init__(self, spark: SparkSession, database: str, name: str, location: str | None = None):
        self.spark, self.database, self.bare = spark, database, name
        self.name = quoted(database, name)
        self.location = location.rstrip("/") if location else None

    @property
    def path(self) -> str | None:
        return f"{self.location}/{self.bare}" if self.location else None

    def exists(self) -> bool:
        """Whether the catalog has it. Files of a table that a session without a lasting
        catalog has left in its folder are taken in."""
        if self.spark.catalog.tableExists(self.name):
            return True
        if not self.path or not files.exists(self.spark, self.path) or not files.exists(self.spark, f"{self.path}/_SUCCESS"):
            return False
        create_database(self.spark, self.database, self.location)
        self.spark.catalog.createTable(self.name, path=self.path, source="parquet")
        self.spark.catalog.recoverPartitions(self.name)
        return True

    def create(self, schema: T.StructType, comment: str | None = None, keys: list[str] | None = None, buckets: int = 64) -> Table:
        """Make the table unless there is one: an append table, or, with ``keys``, a
        dimension in ``buckets`` of them."""
        if self.exists():
            return self
        create_database(self.spark, self.database, self.location)
        hidden = [(BUCKET, T.IntegerType()), (PART, T.StringType())] if keys else [(BATCH, T.StringType())]
        whole = T.StructType(list(schema.fields))
        for name, kind in hidden:
            whole = whole.add(name, kind)
        writer = self.spark.createDataFrame([], whole).write.format("parquet").partitionBy(*[n for n, _ in hidden])
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        if comment:
            self.spark.sql(f"COMMENT ON TABLE {self.name} IS '" + comment.replace("\\", "\\\\").replace("'", "\\'") + "'")
        if keys:
            self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('keys' = '{json.dumps(keys)}', 'buckets' = '{buckets}')".replace('"', '\\"'))
        return self

    def properties(self) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}

    def comment(self) -> str | None:
        return self.spark.catalog.getTable(self.name).description

    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.spark.table(self.name).schema.fields if f.name not in HIDDEN])

    def stored(self) -> DataFrame:
        """The rows with their partitions."""
        if not self.exists():
            raise FileNotFoundError(f"no table {self.name}")
        self.spark.catalog.refreshTable(self.name)  # another session may have written
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self.stored().drop(*HIDDEN)

    def columns(self) -> DataFrame:
        """Name, type and comment of each column, of the catalog."""
        rows = [(c.name, c.dataType, c.description) for c in self.spark.catalog.listColumns(self.name) if c.name not in HIDDEN]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, comment string")

    def _replace(self, df: DataFrame) -> None:
        """Write rows with their partitions, in place of what these hold. A task writes the
        rows of a bucket, which are to be few enough for a file."""
        if BUCKET in df.columns:
            df = df.repartition(BUCKET, PART)
        with _dynamic_overwrite(df.sparkSession):
            df.select(*self.spark.table(self.name).columns).write.insertInto(self.name, overwrite=True)

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Add rows by name, cast to the table's schema. Rows of a ``batch`` (any text
        that names it) take the place of those that it has written before."""
        rows = conform(df, self.schema()).withColumn(BATCH, F.lit(PLAIN if batch is None else batch))
        if batch is None:
            rows.select(*self.spark.table(self.name).columns).write.insertInto(self.name)
        else:
            self._replace(rows)

    def apply_scd2(self, rows: DataFrame, dim: scd2.Dimension, batch: str | None = None, observed=lambda df: df) -> list[int]:
        """Apply a batch to a dimension and return the buckets that it touched.

        A batch that is applied again changes nothing: its versions are there. That holds
        for rows without a null key or event time, which match nothing, and if the batch
        was written to its end; a job that dies while Spark moves its files leaves some
        buckets new and others old, which applying it again mends. ``observed`` gets
        the rows that are written.
        """
        own = self.properties()
        keys, buckets = json.loads(own["keys"]), int(own["buckets"])
        if keys != list(dim.keys):
            raise ValueError(f"the buckets of {self.name} are of {keys}, not of {dim.keys}")
        target = self.stored()
        types = dict(target.dtypes)
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in keys]), F.lit(buckets)).cast("int")
        # At most as many numbers as there are buckets.
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return []
        part = target.where(F.col(BUCKET).isin(touched))
        made = scd2.rewritten(part.drop(*HIDDEN), rows, dim)
        history = f"h-{uuid.uuid4().hex if batch is None else batch}"
        now = F.coalesce(F.col(dim.current), F.lit(False))
        made = made.withColumn(BUCKET, bucket).withColumn(PART, F.when(now, CURRENT).otherwise(history))
        # Rows of the current partitions that aren't current, if some were appended so.
        left = part.where((F.col(PART) == CURRENT) & ~now).withColumn(PART, F.lit(history))
        # A bucket whose rows all end keeps no current partition from before: each
        # replaced row has a successor, so there is none.
        self._replace(observed(made.unionByName(left)))
        return touched

    def load(self, df: DataFrame, dim: scd2.Dimension) -> None:
        """Take rows with their intervals, as they are, into an empty dimension."""
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in dim.keys]), F.lit(int(self.properties()["buckets"]))).cast("int")
        part = F.when(F.coalesce(F.col(dim.current), F.lit(False)), CURRENT).otherwise("h-loaded")
        self._replace(conform(df, self.schema()).withColumn(BUCKET, bucket).withColumn(PART, part))
