"""Looking into a warehouse: its databases, tables, columns and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.catalog import Table, create_database
from millrace.sources.tables import guarded_sql


class Warehouse:
    """Databases of Spark's catalog whose folders are under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create_database(self, name: str, comment: str | None = None) -> None:
        create_database(self.spark, name, f"{self.path}/{name}", comment)

    def databases(self) -> list[str]:
        where = lambda uri: self.spark._jvm.org.apache.hadoop.fs.Path(uri).toUri().getPath()
        own = where(self.path)
        return sorted(d.name for d in self.spark.catalog.listDatabases() if where(d.locationUri).startswith(f"{own}/"))

    def tables(self, database: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary)

    def table(self, database: str, name: str) -> Table:
        return Table(self.spark, database, name, f"{self.path}/{database}")

    def columns(self, database: str, name: str) -> DataFrame:
        return self.table(database, name).columns()

    def preview(self, database: str, name: str, rows: int = 20) -> DataFrame:
        """Some rows of a table, to look at."""
        return self.table(database, name).read().limit(rows)

    def sql(self, query: str, **names: str) -> DataFrame:
        """A query in which ``{alias}`` stands for the table given as
        ``alias="database.table"``."""
        return guarded_sql(self.spark, query, **{alias: self.table(*name.split(".", 1)).read() for alias, name in names.items()})
