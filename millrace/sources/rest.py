"""REST resources as a batch data source and a sink, by Spark's Python data source API.

Options: ``url``; ``selector``, a top-level key that holds the rows; ``auth`` (``bearer``
or ``header``) with ``token`` and, for ``header``, ``header_name``; ``timeout`` and
``retries``. Every row is one JSON text in the column ``body``; ``pages`` with a
``page_param`` reads that many pages, each a partition of its own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage


def headers_of(options) -> dict[str, str]:
    kind, token = options.get("auth"), options.get("token")
    if not kind:
        return {}
    if kind == "bearer" and token:
        return {"Authorization": f"Bearer {token}"}
    if kind == "header" and token:
        return {options.get("header_name", "X-Api-Key"): token}
    raise ValueError(f"auth is bearer or header, with a token; not {kind!r}")


def request(url: str, options, body: bytes | None = None):
    """The decoded JSON of a 200 or 201 response; other statuses raise, and failures
    of the connection and of the server are tried again."""
    retries, timeout = int(options.get("retries", 3)), float(options.get("timeout", 30))
    for attempt in range(retries + 1):
        call = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers_of(options)}, method="POST" if body is not None else "GET")
        try:
            with urllib.request.urlopen(call, timeout=timeout) as response:
                if response.status not in (200, 201):
                    raise ValueError(f"{url}: status {response.status}")
                text = response.read()
                return json.loads(text) if text else None
        except urllib.error.HTTPError as error:
            if error.code < 500 or attempt == retries:
                raise ValueError(f"{url}: status {error.code}") from error
        except urllib.error.URLError:
            if attempt == retries:
                raise
        time.sleep(min(5.0, 0.1 * 2**attempt))


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(k) for k in range(int(self.options.get("pages", 1)))]

    def read(self, partition):
        yield from page_rows(self.options, partition.value)


def page_rows(options: dict, page: int):
    """The rows of a page; of the whole resource, if no parameter names pages."""
    url, param = options["url"], options.get("page_param")
    if param:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode({param: page})
    found = request(url, options)
    if options.get("selector"):
        found = found.get(options["selector"])
    for row in found if isinstance(found, list) else [] if found is None else [found]:
        yield (json.dumps(row),)


class RestWriter(DataSourceWriter):
    """Posts ``{"data": rows}`` in batches of ``batch_size``."""

    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows):
        size, held = int(self.options.get("batch_size", 1000)), []
        for row in rows:
            held.append(json.loads(row[0]))
            if len(held) == size:
                request(self.options["url"], self.options, json.dumps({"data": held}).encode())
                held = []
        if held:
            request(self.options["url"], self.options, json.dumps({"data": held}).encode())
        return WriterCommitMessage()


class RestSource(DataSource):
    @classmethod
    def name(cls):
        return "rest_json"

    def schema(self):
        return "body string"

    def reader(self, schema):
        return RestReader(self.options)

    def simpleStreamReader(self, schema):
        return RestPages(self.options)

    def writer(self, schema, overwrite):
        return RestWriter(self.options)


class RestPages(SimpleDataSourceStreamReader):
    """Pages of a resource as they appear: a micro-batch is the next page, whose number is
    the offset. The query's checkpoint keeps it, so a query that starts again asks for the
    first page that it has not finished; an empty page is asked for again at the next
    trigger."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("first_page", 0))}

    def _rows(self, page: int) -> list[tuple[str]]:
        return list(page_rows(self.options, page))

    def read(self, start: dict):
        rows = self._rows(start["page"])
        return iter(rows), {"page": start["page"] + bool(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        for page in range(start["page"], end["page"]):
            yield from self._rows(page)

    def commit(self, end: dict) -> None:
        pass


def stream_rest(spark: SparkSession, url: str, **options) -> DataFrame:
    """A stream of the pages of a resource; the driver asks for one page at a time."""
    spark.dataSource.register(RestSource)
    return spark.readStream.format("rest_json").options(url=url, **{k: str(v) for k, v in options.items() if v is not None}).load()


def read_rest(spark: SparkSession, url: str, **options) -> DataFrame:
    spark.dataSource.register(RestSource)
    return spark.read.format("rest_json").options(url=url, **{k: str(v) for k, v in options.items() if v is not None}).load()


def write_rest(df: DataFrame, url: str, **options) -> None:
    from pyspark.sql import functions as F

    df.sparkSession.dataSource.register(RestSource)
    body = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
    body.write.format("rest_json").options(url=url, **{k: str(v) for k, v in options.items() if v is not None}).mode("append").save()
