"""Paged remote sources: a Spark data source over an injected page client.

A client is any picklable object with ``partitions(options)``, a list of picklable parts that can be
read independently, and ``pages(part)``, an iterator of lists of dictionaries. Paging by cursor is
sequential within a part; parts, such as one for each journal, are read by tasks of their own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class CursorClient:
    """Pages of one endpoint that hands out the next cursor; ``get`` does the request.

    ``get(url, parameters)`` returns {"results": [...], "meta": {"next_cursor": ...}}. Reading stops
    without a next cursor, on an empty page, or after ``limit`` rows.
    """

    get: Callable[[str, dict], dict]
    url: str
    fields: list[str]
    filters: list[str] = field(default_factory=lambda: [""])
    per_page: int = 200
    limit: int | None = None

    def partitions(self) -> list[str]:
        return self.filters

    def pages(self, part: str) -> Iterator[list[dict]]:
        cursor, left = "*", self.limit
        while cursor:
            reply = self.get(self.url, {"filter": part, "select": ",".join(self.fields), "per-page": self.per_page, "cursor": cursor})
            rows = reply.get("results", [])
            if left is not None:
                rows, left = rows[:left], left - len(rows[:left])
            if not rows:
                return
            yield rows
            cursor = reply.get("meta", {}).get("next_cursor") if left != 0 else None


class _Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, client: Any, schema: StructType):
        self.client, self.names = client, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.client.partitions()]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for page in self.client.pages(partition.value):
            for row in page:
                yield tuple(row.get(n) for n in self.names)


def read_pages(spark: SparkSession, client: Any, schema: str) -> DataFrame:
    """A table of what the client's pages hold; fields beside ``schema`` are dropped, missing ones null."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_client"

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(client, schema)

    spark.dataSource.register(Paged)
    return spark.read.format("paged_client").load()


def unfinished_parts(parts: DataFrame, done: DataFrame, key: str, expected: str, tolerance: int = 30) -> DataFrame:
    """Parts of which ``done`` (key, rows) has fewer rows than expected, by more than ``tolerance``."""
    from pyspark.sql import functions as F

    finished = done.select(F.col(key), F.col("rows").alias("__rows"))
    return parts.join(finished, key, "left").where(F.coalesce("__rows", F.lit(-1)) < F.col(expected) - tolerance).drop("__rows")


class RetryingClient:
    """Requests with a least delay between them, and repeats on failures that pass.

    ``send(url, parameters)`` returns (status, headers, text). Statuses 429 and 5xx are tried again, after
    Retry-After if given, else after a doubling delay.
    """

    def __init__(self, send: Callable[[str, dict], tuple[int, dict, str]], *, delay: float = 0.34, retries: int = 4, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.send, self.delay, self.retries, self.sleep, self.clock = send, delay, retries, sleep, clock
        self.last: float | None = None

    def get(self, url: str, parameters: dict) -> str:
        wait = self.delay
        for attempt in range(self.retries + 1):
            if self.last is not None and (left := self.last + self.delay - self.clock()) > 0:
                self.sleep(left)
            self.last = self.clock()
            status, headers, text = self.send(url, parameters)
            if status < 400:
                return text
            if attempt == self.retries or not (status == 429 or status >= 500):
                raise RuntimeError(f"{url} answered {status}")
            after = headers.get("Retry-After", "")
            self.sleep(float(after) if after.replace(".", "", 1).isdigit() else wait)
            wait *= 2
        raise AssertionError

    def get_json(self, url: str, parameters: dict) -> Any:
        return json.loads(self.get(url, parameters))
