"""Concept extraction by an outside model: batches, checks of replies, and resumed runs.

The model is an injected client, an object with ``complete(records) -> str``; nothing here calls a service.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import blank
from corpusloom.functions.text import normalize_labels, parse_label_list

from .ordering import numbered_parts

REPLY = "items array<struct<pmid:string,concepts:array<string>>>"


def batches_in_order(df: DataFrame, order: list[Column], size: int, *columns: str) -> DataFrame:
    """(batch, items): consecutive rows in groups of ``size``."""
    numbered = numbered_parts(df, *order, rows=size, name="batch")
    return numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))


def request_body(instruction: str, items: Column) -> Column:
    """The request for a batch as JSON."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), F.to_json(items).alias("content")))
    return F.to_json(F.struct(messages.alias("messages")))


def reply_reason(reply: Column, expected: Column) -> Column:
    """Why a reply cannot be used, or null: it must be an object with ``items`` only, each item with ``pmid`` and ``concepts`` only, and exactly the expected pmids once."""
    parsed = F.from_json(reply, REPLY)["items"]
    keys = F.json_object_keys(reply)
    loose = F.from_json(F.get_json_object(reply, "$.items"), "array<map<string,string>>")
    names = F.array(F.lit("concepts"), F.lit("pmid"))
    exact_keys = F.forall(loose, lambda m: F.array_sort(F.map_keys(m)) == names)
    pmids = F.transform(parsed, lambda i: i["pmid"])
    return (
        F.when(reply.isNull() | (~F.coalesce(F.size(keys) == 1, F.lit(False))) | (F.coalesce(keys[0], F.lit("")) != "items"), "not_an_object_with_items")
        .when(parsed.isNull() | ~F.coalesce(exact_keys, F.lit(False)), "item_fields")
        .when(F.exists(pmids, lambda p: p.isNull() | (p == "")), "pmid_missing")
        .when(F.size(F.array_distinct(pmids)) != F.size(pmids), "pmid_repeated")
        .when(F.array_sort(pmids) != F.array_sort(expected), "pmids_differ")
    )


def reply_items(replies: DataFrame, reply: str, most: int = 12) -> DataFrame:
    """(pmid, concepts) of usable replies, labels normalised."""
    return replies.select(F.inline(F.from_json(reply, REPLY)["items"])).select("pmid", normalize_labels(F.coalesce("concepts", F.array().cast("array<string>")), most).alias("concepts"))


def run_extraction(batches: DataFrame, client: Any, attempts: int = 2) -> DataFrame:
    """(batch, reply, error): the client's reply for each batch; a failing call is tried again and then reported, not raised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, items in zip(frame["batch"], frame["items"]):
                reply, error = None, None
                for _ in range(attempts):
                    try:
                        reply, error = client.complete([dict(i) if isinstance(i, dict) else i.asDict() for i in items]), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((number, reply, error))
            yield pd.DataFrame(rows, columns=["batch", "reply", "error"])

    return batches.select("batch", "items").mapInPandas(run, "batch bigint, reply string, error string")


def pending(works: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return works.join(done.select(key), key, "left_anti")


def resumed(works: DataFrame, saved: DataFrame, key: str, column: str, keep_invalid: bool = False) -> DataFrame:
    """``works`` with ``column`` from an earlier run where it is valid; with ``keep_invalid`` wherever it is not blank."""
    old = saved.select(key, F.col(column).alias("__old"))
    usable = ~blank(F.col("__old")) if keep_invalid else ~blank(F.col("__old")) & (F.size(parse_label_list(F.col("__old"))) > 0)
    return works.drop(column).join(old, key, "left").withColumn(column, F.when(usable, F.col("__old"))).drop("__old")


def fill_blanks(works: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """``works`` with blanks of ``column`` filled from ``fresh``, and ``outcome``: preserved, filled or missing."""
    new = fresh.select(key, F.col(column).alias("__new"))
    outcome = F.when(~blank(F.col(column)), "preserved").when(~blank(F.col("__new")), "filled").otherwise("missing")
    return works.join(new, key, "left").withColumn("outcome", outcome).withColumn(column, F.when(F.col("outcome") == "filled", F.col("__new")).otherwise(F.col(column))).drop("__new")


def watch(works: DataFrame, key: str, column: str, client: Any, *, size: int, path: str, wait: Callable[[], None] = lambda: None, most_rounds: int = 20) -> tuple[DataFrame, int]:
    """(``works`` with blanks of ``column`` filled, rounds): batches of pending rows go to the client again and again until none is blank.

    ``column`` holds lists as JSON text. Each round's result is written below ``path``, so that a run
    that is broken off goes on from the last whole round. A round that fills nothing halves the size of
    the batches, as one bad record fails its whole batch; with single records and nothing filled, the
    rest stays blank.
    """
    spark, rounds, now = works.sparkSession, 0, works.select(key, column)
    left = now.where(blank(F.col(column))).count()
    while left and rounds < most_rounds:
        batches = batches_in_order(now.where(blank(F.col(column))).withColumn("pmid", F.col(key).cast("string")), [F.col(key)], size, key, "pmid")
        replies = run_extraction(batches, client, attempts=1).join(batches, "batch")
        usable = replies.where(reply_reason(F.col("reply"), F.transform("items", lambda i: i["pmid"])).isNull())
        fresh = reply_items(usable, "reply").select(F.col("pmid").cast(now.schema[key].dataType).alias(key), F.to_json("concepts").alias(column))
        target = f"{path}/round={rounds}"
        fill_blanks(now, fresh, key, column).drop("outcome").write.mode("overwrite").parquet(target)
        now, rounds = spark.read.schema(now.schema).parquet(target), rounds + 1
        after = now.where(blank(F.col(column))).count()
        if after == left:
            if size == 1:
                break
            size = max(1, size // 2)
        left = after
        wait()
    return works.drop(column).join(now, key, "left"), rounds


def settings_hash(settings: dict) -> str:
    """The same for equal settings in any order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class BatchJobs:
    """States of outside jobs: submitted, completed, failed, not found; kept in a dictionary that can be saved as JSON.

    ``service`` has ``submit(path) -> id``, ``status(id) -> str or None`` and ``result(id) -> list of lines``.
    """

    def __init__(self, service: Any, state: dict | None = None):
        self.service, self.state = service, state if state is not None else {"jobs": {}}

    def submit(self, paths: list[str], most_open: int = 1) -> list[str]:
        started = []
        for path in paths:
            if path not in self.state["jobs"] and sum(j["status"] == "submitted" for j in self.state["jobs"].values()) < most_open:
                self.state["jobs"][path] = {"id": self.service.submit(path), "status": "submitted"}
                started.append(path)
        return started

    def refresh(self) -> dict[str, int]:
        counts: dict[str, int] = {}
        for job in self.state["jobs"].values():
            if job["status"] == "submitted":
                now = self.service.status(job["id"])
                job["status"] = "not_found" if now is None else now
            counts[job["status"]] = counts.get(job["status"], 0) + 1
        return counts

    def collect(self) -> list[str]:
        lines = []
        for job in self.state["jobs"].values():
            if job["status"] == "completed":
                lines += self.service.result(job["id"])
                job["status"] = "collected"
        return lines
