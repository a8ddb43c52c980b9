"""Readers and writers of files: explicit schemas, never inferred ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import split_list, strip
from corpusloom.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, in the session's shared folder."""
    return f"{shared_folder(spark, 'scratch')}/{name}-{uuid.uuid4().hex}"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, if no key is null or comes twice."""
    bad = df.groupBy(*keys).count().where(" OR ".join(["count > 1", *(f"`{k}` IS NULL" for k in keys)]))
    if not bad.isEmpty():
        raise ValueError(f"keys {', '.join(keys)} are not unique")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False, **options) -> DataFrame:
    """CSV with a header and quotes doubled inside quotes.

    With ``multi_line`` cells may hold line breaks; a file is then read by one task, as it cannot be split.
    """
    return spark.read.schema(schema).options(header=True, multiLine=multi_line, escape='"', enforceSchema=False, **options).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV folder; each file appears only when its task has committed."""
    df.write.mode(mode).options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; malformed lines fail the read, or come out in ``_corrupt_record`` where not ``strict``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{text}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, link, title, author, abstract) of text files in which a blank line precedes four lines of a record.

    A blank line among the last four lines opens no record. One file is one row, so a file must fit a task.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("source"), F.split(F.regexp_replace("value", r"\n$", ""), "\r?\n", -1).alias("lines"))
    lines = files.select("source", F.size("lines").alias("n"), "lines", F.posexplode("lines").alias("line_no", "line"))
    found = lines.where((strip(F.col("line")) == "") & (F.col("line_no") < F.col("n") - 4))
    return found.select("source", "line_no", *(F.get("lines", F.col("line_no") + i).alias(c) for i, c in enumerate(("link", "title", "author", "abstract"), 1)))


def rows_by_file(df: DataFrame, name: str = r"([^/]*)$") -> DataFrame:
    """(file, rows) of a table read from files; ``name`` is the pattern whose first group names a file by its path."""
    return df.select(F.regexp_extract(F.input_file_name(), name, 1).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def missing_ids(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(present.select(key), key, "left_anti")


def listed_labels(spark: SparkSession, given: str | None = None, path: str | None = None) -> DataFrame:
    """(label) from an argument, or from the lines of a text or the first column of a CSV file."""
    if given is not None:
        return spark.range(1).select(F.explode(split_list(F.lit(given))).alias("label"))
    lines = spark.read.text(path)
    first = F.regexp_replace(F.split_part("value", F.lit(","), F.lit(1)), '^"|"$', "")
    return lines.select(strip(first).alias("label")).where("label != ''").distinct()


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """One folder for each value of ``part``."""
    df.repartition(part).write.mode("overwrite").partitionBy(part).parquet(path)


def write_flushed(df: DataFrame, path: str, rows: int = 1000, mode: str = "append") -> None:
    """Parquet files of at most ``rows`` rows each, so that a writer never holds more of them."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def unlisted(asked: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of ``asked`` that ``listed`` does not have."""
    return asked.where(F.col(column).isNotNull()).select(column).distinct().join(listed.select(column).distinct(), column, "left_anti")


def require_listed(asked: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """``asked``, if all its values are listed; the message names ten of those that are not."""
    missing = [r[column] for r in unlisted(asked, listed, column).orderBy(column).limit(10).collect()]
    if missing:
        raise ValueError(f"not listed: {', '.join(map(str, missing))}")
    return asked


def write_split(df: DataFrame, kept: str, left_out: str, reason: str = "reason") -> DataFrame:
    """Rows without a reason to ``kept``, the others with it to ``left_out``; returns the counts by reason."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(kept)
    df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(left_out)
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))


def _file(spark: SparkSession, path: str):
    """(file system, path) of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_state(spark: SparkSession, state: dict, path: str) -> None:
    """A JSON document at a path of any file system, written beside its place and put there when it is whole."""
    files, target = _file(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(state, indent=2, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        stream.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"{path} could not be replaced")


def read_state(spark: SparkSession, path: str) -> dict | None:
    """The document of :func:`write_state`, or None where there is none."""
    files, target = _file(spark, path)
    if not files.exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def append_failure(spark: SparkSession, path: str, entry: dict) -> None:
    """One more line of JSON in a folder; each entry is a file of its own, as not every file system can append."""
    files, target = _file(spark, f"{path}/{uuid.uuid4().hex}.jsonl")
    stream = files.create(target, False)
    try:
        stream.write(bytearray((json.dumps(entry, ensure_ascii=False, sort_keys=True) + "\n").encode()))
    finally:
        stream.close()


def packed_requests(df: DataFrame, key: str, body: str, *, most_rows: int = 50_000, most_bytes: int = 190 << 20, most_tokens: int = 1_500_000, group: str | None = None) -> DataFrame:
    """(file, seq, key, bytes, tokens): requests packed in the order of the key into files that keep all three bounds.

    Packing one sequence is a fold, so with ``group`` each group is packed by its own task; without it
    the table is one sequence and must fit a task, as a batch of requests does. A request beyond a
    bound has a file of its own.
    """
    import pandas as pd

    sized = df.select(*([F.col(group).alias("grp")] if group else [F.lit(0).alias("grp")]), F.col(key).alias("key"), F.octet_length(body).cast("bigint").alias("bytes"))
    sized = sized.withColumn("tokens", F.greatest(F.lit(1), F.floor((F.col("bytes") + 3) / 4)).cast("bigint"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable").reset_index(drop=True)
        files, rows, size, tokens, number = [], 0, 0, 0, 0
        for b, t in zip(frame["bytes"], frame["tokens"]):
            if rows and (rows + 1 > most_rows or size + b > most_bytes or tokens + t > most_tokens):
                number, rows, size, tokens = number + 1, 0, 0, 0
            rows, size, tokens = rows + 1, size + b, tokens + t
            files.append(number)
        return frame.assign(file=files, seq=range(len(frame)))

    kind = sized.schema["key"].dataType.simpleString()
    grp = sized.schema["grp"].dataType.simpleString()
    return sized.groupBy("grp").applyInPandas(pack, f"grp {grp}, key {kind}, bytes bigint, tokens bigint, file int, seq int")


def latex_sections(lines: DataFrame, order: str, text: str) -> DataFrame:
    """``lines`` of documents with the section each is in; ``lines`` has doc, ``order`` and ``text``."""
    from corpusloom.functions.text import initial_section

    window = Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(initial_section(F.col(text)), ignorenulls=True).over(window), F.lit("<none>")))
