"""Tables, manifests and documents as files, and the engine's outputs."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import PurePosixPath

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import Workbook

TEXT = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def read_table(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """A table by its suffix: csv, tsv, txt, xlsx or parquet; other suffixes are errors."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in TEXT:
        reader = spark.read.option("header", True).option("sep", TEXT[suffix])
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if suffix == ".xlsx":
        spark.dataSource.register(Workbook)
        reader = spark.read.format("attestra_workbook")
        return (reader.option("sheet", sheet) if sheet else reader).load(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".xls", ".sav"):
        raise ValueError(f"{suffix} needs a reader that is not installed; convert {path} to csv or parquet")
    raise ValueError(f"unsupported file type {suffix!r}: {path}")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Subjects and their vectors (pos, analysis_id, vec) of long-form parquet: pos, analysis_id, i, j, value.

    The lower triangle of each matrix, in row order. Rows must make up square matrices of one size.
    """
    rows = spark.read.parquet(path)
    size = rows.groupBy("pos").agg(F.max("i").alias("i"), F.max("j").alias("j"), F.count("*").alias("n"))
    k = F.col("i") + 1
    bad = size.agg(F.count_if((F.col("i") != F.col("j")) | (F.col("n") != k * k)).alias("bad"), F.count_distinct("i").alias("sizes")).first()
    if bad["bad"] or bad["sizes"] > 1:
        raise ValueError(f"{path}: matrices are not square and of one size")
    below = rows.filter("i > j").groupBy("pos", "analysis_id")
    return below.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda s: s["value"]).alias("vec"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones are errors. Without a schema, one column of documents."""
    if schema:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("document"))


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All shard_*.jsonl of a folder, with the name of each row's shard."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "shard_*.jsonl").json(folder)
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_name"), r"(shard_[^.]*)", 1))


def read_manifest(path: str, roots: dict[str, str] | None = None) -> list[dict]:
    """Entries of a YAML manifest with ${NAME} replaced from roots or the environment; unset names are errors."""
    with open(path, encoding="utf-8") as text:
        content = text.read()
    for name, value in {**os.environ, **(roots or {})}.items():
        content = content.replace("${" + name + "}", value)
    if "${" in content:
        raise ValueError(f"{path}: unset root {content.split('${', 1)[1].split('}', 1)[0]}")
    return yaml.safe_load(content)


def structure(df: DataFrame, artifact: str, sheet: str | None = None) -> DataFrame:
    """(artifact_id, sheet_name, rows, columns, column_names) of one table."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(artifact).alias("artifact_id"), F.lit(sheet).cast("string").alias("sheet_name"), "rows", F.lit(len(df.columns)).alias("columns"), F.array(*map(F.lit, df.columns)).cast("array<string>").alias("column_names")
    )


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys sorted at every depth, nulls kept."""
    return df.select(F.to_json(F.parse_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    sorted_json(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Columns in a fixed order; null is empty."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def summary_json(row: DataFrame) -> str:
    """A one-row summary as indented, sorted JSON."""
    return json.dumps(row.first().asDict(recursive=True), indent=2, sort_keys=True, default=str)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
