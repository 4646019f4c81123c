"""Cards of the files of a manifest: size, hash and structure of every file, sheet by sheet, in one job."""

from __future__ import annotations

import contextlib
import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workbook
from .files import TEXT

#: Bytes that are read at once; files of a batch and parts of a manifest for each core.
CHUNK, FILES, PARTS = 1 << 20, 16, 4
STRUCTURE = (
    "artifact_id string, path string, source_size bigint, source_sha256 string, parser_status string, error_type string, error string, "
    "sheet_at int, sheet_name string, rows bigint, columns int, column_names array<string>"
)


def opened(path: str) -> BinaryIO:
    """A file for reading at any place: of this machine, or of any file system that Arrow knows."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return open(local, "rb")  # noqa: SIM115
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def sha256_of(path: str) -> tuple[int, str]:
    """Size and hash; a chunk of the file is in memory at a time."""
    digest, size = hashlib.sha256(), 0
    with contextlib.closing(opened(path)) as file:
        while chunk := file.read(CHUNK):
            digest.update(chunk)
            size += len(chunk)
    return size, digest.hexdigest()


def _records(path: str, separator: str) -> tuple[int, list[str]]:
    with contextlib.closing(opened(path)) as file:
        lines = csv.reader(io.TextIOWrapper(io.BufferedReader(file) if not isinstance(file, io.BufferedIOBase) else file, "utf-8-sig", newline=""), delimiter=separator)
        head = next(lines, [])
        return sum(1 for line in lines if line), head


def _documents(path: str) -> tuple[int, list[str]]:
    """Lines that hold something, and the names of the first object."""
    n, names = 0, []
    with contextlib.closing(opened(path)) as file:
        for line in io.TextIOWrapper(file, "utf-8"):
            if line.strip():
                names = names if n else list(json.loads(line))
                n += 1
    return n, names


def _sheets(path: str) -> Iterator[tuple[int, str, int, list[str]]]:
    with contextlib.closing(opened(path)) as file:
        for at, (name, _) in enumerate(workbook.sheets(file)):
            body = workbook.rows(file, name)
            head = next(body, [])
            yield at, name, sum(1 for _ in body), [h or f"column_{i}" for i, h in enumerate(head)]


def tables(path: str) -> list[tuple[int, str | None, int, list[str]]]:
    """(number, sheet, rows, names) of each table of a file, by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in TEXT:
        return [(0, None, *_records(path, TEXT[suffix]))]
    if suffix in (".json", ".jsonl"):
        return [(0, None, *_documents(path))]
    if suffix == ".xlsx":
        return list(_sheets(path))
    if suffix == ".parquet":
        with contextlib.closing(opened(path)) as file:
            told = pq.ParquetFile(file)
            return [(0, None, told.metadata.num_rows, told.schema_arrow.names)]
    raise ValueError(f"unsupported file type {suffix!r}")


def _of(artifact: str, path: str, parsed: bool) -> Iterator[tuple]:
    """Rows of one file; what goes wrong with it is data about it."""
    size = digest = None
    try:
        size, digest = sha256_of(path)
        found = tables(path) if parsed else []
    except (OSError, ValueError, KeyError, StopIteration, csv.Error, pa.ArrowException, *workbook.BadBook) as error:
        yield artifact, path, size, digest, "failed", type(error).__name__, str(error)[:500], None, None, None, None, None
        return
    for at, sheet, rows, names in found or [(None, None, None, None)]:
        yield artifact, path, size, digest, "parsed", None, None, at, sheet, rows, None if names is None else len(names), names


def _structures(parsed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    names = [c.split(" ")[0] for c in STRUCTURE.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, FILES):
            part = batch.slice(lo, FILES)
            entries = zip(part.column("artifact_id").to_pylist(), part.column("path").to_pylist(), strict=True)
            columns = list(zip(*[row for a, p in entries for row in _of(a, p, parsed)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def structures(manifest: DataFrame, parsed: bool = True) -> DataFrame:
    """A row for each table of each file (artifact_id, path): one for a table, one a sheet of a workbook, one with an error.

    The files are dealt out to tasks, each of which reads them as streams. Without `parsed` they are only hashed.
    """
    parts = manifest.sparkSession.sparkContext.defaultParallelism * PARTS
    dealt = manifest.select(F.col("artifact_id").cast("string").alias("artifact_id"), "path").repartition(parts, "artifact_id", "path")
    return dealt.mapInArrow(lambda it: _structures(parsed, it), STRUCTURE)


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length")


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of files of any size."""
    found = structures(listed(spark, folder, glob).select(F.lit("").alias("artifact_id"), "path"), parsed=False)
    return found.select("path", F.col("source_size").alias("length"), F.col("source_sha256").alias("sha256"))


def file_cards(manifest: DataFrame) -> DataFrame:
    """The manifest's columns with card_id, size, hash, status, error, the tables as one list and the requested columns that no table has.

    A manifest is (artifact_id, path) and, if it asks for columns, selected_columns (array of strings).
    """
    table = F.struct("sheet_at", "sheet_name", "rows", "columns", "column_names")
    facts = [F.first(c).alias(c) for c in ("source_size", "source_sha256", "parser_status", "error_type", "error")]
    one = structures(manifest).groupBy("artifact_id", "path").agg(*facts, F.array_sort(F.collect_list(F.when(F.col("sheet_at").isNotNull(), table))).alias("structure"))
    found = manifest.withColumn("artifact_id", F.col("artifact_id").cast("string")).join(one, ["artifact_id", "path"])
    wanted = F.coalesce("selected_columns", F.array().cast("array<string>")) if "selected_columns" in manifest.columns else F.array().cast("array<string>")
    there = F.flatten(F.transform("structure", lambda t: t["column_names"]))
    return found.select("*", F.concat(F.lit("file:"), "artifact_id").alias("card_id"), F.array_sort(F.array_except(wanted, there)).alias("missing_requested_columns"))
