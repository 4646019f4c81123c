"""What the training-data operators share: reading, materialising, words, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table

__all__ = ["components", "fold_of", "lists", "local_frame", "materialize", "slices", "table", "text_of", "unused", "words_of"]

#: ASCII that separates words; digits, letters and everything beyond ASCII make words up.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For bytes.translate: A-Z to a-z, separators to a space. UTF-8's bytes of other characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8; the same words that WORD_GAP separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, so that a task holds few texts as Python objects; empty batches come along."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. It travels as Arrow: a list would start further Python workers just to be pickled again."""
    names = [c.split()[0] for c in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    arrays = [pa.array(list(c), kinds[k.split()[1]]) for c, k in zip(columns, schema.split(","), strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names))


def lists(lengths: list[int], **columns: pa.Array) -> pa.ListArray:
    """Rows of structs from flat columns, without a Python object for each struct."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node of its component.

    Each round hooks every root to the smallest neighbouring root and then follows the roots' own
    roots, so that the number of rounds grows with the logarithm of a component's width. Only labels
    travel; no component is ever gathered in a task. An empty edge table gives an empty result.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a != b").distinct(), f"{name}-edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    label = materialize(label, f"{name}-labels")
    for _ in range(most):
        # the smallest root next door of each root's members, then one jump along it
        near = (
            both.join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("rb").alias("near"))
        )
        own = label.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("best"))
        hook = own.groupBy(F.col("root").alias("old")).agg(F.min("best").alias("new"))
        step = own.join(hook, own["root"] == hook["old"], "left").select(
            "node", F.col("root").alias("was"), F.least("best", F.coalesce("new", "best")).alias("root")
        )
        step = materialize(step, f"{name}-labels")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = step.join(jump, "root", "left").select("node", "was", F.coalesce("next", "root").alias("root"))
        label = materialize(jumped, f"{name}-labels")
        if label.filter("was != root").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")
    raise RuntimeError(f"components of {name} did not settle in {most} rounds")
