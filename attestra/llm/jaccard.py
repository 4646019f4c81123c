"""N-gram Jaccard join: banded MinHash LSH for candidates, exact verification of each.

Documents with the same text are one class. Each class has TREES bands of MinHash values, DEPTH at most,
as many as leave a pair at the threshold the target recall of sharing some band. Pairs that share none
are not candidates by themselves. All texts with one band in common are linked to its smallest member, and the components of these links are
the sets within which every pair is verified on its whole shingle sets. Sets of any size are split
into blocks by hash, and each pair of blocks is one unit of work, so that a task holds at most two
blocks; a unit returns the number of links of each of its texts and a spanning forest of them, never
the pairs.

Shingles are five words (fewer words are one shingle); null texts are empty; texts without words are
linked to nothing but their copies. Repeated rows, and rows that share an id, get equal results row by
row. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, slices, text_of, unused, words_of

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 48, 12, 0.9995
#: Texts of one block; a unit of work compares two.
BLOCK = 192
#: Words whose hashes a task remembers.
WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _Words(dict):
    """Word to 64-bit hash, forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, known: dict, n: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    last = max(1, len(h) - n + 1)
    out = np.zeros(last, np.uint64)
    for k in range(min(n, len(h))):
        out = (out ^ h[k : k + last]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 32, (k, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (k, 1), np.uint32)


def minima(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of each of many linear hashes; long texts go by in slices."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    a, b = seeds
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (x[None, i : i + 1024] * a + b).min(1), out=best)
    return best


def _prefixes(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, seeds = _Words(), _seeds(TREES * depth)
    for batch in slices(batches):
        keys: list = []
        for text in batch.column("text").to_pylist():
            s = shingles(text, known)
            if not len(s):
                keys.append(None)
                continue
            tree = minima(s, seeds).reshape(TREES, depth).astype(np.uint64)
            code = np.arange(1, TREES + 1, dtype=np.uint64)
            for level in range(depth):
                code = (code ^ tree[:, level]) * _MIX
                code ^= code >> np.uint64(31)
            keys.append(code.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "keys"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in slices(batches):
        found = [np.unique(shingles(t, known)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])


def _verify(members: list[tuple[int, bool, bytes]], crossed: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(node, links, least node reached) of one unit; crossed: only pairs across its two blocks count."""
    members.sort()
    ids = [m[0] for m in members]
    side = np.array([m[1] for m in members])
    sets = [np.frombuffer(m[2], np.uint64) for m in members]
    n, size = len(sets), np.array([len(s) for s in sets])
    if n < 2 or (crossed and (side.all() or not side.any())):
        return []
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.r_[True, value[1:] != value[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        part = np.zeros((n, min(8192, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    near = inter >= threshold * np.maximum(union, 1) - 1e-9
    near &= size[:, None] > 0
    np.fill_diagonal(near, False)
    if crossed:
        near &= side[:, None] != side[None, :]
    links = near.sum(1)
    root = np.arange(n)
    while True:  # the least index in reach; ids are sorted, so it is the least id
        least = np.where(near, root[None, :], n).min(1)
        new_root = np.minimum(root, least)
        new_root = np.minimum(new_root, new_root[new_root])
        if (new_root == root).all():
            break
        root = new_root
    return [(ids[i], int(links[i]), ids[root[i]]) for i in range(n) if links[i]]


def _units(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit may run over several batches."""

    def told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "root"])

    now, members, out = None, [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "block", "shingles")]
        for root, i, j, node, block, packed in zip(*cols, strict=True):
            if (root, i, j) != now:
                if now:
                    out += _verify(members, now[1] != now[2], threshold)
                now, members = (root, i, j), []
                if len(out) > 10_000:
                    yield told(out)
                    out = []
            members.append((node, block == i, packed))
    if now:
        out += _verify(members, now[1] != now[2], threshold)
    yield told(out)


def join(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each of documents: doc_id, h, class_id, text_id, n_links, n_copies.

    text_id is the least doc_id of the same text and n_copies how many rows have it; n_links counts the
    other texts at or above the threshold; class_id is the least text_id that links lead to. Texts of
    which all ids are null are told apart by their hash and have null class and text ids.
    """
    depth = depth_for(recall, threshold)
    rows = documents.select("doc_id", text_of().alias("text")).withColumn("h", F.md5("text"))
    least = rows.groupBy("h").agg(F.min("doc_id").alias("same"), F.count("*").alias("n_copies"))
    # a node is a text: 64 bits of its hash
    least = materialize(least.withColumn("node", F.conv(F.substring("h", 1, 16), 16, -10).cast("bigint")), "jaccard-texts")
    kind = documents.schema["doc_id"].dataType.simpleString()
    tries = rows.select("doc_id", "h", "text").mapInArrow(
        lambda it: _prefixes(depth, it), f"doc_id {kind}, h string, keys array<bigint>"
    )
    # of the copies of a text, one stands in the tries
    tries = tries.filter("keys IS NOT NULL").join(least, "h").filter(F.col("doc_id").eqNullSafe(F.col("same")))
    leaves = materialize(tries.select("node", F.explode("keys").alias("key")), "jaccard-leaves")
    under = leaves.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a != most")
    links = leaves.join(under.select("key", "a"), "key").filter("node != a").select("a", F.col("node").alias("b")).distinct()
    found = components(links, "jaccard-candidates")

    groups = found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = found.join(groups, "root").select(
        "root", "node", "blocks", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block")
    )
    once = placed.join(least.select("node", "h", "same"), "node")
    wanted = rows.join(once.select("node", "h", "same"), "h").filter(F.col("doc_id").eqNullSafe(F.col("same")))
    sets = wanted.select("node", "text").mapInArrow(_sets, "node bigint, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = (
        placed.join(sets, "node")
        .select("root", "node", "block", "shingles", other)
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "shingles")
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    near = units.mapInArrow(lambda it: _units(threshold, it), "node bigint, links bigint, root bigint")
    near = materialize(near, "jaccard-links")
    counts = near.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(near.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    member = joined.join(least.select("node", "same"), "node")
    class_of = member.join(member.groupBy("root").agg(F.min("same").alias("class_id")), "root").select("node", "class_id")
    texts = (
        least.join(counts, "node", "left")
        .join(class_of, "node", "left")
        .select("h", F.coalesce("class_id", "same").alias("class_id"), F.col("same").alias("text_id"), F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies")
    )
    return documents.select("doc_id", F.md5(text_of()).alias("h")).join(texts, "h").select(
        "doc_id", "h", "class_id", "text_id", "n_links", "n_copies"
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, that of the least id; copies that repeat its id as well are one row."""
    found = join(documents)
    alone = F.when(F.col("class_id").isNull(), F.col("h"))
    first = found.groupBy("class_id", alone.alias("alone")).agg(F.min(F.struct("doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    h = unused(documents, "h")
    rows = documents.withColumn(h, F.md5(text_of()))
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows[h] == first["h"]), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).drop(h)
