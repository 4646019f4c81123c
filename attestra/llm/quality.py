"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of hashed terms: its words, and the shapes of its tokens (letters, digits and other
runs folded to one sign each, ASCII punctuation as it is; a word that repeats the one before adds to a shape
of its own), each kind weighted by idf and scaled to
length one. A truncated singular value decomposition of a bounded sample of labelled rows gives the
latent directions. The sample's vectors are broadcast (SAMPLE rows of RANK numbers); every document's
cosine with each of them is computed exactly, block by block, and the labels of its NEIGHBOURS nearest
are averaged with the fourth power of their similarities as weights, negative ones counting nothing: near
neighbours outweigh many distant ones.

Null and empty texts have the zero vector, no similarities, and the share of label 1 as their score;
so has every text if the sample is empty (0.5 without labels). Ties between neighbours go to the
smaller hash of the id; of labelled rows with one id the least text counts. Null ids belong to fold 0. Repeated rows get equal scores, an empty table gives
an empty result, and columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of, words_of

FOLDS, HELD_OUT = 3, 1
#: Labelled rows that the directions and the vote rest on at most, those of the smallest hash.
SAMPLE = 4_000
WORDS, SHAPES, RANK, NEIGHBOURS = 1024, 512, 48, 25
#: What words and shapes each add to the squared length of a vector.
WORD_SHARE = 0.3
BLOCK = 512
#: Upper- and lower-case letters, digits and bytes beyond ASCII become one sign each; white space a space.
SHAPE = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


class _Places(dict):
    """Term to dimension, forgotten when it has grown large."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, term: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[term] = at = zlib.crc32(term) % self.size
        return at


def terms(text: str | None, words: _Places, shapes: _Places) -> np.ndarray:
    """Counts over WORDS + SHAPES dimensions, damped by logarithm for words and relative for shapes."""
    out = np.zeros(WORDS + SHAPES, np.float32)
    found = words_of(text)
    if found:
        at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        out[:WORDS] = np.log1p(np.bincount(at, minlength=WORDS))
        out[WORDS + shapes[b"= ="]] = np.count_nonzero(at[1:] == at[:-1])
    raw = (text or "").encode("utf-8", "surrogatepass").translate(SHAPE)
    kinds = Counter(_RUN.sub(rb"\1", raw).split())
    for shape, n in kinds.items():
        out[WORDS + shapes[shape]] += n
    return out


@dataclass
class Neighbours:
    """Directions, the sample's vectors in them, and its labels."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return _scaled(_weighted(rows, self.idf) @ self.directions)

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.share)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        x = self.latent(rows)
        for lo in range(0, len(x), BLOCK):
            near = x[lo : lo + BLOCK] @ self.vectors.T
            at = nearest(near, k)
            weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[at]).sum(1)
            out[lo : lo + BLOCK] = np.where(total > 0, vote / np.maximum(total, 1e-30), self.share)
        return np.clip(out, 0.0, 1.0)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest numbers of each row; of equal ones the first."""
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    above, ties = near > least, near == least
    picked = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(picked)[1].reshape(-1, k)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = rows * idf
    return np.hstack([_scaled(x[:, :WORDS]) * WORD_SHARE**0.5, _scaled(x[:, WORDS:]) * (1 - WORD_SHARE) ** 0.5])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, shapes = _Places(WORDS), _Places(SHAPES)
    for batch in batches:
        found = [terms(t, words, shapes).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("order"), pa.array(found, pa.binary())], names=["y", "order", "v"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """Directions from the second moments of at most `sample` labelled rows outside the held-out fold."""
    order = F.xxhash64("doc_id", F.lit("quality")).alias("order")
    known = (
        labels.filter((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("y"))
        .select("doc_id", "y", order)
    )
    chosen = known.orderBy("order", "doc_id").limit(sample)
    rows = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y", "order").agg(F.min("text").alias("text")).select("y", "order", "text")
    got = rows.mapInArrow(_vectors, "y int, order bigint, v binary").toArrow().sort_by([("order", "ascending"), ("v", "ascending")])
    y = got["y"].to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float32).reshape(len(y), WORDS + SHAPES)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y):
        return Neighbours(np.ones(WORDS + SHAPES, np.float32), np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, share)
    idf = (np.log((1 + len(y)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    weighted = _weighted(x, idf)
    _, vectors = np.linalg.eigh(weighted.T @ weighted)
    directions = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return Neighbours(idf, directions, _scaled(weighted @ directions), y, share)


def _scores(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, shapes = _Places(WORDS), _Places(SHAPES)
    for batch in batches:
        texts, found = batch.column("text").to_pylist(), []
        for lo in range(0, len(texts), BLOCK):
            found.append(model.value.score(np.stack([terms(t, words, shapes) for t in texts[lo : lo + BLOCK]])))
        score = np.concatenate(found) if found else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))
    rows = documents.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scores(shared, it), f"doc_id {kind}, held_out boolean, score double, predicted int")
