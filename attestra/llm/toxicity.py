"""Toxicity by two class-conditional Kneser-Ney models of how words are spelled.

A word is a sequence of characters between a start and an end. Either class counts each character with
the ORDER - 1 characters before it, once for each distinct word of a document, discounts the counts (the
discount follows from how many n-grams were seen once and twice), and hands what it took off to a
backoff that both classes share: the interpolated Kneser-Ney model of all shorter contexts, in which an
n-gram counts by how many characters stand before it. Where the classes' probabilities are fewer than APART
standard errors apart (by the variance between documents) they are smoothed altogether: both classes take
one estimate there, and the n-gram speaks for neither, unless it holds an n-gram that does and bears it out
or refutes it by NEAR standard errors. So rare expressions, and the topics and languages of a few training
documents, weigh nothing, while inflected or compounded forms of an abusive stem weigh as the stem does.

A text's evidence is the difference of its two log-likelihoods over its number of words, a word's share
of it being shrunk by DEAD. A one-dimensional logistic fit on labelled rows that the counts have not seen
turns this into a probability.

All counting, discounting, backing off and comparing is done by Spark over the labelled rows; the driver
gets the n-grams that tell the classes apart. Null and empty texts have no words: their evidence is 0 and
they get the score of evidence 0. Null ids belong to fold 0; of labelled rows with one id the least text
counts, and of differing labels the larger. Repeated rows get equal scores. Without labelled rows of both
classes every score is the share of label 1 (0 if there are no labels). Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, materialize, slices, text_of, words_of

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: Labelled rows of each class that the models are fitted on at most, those of the smallest hash; a fifth calibrates.
SAMPLE = 4_000
#: Characters of an n-gram, the one predicted included.
ORDER = 6
#: Standard errors between the classes' probabilities of a character, below which they are taken to be one.
APART = 2.5
#: The same for n-grams that hold such an n-gram: they may bear it out or refute it.
NEAR = 1.5
#: What a word's log-likelihood ratio is shrunk by: ordinary words drift that far with languages and topics.
DEAD = 2.0
START, END = "\x01", "\x02"
WORDS = 500_000


def grams(word: bytes) -> list[str]:
    """Each character of a word, and its end, after the characters before it."""
    spelled = START + word.decode("utf-8", "replace") + END
    return [spelled[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(spelled))]


class _Ratios(dict):
    """Word to its shrunk log-likelihood ratio, forgotten when it has grown large."""

    def __init__(self, ratio: dict[str, float]):
        super().__init__()
        self.ratio = ratio

    def __missing__(self, word: bytes) -> float:
        if len(self) > WORDS:
            self.clear()
        of = self.ratio
        whole = sum(of.get(g, 0.0) for g in grams(word))
        self[word] = value = math.copysign(max(abs(whole) - DEAD, 0.0), whole)
        return value


@dataclass
class Models:
    """log P(character | context, toxic) - log P(character | context, ordinary), and the logistic curve over evidence."""

    ratio: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    slope: float = 0.0
    shift: float = 0.0

    def reader(self) -> _Ratios:
        return _Ratios(self.ratio)

    def score(self, evidence: float) -> float:
        at = self.slope * math.asinh(evidence / self.scale) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, at))))


def evidence(text: str | None, reader: _Ratios) -> float:
    words = words_of(text)
    return math.fsum(map(reader.__getitem__, words)) / len(words) if words else 0.0


def labelled(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """(text, y, part, weight) of labelled documents outside the held-out fold, at most `sample` of a class.

    weight makes up for the share of the class that is left out; part 4 of 0-4 calibrates.
    """
    known = (
        labels.filter((fold_of("doc_id", folds) != held_out) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, n in sorted(size.items()):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        part = part.withColumn("weight", F.lit(max(1.0, n / sample)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known.withColumn("weight", F.lit(1.0))
    rows = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(5)).alias("part")
    return rows.groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")).select("text", "y", part, "weight")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each n-gram and class: its count, and over documents the sums of its square and of its product with its context's."""
    for batch in slices(batches, 256):
        counts: dict[tuple[str, int], list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            own = Counter(g for word in set(words_of(text)) for g in grams(word))
            context: Counter = Counter()
            for g, n in own.items():
                context[g[:-1]] += n
            for g, n in own.items():
                sums = counts.setdefault((g, y), [0, 0, 0])
                sums[0] += n
                sums[1] += n * n
                sums[2] += n * context[g[:-1]]
        flat = np.array(list(counts.values()), np.int64).reshape(-1, 3)
        arrays = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), *map(pa.array, flat.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=["gram", "y", "n", "nn", "nc"])


def _discount(once: Column, twice: Column) -> Column:
    """The share of a count that the backoff gets, by the counts of counts; at least a tenth and at most all of it."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(1.0))))


def _before(gram: Column) -> Column:
    return F.left(gram, F.char_length(gram) - 1)


def _totals(table: DataFrame, *counts: str) -> DataFrame:
    """Beside each n-gram: all counts of its context, and how many characters were seen there."""
    each = [x for c in counts for x in (F.sum(c).alias(f"all_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))]
    table = table.withColumn("context", _before(F.col("gram")))
    return table.join(table.groupBy("context").agg(*each), "context").drop("context")


def _shared(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, shared): the shared probability of the last character of each wanted n-gram after a shorter context."""
    tails = counted.select(F.explode(F.transform(F.sequence(F.lit(2), F.char_length("gram")), lambda n: F.right("gram", n))).alias("tail")).distinct()
    lower = tails.select(F.substring("tail", 2, ORDER).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    taken = lower.agg(_discount(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).alias("d"), F.count_if(F.char_length("gram") == 1).alias("letters"))
    lower = _totals(lower, "n").select(F.col("gram").alias("tail"), "n", "all_n", "kinds_n")
    ends = wanted.select("gram", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("gram") - 1), lambda n: F.right("gram", n))).alias("tail"))
    levels = ends.join(lower, "tail").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(F.char_length("tail").alias("at"), "n", "all_n", "kinds_n"))).alias("levels"))

    def deeper(p: Column, x: Column) -> Column:
        return (F.greatest(x["n"] - F.col("d"), F.lit(0.0)) + F.col("d") * x["kinds_n"] * p) / x["all_n"]

    return levels.crossJoin(F.broadcast(taken)).select("gram", F.aggregate("levels", 1.0 / (F.col("letters") + 1), deeper).alias("shared"))


def _deviations(counted: DataFrame) -> Column:
    """How many standard errors the classes' probabilities are apart, by the variance between documents."""
    n, total, nn, nc, cc = ([F.col(f"{c}{y}") for y in (0, 1)] for c in ("n", "all_n", "nn", "nc", "all_nc"))
    pooled = (n[0] + n[1] + 1) / (total[0] + total[1] + 2)
    between = [(nn[y] - 2 * pooled * nc[y] + pooled * pooled * cc[y]) / (total[y] * total[y]) for y in (0, 1)]
    within = [pooled * (1 - pooled) / total[y] for y in (0, 1)]
    error = F.sqrt(F.greatest(between[0], within[0]) + F.greatest(between[1], within[1]))
    return F.abs(n[1] / total[1] - n[0] / total[0]) / error


def ratios(rows: DataFrame) -> DataFrame:
    """(gram, ratio) of the n-grams by which the classes differ, and of those that hold one of them."""
    each = rows.mapInArrow(_count, "gram string, y int, n long, nn long, nc long")
    sums = [F.coalesce(F.sum(F.when(F.col("y") == y, F.col(c))), F.lit(0)).alias(f"{c}{y}") for c in ("n", "nn", "nc") for y in (0, 1)]
    counted = materialize(each.groupBy("gram").agg(*sums), "toxicity-counts")
    seen = lambda k: F.count_if(F.col("n0") == k) + F.count_if(F.col("n1") == k)
    taken = counted.agg(_discount(seen(1), seen(2)).alias("d"))
    full = _totals(counted, "n0", "n1", "nc0", "nc1").filter("all_n0 > 0 AND all_n1 > 0")
    full = materialize(full.withColumn("apart", _deviations(full)), "toxicity-deviations")
    apart = full.filter(F.col("apart") >= APART).select(F.col("gram").alias("part"))
    size = F.char_length("gram")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(F.lit(2), size - i + 1), lambda n: F.substring("gram", i, n))))
    near = full.filter(F.col("apart") >= NEAR).select("gram", F.explode(parts).alias("part")).join(apart, "part").select("gram").distinct()
    wanted = materialize(full.join(near, "gram"), "toxicity-apart")

    def likelihood(y: int) -> Column:
        return (F.greatest(F.col(f"n{y}") - F.col("d"), F.lit(0.0)) + F.col("d") * F.col(f"kinds_n{y}") * F.col("shared")) / F.col(f"all_n{y}")

    both = wanted.join(_shared(counted, wanted), "gram").crossJoin(F.broadcast(taken))
    return both.select("gram", (F.log(likelihood(1)) - F.log(likelihood(0))).alias("ratio"))


def fit(rows: DataFrame) -> Models:
    """The n-grams that differ, and the calibration, of labelled rows."""
    rows = materialize(rows, "toxicity-sample")
    if {r["y"] for r in rows.select("y").distinct().collect()} != {0, 1}:
        share = rows.agg(F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).first()[0] or 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Models(shift=math.log(share / (1 - share)))
    found = ratios(rows.filter("part != 4")).toArrow()
    return _calibrate(Models(dict(zip(found["gram"].to_pylist(), found["ratio"].to_pylist(), strict=True))), rows.filter("part = 4"))


def _evidence(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = model.value.reader()
    for batch in slices(batches):
        found = [evidence(t, reader) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("weight"), pa.array(found, pa.float64())], names=["y", "weight", "x"])


def _calibrate(model: Models, rows: DataFrame) -> Models:
    """Logistic fit of the label on the evidence, whose large values are drawn in, over a bounded number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    got = rows.mapInArrow(lambda it: _evidence(shared, it), "y int, weight double, x double").toArrow()
    y, x, w = got["y"].to_numpy().astype(float), got["x"].to_numpy(), got["weight"].to_numpy()
    model.scale = float(np.abs(x).mean()) or 1.0 if len(x) else 1.0
    if len(set(y.tolist())) < 2:
        model.slope = 1.0
        return model
    a = np.stack([np.arcsinh(x / model.scale), np.ones_like(x)], 1)
    beta, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(beta[0]), 0.0), float(beta[1])
    return model


def _scores(model, cut: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = model.value.reader()
    for batch in slices(batches):
        found = np.array([model.value.score(evidence(t, reader)) for t in batch.column("text").to_pylist()], np.float64)
        added = [pa.array(found), pa.array((found >= cut).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "score", "predicted"])


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, text, score, predicted) of every row of documents."""
    model = fit(labelled(documents, labels, "toxic", FOLDS, HELD_OUT, sample))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda it: _scores(shared, cut, it), f"doc_id {kind}, held_out boolean, text string, score double, predicted int"
    )


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the cut, with their own columns."""
    model = fit(labelled(documents, labels, "toxic", FOLDS, HELD_OUT, SAMPLE))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in slices(batches):
            keep = [shared.value.score(evidence(t, reader)) < CUT for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
