"""Prediction by partial matching over bytes, next to a smoothed word model, for every document.

All training documents are counted: each byte with the ORDER bytes before it, in numpy inside the
tasks and then by Spark. Shorter contexts are sums of these counts, and no count is left out. The
n-grams are dealt by the last NEAR bytes of their context, so that a task has whole tries of the longer
orders; the shorter ones, at most 2^24 n-grams each, are broadcast. The code length of each distinct
n-gram of any document is looked up there once. The most frequent n-grams are broadcast with it, (ORDER
+ 1) * KEPT at most; the rest of each document's n-grams finds it by a join. Escapes follow method C and symbols seen in the
longer context are excluded below it; since a longer context's symbols are always among the shorter
one's, what an exclusion takes off is one number per context, and a document's code length is a sum of
table lookups. Bytes that no order predicts are uniform over what is left of the 256. 0xFF, which UTF-8
never holds, stands before the first byte and ends each text.

Words of a share of the training tokens of at least one in WORDS are broadcast with their counts; the
rest of each document's words finds its counts by a join.

Null and empty texts have one token, the end. Null ids belong to fold 0. Without training documents
every byte is uniform and every base score 0. Repeated rows are rows like others; an empty table gives
an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, lists, materialize, slices, text_of

FOLDS, HELD_OUT = 7, 2
ORDER, KEPT, WORDS = 5, 1 << 20, 1 << 18
#: Contexts up to the one before this length are broadcast; longer ones with the same last bytes share a task.
NEAR = 3
END, SLICE = 0xFF, 1 << 21
#: Distinct n-grams that a task gathers before it hands them on.
GATHERED = 2_000_000
#: Distinct n-grams of one task that looks their code lengths up.
TRIE = 1 << 19


def tokens_of(text: str) -> list[bytes]:
    """ASCII letters lowered, split at ASCII white space; bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _codes(texts: list[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (n-gram ending at each byte or end, lengths of the texts in it), whole texts together."""

    def told(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pad = bytes([END]) * order
        flat = np.frombuffer(pad + pad.join(p + bytes([END]) for p in parts), np.uint8)
        length = np.array([len(p) + 1 for p in parts], np.int64)
        begin = order + np.cumsum(length + order) - (length + order)
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        code = np.zeros(len(at), np.int64)
        for back in range(order, -1, -1):
            code = (code << 8) | flat[at - back]
        return code, length

    parts, size = [], 0
    for text in texts:
        parts.append(text.encode("utf-8", "surrogatepass"))
        size += len(parts[-1])
        if size >= SLICE:
            yield told(parts)
            parts, size = [], 0
    if parts:
        yield told(parts)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables of counts as one; a stable sort merges sorted runs in one go."""
    code, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    at = np.argsort(code, kind="stable")
    code, n = code[at], n[at]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(n, first)


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told = lambda t: pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1])], names=["code", "times"])
    seen = None
    for batch in slices(batches):
        for code, _ in _codes(batch.column("text").to_pylist()):
            found, n = np.unique(code, return_counts=True)
            own = found, n.astype(np.int64)
            seen = own if seen is None else _added(seen, own)
            if len(seen[0]) > GATHERED:
                yield told(seen)
                seen = None
    if seen is not None:
        yield told(seen)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            seen.update(tokens_of(text))
        if len(seen) > GATHERED // 10:
            yield told(seen)
            seen = Counter()
    yield told(seen)


@dataclass
class _Order:
    """n-grams of one length in order, their counts, and their contexts' totals."""

    codes: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        at = np.argsort(self.codes)
        self.codes, self.counts = self.codes[at], self.counts[at].astype(np.float64)
        self.contexts, first, self.kinds = np.unique(self.codes >> 8, return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.out = np.zeros(len(self.contexts))  # what the next shorter order leaves out after an escape from here
        space = np.repeat(self.totals + self.kinds, self.kinds)
        self.direct = np.log10(self.counts / space) if len(first) else np.zeros(0)  # without an escape before

    @staticmethod
    def find(sorted_codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_codes):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
        return at, sorted_codes[at] == wanted


class Trie:
    """Code lengths by table lookup; orders from none to the longest context."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.orders = [_Order(c, n) for c, n in tables]
        for j in range(1, len(self.orders)):
            own, below = self.orders[j], self.orders[j - 1]
            at, _ = _Order.find(below.codes, own.codes & ((1 << 8 * j) - 1))
            if len(own.codes):
                own.out = np.bincount(np.searchsorted(own.contexts, own.codes >> 8), below.counts[at], len(own.contexts))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Of each n-gram: log10 probability of its last byte after the others."""
        result = np.zeros(len(codes))
        todo, out, gone = np.arange(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
        for j in range(len(self.orders) - 1, -1, -1):
            table = self.orders[j]
            if not len(table.codes) or not len(todo):
                continue
            own = codes[todo] & ((1 << 8 * (j + 1)) - 1)
            s, seen = _Order.find(table.codes, own)
            plain = seen & (gone == 0)
            result[todo[plain]] += table.direct[s[plain]]
            todo, own, s, seen, out, gone = (x[~plain] for x in (todo, own, s, seen, out, gone))
            c, known = _Order.find(table.contexts, own >> 8)
            rest = table.kinds[c] - gone  # symbols that are not excluded: as many escapes
            space = table.totals[c] - out + rest
            miss = known & ~seen & (rest > 0)
            result[todo[seen]] += np.log10(table.counts[s[seen]] / space[seen])
            result[todo[miss]] += np.log10(rest[miss] / space[miss])
            out, gone = np.where(known, table.out[c], 0.0)[~seen], np.where(known, table.kinds[c], 0)[~seen]
            todo = todo[~seen]
        result[todo] -= np.log10(np.maximum(256 - gone, 1))
        return result


def _train(documents: DataFrame) -> DataFrame:
    return documents.filter(fold_of("doc_id", FOLDS) != HELD_OUT).select(text_of().alias("text"))


def _order(grams: DataFrame, j: int) -> DataFrame:
    """Counts of the n-grams with contexts of j bytes."""
    return grams.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, kept: int = KEPT) -> Trie:
    """One trie of at most `kept` n-grams an order, by a least count; score() leaves nothing out and has no use for it."""
    grams = _train(documents).mapInArrow(_count_bytes, "code bigint, times bigint").groupBy("code").agg(F.sum("times").alias("n"))
    grams = materialize(grams, "language-model-bytes")
    orders = [_order(grams, j) for j in range(ORDER)] + [grams]
    least = max(_least(o, "n", kept) for o in orders)
    found = [o.filter(F.col("n") >= least).toArrow() for o in orders]
    return Trie([(t["code"].to_numpy(), t["n"].to_numpy()) for t in found])


def _least(table: DataFrame, name: str, kept: int) -> int:
    """The smallest power of two that at most `kept` rows reach."""
    steps = [1 << k for k in range(48)]
    sizes = table.agg(*[F.count_if(F.col(name) >= t).alias(str(t)) for t in steps]).first()
    return next(t for t in steps if sizes[str(t)] <= kept)


def _code_lengths(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of n-grams that come with all others of the same last NEAR bytes of context: their log10 probabilities."""
    parts = [tuple(b.column(c).to_numpy() for c in ("code", "n", "times")) for b in batches]
    if not parts:
        return
    code, n, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    tables = list(shared.value)
    for j in range(NEAR, ORDER + 1):
        own, at = np.unique(code[n > 0] & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
        tables.append((own, np.bincount(at, n[n > 0], len(own))))
    value = Trie(tables).log10(code)
    for lo in range(0, len(code), SLICE // 32):
        cut = slice(lo, lo + SLICE // 32)
        yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (code, value, times)], names=["code", "value", "times"])


def code_lengths(documents: DataFrame) -> DataFrame:
    """(code, value, times) of each distinct n-gram of all documents: log10 probability after training, occurrences."""
    held = documents.filter(fold_of("doc_id", FOLDS) == HELD_OUT).select(text_of().alias("text"))
    found = [d.mapInArrow(_count_bytes, "code bigint, times bigint") for d in (_train(documents), held)]
    both = found[0].withColumn("n", F.col("times")).unionByName(found[1].withColumn("n", F.lit(0).cast("bigint")))
    grams = both.groupBy("code").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    grams = materialize(grams, "language-model-bytes")
    short = [_order(grams.filter("n > 0"), j).toArrow() for j in range(NEAR)]
    shared = documents.sparkSession.sparkContext.broadcast([(t["code"].to_numpy(), t["n"].to_numpy()) for t in short])
    near = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * NEAR) - 1))
    dealt = grams.repartition(-(-grams.count() // TRIE) or 1, near)
    values = dealt.mapInArrow(lambda it: _code_lengths(shared, it), "code bigint, value double, times bigint")
    return materialize(values, "language-model-values")


def _read(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, values, words, counts, ends = shared.value
    if not isinstance(words, dict):
        words = {w: i for i, w in enumerate(words)}
        shared.value[2] = words
    none, row, part = len(words), 0, TaskContext.get().partitionId() << 33
    plus = np.append(np.log10(counts + 1.0), 0.0)
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        scores, missed, missed_codes, missed_times = [], [], [], []
        for code, length in _codes(texts):
            distinct, at = np.unique(code, return_inverse=True)
            place, common = _Order.find(grams, distinct)
            value = np.where(common, values[place], 0.0) if len(values) else np.zeros(len(distinct))
            scores.append(np.add.reduceat(value[at], np.cumsum(length) - length))
            lost = ~common[at]
            pair, times = np.unique(np.repeat(np.arange(len(length)), length)[lost] * len(distinct) + at[lost], return_counts=True)
            missed.append(np.bincount(pair // len(distinct), minlength=len(length)))
            missed_codes.append(distinct[pair % len(distinct)])
            missed_times.append(times.astype(np.int32))
        rows, lengths, rare_words, rare_counts = [], [], [], []
        for text in texts:
            found = tokens_of(text)
            ids = np.fromiter((words.get(w, none) for w in found), np.int64, len(found))
            rare = Counter(found[k] for k in np.flatnonzero(ids == none))
            known = len(found) - sum(rare.values()) + (ends > 0)
            base = float(plus[ids].sum()) + float(np.log10(ends + 1.0))
            rows.append((part + row, len(found) + 1, known, base))
            row += 1
            lengths.append(len(rare))
            rare_words += rare.keys()
            rare_counts += rare.values()
        cols = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        arrays.append(lists(lengths, word=pa.array(rare_words, pa.binary()), n=pa.array(rare_counts, pa.int64())))
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        arrays.append(lists(flat(missed, np.int64), code=pa.array(flat(missed_codes, np.int64)), times=pa.array(flat(missed_times, np.int32))))
        score = pa.array(flat(scores, np.float64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), *arrays, score],
            names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "rare", "missed", "score"],
        )


def score(documents: DataFrame, kept: int = KEPT, words: int = WORDS) -> DataFrame:
    """A row for each of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = _train(documents)
    counts = train.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-model-words")
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = train.count()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    common = counts.filter(F.col("n") >= tokens / words).toArrow()
    grams = code_lengths(documents)
    known = grams.filter(F.col("times") >= _least(grams, "times", (ORDER + 1) * kept)).select("code", "value").toArrow().sort_by("code")
    model = [known["code"].to_numpy(), known["value"].to_numpy(), common["word"].to_pylist(), common["n"].to_numpy(), ends]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), text_of().alias("text"))
    schema = (
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, row bigint, n_tokens bigint, "
        "known bigint, base double, rare array<struct<word: binary, n: bigint>>, "
        "missed array<struct<code: bigint, times: int>>, score double"
    )
    read = materialize(rows.mapInArrow(lambda it: _read(shared, it), schema), "language-model-read")
    rare = read.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    more = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("also"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("sum")
    )
    missed = read.select("row", F.explode("missed").alias("m")).select("row", "m.code", F.col("m.times").alias("here"))
    rest = missed.join(grams.select("code", "value"), "code").groupBy("row").agg(F.sum(F.col("here") * F.col("value")).alias("rest"))
    space = F.log10(F.lit(float(tokens + kinds + 1)))
    return read.join(more, "row", "left").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
