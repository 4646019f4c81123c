"""SimHash near-duplicates: pigeonring candidates, exact Hamming distances, connected components.

Words are runs of anything but ASCII white space, with A-Z lower-cased; every run of four words (all words of a
shorter text) is hashed with XXH64, repeats included, and a bit of the 64-bit fingerprint is one if it is one in
more than half of the hashes. A text without words has fingerprint zero and is linked like any other.

Two fingerprints of at most LIMIT = 4 different bits are linked. The 64 bits form a ring of five segments. By the
pigeonring principle such a pair has a segment from which on every chain of l consecutive segments differs in
at most floor(4 l / 5) bits: none in the first, one in two, two in three, three in four. The first two demands
are a join key: the first segment is equal, and of the two halves of the next one at least one is. Rows with equal
keys are then held to the longer chains, and what is left is compared in full. No pair within the limit is lost.

Equal fingerprints are one row from the start. A key's rows are cut into blocks by hash and each pair of blocks is a
unit of work, so that no task holds more than two blocks however many fingerprints share a key; a unit returns a
spanning forest of its links, never the pairs.

Null texts are empty. component_id is the least doc_id in reach, null ids left aside; it is null where all are
null. Rows with one id, and repeated rows, get results row by row. Very long texts are hashed in portions. An
empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, slices, text_of

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Bits of the segments around the ring.
SEGMENTS = (13, 13, 13, 13, 12)
#: Fingerprints of a block; a unit compares two blocks.
BLOCK = 512
#: Bytes of a text that are hashed at once; rows and links that a task compares at once.
PORTION, ROWS, LINKS = 1 << 20, 1 << 17, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FULL = (1 << 64) - 1


def hashes(data: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in order, in portions."""
    digest, carry, lo, some = xxhash.xxh64_intdigest, [], 0, False
    while lo < len(data):
        hi = min(len(data), lo + PORTION)
        cut = _SPACE.search(data, hi)
        hi = cut.end() if cut else len(data)
        words = carry + data[lo:hi].translate(_LOWER).split()
        lo, n = hi, len(words) - SHINGLE + 1
        if n > 0:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts, stops = [0, *ends[: n - 1].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
            some, carry = True, words[1 - SHINGLE :]
        else:
            carry = words
    if carry and not some:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed long."""
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes((text or "").encode("utf-8", "surrogatepass")):
        for at in range(0, len(part), 8192):
            some = part[at : at + 8192]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (bigint) of each document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fingerprint bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chains(segments: tuple[int, ...] = SEGMENTS) -> list[list[int]]:
    """For each first segment the bits of the chains of one, two, ... segments from there around the ring."""
    starts = np.cumsum([0, *segments]).tolist()
    mask = [((1 << n) - 1) << at for n, at in zip(segments, starts, strict=False)]
    m = len(segments)
    return [[sum(mask[(i + k) % m] for k in range(n)) for n in range(1, m + 1)] for i in range(m)]


def budgets(segments: tuple[int, ...] = SEGMENTS, limit: int = LIMIT) -> list[int]:
    """How many bits a chain of one, two, ... segments may differ in."""
    return [limit * n // len(segments) for n in range(1, len(segments) + 1)]


def key_masks(segments: tuple[int, ...] = SEGMENTS) -> list[int]:
    """Two keys for each first segment: its bits, and one half of those of the next."""
    found, m = [], len(segments)
    starts = np.cumsum([0, *segments]).tolist()
    for i in range(m):
        own, after = chains(segments)[i][0], (i + 1) % m
        low = segments[after] // 2
        half = ((1 << low) - 1) << starts[after]
        found += [own | half, own | (chains(segments)[after][0] ^ half)]
    return found


def _near(part: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray, value: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (a, b) of units that follow one another: each row with those after it in its unit."""
    n = len(value)
    unit = np.cumsum(np.r_[False, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if n else part
    ring = np.array(chains(), np.uint64)
    allowed, first = budgets(limit=limit), part // 2
    at, crossed = np.arange(n), i != j
    for away in range(1, n):
        at = at[: np.searchsorted(at, n - away)]
        at = at[unit[at] == unit[at + away]]
        if not len(at):
            break
        a = at[~crossed[at] | (block[at] != block[at + away])]
        differ, start = value[a] ^ value[a + away], first[a]
        for length in range(1, ring.shape[1]):  # chain after chain; the whole ring is the full check
            fit = np.bitwise_count(differ & ring[start, length]) <= allowed[length]
            a, differ, start = a[fit], differ[fit], start[fit]
        if len(a):
            yield a, a + away


def _forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row in reach of each row."""
    root, held = np.arange(n), []

    def settle() -> None:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        while True:
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            np.minimum.at(root, before[a], root[a])
            np.minimum.at(root, before[b], root[b])
            root[:] = root[root]
            if (root == before).all():
                return

    for pair in found:
        held.append(pair)
        if sum(len(a) for a, _ in held) > LINKS:
            settle()
    if held:
        settle()
    return root


def _units(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; what may go on in the next batch waits for it."""

    def told(rows: pa.Table) -> pa.RecordBatch:
        part, key, i, j, block = (rows[c].to_numpy() for c in ("part", "key", "i", "j", "block"))
        value = rows["fingerprint"].to_numpy()
        root = _forest(len(value), _near(part, key, i, j, block, value.view(np.uint64), limit))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(value[linked]), pa.array(value[root[linked]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        rows = pa.Table.from_batches(held)
        names = [rows[c].to_numpy() for c in ("part", "key", "i", "j")]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        if len(new):
            yield told(rows.slice(0, new[-1]))
            held = rows.slice(new[-1]).to_batches()
    if held:
        yield told(pa.Table.from_batches(held))


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): a spanning forest of the links among distinct fingerprints."""
    if budgets(limit=limit)[:2] != [0, 1]:
        raise ValueError(f"the keys hold for a limit of 4 bits on {len(SEGMENTS)} segments, not for {limit}")
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in key_masks()])
    keyed = prints.select("fingerprint", F.posexplode(keys).alias("part", "key"))
    shared = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1").select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # one key may have most of the rows: as a written table the sizes meet them in a join that adaptive execution can split
    placed = keyed.join(materialize(shared, "simhash-keys"), ["part", "key"])
    both = placed.withColumn("block", F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("blocks")).cast("int"))
    units = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fingerprint"
    )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return units.mapInArrow(lambda it: _units(limit, it), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (bigint), component_id of every document."""
    told = materialize(fingerprints(documents), "simhash-fingerprints")
    prints = materialize(told.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(prints, limit), "simhash")
    member = found.select(F.col("node").alias("fingerprint"), "root").join(prints, "fingerprint")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = member.join(first, "root").select("fingerprint", "component_id", F.lit(True).alias("linked"))
    named = prints.join(class_of, "fingerprint", "left").select("fingerprint", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    # a fingerprint that many documents share is a skewed key of small rows: a join of written tables, which adaptive execution can split
    return told.join(materialize(named, "simhash-classes"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
