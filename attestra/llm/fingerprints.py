"""Document fingerprints: one-permutation MinHash, densified, four bits a bin, with DataFrame functions only.

Every five-word shingle is hashed once. The hash's top byte names one of 256 bins and the smallest
hash of a bin stands for it. Empty bins borrow from the first filled bin of a probe sequence that
depends on the bin alone (optimal densification); what eight probes leave empty takes the filled bin
of least rank, the end of the same kind of sequence. The low four bits of each bin are packed into one
hexadecimal digit. Of equal digits a sixteenth agrees by chance, which the likeness takes off.

Null texts are empty; a text of fewer than five words is one shingle of them, a text without words
has the fingerprint of empty bins, all digits f, which is like its equals only. Rows of equal ids
follow one another in the order of their texts; null ids come first. Ids that are no whole numbers are
ordered by their own type. Repeated rows are rows like others; those of one id meet in one bucket. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import ranks
from .common import WORD_GAP, materialize, text_of

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 8
#: No hash of a shingle but one in 2^56 has these low bits; they mark an empty bin.
EMPTY = (1 << 56) - 1
#: Ids of one bucket are told apart by their low bits: 256 documents or fewer are sorted together.
BUCKET_BITS = 8
LEAST = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56)


def _is_empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(EMPTY)) == F.lit(EMPTY)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shingles(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), WORD_GAP), "")

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        found = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return _let(words, hashes)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin; one mark for each bin is sorted in after all its hashes."""
    marks = F.array(*[F.lit(_signed((b << 56) | EMPTY)) for b in range(BINS)])
    return _let(
        F.sort_array(F.concat(hashes, marks)),
        lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))),
    )


def _densify(bins: Column) -> Column:
    def probe(own: Column) -> Column:
        def fill(now: Column, turn: Column) -> Column:
            filled = F.transform(
                now, lambda h, b: F.when(_is_empty(h), F.get(own, F.pmod(F.xxhash64(b, turn), F.lit(BINS)).cast("int"))).otherwise(h)
            )
            return F.when(F.exists(now, _is_empty), filled).otherwise(now)

        def last(now: Column) -> Column:
            def lend(given: Column) -> Column:
                least = lambda b: F.array_min(F.transform(given, lambda g: F.struct(F.xxhash64(b, _bin(g)).alias("r"), g.alias("g"))))
                return F.transform(now, lambda h, b: F.when(_is_empty(h), least(b)["g"]).otherwise(h))

            lent = _let(F.filter(own, lambda h: ~_is_empty(h)), lend)
            return F.when(F.exists(now, _is_empty) & ~F.forall(own, _is_empty), lent).otherwise(now)

        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), own, fill), last)

    return _let(bins, probe)


def signature(text: Column) -> Column:
    """Sixteen longs of sixteen four-bit bins each."""

    def pack(bins: Column) -> Column:
        part = lambda k: F.slice(bins, k * 16 + 1, 16)
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // 16 - 1)),
            lambda k: F.aggregate(part(k), F.lit(0).cast("bigint"), lambda a, h: F.shiftleft(a, BITS).bitwiseOR(h.bitwiseAND(F.lit(15).cast("bigint")))),
        )

    return _let(_densify(_bins(_shingles(text))), pack)


def digits(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, the chance agreement of four bits taken off."""
    ones = F.lit(0x1111111111111111)

    def equal(x: Column) -> Column:
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(F.bitwise_not(any_bit).bitwiseAND(ones))

    n = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, x: s + equal(x))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (n / F.lit(float(BINS)) - chance) / (1 - chance))


def successors(keys: DataFrame, depth: int = 0) -> DataFrame:
    """(k, next) for distinct longs k: the next larger one, after the last the first.

    Windows hold the keys of one 16-bit range, and the ranges follow one another in the same way; no
    window has more than 65,536 rows, however many keys there are.
    """
    if depth == 4:
        everything = Window.partitionBy(F.lit(0)).orderBy("k")
        return keys.select("k", F.coalesce(F.lead("k").over(everything), F.min("k").over(Window.partitionBy(F.lit(0)))).alias("next"))
    own = keys.select("k", F.shiftright("k", 16).alias("g"))
    first = own.groupBy("g").agg(F.min("k").alias("first"))
    after = successors(first.select(F.col("g").alias("k")), depth + 1)
    opening = first.select(F.col("g").alias("next"), F.col("first").alias("opening"))
    follow = after.join(opening, "next").select(F.col("k").alias("g"), "opening")
    inside = own.select("k", "g", F.lead("k").over(Window.partitionBy("g").orderBy("k")).alias("inside"))
    return inside.join(follow, "g").select("k", F.coalesce("inside", "opening").alias("next"))


def placed(documents: DataFrame) -> DataFrame:
    """doc_id, text and at, a long in the order of the ids, whatever their type.

    Whole numbers stand for themselves, other ids for their rank. Rows without an id come first, at the ranks of their
    texts, so that many of them do not meet in one bucket.
    """
    rows = documents.select("doc_id", text_of().alias("text"))
    if isinstance(documents.schema["doc_id"].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        numbered = rows.withColumn("at", F.col("doc_id").cast("bigint"))
    else:
        ids = documents.select("doc_id").filter("doc_id IS NOT NULL").distinct()
        numbered = rows.join(ranks.before(ranks.placed(ids, ["doc_id"]), ["doc_id"], name="at"), "doc_id", "left")
    bare = documents.filter("doc_id IS NULL")
    if bare.isEmpty():
        return numbered
    texts = ranks.before(ranks.placed(bare.select(text_of().alias("text")).distinct(), ["text"]), ["text"], name="rank")
    without = numbered.filter("doc_id IS NULL").join(texts, "text").select("doc_id", "text", (F.lit(LEAST) + F.col("rank")).alias("at"))
    return numbered.filter("doc_id IS NOT NULL").unionByName(without)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text, signatures of the text, the edited text and the next document's text."""
    rows = placed(documents).withColumn("bucket", F.shiftright("at", BUCKET_BITS))
    signed = rows.select("*", signature(F.col("text")).alias("sig"))
    order = Window.partitionBy("bucket").orderBy("at", "text")
    near = signed.select(
        "*", F.lead("text").over(order).alias("after"), F.lead("sig").over(order).alias("after_sig")
    )
    # the first document of the following bucket comes after the last of this one; only the few first ones are signed again
    first = rows.groupBy("bucket").agg(F.min(F.struct("at", "text")).alias("f"))
    first = materialize(first.select("bucket", F.col("f.text").alias("first")), "fingerprints-buckets")
    following = successors(first.select(F.col("bucket").alias("k")))
    named = first.select(F.col("bucket").alias("next"), "first", signature(F.col("first")).alias("first_sig"))
    opening = following.join(named, "next").select(F.col("k").alias("bucket"), "first", "first_sig")
    n, edge = F.char_length("text"), F.col("after").isNull()
    cut = F.floor(n / 4).cast("int")
    chained = near.join(opening, "bucket").select(
        "doc_id",
        "text",
        n.cast("long").alias("n_chars"),
        "sig",
        F.when(edge, F.col("first_sig")).otherwise(F.col("after_sig")).alias("next_sig"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.when(edge, F.col("first")).otherwise(F.col("after")), F.lit(1), cut)).alias("edited"),
    )
    return chained.select("doc_id", "n_chars", "edited", "sig", "next_sig", signature(F.col("edited")).alias("edited_sig"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("sig")).alias("fingerprint"),
        digits(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
