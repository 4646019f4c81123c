"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window (ten consecutive words of an item, or a shorter item as a whole) is a set of positioned word
pairs. Containment asks for all of them, so the necessary prefix in order of rarity is its one rarest
pair, by occurrences in the corpus. Documents meet windows on that pair alone; where the window would
have to start, and whether it fits into the document, are bounds on position and length; what is left
is compared word for word.

Null and empty texts have no words, and items without words no windows. Windows that several items
share are compared once. Rows are told apart by id and text: repeated rows get the same result each.
Empty tables give no hits, or no rows. Other columns are not read. Nothing is capped: a benchmark too
large to broadcast is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, unused

WINDOW = 10
#: Windows or pairs up to this many are broadcast (about 200 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators where case still stands.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, RAW_GAP), "")


def _pair(a: Column, b: Column) -> Column:
    """lower() also folds letters beyond ASCII; that only adds candidates, and is cheaper than translate()."""
    return F.xxhash64(F.lower(a), F.lower(b))


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, item_id): the words of each window joined by spaces, which no word holds."""
    words = items.select("item_id", _raw_words(_fold(text_of())).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = words.select("item_id", "w", F.explode(starts).alias("s"))
    return each.select(F.array_join(F.slice("w", F.col("s"), length), " ").alias("window"), "item_id").distinct()


def _places(docs: DataFrame, length: int, near: bool) -> DataFrame:
    """Every word of every document with its place and the pair it begins, and words to compare a window with.

    Where the other side is broadcast, the whole word array travels along by reference; where rows are shuffled,
    they carry the words around their place only.
    """
    each = docs.select("doc_id", "h", "words", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "word"))
    each = each.withColumn("follows", F.get("words", F.col("at") + 1))
    if not near:
        return each.withColumn("base", F.lit(0))
    each = each.withColumn("base", F.greatest(F.col("at") - (length - 1), F.lit(0)))
    return each.withColumn("words", F.slice("words", F.col("base") + 1, 2 * length))


def hits(documents: DataFrame, items: DataFrame, length: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, h, start, n, window) wherever a window of items stands in a document."""
    docs = documents.select("doc_id", F.xxhash64(text_of()).alias("h"), _raw_words(text_of()).alias("words"))
    found = materialize(windows(items, length).select("window").distinct(), "decontamination-windows")
    split = found.select("window", F.split("window", " ").alias("w")).select("window", "w", F.size("w").alias("n"))
    count = found.count()
    pairs = split.filter("n > 1").select("window", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("offset"))
    pairs = pairs.select("window", "n", "offset", _pair(F.get("w", F.col("offset")), F.get("w", F.col("offset") + 1)).alias("pair"))
    wanted = pairs.select("pair").distinct()
    place = _places(docs, length, False).select(_pair(F.col("word"), F.col("follows")).alias("pair"))
    if count * (length - 1) <= broadcast_rows:
        rarity = place.join(F.broadcast(wanted), "pair").groupBy("pair").agg(F.count("*").alias("seen"))
    else:  # counted where they stand before anything is shuffled
        rarity = place.groupBy("pair").agg(F.count("*").alias("seen")).join(wanted, "pair")
    # a window with an unseen pair stands nowhere; of the others the rarest pair is the prefix
    rarest = (
        pairs.join(rarity, "pair", "left")
        .groupBy("window", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "pair", "offset")).alias("p"))
        .filter("p.seen > 0")
        .select("window", "n", F.col("p.pair").alias("pair"), F.col("p.offset").alias("offset"))
    )
    near = count > broadcast_rows

    def met(side: DataFrame, second: Column) -> DataFrame:
        each = _places(docs, length, near).withColumn("pair", _pair(F.col("word"), second))
        return each.join(side if near else F.broadcast(side), "pair")

    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = _fold(F.array_join(F.slice("words", start - F.col("base") + 1, F.col("n")), " ")) == F.col("window")
    out = ("doc_id", "h", start.alias("start"), "n", "window")
    result = met(materialize(rarest, "decontamination-prefixes"), F.col("follows")).filter(fits).filter(same).select(*out)
    if not split.filter("n = 1").isEmpty():
        none = F.lit(None).cast("string")
        ones = split.filter("n = 1").select("window", "n", F.lit(0).alias("offset"), _pair(F.col("window"), none).alias("pair"))
        result = result.unionByName(met(ones, none).filter(same).select(*out))
    return result


def contamination(documents: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """A row for each of documents: doc_id, h (hash of its text), n_words, n_hit, items (sorted ids), contaminated."""
    items = items.select("item_id", "text")
    hit = materialize(hits(documents, items, length), "decontamination-hits")
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    spans = (
        hit.groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("start", "n")).alias("spans"))
        .select("doc_id", "h", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"))
    )
    named = (
        hit.select("doc_id", "h", "window")
        .distinct()
        .join(windows(items, length), "window")
        .groupBy("doc_id", "h")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])

    both = spans.join(named, same(spans, named)).select(spans["doc_id"], spans["h"], "n_hit", "items")
    base = documents.select(
        "doc_id", F.xxhash64(text_of()).alias("h"), F.size(_raw_words(text_of())).cast("long").alias("n_words")
    )
    return base.join(both, same(base, both), "left").select(
        base["doc_id"],
        base["h"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def keep_clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a window of the benchmark, with their own columns."""
    hit = materialize(hits(documents, items.select("item_id", "text")).select("doc_id", "h").distinct(), "decontamination-hits")
    h = unused(documents, "h")
    rows = documents.withColumn(h, F.xxhash64(text_of()))
    kept = rows.join(hit, rows["doc_id"].eqNullSafe(hit["doc_id"]) & (rows[h] == hit["h"]), "left_anti")
    return kept.drop(h)
