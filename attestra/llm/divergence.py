"""Source divergence audit: which terms, and which other sources, set a source of a language apart.

Tasks count with Arrow's compute functions: texts are lower-cased (A-Z only), split at everything that is no
letter, terms are encoded as a dictionary and counted by hash grouping, first by document and then by
(lang, source, term). These partial counts are merged by Spark, (lang, term) a shard's key, and the merged
columns are cut into shards of bounded size, in which Arrow and numpy sum the divergences of all pairs of sources.

Every language keeps the terms that occur in at least three of its documents (V of them). A term's share of a
group is p = 1 + floor(10^9 (count + 1) / (N + V)), N being the group's occurrences of kept terms; the divergence of
p from q is floor((p - q)^2 / q). All arithmetic is in whole numbers.

Null texts, languages and sources are empty strings. Every row counts as a document, also one whose id
occurs before. A language without kept terms has divergences of zero between its sources; a language of one source
has no pairs. Ties of value are ranked by the bytes of the item. An empty table gives an empty result. Columns
besides text, lang and source are not read.

Bounds: a unit of work holds about SHARD counts of at most twice BLOCK sources, whatever the number of
terms, sources or rows. The pairs of sources are the result itself and grow with the square of a language's sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Everything but letters: ASCII other than A-Z and a-z.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Bytes of text that a task takes apart at once, and partial counts that it holds.
PORTION, HELD = 4 << 20, 1 << 18
#: Counts of one shard, sources of one block, cells of one matrix.
SHARD, BLOCK, CELLS = 1 << 16, 128, 1 << 20
SALTS = 8


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about PORTION bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // PORTION)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of some documents; each group also has a row of the empty term."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), GAP)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    full = pc.not_equal(term, "")
    told = term.filter(full).dictionary_encode()
    each = pa.table({"row": row.filter(full), "code": told.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    at = each["row"]
    summed = (
        pa.table({"lang": lang.indices.take(at), "source": source.indices.take(at), "code": each["code"], "n": each["count_all"]})
        .group_by(["lang", "source", "code"])
        .aggregate([("n", "sum"), ("n", "count")])
    )
    here = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"]).aggregate([])
    none = pa.array(np.zeros(here.num_rows, np.int64))
    counts = pa.table(
        {"lang": lang.dictionary.take(summed["lang"]), "source": source.dictionary.take(summed["source"]), "term": told.dictionary.take(summed["code"]), "n": summed["n_sum"], "docs": summed["n_count"]}
    )
    marks = pa.table(
        {"lang": lang.dictionary.take(here["lang"]), "source": source.dictionary.take(here["source"]), "term": pa.array([""] * here.num_rows, pa.string()), "n": none, "docs": none}
    )
    return pa.concat_tables([counts, marks])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, merged while they are few; beyond HELD rows they go on to the shuffle."""
    held: list[pa.Table] = []
    for portion in _portions(batches):
        held.append(_counted(portion))
        if sum(t.num_rows for t in held) > HELD:
            held = [_merged(held)]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def _merged(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks()


def counts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n, all_n of the kept terms, all_n over the language; the empty term stands for every group."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    partial = documents.select(text, lang, source).mapInArrow(_partials, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle: a term's sources meet in one place, already counted
    summed = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = summed.select("lang", "term", "source", "n", F.sum("n").over(term).alias("all_n"), F.sum("docs").over(term).alias("all_docs"))
    return known.filter((F.col("term") == "") | (F.col("all_docs") >= least)).drop("all_docs")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)), null for no terms at all; exact for counts of any size."""
    whole = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(19,0))"
    return F.expr(f"1 + {whole} div CAST(nullif({total} + {kept}, 0) AS DECIMAL(20,0))")


def groups(kept: DataFrame) -> DataFrame:
    """A row for each (lang, source): total, terms and lang_total, its share of a term that it lacks, its block, the shards of its language."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    terms = kept.filter("term != ''").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("rows").alias("lang_rows"), F.count("*").alias("sources"))
    # a language may have most of the sources, but a row for each source is small
    named = own.join(whole.join(terms, "lang", "left").withColumn("terms", F.coalesce("v", F.lit(0))), "lang")
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    return named.select(
        "lang", "source", "total", "lang_total", "terms", share("0", "total", "terms").alias("p0"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), F.ceil(F.col("lang_rows") / SHARD).cast("int").alias("shards"),
    )


def _pairs(unit: pa.Table) -> pa.Table:
    """Sums of one shard for every pair of its sources, both ways; each block of a unit of two only with the other."""
    unit = unit.combine_chunks()
    is_head = pc.equal(unit["term"], "")
    head, body = unit.filter(is_head), unit.filter(pc.invert(is_head))
    names, p0 = head["source"].combine_chunks(), head["p"].to_numpy()
    block, n = head["block"].to_numpy(), len(head)
    i, j = unit["i"][0].as_py(), unit["j"][0].as_py()
    # what all terms would give if no source had any; one shard of a language says it
    zero = (p0[:, None] - p0[None, :]) ** 2 // p0[None, :]
    sums = zero * head["base"].to_numpy()[:, None]
    at = pc.index_in(body["source"], value_set=names).to_numpy()
    column, width = np.zeros(0, np.int64), 0
    if len(body):
        code = body["term"].combine_chunks().dictionary_encode()
        column, width = code.indices.to_numpy(), len(code.dictionary)
    order = np.argsort(column, kind="stable")
    at, column, p = at[order], column[order], body["p"].to_numpy()[order]
    step = max(1, CELLS // max(1, n))
    for lo in range(0, width, step):
        hi = min(width, lo + step)
        a, b = np.searchsorted(column, [lo, hi])
        part = np.repeat(p0[:, None], hi - lo, axis=1)
        part[at[a:b], column[a:b] - lo] = p[a:b]
        for g in range(n):
            sums[g] += ((part[g] - part) ** 2 // part).sum(1) - (hi - lo) * zero[g]
    wanted = ~np.eye(n, dtype=bool) if i == j else block[:, None] != block[None, :]
    g, h = np.nonzero(wanted)
    lang = pa.array([unit["lang"][0].as_py()] * len(g), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "value": sums[g, h]})


def pairs(shares: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language."""
    body = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "source", "block", "blocks", "p", F.lit(0).cast("bigint").alias("base"))
    shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    # without any term the shares do not matter: all are one
    head = known.select("lang", shard, "source", "block", "blocks", F.coalesce("p0", F.lit(1)).alias("p"), "terms").select(
        "lang", "shard", F.lit("").alias("term"), "source", "block", "blocks", "p", F.when(F.col("shard") == 0, F.col("terms")).otherwise(0).cast("bigint").alias("base")
    )
    rows = body.unionByName(head).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shard", "term", "source", "block", "p", "base")
    parts = units.groupBy("lang", "i", "j", "shard").applyInArrow(_pairs, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(found: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Ranks within (lang, source); with a top, tasks keep only that many rows of a group before they are sorted together."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rows = found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return rows if top is None else rows.filter(F.col("rank") <= top)


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows against every other source, `term` rows for telling terms."""
    kept = materialize(counts(documents, least), "divergence-counts")
    known = materialize(groups(kept), "divergence-groups")
    # the counts of one large source are spread over salts; few groups are broadcast by Spark's own check of their size
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.filter("term != ''").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    shares = rows.select("lang", "source", "term", "block", "blocks", "shards", share("n", "total", "terms").alias("p"), share("all_n", "lang_total", "terms").alias("q"))
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(pairs(shares, known), "pair").unionByName(ranked(terms, "term", top))
