"""Privacy-safe value signatures: aggregates only, and for identifier-like columns no values at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalar as S
from . import ranks

NUMERIC_SHARE, MOST_CATEGORIES, LONGEST_CATEGORY, MASKS = 0.95, 20, 80, 8
QUARTERS = (1, 2, 3)
#: Children of a node of the tree that a column's fingerprint is the root of.
FAN = 256


def _present(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    null = F.col(name).isNull()
    return ~(null | F.isnan(name)) if isinstance(kind, T.DoubleType | T.FloatType) else ~null


def _text(df: DataFrame, name: str) -> Column:
    """Trimmed text of a value; doubles through output_number, so that engines agree."""
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        return S.output_number(F.col(name).cast("double"))
    return F.trim(F.col(name).cast("string"))


def _unpivoted(df: DataFrame, columns: list[str], value: Callable[[str], Column]) -> DataFrame:
    """(column_name, v) of all columns, in one pass over the table."""
    each = [F.struct(F.lit(c).alias("column_name"), value(c).alias("v")) for c in columns]
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.column_name", "x.v")


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: n, missing, distinct values, identifier-likeness. One pass over the table.

    Values are counted where they stand before they are shuffled by column and value, so that a column of few
    values moves few rows; then each column's distinct values are counted, in parts.
    """
    def value(c: str) -> Column:
        # adding nothing makes one of the two zeros
        typed = F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType) else F.col(c)
        return F.when(_present(df, c), typed.cast("string"))

    each = _unpivoted(df, columns, value).groupBy("column_name", "v").agg(F.count("*").alias("times"))
    found = each.groupBy("column_name").agg(F.sum("times").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("times"))), F.lit(0)).alias("missing_n"), F.count("v").alias("unique_n"))
    facts = [(c, df.schema[c].dataType.simpleString()) for c in columns]
    named = df.sparkSession.createDataFrame(facts, "column_name string, dtype string")
    found = named.join(F.broadcast(found), "column_name", "left").fillna(0)  # a row for each column
    share = F.coalesce(F.try_divide("missing_n", "n"), F.lit(0.0))
    return found.select("column_name", "dtype", "n", "missing_n", share.alias("missing_fraction"), "unique_n", S.is_identifier_name("column_name").alias("is_identifier_like"))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values that are numbers and, if it reaches 0.95, their summary; one row a column, one pass over the table.

    Equal values are counted first. A quartile lies at a rank, or between two: the values in whose run of equals these
    ranks fall are picked by running counts over ranges of values, so that no state holds a column's values.
    """
    def value(c: str) -> Column:
        numbers = F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else S.as_number(c)
        return F.when(_present(df, c), F.struct(numbers.alias("x")))

    each = _unpivoted(df, columns, value).filter("v IS NOT NULL").select("column_name", F.col("v.x").alias("x"))
    each = ranks.placed(each.groupBy("column_name", "x").agg(F.count("*").alias("times")), ["x"], ["column_name"])
    x, times = F.col("x"), F.col("times")
    one = each.groupBy("column_name").agg(
        F.sum("times").alias("present_n"), F.coalesce(F.sum(F.when(x.isNotNull(), times)), F.lit(0)).alias("numbers"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.try_divide(F.sum(x * times), F.sum(F.when(x.isNotNull(), times))).alias("mean"),
    )
    whole = F.broadcast(one.select("column_name", "mean", "numbers"))  # a row for each column
    # deviations from the mean itself, so that large numbers keep their digits
    spread = each.join(whole, "column_name").groupBy("column_name")
    spread = spread.agg(F.sqrt(F.try_divide(F.sum((x - F.col("mean")) * (x - F.col("mean")) * times), F.nullif(F.max("numbers") - 1, F.lit(0)))).alias("std"))
    ranked = ranks.before(each.filter("x IS NOT NULL"), ["x"], times, ["column_name"]).join(whole, "column_name")
    last = F.col("numbers") - 1
    holds = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + times), x))
    at = {k: holds(F.floor(last * k / 4)) for k in QUARTERS} | {-k: holds(F.ceil(last * k / 4)) for k in QUARTERS}
    picked = ranked.groupBy("column_name").agg(*[v.alias(f"q{k}") for k, v in at.items()])
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    found = one.join(spread, "column_name", "left").join(picked, "column_name", "left")
    found = named.join(F.broadcast(found), "column_name", "left").fillna(0, ["present_n", "numbers"])
    found = found.withColumn("numeric_fraction", F.coalesce(F.try_divide("numbers", "present_n"), F.lit(0.0)))
    enough = F.col("numeric_fraction") >= NUMERIC_SHARE
    between = {k: F.col(f"q{k}") + (F.col(f"q-{k}") - F.col(f"q{k}")) * (last * k / 4 - F.floor(last * k / 4)) for k in QUARTERS}
    shown = {"min": F.col("min"), "q25": between[1], "median": between[2], "q75": between[3], "max": F.col("max"), "mean": F.col("mean"), "std": F.coalesce("std", F.lit(0.0))}
    return found.select("column_name", "present_n", "numeric_fraction", *[F.when(enough, c).alias(k) for k, c in shown.items()])


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, category, n) of columns with few, short values; identifier-like names give none."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("category")) for c in columns])).alias("v")
    found = df.select(each).select("v.*").filter("category IS NOT NULL").groupBy("column_name", "category").agg(F.count("*").alias("n"))
    whole = found.groupBy("column_name").agg(F.count("*").alias("kinds"), F.max(F.char_length("category")).alias("longest"))
    fit = whole.filter((F.col("kinds") <= MOST_CATEGORIES) & (F.col("longest") <= LONGEST_CATEGORY) & ~S.is_identifier_name("column_name"))
    return found.join(fit.select("column_name"), "column_name", "left_semi")


def identifier_shape(df: DataFrame, name: str) -> DataFrame:
    """(kind, shape, n): lengths of an identifier's texts, and its eight commonest format masks. No values."""
    text = df.filter(_present(df, name)).select(_text(df, name).alias("t"))
    lengths = text.groupBy(F.char_length("t").alias("l")).agg(F.count("*").alias("n"))
    lengths = lengths.select(F.lit("length").alias("kind"), F.col("l").cast("string").alias("shape"), "n")
    masks = text.groupBy(S.format_mask("t").alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(MASKS)
    return lengths.unionByName(masks.select(F.lit("mask").alias("kind"), "shape", "n"))


def unique_fraction(df: DataFrame, name: str) -> DataFrame:
    text = F.when(_present(df, name), _text(df, name))
    return df.agg(F.count(text).alias("present_n"), F.count_distinct(text).alias("unique_n")).select(
        F.lit(name).alias("column_name"), "present_n", "unique_n", F.coalesce(F.try_divide("unique_n", "present_n"), F.lit(0.0)).alias("unique_fraction")
    )


def fingerprints(df: DataFrame, columns: list[str], order: str, fan: int = FAN) -> DataFrame:
    """(column_name, fingerprint) of all columns in one pass: the root of a tree of digests over a column's values in order.

    A leaf is the digest of a value and how often it stands at a place of the order, values of one place by their text; a
    node is the digest of up to `fan` children, level by level until one is left. This is the definition for every
    size. What meets in one place are the digests of `fan` children.
    """
    def value(c: str) -> Column:
        return F.when(_present(df, c), _text(df, c)).otherwise("<NA>")

    each = [F.struct(F.lit(c).alias("column_name"), value(c).alias("v")) for c in columns]
    rows = df.select(F.col(order).alias("at"), F.explode(F.array(*each)).alias("x")).select("x.column_name", "at", "x.v")
    runs = ranks.placed(rows.groupBy("column_name", "at", "v").agg(F.count("*").alias("times")), ["at", "v"], ["column_name"])
    leaves = ranks.before(runs, ["at", "v"], by=["column_name"], name="p")
    nodes = leaves.select("column_name", "p", F.sha2(F.concat("v", F.lit("\t"), F.col("times").cast("string")), 256).alias("h"))
    n = runs.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"])
        above = nodes.groupBy("column_name", F.floor(F.col("p") / fan).alias("q")).agg(children.alias("c"), F.max("p").alias("most"))
        # a column that has come to its root keeps it
        nodes = above.select("column_name", F.col("q").alias("p"), F.when((F.col("q") == 0) & (F.col("most") == 0), F.get("c", F.lit(0))).otherwise(F.sha2(F.array_join("c", ""), 256)).alias("h"))
        n = -(-n // fan)
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    root = F.coalesce("h", F.sha2(F.lit("").cast("binary"), 256))  # of no rows
    return named.join(F.broadcast(nodes), "column_name", "left").select("column_name", F.substring(F.sha2(F.concat("column_name", F.lit("\n"), root), 256), 1, 24).alias("fingerprint"))


def fingerprint(df: DataFrame, name: str, order: str, fan: int = FAN) -> DataFrame:
    return fingerprints(df, [name], order, fan)


def existing_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that are there, and those that aren't."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def signature(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """One row a column with its counts and, unless identifier-like, its numeric summary; with an order, its fingerprint."""
    base = counts(df, columns)
    if order is not None:
        base = base.join(fingerprints(df, columns, order), "column_name")
    plain = [r["c"] for r in df.sparkSession.createDataFrame([(c,) for c in columns], "c string").filter(~S.is_identifier_name("c")).collect()]
    if not plain:
        return base
    return base.join(numeric(df, plain).drop("present_n"), "column_name", "left")


def missing_required(required: Column, names: Column) -> Column:
    """Headers that a reference sheet must have and doesn't."""
    return F.array_except(required, names)


def integrity(cards: DataFrame, files: DataFrame) -> DataFrame:
    """Stored against recomputed hashes: match, mismatch or missing; cards (artifact_id, path, sha256), files (path, sha256)."""
    now = files.select("path", F.col("sha256").alias("now"))
    return cards.join(now, "path", "left").select(
        "artifact_id", "path", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "match").otherwise("mismatch").alias("status")
    )


def resolve_column_cards(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """The card of each (artifact_id, column_name), with its state: resolved, missing or ambiguous."""
    n = F.count("*").over(Window.partitionBy("artifact_id", "column_name"))
    found = cards.select("*", n.alias("__n")).groupBy("artifact_id", "column_name").agg(F.max("__n").alias("n"), F.min("card_id").alias("card_id"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return requests.join(found, ["artifact_id", "column_name"], "left").select(
        "artifact_id", "column_name", state.alias("state"), F.when(F.col("n") == 1, F.col("card_id")).alias("card_id")
    )


def column_cards(artifact: str, study: str, sheets: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """(card_id, artifact_id, study, sheet, column_name, concept, signature columns) of the wanted columns of each sheet.

    One pass over each sheet; identifier-like columns show counts only, and no card shows a value.
    """
    out = None
    for sheet, df in sheets.items():
        wanted = [c for c in (columns or df.columns) if c in df.columns]
        facts, numbers = counts(df, wanted), numeric(df, wanted).select("column_name", "numeric_fraction")
        one = facts.join(F.broadcast(numbers), "column_name").select(
            F.concat(F.lit(f"column:{artifact}:"), S.stable_digest(F.concat(F.lit(f"{sheet}:"), "column_name"))).alias("card_id"), F.lit(artifact).alias("artifact_id"), F.lit(study).alias("study"),
            F.lit(sheet).alias("sheet"), "column_name", S.infer_column_concept("column_name").alias("concept"), "dtype", "n", "missing_n", "unique_n", "numeric_fraction", "is_identifier_like",
        )
        out = one if out is None else out.unionByName(one)
    return out


def reference_cards(dictionary: DataFrame, artifact: str, study: str, scope: str) -> DataFrame:
    """(card_id, artifact_id, study, reference_scope, variable, verified_fields) of a dictionary (variable, code, meaning).

    Each variable's codes are one text, in their order: the codes of a dictionary are few by their nature.
    """
    pairs = F.transform(F.array_sort(F.collect_set(F.struct("code", "meaning"))), lambda p: F.concat(p["code"], F.lit("="), p["meaning"]))
    return dictionary.groupBy("variable").agg(pairs.alias("__p")).select(
        F.concat(F.lit(f"reference:{artifact}:"), S.stable_digest("variable")).alias("card_id"), F.lit(artifact).alias("artifact_id"), F.lit(study).alias("study"), F.lit(scope).alias("reference_scope"),
        "variable", F.concat("variable", F.lit(":"), F.array_join("__p", ",")).alias("verified_fields"),
    )
