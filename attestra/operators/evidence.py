"""What a case shows of its evidence: four views of growing detail, and cards from which provisional answers are deleted.

Views are JSON texts with sorted names. Deleting names at any depth is an expression over the tokens of a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .gate import canonical

#: Strings, brackets and colons, and what stands between them; commas are set anew.
_TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:]|[^{}\[\]:,"\s]+)'
#: Views that a card shows, in this order. Fixed values.
SHOWN = ("names_only", "context", "structure", "full")
#: Names of columns that a compact structure lists of a table, and of a sheet. Fixed values.
MOST_NAMES, MOST_SHEET_NAMES = 80, 40
WITHHELD = "withheld_until_reparse"


def without_keys(document: Column, keys: Sequence[str] = V.PROVISIONAL_KEYS) -> Column:
    """A JSON text without these names and what they hold, at any depth, names sorted; null for what is no JSON.

    Meant for documents of a case: work grows with the square of the number of tokens of one text.
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(document)), F.lit(_TOKEN), 1)
    named = F.array(*[F.lit(f'"{k}"') for k in keys])
    each = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t, after: F.struct(t.alias("t"), after.alias("after")))
    # skip: the depth at which the value of a deleted name ends; -1 if nothing is being left out
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        t, skipping = x["t"], acc["skip"] >= 0
        opens = t.isin("{", "[")
        depth = acc["depth"] + F.when(opens, 1).when(t.isin("}", "]"), -1).otherwise(0)
        ends = skipping & (t != ":") & ~opens & (depth == acc["skip"])
        starts = ~skipping & x["after"].eqNullSafe(":") & F.array_contains(named, t)
        kept = ~skipping & ~starts
        return F.struct(
            depth.alias("depth"), F.when(starts, acc["depth"]).when(ends, -1).otherwise(acc["skip"]).alias("skip"), F.when(kept, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out")
        )

    def written(out: Column) -> Column:
        after = F.slice(out, 2, F.greatest(F.size(out), F.lit(1)))
        comma = lambda t, n: ~t.isin("{", "[", ":") & n.isNotNull() & ~n.isin("}", "]", ":")
        return F.array_join(F.zip_with(out, after, lambda t, n: F.concat(t, F.when(comma(t, n), ",").otherwise(""))), "")

    return F.aggregate(each, start, step, lambda acc: written(acc["out"]))


def compact_structure(structure: Column) -> Column:
    """JSON of a file card's structure: one table with at most 80 names, or its sheets with at most 40 each."""
    table = F.get(structure, F.lit(0))
    names = lambda t, most: F.slice(t["column_names"], 1, most)
    alone = canonical(("rows", table["rows"]), ("columns", table["columns"]), ("column_names", names(table, MOST_NAMES)))
    sheets = F.transform(structure, lambda s: F.struct(names(s, MOST_SHEET_NAMES).alias("column_names"), s["columns"].alias("columns"), s["rows"].alias("rows"), s["sheet_name"].alias("sheet_name")))
    return F.when(table["sheet_name"].isNull(), alone).otherwise(F.to_json(F.struct(sheets.alias("sheets"))))


def _nested(text: Column, name: str, json: Column) -> Column:
    """A JSON object with one more member that is JSON itself, in the order of names."""
    return F.to_json(F.parse_json(F.concat(F.regexp_replace(text, r"\}$", ""), F.when(text == "{}", "").otherwise(","), F.lit(f'"{name}":'), json, F.lit("}"))))


def file_views(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Cases of files with evidence_views; facts: artifact_id, artifact_name, path_context, component_hints, structure (JSON), lineage_family, validity_status.

    A case whose parser failed shows its name only, and that the structure is withheld.
    """
    rows = cases.join(facts.withColumnRenamed("artifact_id", "base_artifact"), "base_artifact")
    failed = F.col("parser_status") == "injected_parser_failure"
    base = [("artifact_name", F.col("artifact_name")), ("path_context", F.col("path_context")), ("proposed_primary_role", F.col("proposal")), ("parser_status", F.when(failed, F.col("parser_status")).otherwise("not_yet_requested"))]
    whole = canonical(*base)
    structure = F.when(failed, F.lit(f'"{WITHHELD}"')).otherwise(F.col("structure"))
    views = {
        "names_only": F.when(failed, whole).otherwise(canonical(*base[:1], base[2])),
        "context": F.when(failed, whole).otherwise(canonical(*base, ("component_hints", F.col("component_hints")))),
        "structure": _nested(whole, "structure", structure),
        "full": _nested(F.when(failed, whole).otherwise(canonical(*base, ("lineage_family", F.col("lineage_family")), ("validity_status", F.col("validity_status")))), "structure", structure),
    }
    return rows.select(*cases.columns, F.struct(*[v.alias(k) for k, v in views.items()]).alias("evidence_views"))


def column_views(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Cases of columns with evidence_views; facts: base_artifact, case key columns, artifact_name, column_name, sheet_name, parent_primary_role, component_roles, signature (JSON)."""
    rows = cases.join(facts, "case_id")
    base = [(c, F.col(c)) for c in ("artifact_name", "column_name", "sheet_name", "parent_primary_role")] + [("proposed_concept", F.col("proposal"))]
    views = {
        "names_only": canonical(base[1], base[4]),
        "context": canonical(*base, ("parent_component_roles", F.col("component_roles"))),
        "value_signature": _nested(canonical(*base), "value_signature", F.col("signature")),
        "full": _nested(canonical(*base), "value_signature", F.col("signature")),
    }
    return rows.select(*cases.columns, F.struct(*[v.alias(k) for k, v in views.items()]).alias("evidence_views"))


def card(cases: DataFrame, tools: Column, interface: str = "hidden") -> Column:
    """JSON that a predictor sees: tools, the observation (the context view) and the views, without provisional answers.

    With any other interface than `hidden` the proposal is shown beside them, to be reviewed.
    """
    if interface not in V.INTERFACES:
        raise ValueError(f"unknown interface {interface}")
    there = [v for v in SHOWN if v in cases.schema["evidence_views"].dataType.names]
    view = lambda v: without_keys(F.col(f"evidence_views.{v}"))
    shown = F.concat_ws(",", *[F.concat(F.lit(f'"{v}":'), view(v)) for v in there])
    parts = [F.concat(F.lit('"available_tools":'), F.to_json(F.array_sort(tools))), F.concat(F.lit('"initial_observation":'), view("context"))]
    if interface != "hidden":
        name = F.when(F.col("task") == "T-FILE", "primary_role").when(F.col("task") == "T-COL", "concept")
        parts.append(F.concat(F.lit('"proposal_under_review":{"'), name, F.lit('":"'), F.col("proposal"), F.lit('"}')))
    parts.append(F.concat(F.lit('"views":{'), shown, F.lit("}")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
