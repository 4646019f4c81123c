"""Column functions of the audit: identifiers, digests, lenient numbers, names and codes.

All are built-in expressions; nulls are handled as each docstring says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return any_of(*[text.contains(w) for w in words])


def first_match(rules: list[tuple[Column, str]], otherwise: str | Column) -> Column:
    """One CASE: the value of the first rule that holds."""
    whens = reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return whens.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def normalized_identifier(c: Column | str) -> Column:
    """Upper case, letters and digits only, no leading zeros if all digits; null is empty."""
    text = F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), "[^A-Z0-9]", "")
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)


def stable_digest(c: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, length)


def case_id(*parts: Column | str) -> Column:
    """24 hexadecimal digits of the parts joined by bars."""
    return stable_digest(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 24)


def stable_seed(case: Column | str, run: int) -> Column:
    """A 32-bit number of the case and the run."""
    text = F.concat(col(case).cast("string"), F.lit(f":{run}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def masked_key(study: str, identifier: Column | str, salt: str) -> Column:
    """Study and a salted digest of the normalised identifier; an empty identifier is an error."""
    norm = normalized_identifier(identifier)
    checked = F.when(norm == "", F.raise_error(F.lit("empty subject identifier"))).otherwise(norm)
    text = F.concat_ws("|", F.lit(salt), F.lit(study), checked)
    return F.concat(F.lit(study.lower() + "_"), F.substring(F.sha2(text, 256), 1, 20))


def as_number(c: Column | str) -> Column:
    """A double where the trimmed text is a plain number, else null."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def output_number(c: Column | str) -> Column:
    """Null is empty, whole numbers have no fraction, others six decimals at most."""
    x = col(c)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(""))
        .when(whole, x.cast("bigint").cast("string"))
        .otherwise(F.round(x, 6).cast("string"))
    )


def canonical_code(c: Column | str, codes: dict[str, str]) -> Column:
    """The meaning of a code; UNRESOLVED:<text> where the map has none, empty for null."""
    text = F.trim(col(c).cast("string"))
    return first_match([(text.isNull() | (text == ""), "")] + [(text == k, v) for k, v in codes.items()], F.concat(F.lit("UNRESOLVED:"), text))


def same_value(left: Column, right: Column, kind: str, codes: dict[str, str] | None = None) -> Column:
    """Ages agree within 1e-9 or by both missing, codes after canonicalisation."""
    if kind == "age":
        a, b = as_number(left), as_number(right)
        return F.coalesce(F.abs(a - b) <= 1e-9, a.isNull() & b.isNull())
    return canonical_code(left, codes or {}).eqNullSafe(canonical_code(right, codes or {}))


def name_tokens(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def compact_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


# fixed values: what names of identifiers consist of
_ID_WORDS = "id|ursi|subject|subj|patient|participant|visit|site|experiment|segment|assessment|asmt|doi|usrd"
_ID_NAMES = ("id", "doi", "ursi", "usrd", "subjectid", "subjid", "patientid", "participantid")
_ID_STARTS = ("subject", "subj", "patient", "participant", "visit", "site", "experiment", "segment", "assessment", "asmt")


def is_identifier_name(c: Column | str) -> Column:
    """Does a name speak of an identifier: by a whole word, by its compact form, or by start and end."""
    name, compact = col(c), compact_name(c)
    word = F.lower(F.replace(name, F.lit("_"), F.lit(" "))).rlike(f"(^|[^a-z])({_ID_WORDS})([^a-z]|$)")
    return word | compact.isin(*_ID_NAMES) | (compact.endswith("id") & any_of(*[compact.startswith(p) for p in _ID_STARTS]))


def format_mask(c: Column | str) -> Column:
    """Digits as #, lower-case letters as a, upper-case as A."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A")


# fixed values: the families of file names, in the order in which one wins
_ROLE_WORDS = (
    ("medication", (" medication ", " med ", "cpz", "antipsychotic", "dose")),
    ("clinical_scale", ("panss", "delusions", "clinical", "calgary")),
    ("cognitive", ("cognitive", "working memory", "wasi", "wtar", "cminds")),
    ("diagnosis_or_labels", ("diagnosis", " dx ", "subject type")),
    ("demographics", ("demographic", " age ", " gender ", " sex ")),
)
_DICTIONARY_WORDS = ("dictionary", "codebook", "valid values", "field name")


def infer_file_role(name: Column | str, columns: Column | None = None, sheets: Column | None = None) -> Column:
    """Role of a file by the words of its name, its sheets and its first 120 columns."""
    none = F.array().cast("array<string>")
    columns, sheets = F.coalesce(columns if columns is not None else none, none), F.coalesce(sheets if sheets is not None else none, none)
    token = name_tokens(name)
    clean = lambda a: F.transform(a, name_tokens)
    joined = F.array_join(F.concat(F.array(token), clean(sheets), F.slice(clean(columns), 1, 120)), " ")
    hits = [F.when(holds_any(joined, words), F.lit(role)) for role, words in _ROLE_WORDS]
    found = F.array_compact(F.array(*hits))
    dictionary = holds_any(joined, _DICTIONARY_WORDS)
    return first_match(
        [
            (holds_any(token, ("dictionary", "codebook")), "dictionary_or_codebook"),
            (dictionary & (F.size(found) == 0), "dictionary_or_codebook"),
            ((F.size(found) >= 2) | (F.size(sheets) >= 3), "mixed"),
        ],
        F.when(F.size(found) == 1, F.get(found, F.lit(0)))
        .when(holds_any(joined, ("subjectid", "subject id", "subjid", "ursi")), "subject_list")
        .otherwise("unknown"),
    )


def infer_column_concept(name: Column | str) -> Column:
    """Concept of a column by its name; the rules are tried in this order."""
    c, spaced = compact_name(name), name_tokens(name)
    has = lambda *w: holds_any(c, w)
    panss = has("panss")
    # fixed values
    rules = [
        (has("subjectid", "subjid", "ursi", "anonymizedid") | c.isin("id", "doi", "usrd"), "subject_identifier"),
        (has("siteid") | (c == "site"), "site_identifier"),
        (has("visitid") | (c == "visit"), "visit_identifier"),
        (has("experimentid"), "experiment_identifier"),
        (has("assessmentid", "asmtid", "segmentid", "instrumentid"), "assessment_identifier"),
        (has("diagnos") | (c == "dx"), "diagnosis"),
        (has("gender") | (c == "sex") | F.array_contains(F.split(spaced, " "), "sex"), "sex_or_gender"),
        (has("ageonset", "ageatfirst") | (c == "ao"), "age_at_onset"),
        (has("age"), "current_age"),
        (panss & has("tot"), "panss_total"),
        (panss & has("pos"), "panss_positive"),
        (panss & has("neg"), "panss_negative"),
        (c.isin("delusions", "hallucinatorybehavior", "bluntedaffect", "poorattention", "conceptualdisorganization") | has("npanss"), "panss_item"),
        (has("drug", "medication"), "medication_name"),
        (has("dose") | c.endswith("mg"), "medication_dose"),
        (c.isin("cpz", "cpz1", "cpz2"), "cpz_candidate"),
        (has("cognitive", "workingmemory", "speedofprocessing", "attentionvigilance", "cmindscomposite", "wtar", "wasi", "iq"), "cognitive_domain"),
        (c == "positive", "panss_positive"),
        (c == "negative", "panss_negative"),
    ]
    return first_match(rules, "unknown_or_study_specific")


def redacted_locator(c: Column | str, root: str, scheme: str = "source:") -> Column:
    """A path below the root under a scheme name; other paths as they are."""
    return F.when(col(c).startswith(root), F.concat(F.lit(scheme), F.substring(col(c), len(root) + 1, 1 << 30))).otherwise(col(c))


def code_text(codes: Column | str) -> Column:
    """Text of an array of code points; zeros are padding."""
    return F.array_join(F.transform(F.filter(col(codes), lambda x: x != 0), lambda x: F.chr(x.cast("bigint"))), "")


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty text, list, object, false or zero."""
    void = ("", "[]", "{}", "false", "0", "null")
    return F.coalesce(*[F.when(~c.isin(*void), c) for c in columns])


def label_or_missing(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("__missing__"))


def is_case(diagnosis: Column | str) -> Column:
    return F.coalesce((col(diagnosis) == 1).cast("int"), F.lit(0))


def fraction_text(part: Column, whole: Column) -> Column:
    return F.format_string("%d/%d", part, whole)


def finite_vector(c: Column | str) -> Column:
    """No null, NaN or infinite entry."""
    return ~F.exists(col(c), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def field_lookup(fields: Column, exact: str, prefix: str) -> Column:
    """The header of that name, or the first with the prefix."""
    return F.coalesce(F.get(F.filter(fields, lambda f: f == exact), F.lit(0)), F.get(F.filter(fields, lambda f: f.startswith(prefix)), F.lit(0)))




def safe_scalar(c: Column | str, kind: str) -> Column:
    """A value that JSON can hold: numbers that are none become null, times ISO text; kind is the column's type name."""
    v = col(c)
    if kind in ("double", "float"):
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    if kind.startswith("timestamp"):
        return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    return v


def attribute_text(c: Column | str) -> Column:
    """Attribute bytes as text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(col(c).cast("string"))


def envelope(action: Column, label: Column, repair: Column, tools: Column, unresolved: Column | None = None) -> Column:
    """A decision as one struct: lists that are null count as empty."""
    none = F.array().cast("array<string>")
    return F.struct(
        action.alias("action"), F.coalesce(tools, none).alias("evidence_tools"), label.alias("label"), repair.alias("repair"), (F.coalesce(unresolved, none) if unresolved is not None else none).alias("unresolved")
    )
