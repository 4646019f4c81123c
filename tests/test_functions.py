import pytest
from pyspark.sql import functions as F

from attestra.functions import scalar as S
from attestra.functions import vocabulary as V


def one(spark, column, **values):
    kinds = {int: "bigint", float: "double", str: "string"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds.get(type(v), "string")).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("000-123", "123"), ("ab_1", "AB1"), (None, ""), ("000", "0"), ("é1", "1")])
def test_normalized_identifier(spark, raw, want):
    assert one(spark, S.normalized_identifier("x"), x=raw) == want


@pytest.mark.parametrize(("name", "want"), [("SubjectID", True), ("visit_date", True), ("siteid", True), ("height", False), ("idea", False), ("doi", True)])
def test_identifier_names(spark, name, want):
    assert one(spark, S.is_identifier_name("x"), x=name) is want


@pytest.mark.parametrize(
    ("name", "want"),
    [("SubjID", "subject_identifier"), ("usage", "current_age"), ("Age_Onset", "age_at_onset"), ("PANSS_Total", "panss_total"), ("dose mg", "medication_dose"), ("positive", "panss_positive"), ("x", "unknown_or_study_specific"), ("my sex", "sex_or_gender")],
)
def test_concepts_in_order(spark, name, want):
    assert one(spark, S.infer_column_concept("x"), x=name) == want
    assert want in V.COLUMN_CONCEPTS


@pytest.mark.parametrize(("name", "want"), [("codebook v2", "dictionary_or_codebook"), ("panss scores", "clinical_scale"), ("panss and cpz", "mixed"), ("ursi list", "subject_list"), ("foo", "unknown")])
def test_roles(spark, name, want):
    assert one(spark, S.infer_file_role("x"), x=name) == want


@pytest.mark.parametrize(("text", "want"), [(" 1.5 ", 1.5), ("1e3", 1000.0), ("1d", None), ("1_000", None), ("", None), (None, None)])
def test_lenient_numbers(spark, text, want):
    assert one(spark, S.as_number("x"), x=text) == want


def test_codes_numbers_and_keys(spark):
    assert one(spark, S.canonical_code("x", V.SEX_CODES), x="1") == "male"
    assert one(spark, S.canonical_code("x", V.SEX_CODES), x="9") == "UNRESOLVED:9"
    assert one(spark, S.output_number("x"), x=3.0) == "3"
    assert one(spark, S.masked_key("ALPHA", "x", "s"), x="01").startswith("alpha_")
    with pytest.raises(Exception, match="empty subject identifier"):
        one(spark, S.masked_key("ALPHA", "x", "s"), x="--")
    assert one(spark, S.same_value(F.col("x"), F.col("y"), "age"), x="1.0", y="1") is True
    assert one(spark, S.same_value(F.col("x"), F.col("y"), "age"), x=None, y=None) is True
    assert one(spark, S.format_mask("x"), x="aB-19é") == "aA-##é"
    assert one(spark, S.redacted_locator("x", "/data/"), x="/data/a/b") == "source:a/b"
    assert spark.range(1).select(S.code_text(F.array(F.lit(72), F.lit(0), F.lit(105))).alias("r")).first()["r"] == "Hi"
    assert one(spark, S.first_truthy(F.col("x"), F.col("y")), x="[]", y="b") == "b"
