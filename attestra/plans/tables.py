"""Queries that profile, normalise and link the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import linkage, profile
from ..session import table
from .registry import query

_NUM = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
_ID_SQL = r"""(regexp_matches(lower(replace({c}, '_', ' ')), '(^|[^a-z])(id|ursi|subject|subj|patient|participant|visit|site|experiment|segment|assessment|asmt|doi|usrd)([^a-z]|$)')
 OR regexp_replace(lower({c}), '[^a-z0-9]', '', 'g') IN ('id', 'doi', 'ursi', 'usrd', 'subjectid', 'subjid', 'patientid', 'participantid')
 OR regexp_matches(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'), '^(subject|subj|patient|participant|visit|site|experiment|segment|assessment|asmt).*id$'))"""


def _norm(c: str) -> str:
    t = f"regexp_replace(upper(coalesce(({c})::VARCHAR, '')), '[^A-Z0-9]', '', 'g')"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]+$') THEN CASE WHEN ltrim({t}, '0') = '' THEN '0' ELSE ltrim({t}, '0') END ELSE {t} END"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing_n, (count(*) - count({c})) / count(*)::DOUBLE AS missing_fraction, count(DISTINCT {c}) AS unique_n, {_ID_SQL.format(c=repr(c))} AS is_identifier_like FROM lineitem"
    for c in [*_LINE, "l_returnflag", "l_linestatus", "l_shipdate"]
))
def profile_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.counts(table(spark, sf_dir, "lineitem"), [*_LINE, "l_returnflag", "l_linestatus", "l_shipdate"])
    return found.drop("dtype")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS present_n, 1.0::DOUBLE AS numeric_fraction, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max, round(avg(x), 5) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT {c}::DOUBLE AS x FROM lineitem)"
    for c in _LINE[3:]
))
def profile_numeric_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.numeric(table(spark, sf_dir, "lineitem"), _LINE[3:])
    # a mean of the taxes lies halfway between two numbers of six digits, where the last bit of a sum decides
    return _rounded(found.withColumn("mean", F.round("mean", 5)), "min", "q25", "median", "q75", "max", "std")


@query(f"""WITH v AS (SELECT CASE WHEN regexp_matches(trim(x), {_NUM}) THEN trim(x)::DOUBLE END AS x FROM (SELECT substr(o_orderpriority, 1, 1) AS x FROM orders WHERE o_orderpriority IS NOT NULL))
SELECT 'priority' AS column_name, count(*) AS present_n, avg((x IS NOT NULL)::INT)::DOUBLE AS numeric_fraction, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM v""")
def profile_numeric_text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("priority"))
    return _rounded(profile.numeric(rows, ["priority"]), "mean", "std")


_CATS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c}::VARCHAR AS category, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2) WHERE (SELECT count(DISTINCT {c}) <= 20 AND max(length({c}::VARCHAR)) <= 80 FROM orders)"
    for c in _CATS
))
def profile_categories_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categories(table(spark, sf_dir, "orders"), _CATS)


@query("""WITH t AS (SELECT trim(c_name) AS t FROM customer WHERE c_name IS NOT NULL)
SELECT 'length' AS kind, length(t)::VARCHAR AS shape, count(*) AS n FROM t GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'mask' AS kind, regexp_replace(regexp_replace(regexp_replace(t, '[0-9]', '#', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') AS shape, count(*) AS n FROM t GROUP BY 2 ORDER BY n DESC, shape LIMIT 8)""")
def profile_identifier_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.identifier_shape(table(spark, sf_dir, "customer"), "c_name")


@query("""WITH t AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(p_type || ' ' || p_brand), '[0-9]', '#', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') AS shape, length(trim(p_type || ' ' || p_brand)) AS l FROM part)
SELECT 'length' AS kind, l::VARCHAR AS shape, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'mask' AS kind, shape, count(*) AS n FROM t GROUP BY 2 ORDER BY n DESC, shape LIMIT 8)""")
def format_masks_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.identifier_shape(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("p")), "p")


@query("SELECT 'o_custkey' AS column_name, count(o_custkey) AS present_n, count(DISTINCT o_custkey) AS unique_n, count(DISTINCT o_custkey) / count(o_custkey)::DOUBLE AS unique_fraction FROM orders")
def unique_fraction_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unique_fraction(table(spark, sf_dir, "orders"), "o_custkey")


def _tree_sql(t: str, order: str, columns: dict[str, str], levels: int = 4) -> str:
    """The root of each column's tree of digests, 256 children a node; levels beyond the root leave it as it is."""
    runs = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {order} AS place, coalesce({v}, '<NA>') AS v, count(*) AS times FROM {t} GROUP BY 2, 3" for c, v in columns.items())
    parts = [f"l0 AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY place, v) - 1 AS p, sha256(v || chr(9) || times) AS h FROM ({runs}))"]
    for k in range(1, levels + 1):
        parts.append(f"l{k} AS (SELECT column_name, p // 256 AS p, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY column_name) AS n FROM l{k - 1}) GROUP BY column_name, p // 256)")
    return f"WITH {', '.join(parts)} SELECT column_name, substr(sha256(column_name || chr(10) || h), 1, 24) AS fingerprint FROM l{levels}"


@query(_tree_sql("customer", "c_custkey", {"c_name": "trim(c_name)"}))
def fingerprint_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fingerprint(table(spark, sf_dir, "customer"), "c_name", "c_custkey")


_LINE_TEXTS = {"l_returnflag": "trim(l_returnflag)", "l_partkey": "l_partkey::VARCHAR", "l_linenumber": "l_linenumber::VARCHAR"}


@query(_tree_sql("lineitem", "l_orderkey", _LINE_TEXTS))
def fingerprints_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns in one pass, in an order whose values repeat."""
    return profile.fingerprints(table(spark, sf_dir, "lineitem"), list(_LINE_TEXTS), "l_orderkey")


_SIGNED = {"o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "trim(o_orderstatus)", "o_orderpriority": "trim(o_orderpriority)"}


@query(f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing_n, (count(*) - count({c})) / count(*)::DOUBLE AS missing_fraction, count(DISTINCT {c}) AS unique_n, {_ID_SQL.format(c=repr(c))} AS is_identifier_like FROM orders" for c in _SIGNED)}),
q AS (SELECT 'o_custkey' AS column_name, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75 FROM (SELECT o_custkey::DOUBLE AS x FROM orders)),
f AS ({_tree_sql("orders", "o_orderdate", _SIGNED)})
SELECT c.*, f.fingerprint, CASE WHEN q.q25 IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS numeric_fraction, q.q25, q.median, q.q75 FROM c JOIN f USING (column_name) LEFT JOIN q USING (column_name)""")
def signature_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, quartiles and fingerprints by date of columns of orders, as one signature a column."""
    found = profile.signature(table(spark, sf_dir, "orders"), list(_SIGNED), "o_orderdate")
    return _rounded(found.drop("dtype", "min", "max", "mean", "std"), "q25", "median", "q75")


@query(f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents))
SELECT word, {_ID_SQL.format(c='word')} AS is_identifier_like FROM w""")
def identifier_name_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", S.is_identifier_name("word").alias("is_identifier_like"))


_CONCEPT_SQL = """CASE WHEN contains(c, 'subjectid') OR contains(c, 'subjid') OR contains(c, 'ursi') OR contains(c, 'anonymizedid') OR c IN ('id', 'doi', 'usrd') THEN 'subject_identifier'
WHEN contains(c, 'siteid') OR c = 'site' THEN 'site_identifier' WHEN contains(c, 'visitid') OR c = 'visit' THEN 'visit_identifier' WHEN contains(c, 'experimentid') THEN 'experiment_identifier'
WHEN contains(c, 'assessmentid') OR contains(c, 'asmtid') OR contains(c, 'segmentid') OR contains(c, 'instrumentid') THEN 'assessment_identifier'
WHEN contains(c, 'diagnos') OR c = 'dx' THEN 'diagnosis' WHEN contains(c, 'gender') OR c = 'sex' THEN 'sex_or_gender'
WHEN contains(c, 'ageonset') OR contains(c, 'ageatfirst') OR c = 'ao' THEN 'age_at_onset' WHEN contains(c, 'age') THEN 'current_age'
WHEN contains(c, 'panss') AND contains(c, 'tot') THEN 'panss_total' WHEN contains(c, 'panss') AND contains(c, 'pos') THEN 'panss_positive' WHEN contains(c, 'panss') AND contains(c, 'neg') THEN 'panss_negative'
WHEN c IN ('delusions', 'hallucinatorybehavior', 'bluntedaffect', 'poorattention', 'conceptualdisorganization') THEN 'panss_item'
WHEN contains(c, 'drug') OR contains(c, 'medication') THEN 'medication_name' WHEN contains(c, 'dose') OR c LIKE '%mg' THEN 'medication_dose' WHEN c IN ('cpz', 'cpz1', 'cpz2') THEN 'cpz_candidate'
WHEN contains(c, 'cognitive') OR contains(c, 'workingmemory') OR contains(c, 'speedofprocessing') OR contains(c, 'attentionvigilance') OR contains(c, 'cmindscomposite') OR contains(c, 'wtar') OR contains(c, 'wasi') OR contains(c, 'iq') THEN 'cognitive_domain'
WHEN c = 'positive' THEN 'panss_positive' WHEN c = 'negative' THEN 'panss_negative' ELSE 'unknown_or_study_specific' END"""


@query(f"""WITH w AS (SELECT DISTINCT regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS c FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)),
f AS (SELECT c, {_CONCEPT_SQL} AS concept FROM w WHERE c <> '')
SELECT concept, count(*) AS words FROM f GROUP BY concept""")
def infer_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).select(S.compact_name("w").alias("c")).filter("c <> ''").distinct()
    return words.groupBy(S.infer_column_concept("c").alias("concept")).agg(F.count("*").alias("words"))


@query("""WITH t AS (SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS j FROM pages),
h AS (SELECT url, j, list_filter([CASE WHEN contains(j, ' medication ') OR contains(j, ' med ') OR contains(j, 'cpz') OR contains(j, 'antipsychotic') OR contains(j, 'dose') THEN 'medication' END,
 CASE WHEN contains(j, 'panss') OR contains(j, 'delusions') OR contains(j, 'clinical') OR contains(j, 'calgary') THEN 'clinical_scale' END,
 CASE WHEN contains(j, 'cognitive') OR contains(j, 'working memory') OR contains(j, 'wasi') OR contains(j, 'wtar') OR contains(j, 'cminds') THEN 'cognitive' END,
 CASE WHEN contains(j, 'diagnosis') OR contains(j, ' dx ') OR contains(j, 'subject type') THEN 'diagnosis_or_labels' END,
 CASE WHEN contains(j, 'demographic') OR contains(j, ' age ') OR contains(j, ' gender ') OR contains(j, ' sex ') THEN 'demographics' END], lambda x: x IS NOT NULL) AS f,
 contains(j, 'dictionary') OR contains(j, 'codebook') OR contains(j, 'valid values') OR contains(j, 'field name') AS d FROM t)
SELECT url, CASE WHEN contains(j, 'dictionary') OR contains(j, 'codebook') OR (d AND len(f) = 0) THEN 'dictionary_or_codebook' WHEN len(f) >= 2 THEN 'mixed' WHEN len(f) = 1 THEN f[1]
 WHEN contains(j, 'subjectid') OR contains(j, 'subject id') OR contains(j, 'subjid') OR contains(j, 'ursi') THEN 'subject_list' ELSE 'unknown' END AS role FROM h""")
def infer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", S.infer_file_role("url").alias("role"))


@query(f"SELECT c_custkey, {_norm('c_name')} AS name_key, {_norm('c_custkey')} AS key_key, {_norm('c_mktsegment')} AS segment_key FROM customer")
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.normalized_identifier
    return table(spark, sf_dir, "customer").select("c_custkey", n("c_name").alias("name_key"), n("c_custkey").alias("key_key"), n("c_mktsegment").alias("segment_key"))


@query(f"SELECT c_custkey, 'alpha_' || substr(sha256('pepper|ALPHA|' || {_norm('c_name')}), 1, 20) AS subject_key FROM customer")
def mask_subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.masked_key("ALPHA", "c_name", "pepper").alias("subject_key"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS digest, substr(sha256(c_name || '|' || c_mktsegment || '|' || c_custkey::VARCHAR), 1, 24) AS case_id FROM customer")
def case_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_digest("c_name").alias("digest"), S.case_id("c_name", "c_mktsegment", "c_custkey").alias("case_id"))


@query("SELECT c_custkey, ('0x' || substr(sha256(c_name || ':11'), 1, 8))::BIGINT AS seed FROM customer")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_seed("c_name", 11).alias("seed"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'UNRESOLVED:' || o_orderstatus END AS status, (o_orderstatus = 'F') = (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS agrees FROM orders")
def code_map_orderstatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = S.canonical_code("o_orderstatus", {"F": "filled", "O": "open"})
    urgent = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.lit("F")).otherwise(F.lit("O"))
    filled = F.when(F.col("o_orderstatus") == "F", F.lit("F")).otherwise(F.lit("O"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), S.same_value(filled, urgent, "code", {"F": "filled", "O": "open"}).alias("agrees"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE (round(o_totalprice * 100)::BIGINT)::VARCHAR END AS price, abs(o_totalprice - round(o_totalprice, 1)) <= 1e-9 AS one_decimal FROM orders")
def lenient_numbers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("o_totalprice") == F.floor("o_totalprice")
    price = F.when(whole, S.output_number("o_totalprice")).otherwise(S.output_number(F.round(F.col("o_totalprice") * 100)))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), S.same_value(F.col("o_totalprice"), F.round("o_totalprice", 1), "age").alias("one_decimal"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT props->>'k') AS kinds FROM events GROUP BY event_type")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("bigint")).alias("k_sum"), F.count_distinct(k).alias("kinds"))


_LINKS = [("customer", "c_custkey", "orders", "o_custkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]


def _card_sql(a: str, ak: str, b: str, bk: str) -> str:
    return f"""SELECT *, CASE WHEN overlap_n < left_unique_n THEN 'partial_overlap' WHEN duplicate_right_n > 0 THEN 'left_complete_with_right_duplicates' WHEN right_unique_n > left_unique_n THEN 'left_complete_subset' ELSE 'one_to_one_technical_overlap' END AS relationship FROM (
SELECT '{a}:{b}' AS card, (SELECT count(*) FROM {a}) AS left_n, (SELECT count(*) FROM {b}) AS right_n, (SELECT count(DISTINCT {ak}) FROM {a}) AS left_unique_n, (SELECT count(DISTINCT {bk}) FROM {b}) AS right_unique_n,
(SELECT count(*) FROM (SELECT {ak} FROM {a} INTERSECT SELECT {bk} FROM {b})) AS overlap_n, (SELECT count({ak}) - count(DISTINCT {ak}) FROM {a}) AS duplicate_left_n, (SELECT count({bk}) - count(DISTINCT {bk}) FROM {b}) AS duplicate_right_n)"""


@query(" UNION ALL ".join(_card_sql(*x) for x in _LINKS))
def linkage_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.overlap_cards([(f"{a}:{b}", table(spark, sf_dir, a), ak, table(spark, sf_dir, b), bk) for a, ak, b, bk in _LINKS])


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, doc_id AS a FROM documents), b AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, doc_id AS b FROM labels)
SELECT count(a) AS left_n, count(b) AS right_n, count_if(a IS DISTINCT FROM b)::BIGINT AS mismatch_n, count_if(a IS DISTINCT FROM b) = 0 AS order_agreement FROM a FULL JOIN b USING (p)""")
def order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.positions import positions

    a = positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    b = positions(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return linkage.order_agreement(a, b, "pos", "doc_id")


@query("""SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN 'not_in_source' ELSE 'matched_unique' END AS source_status, l.quality AS source_quality, l.toxic AS source_toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def guarded_lookup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.guarded_lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'not_in_source' WHEN n > 1 THEN 'duplicate_key' ELSE 'matched_unique' END AS source_status, CASE WHEN n = 1 THEN p END AS source_l_partkey FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def guarded_lookup_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.guarded_lookup(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey"])


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.cover(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT source, list_sort(list(doc_id))[1] AS left_member, list_sort(list(doc_id))[2] AS right_member, count(*) AS members FROM documents GROUP BY source HAVING count(*) >= 2""")
def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.lineage_pairs(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""SELECT doc_id, 'lang' AS field FROM documents WHERE doc_id % 9 = 0 AND lang <> 'xx' UNION ALL SELECT doc_id, 'source' AS field FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'n_chars' AS field FROM documents WHERE n_chars IS DISTINCT FROM length(text)""")
def metadata_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a second account of them, in which some languages differ, some sources are gone and lengths are counted anew."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    again = docs.select(
        "doc_id", F.when(k % 9 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(k % 13 != 0, F.col("source")).alias("source"), F.char_length("text").cast("bigint").alias("n_chars")
    )
    return linkage.inconsistent_metadata(docs, again, ["lang", "source", "n_chars"], "doc_id")


_CARD_COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "customer": ["c_custkey", "c_name", "c_acctbal"]}
_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}


def _column_card_sql(sheet: str, c: str) -> str:
    share = "1.0::DOUBLE" if _KINDS[c] != "string" else "0.0::DOUBLE"
    key = "regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g')"
    return f"""SELECT 'column:shop:' || substr(sha256('{sheet}:{c}'), 1, 16) AS card_id, 'shop' AS artifact_id, 'ALPHA' AS study, '{sheet}' AS sheet, column_name, {_CONCEPT_SQL.replace('(c,', f'({key},').replace('c IN', f'{key} IN').replace('c =', f'{key} =').replace('c LIKE', f'{key} LIKE')} AS concept,
'{_KINDS[c]}' AS dtype, n, missing_n, unique_n, {share} AS numeric_fraction, {_ID_SQL.format(c='column_name')} AS is_identifier_like FROM (SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing_n, count(DISTINCT {c}) AS unique_n FROM {sheet})"""


@query(" UNION ALL ".join(_column_card_sql(t, c) for t, names in _CARD_COLUMNS.items() for c in names))
def column_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = {t: table(spark, sf_dir, t) for t in _CARD_COLUMNS}
    return profile.column_cards("shop", "ALPHA", sheets, [c for names in _CARD_COLUMNS.values() for c in names])


@query("""SELECT 'reference:nations:' || substr(sha256(n_regionkey::VARCHAR), 1, 16) AS card_id, 'nations' AS artifact_id, 'ALPHA' AS study, 'nation codes' AS reference_scope, n_regionkey::VARCHAR AS variable,
n_regionkey::VARCHAR || ':' || string_agg(n_nationkey::VARCHAR || '=' || n_name, ',' ORDER BY n_nationkey::VARCHAR) AS verified_fields FROM nation GROUP BY n_regionkey""")
def reference_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("variable"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("meaning"))
    return profile.reference_cards(words, "nations", "ALPHA", "nation codes")


@query("""SELECT 'orders' AS name, (SELECT count(DISTINCT o_orderkey) FROM orders) AS expected_n, (SELECT count(*) FROM orders) AS n, (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders) AS as_expected
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), (SELECT count(*) FROM lineitem), (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) = (SELECT count(*) FROM lineitem)""")
def row_count_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as keys?"""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    keys = [o.agg(F.count_distinct("o_orderkey").alias("expected_n")).withColumn("name", F.lit("orders")), li.agg(F.count_distinct("l_orderkey", "l_linenumber").alias("expected_n")).withColumn("name", F.lit("lineitem"))]
    return linkage.row_counts({"orders": o, "lineitem": li}, keys[0].unionByName(keys[1]))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered, o_orderstatus AS status, o_orderpriority AS attribute FROM orders""")
def safe_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that are infinite or no numbers, times, and attribute bytes as JSON would hold them."""
    k = F.col("o_orderkey")
    price = F.when(k % 5 == 0, F.lit(float("inf"))).when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders")
    kinds = dict(rows.dtypes)
    return rows.select(
        "o_orderkey", S.safe_scalar(price, "double").alias("price"), S.safe_scalar("o_orderdate", kinds["o_orderdate"]).alias("ordered"), S.safe_scalar("o_orderstatus", "string").alias("status"),
        S.attribute_text(F.col("o_orderpriority").cast("binary")).alias("attribute"),
    )
