"""The registered queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, decontamination, divergence, extraction, fingerprints, jaccard, language_model, pii, quality, sentencepiece, simhash, token_counts, toxicity
from .common import table


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id", "n_links", "n_copies")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(token_counts.with_edits(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprints(table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.summarize(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversation.audit(conversation.damaged(whole), whole)


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the lengths and the digests of the edited texts."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: how many base spans of each kind a text has."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: folds, tokens and the base score."""
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_fingerprints": op3_fingerprints,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_html_extraction": op5_html_extraction,
        "op6_token_counts": op6_token_counts,
        "op7_pii": op7_pii,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_toxicity": op9_toxicity,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_divergence": op11_divergence,
        "op12_simhash": op12_simhash,
        "op13_conversation_repair": op13_conversation_repair,
        "fingerprint_edits": fingerprint_edits,
        "lm_base_scores": lm_base_scores,
        "pii_base_counts": pii_base_counts,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + 9], ' ') AS wording FROM s),
lengths AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, lengths WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.pos, p.n, v.item_id FROM p JOIN v ON v.n = p.n AND array_to_string(p.w[p.pos:p.pos + p.n - 1], ' ') = v.wording),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(len(m.items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(m.items, ','), '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, coalesce(text, '')))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(coalesce(after, first), length(t) // 4)) AS edited_sha256 FROM d
"""

BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM d)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0)) AS n_ip,
  len(list_filter(list_filter(cards, lambda x: length(x) BETWEEN 12 AND 19),
    lambda x: list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN substr(x, length(x) - i, 1)::INT ELSE 2 * substr(x, length(x) - i, 1)::INT - CASE WHEN substr(x, length(x) - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone FROM m
"""


#: The table of crc32 as a row, and the checksum of an ASCII text by it.
_CRC_TABLE = "bytes AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc FROM range(256) b(i))"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295)"


BASE_SCORE_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents, bytes),
t AS (SELECT doc_id, held_out, unnest(list_append(w, ' end')) AS token FROM d),
c AS (SELECT token, count(*) AS n FROM t WHERE NOT held_out GROUP BY token),
s AS (SELECT sum(n) AS total, count(*) AS kinds FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.n) AS n_known, s.total::BIGINT AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 1) / (s.total + 1 * (s.kinds + 1))::DOUBLE)), 6) AS base_score
FROM t LEFT JOIN c ON t.token = c.token, s GROUP BY doc_id, held_out, s.total
"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, k.n AS all_n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.lang, f.source, f.term, f.n, (1 + (1000000000::HUGEINT * (f.n + 1)) // (f.total + v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (f.all_n + 1)) // (v.n + v.v))::BIGINT AS q
  FROM f JOIN v ON f.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM e) WHERE part = 'pair' OR rank <= 200
"""


def _taken(states: str, edit: str, cost: str, line: str = "''") -> str:
    """Audits of some states, with one more edit."""
    return f"list_transform({states}, lambda x: {{'c': x.c + {cost}, 't': x.t || '{edit}', 'r': x.r || {line}}})"


def _step(states: str, initial: str, role: str) -> str:
    """A row that takes states where rows of this role may follow: kept or with the role given to it; no audits if it must go."""
    rerole = _taken(states, "R", "2 + w.cut", f"(chr(10) || '{role}:' || w.text)") if role != "system" else "[]"
    return f"CASE WHEN w.gone THEN [] WHEN w.initial = '{initial}' THEN list_concat({_taken(states, 'K', 'w.cut', '(chr(10) || w.role || chr(58) || w.text)')}, {rerole}) ELSE {rerole} END"


def _repair_sql() -> str:
    user, both = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
    into = {
        "eu": f"list_concat({_taken('[p.e, p.s, p.a]', 'I', '2', user)}, [p.u])",
        "ea": f"list_concat({_taken('[p.u]', 'I', '2', "chr(10) || 'assistant:'")}, {_taken('[p.e, p.s]', 'II', '4', both)}, [p.a])",
    }
    far = "{'c': 1000000000, 't': '', 'r': ''}"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, bytes),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM d),
b AS (SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(shown, 1) IN ('.', '!', '?') AS ends,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM o),
r AS (SELECT conv_id, turn, pos, role, text, initial, blank, again AND NOT blank AS dup, NOT blank AND NOT again AND NOT ends AS short, blank OR again AS gone,
    CASE WHEN blank OR again OR ends THEN 0 ELSE 1 END AS cut, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS odd FROM b),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 't': '', 'r': ''}} AS e, {far} AS s, {far} AS u, {far} AS a FROM conversations
  UNION ALL SELECT p.conv_id, w.pos,
    list_min({_taken('[p.e]', 'D', '3')}),
    list_min(list_concat({_taken('[p.s]', 'D', '3')}, {_step('[p.e]', 's', 'system')})),
    list_min(list_concat({_taken(into['eu'], 'D', '3')}, {_step('[p.e, p.s, p.a]', 'u', 'user')}, {_step(_taken('[p.u]', 'I', '2', "chr(10) || 'assistant:'"), 'u', 'user')}, {_step(_taken('[p.e, p.s]', 'II', '4', both), 'u', 'user')})),
    list_min(list_concat({_taken(into['ea'], 'D', '3')}, {_step(into['eu'], 'a', 'assistant')}))
  FROM p JOIN r w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.pos = p.pos + 1),
z AS (SELECT conv_id, list_min([p.e, p.a, {{'c': p.u.c + 2, 't': p.u.t || 'I', 'r': p.u.r || chr(10) || 'assistant:'}}, {{'c': p.s.c + 4, 't': p.s.t || 'II', 'r': p.s.r || {both}}}]) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM p) p WHERE back = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (short) AS short, count(*) FILTER (odd) AS odd FROM r GROUP BY conv_id)
SELECT z.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.dup, 0)::BIGINT AS duplicate, coalesce(n.short, 0)::BIGINT AS truncated, coalesce(n.odd, 0)::BIGINT AS illegal,
  z.best.c::BIGINT AS cost, z.best.t AS audit, sha256(substr(z.best.r, 2)) AS repaired_sha256 FROM z LEFT JOIN n ON z.conv_id IS NOT DISTINCT FROM n.conv_id
"""


REPAIR_SQL = _repair_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL, "fingerprint_edits": EDITS_SQL, "lm_base_scores": BASE_SCORE_SQL, "pii_base_counts": BASE_SQL, "op11_divergence": DIVERGENCE_SQL, "op13_conversation_repair": REPAIR_SQL,
    }
