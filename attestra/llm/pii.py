"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

The four base kinds (email, ip, card, phone) are fixed by their patterns and checks alone; they stay
whatever their score. The method adds IBANs that pass mod 97 and national numbers (nine digits in
groups of 3-2-4, or a phone number without its plus) where a context word within forty characters lifts
a weak score over the line. Each span carries its score.

Null and empty texts have no spans. Offsets count code points, ends are exclusive. Within a kind spans
are leftmost and don't overlap; between kinds they may. Repeated rows get equal spans, an empty table
gives an empty result, and other columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone")
LINE, NEAR = 0.5, 40

# what may not stand before a match is asked after its first character, which makes the search fast;
# an address can only start at the start of its run of digits
_ANY_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9+.(-][(0-9])(?:(?<=\()[0-9]{3}\)|(?<!\()[0-9]{2})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
#: Words that speak for a kind, in the languages of the corpus.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "passport", "id"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(v) + r")(?!\w)", re.I) for k, v in CONTEXT.items()}
#: What a pattern with its check is worth alone, and what a word nearby adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
LIFT = 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, then the longest domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, at):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", *s) for s in _emails(text))
    if not _ANY_DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("national_id", _NATIONAL), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def spans(text: str | None) -> list[Span]:
    """By start, then in the order of KINDS."""
    text = text or ""
    found = []
    for kind, start, end in _proposed(text):
        around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
        score = min(1.0, PRIOR[kind] + LIFT * bool(_CONTEXT[kind].search(around)))
        if kind in BASE or score >= LINE:
            found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str | None) -> str | None:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in slices(batches):
        found = [[s._asdict() for s in spans(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_find, f"doc_id {kind}, spans {_SPAN}")


def _told(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            found = spans(text)
            base = [s for s in found if s.kind in BASE]
            sha = hashlib.sha256(_told(base).encode()).hexdigest()
            rows.append((*(sum(s.kind == k for s in base) for k in BASE), sha, _told(found)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def digest(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"n_{k} bigint" for k in BASE)
    return documents.select("doc_id", "text").mapInArrow(_digest, f"doc_id {kind}, {columns}, base_sha256 string, spans string")


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with redacted texts and their lengths; other columns as they are."""
    at = documents.schema.fieldNames().index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns)
            cols[at] = pa.array([redact(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    found = documents.mapInArrow(work, documents.schema)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in documents.columns else found
