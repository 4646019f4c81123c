"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold how many characters and tokens a pre-token has, inner nodes their sums. trees() makes them and
keeps the leaves as columns beside the text, where they can be stored; edited() starts from these columns, and
encodes nothing but what the edits touch. An edit finds its leaf by descending on the characters, re-splits the
text from a little before the edit (the pattern looks ahead two characters at most) until a boundary coincides
with one of the old ones, from where on everything is as before, and puts the new pre-tokens into the leaves of
the old ones, or into empty leaves after them, and updates the sums above; only where these do not suffice is
the tree laid out anew, without encoding. Sums are made again when leaves are read.

Null and empty texts have no tokens; edits beyond the end of a text are cut to it; an empty or null
list of edits changes nothing. Repeated rows get equal counts, an empty table gives an empty result, and
other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the rank file's vocabulary splits texts before its merges (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters before an edit whose pre-tokens may have looked at it.
BACK = 4


class Encoder:
    """Splits texts and counts the tokens of each pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.split = regex.compile(PATTERN)
        self.whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def size(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > 500_000:
                self.known.clear()
            n = self.known[piece] = len(self.whole.encode_ordinary(piece))
        return n


def load(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Counts:
    """The segment tree of one text, from its leaves if these are known."""

    def __init__(self, text: str, encoder: Encoder, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.encoder, self.encoded = text, encoder, 0
        if leaves is None:
            pieces = encoder.split.findall(text)
            leaves = np.array([len(p) for p in pieces], np.int64), np.array([encoder.size(p) for p in pieces], np.int64)
        self._lay(*leaves)

    def _lay(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves = width = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
        self.chars[width : width + len(chars)] = chars
        self.tokens[width : width + len(chars)] = tokens
        while width > 1:
            for tree in (self.chars, self.tokens):
                tree[width // 2 : width] = tree[width : 2 * width].reshape(-1, 2).sum(1)
            width //= 2

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token, in order."""
        chars, tokens = self.chars[self.leaves :], self.tokens[self.leaves :]
        return chars[chars > 0], tokens[chars > 0]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node, begin

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        more, gained = chars - int(self.chars[leaf]), tokens - int(self.tokens[leaf])
        while leaf and (more or gained):
            self.chars[leaf] += more
            self.tokens[leaf] += gained
            leaf //= 2

    def _replace(self, first: int, last: int, pieces: list[tuple[int, int]]) -> None:
        """New pre-tokens for those of the leaves from first to last."""
        while last - first + 1 < len(pieces) and last + 1 < 2 * self.leaves and not self.chars[last + 1]:
            last += 1
        if len(pieces) <= last - first + 1:
            for leaf in range(first, last + 1):
                self._put(leaf, *(pieces[leaf - first] if leaf - first < len(pieces) else (0, 0)))
            return
        old = [x[self.leaves :] for x in (self.chars, self.tokens)]
        here = old[0] > 0
        lo, hi = first - self.leaves, last + 1 - self.leaves
        new = np.array(pieces, np.int64).T
        self._lay(*(np.concatenate([x[:lo][here[:lo]], n, x[hi:][here[hi:]]]) for x, n in zip(old, new, strict=True)))

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start up to stop."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        leaf, begin = self._leaf(min(max(start - BACK, 0), max(size - 1, 0)))
        text = self.text[:start] + new + self.text[stop:]
        shift, same = len(new) - (stop - start), start + len(new)
        last, edge = leaf, begin + int(self.chars[leaf])  # the old boundary after the leaves taken so far
        pieces: list[tuple[int, int]] = []
        for m in self.encoder.split.finditer(text, begin):
            pieces.append((len(m[0]), self.encoder.size(m[0])))
            self.encoded += 1
            at = m.end()
            if at < same:
                continue
            while edge < at - shift and last + 1 < 2 * self.leaves:
                last += 1
                edge += int(self.chars[last])
            if edge == at - shift and edge >= stop:
                break
        else:
            last = 2 * self.leaves - 1
        self.text = text
        self._replace(leaf, last, pieces)


def _leaves(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int32()))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy().astype(np.int64), np.cumsum(np.diff(ends))[:-1]) if len(column) else []


def _build(ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks.value)
    for batch in slices(batches):
        kept = [Counts(t, encoder).kept() for t in batch.column("text").to_pylist()]
        arrays = [*batch.columns, _leaves([k[0] for k in kept]), _leaves([k[1] for k in kept])]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "chars", "tokens"])


def _edit(ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks.value)
    names = ["n_chars", "n_pretokens", "n_tokens", "n_edits", "n_encoded_again", "edited_chars", "edited_tokens"]
    for batch in slices(batches):
        rows, kept, texts = [], [], []
        leaves = zip(_rows(batch.column("chars")), _rows(batch.column("tokens")), strict=True)
        for text, edits, own in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), leaves, strict=True):
            tree = Counts(text, encoder, own)
            before = (len(text), len(own[0]), tree.total)
            for e in edits or []:
                tree.edit(e["start"], e["stop"], e["text"] or "")
            rows.append((*before, len(edits or []), tree.encoded, len(tree.text), tree.total))
            kept.append(tree.kept())
            texts.append(tree.text)
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [batch.column("doc_id"), pa.array(texts, pa.string()), _leaves([k[0] for k in kept]), _leaves([k[1] for k in kept])]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "text", "chars", "tokens", *names])


def _ranks(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load(path))


def trees(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, text, chars, tokens (and edits, if documents have them): the leaves of each document's tree."""
    rows = documents.select("doc_id", text_of().alias("text"), *(["edits"] if "edits" in documents.columns else []))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", chars array<int>, tokens array<int>"
    ranks = _ranks(documents, path)
    return rows.mapInArrow(lambda it: _build(ranks, it), schema)


def edited(kept: DataFrame, path: str = RANKS) -> DataFrame:
    """The trees of kept (doc_id, text, chars, tokens, edits) after their edits, and counts before and after.

    edits is an array of (start, stop, text) applied in turn.
    """
    ranks, kind = _ranks(kept, path), kept.schema["doc_id"].dataType.simpleString()
    counts = ("n_chars", "n_pretokens", "n_tokens", "n_edits", "n_encoded_again", "edited_chars", "edited_tokens")
    rows = kept.select("doc_id", "text", "chars", "tokens", "edits")
    schema = f"doc_id {kind}, text string, chars array<int>, tokens array<int>, " + ", ".join(f"{c} bigint" for c in counts)
    return rows.mapInArrow(lambda it: _edit(ranks, it), schema)


def recount(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """Token counts of each row before and after its edits."""
    return edited(trees(documents, path), path).drop("text", "chars", "tokens")


def with_edits(documents: DataFrame) -> DataFrame:
    """Three edits of each text: its first forty characters again in the middle, twelve characters gone after a
    quarter, and twenty after three quarters turned round."""
    text = text_of()
    n = F.char_length(text)
    half, quarter, late = (F.floor(n * k / 4).cast("int") for k in (2, 1, 3))
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), t.alias("text"))
    return documents.select(
        "doc_id",
        text.alias("text"),
        F.array(
            edit(half, half, F.substring(text, 1, 40)),
            edit(quarter, quarter + 12, F.lit("")),
            edit(late, late + 20, F.reverse(F.substring(text, late + 1, F.lit(20)))),
        ).alias("edits"),
    )
