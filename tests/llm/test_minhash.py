"""One-permutation MinHash by hand: bins, densification, packed digits, likeness with bias correction."""

import random
import re
import struct

import xxhash

from attestra.llm import fingerprints

BINS, MARK = 256, (1 << 56) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def digest(*values):
    """Of texts and whole numbers one after another, each seeded with the last one's."""
    seed = 42
    for kind, v in values:
        data = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def by_hand(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    hashes = {digest(*[("s", w) for w in words[i : i + 5]]) for i in range(max(1, len(words) - 4))} if words else set()
    # bins stand in the order of signed hashes
    own = [min((h for h in hashes if h >> 56 == (b + BINS // 2) % BINS), default=None) for b in range(BINS)]
    now = list(own)
    for turn in range(1, 9):
        now = [own[signed(digest(("i", b), ("i", turn))) % BINS] if h is None else h for b, h in enumerate(now)]
    filled = [h for h in own if h is not None]
    if filled:
        lend = lambda b: min(filled, key=lambda g: (signed(digest(("i", b), ("q", g >> 56))), signed(g)))
        now = [lend(b) if h is None else h for b, h in enumerate(now)]
    return "".join(f"{(MARK if h is None else h) & 15:x}" for h in now)


def likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / BINS - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_and_likeness_by_hand(spark):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "漢字", "x1"]
    texts = ["", "one", "a b c d e", "...", *[" ".join(rng.choices(vocabulary, k=n)) for n in (4, 6, 9, 30, 200, 2500)]]
    texts.append(texts[-1][: len(texts[-1]) // 2])
    texts.append(texts[7] + " tail")
    found = fingerprints.digest(fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    got = {r["doc_id"]: r for r in found}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["fingerprint"] == by_hand(text) and got[i]["edited_fingerprint"] == by_hand(edited)
        assert abs(got[i]["near_edited"] - likeness(by_hand(text), by_hand(edited))) < 1e-12
        assert abs(got[i]["near_next"] - likeness(by_hand(text), by_hand(after))) < 1e-12


def test_likeness_is_unbiased(spark):
    """Pairs of a known similarity: the mean estimate is near it, chance agreement of digits taken off."""
    rng, rows, truth = random.Random(5), [], []
    for k in range(60):
        words = [f"u{k}x{n}" for n in range(400)]
        kept = rng.randrange(40, 360)
        other = words[:kept] + [f"v{k}x{n}" for n in range(400 - kept)]
        a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (words, other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        truth.append(len(a & b) / len(a | b))
    found = fingerprints.digest(fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id int, text string")))
    near = {r["doc_id"] // 2: r["near_next"] for r in found.filter("doc_id % 2 = 0").collect()}
    errors = [near[k] - t for k, t in enumerate(truth)]
    assert abs(sum(errors) / 60) < 0.02 and max(map(abs, errors)) < 0.2
