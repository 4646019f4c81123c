"""The divergence audit, SimHash near-duplicates and conversation repair against SQL and brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from helpers import connect, plain

from attestra.llm import conversation, divergence, queries, simhash


@pytest.mark.parametrize("name", ["op11_divergence", "op13_conversation_repair"])
def test_what_its_sql_says(spark, sf, name):
    got, want = plain(queries.queries()[name](spark, sf).toPandas()), plain(connect(sf).sql(queries.oracle_sql()[name]).df())
    assert got == want


# --- divergence


def divergences(rows, least=3, top=200):
    """Every pair and term by the definition, in whole numbers."""
    tokens = [(lang or "", source or "", [t for t in re.split(r"[^A-Za-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if t]) for text, lang, source in rows]
    found = []
    for lang in {r[0] for r in tokens}:
        docs = collections.Counter(t for la, _, ts in tokens if la == lang for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: collections.Counter(t for la, so, ts in tokens if (la, so) == (lang, s) for t in ts if t in kept) for s in {so for la, so, _ in tokens if la == lang}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, values, n in (("pair", pair, None), ("term", term, top)):
                order = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:n]
                found += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)]
    return sorted(found)


def audited(df, **given):
    return sorted(map(tuple, divergence.audit(df, **given).select("lang", "source", "part", "item", "value", "rank").collect()))


SCHEMA = "text string, lang string, source string"
WORDS = ["Öl", "öl", "Alpha", "beta", "GAMMA", "gamma", "x", "über", "漢字", "\U0001f600", "a1b", "don't"]


def test_divergences_by_definition(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randrange(9))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for _ in range(120)]
    rows += [(None, "en", "s"), ("", None, None), ("only once", "xx", "one"), ("nothing", "yy", "one"), ("other", "yy", "two"), ("word " * 30_000, "en", "t"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS block")
    assert audited(df) == divergences(rows)
    assert audited(df, least=1, top=2) == divergences(rows, 1, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergences_do_not_depend_on_blocks_shards_and_portions(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices(WORDS[:8], k=6)), "en", f"s{rng.randrange(9)}") for _ in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = audited(df)
    kept = divergence.counts(df)
    known = divergence.groups(kept)
    # blocks of a few sources and shards of a few counts, as a large table has them
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SHARD", 7)
    monkeypatch.setattr(divergence, "PORTION", 64)
    assert {r["blocks"] for r in divergence.groups(kept).collect()} == {5} and {r["blocks"] for r in known.collect()} == {1}
    assert audited(df) == whole == divergences(rows)


def test_shares_are_exact_beyond_longs(spark):
    n, total = 10**15, 3 * 10**15 + 7
    df = spark.createDataFrame([(n, total, 12345)], "n bigint, total bigint, v bigint")
    assert df.select(divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 1) // (total + 12345)


# --- SimHash


def print_of(text):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, limit=4):
    """The least index in reach of each fingerprint, from all pairs."""
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= limit:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "one\x0btwo  THREE", "a b c d", "A B\nc d e", "Ünïcode ÄÖ text bleibt gross", "...! ? -", "word " * 50_000, "x" * 3_000_000 + " y z", "a\x85b c\xa0d e f"]


def test_fingerprints_by_definition(spark, docs, monkeypatch):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.digest(simhash.near_duplicates(docs(list(enumerate(TEXTS))))).collect()}
    assert got == {i: f"{print_of(t):016x}" for i, t in enumerate(TEXTS)}
    # a text in portions has the fingerprint of the whole
    monkeypatch.setattr(simhash, "PORTION", 7)
    for t in ("a b c d e f g  h i\tj", "one two", "  x  ", "longwordlongword b c d e", ""):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == print_of(t)


def test_spark_hashes_alike(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_components_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = reach([print_of(t) for _, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in queries.queries()["op12_simhash"](spark, sf).collect()}
    assert got == {i: rows[w][0] for (i, _), w in zip(rows, want, strict=True)}


def test_every_pair_within_the_limit_has_a_chain():
    """Any four bits, in any segments: some first segment allows all its chains, and one of its keys is equal."""
    rng, chains, budgets, keys = random.Random(1), simhash.chains(), simhash.budgets(), simhash.key_masks()
    assert budgets == [0, 1, 2, 3, 4] and chains[0][-1] == (1 << 64) - 1
    for _ in range(20_000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        fits = [all((differ & m).bit_count() <= b for m, b in zip(ring, budgets, strict=True)) for ring in chains]
        assert any(fits[k // 2] and not differ & m for k, m in enumerate(keys))


@pytest.mark.parametrize("block", [512, 4])
def test_links_of_planted_fingerprints(spark, monkeypatch, block):
    """Chains, crowds around one fingerprint and lone ones, in blocks of any size, give the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for base in (prints[0], 0, (1 << 64) - 1):
        for _ in range(60):
            other = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                other ^= 1 << b
            prints.append(other)
    walk = prints[1]
    for _ in range(40):
        for b in rng.sample(range(64), 4):
            walk ^= 1 << b
        prints.append(walk)
    prints = sorted({simhash._signed(p) for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    edges = [tuple(r) for r in simhash.links(df).collect()]
    bits = [p & (1 << 64) - 1 for p in prints]
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == reach(bits)
    with pytest.raises(ValueError, match="limit of 4"):
        simhash.links(df, 9)


def test_copies_and_ids_without_value(spark, docs):
    rows = [(7, "same text here now"), (3, "same text here now"), (None, "same text here now"), (3, "same text here now"), (None, "another one with no id at all"), (9, None), (2, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 3), (3, 3), (None, None), (9, 2), (2, 2)], key=str)
    assert simhash.near_duplicates(docs([])).count() == 0


# --- conversations


def best_audit(rows):
    """(cost, audit, text) by trying all edits; rows are (role, text, gone, truncated)."""
    best = None
    legal = re.compile(r"(s?(ua)+)?\Z")
    n = len(rows)
    inserts = [""] + ["u", "a", "ua", "au"]

    def walk(i, cost, audit, roles, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for extra in inserts:
            c, t, r, o = cost + 2 * len(extra), audit + "I" * len(extra), roles + extra, out + [f"{'user' if x == 'u' else 'assistant'}:" for x in extra]
            if i == n:
                if legal.match(r) and (best is None or (c, t) < best[:2]):
                    best = (c, t, "\n".join(o))
                continue
            role, text, gone, cut = rows[i]
            walk(i + 1, c + 3, t + "D", r, o)
            if not gone:
                walk(i + 1, c + cut, t + "K", r + (role[:1] or "?"), [*o, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    walk(i + 1, c + cut + 2, t + "R", r + new[0], [*o, f"{new}:{text}"])

    walk(0, 0, "", "", [])
    return best


def test_repairs_are_the_best_of_all_edits():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", " "]), str(k), rng.random() < 0.2, rng.random() < 0.2) for k in range(rng.randrange(5))]
        repair = conversation.Repair()
        for role, _, gone, cut in rows:
            repair.add(role[:1], gone, cut)
        cost, audit = repair.done()
        want = best_audit(rows)
        assert (cost, audit) == want[:2]
        out, at = [], {k + 1: r for k, r in enumerate(rows)}
        for pos, edit, role in conversation.edits_of(audit):
            if edit != "D":
                out.append(f"{role or at[pos][0]}:{at[pos][1] if pos else ''}")
        assert "\n".join(out) == want[2]


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 1, 3])
def test_strings_are_compared_right_even_when_all_hashes_collide(monkeypatch, prime):
    monkeypatch.setattr(conversation, "_PRIME", prime)
    rng, root = random.Random(prime), conversation.Node()
    trie = {"": root}
    for _ in range(300):
        text = "".join(rng.choices("DK", k=rng.randrange(40)))
        for n in range(1, len(text) + 1):
            if text[:n] not in trie:
                trie[text[:n]] = conversation.Node(trie[text[: n - 1]], text[n - 1])
    names = rng.sample(sorted(trie), 120)
    for a in names:
        assert trie[a].string() == a
        for b in names:
            assert conversation.less(trie[a], trie[b]) == (a < b)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def test_repaired_rows_and_edges(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 3, "assistant", "So"), (1, 9, "user", " \t"),
        (2, None, "user", "No turn."), (2, None, "assistant", "None."), (None, 4, None, None), (None, 5, "tool", "Ok."), (3, 2, "assistant", "x" * 200_000 + "."),
    ]
    df = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "1 AS pos", "2 AS step", "3 AS edit")
    named = df.select("conv_id").union(spark.createDataFrame([(77,)], "conv_id bigint"))
    got = {r["conv_id"]: r for r in conversation.audit(df, named).collect()}
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"], one["cost"], one["audit"]) == (6, 1, 1, 1, 1, 7, "KKDKD")
    assert one["repaired_sha256"] == digest("system:Be brief.", "user:Why?", "assistant:So")
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"], got[2]["repaired_sha256"]) == (0, 4, "IKKI", digest("user:", "assistant:None.", "user:No turn.", "assistant:"))
    assert (got[None]["blank"], got[None]["illegal"], got[None]["audit"], got[None]["cost"]) == (1, 1, "DD", 6)
    assert (got[3]["audit"], got[3]["cost"], got[3]["repaired_sha256"]) == ("IK", 2, digest("user:", f"assistant:{'x' * 200_000}."))
    assert tuple(got[77])[1:] == (0, 0, 0, 0, 0, 0, "", digest(""))
    told = conversation.faults(df)
    left = conversation.repaired(told, conversation.edits(told)).filter("conv_id = 1 AND edit != 'D'").orderBy("step").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in left] == [(0, "system", "Be brief."), (1, "user", "Why?"), (3, "assistant", "So")]
    assert conversation.audit(df.limit(0), df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "What? Now! So.") for c in range(30) for t in range(10)]
    got = collections.Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversation.damaged(spark.createDataFrame(rows, CONVERSATION)).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            want[(c, t, "user" if kind == 4 else role, {1: "", 2: "What Now So"}.get(kind, text))] += 1 + (kind == 3)
    assert got == want


def test_a_long_conversation_shares_its_prefixes():
    """Ten thousand rows with ties that reach far back: the audit gives a legal order at the least cost."""
    rows = [("ua"[k % 2] if k % 97 else "t", k % 11 == 5, k % 7 == 3) for k in range(10_000)]
    repair = conversation.Repair()
    for row in rows:
        repair.add(*row)
    cost, audit = repair.done()
    order, total = "", 0
    for pos, edit, role in conversation.edits_of(audit):
        initial, gone, cut = rows[pos - 1] if pos else (None, False, False)
        assert edit == "D" or not gone
        total += {"D": 3, "I": 2, "K": cut, "R": 2 + cut}[edit]
        order += "" if edit == "D" else (role or initial)[0]
    assert re.match(r"(s?(ua)+)?\Z", order) and total == cost
    # costs alone: nothing, user last, assistant last
    far = 10**9
    none, user, agent = 0, far, far
    for initial, gone, cut in rows:
        for _ in range(2):
            user, agent = min(user, none + 2, agent + 2), min(agent, user + 2)
        keep = lambda role: far if gone else cut + (0 if initial == role else 2)  # noqa: B023, E731
        opened = min(none, agent)
        none, user, agent = none + 3, min(user + 3, opened + keep("u")), min(agent + 3, user + keep("a"))
    assert cost == min(none, agent, user + 2)
