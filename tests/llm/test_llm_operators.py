"""Operators against brute force, exact round trips and planted cases."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from helpers import connect, plain

from attestra.llm import decontamination, extraction, fingerprints, jaccard, language_model, pii, quality, queries, sentencepiece, token_counts, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


def test_contamination_is_what_its_sql_says(spark, sf):
    got, want = plain(queries.queries()["op2_decontamination"](spark, sf).toPandas()), plain(connect(sf).sql(queries.OP2_SQL).df())
    assert got == want


@pytest.mark.parametrize("name", ["fingerprint_edits", "lm_base_scores", "pii_base_counts"])
def test_exact_columns_are_what_their_sql_says(spark, sf, name):
    got, want = plain(queries.queries()[name](spark, sf).toPandas()), plain(connect(sf).sql(queries.oracle_sql()[name]).df())
    assert got == want


def test_shuffled_windows_give_the_same_hits(spark, sf, corpus):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    few = corpus.filter("doc_id < 120")
    a, b = (sorted(map(tuple, decontamination.hits(few, items, broadcast_rows=k).collect())) for k in (0, decontamination.BROADCAST_ROWS))
    assert a == b and a


def test_short_and_single_word_items(spark, docs):
    items = spark.createDataFrame([(1, "Stop"), (2, "two words"), (3, " ".join(map(str, range(12))))], "item_id bigint, text string")
    d = docs([(1, "please STOP now"), (2, "two  words, stop"), (3, "x " + ".".join(map(str, range(11)))), (4, "two word s"), (5, "École stop"), (6, "école")])
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(d, items).collect()}
    assert got == {1: (1, ["1"]), 2: (3, ["1", "2"]), 3: (11, ["3"]), 4: (0, []), 5: (1, ["1"]), 6: (0, [])}


def test_fingerprints(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.queries()["op3_fingerprints"](spark, sf).collect()}
    ids, off, same = sorted(texts), [], collections.defaultdict(set)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - k] + texts[nxt][:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t.lower()), shingles(edited.lower())
        if len(a) > 20:
            off.append(abs(len(a & b) / len(a | b) - got[i]["near_edited"]))
        same[t].add(got[i]["fingerprint"])
    assert sum(off) / len(off) < 0.05 and all(len(f) == 1 for f in same.values())


def test_successors_wrap_around(spark):
    keys = [-(1 << 62), -5, 0, 1, 65_535, 65_536, 1 << 40, (1 << 62) + 3]
    got = {r["k"]: r["next"] for r in fingerprints.successors(spark.createDataFrame([(k,) for k in keys], "k bigint")).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


def test_jaccard_links_are_those_of_brute_force(spark, docs):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 40)):
            w = b.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(60)] = f"x{rng.randrange(9)}"
            rows.append(" ".join(w))
    rows += rows[:5] + ["", "!!", "one", "one"]
    got = {r["doc_id"]: r for r in jaccard.join(docs(list(enumerate(rows)))).collect()}
    first = {t: rows.index(t) for t in rows}
    sets = {t: shingles(t) for t in first}
    near = {t: [u for u in first if u != t and sets[t] and len(sets[t] & sets[u]) / len(sets[t] | sets[u]) >= 0.8] for t in first}
    for i, t in enumerate(rows):
        seen, todo = {t}, [t]
        while todo:
            fresh = [u for u in near[todo.pop()] if u not in seen]
            seen.update(fresh)
            todo += fresh
        assert got[i]["n_links"] == len(near[t]) and got[i]["text_id"] == first[t] and got[i]["class_id"] == min(first[u] for u in seen)
    kept = jaccard.keep_one(docs(list(enumerate(rows)))).count()
    assert kept == len({r["class_id"] for r in got.values()})
    assert 1 - (1 - 0.8 ** jaccard.depth_for()) ** jaccard.TREES >= jaccard.RECALL


def test_extraction(spark):
    page = '<html><head><title>T</title><style>x</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav><header>Site</header><div class="ad">Buy</div><article><h1>A&amp;B</h1><p>One<br>two <b>three</b><p>Four<ul><li>five</ul><aside>x</aside><div class="comments"><p>nice</div></article><div id="cookie-notice">ok</div><form>f</form><footer>c</footer></body></html>'
    plain_page = "<body><div class='menu'>m</div><div class='x1'><p>{}</p><p>more words of it</p></div><div><a href=1>l1</a> <a href=2>l2</a></div><p>All rights</p></body>"
    rows = [(1, "http://a.com/1", page)] + [(2 + i, f"http://b.com/{i}", plain_page.format("long text number %d " % i * 5)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "A&B\n\nOne two three\n\nFour\n\nfive"
    assert got[3] == " ".join(("long text number 1 " * 5).split()) + "\n\nmore words of it"


def test_wrappers_generalise():
    a, b = extraction.tree(["nav/ul/li", "article/h1", "article/p"]), extraction.tree(["article/h1", "article/p", "article/p", "footer"])
    both = extraction.merged(a, b)
    assert extraction.slots(both) == {"nav/ul/li", "article/h1", "article/p", "footer"}
    shown = extraction.expression(both)
    assert "(<nav>" in shown and ")?" in shown and "(<p> # </p>)+" in shown
    assert extraction.merged(both, a) == extraction.merged(both, both)


def extracted(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_places_in_the_wrapper_are_slots(spark):
    """The p before the table is the template's; the one after it has the same path and is text."""
    page = "<body><p>constant notice of the site</p><table><tr><td>a{0}</td></tr></table><p>main text {0} of this page</p></body>"
    got = extracted(spark, [("http://w.com/", page.format(i)) for i in range(6)])
    assert got[2] == "a2\n\nmain text 2 of this page"
    a, b = extraction.tree(["p", "table/td", "p"]), extraction.tree(["table/td", "p"])
    assert extraction.aligned(b, extraction.merged(a, b)) == ["table@1/td@0/#@0", "p@2/#@0"]


def test_minority_templates_and_copies_keep_their_text(spark):
    marked = [("http://m.com/", f"<article><p>story {i}</p></article>") for i in range(6)]
    plain_page = ("http://m.com/", "<div class='x'><p>page without an article</p></div>")
    large = [("http://t.com/", f"<div class='a'><p>{f'large template {i} ' * 40}</p></div>") for i in range(9)]
    small = ("http://t.com/", "<div class='b'><p>the other template</p></div>")
    copies = [("http://c.com/", "<div class='a'><h1>Title</h1><p>one copied text</p></div>")] * 9
    alone = [("http://c.com/", f"<div class='a'><h1>Title {i}</h1><p>text {i}</p></div>") for i in range(2)]
    pages = [*marked, plain_page, *large, small, *copies, *alone]
    got = extracted(spark, pages)
    assert got[0] == "story 0" and got[6] == "page without an article"
    assert got[16] == "the other template" and got[7] == " ".join(("large template 0 " * 40).split())
    assert got[17] == "Title\n\none copied text" and got[26] == "Title 0\n\ntext 0"


def test_pages_of_the_corpus(spark, sf):
    got = {r["page_id"]: r["text"] for r in queries.queries()["op5_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub("<br>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_edited_counts_are_those_of_encoding_anew(texts):
    encoder, rng = token_counts.Encoder(token_counts.load()), random.Random(3)
    alphabet = "ab '\n  1.é漢s　t's've12"
    for k in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) if k % 3 else texts[rng.randrange(len(texts))][:400]
        tree = token_counts.Counts(text, encoder)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 3, 9])), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 7])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == len(encoder.whole.encode_ordinary(text))


def test_stored_trees_take_further_edits(spark, docs):
    """Leaves that are stored and read again take edits without encoding the rest; they are the pre-tokens of the new text."""
    encoder = token_counts.Encoder(token_counts.load())
    texts = {i: f"some words, {i} numbers and  more of it's text " * 30 for i in range(5)} | {7: ""}
    kept, kind = token_counts.trees(docs(list(texts.items()))), "array<struct<start:int,stop:int,text:string>>"
    for batch in ("array(struct(10, 12, 'xy z'), struct(11, 11, '!!! a b c'))", "array(struct(10, 40, ''))", "null"):
        found = token_counts.edited(kept.selectExpr("doc_id", "text", "chars", "tokens", f"cast({batch} as {kind}) edits"))
        for r in found.collect():
            pieces = encoder.split.findall(r["text"])
            assert r["chars"] == [len(p) for p in pieces] and r["tokens"] == [encoder.size(p) for p in pieces]
            assert r["edited_tokens"] == sum(r["tokens"]) and r["n_encoded_again"] < 40
        kept = found.select("doc_id", "text", "chars", "tokens")


def test_counts_of_the_query_are_those_of_encoding_anew(spark, corpus):
    encoder = token_counts.Encoder(token_counts.load())
    rows = {r["doc_id"]: r for r in token_counts.with_edits(corpus).collect()}
    for r in token_counts.recount(token_counts.with_edits(corpus)).collect():
        text = rows[r["doc_id"]]["text"]
        assert (r["n_chars"], r["n_tokens"]) == (len(text), len(encoder.whole.encode_ordinary(text)))
        for e in rows[r["doc_id"]]["edits"]:
            start = min(e["start"], len(text))
            text = text[:start] + e["text"] + text[max(start, min(e["stop"], len(text))) :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(text), len(encoder.whole.encode_ordinary(text)))


def test_base_spans_are_those_of_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(2)
    for k in range(6000):
        text = "".join(rng.choice("a1.@-+ 2b3()4é" if k % 2 else "1.2 3-+4") for _ in range(70))
        want = [("email", *m.span()) for m in email.finditer(text)] + [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [s[:3] for s in pii.spans(text) if s.kind in pii.BASE] == sorted(want, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_checks_and_context():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487") and pii.mod97("GB82 WEST 1234 5698 7654 32")
    kinds = [s.kind for s in pii.spans("ssn 123-45-6789, again 123-45-6789 far away from any such word; iban GB82 WEST 1234 5698 7654 32")]
    assert kinds[0] == "national_id" and "iban" in kinds
    assert pii.redact("to me@x.org!") == "to [EMAIL]!" and pii.redact(None) is None
    assert len(pii.spans("1" * 50_000 + "a" * 50_000 + "@")) == 0


def test_language_model_is_its_definition(corpus, texts):
    got = {r["doc_id"]: r for r in language_model.score(corpus).collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in [*t.encode().lower().split(), "end"])
    total, kinds = sum(count.values()), len(count)
    order = language_model.ORDER
    pad = bytes([255]) * order
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        b = pad + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for j in range(order + 1):
                seen[j][b[i - j : i]][b[i]] += 1

    def ppm(text):
        b, out = pad + text.encode() + b"\xff", 0.0
        for i in range(order, len(b)):
            gone: set = set()
            for j in range(order, -1, -1):
                if not (c := seen[j].get(b[i - j : i])):
                    continue
                rest = {s: n for s, n in c.items() if s not in gone}
                if b[i] in c:
                    out += math.log10(c[b[i]] / (sum(rest.values()) + len(rest)))
                    break
                if rest:
                    out += math.log10(len(rest) / (sum(rest.values()) + len(rest)))
                gone = set(c)
            else:
                out -= math.log10(256 - len(gone))
        return out

    for i in list(texts)[:25]:
        t, r = texts[i], got[i]
        tokens = [*t.encode().lower().split(), "end"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(ppm(t), rel=1e-9)


def test_pruned_models_still_sum_to_one(corpus):
    import numpy as np

    trie = language_model.fit(corpus, kept=500)
    for context in (b"ation", b"\xff" * 5, b"qqqqq"):
        code = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.int64)
        assert (10 ** trie.log10(code)).sum() == pytest.approx(1.0)


def test_scores_leave_no_rare_bytes_out(corpus):
    """What is broadcast bounds memory only: a tiny share of the n-grams gives the same scores."""
    a, b = ({r["doc_id"]: r for r in language_model.score(corpus, kept=k).collect()} for k in (50, language_model.KEPT))
    assert a.keys() == b.keys() and all(a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-9) for i in a)


def test_class_models_are_kneser_ney_by_brute_force(spark):
    """Ratios of two spelled class models, counted and smoothed here in plain loops."""
    rng = random.Random(11)
    stems, bad = ["pla", "tor", "mi", "sen", "ka", "lu"], ["grob", "zwik"]
    made = lambda y: " ".join(rng.choice(bad) + rng.choice(stems) if y and rng.random() < 0.3 else "".join(rng.choices([*stems, chr(rng.randrange(97, 123))], k=2)) for _ in range(30))
    rows = [(made(y), y) for y in (0, 1) for _ in range(30)]
    got = {r["gram"]: r["ratio"] for r in toxicity.ratios(spark.createDataFrame(rows, "text string, y int")).collect()}
    n, per = collections.defaultdict(lambda: [0, 0]), [[], []]
    for text, y in rows:
        own = collections.Counter(g for w in {w.encode() for w in words(text)} for g in toxicity.grams(w))
        per[y].append(own)
        for g, k in own.items():
            n[g][y] += k

    def discount(counts):
        once, twice = (sum(c == k for c in counts) for k in (1, 2))
        return max(0.1, min(1.0, once / (once + 2 * twice))) if once + twice else 1.0

    d = discount([c for v in n.values() for c in v])
    tails = {g[-k:] for g in n for k in range(2, len(g) + 1)}
    lower = collections.Counter(t[1:] for t in tails)
    low_d = discount(lower.values())

    def shared(g):
        p = 1 / (1 + sum(len(x) == 1 for x in lower))
        for k in range(1, len(g)):
            same = [c for x, c in lower.items() if len(x) == k and x[:-1] == g[-k:-1]]
            p = (max(lower[g[-k:]] - low_d, 0) + low_d * len(same) * p) / sum(same)
        return p

    def apart(g, total):
        p = (sum(n[g]) + 1) / (sum(total) + 2)
        error = 0
        for y in (0, 1):
            between = sum((o[g] - p * sum(k for x, k in o.items() if x[:-1] == g[:-1])) ** 2 for o in per[y]) / total[y] ** 2
            error += max(between, p * (1 - p) / total[y])
        return abs(n[g][1] / total[1] - n[g][0] / total[0]) / error**0.5

    total = {g: [sum(v[y] for x, v in n.items() if x[:-1] == g[:-1]) for y in (0, 1)] for g in n}
    away = {g: apart(g, total[g]) for g in n if min(total[g]) > 0}
    loud = {g for g, z in away.items() if z >= toxicity.APART}
    want = {g for g, z in away.items() if z >= toxicity.NEAR and any(g[i:j] in loud for i in range(len(g)) for j in range(i + 2, len(g) + 1))}
    assert got.keys() == want and any(g.startswith("\x01g") for g in got)
    for g in got:
        kinds = [sum(v[y] > 0 for x, v in n.items() if x[:-1] == g[:-1]) for y in (0, 1)]
        p = [(max(n[g][y] - d, 0) + d * kinds[y] * shared(g)) / total[g][y] for y in (0, 1)]
        assert got[g] == pytest.approx(math.log(p[1] / p[0]), rel=1e-9)


def test_votes_are_those_of_brute_force(spark):
    import numpy as np

    folder = "/root/testdata/sf0.001"
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(d, lab)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, lab).collect()}
    words, shapes = quality._Places(quality.WORDS), quality._Places(quality.SHAPES)
    for r in d.orderBy("doc_id").limit(40).collect():
        x = model.latent(quality.terms(r["text"], words, shapes)[None, :])[0].astype(float)
        near = sorted(((float(x @ v), -k) for k, v in enumerate(model.vectors.astype(float))), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0) ** 4 for s, _ in near]
        assert got[r["doc_id"]] == pytest.approx(sum(w * model.labels[-k] for w, (_, k) in zip(weight, near, strict=True)) / sum(weight), abs=1e-3)
    ties = quality.nearest(np.array([[1.0, 3.0, 2.0, 2.0, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]]), 3)
    assert ties.tolist() == [[1, 2, 3], [0, 1, 2]]


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_held_out_accuracy(spark, module):
    folder = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {"quality": quality, "toxicity": toxicity}[module].score(d, lab).join(lab, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    if module == "quality":
        assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    else:
        bad = [r for r in held if r["predicted"]]
        assert bad and all(r["toxic"] for r in bad) and len(bad) >= 0.5 * sum(r["toxic"] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.5 if module == "quality" else 0.3)) for r in got)


def test_sentencepiece_is_the_library(corpus, texts, docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    odd = {5001: "a  b\nc é 漢\U0001f600 x　y\t  ", 5002: " ", 5003: "     lead 12345 ab", 5004: "x" * 200, 5005: "      seven       "}
    want = {**texts, **odd}
    rows = corpus.select("doc_id", "text").unionByName(docs(list(odd.items())).select("doc_id", "text"))
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(rows, kept=300).collect()}
    assert all(got[i] == model.encode(t) for i, t in want.items())
    pieces = sentencepiece.load()
    back = sentencepiece.decode(sentencepiece.encode(rows), "doc_id", pieces)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: "▁" + t.replace(" ", "▁") for i, t in want.items() if t}
    a, b = ({r["doc_id"]: tuple(r) for r in sentencepiece.summarize(rows, kept=k).collect()} for k in (300, 1 << 18))
    assert a == b and all(r[4] for r in a.values()) and all(a[i][2] == len(got[i]) for i in got)


def test_summaries_are_of_the_ids_of_whole_documents(docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    step = 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    texts = {1: "a plain text of words, é 漢", 2: "a literal ▁ is lost", 3: "  two  spaces ", 4: "", 5: "a plain text of words"}
    for kept in (0, 1 << 18):
        got = {r["doc_id"]: r for r in sentencepiece.summarize(docs(list(texts.items())), kept=kept).collect()}
        for i, t in texts.items():
            ids = model.encode(t)
            total = sum(mixed(k + step) * pow(step, at, 1 << 64) for at, k in enumerate(ids)) % (1 << 64)
            assert (got[i]["n_pieces"], got[i]["ids_digest"]) == (len(ids), total - (1 << 64) * (total >> 63))
            assert got[i]["round_trip"] == (model.decode(ids) == t) == ("▁" not in t)


def test_whole_documents_are_decoded(docs, monkeypatch):
    """The decoded texts are the library's; a segment in another's place is seen, though each decodes to its own unit."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = {1: "a plain text of words, é 漢", 2: "a literal ▁ is lost", 3: "  two  spaces ", 4: "", 5: "rarely zqxv wjkp meets zqxv", 6: " ", 7: None}
    read = sentencepiece.text_digest
    for kept in (0, 3, 1 << 18):
        got = {r["doc_id"]: r for r in sentencepiece.summarize(docs(list(texts.items())), kept=kept).collect()}
        assert {i: r["decoded_digest"] for i, r in got.items()} == {i: read(model.decode(model.encode(t or "")).encode()) for i, t in texts.items()}
        assert {i for i, r in got.items() if not r["round_trip"]} == {2}
    prepared = sentencepiece._prepared

    def swapped(*args):
        known, fill, shared = prepared(*args)
        ids = lambda x, k: F.get(F.col("fill"), F.size("fill") - 1 - k)["ids"]
        return known, fill.withColumn("fill", F.transform("fill", lambda x, k: x.withField("ids", ids(x, k)))), shared

    monkeypatch.setattr(sentencepiece, "_prepared", swapped)
    got = sentencepiece.summarize(docs([(1, "one two three four"), (2, "same")]), kept=0).collect()
    assert {r["doc_id"]: r["round_trip"] for r in got} == {1: False, 2: True}


def test_long_units_are_the_library_s(spark):
    from sentencepiece import SentencePieceProcessor

    model, pieces = SentencePieceProcessor(model_file=sentencepiece.MODEL), sentencepiece.load()
    rng = random.Random(8)
    letters = [p for p, _, _ in pieces.table if len(p) > 1 and sentencepiece.SPACE not in p]
    texts = ["=" * 1_000_000, "ab" * 5_000, " " * 333 + "x" + "-" * 77, "".join(rng.choices(letters, k=300))]
    texts += ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(rows).collect()}
    assert all(got[i] == model.encode(t) for i, t in enumerate(texts))
    cut = pieces.cutter()
    units = cut("a word " * 200_000)
    assert "".join(units) == "▁" + "a▁word▁" * 200_000 and set(units) == set(cut("a word a "))


def test_best_paths_are_those_of_brute_force(spark):
    table = [("▁a", 300, -1.0), ("b", 301, -2.0), ("ab", 302, -0.5), ("▁", 303, -1.5), ("a", 304, -1.1), ("bb", 305, -3.5), ("▁ab", 306, -1.9)]
    pieces = sentencepiece.Pieces(table, 3, False)
    units = ["▁a", "▁ab", "▁abb", "abab", "▁bba"]
    got = {r["unit"]: r["ids"] for r in sentencepiece.segment(spark.createDataFrame([(u, 1) for u in units], "unit string, n bigint"), pieces).collect()}
    score, number = {p: s for p, _, s in table}, {p: i for p, i, _ in table}

    def best(u):
        return max(((score[u[:k]] + s, [number[u[:k]], *ids]) for k in range(1, len(u) + 1) if u[:k] in score for s, ids in [best(u[k:])]), default=(0.0, []) if not u else (-1e9, []))

    assert {u: best(u)[1] for u in units} == got


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = p.run(spark, sf).collect()
    kept = {r["doc_id"] for r in got}
    clean = {r["doc_id"] for r in decontamination.contamination(d, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if not r["contaminated"]}
    assert kept <= clean and len(kept) > 0.5 * d.count() and all(len(r["ids"]) == r["n_pieces"] for r in got)


def test_names_inside_articles_do_not_drop_their_text(spark):
    page = "<article><div class='comment-policy'>on policy</div><p class='notice-text'>text</p><div class='share-price'>price</div><section class='header'>head</section><div class='comments'><p>nice</p></div><ul class='share'><li>x</li></ul></article>"
    wrap = "<div class='page-header-wrap'><div><p>all of it {0}</p><p>and more {0}</p></div></div>"
    got = extracted(spark, [("http://n.com/", page), *[("http://o.com/", wrap.format(i)) for i in range(3)]])
    assert got[0] == "on policy\n\ntext\n\nprice\n\nhead"
    assert got[2] == "all of it 1\n\nand more 1"


def test_deep_and_wide_pages(spark):
    rng = random.Random(4)
    deep = "".join(f"<div>t{i} " for i in range(5_000))
    mixed = "".join(f"<{t} class=c{i % 7}>m{i}</{t}>" for i in range(4_000) for t in ["section" if i % 3 else "table"])
    pairs = "<dl>" + "".join(f"<dt>k{i}</dt><dd>v{i}</dd>" for i in range(20_000)) + "</dl>"
    odd = lambda: "".join(f"<{t}>{t}{i}</{t}>" for i in range(5_000) for t in [rng.choice(["p", "h2", "table", "blockquote", "ul"])])
    pages = [("http://d.com/1", deep), ("http://d.com/2", mixed), ("http://e.com/1", pairs), ("http://e.com/2", pairs + "<p>x</p>"), ("http://f.com/1", odd()), ("http://f.com/2", odd())]
    got = extracted(spark, pages)
    # what stands beside the element that holds most of the text is not part of it
    assert got[0].endswith("\n\n".join(f"t{i}" for i in range(64, 5_000))) and got[2] == "\n\n".join(f"{x}{i}" for i in range(20_000) for x in "kv")
    assert len(got[1]) > 10_000 and len(got[4]) > 10_000
    groups = extraction.tree(["dl/dt", "dl/dd"] * 5)
    assert extraction.expression(groups) == "<dl> (<dt> # </dt>)+ (<dd> # </dd>)+ </dl>"


def test_without_its_wrapper_a_page_keeps_the_template(spark):
    """What pages of a host share is known from their alignment only: one page alone can't tell it."""
    page = "<body><p>About this site and its makers</p><table><tr><td>cell {0}</td></tr></table><p>text {0} of the page</p></body>"
    many = extracted(spark, [("http://w.com/", page.format(i)) for i in range(6)])
    one = extracted(spark, [("http://w.com/", page.format(2))])
    assert many[2] == "cell 2\n\ntext 2 of the page" and one[0] == "About this site and its makers\n\n" + many[2]


def test_wrappers_decide_on_pages_with_articles_too(spark):
    """In articles, too, the host's wrapper tells the template: links that its pages share go, one page's links and shared text stay."""
    page = "<nav><a href=/>Home</a></nav><article><h1>Title {0}</h1><p>as in all our reports</p><p class='go'><a href=1>Share</a> <a href=2>Print</a></p><p>story {0}</p></article><p>words outside {0}</p>"
    own = "<article><p><a href=1>only a link</a></p></article>"
    shared = [("http://s.com/", f"<article><p><a href=1>All that is here</a></p></article><p>beside {i}</p>") for i in range(6)]
    got = extracted(spark, [*[("http://a.com/", page.format(i)) for i in range(6)], ("http://b.com/", own), *shared])
    assert got[2] == "Title 2\n\nas in all our reports\n\nstory 2" and got[6] == "only a link" and got[9] == "All that is here"
    mixed = extracted(spark, [("http://c.com/", "<article><p>one</p><p class='comment'>nice</p><p>two</p></article>")])
    assert mixed[0] == "one\n\ntwo"


def test_every_structure_has_its_rules(spark, sf, monkeypatch):
    """The given pages all have an article; their slots are decided with their hosts' wrappers all the same."""
    found, rules = [], extraction.rules
    monkeypatch.setattr(extraction, "rules", lambda parsed: found.append((parsed, rules(parsed))) or found[0][1])
    extraction.extract(spark.read.parquet(f"{sf}/pages.parquet"))
    parsed, kept = found[0]
    assert kept.count() == parsed.select("host", "key").distinct().count() > 0


def test_pipeline_on_edge_rows(spark, docs, labels, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows, clashing columns; and empty tables."""
    import corpus_pipeline as p
    from test_edges import EDGES

    folder = str(tmp_path)
    items = spark.createDataFrame([(1, "b c d"), (2, None)], "item_id bigint, text string")
    for name, df in {"documents": docs([*EDGES, (8, "mail me@x.org")]), "labels": labels([(None, 1, 1)]), "benchmark": items}.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    got = {r["doc_id"]: r["n_pieces"] for r in p.run(spark, folder).collect()}
    # of the empty texts 0 and 1 that of the least id stays, 3 holds a benchmark item
    assert set(got) == {0, 2, 4, None, 5, 6, 8} and got[0] == 0
    empty = str(tmp_path / "empty")
    for name, df in {"documents": docs([]), "labels": labels([]), "benchmark": items.limit(0)}.items():
        df.write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, empty).count() == 0


def test_pipeline_hands_texts_to_workers_in_small_batches(spark, docs, tmp_path, monkeypatch):
    """However many rows a partition has: a batch is held by the JVM and by its Python worker at once."""
    import corpus_pipeline as p

    sets = jaccard._sets

    def measured(batches):
        def small(batches):
            for batch in batches:
                if batch.nbytes > 2 * most:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return sets(small(batches))

    most = p.BATCH
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    rows = [(2 * i + k, f"head {i} " + "a b c d e f g h i j " * 300 + "tail " * k) for i in range(1_500) for k in (0, 1)]
    monkeypatch.setattr(jaccard, "_sets", measured)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert p.keep_one_of_a_kind(spark, docs(rows).coalesce(1), str(tmp_path)).count() == 1_500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.set(limit, before)


def test_pieces_start_no_python_workers(spark):
    """The piece table is a local table of the plan, not an RDD that Python workers pickle."""
    pieces = sentencepiece.load()
    for frame in (pieces.frame(spark), pieces.bytes_frame(spark)):
        assert "LocalRelation" in frame._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in pieces.frame(spark).collect()] == pieces.table


def test_words_of_a_task_are_forgotten():
    known = jaccard._Words()
    got = [known[f"w{i}".encode()] for i in range(150_000)]
    assert len(known) <= jaccard.WORDS and len(set(got)) == 150_000 and known[b"w7"] == got[7]
