"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attestra.llm import decontamination, extraction, fingerprints, jaccard, language_model, pii, quality, sentencepiece, token_counts, toxicity

EDGES = [(0, None), (1, ""), (2, "one"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "word " * 20_000), (None, "no id here at all"), (5, "...!?"), (6, "été 漢字 \U0001f600")]


def operators(spark, labels):
    none = labels([])
    items = spark.createDataFrame([(1, "b c d"), (2, None), (3, "")], "item_id bigint, text string")
    return {
        "quality": lambda d: quality.score(d, none),
        "decontamination": lambda d: decontamination.digest(decontamination.contamination(d, items)),
        "fingerprints": lambda d: fingerprints.digest(fingerprints.fingerprints(d)),
        "jaccard": jaccard.join,
        "token_counts": lambda d: token_counts.recount(token_counts.with_edits(d)),
        "pii": pii.digest,
        "language_model": language_model.score,
        "toxicity": lambda d: toxicity.score(d, none),
        "sentencepiece": sentencepiece.summarize,
    }


@pytest.mark.parametrize("name", ["quality", "decontamination", "fingerprints", "jaccard", "token_counts", "pii", "language_model", "toxicity", "sentencepiece"])
def test_every_row_comes_back_and_empty_tables_stay_empty(spark, docs, labels, name):
    run = operators(spark, labels)[name]
    got = run(docs(EDGES)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in EDGES)
    threes = [r for r in got if r["doc_id"] == 3]
    drop = ("near_next", "edited_sha256", "edited_fingerprint", "near_edited", "row")
    assert len({tuple((k, str(v)) for k, v in r.asDict().items() if k not in drop) for r in threes}) == 1
    assert run(docs([])).count() == 0


@pytest.mark.parametrize("stage", ["toxicity", "jaccard", "decontamination", "pii"])
def test_stages_keep_the_columns(spark, docs, labels, stage):
    d, none = docs(EDGES), labels([])
    items = spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    done = {"toxicity": lambda: toxicity.keep_clean(d, none), "jaccard": lambda: jaccard.keep_one(d), "decontamination": lambda: decontamination.keep_clean(d, items), "pii": lambda: pii.redacted(d)}[stage]()
    assert done.columns == d.columns
    left = sorted(str(r["doc_id"]) for r in done.collect())
    want = {"jaccard": 7, "decontamination": 7}.get(stage, 9)
    assert len(left) == want and done.filter(F.col("text").isNull()).count() <= 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/x", None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "http://b/", "<nav>n</nav>")], "page_id bigint, url string, html string").withColumn("blocks", F.lit(1))
    assert sorted((r["page_id"], r["text"]) for r in extraction.extract(pages).collect()) == [(1, ""), (2, "x"), (2, "x"), (3, "")]
    assert extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_fitted_models_meet_edge_rows(spark, docs, labels, module):
    """With labels of both classes, on edge rows and on ids that occur twice, every row still gets a score."""
    told = [(100 + i, "a fine text of words" if i % 2 else "grob und zwik zwik words") for i in range(60)]
    d = docs([*EDGES, *told, *told[:5]])
    lab = labels([*[(i, i % 2, 1 - i % 2) for i, _ in told], (3, 1, 0), (3, 0, 1), (4, 1, 0), (0, 0, 0), (None, 1, 1), (7777, 1, 1)])
    got = module.score(d, lab).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in [*EDGES, *told, *told[:5]])
    assert all(0 <= r["score"] <= 1 for r in got) and module.score(docs([]), lab).count() == 0
    empty = {r["score"] for r in got if r["doc_id"] in (0, 1)}
    assert len(empty) == 1


def test_stages_return_columns_of_any_name(spark, docs, labels):
    """Also those that an operator might use inside."""
    names = ["__h", "h", "H_", "node", "n_links", "text_id", "score_", "spans", "root", "items"]
    d = docs(EDGES).selectExpr("*", *[f"cast(doc_id AS string) AS {n}" for n in names if n != "h"])
    items = spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    stages = [lambda x: toxicity.keep_clean(x, labels([])), jaccard.keep_one, lambda x: decontamination.keep_clean(x, items), pii.redacted]
    for stage in stages:
        done = stage(d)
        assert done.columns == d.columns
        assert all(r["__h"] == (None if r["doc_id"] is None else str(r["doc_id"])) == r["H_"] for r in done.collect())


PAGES = {
    "comments in articles of their own": (
        "<article><h1>Title</h1><p>story</p></article><section class='responses'><article class='comment'><p>nice post</p></article>"
        "<article class='hentry reply' id='c2'><p>me too</p></article></section>", "Title\n\nstory"),
    "comments inside the article": ("<article><p>story</p><section><article class='comment'><p>nice</p></article></section></article>", "story"),
    "an opinion piece named comment is all there is": ("<article class='comment'><p>I think so.</p></article>", "I think so."),
    "an article below seventy elements": ("<p>before</p>" + "<div>" * 70 + "<article><p>deep story</p></article>" + "</div>" * 70 + "<p>after</p>", "deep story"),
    "a form around the page": ("<form><div>menu</div><article><p>story</p><form><p>your mail</p></form></article><p>below</p></form>", "story"),
    "a form beside the text": ("<form><p>search here</p></form><p>story</p>", "story"),
}


def test_articles_comments_and_forms(spark):
    rows = [(i, f"http://h{i}/", html) for i, (html, _) in enumerate(PAGES.values())]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {name: got[i] for i, name in enumerate(PAGES)} == {name: want for name, (_, want) in PAGES.items()}


def edited(rows, order):
    """n_chars and the digest of the edited text of each row, rows in the order of their ids, then of their texts."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, order(r[0])) if r[0] is not None else (False, order(None)), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        out.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["string", "decimal(25,2)", "double", "date", "int", "bigint"])
def test_fingerprints_follow_ids_of_any_type(spark, kind):
    rng = random.Random(9)
    numbers = rng.sample(range(-50, 900), 40)
    rows = [(n, " ".join(rng.choices(["one", "two", "été", "four", "x"], k=rng.randrange(30)))) for n in numbers]
    df = spark.createDataFrame(rows, "n int, text string")
    made = {"string": "concat('a-', n)", "decimal(25,2)": "cast(n * 10000000000000000000.25BD AS decimal(25,2))", "double": "n / 7D", "date": "date_add(date'2020-01-01', n)"}
    df = df.selectExpr(f"{made.get(kind, f'cast(n AS {kind})')} AS doc_id", "text")
    got = fingerprints.digest(fingerprints.fingerprints(df)).collect()
    want = edited([(r["doc_id"], r["text"]) for r in df.collect()], lambda v: v)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == want


def test_many_rows_without_an_id_are_spread(spark):
    texts = [f"text number {k} of those without an id" for k in range(3000)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(5, "five words stand in here"), (6, "x")], "doc_id bigint, text string")
    buckets = fingerprints.placed(df).groupBy(F.shiftright("at", fingerprints.BUCKET_BITS)).count().agg(F.max("count")).first()[0]
    assert buckets <= 1 << fingerprints.BUCKET_BITS
    got = fingerprints.digest(fingerprints.fingerprints(df)).collect()
    want = edited([(None, t) for t in texts] + [(5, "five words stand in here"), (6, "x")], lambda v: v or 0)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == want


def test_wrappers_find_the_articles_of_given_pages(spark, sf):
    """Without article elements the hosts' wrappers decide; they find the same texts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)article\b", "<$1div"))
    assert bare.filter(F.col("html").contains("<article")).count() == 0
    of = lambda df: {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    assert of(bare) == of(pages)
