import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscan.llm import bpe, html_extract, importance, quality_rules, toxicity
from ledgerscan.llm.html_extract import Page, tags_of
from ledgerscan.llm.queries import tokenizer_path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.01"

# -- 6 -------------------------------------------------------------------------------------------

ARTICLE = "The council met on Monday. " * 6
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page-12">
<header><a href="/">Site</a></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="sidebar"><p>{ARTICLE}</p></div>
<div class="main-7"><h1>Head &amp; line</h1><p>{ARTICLE}<br>more&nbsp;text<p>Second <b>bold <a href=x>link</a>
 text<ul><li>one<li>two</ul><script>var a="</p>";</script><form><input>Sign</form><div class="ad">Buy</div>
<p title="a > b">Last</p><section id="comments"><p>{ARTICLE}</p></section></div><footer>&copy; us</footer>"""


def test_main_text_of_a_page():
    text = html_extract.Page(PAGE).extract(None)
    assert text.split("\n") == ["Head & line", ARTICLE.strip() + " more text", "Second bold link text", "one", "two", "Last"]


def test_hosts_agree_on_a_path(spark):
    link = "<p><a href=x>" + "related reading " * 40 + "</a></p>"
    short = PAGE.replace(ARTICLE, "Short. ").replace('<div class="sidebar">', f'<div class="extra"><p>{ARTICLE}</p>{link}</div><div class="sidebar">')
    rows = [(k, f"https://Example.org:8080/{k}", PAGE.replace("main-7", f"main-{k}")) for k in range(5)]
    rows += [(10, None, None), (11, "https://example.org/x", ""), (12, "no url", "plain & simple"), (13, "http://other.org/", "<p>a<p>b</div></p>c")]
    rows.append(rows[0])
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()}
    assert all(found[k][0].startswith("Head & line\n") and found[k][1] == len(found[k][0]) for k in range(5))
    assert found[10] == found[11] == ("", 0)
    assert found[12][0] == "plain & simple" and found[13][0] == "a\nb\nc"
    assert html_extract.extract_pages(pages).count() == len(rows)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    assert html_extract.Page(short).extract(None) != ""


def test_nothing_of_an_article_is_dropped(spark):
    text = lambda word, letters: (f"{word} words here. " * letters)[:letters].strip()
    lead, body, more = text("lead", 300), text("body", 1000), text("more", 400)
    pages = {
        "lead": f"<article><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p></div></article>",
        "deep": f"<article><h1>Title</h1><p>{lead}</p><div class=wrap><div class=in><div class=body><p>{body}</p></div></div></div></article>",
        "parts": f"<article><h1>Title</h1><section class=one><p>{body}</p></section><div class=two><p>{more}</p></div></article>",
        "above": f"<h1>Title</h1><article><p>{body}</p></article>",
        "post": f"<div class=post><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p></div></div>",
    }
    whole = {"lead": (lead, body), "deep": (lead, body), "parts": (body, more), "above": (body,), "post": (lead, body)}
    nav = "<nav><a href=x>Elsewhere</a></nav><div class=ad>Buy</div>"
    for k, page in pages.items():
        assert html_extract.Page(f"<body>{nav}{page}<footer>us</footer>").extract(None).split("\n") == ["Title", *whole[k]]
    stray = html_extract.Page(f"<body><article><h1>Title</h1><p>{body}</p></article><div>stray</div>")
    assert stray.extract(None).split("\n") == ["Title", body]
    # most pages of the host have only the body
    flat = f"<body>{nav}<article><div class=body><h1>Title</h1><p>{body}</p></div></article>"
    rows = [(k, "http://a.org/", flat) for k in range(3)] + [(9, "http://a.org/", f"<body>{nav}{pages['lead']}")]
    rows += [(20 + k, "http://b.org/", f"<body>{nav}{pages['parts']}") for k in range(3)]
    found = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = {r["page_id"]: r["text"].split("\n") for r in found}
    assert found == {0: ["Title", body], 1: ["Title", body], 2: ["Title", body], 9: ["Title", lead, body]} | {k: ["Title", body, more] for k in (20, 21, 22)}


# -- 7 -------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic", "quality").collect()
    good = [r for r in found if r["quality"] == 1]
    clean, toxic = [r["score"] for r in good if not r["toxic"]], [r["score"] for r in good if r["toxic"]]
    wins = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert wins > 0.97
    assert np.mean([r["predicted"] == r["toxic"] for r in good]) > 0.96
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


@pytest.mark.parametrize("size", [1 << 30, 24_000])
def test_every_labelled_row_is_fitted(spark, monkeypatch, size):
    """Words that only rows after the first 2,500 of a class have, by hash of their id, tell the class too."""
    monkeypatch.setattr(toxicity, "SHARD_BYTES", size, raising=False)
    ids = [r[0] for r in spark.range(8000).orderBy(F.xxhash64("id"), "id").collect()]
    labels, rows = [], []
    for y, common, rare in ((0, "calm", "plork"), (1, "rude", "zork")):
        own = ids[y::2]
        labels += [(i, y) for i in own]
        rows += [(i, f"some {common if k < 3200 else rare + str(k % 20)} words") for k, i in enumerate(own)]
        rows += [(10_000 + 100 * y + k, f"some {rare}{k} words") for k in range(20)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == len(rows)
    assert [found[10_000 + 100 * y + k]["predicted"] for y in (0, 1) for k in range(20)] == [0] * 20 + [1] * 20
    # however rows are cut
    one, two = (toxicity.fitted(d, k, "doc_id", "text", "toxic") for d, k in ((docs, labels), (docs.repartition(7, "text"), labels.repartition(3))))
    assert np.array_equal(one.dense, two.dense) and np.array_equal(one.embedding, two.embedding) and one.thresholds == two.thresholds


def test_shards_hold_all_rows_and_labels_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (2, "der die"), (3, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (3, None), (None, 1), (4, 5), (9, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "toxic")
    found = [x for batch in toxicity.shards(rows, 3).toArrow().to_batches() for x in toxicity.unpacked(batch)]
    texts = sorted((int(k), toxicity.NAMES[name], len(t)) for _, y, _, names, all_ in found for k, name, t in zip(y, names, all_, strict=True))
    assert texts == sorted([(k, "other", n) for k in (0, 1) for n in (2, 2, 0)] + [(1, "de", 2)])
    for y, share in ((0, 0.0), (1, 1.0)):
        assert toxicity.fitted(docs, labels.filter(f"toxic = {y}"), "doc_id", "text", "toxic") == share
    assert toxicity.fitted(docs, labels.limit(0), "doc_id", "text", "toxic") == 0.0


def test_scores_do_not_depend_on_company_and_bad_rows(spark):
    model = toxicity.Model()
    model.thresholds = {"": 0.1}
    known, tables = toxicity.Memory(toxicity.buckets_of, 100), model.tables()
    texts = [toxicity.words_of(t) for t in ("", "one", "one two", "the long text of many words " * 30)]
    together = model.logits(texts, tables, known)
    alone = np.array([model.logits([t], tables, known)[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    slow = [np.maximum(model._pooled(np.array([known[w] for w in t], np.int64).reshape(-1, 3))[0], 0) @ model.weights for t in texts]
    assert np.allclose(together, slow, atol=1e-4)
    rows = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "x", 1)], "doc_id long, text string, score int")
    assert toxicity.score_documents(rows, model).count() == 3
    assert {r["score"] for r in toxicity.score_documents(rows, toxicity.train([])).collect()} == {0.0}
    assert toxicity.score_documents(rows.limit(0), model).count() == 0


# -- 10 ------------------------------------------------------------------------------------------


def test_sample_is_the_top_k_of_weight_and_noise(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    k = round(importance.trusted_share(labels) * docs.count())
    found = importance.importance_sample(docs, good, k).collect()
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    assert [r["gumbel_key"] >= keys[k - 1] for r in found] == [r["kept"] for r in found]
    marked = {r["doc_id"]: r["kept"] for r in found}
    by = {q: [marked[r["doc_id"]] for r in labels.collect() if r["quality"] == q] for q in (0, 1)}
    assert np.mean(by[1]) > 0.95 and np.mean(by[0]) < 0.1


def test_sample_of_ties_and_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a b"), (None, "a b"), (4, "a b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    none = spark.createDataFrame([], "doc_id long")
    for k in (0, 2, 5, 9):
        kept = sum(r["kept"] for r in importance.importance_sample(docs, none, k).collect())
        assert min(k, len(rows)) <= kept <= min(k + 1, len(rows)) if k else kept == 0
    assert importance.importance_sample(docs.limit(0), none, 3).count() == 0


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    from brute import components, overlapping, sha, without_lines

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.quality_rules(docs, labels.filter("quality = 1").select("doc_id"))
    rows = [(r[0], r[1]) for r in judged.filter("kept").select("doc_id", "text").collect()]
    rows = [(i, v[0]) for i, v in without_lines(rows, 10).items()]
    groups = components(rows, 80, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _ in overlapping(rows, items)}
    library = bpe.tokenizer(tokenizer_path("word_bpe_49k.json")).library
    expected = []
    for i, t in rows:
        if i not in leaks:
            ids = library.encode(t, add_special_tokens=False).ids
            expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert found == sorted(expected)
    assert 0 < len(found) < docs.count()


def test_near_duplicates_are_told_apart_by_row(spark):
    import corpus_pipeline

    same, other = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = [(None, same), (1, same), (1, same), (None, same), (2, other), (2, same), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(found, key=str) == sorted([(1, same), (2, other), (None, None), (None, None)], key=str)


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    own = {"llr": F.lit("own"), "n_lines": F.lit("mine"), "kept": F.col("doc_id"), "component_id": F.lit(None).cast("int"), "__row": F.lit(3), "lang": F.lit("xx")}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns(own)
    given = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf)
        assert found.schema.simpleString() == docs.schema.simpleString()
        for r in found.collect():
            for c in ("llr", "n_lines", "kept", "component_id", "lang", "source"):
                assert r[c] == given[r.doc_id][c]


def test_stages_of_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    for rows in ([], [(None, None, "a"), (None, "", None), (1, None, "b"), (1, " \n ", "b"), (2, "x " * 60_000, "c"), (None, "x " * 60_000, "c")]):
        odd = spark.createDataFrame(rows, docs.schema)
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, odd, sf).collect()
            if name == "jaccard_join":
                assert len(found) == max(0, len(rows) - 1)  # the two long texts are one group
            elif name != "quality_rules":
                assert len(found) == len(rows)
            else:
                assert found == []  # fewer than 50 words, or the same ones again and again


def test_rows_are_numbered_alike_in_any_splits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").select("doc_id", "text")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        first = corpus_pipeline._with_rows(docs).agg(F.sum(F.xxhash64("doc_id", "__row").cast("decimal(38,0)")), F.countDistinct("__row")).first()
        spark.conf.set(key, "1m")
        again = corpus_pipeline._with_rows(docs).agg(F.sum(F.xxhash64("doc_id", "__row").cast("decimal(38,0)")), F.countDistinct("__row")).first()
    finally:
        spark.conf.set(key, before)
    assert first == again and first[1] == docs.count()


def test_tags_against_a_pattern():
    """Tags, comments and declarations as a backtracking pattern finds them, which takes quadratic time on broken pages."""
    pattern = re.compile(
        r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
    )
    pieces = ["<a ", "<b", "</a", ">", ' "', "'", "x", "<!--", "-->", "<!doctype", "< ", "/", "</", ' k="v>" ']
    rng = random.Random(5)
    for _ in range(5000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        expected = [
            (m.start(), m.end(), (m[1] or m[4] or "") == "/", (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in pattern.finditer(page)
        ]
        if not any(set(name) & set("'\"") for *_, name, _ in expected):  # a quote in a name: the pattern gives part of it back
            got = list(tags_of(page))
            if not any(set(name) & set("'\"") for *_, name, _ in got):
                assert got == expected, page


@pytest.mark.parametrize("piece", ['<a x="', "<p><b>", '<a ">" ', "<article>", "<div>", "</x><i>"])
def test_broken_pages_take_linear_time(piece):
    def seconds(n: int) -> float:
        began = time.process_time()
        Page(piece * n + "text").extract(None)
        return time.process_time() - began

    seconds(1_000)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.02)  # 8 times the page; quadratic time would be 64 times
