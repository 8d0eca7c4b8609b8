"""HTML extraction, language ID, URL rules, mixing and the pipeline."""

import html
import os
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens.llm import htmltext, langid, mixing, urlrules
from churnlens.llm.common import quoted
from churnlens.llm.queries import ORACLE, QUERIES

from .conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title><body class="no-sidebar"><header><a href=/>Site</a></header>
<div id="menu"><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div>
<div class="cookie-notice">We use cookies, please accept, yes, sure, a long text here to win, yes, yes.</div>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1>
<p>First para, with commas, and text that is long enough to matter for the scoring of it.</p>
<p>Short.</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><blockquote>Quoted</blockquote>
<div class="ad">Buy, buy, buy</div><form>name <input></form><p>Last &eacute; para &#8212; ok<br>second
  line</p><script>var a = "<p>no</p>";</script></div>
<div class="sidebar"><p>Side, side, side text which is long and long and long, really long, honest.</p></div></div>
<section id="comments"><article class="comment"><p>I like it, really, so much, that I write this.</p></article>
</section><footer>foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert htmltext.main_text(PAGE).split("\n") == [
        "Title & more", "First para, with commas, and text that is long enough to matter for the scoring of it.",
        "Short.", "one", "two", "c1", "c2", "Quoted", "Last é para — ok second line"]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>x", "x"), ("<p>a<p>b</p></div>c", "a\nb\nc"),
    ("<p title='a>b'>q</p>", "q"), ("a < b and c > d", "a < b and c > d"), ("<!--x--><p>y</p><!-- <p>z", "y"),
    ("<script>var a='<p>no</p>'</script><p>yes", "yes"), ("<head><title>x</title><body><p>in, body", "in, body"),
    ("<article><header><h1>H</h1></header><p>Hello, there</article>", "H\nHello, there"),
    ("<p>a&nbsp;&lt;b&gt;</p>", "a <b>")])
def test_odd_pages(page, text):
    assert htmltext.main_text(page) == text


LONG = "".join(f"<p>Long one, number {i}, with commas, and with words enough to get points, many of them.</p>"
               for i in range(40))
PARTS = """<div><p>Lead of one paragraph.</p></div><section>%s</section><h3>Between</h3><ul><li>one</li><li>two</li></ul>
<ol><li>three</li></ol><table><tr><td>c1</td><td>c2</td></tr></table><figure><figcaption>Figure</figcaption></figure>
<section><p>Closing, first.</p><p>Closing, second.</p></section>""" % LONG


@pytest.mark.parametrize("page", [
    "<body><div id=menu>m</div><h1>T</h1><article>%s</article><div><a href=x>more</a></div></body>",
    "<body><main><h1>T</h1><div><article>%s</article></div></main><footer>f</footer></body>",
    "<body><main><h1>T</h1>%s</main><div><a href=x>more</a></div></body>",
    "<body><div><a href=x>more</a></div><div><h1>T</h1><div>%s</div></div></body>"])
def test_whole_article_with_nested_parts(page):
    got = htmltext.main_text(page % PARTS).split("\n")
    assert got[:2] == ["T", "Lead of one paragraph."]
    assert got[-9:] == ["Between", "one", "two", "three", "c1", "c2", "Figure", "Closing, first.", "Closing, second."]
    assert len(got) == 2 + 40 + 9


def test_hostile_pages_end_soon():
    for bad in ("<" * 50_000, "<p " * 20_000, "<!--" * 20_000, "<div>" * 50_000 + "deep, text", "<a '" * 20_000,
                "<b>" * 20_000 + "x", "<li>" * 3000, "&" * 50_000, "<b>" * 20_000 + "</i>" * 20_000,
                "<span>" * 5000 + "<li>" * 5000, "<i><table>" + "<b>" * 10_000 + "</i>" * 10_000, "<form>" * 10_000 + "x"):
        start = time.process_time()
        htmltext.main_text(bad)
        assert time.process_time() - start < 5


SAID = "".join(f"<p>Paragraph {i} of the text, which says something, and goes on about it, for a while.</p>" for i in range(4))


def test_page_in_one_form():
    said = [f"Paragraph {i} of the text, which says something, and goes on about it, for a while." for i in range(4)]
    page = "<body><form action=x><div id=menu><a href=a>A</a></div><div class=content>%s<form><input> go <p>Mail, please</p></form></div></form>"
    assert htmltext.main_text(page % SAID).split("\n") == said
    assert htmltext.main_text("<body><div>%s</div><form><p>Your name</p><input><label>Mail</label></form>" % SAID).split("\n") == said


@pytest.mark.parametrize("name,kept", [("share-price", True), ("notice-period", True), ("side-effects", True), ("share", False),
                                       ("share-buttons", False), ("side-bar", False), ("cookie-notice", False), ("comment-text", False),
                                       ("related-posts", False), ("social_history", True), ("top-nav", False)])
def test_names_inside_an_article(name, kept):
    got = htmltext.main_text(f"<body><article>{SAID}<div class='{name}'><p>Named part, of some length.</p></div>{SAID}</article>")
    assert ("Named part, of some length." in got.split("\n")) is kept and got.count("Paragraph") == 8


def test_extracted_pages(spark):
    pages = spark.read.parquet(os.path.join(SMALL, "pages.parquet"))
    got = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    for p in pages.collect():
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip()
                 for x in re.split("</?p>|</?h1>", inner)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    odd = spark.createDataFrame([(None, None, None, 1, "c"), (1, "u", "", 2, "d"), (1, "u", "", 2, "d")],
                                "page_id long, url string, html string, n_chars long, text string")
    assert sorted(map(tuple, htmltext.extract_pages(odd).collect()), key=str) == [
        (1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0)]
    assert htmltext.extract_pages(odd.limit(0)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 6, "en"))
    got = [tuple(r) for r in langid.identify(docs).collect()]
    assert len(got) == docs.count()
    assert all(r[2] == "und" and r[3] == 0 for r in got if r[0] in (2, 3, 4))
    assert all(r[2] == "en" for r in got if r[0] in (1, 5, 8))
    untaught = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    assert langid.identify(no_docs).count() == 0
    kept = langid.identified_documents(docs)
    assert kept.columns == docs.columns and {2, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())


def test_vectors_are_bound_and_bundled():
    p = langid.Profiler(64, 3, 1, cache_rows=10)  # a cache that overflows
    text = "the end, the beginning of things"
    codes = [0]
    for ch in text:
        c = int(p.codes[ord(ch)])
        if c or codes[-1]:
            codes.append(c)
    codes.append(0)
    rng = langid.np.random.default_rng(1)
    letters = rng.choice(langid.np.array([-1, 1], langid.np.int8), (langid.CODES, 64))
    want = sum(langid.np.roll(letters[a], 2) * langid.np.roll(letters[b], 1) * letters[c]
               for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (p.bundles([p.grams(text), p.grams("")])[0] == want).all()


def test_url_parts_and_listed_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://Ex.COM", "http://a.com/x?y#z", "https://example.com/en/1",
            "https://www.example.com/en/1", "https://m.www.example.com/en/", "https://x.net/es/", "https://net/fr/2",
            "ftp://xnet/fr/2", "http://a.net?u=http://b.com/c", "x://ÄB.net/en/Q#/es/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = urlrules.mine_rules(spark.createDataFrame([], "url string, blocked boolean"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("ex.com", "", None, "allow"), 5: ("a.com", "/x", "com/", "allow"),
        6: ("example.com", "/en/1", "example.com/en/", "block"),
        7: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        8: ("m.www.example.com", "/en/", "www.example.com/en/", "allow"), 9: ("x.net", "/es/", "net/es/", "block"),
        10: ("net", "/fr/2", "net/fr/", "block"), 11: ("xnet", "/fr/2", None, "allow"),
        12: ("a.net", "", None, "allow"), 13: ("Äb.net", "/en/Q", None, "allow")}


def test_mined_rules_block_planted_combinations(spark):
    rows = []
    for i in range(400):
        host, lang = ("cheap", "shop", "news")[i % 3], ("en", "de")[i % 2]
        rows.append((f"http://{host}.example.org/{lang}/{i}", host == "cheap" and lang == "de" or i % 40 == 0))
    rows += [("http://none.org/x/1", None)]
    rules = urlrules.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), 5, 0.9).collect()
    assert sorted(map(sorted, (r.antecedent for r in rules))) == [["h:cheap", "p:de"]]
    assert rules[0].confidence == 1.0
    pages = spark.createDataFrame([(1, "http://cheap.example.org/de/9?q=1"), (2, "http://cheap.example.org/en/9"),
                                   (2, "http://cheap.example.org/en/9"), (3, "https://de.cheap.org/de/")],
                                  "page_id long, url string")
    filed = spark.createDataFrame(rules)
    assert sorted((r.page_id, r.verdict) for r in urlrules.judge_urls(pages, filed).collect()) == [
        (1, "block"), (2, "allow"), (2, "allow"), (3, "block")]


def plain_targets(sizes, factor=1.5, most=2):
    """Excess reshared by weight until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), factor * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check_mix(docs, tolerance):
    got = mixing.mix(docs, bucket_rows=50).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    largest = max((r.size for r in got), default=0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance * want[s] + largest
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, mixing.mix(docs.repartition(5), bucket_rows=7).collect())) == sorted(map(str, got))


def test_mix(spark, documents, odd_docs, no_docs):
    check_mix(documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 != 0,
                                                                                          F.col("source"))), 0.02)
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0
    taken = mixing.mix(documents).agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed_documents(documents)
    assert mixed.count() == taken and mixed.columns == documents.columns


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_takes_part_of_repeated_rows(spark, doc_id):
    # one source of equal rows, one of rows with one id and different texts, one of plain rows
    rows = ([(doc_id, "same words here", "a", i) for i in range(300)]
            + [(doc_id, "w " * (1 + i % 9) + str(i), "b", i) for i in range(300)]
            + [(1000 + i, "other words", "c", i) for i in range(900)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(4)
    check_mix(docs, 0.02)
    got = mixing.mix(docs).collect()
    assert len({(r.source, r.copies) for r in got if r.source == "b"}) > 1
    short = [r.copies for r in got if r.source == "b" and r.size <= 3]
    assert len(set(short)) > 1  # shuffled, not shortest first
    everything = spark.createDataFrame([(doc_id, "a b c", "s")] * 400, "doc_id long, text string, source string")
    assert mixing.mix(everything).agg(F.sum("copies")).first()[0] == 600


def test_pipeline_decisions_take_effect(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "mix_sources", "packing"]
    empty = spark.createDataFrame([(10 ** 6, "12 34 !!", "en", "src1", 8), (10 ** 6 + 1, None, None, None, 0)],
                                  documents.schema)
    docs, trail = documents.unionByName(empty), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        trail.append(docs)
    first = {r.doc_id for r in trail[0].collect()}
    assert 10 ** 6 not in first and 10 ** 6 + 1 not in first
    assert len(first) >= 0.97 * documents.count()
    second = {r.doc_id for r in trail[1].collect()}
    assert second < first
    mixed = Counter(r.doc_id for r in trail[2].collect())
    assert set(mixed) <= second and max(mixed.values()) == 2
    pieces = trail[3].collect()
    assert {p.doc_id for p in pieces} == set(mixed)
    per_doc = Counter()
    for p in pieces:
        per_doc[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert per_doc == Counter({d: n * tokens[d] for d, n in mixed.items()})


def test_short_labelled_texts_stay(spark, documents):
    short = ["Avec.", "A.", "Oui", "Qx", "Zj.", "Xq", "kw", "Vz", "Jx.", "Yq"]
    rows = [(10 ** 6 + i, t, "fr", "src1", len(t)) for i, t in enumerate(short)]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()}
    assert {r[0] for r in rows} <= kept
    assert {r[0] for r in rows} - {r.doc_id for r in langid.identified_documents(docs, 0.05).collect()}


def test_texts_in_another_language_than_their_label_go(spark, documents):
    whole = max((r for r in documents.collect() if r.lang == "en"), key=lambda r: len(r.text)).text
    rows = [(10 ** 6 + i, whole, lang, "src1", len(whole)) for i, lang in enumerate(("en", "fr", None))]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    kept = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} & {r[0] for r in rows} == {10 ** 6, 10 ** 6 + 2}
    assert kept.columns == docs.columns


def test_registry():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


CLASHING = ["_id", "_hash", "_h", "source_no", "_key", "lasts", "score", "lang_pred", "size", "target", "copies", "taken", "_copy",
            "row", "key", "words_hash", "_s", "_n", "_t", "_size", "_parts", "part", "whole", "group", "fp", "a`b"]


def test_stages_return_clashing_columns_unchanged(spark, documents):
    own = [F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHING]
    docs = documents.select("*", *own)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == [*documents.columns, *CLASHING]
        wrong = [F.col(quoted(c)) != F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in CLASHING]
        counts = docs.agg(F.count("*").alias("n"), *[F.count_if(w).alias(f"w{i}") for i, w in enumerate(wrong)]).first()
        assert counts["n"] > 100 and not any(counts[1:])


def test_url_rules_need_more_than_chance(spark):
    """A planted combination is found; the same URLs with shuffled labels give (nearly) no rule."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        host, a, b = rng.choice(["aa.org", "bb.org", "cc.info"]), rng.choice(words), rng.choice(words)
        spam = host == "cc.info" and i % 5 == 0
        rows.append((f"https://{host}/{'casino' if spam else a}/{b}/{i}", spam or rng.random() < 0.2))
    fields = "url string, blocked boolean"
    found = urlrules.mine_rules(spark.createDataFrame(rows, fields)).collect()
    assert [r.antecedent for r in found] == [["p:casino"]]
    labels = [b for _, b in rows]
    rng.shuffle(labels)
    mixed = [(u, b) for (u, _), b in zip(rows, labels, strict=True)]
    assert urlrules.mine_rules(spark.createDataFrame(mixed, fields)).count() <= 1


def test_label_numbers_of_any_length(spark):
    big = 2 ** 63 - 1
    pages = spark.createDataFrame([(f"http://a/{big}",), (f"http://a/{big + 1}",), ("http://a/7.html",), (None,)],
                                  "url string")
    labels = spark.createDataFrame([(big, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urlrules.labelled_urls(pages, labels).collect())) == [
        ("http://a/7.html", False), (f"http://a/{big}", True)]
