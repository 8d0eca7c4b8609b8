"""Collocations, line rules and ranked lexical search against plain code, on odd rows and planted cases."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import bytewords, collocations, lexical, linerules

from .conftest import SMALL


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# ------------------------------------------------------------------------------------------------ collocations
def plain_collocations(docs, least, kept=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = tuple(re.findall("[^ \t]+", piece))
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(words[i:i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        rows = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = max((n for q, n in counts.items() if len(q) > len(p) and n >= least
                          and any(q[i:i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer >= 80 * a:
                continue
            score, k, r, n = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), r, n))
        out += [(lang, i + 1, p.decode(), -a, r, n, total[lang], -s) for i, (s, a, p, r, n) in enumerate(sorted(rows)[:kept])]
    return sorted(out)


PHRASES = [("en", "New York is big. New York is New York, new york is new"), (None, "a b a b a b a b c"), ("en", None),
           ("en", ""), ("und", "a b\ta b, a b"), ("de", "ü ü ü ü ü ü"), ("de", "Ü ü\x0bü ü:ü ü"), ("fr", "x y z w v x y z w v x y z w"),
           ("fr", "x y z w v x y z w"), ("en", "is new york" * 40), ("en", "\x00 \x00 \x00 \x00")]


@pytest.mark.parametrize("least", [2, 3])
def test_collocations_of_odd_texts(spark, least):
    rows = PHRASES * 2
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, w1 int, phrase string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least).collect()))
    assert got == plain_collocations(rows, least)


def test_collocations_of_documents_and_of_none(spark, documents, no_docs):
    docs = documents.select("lang", "text")
    got = sorted(map(tuple, collocations.collocations(docs, 6, 50).collect()))
    assert got == plain_collocations([tuple(r) for r in docs.collect()], 6, 50) and len(got) > 50
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a. b c", ". a b"])
def test_windows_of_few_words(spark, text):
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    got = sorted(map(tuple, collocations.collocations(df, 1).collect()))
    assert got == plain_collocations([("en", text)], 1)


def test_few_bits_leave_counts_exact(spark, documents, monkeypatch):
    docs = documents.select("lang", "text")
    full = sorted(map(tuple, collocations.phrase_counts(docs, 8).collect()))
    monkeypatch.setattr(collocations, "HASH_BITS", 9)  # nearly every hash collides: hardly a window is cut
    assert sorted(map(tuple, collocations.phrase_counts(docs, 8).collect())) == full


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["Aé b", None, "", "  x", "no break", "日本 b"]
    got = bytewords.cut(pa.array(texts), collocations._BLANKS, collocations._BREAKS)
    vocabulary = got.vocabulary.to_pylist()
    assert [vocabulary[c] for c in got.codes] == ["aé", "b", "x", "no", "break", "日本", "b"]
    assert got.rows.tolist() == [0, 0, 3, 4, 4, 5, 5] and len(set(got.pieces)) == 4
    assert list(bytewords.slices(pa.array(["abc", "d", None, "efghij", "k"]), 4)) == [(0, 3), (3, 4), (4, 5)]


# ------------------------------------------------------------------------------------------------ line rules
def plain_figures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 2 * len(covered) > len(words))


def test_base_figures(spark, documents, odd_docs):
    for df in (documents, odd_docs):
        got = sorted(map(tuple, linerules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                           "n_repeat_words", "base_failed").collect()), key=str)
        assert got == sorted([(r["doc_id"], *plain_figures(r["text"])) for r in df.collect()], key=str)


@pytest.mark.parametrize("line,fails", [
    ("A sentence that ends as it should.", False), ("She said so.”", False), ("Over. And on it goes without an end", False),
    ("Ends in nothing at all", True), ("Home", True), ("Next page »", True), ("Home | News | Sport | More.", True),
    ("Buy!! Now!! Or never!!", True), ("Really?! Yes.", False), ("© 2020 Somebody.", True), ("All rights reserved.", True),
    ("Released under the MIT License.", True), ("これは文です。", False), ("word### other*** thing.&&&", True), ("Fin.\r", False)])
def test_lines(spark, line, fails):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(linerules.line_fails(F.col("x"))).first()[0] is fails


def test_documents_that_lose_too_much(spark, no_docs):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12))
    menu = "\n".join(f"Entry {i} | Part {i} | Side {i} | Rest {i}" for i in range(20))
    rows = [(1, good, "a", 1), (2, good + "\nHome\n\nAll rights reserved.", "b", 2), (3, good[:200] + menu, "c", 3), (4, None, None, None),
            (2, good + "\nHome\n\nAll rights reserved.", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, own int")
    assert sorted((r["doc_id"], r["kept"]) for r in linerules.judge(df).collect()) == [
        (1, True), (2, True), (2, True), (3, False), (4, False)]
    clean = sorted(map(tuple, linerules.cleaned(df).collect()))
    assert clean == [(1, good, "a", 1), (2, good + "\n", "b", 2), (2, good + "\n", "b", 2)]
    assert linerules.judge(no_docs).count() == 0 and linerules.cleaned(no_docs).columns == no_docs.columns


def test_no_shuffle_and_no_python(documents):
    plan = linerules.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))


# ------------------------------------------------------------------------------------------------ lexical search
TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def plain_ranking(docs, items, k):
    cut = [(d, re.findall(TERM, lower(t))) for d, t in docs if t is not None]
    cut = [(d, t) for d, t in cut if t]
    n, size = len(cut), sum(len(t) for _, t in cut)
    df = Counter(t for _, terms in cut for t in set(terms))
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(t, texts.get(i, t), key=str.encode)
    out = []
    for i, text in texts.items():
        rows = []
        for d, terms in cut:
            tf, m = Counter(terms), 75 + 25 * len(terms) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in re.findall(TERM, lower(text)) if tf[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block", [(20, 100_000), (3, 100_000), (2, 150)])
def test_ranking_of_odd_texts(spark, odd_docs, k, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)  # small blocks: the items are ranked in several passes
    rows = [(1, "one two two WORD é 日本"), (2, None), (3, "nothing there zzz"), (None, "five text İß"), (1, "a b c d"), (5, ""),
            (6, "x s endoftext as text " * 20), (7, "word")]
    items = spark.createDataFrame([(a, b, 1) for a, b in rows], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.ranked_documents(odd_docs, items, k).collect()), key=str)
    assert got == plain_ranking([(r["doc_id"], r["text"]) for r in odd_docs.collect()], rows, k)


@pytest.mark.parametrize("bucket,focus,first", [(1024, 8, 4096), (16, 1, 4)])
def test_ranking_of_documents(spark, documents, bucket, focus, first, monkeypatch):
    for name, value in (("BUCKET", bucket), ("FOCUS", focus), ("FIRST", first)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.read.parquet(os.path.join(SMALL, "benchmark.parquet")).select("item_id", "text")
    docs = documents.unionByName(documents.where("doc_id % 7 = 0"))  # repeated rows: ties
    got = sorted(map(tuple, lexical.ranked_documents(docs, items).collect()), key=str)
    assert got == plain_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()], 20)


def test_no_documents_or_items(spark, documents, no_docs):
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert lexical.ranked_documents(no_docs, items).count() == 0
    assert lexical.ranked_documents(documents, items.limit(0)).count() == 0


def test_bounds_rule_buckets_and_vectors_out():
    import pyarrow as pa
    from pyspark.sql import Row

    items = lexical.Items([Row(item_id=1, text="a b c")])
    terms = {t: i for i, t in enumerate(items.terms.to_pylist())}
    doc = np.arange(6)
    vectors = [{"a": 90, "b": 80}, {"a": 85, "b": 70, "c": 5}, {"a": 30}, {"b": 25}, {"c": 20}, {"c": 1}]
    cuts = np.cumsum([0, *map(len, vectors)])
    ids = np.array([terms[t] for v in vectors for t in v])
    impact = np.array([x for v in vectors for x in v.values()], np.int64)
    length = np.sqrt([sum(x * x for x in v.values()) for v in vectors])
    best = [lexical._Best(2, 150)]
    rescored = lexical.search_bucket(items, np.array([3 ** 0.5]), best, doc, doc < 0, length, cuts, ids, impact)
    assert rescored == 2 and best[0].doc.tolist() == [0, 1] and best[0].score.tolist() == [170, 160]
    assert lexical.search_bucket(items, np.array([3 ** 0.5]), best, doc, doc < 0, length / 100, cuts, ids, impact) == 0
    assert isinstance(items.terms, pa.Array)
