"""Spelling repair against plain dynamic programming over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edits_of(word):
    return 0 if len(word) < 3 or any(c.isnumeric() for c in word) else 1 if len(word) <= 4 else 2


def brute(words, corpus, least=2):
    known, found = {w: n for w, n in corpus.items() if n >= least}, {}
    for w in words:
        if w in known or not edits_of(w):
            continue
        near = sorted((distance(w, k), -n, k) for k, n in known.items() if abs(len(k) - len(w)) <= 2)
        if near and near[0][0] <= edits_of(w):
            found[w] = (near[0][2], near[0][0])
    return found


def changed(draw, word, times):
    for _ in range(times):
        at = draw.randrange(len(word) + 1)
        kind = draw.randrange(4)
        if kind == 0:
            word = word[:at] + draw.choice("abcé") + word[at:]
        elif kind == 1:
            word = word[:at] + word[at + 1 :]
        elif kind == 2:
            word = word[:at] + draw.choice("abcé") + word[at + 1 :]
        elif at + 1 < len(word):
            word = word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    return word


@pytest.fixture(scope="module")
def words():
    """Short words over few letters, so that there are ties, and words about and above the border between the two ways."""
    draw = random.Random(11)
    corpus = {"".join(draw.choice("abcdé") for _ in range(n)): draw.randint(1, 5) for n in [*range(1, 9)] * 25 + [*range(16, 27)] * 12 + [90, 300]}
    asked = {changed(draw, draw.choice(sorted(corpus)), draw.randint(0, 3)) for _ in range(400)} | {changed(draw, w, 2) for w in corpus if len(w) > 17}
    return corpus, sorted(asked - {""}) + ["ab1cd", "zzzzzz"]


def test_equals_brute_force(spark, words):
    corpus, asked = words
    known = spark.createDataFrame(list(corpus.items()), "word string, n long")
    got = spelling.spelling_repairs(spark.createDataFrame([(w,) for w in asked + asked[:9] + [None]], "word string"), known).collect()
    want = brute(asked, corpus)
    assert {r.word: (r.repair, r.edits) for r in got} == want and len(got) == len(want)
    assert sum(len(w) > 20 for w in want) > 20 and sum(len(w) < 9 for w in want) > 50


def test_no_all_pairs_join(spark, words):
    corpus, asked = words
    known = spark.createDataFrame(list(corpus.items()), "word string, n long").filter("n >= 2")
    unknown = spark.createDataFrame([(w,) for w in asked], "word string")
    plan = spelling.spelling_repairs(unknown, known)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_texts(spark):
    docs = spark.createDataFrame([("Solid wooden table, solid wooden table",), ("glass table lamp; glass lamp",), (None,), ("",)], "text string")
    asked = [("a", "Wodden TABEL of glas"), ("b", ""), ("c", None), ("d", "tble tble 12cm lamp"), ("e", "xylophone")]
    got = spelling.repair_queries(spark.createDataFrame(asked, "query_id string, query_text string"), spelling.corpus_words(docs))
    assert {r.query_id: (r.search_text, r.n_repaired) for r in got.collect()} == {
        "a": ("wooden table of glass", 3), "b": ("", 0), "c": ("", 0), "d": ("table table 12cm lamp", 2), "e": ("xylophone", 0),
    }
    none = spelling.repair_queries(spark.createDataFrame(asked, "query_id string, query_text string"), spelling.corpus_words(docs.filter(F.lit(False))))
    assert none.filter("n_repaired > 0").isEmpty() and none.count() == 5
    assert spelling.repair_queries(spark.createDataFrame([], "query_id string, query_text string"), spelling.corpus_words(docs)).isEmpty()


def test_the_corpus_is_counted_once(spark):
    """What is returned reads written words: no plan branch cuts the documents into words again."""
    docs = spark.createDataFrame([("solid wooden table solid wooden table",)], "text string")
    got = spelling.spelling_repairs(spark.createDataFrame([("tabel",)], "word string"), spelling.corpus_words(docs))
    assert "split(" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.word, r.repair, r.edits) for r in got.collect()] == [("tabel", "table", 2)]
