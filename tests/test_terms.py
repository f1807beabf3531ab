"""Terms within documents in one pass: the same as by tables of terms, which are neither shuffled nor joined."""

import math
import re

import pytest
from pyspark.sql import functions as F

from florilege.operators import sentences, terms
from florilege.plans import catalog

ROWS = [
    (1, 0, "The cat eats cat fish and cat fish."),
    (1, 1, "A well- known- dog eats the cat's fish."),
    (1, 2, "Kelvin dogs can't eat İstanbul fish-and-chips."),
    (1, 3, ""),
    # Two documents of one id.
    (2, 0, "Birds sing loud songs."),
    (2, 0, "Loud birds sing birds songs in trees."),
    (2, 1, "Trees sing."),
    (2, 2, "Nothing alike here."),
    (3, 0, "Only one sentence stands here."),
    (None, 0, "Birds sing loud songs."),
    (None, 1, "Dogs don't."),
]


@pytest.fixture(scope="module")
def body(spark):
    return spark.createDataFrame(ROWS, "doc_id long, order int, text string").repartition(3)


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_summary_similarity(spark, body):
    tf = sentences.term_frequency(body)
    vocab = sentences.vocabulary(tf, body)
    value = {}
    for r in sentences.tfidf(tf, vocab).collect():
        value.setdefault((r.doc_id, r.order), {})[r.term] = r.value
    text = {1: ROWS[0][2] + " " + ROWS[3][2], 2: "Birds sing loud songs. Loud birds sing birds songs in trees."}
    table = spark.createDataFrame([(k, t) for k, t in text.items()], "doc_id long, text string")
    s = {}
    for r in sentences.tfidf(sentences.term_frequency(table.withColumn("order", F.lit(0))), vocab).collect():
        s.setdefault(r.doc_id, {})[r.term] = r.value
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    want = []
    for doc, order, _ in ROWS:
        a, b = value.get((doc, order), {}), s.get(doc, {})
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        want.append((str(doc), order, round(dot / (norm(a) * norm(b)) if dot else 0.0, 9)))
    assert sum(x[2] > 0 for x in want) >= 4
    for summaries in (table, F.col("order") % 3 == 0):
        out = sentences.sparse_summary_similarity(body, summaries)
        assert out.dtypes == [("doc_id", "bigint"), ("order", "int"), ("similarity", "double")]
        assert sorted((str(r.doc_id), r.order, round(r.similarity, 9)) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["sparse_summary_similarity", "centroid", "vocab_topk"])
def test_sentences_are_shuffled_once(spark, monkeypatch, name):
    monkeypatch.setattr(sentences, "SPLIT_BYTES", 0)  # as on a large table, whose texts are not dealt out before
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert exchanges(df) == 1 and not re.search("Join|Window|Aggregate", df._jdf.queryExecution().executedPlan().toString())


def test_centroid(spark, body):
    value = {}
    for r in sentences.vectors(body).filter("doc_id IS NOT NULL").collect():
        value[r.doc_id, r.term] = value.get((r.doc_id, r.term), 0) + r.value
    n = {1: 4, 2: 4, 3: 1}
    got = {(r.doc_id, r.term): round(r.value, 9) for r in terms.centroid(body).collect()}
    assert got == {k: round(v / n[k[0]], 9) for k, v in value.items()} and len(got) > 20


@pytest.mark.parametrize("most", [3, 16_000])
def test_vocabularies(body, most):
    def both(rows, *columns):
        old, new = sentences.vocabulary(sentences.term_frequency(rows), rows, most), terms.vocabularies(rows, most)
        a, b = ({tuple(r) for r in x.select("doc_id", *columns).collect()} for x in (old, new))
        assert a == b and len(a) >= 3

    both(body.filter("doc_id <> 2 OR doc_id IS NULL"), "term", "df", "n", "rank")
    if most > 3:  # where two documents share an id, terms share first places, and the order of those is open
        both(body, "term", "df", "n")
