"""Selection, layout, builder, sources, summaries, labels and annotations."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florilege.functions.config import DEFAULT_LABELS, Scoring, Settings, labels_file, parse_labels, toml_string
from florilege.operators import annotations, layout, mmr, sentences, summaries
from florilege.operators.builder import build_sentences
from florilege.plans.annotate import KeySentences
from florilege.sources import pages
from florilege.streaming.incremental import extract_stream


def word(text, x, y, h=10.0):
    return layout.Word(text, [x, y, x + 6.0 * len(text), y + h], y + h)


def row(text, x, y):
    out = []
    for w in text.split():
        out.append(word(w, x, y))
        x += 6.0 * len(w) + 4
    return out


def page(lines, index=0, x=50.0):
    return layout.Page(index, 600.0, 800.0, [w for i, t in enumerate(lines) for w in row(t, x, 700.0 - 14 * i)])


# ---- selection ----


def test_selection_prefers_importance_then_diversity():
    vectors = [{"a": 1.0}, {"a": 1.0}, {"b": 1.0}]
    assert mmr.select([1.0, 0.9, 0.5], ["", "", ""], vectors, 2) == [0, 2]
    assert mmr.select([1.0, 1.0], ["", ""], [{}, {}], 5) == [0, 1]
    assert mmr.select([], [], [], 3) == []


def test_section_penalty_and_coverage():
    assert mmr.select([0.5, 0.49, 0.45], ["x", "x", "y"], [{}, {}, {}], 2) == [0, 2]
    assert mmr.select([0.5, 0.5], ["", ""], [{}, {}], 1, [[0.0], [0.9]]) == [1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12), st.integers(0, 15))
def test_selection_invariants(importance, k):
    rnd = random.Random(len(importance))
    vectors = [{t: rnd.random() for t in rnd.sample("abcdef", 3)} for _ in importance]
    picks = mmr.select(importance, ["s"] * len(importance), vectors, k)
    assert len(picks) == min(k, len(importance)) == len(set(picks))
    assert picks == mmr.select(importance, ["s"] * len(importance), vectors, len(importance))[: len(picks)]


def test_unrolled_form_agrees(spark):
    docs = spark.createDataFrame([(1, "The cats eat fish today in Rome. The dogs eat the fish today in Rome. Birds sing very loud songs at night. Birds sing songs at night in trees.")], "doc_id long, text string")
    body = sentences.importance(sentences.body(sentences.sentence_table(docs)))
    tf = sentences.term_frequency(body)
    v = sentences.tfidf(tf, sentences.vocabulary(tf, body))
    a = {tuple(r) for r in mmr.select_table(body, v, 3).collect()}
    assert a == {tuple(r) for r in mmr.select_unrolled(body, v, 3).collect()} and len(a) == 3


# ---- layout ----


def test_split_fragment():
    a, b = layout.split_fragment("ab  cdef", [0.0, 0.0, 65.5, 10.0])
    assert (a.text, b.text) == ("ab", "cdef") and a.rect[0] == 0 and b.rect[2] == 65.5 and a.rect[2] == pytest.approx(20.0)
    assert layout.split_fragment(" ", [0, 0, 1, 1]) == []


def test_two_columns_are_read_in_turn():
    left, right = ["a b c d e"] * 3, ["f g h i j"] * 3
    p = layout.Page(0, 600.0, 800.0, [w for i, (x, y) in enumerate(zip(left, right)) for w in row(x, 190.0, 700.0 - 14 * i) + row(y, 370.0, 700.0 - 14 * i)])
    assert [x.text for x in layout.build_lines(p)] == left + right


def test_repeated_margins_go():
    made = [layout.Page(i, 600.0, 800.0, [word(f"Journal{i}", 50, 780), word("body", 50, 400)]) for i in range(4)]
    assert [[w.text for w in p.words] for p in layout.clean_margins(made)] == [["body"]] * 4
    assert layout.clean_margins(made[:3]) is not None and len(layout.clean_margins(made[:3])[0].words) == 2


def test_tables_are_found():
    lines = [row("Table 1. Scores", 50, 700), *([word("x", 50, y), word("1.0", 150, y), word("2.0", 250, y), word("3.0", 350, y)] for y in (680, 666, 652)), row("This is prose that goes on and is long.", 50, 600)]
    made = layout.build_lines(layout.Page(0, 600.0, 800.0, [w for x in lines for w in x]))
    assert layout.table_lines(made, 600.0) == {0, 1, 2, 3}


def test_merge_rects():
    assert layout.merge_rects([[0, 0, 5, 10], [6, 1, 9, 11], [0, 30, 4, 40]]) == [[0, 30, 4, 40], [0, 0, 9, 11]]
    assert layout.merge_rects([]) == []


def test_margin_and_fragment_tables_agree_with_plain(spark):
    f = spark.createDataFrame([(1, 0, 0, "ab cdef g", 0.0, 0.0, 80.0, 10.0)], "doc_id long, page_index int, frag int, text string, x1 double, y1 double, x2 double, y2 double")
    got = [(r.word, pytest.approx(r.left), pytest.approx(r.right)) for r in layout.split_fragments(f).orderBy("pos").collect()]
    assert got == [(w.text, w.rect[0], w.rect[2]) for w in layout.split_fragment("ab cdef g", [0.0, 0.0, 80.0, 10.0])]


# ---- builder ----


def test_sections_references_and_back_matter():
    p = page(["Abstract", "We study the thing here.", "1 Introduction", "It matters a lot to us.", "Funding: nobody paid.", "Hidden text goes here.", "2 Results", "They were quite good.", "References", "Smith, J. A paper. 2001.", "3 Discussion", "Ignored in references.", "Appendix", "Shown after all of it."])
    got = [(s["text"], s["section"]) for s in build_sentences([p])]
    assert got == [("We study the thing here.", "abstract"), ("It matters a lot to us.", "introduction"), ("They were quite good.", "results"), ("Shown after all of it.", "appendix")]


def test_inline_heading_front_matter_and_order():
    got = build_sentences([page(["Some title words here.", "Abstract: We show one thing.", "And then another one."]), page(["Next page goes on."], 1)])
    assert [s["order"] for s in got] == [0, 1, 2, 3]
    assert [s["front_matter"] for s in got] == [True, False, False, False]
    assert [s["section_start"] for s in got] == [False, True, False, False]
    assert all(s["rects"] for s in got)


# ---- sources ----


def test_arrays_flip_and_default_sizes():
    (p,) = pages.pages_from_arrays({"pages": [[0, None, [[10, 20, 60, 30, "two words"]]]]})
    assert (p.width, p.height) == (612.0, 792.0)
    assert [w.text for w in p.words] == ["two", "words"] and p.words[0].rect[1::2] == [762.0, 772.0] and p.words[0].top == 20
    with pytest.raises(ValueError):
        pages.pages_from_arrays({})


def test_tree_inherits_geometry_and_drops_repeats():
    node = {"position": {"pageIndex": 0, "rects": [[10, 100, 60, 110], [10, 80, 60, 90]]}, "text": "one two three"}
    (p,) = pages.pages_from_tree(json.dumps({"pageSizes": [[600, 800]], "content": [node, node, {"text": "no place"}]}))
    assert [w.text for w in p.words] == ["one", "two", "three"]
    assert pages.pages_from_tree("{broken") == [] == pages.pages_from_tree(None)


def test_words_from_json(spark):
    df = spark.createDataFrame([(1, json.dumps({"pages": [[600, 800, [10, 20, 60, 30, "hi you"]], [600, 800]]})), (2, None)], "doc_id long, data string")
    assert [(r.page_index, r.text) for r in pages.words_from_json(df).orderBy("page_index", "word_pos").collect()] == [(0, "hi"), (0, "you"), (1, None)]


def test_first_pdf_and_title(spark):
    items = spark.createDataFrame([(1, False, False), (2, True, True), (3, True, False), (4, False, False)], "item_id long, is_attachment boolean, is_pdf boolean")
    att = spark.createDataFrame([(1, 11, 2, True), (1, 12, 1, True), (1, 13, 0, False), (4, 12, 0, True)], "item_id long, attachment_id long, pos int, is_pdf boolean")
    assert {tuple(r) for r in pages.first_pdf(items, att).collect()} == {(1, 12), (2, 2)}


# ---- summaries ----


@settings(max_examples=60, deadline=None)
@given(st.text("ab c\n", max_size=200), st.integers(1, 20))
def test_token_chunks_keep_the_budget(text, limit):
    chunks = summaries.split_by_tokens(text, limit)
    # A word beyond the limit is cut by length, so that signs of one token each may double it.
    assert all(summaries.estimate_tokens(c) <= 2 * limit for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_map_budget_and_retry():
    assert summaries.map_budget(4096) == {"reserve": 512, "input": 3584, "output": 400}
    calls = []

    def fails(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert summaries.retried(fails, sleep=calls.append)(7) == 7 and calls == [7, 2.0, 7][:1] + calls[1:]
    with pytest.raises(OSError):
        summaries.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=lambda s: None)()


def test_map_reduce_ends(spark):
    docs = spark.createDataFrame([(1, " ".join(f"Sentence {i} is here." for i in range(60))), (2, ""), (3, None), (4, "One.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in summaries.summarise(docs, 2, map_reduce=True, chunk_sentences=5).collect()}
    assert got[1].startswith("Sentence 0 is here.") and got[4] == "One."


# ---- configuration and annotations ----


def test_labels(tmp_path):
    assert [x["name"] for x in parse_labels(DEFAULT_LABELS)][:2] == ["[literature]", "[method]"]
    assert toml_string(r'"a \"b\" \n"') == 'a "b" \n' and toml_string(" bare ") == "bare"
    for bad in ("", "x = 1", "[a]", "[a]\ncolor = \"red\"", '[a]\ndescription = "x"\nother = "y"', '[a]\ndescription = "x"\ndescription = "y"'):
        with pytest.raises(ValueError):
            parse_labels(bad)
    path = tmp_path / "labels"
    assert len(labels_file(str(path))) == 7 and path.exists()


def test_settings_and_scoring(tmp_path):
    assert Settings.read({"compression_ratio": 1.0}) == Settings() and Settings.read({"compression_ratio": 5}).compression_ratio == 5
    assert Settings.read({"nonsense": 1}) == Settings() and Settings().remote_problems()
    (tmp_path / "s").write_text('{"initial": {"summarySimilarity": 0.5, "sentenceLength": 0.5}, "selection": {"importance": 1, "redundancy": 0, "sectionPenalty": 0}}')
    assert Scoring.read(str(tmp_path / "s")).selection == {"importance": 1, "redundancy": 0, "section": 0}


def test_guard_and_delete(spark):
    tags = lambda *names: [(n,) for n in names]
    old = spark.createDataFrame([(1, tags(annotations.AUTO_TAG)), (2, tags("mine")), (3, tags("autoskim-other"))], "doc_id long, tags array<struct<name:string>>")
    docs = spark.range(1, 5).withColumnRenamed("id", "doc_id")
    assert sorted(r[0] for r in annotations.without_annotated(docs, old).collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        annotations.without_annotated(docs, old, fail=True)
    assert [r.doc_id for r in annotations.without_auto(old).collect()] == [2]
    assert sorted(r.doc_id for r in annotations.without_auto(old, docs.filter("doc_id = 1")).collect()) == [2, 3]


TEXT = "Abstract\nWe study cats here in great detail today.\n1 Introduction\nCats are animals that people like to keep at home.\nDogs are animals that people take out for a walk.\n2 Results\nThe cats of this study slept for most of the day.\nThe dogs of this study did not sleep that much at all."


@pytest.mark.parametrize("mode", ["documented", "reference_exact"])
@pytest.mark.parametrize("labels", [False, True])
def test_whole_extraction(spark, tmp_path, mode, labels):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    plan = KeySentences(Settings(compression_ratio=2.0, summary_labels=labels, local_relevance=True), mode=mode)
    out = plan.transform(pages.words_from_text(docs))
    annotations.save(out, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {1} and all(r.tags[0].name == annotations.AUTO_TAG for r in got)
    assert all((len(r.tags) == 2) is labels for r in got)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    extract_stream(stream, lambda b: sentences.sentence_table(b), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("doc_id") == 1).count() >= 4


def test_layout_of_long_texts(spark):
    """Very many lines, and a very long line: places are exact, and linear to find."""
    many, long = "\n".join(["a bc  d"] * 30_000), " ".join(["word"] * 200_000)
    docs = spark.createDataFrame([(1, many), (2, long), (3, ""), (4, None)], "doc_id long, text string")
    w = pages.words_from_text(docs)
    got = {r.doc_id: r for r in w.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("word_pos").alias("d"), F.max("page_index").alias("p"), F.max("x2").alias("x")).collect()}
    assert set(got) == {1, 2} and (got[1].n, got[1].d, got[1].p, got[1].x) == (90_000, 90_000, 499, 36 + 7 * 6) and (got[2].n, got[2].d, got[2].x) == (200_000, 200_000, 36 + 6 * (5 * 200_000 - 1))
    assert [(r.text, r.x1) for r in w.filter("doc_id = 1 AND word_pos >= 4294967296 AND word_pos < 8589934592").orderBy("word_pos").collect()] == [("a", 36.0), ("bc", 48.0), ("d", 72.0)]


def test_words_of_single_pages(spark):
    df = spark.createDataFrame([(1, 4, json.dumps([600, 800, [10, 20, 60, 30, "hi you"]])), (1, 5, json.dumps([600, 800])), (2, 0, None)], "doc_id long, page_index int, data string")
    assert [(r.page_index, r.text) for r in pages.words_from_pages(df).orderBy("page_index", "word_pos").collect()] == [(4, "hi"), (4, "you"), (5, None)]


def test_sources_of_models():
    def broken(*_):
        raise OSError

    assert summaries.with_fallback(broken, lambda x: x + 1)(1) == 2 and summaries.with_fallback(lambda x: x, broken)(1) == 1
    assert summaries.by_index([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        summaries.by_index([{"index": 1, "embedding": [2.0]}], 1)


def test_summaries_that_do_not_shrink(spark):
    docs = spark.createDataFrame([(1, "A b. " * 60), (2, "One.")], "doc_id long, text string")
    grows = lambda texts, n: [t + " More. And more." * 9 for t in texts]
    assert summaries.summarise(docs, 2, grows, map_reduce=True, rounds=2).count() == 2
    with pytest.raises(RuntimeError):
        summaries.summarise(docs, 2, grows, map_reduce=True, rounds=2, strict=True)
    assert summaries.summarise(docs, 2, map_reduce=True, rounds=16, strict=True).count() == 2
    assert {r.text for r in summaries.summarise(docs, 9, lambda t, n: t, most=4).collect()} == {"A b.", "One."}


def test_exact_mode_compares_whole_values():
    close = [0.5, 0.5 + 1e-12]
    assert mmr.select(close, ["", ""], [{}, {}], 1) == [0] and mmr.select(close, ["", ""], [{}, {}], 1, digits=None) == [1]


def test_broadcasts_are_checked(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        sentences.nearest_label(vec, spark.range(10_001).select(F.col("id").alias("pos"), F.lit("x").alias("label"), F.array(F.lit(1.0)).alias("vector")))
    with pytest.raises(ValueError):
        sentences.nearest_label(vec, spark.range(9).select(F.col("id").alias("pos"), F.lit("x").alias("label"), F.array_repeat(F.lit(1.0), 500_000).alias("vector")))


def test_caches_are_released(spark):
    plan = KeySentences(Settings(compression_ratio=2.0))
    plan.transform(pages.words_from_text(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))).collect()
    held = list(plan._held)
    assert held and all(df.is_cached for df in held)
    plan.release()
    assert not plan._held and not any(df.is_cached for df in held)


def test_words_leave_in_batches():
    """What a worker holds of the result is a batch of words, whatever a batch of documents comes to."""
    page = {"pages": [[600, 800, *([10, 20, 60, 30, "a b c d e"] for _ in range(100))], [600, 800]]}
    big = {"pages": [[600, 800, [0, 0, 9, 9, "w " * 50_000]]]}
    found = ((i, p.index, p) for i, x in enumerate([page] * 100 + [big]) for p in pages.pages_from_arrays(x))
    batches = list(pages._word_batches(found))
    assert max(b.num_rows for b in batches) < 2 * pages.BATCH and len(batches) >= 4
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(rows) == 100 * 501 + 50_000
    assert [(r["doc_id"], r["page_index"], r["word_pos"]) for r in rows[499:502]] == [(0, 0, 499), (0, 1, 0), (1, 0, 0)] and rows[500]["text"] is None
    assert [r["word_pos"] for r in rows[-50_000:]] == list(range(50_000)) and rows[-1]["top"] == 0 and rows[0]["x1"] == 10 and rows[4]["x2"] == 60


def test_array_pages_are_shuffled_once(spark, monkeypatch):
    from florilege.plans import catalog

    monkeypatch.setattr(sentences, "SPLIT_BYTES", 0)  # as on a large table, whose texts are not dealt out before
    plan = catalog.queries()["pages_from_arrays"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
