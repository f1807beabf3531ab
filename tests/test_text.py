"""Text functions and rules: goldens, and agreement of the expressions with the plain forms."""

import pytest
from pyspark.sql import functions as F

from florilege.functions import plain, rules
from florilege.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


NORMAL = {
    "ﬁrst soft­ware  —\tspaced": "first software — spaced",
    "ﬀ ﬁ ﬂ ﬃ ﬄ": "ff fi fl ffi ffl",
    "hyphen- ated A- word": "hyphenated Aword",
    "“curly” ‘quotes’": "\"curly\" 'quotes'",
    None: "",
    "": "",
}


@pytest.mark.parametrize("value", list(NORMAL))
def test_normalize(spark, value):
    assert one(spark, value, T.normalize_text) == NORMAL[value] == plain.normalize_text(value)


SENTENCES = {
    "First one. Second one! Third?": ["First one.", "Second one!", "Third?"],
    "See Fig. 3 for it. Then e.g. This.": ["See Fig. 3 for it.", "Then e.g. This."],
    'He said "no." Then left.': ['He said "no.', "Then left."],
    "lower. case goes on": ["lower. case goes on"],
    "Smith et al. (2020) did. [3] too.": ["Smith et al. (2020) did.", "[3] too."],
}


@pytest.mark.parametrize("value", list(SENTENCES))
def test_sentences(spark, value):
    assert one(spark, value, T.sentences) == SENTENCES[value]
    assert [value[a:b] for a, b in plain.sentence_ranges(value)] == SENTENCES[value]


@pytest.mark.parametrize(
    "value, name",
    [("Methods", "methods"), ("2.1 Data and Tools", "data and tools"), ("3. Results", "results"), ("1 this is a plain sentence", None), ("x" * 91, None), ("", None), ("4 Why This?", None), ("RELATED WORK", "related work")],
)
def test_heading(spark, value, name):
    assert one(spark, value, T.heading) == name == plain.detect_heading(value)


@pytest.mark.parametrize(
    "value, entry",
    [
        ("Smith, J., Jones, K. A study of things. 2019.", True),
        ("[3] Something, Proceedings of X, 2001", True),
        ("https://doi.org/10.1 short", True),
        ("Smith and others (2019) argued.", True),
        ("We present a method for this problem.", False),
        ("The conference of 1999 was long.", True),
    ],
)
def test_reference_entry(spark, value, entry):
    assert one(spark, value, rules.is_reference_entry) is entry
    assert bool(plain.is_reference_entry(value)) is entry


@pytest.mark.parametrize(
    "value, reason",
    [
        ("Funding: this work was paid for by all.", "back_matter"),
        ("Too short here.", "word_count"),
        ("Figure 3 shows the way in which it went.", "caption"),
        ("1 2 3 4 5 6 7 8 9 10 11 12", "digits"),
        ("alpha 1 beta 2 gamma 3 delta 4 epsilon 5 zeta eta", "numeric"),
        ("All rights reserved by the authors of this text.", "publisher"),
        ("Write to someone@example.org for all the data.", "email"),
        ("Ann Bee Cee Dee and Eff Gee", "name_list"),
        ("We show that the method works well on data.", None),
    ],
)
def test_noise(spark, value, reason):
    assert one(spark, value, rules.noise_reason) == reason


def test_tokens_keep_repeats(spark):
    assert one(spark, "The cat and the well-known cat's x", T.tokens) == ["cat", "well-known", "cat's"]
    assert spark.range(1).select(T.terms(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0] == ["a", "b", "c", "a__b", "b__c"]
    assert spark.range(1).select(T.terms(F.array().cast("array<string>"))).first()[0] == []


def test_join_tokens(spark):
    words = ["(", "a", ")", ",", "", "b", "/", "c", "."]
    assert spark.createDataFrame([(words,)], "w array<string>").select(T.join_tokens(F.col("w"))).first()[0] == plain.join_tokens(words) == "(a), b /c."


def test_labelled_entries(spark):
    s = "1. [method] We try. 2. [other] No.\n3) [result] It works."
    got = [tuple(r) for r in one(spark, s, lambda x: T.labelled_entries(x, ["[method]", "[result]"]))]
    assert got == [("[method]", "We try."), ("[result]", "It works.")]


def test_sort_index(spark):
    row = spark.range(1).select(T.sort_index(F.lit(3), F.lit(792.0), F.lit(700.123), F.lit(36.0))).first()[0]
    assert row == "00003|009188|03600"


def test_chunks_and_tokens(spark):
    assert one(spark, "A b. C d. E f.", lambda x: T.chunks_by_sentences(x, 2)) == ["A b.  C d.", "E f."]
    assert one(spark, "", lambda x: T.chunks_by_sentences(x, 2)) == []
    assert one(spark, "abcd efg, 12", T.estimate_tokens) == 2 + 1 + 1 + 1


def made_texts():
    """Random strings over what the rules look at."""
    import random

    rnd = random.Random(5)
    bits = [
        "Smith, J. A.", "Journal of X", "et al.", "vol. 3", "1999", "2020a", "[3]", "12.", "doi: 10.1", "https://x.y", "www.a.b", "www", "doi", "pages", "no", "accessed", "a@b.co", ".+@x.org", "Figure 2", "Table IV", "tab. 1.2", "n/a", "NA", "3.14", "we", "The",
        "results", "a-", "b", "c-", "\t", " ", "\n ", "­", "ﬁ", "“q”", "‘s’", "received", "published:", "copyright", "Funding:", "Acknowledgements", "References", "©", "--", "Anna and Bob", "Jones & Lee (2001)", "plain words of prose", "éa", "x_1999", "1999x9", "3", "7,5",
    ]
    return [rnd.choice(["", " "]).join(rnd.choice(bits) for _ in range(rnd.randrange(0, 9))) for _ in range(700)] + [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 100))) for _ in range(100)]


def test_expressions_agree_with_the_plain_forms(spark):
    texts = made_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = df.select("i", T.normalize_text(x).alias("n"), rules.is_reference_entry(x).alias("e"), rules.is_back_matter_line(x).alias("b"), rules.is_front_matter_line(x, F.lit(0)).alias("f"), rules.is_table_caption(x).alias("t"), T.n_words(T.normalize_text(x)).alias("w")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.n == plain.normalize_text(t) and r.w == len(r.n.split())
        assert (r.e, r.b, r.f, r.t) == (plain.is_reference_entry(t), plain.is_back_matter_line(t), plain.is_front_matter_line(t, 0), plain.is_table_caption(t)), t


def test_noise_is_what_has_a_reason(spark):
    texts = [plain.normalize_text(t) for t in made_texts()]
    df = spark.createDataFrame([(t, s, f) for t in texts for s, f in (("", False), ("References", False), ("x", True))], "x string, s string, f boolean")
    x, s, f = F.col("x"), F.col("s"), F.col("f")
    got = df.select(x, rules.noise_reason(x, s, f).alias("r"), rules.noise_reason(x, s, f, normal=True).alias("q"), rules.is_noise(x, s, f, normal=True).alias("n")).collect()
    assert all(r.r == r.q and (r.r is not None) == r.n for r in got) and {r.r for r in got} >= {None, "flag", "reference", "word_count", "publisher"}


def test_cut_from_a_normalised_text(spark):
    once = spark.createDataFrame([(t,) for t in made_texts()], "x string").select(T.normalize_text(F.col("x")).alias("x"))
    assert once.filter(T.normalize_again(F.col("x")) != T.normalize_text(F.col("x"))).isEmpty()
    assert one(spark, "a- b- c", lambda x: T.normalize_again(T.normalize_text(x))) == "abc"
