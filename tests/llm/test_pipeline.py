"""The pipeline against a brute-force version of its stages on a small table."""

import random
from pathlib import Path

import pytest

from florilege.llm import secrets
from florilege.llm.line_dedup import line_dedup
from test_corpus_operators import brute_components, check_packing

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(80)
    rnd = random.Random(8)
    base = docs.first().text
    near = " ".join(w if rnd.random() > 0.01 else "other" for w in base.split(" "))
    extra = spark.createDataFrame([(9000, near, "en", "s", 1), (9001, None, None, None, None), (9002, "12 34", "en", "s", 5), (9003, "clean words of a short text, password = 'hunter2hunter2'", "en", "s", 5)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    state, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    kept = []
    for i, (_, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in state.select("doc_id", "text").collect()} if "text" in state.columns else {}
        stage(spark, state, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        state = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert state.columns == columns
        kept.append((before, state.collect()))
    assert {9001, 9002} == set(kept[0][0]) - {r.doc_id for r in kept[0][1]}
    cut = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(list(kept[1][0].items()), "doc_id long, text string")).collect()}
    assert {r.doc_id: r.text for r in kept[1][1]} == {i: t for i, t in cut.items() if t.strip() or t == kept[1][0][i]}
    ids = sorted(kept[2][0])
    root = brute_components([kept[2][0][i] for i in ids], 5, 80)
    assert {r.doc_id for r in kept[2][1]} == {i for k, i in enumerate(ids) if root[k][1] == k}
    assert {r.doc_id: r.text for r in kept[3][1]} == {i: secrets.redacted(t) for i, t in kept[3][0].items()}
    assert all(r.n_chars == len(r.text) for r in kept[3][1])
    check_packing(kept[4][1], 1024)
    assert {r.doc_id for r in kept[4][1]} == set(kept[4][0])
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect())) == sorted((r.doc_id, r.piece, r.length) for r in kept[4][1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h string, pos int, shard long, sig long"


def staged(spark, folder, rows):
    """What each stage keeps of rows of (doc_id, text, lang)."""
    import corpus_pipeline as p

    made = [(i, t, g, "s", None if t is None else len(t), "l", "h", 1, 2, 3) for i, t, g in rows]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    state, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(p.STAGES):
        before = state.columns
        stage(spark, state, str(folder)).write.parquet(f"{folder}/{i}")
        state = spark.read.parquet(f"{folder}/{i}")
        assert i == 4 or state.columns == before
        out.append(state.collect())
    return out


def test_empty_table(spark, tmp_path):
    assert staged(spark, tmp_path, []) == [[]] * 5


def test_extra_columns_and_repeated_ids(spark, tmp_path):
    long = " ".join(f"word{i} of a text" for i in range(60))
    rows = [(1, "hello there friend", "en"), (1, "hello there friend", "en"), (2, long, "en"), (2, "another text of the same id", "en"), (3, long + " more", "en"), (4, "½ 12", "en"), (5, "", "en"), (6, None, None), (None, "no id here", "en"), (7, "a\nb\nc\nd", "en"), (8, "a\nb\nc\nd", "en"), (9, "password = 'abcdefghijklmnop'", "en")]
    kept = staged(spark, tmp_path, rows)
    ids = [sorted((r.doc_id is not None, r.doc_id) for r in x) for x in kept]
    assert [i for _, i in ids[0]] == [None, 1, 1, 2, 2, 3, 7, 8, 9]
    # The copy of four lines goes with its document; the near copy goes; rows that share an id go or stay together.
    assert [i for _, i in ids[1]] == [None, 1, 1, 2, 2, 3, 7, 9] and [i for _, i in ids[2]] == [None, 1, 1, 2, 2, 7, 9] == [i for _, i in ids[3]]
    assert {r.text for r in kept[3] if r.doc_id == 9} == {"[secret]"} or all("abcdefghijklmnop" not in r.text for r in kept[3])
    assert {r.doc_id for r in kept[4]} == {None, 1, 2, 7, 9}


def test_stages_delete_what_those_before_stored(spark, tmp_path):
    from florilege.llm import common

    staged(spark, tmp_path, [(i, f"text number {i} is about some thing\nand has two lines", "en") for i in range(20)])
    app = spark.sparkContext.applicationId
    assert (app, "pipeline") not in common._tables and all("units" not in x and "sets" not in x for x in common._paths.get((app, "pipeline"), []))
    common.release(spark, "pipeline")
    assert (app, "pipeline") not in common._paths
