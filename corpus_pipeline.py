"""A corpus pipeline over documents: language ID, line dedup, near duplicates, secret scans, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again,
and its decisions take effect:

1. language: documents whose text is null or has no letter are rejected; `lang` becomes the predicted language.
2. lines: repeated multi-line chunks are cut from texts; documents of which nothing is left go.
3. near duplicates: one document of each group of similar texts (five words, 0.8) stays, the one with the smallest id.
4. secrets: every span found is replaced by a mark; the documents stay.
5. packing: pieces of the documents' ids with their places in sequences.

n_chars follows the text wherever a stage changes it. What a stage stores on its way is
deleted when the next one begins, as its result is written by then.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.common import crc_mod, forget, owned, release, shared_dir
from florilege.llm.jaccard import jaccard_join
from florilege.llm.langid import UNDETERMINED, fit, predict
from florilege.llm.line_dedup import line_dedup
from florilege.llm.packing import pack_documents
from florilege.llm.queries import tokenizer
from florilege.llm.secrets import scan


def _stage(f):
    """f, with its own tables: those of the stage before are deleted first."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language; the model is fitted on a bounded sample of the labelled ones, one in five left out.

    Where no row is labelled, no language is learned and every document is rejected as undetermined only if it has no letter.
    """
    columns = docs.columns
    model = fit(docs.filter(F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(False))).select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model).filter(F.col("lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines; a document that had text and has none left goes."""
    cut = line_dedup(docs)
    kept = cut.filter(~((F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component; documents without words are all kept."""
    others = jaccard_join(docs, words=5, percent=80).filter("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    marks = scan(docs, extra=[c for c in docs.columns if c not in ("doc_id", "text")], outputs="redacted")
    return marks.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("near duplicates", near_duplicates), ("secret scans", secrets), ("best-fit packing", packing)]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and its input deleted."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            forget(spark, f"{folder}/{i - 1}")
    release(spark, "pipeline")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
