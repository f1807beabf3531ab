"""Annotation records: their fields, the guard against a second run, and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sort_index

# The tags and colour of automatic annotations.
AUTO_TAG = "autoskim-key-sentence"
AUTO_PREFIX = "autoskim-"
GREY = "#aaaaaa"


def annotation_records(picks: DataFrame, labels: list[dict] | None = None) -> DataFrame:
    """Records of picks (doc_id, order, text, page_index, page_height, rects, section, importance; tag, tag_color and tag_description if there are).

    The colour is the pick's own if it is valid, else its label's, else grey.
    """
    for name in ("tag", "tag_color", "tag_description"):
        if name not in picks.columns:
            picks = picks.withColumn(name, F.lit(None).cast("string"))
    tag = F.nullif(F.trim("tag"), F.lit(""))
    known = F.create_map(*(F.lit(x) for label in labels for x in (label["name"], label["color"] or ""))) if labels else F.create_map(F.lit(""), F.lit(""))
    own = F.when(F.col("tag_color").rlike("^#[0-9A-Fa-f]{6}$"), F.col("tag_color"))
    color = F.coalesce(own, F.nullif(F.try_element_at(known, F.concat(F.lit("["), tag, F.lit("]"))), F.lit("")), F.lit(GREY))
    top, left = F.array_max(F.transform("rects", lambda r: F.get(r, 3))), F.array_min(F.transform("rects", lambda r: F.get(r, 0)))
    comment = F.concat(F.when(tag.isNotNull(), F.concat(F.coalesce("tag_description", F.lit("")), F.lit(". "))).otherwise(""), F.format_string("Section: %s. Score: %.3f.", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("unclassified")), F.col("importance")))
    name = lambda c: F.struct(c.alias("name"))
    tags = F.when(tag.isNull(), F.array(name(F.lit(AUTO_TAG)))).otherwise(F.array(name(F.lit(AUTO_TAG)), name(tag)))
    return picks.select(
        "doc_id", F.substring(F.md5(F.concat_ws("|", "doc_id", "order", "text")), 1, 8).alias("key"), F.lit("highlight").alias("type"), color.alias("color"), (F.col("page_index") + 1).cast("string").alias("page_label"),
        sort_index(F.col("page_index"), F.col("page_height"), top, left).alias("sort_index"), F.struct("page_index", "rects").alias("position"), "text", comment.alias("comment"), tags.alias("tags"),
    )


def has_auto_tag(tags, prefix: bool = False):
    """Whether an annotation's tags hold the automatic one; prefix: any of its family."""
    return F.exists(tags, lambda t: t["name"].startswith(AUTO_PREFIX) if prefix else t["name"] == AUTO_TAG)


def without_annotated(docs: DataFrame, existing: DataFrame, fail: bool = False) -> DataFrame:
    """Documents that have no automatic annotations yet; fail: raise if any has."""
    done = existing.filter(has_auto_tag(F.col("tags"))).select("doc_id")
    if fail and not docs.join(done, "doc_id", "left_semi").isEmpty():
        raise ValueError("some documents have automatic annotations already")
    return docs.join(done, "doc_id", "left_anti")


def without_auto(existing: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Annotations without the automatic ones, of all documents or of some."""
    auto = has_auto_tag(F.col("tags"), prefix=True)
    if docs is None:
        return existing.filter(~auto)
    hit = existing.join(docs.select("doc_id").distinct().withColumn("_sel", F.lit(True)), "doc_id", "left")
    return hit.filter(~(auto & F.coalesce("_sel", F.lit(False)))).drop("_sel")


def save(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append records to a folder of Parquet or JSON files; a job's files appear together when it commits."""
    records.write.mode("append").format(kind).save(path)
