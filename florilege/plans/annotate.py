"""The whole extraction: words to sentences, scores, selection, labels, annotation records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.config import Scoring, Settings, parse_labels
from ..operators import annotations, mmr, sentences
from ..operators.builder import sentences_from_words
from ..operators.summaries import Embedder, Summariser, embeddings, hashed_embedding, lead_summary, summarise


@dataclass
class KeySentences:
    """transform(words) gives annotation records; pick(sentences) the picks alone.

    mode "documented": similarity to the summary counts, and its sentences' coverage;
    "reference_exact": a summary without embeddings adds nothing, and coverage is 0.
    """

    settings: Settings = field(default_factory=Settings)
    scoring: Scoring = field(default_factory=Scoring)
    model: Summariser = lead_summary
    embed: Embedder = hashed_embedding
    mode: str = "documented"
    _held: list[DataFrame] = field(default_factory=list, repr=False)

    def _kept(self, df: DataFrame) -> DataFrame:
        """df, cached until release(): several branches of the plan read it."""
        self._held.append(df.persist())
        return df

    def release(self) -> None:
        """Drop what transform() and pick() cached, once their results are written."""
        while self._held:
            self._held.pop().unpersist()

    def pick(self, found: DataFrame) -> DataFrame:
        """Sentence records with importance, and tag, tag_color, tag_description, tag_score where labels are on."""
        s, w = self.settings, Window.partitionBy("doc_id")
        ratio = s.compression_ratio
        # Abstracts don't count, but their sentences may be picked.
        body = sentences.body(found).withColumn("_n", F.count(F.when(F.lower("section") != "abstract", 1)).over(w)).withColumn("k", sentences.annotation_target(F.col("_n"), ratio)).drop("_n")
        body = self._kept(body)
        papers = sentences.paper_text(body)
        labels = parse_labels(s.label_config) if s.summary_labels else []
        summary = self._kept(summarise(papers, 10, self.model, s.map_reduce, s.map_reduce_sentences, keep=self._kept))
        if labels:
            entries = summary.select("doc_id", T.labelled_entries(F.col("text"), [x["name"] for x in labels]).alias("e"), "text")
            summary = entries.select("doc_id", F.when(F.size("e") > 0, F.array_join("e.sentence", "\n")).otherwise(F.col("text")).alias("text"), "e")
        scored, cover = sentences.importance(body, weights=(self.scoring.summary_similarity, self.scoring.sentence_length)), None
        if s.local_relevance:
            vec = embeddings(body.select("doc_id", "order", "text"), self.embed).select("doc_id", "order", "embedding")
            near = vec.join(embeddings(summary.select("doc_id", "text"), self.embed).select("doc_id", F.col("embedding").alias("_s")), "doc_id", "left")
            near = near.select("doc_id", "order", F.coalesce(sentences.dense_cosine(F.col("embedding"), F.col("_s")), F.lit(0.0)).alias("_r"))
            scored = sentences.importance(body.join(near, ["doc_id", "order"], "left"), F.coalesce("_r", F.lit(0.0)), (self.scoring.summary_similarity, self.scoring.sentence_length)).drop("_r")
            if self.mode == "documented":
                parts = summary.select("doc_id", F.posexplode(T.sentences(T.normalize_text(F.col("text")))).alias("col", "text"))
                many = embeddings(parts, self.embed).withColumn("_m", F.count("*").over(w)).filter("_m > 1").select("doc_id", "col", F.col("embedding").alias("_p"))
                cover = vec.join(many, "doc_id").select("doc_id", "order", "col", sentences.dense_cosine(F.col("embedding"), F.col("_p")).alias("similarity"))
        picks = mmr.select_table(scored, sentences.vectors(body), F.col("k"), self.scoring.selection, cover, self.mode)
        out = scored.join(picks.select("doc_id", "order", "pick"), ["doc_id", "order"])
        return self._classified(out, summary, labels) if labels else out

    def _classified(self, picks: DataFrame, summary: DataFrame, labels: list[dict]) -> DataFrame:
        """The label of the nearest labelled summary sentence, or where a document has none, of the nearest description."""
        known = {x["name"]: (i, x) for i, x in reversed(list(enumerate(labels)))}
        columns = lambda i, x: F.struct(F.lit(i).alias("pos"), F.lit(x["name"]).alias("label"), F.lit(x["description"]).alias("text"), F.lit(x["color"]).alias("color"))
        own = summary.select("doc_id", F.posexplode("e").alias("pos", "x")).select("doc_id", "pos", F.col("x.label").alias("label"), F.col("x.sentence").alias("text"))
        described = F.array(*(columns(i, x) for i, x in sorted(known.values(), key=lambda v: v[0])))
        plain = summary.filter(F.size("e") == 0).select("doc_id", F.inline(described)).drop("color")
        entries = embeddings(own.unionByName(plain), self.embed).select("doc_id", "pos", "label", F.col("embedding").alias("_e"))
        vec = embeddings(picks.select("doc_id", "order", "text"), self.embed)
        best = vec.join(entries, "doc_id").groupBy("doc_id", "order").agg(F.max(F.struct(sentences.dense_cosine(F.col("embedding"), F.col("_e")).alias("score"), (-F.col("pos")).alias("first"), "label")).alias("b"))
        by_name = F.create_map(*(c for name, (i, x) in known.items() for c in (F.lit(name), columns(i, x))))
        tagged = best.withColumn("t", F.try_element_at(by_name, F.col("b.label"))).filter("t IS NOT NULL")
        tags = tagged.select("doc_id", "order", F.regexp_replace("t.label", r"^\[|\]$", "").alias("tag"), F.col("t.text").alias("tag_description"), F.col("t.color").alias("tag_color"), F.col("t.pos").alias("tag_index"), F.col("b.score").alias("tag_score"))
        return picks.join(tags, ["doc_id", "order"], "left")

    def transform(self, words: DataFrame) -> DataFrame:
        """Annotation records of positioned words. Call release() once they are written."""
        found = self._kept(sentences_from_words(words))
        return annotations.annotation_records(self.pick(found), parse_labels(self.settings.label_config))
