"""Documents to sentences, noise filtering, features, scores and rankings, as DataFrames keyed by doc_id.

Everything is within a document, so one shuffle by doc_id serves windows,
aggregations and group functions alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import terms


SPLIT_BYTES = 16 << 20  # of input for each core, from which on a scan has splits enough


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs as it is, or if it is too small to keep all cores busy (few row groups, maybe one), dealt out by the key.

    What follows works on each text for long, and windows by the key reuse the partitioning. The rows stay the same.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores, key) if size < cores * SPLIT_BYTES else docs


def sentence_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, order (from 0), text (normalised), section, page_index of the sentences of flat texts."""
    normal = spread(docs.select("doc_id", text_col)).select("doc_id", text.normalize_text(F.col(text_col)).alias("_n"))
    return normal.select("doc_id", F.posexplode(text.sentences(F.col("_n"))).alias("order", "text")).withColumns({"section": F.lit(""), "page_index": F.lit(0)})


def body(sentences: DataFrame) -> DataFrame:
    """Sentences that no noise rule rejects. Their texts are normalised, as sentence_table() and the builder give them."""
    flagged = None
    for name in ("front_matter", "in_table", "reference"):
        if name in sentences.columns:
            flagged = F.col(name) if flagged is None else flagged | F.col(name)
    section = F.col("section") if "section" in sentences.columns else None
    return sentences.filter(~rules.is_noise(F.col("text"), section, flagged, normal=True))


def section_carry_forward(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, section: the last heading at or before each line."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", text.heading(F.col("text"))).withColumn("section", F.last("heading", ignorenulls=True).over(w))


# ---- features ----


def term_frequency(sentences: DataFrame) -> DataFrame:
    """doc_id, order, term, tf, pos (where the term first stands in its sentence)."""
    words = sentences.select("doc_id", "order", text.tokens(text.normalize_again(F.col("text"))).alias("_w"))
    each = words.select("doc_id", "order", F.posexplode(text.terms(F.col("_w"))).alias("pos", "term"))
    return each.groupBy("doc_id", "order", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """doc_id, term, df, and where the term first stands (order, pos)."""
    return tf.groupBy("doc_id", "term").agg(F.count("*").alias("df"), F.min(F.struct("order", "pos")).alias("first"))


def vocabulary(tf: DataFrame, sentences: DataFrame, most: int = 16_000, share: float = 0.96) -> DataFrame:
    """doc_id, term, df, n: terms in at most a share of a document's n sentences, the most frequent `most`; ties by first place."""
    n = sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
    allowed = document_frequency(tf).join(n, "doc_id").filter(F.col("df") <= F.col("n") * F.lit(share))
    w = Window.partitionBy("doc_id").orderBy(F.desc("df"), "first")
    return allowed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("first")


def tfidf(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, order, term, value: (1 + ln tf) (ln((n + 1) / (df + 1)) + 1)."""
    v = tf.join(vocab.select("doc_id", "term", "df", "n"), ["doc_id", "term"])
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return v.select("doc_id", "order", "term", ((1 + F.log(F.col("tf").cast("double"))) * idf).alias("value"))


def vectors(sentences: DataFrame, most: int = 16_000, share: float = 0.96) -> DataFrame:
    """tfidf() of term_frequency() and vocabulary() in one pass: documents are shuffled once, as sentences, and the rest are windows within them."""
    doc = Window.partitionBy("doc_id")
    counted = sentences.select("doc_id", "order", "text", F.count("*").over(doc).alias("n"))
    words = counted.select("doc_id", "order", "n", text.tokens(text.normalize_again(F.col("text"))).alias("_w"))
    each = words.select("doc_id", "order", "n", F.posexplode(text.terms(F.col("_w"))).alias("pos", "term"))
    tf = each.groupBy("doc_id", "order", "n", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))
    term = Window.partitionBy("doc_id", "term")
    framed = tf.withColumn("df", F.count("*").over(term)).withColumn("first", F.min(F.struct("order", "pos")).over(term)).filter(F.col("df") <= F.col("n") * F.lit(share))
    # A term's first place is its own, so that all its rows share a rank.
    kept = framed.withColumn("rank", F.dense_rank().over(doc.orderBy(F.desc("df"), "first"))).filter(F.col("rank") <= most)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return kept.select("doc_id", "order", "term", ((1 + F.log(F.col("tf").cast("double"))) * idf).alias("value"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id", "order").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def sparse_cosine(vectors: DataFrame) -> DataFrame:
    """doc_id, a, b, cosine of sentence pairs a < b of a document that share a term. Reported for analysis; selection itself works in the group function."""
    n = norms(vectors)
    x = vectors.select("doc_id", "term", F.col("order").alias("a"), F.col("value").alias("va"))
    y = vectors.select("doc_id", "term", F.col("order").alias("b"), F.col("value").alias("vb"))
    dots = x.join(y, ["doc_id", "term"]).filter("a < b").groupBy("doc_id", "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na, nb = n.select("doc_id", F.col("order").alias("a"), F.col("norm").alias("na")), n.select("doc_id", F.col("order").alias("b"), F.col("norm").alias("nb"))
    return dots.join(na, ["doc_id", "a"]).join(nb, ["doc_id", "b"]).select("doc_id", "a", "b", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


# ---- scores ----


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter vector's length; norms over each vector's own."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def sparse_summary_similarity(sentences: DataFrame, summaries: DataFrame | Column) -> DataFrame:
    """doc_id, order, similarity: the cosine of each sentence's vector and the summary's, both in the sentences' vocabulary and weights; 0 without common terms.

    summaries: a table (doc_id, text), one for a document; or a condition on sentences, whose texts in order are the summary.
    The documented form. The code that this engine re-expresses builds each side its own
    vocabulary, in which nothing is comparable; its result is 0 throughout.
    """
    return terms.summary_similarity(sentences, summaries)


def length_score(content: Column) -> Column:
    """A bell around 18 words with a deviation of 12."""
    return F.exp(-F.pow(F.size(text.words(content)) - 18, F.lit(2)) / 288)


def min_max(x: Column, w: Window) -> Column:
    """Scaled to 0..1 in the window; a constant gives 0.5."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise((x - low) / (high - low))


def importance(sentences: DataFrame, similarity: Column | None = None, weights: tuple[float, float] = (0.85, 0.15)) -> DataFrame:
    """Add summary_relevance, length_score and importance; without a similarity the first is 0 everywhere, which scales to 0.5."""
    w = Window.partitionBy("doc_id")
    scored = sentences.withColumn("summary_relevance", F.lit(0.0) if similarity is None else similarity).withColumn("length_score", length_score(F.col("text")))
    value = weights[0] * min_max(F.col("summary_relevance"), w) + weights[1] * min_max(F.col("length_score"), w)
    return scored.withColumn("importance", value)


def annotation_target(n: Column, ratio: float = 10.0) -> Column:
    """How many sentences to pick of n."""
    return F.greatest(F.lit(1), F.floor(F.greatest(n, F.lit(0)) / ratio + 0.5)).cast("int")


def summary_target(n: Column, mode: str = "preview", ratio: float = 10.0) -> Column:
    """How many sentences a summary gets: of n body sentences (preview), or for n picks (annotate)."""
    return annotation_target(n, ratio) if mode == "preview" else F.greatest(F.lit(3), F.floor(n * 1.5 + 0.5)).cast("int")


def output_tokens(target: Column) -> Column:
    return F.least(F.lit(1000), F.greatest(F.lit(120), target * 30)).cast("int")


def shortlist_size(n: Column, k: Column) -> Column:
    return F.least(n, F.greatest(k * 4, F.lit(60)), F.lit(160))


def top_sentences(scored: DataFrame, ratio: float = 10.0) -> DataFrame:
    """The most important sentences of each document; ties in reading order."""
    w = Window.partitionBy("doc_id")
    ranked = scored.withColumn("k", annotation_target(F.count("*").over(w), ratio)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("importance"), "order")))
    return ranked.filter("rank <= k")


def shortlist(scored: DataFrame, ratio: float = 10.0) -> DataFrame:
    w = Window.partitionBy("doc_id")
    n = F.count("*").over(w)
    ranked = scored.withColumn("size", shortlist_size(n, annotation_target(n, ratio))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("importance"), "order")))
    return ranked.filter("rank <= size").drop("size")


def matrix_stats(pairs: DataFrame, x: str = "similarity") -> DataFrame:
    """doc_id, deviation (population), penalty (a tenth of it) of each document's similarity matrix."""
    return pairs.groupBy("doc_id").agg(F.stddev_pop(x).alias("deviation")).withColumn("penalty", F.col("deviation") * 0.1)


def small(table: DataFrame, rows: int = 10_000, numbers: int = 4_000_000, vector_col: str | None = None) -> DataFrame:
    """The table, for a broadcast: after a check that it has at most so many rows, and numbers in its vectors."""
    size = F.sum(F.size(vector_col)) if vector_col else F.lit(0)
    n, total = table.limit(rows + 1).agg(F.count("*"), size).first()
    if n > rows or (total or 0) > numbers:
        raise ValueError(f"a table of at most {rows} rows and {numbers} numbers is needed here")
    return F.broadcast(table)


def nearest_label(vectors: DataFrame, prototypes: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, label, score: the prototype (pos, label, vector; a small table, whose size is checked) of the largest cosine; ties to the first."""
    held = small(prototypes.select("pos", "label", F.col("vector").alias("p")), vector_col="p")
    pairs = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(held)
    best = pairs.groupBy("id").agg(F.max(F.struct(dense_cosine(F.col("v"), F.col("p")).alias("score"), (-F.col("pos")).alias("first"), "label")).alias("b"))
    return best.select("id", F.col("b.label").alias("label"), F.col("b.score").alias("score"))


def paper_text(sentences: DataFrame, most: int = 128_000) -> DataFrame:
    """doc_id, text: the body in order, without front matter and abstract, cut at `most` characters."""
    kept = sentences.filter(F.lower(text.normalize_text(F.coalesce(F.col("section"), F.lit("")))) != "abstract").filter(F.col("text") != "")
    if "front_matter" in sentences.columns:
        kept = kept.filter(~F.col("front_matter"))
    parts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("p"))
    return parts.select("doc_id", F.substring(text.normalize_again(F.array_join("p.text", " ")), 1, most).alias("text"))
