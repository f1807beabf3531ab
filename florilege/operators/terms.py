"""What counts terms within documents, in one pass over their sentences.

Sentences are dealt out once by doc_id and sorted, and a worker reads one document after
the other: terms, many times as large as the texts, are neither shuffled nor sorted. A
worker holds the terms of one document, and of results a batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import plain
from ..functions.text import TOKEN

MOST, SHARE = 16_000, 0.96
BATCH = 50_000  # rows of a result
_TOKEN, _STOP = re.compile(TOKEN), frozenset(P.STOP_WORDS)


def tokens(normal: str) -> list[str]:
    """As functions.text.tokens, of normalize_again()."""
    s = plain.normalize_text(normal) if "- " in normal else normal
    return [w for w in _TOKEN.findall(s.lower()) if len(w) > 1 and w not in _STOP]


def terms(words: list[str]) -> list[str]:
    """As functions.text.terms."""
    return words + [f"{a}__{b}" for a, b in zip(words, words[1:])]  # noqa: B905


class Document:
    """Rows (order, text) of one document, by order. Rows of one order count as one sentence, and as several in n.

    n; orders and sentences, of which each has its terms by their first places, with their counts where one is above 1;
    df: of each term, by its first place.
    """

    def __init__(self, rows: list[tuple]):
        self.n, self.orders, self.sentences = len(rows), [], []
        every: list[str] = []
        for order, own in groupby(rows, key=itemgetter(0)):
            each = [terms(tokens(r[1] or "")) for r in own]
            found = each[0] if len(each) == 1 else [t for _, t in sorted(((i, t) for x in each for i, t in enumerate(x)), key=itemgetter(0))]
            once = dict.fromkeys(found)
            self.orders.append(order)
            self.sentences.append(once if len(once) == len(found) else Counter(found))
            every += once
        self.df = Counter(every)

    def vocabulary(self, most: int = MOST, share: float = SHARE) -> list[tuple[str, int]]:
        """(term, df) by rank."""
        limit = self.n * share
        kept = [x for x in self.df.items() if x[1] <= limit]
        kept.sort(key=itemgetter(1), reverse=True)
        return kept[:most]

    def idf(self, vocabulary: list[tuple[str, int]]) -> list[float]:
        of = {df: math.log((self.n + 1) / (df + 1)) + 1 for df in {df for _, df in vocabulary}}
        return [of[df] for _, df in vocabulary]


def tf_weight(tf: int | None) -> float:
    return 1 + math.log(tf) if tf else 1.0


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """doc_id and the other columns' rows of each document, from batches sorted by it."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for doc_id, own in groupby(rows, key=itemgetter(0)):
        yield doc_id, [r[1:] for r in own]


def by_document(rows: DataFrame, of: Callable[[list[tuple]], tuple[list, ...]], columns: dict[str, str], least: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns: what of() gives for the rows (order, text, least) of each document."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    own = rows.schema["order"].dataType.simpleString()
    names, types = ["doc_id", *columns], [pa.int64(), *map(kinds.get, columns.values())]

    def run(batches):
        ids, sizes, held = [], [], [[] for _ in columns]

        def batch():
            doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            return pa.RecordBatch.from_arrays([doc, *(pa.array(v, t) for v, t in zip(held, types[1:], strict=True))], names)

        for doc_id, own in _documents(batches):
            found = of(own)
            ids.append(doc_id)
            sizes.append(len(found[0]))
            for to, values in zip(held, found, strict=True):
                to += values
            if len(held[0]) >= BATCH:
                yield batch()
                ids, sizes, held = [], [], [[] for _ in columns]
        if ids:
            yield batch()

    dealt = rows.select(F.col("doc_id").cast("long"), "order", "text", *least).repartition("doc_id").sortWithinPartitions("doc_id", "order", "text")
    out = dealt.mapInArrow(run, ", ".join(["doc_id long", *(f"{k} {v}" for k, v in columns.items())]))
    return out.withColumn("order", F.col("order").cast(own)) if "order" in columns else out


def vocabularies(sentences: DataFrame, most: int = MOST, share: float = SHARE) -> DataFrame:
    """doc_id, term, df, n, rank: sentences.vocabulary() of sentences.term_frequency()."""

    def of(rows):
        doc = Document(rows)
        kept = doc.vocabulary(most, share)
        return [t for t, _ in kept], [df for _, df in kept], [doc.n] * len(kept), range(1, len(kept) + 1)

    return by_document(sentences.filter("doc_id IS NOT NULL"), of, {"term": "string", "df": "long", "n": "long", "rank": "int"})


def centroid(sentences: DataFrame, most: int = MOST, share: float = SHARE) -> DataFrame:
    """doc_id, term, value: the mean of sentences.vectors() of a document's sentences."""

    def of(rows):
        doc = Document(rows)
        kept = doc.vocabulary(most, share)
        more = Counter()  # what repeats within a sentence add to the df that the weights of single ones come to
        for s in doc.sentences:
            if isinstance(s, Counter):
                for t, tf in s.items():
                    if tf > 1:
                        more[t] += math.log(tf)
        n = doc.n
        return [t for t, _ in kept], [(df + more[t] if t in more else df) * idf / n for (t, df), idf in zip(kept, doc.idf(kept), strict=True)]

    return by_document(sentences.filter("doc_id IS NOT NULL"), of, {"term": "string", "value": "double"})


def summary_similarity(sentences: DataFrame, summaries: DataFrame | Column, most: int = MOST, share: float = SHARE) -> DataFrame:
    """sentences.sparse_summary_similarity()."""

    def of(rows):
        own = [r for r in rows if r[0] is not None]
        doc = Document(own)
        text = " ".join(r[1] for r in rows if r[2] and r[1] is not None)
        found = Counter(terms(tokens(plain.normalize_text(text))))
        kept = doc.vocabulary(most, share)
        idf = dict(zip((t for t, _ in kept), doc.idf(kept), strict=True))
        # Of the summary by term: its value times the idf that the sentence's has as a factor too.
        summary = {t: tf_weight(tf) * idf[t] for t, tf in found.items() if t in idf}
        own_norm, of_order = math.sqrt(sum(v * v for v in summary.values())), {}
        for order, s in zip(doc.orders, doc.sentences, strict=True):
            dot = square = 0.0
            for t, tf in s.items():
                if (x := idf.get(t)) is not None:
                    x = x * tf_weight(tf) if tf else x
                    square += x * x
                    if t in summary:
                        dot += x * summary[t]
            of_order[order] = dot / (math.sqrt(square) * own_norm) if dot else 0.0
        return [r[0] for r in own], [of_order[r[0]] for r in own]

    if isinstance(summaries, Column):
        rows = sentences.select("doc_id", "order", "text", summaries.alias("summary"))
    else:
        rows = sentences.select("doc_id", "order", "text", F.lit(False).alias("summary")).unionByName(summaries.select("doc_id", F.lit(None).cast("int").alias("order"), "text", F.lit(True).alias("summary")))
    out = by_document(rows, of, {"order": "long", "similarity": "double"}, ("summary",))
    return out.withColumn("similarity", F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.col("similarity")))
