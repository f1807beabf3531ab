"""Language identification by hierarchical discrimination.

A text's family is predicted first (one linear model for each family), then
one-versus-one linear support vector machines separate the languages of that
family. Features are hashed counts of byte bigrams and trigrams of the whole
lower-cased text.

The models are fitted on a bounded sample: at most `per_language` labelled rows
of each language, those with the smallest hash of their id. Prediction covers
every row and reads the text alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Language families by language code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
}
BINS = 4096
PER_LANGUAGE = 500
TREE = 64
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_WINDOW = 1 << 22


def has_letter(text: str) -> bool:
    """Whether a text has a letter (Unicode category L); numerals such as ½ or Ⅳ are none."""
    return any(c.isalpha() for run in _LETTERS.finditer(text) for c in run[0])


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def features(texts: list[str]) -> np.ndarray:
    """A unit row for each text: square roots of hashed n-gram counts."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    out = np.zeros((len(raw), BINS), np.float32)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    stream = np.frombuffer(b"".join(raw), np.uint8)
    flat = out.reshape(-1)
    for start in range(0, len(stream) - 1, _WINDOW):
        c = stream[start : start + _WINDOW + 2].astype(np.uint32)
        who = owner[start : start + _WINDOW + 2]
        lo = who[0]
        for n in (2, 3):
            k = min(_WINDOW, len(c) - n + 1)
            if k <= 0:
                continue
            h = c[:k].copy()
            for i in range(1, n):
                h = h * np.uint32(0x01000193) ^ c[i : i + k]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            inside = who[:k] == who[n - 1 : n - 1 + k]
            got = np.bincount(((who[:k] - lo) * BINS + h)[inside])
            flat[lo * BINS : lo * BINS + len(got)] += got
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, y of -1 and 1, by averaged subgradient descent with classes weighted alike."""
    x, y = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32), y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for t in range(1, rounds + 1):
        bad = y * (x @ w) < 1
        w -= np.float32(20.0 / np.sqrt(t)) * (np.float32(penalty) * w - (weight * y * bad) @ x)
        if t > rounds // 2:
            mean += w
    return mean / (rounds - rounds // 2)


class Hierarchy:
    """Family models, and one-versus-one machines within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for g in self.langs:
            self.members.setdefault(family_of(g), []).append(g)
        self.families = sorted(self.members)
        lang, fam = np.array(langs, object), np.array([family_of(g) for g in langs], object)
        ones = [fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else [np.zeros(x.shape[1] + 1)]
        self.family_w = np.array(ones).T
        self.pair_w = {}
        for f, members in self.members.items():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    own = (lang == a) | (lang == b)
                    self.pair_w[f, a, b] = fit_svm(x[own], np.where(lang[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(languages, scores from 0 to 1: the smaller of the family's and the language's confidence)."""
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = x @ self.family_w
        best = margins.argmax(1)
        rest = np.sort(margins, 1)
        sure = rest[:, -1] - rest[:, -2] if margins.shape[1] > 1 else np.full(len(x), 4.0)
        names = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == k), self.members[f]
            votes, lead = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = x[rows] @ self.pair_w[f, a, members[j]]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    lead[:, i] += m
                    lead[:, j] -= m
            if len(members) > 1 and len(rows):
                pick = (votes * 1e6 + lead).argmax(1)
                sure[rows] = np.minimum(sure[rows], lead[np.arange(len(rows)), pick] / (len(members) - 1))
            else:
                pick = np.zeros(len(rows), int)
            names[rows] = np.array(members, object)[pick]
        return names.tolist(), 1 / (1 + np.exp(-3.0 * np.clip(sure, -10, 10)))


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Fit on a bounded sample of labelled rows (doc_id, text, lang); None where no row has a language and a letter.

    Only rows' ids and languages are ranked, in two steps, so that no task gets more than
    per_language rows of each of TREE parts, however many rows and tasks there are. The
    sampled rows' features, at most per_language x languages of fixed length, come to the driver.
    """
    labelled = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").withColumn("part", F.spark_partition_id() % TREE)
    # Whatever part a row is in, the smallest hashes of a language are among the smallest of their parts.
    for of in (["lang", "part"], ["lang"]):
        w = Window.partitionBy(*of).orderBy(F.xxhash64("doc_id"), "doc_id")
        labelled = labelled.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_language)
    ids = [r[0] for r in labelled.select("doc_id").distinct().collect()]
    if not ids:
        return None

    def vectors(batches):
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            x = features([texts[i] for i in keep]).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([langs[i] for i in keep], pa.string()), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    sample = rows.filter(F.col("doc_id").isin(ids) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = sample.select("doc_id", "text", "lang").mapInArrow(vectors, "lang string, x binary").collect()
    if not got:
        return None
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    return Hierarchy(np.frombuffer(b"".join(x for _, x in got), np.float16).reshape(-1, BINS).astype(np.float32), [g for g, _ in got])


def predict(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """Add lang_pred and score to docs (which needs a column text). Null texts and texts without a letter are `und`, with score 0."""
    extra = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            keep = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            for at in range(0, len(keep), 512):
                some = keep[at : at + 512]
                got, s = model.predict(features([texts[i] for i in some]))
                for i, g in zip(some, got, strict=True):
                    names[i] = g
                scores[some] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], schema=pa.schema([*batch.schema, *extra]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
