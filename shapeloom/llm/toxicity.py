"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse features: words and beginnings of words.

One weight vector is shared by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k). The expected severity is
the sum of these over k. Labels only tell toxic from not, so a toxic row's grade (1 to GRADES) comes from
how many words it has that tell toxic from other rows.

The model is fitted on the driver, on at most SAMPLE labelled documents of each class, those of least hash of their doc_id among the
documents that there are. Every document is scored, over its whole text, in batches by the Python workers; its doc_id passes
through as it is, null or of any type.

Null and empty texts have severity 0 up to the intercept and are kept. Repeated rows get equal scores. A document that is
labelled both ways counts as toxic, and so does a text; of rows that share a labelled doc_id the least text is taken. Labels that are
null or of unknown documents are left out; without toxic rows, or without labels or documents, nothing is toxic. Other columns are kept by
keep_clean() and ignored by score().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import give_back, lean, ship, stored, table, texts_of

ship(__name__)

GRADES = 3
#: Labelled rows of each class, at most, that the fit uses, and the words it may use.
SAMPLE = 2000
WORDS = 256
PREFIX = 5
#: Least log odds ratio, in standard errors, of a word that the fit may use.
LEAST_Z = 3.0
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; all beyond ASCII counts as letters."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def features_of(text: str | None) -> list[bytes]:
    """The words, and of words over PREFIX bytes also their beginnings (marked by a star), repeats included."""
    words = words_of(text)
    return words + [w[:PREFIX] + b"*" for w in words if len(w) > PREFIX]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def linear(self, text: str | None) -> float:
        seen = Counter(w for w in features_of(text) if w in self.weights)
        return sum(self.weights[w] * (1 + math.log(n)) for w, n in seen.items())

    def severity(self, text: str | None) -> tuple[float, int]:
        """The expected grade, and the median one: toxic if that is 1 or more."""
        z = self.linear(text)
        return (
            float(sum(1 / (1 + math.exp(-max(-30.0, min(30.0, z - t)))) for t in self.thresholds)),
            sum(z >= t for t in self.thresholds),
        )


def _words_that_tell(rows: list[tuple[str, int]]) -> list[bytes]:
    n, df = [0, 0], (Counter(), Counter())
    for text, y in rows:
        n[y] += 1
        df[y].update(set(features_of(text)))

    def z(w: bytes) -> float:
        a, b = df[1][w] + 0.5, df[0][w] + 0.5
        odds = math.log(a / (n[1] - df[1][w] + 0.5)) - math.log(b / (n[0] - df[0][w] + 0.5))
        return odds / math.sqrt(1 / a + 1 / b + 1 / (n[1] - df[1][w] + 0.5) + 1 / (n[0] - df[0][w] + 0.5))

    found = sorted(((z(w), w) for w, k in df[1].items() if k >= 3), reverse=True)
    return [w for s, w in found[:WORDS] if s > LEAST_Z]


def likelihood(w: np.ndarray, x: np.ndarray, grade: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted log likelihood of the grades, and its gradient by w: the weights, then the GRADES thresholds."""
    some, up, down = np.arange(len(x)), grade >= 1, grade < GRADES
    p = _sigmoid((x @ w[:-GRADES])[:, None] - w[-GRADES:])  # P(grade >= k), k = 1 ...
    hi = np.concatenate([np.ones((len(x), 1)), p], 1)[some, grade]
    lo = np.concatenate([p, np.zeros((len(x), 1))], 1)[some, grade]
    d, mass = np.zeros_like(p), np.maximum(hi - lo, 1e-9)  # d: by w.x - theta_k
    d[some[up], grade[up] - 1] += (hi * (1 - hi) / mass)[up]
    d[some[down], grade[down]] -= (lo * (1 - lo) / mass)[down]
    d *= share[:, None]
    return float((share * np.log(mass)).sum()), np.concatenate([x.T @ d.sum(1), -d.sum(0)])


def fit(rows: list[tuple[str, int]], l1: float = 0.00005, steps: int = 600, rate: float = 0.1) -> Model:
    """rows: text and 0 or 1; both classes weigh the same. Adam steps, each followed by soft thresholding."""
    rows = sorted(dict(sorted((t or "", y) for t, y in rows)).items())  # a text counts once, as toxic if it is both
    words = _words_that_tell(rows)
    at = {w: i for i, w in enumerate(words)}
    if not words or all(y for _, y in rows):
        return Model({}, (30.0,) * GRADES)
    x, hits, y = np.zeros((len(rows), len(words)), "f4"), np.zeros(len(rows)), np.array([y for _, y in rows])
    for i, (text, _) in enumerate(rows):
        for w, k in Counter(w for w in features_of(text) if w in at).items():
            x[i, at[w]] = 1 + math.log(k)
            hits[i] += k
    cuts = np.quantile(hits[y == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, hits, side="right"), 0)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.concatenate([np.zeros(len(words)), np.arange(GRADES) * 0.5])  # weights, then thresholds
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = likelihood(w, x, grade, share)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w + size * m / (1 - 0.9**t)
        pull = np.minimum(size * l1, rate)[:-GRADES]
        w[:-GRADES] = np.maximum(w[:-GRADES] - pull, 0)  # the words chosen all speak for toxic
        gaps = np.arange(GRADES) * 0.5  # thresholds stay ordered and apart
        w[-GRADES:] = np.maximum.accumulate(w[-GRADES:] - gaps) + gaps
    found = {word: float(c) for word, c in zip(words, w, strict=False) if c}
    return Model(found, tuple(map(float, w[-GRADES:])))


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> list[tuple[str, int]]:
    """Text and label of at most n documents of each class."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("_id").agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    there = docs.select(F.col("doc_id").alias("_id")).distinct()
    known = stored(known.join(there, "_id", "left_semi"), "toxicity-labels")
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # at most 2 n rows
    found = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id"))
    found = found.groupBy("_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return [(r["text"], r["toxic"]) for r in found.collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.severity(t) for texts in texts_of(b.column("text")) for t in texts]
            severity, grade = [x for x, _ in found], [g for _, g in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array([g >= 1 for g in grade], pa.bool_())],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels)))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with their columns. Only texts go to the Python workers."""
    model = fit(labelled_sample(docs, labels))

    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                yield pa.array([model.severity(t)[1] < 1 for texts in texts_of(column) for t in texts], pa.bool_())
        finally:
            give_back()

    return docs.where(F.arrow_udf(clean, "boolean")("text"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
