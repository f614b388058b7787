"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) is the logistic of threshold k less one linear score: all grades share the
weights of hashed text features, only the thresholds differ, and they are ordered by
construction (each but the first adds a positive gap). A text gets its expected grade and the
probability of the upper grades, by which it is selected.

Features are tokens of a text, hashed to ``WIDTH`` weights: its words, the shapes of its
words, and steps of its length and of how much it repeats
itself. They are relative to the text's length, so whole texts of any length compare.

Fitted by Adam on a bounded sample (``LABELLED_ROWS``) of rated texts.

Defined results: null, empty and blank texts have no features but their length, and a grade
all the same; null ratings and ids don't train, repeated ratings of an id count by their
lowest; with no ratings or one grade alone, every text gets that grade (0 if there is none);
repeated rows each get a result row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import labelled_sample, lists, map_text, remainder, table

WIDTH = 1 << 14
LABELLED_ROWS = 6_000
ROUNDS = 200
PENALTY = 1e-4
SELECT = 0.5

def _slot(token: str) -> int:
    return zlib.crc32(token.encode(errors="replace")) % WIDTH


@lru_cache(200_000)
def coded(word: str) -> tuple[int, str]:
    """The slot of a word and its shape."""
    return _slot("word " + word.lower()), shape(word)


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, marks as they are; runs count once."""
    out = []
    for ch in word[:64]:
        c = "x" if ch.islower() else "X" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def tokens(text: str | None) -> dict[int, float]:
    """Weights of the hashed features of a text."""
    words = text.split() if text else []
    n = len(words)
    found: dict[int, float] = {}

    def add(token, value):
        slot = _slot(token)
        found[slot] = found.get(slot, 0.0) + value

    add(f"length {n.bit_length()}", 1.0)
    if not n:
        return found
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    add(f"distinct {10 * len(counts) // n}", 1.0)
    lines = [x for x in text.split("\n") if x.strip()]
    add(f"lines {5 * len(set(lines)) // max(1, len(lines))}", 1.0)
    shapes: dict[str, int] = {}
    for w, k in counts.items():
        slot, s = coded(w)
        shapes[s] = shapes.get(s, 0) + k
        found[slot] = found.get(slot, 0.0) + k / n
    for s, k in shapes.items():
        add("shape " + s, k / n)
        add(f"much {s} {(8 * k + n - 1) // n}", 1.0 if 8 * k >= n else 0.0)
    return found


def rows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: counts, slots, values."""
    made = [tokens(t) for t in texts]
    counts = np.array([len(m) for m in made], np.int64)
    slots = np.fromiter((k for m in made for k in m), np.int32, int(counts.sum()))
    values = np.fromiter((v for m in made for v in m.values()), np.float32, int(counts.sum()))
    return counts, slots, values


def _dot(counts, slots, values, w) -> np.ndarray:
    row = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(row, values * w[slots], minlength=len(counts))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.weights = np.zeros(WIDTH)
        self.first, self.gaps = 0.0, np.zeros(max(0, len(grades) - 2))

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))]) if len(self.grades) > 1 else np.zeros(0)

    def fit(self, counts, slots, values, y: np.ndarray, rounds: int = ROUNDS) -> Ordinal:
        """``y``: indices of grades. Adam on the mean negative logarithm of the likelihood."""
        k = len(self.grades)
        if k < 2 or not len(y):
            return self
        share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
        cuts = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        self.first = float(cuts[0])
        self.gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
        row = np.repeat(np.arange(len(counts)), counts)
        theta = np.concatenate([self.weights, [self.first], self.gaps])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            self.weights, self.first, self.gaps = theta[:WIDTH], float(theta[WIDTH]), theta[WIDTH + 1 :]
            cut = self.thresholds()
            score = np.bincount(row, values * self.weights[slots], minlength=len(counts))
            upper = np.where(y < k - 1, _logistic(cut[np.minimum(y, k - 2)] - score), 1.0)
            lower = np.where(y > 0, _logistic(cut[np.maximum(y - 1, 0)] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
            n = len(y)
            g_score = (up - low) / n
            g_cut = np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, -up, 0), minlength=k - 1)
            g_cut = (g_cut + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, low, 0), minlength=k - 1)) / n
            tail = np.cumsum(g_cut[::-1])[::-1]
            grad = np.concatenate(
                [
                    np.bincount(slots, values * g_score[row], minlength=WIDTH) + PENALTY * self.weights,
                    [tail[0]],
                    tail[1:] * np.exp(self.gaps),
                ]
            )
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.first, self.gaps = theta[:WIDTH].copy(), float(theta[WIDTH]), theta[WIDTH + 1 :].copy()
        return self

    def predict(self, counts, slots, values, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade of ``least`` or more."""
        n = len(counts)
        if len(self.grades) < 2:
            only = self.grades[0] if self.grades else 0
            return np.full(n, float(only)), np.full(n, float(only >= least))
        below = _logistic(self.thresholds()[None, :] - _dot(counts, slots, values, self.weights)[:, None])
        p = np.diff(np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1), axis=1)
        grades = np.array(self.grades)
        return p @ grades, p[:, grades >= least].sum(1)


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", rows: int = LABELLED_ROWS) -> Ordinal:
    """``ratings``: doc_id, grade. Learns from ids with a crc32 that 5 does not divide."""
    known = (
        ratings.select(F.col("doc_id").alias("id_"), F.col("grade").cast("int").alias("grade_"))
        .filter("id_ is not null and grade_ is not null")
        .filter(remainder("id_", 5) != 0)
        .groupBy("id_")
        .agg(F.min("grade_").alias("grade_"))
    )
    sample = labelled_sample(known, rows, "id_")
    texts = docs.select(F.col("`doc_id`").alias("id_"), F.col(f"`{text}`").alias("text_"))
    # The sample is bounded by ``rows``, so it may go to all executors.
    own = texts.join(F.broadcast(sample), "id_")

    def measure(ts):
        counts, slots, values = rows_of(ts)
        return [lists(slots, counts, pa.int32()), lists(values, counts, pa.float32())]

    taken = map_text(own, measure, "slots_ array<int>, values_ array<float>", ["grade_"], "text_").toArrow()
    if not taken.num_rows:
        return Ordinal([])
    flat = lambda name: np.concatenate([np.asarray(c.flatten()) for c in taken.column(name).chunks])
    counts = np.concatenate([np.diff(np.asarray(c.offsets)) for c in taken.column("slots_").chunks])
    given = np.asarray(taken.column("grade_"))
    grades = sorted(set(given.tolist()))
    return Ordinal(grades).fit(counts, flat("slots_"), flat("values_"), np.searchsorted(grades, given))


def graded(docs: DataFrame, model: Ordinal, keep: list[str], least: int, text: str = "text") -> DataFrame:
    """``keep``, expected_grade and tail_probability (of ``least`` or more) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        grade, tail = shared.value.predict(*rows_of(texts), least)
        return [pa.array(grade), pa.array(tail)]

    return map_text(docs, run, "expected_grade double, tail_probability double", keep, text)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 poor, 1 good but toxic, 2 good."""
    good, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(good == 1, 2 - toxic).when(good == 0, 0).alias("grade"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = graded(docs, fit(docs, ratings_of(table(spark, sf_dir, "labels"))), ["doc_id"], least=1)
    return found.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= SELECT).alias("selected"),
    )
