"""Language identification in two steps: the family first, then the language within it.

Texts are vectors of hashed byte trigrams and single bytes, of unit length. One linear support
vector machine for each pair of families votes for a family, then one for each pair of its
languages, which are closely related and differ in other features than families do. The
machines are fitted with the squared hinge loss on a bounded sample (``ROWS_PER_LANGUAGE``).

Families are a fixed table; a language that it does not name is a family of its own.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without
language or id don't train; without training rows all is ``und``; repeated rows each get a
result row; other columns are ignored. Language, source and id are never inputs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import lists, map_text, remainder, table

TRIGRAMS = 2048
WIDTH = TRIGRAMS + 256
ROWS_PER_LANGUAGE = 1500
UNKNOWN = "und"

# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy fo sco",
    "romance": "fr es it pt ro ca gl oc la ast wa",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs sh",
    "baltic": "lt lv",
    "uralic": "fi et hu se",
    "turkic": "tr az uz kk ky tt tk",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "celtic": "ga gd cy br",
    "malayic": "id ms jv su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Digits and ASCII marks say nothing of a language; runs of them become one blank.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_RNG = np.random.default_rng(11)
_T0, _T1, _T2 = (_RNG.integers(0, TRIGRAMS, 256, dtype=np.int32) for _ in range(3))
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def vectors(texts: list[str | None]) -> np.ndarray:
    """A unit vector of each text (zero if it has no letter)."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        data = b" " + b" ".join(t.lower().encode(errors="replace").translate(_PLAIN).split()) + b" "
        b = np.frombuffer(data, np.uint8)
        if len(b) < 3:
            continue
        codes = _T0[b[:-2]] ^ _T1[b[1:-1]] ^ _T2[b[2:]]
        v = np.sqrt(np.concatenate([np.bincount(codes, minlength=TRIGRAMS), np.bincount(b, minlength=256)]))
        out[i] = v / np.sqrt((v * v).sum())
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 120) -> np.ndarray:
    """A linear support vector machine (last weight: offset), squared hinge, y in -1, +1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Everything in single precision: mixed types would copy the matrix in each round.
    y = y.astype(np.float32)
    weight = (cost / len(x)) * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    weight = weight.astype(np.float32)
    rate = 1.0 / (1.0 + 2 * float((weight * (x * x).sum(1)).sum()))
    w, look = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    rate = np.float32(rate)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (look - 2 * (x.T @ (weight * slack * y)))
        look = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def vote(x: np.ndarray, classes: list, machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one votes, ties to the larger margins: class index and a score from 0 to 1."""
    votes, sums = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
    least = np.full((len(x), len(classes)), np.inf)
    for (a, b), w in machines.items():
        margin = x @ w[:-1] + w[-1]
        votes[:, a] += margin >= 0
        votes[:, b] += margin < 0
        for c, m in ((a, margin), (b, -margin)):
            sums[:, c] += np.clip(m, -1, 1)
            least[:, c] = np.minimum(least[:, c], m)
    best = np.argmax(votes + sums / (4 * len(classes)), axis=1)
    own = least[np.arange(len(x)), best]
    return best, 1 / (1 + np.exp(-3 * np.minimum(own, 20)))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family(lang), []).append(lang)
        self.names = sorted(self.families)
        of = np.array([self.names.index(family(lang)) for lang in langs], int)
        own = np.array(langs, object)
        self.between = self._pairs(x, of, range(len(self.names)))
        self.within = {
            f: self._pairs(x, own, codes) for f, codes in self.families.items() if len(codes) > 1
        }

    @staticmethod
    def _pairs(x, labels, classes) -> dict:
        out = {}
        for (i, a), (j, b) in combinations(enumerate(classes), 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            out[i, j] = fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = vectors(texts)
        lang, score = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts))
        if self.names:
            which, sure = vote(x, self.names, self.between)
            for f, name in enumerate(self.names):
                rows = np.flatnonzero(which == f)
                codes = self.families[name]
                if len(codes) == 1:
                    lang[rows], score[rows] = codes[0], sure[rows]
                    continue
                inner, certain = vote(x[rows], codes, self.within[name])
                lang[rows] = np.array(codes, object)[inner]
                score[rows] = sure[rows] * certain
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                lang[i], score[i] = UNKNOWN, 0.0
        return lang.tolist(), score.tolist()


def fit(docs: DataFrame, text: str = "text", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows whose id has a crc32 that leaves 0 or 2 when divided by 3.

    At most about ``rows`` rows of each language, chosen by a hash of the id.
    """
    known = docs.select(F.col("`doc_id`").alias("id_"), F.col("`lang`").alias("lang_"), F.col(f"`{text}`").alias("text_"))
    known = known.filter(F.col("lang_").isNotNull() & F.col("text_").isNotNull() & (remainder("id_", 3) != 1))
    counts = {r["lang_"]: r["count"] for r in known.groupBy("lang_").count().collect()}
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows / n))]) if counts else None
    if shares is None:
        return Model(np.zeros((0, WIDTH), np.float32), [])
    chance = F.pmod(F.xxhash64(F.lit(5), "id_"), F.lit(1_000_000)) / 1_000_000
    sample = known.filter(chance < shares[F.col("lang_")])

    def measure(texts):
        x = vectors(texts)
        return [lists(x.ravel(), np.full(len(x), WIDTH), pa.float32())]

    taken = map_text(sample, measure, "x_ array<float>", ["id_", "lang_"], "text_").drop("id_").toArrow()
    x = np.concatenate([np.asarray(c.flatten()) for c in taken.column("x_").chunks] or [np.zeros(0, np.float32)])
    return Model(x.reshape(-1, WIDTH), taken.column("lang_").to_pylist())


def identified(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double", keep, text)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
