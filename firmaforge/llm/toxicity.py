"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Insults are often disguised: 1d10t, i.d.i.o.t, i d i o t, idiiiot. Each suspicious string, however
long, is read as a lattice in which every character may stand for itself, for a letter that it
looks like, or (separators) for nothing or a word end, and a run of one letter for one or two.
Letters of any script stand for themselves. Viterbi decoding under a trigram language model of
characters, counted over all texts, finds the likeliest plain words. The words of a text and its
restored words are then scored.

The score rests on features (words, and their first four and five letters) that labelled
texts tie to the label: a feature's weight is the lower Wilson bound of the share of toxic
texts among those that have it; a text's score is the largest weight of its features. Very
many features are looked at, so one counts only if its share would be a rare accident among
all of them (``ACCIDENTS``), by its divergence from the share of toxic texts. Near copies
would count one observation many times, so labelled texts that share the least hash of their
word triples count once.

Labels are learned from a bounded sample (``LABELLED_ROWS``); the language model from every
text. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of a text without features; without
labels every score is 0; repeated rows each get a result row; null labels and ids don't train;
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import fresh, labelled_sample, map_text, remainder, table
from firmaforge.session import cut

LABELLED_ROWS = 20_000
LEAST_TEXTS = 5
ACCIDENTS = 0.01  # expected number of features that are there by chance
CONFIDENCE = 2.0
LETTERS = 32  # 0 word end, 1-26 a-z, 27-31 the other bytes by their last bits

# Letters that other characters stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h",
}
SEPARATORS = " .-_*~'`,:;/\\"
NEARLY = 8.0  # see inner_words
WORD_END = 0.5  # cost of a separator that is one

_CODE = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 5 if b >= 128 else 0 for b in range(256)], np.uint8)
_WORD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_L = r"[^\W\d_]"  # a letter of any script
# A letter, then a character that is none inside the same string, or a letter three times.
_ODD = re.compile(rf"{_L}(?:[^\w\s]|[\d_])+{_L}|[0-9@$!|+(<€£]{_L}|{_L}[0-9@$!|]|({_L})\1\1")
_SPACED = re.compile(rf"(?<![^\s.,;:!?])(?:(?:{_L}|[0-9@$!|])[ .\-_*]){{2,}}(?:{_L}|[0-9@$!|])(?![^\s.,;:!?])")
_TRIM = re.compile(r"^(?:[^\w@$!|+(<€£]|_)+|(?:[^\w@$|]|_)+$")
# The same for texts of ASCII, where they are cheaper.
_ODD_ASCII = re.compile(r"[a-z][^a-z\s]+[a-z]|[0-9@$!|+(<][a-z]|[a-z][0-9@$!|]|([a-z])\1\1")
_TWICE = re.compile(r"([a-z])\1")
LONGEST = 64  # characters of a disguised word whose decoding is remembered


def words(text: str) -> list[bytes]:
    return text.lower().encode(errors="replace").translate(_WORD).split()


def features(word: bytes) -> tuple[bytes, ...]:
    plain = word.decode(errors="replace")
    return (word, *(plain[:k].encode() + b"*" for k in (4, 5) if len(plain) > k))


# Language model


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns code, n: character trigrams of all texts, words apart."""

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = _CODE[np.frombuffer(f"  {t.lower()}  ".encode(errors="replace"), np.uint8)].astype(np.int32)
                    total += np.bincount(c[:-2] * LETTERS**2 + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["code", "n"])

    part = docs.select(F.col(f"`{text}`")).mapInArrow(run, "code int, n long")
    return part.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative logarithms) of a letter after two others, smoothed by shorter contexts."""
    n = np.zeros(LETTERS**3)
    for row in trigram_counts(docs, text).collect():
        n[row["code"]] = row["n"]
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + LETTERS)
    two = (n.sum(0) + 20 * one) / (n.sum(0).sum(1, keepdims=True) + 20)
    three = (n + 20 * two) / (n.sum(2, keepdims=True) + 20)
    return -np.log(three)


# Channel


def _options(ch: str, last: bool) -> list[tuple[str, float]]:
    """What a character may stand for, with its cost; "" for nothing, " " for a word end."""
    if ch.isalpha():
        return [(ch, 0.0)]
    found = [(c, 1.0 + 0.5 * i) for i, c in enumerate(LOOKS_LIKE.get(ch, ""))]
    if ch in SEPARATORS or (last and ch in "!") or not found:
        found.append(("", 0.5 if ch in SEPARATORS else 3.0))
        if ch in SEPARATORS:
            found.append((" ", WORD_END))
    return found


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """Steps of (letters, cost); a run of one letter is one step of one or two letters."""
    steps, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] == text[i]:
            j += 1
        run = j - i
        step = []
        for out, cost in _options(text[i], j == len(text)):
            if not out:
                step.append(("", cost * run))
            elif out == " ":
                step.append((" ", cost))
            else:
                step.append((out, cost + (0 if run == 1 else 1.0 if run == 2 else 0.3)))
                if run > 1:
                    step.append((out * 2, 2 * cost + (0 if run == 2 else 0.6)))
        steps.append(step)
        i = j
    return steps


def viterbi(text: str, model: np.ndarray) -> str:
    """The plain words of least cost. States are the last two codes; one pass of any length."""
    codes = lambda c: (ord(c) - 96,) if "a" <= c <= "z" else _CODE[list(c.encode(errors="replace"))].tolist()
    price = model.item
    best: dict = {(0, 0): (0.0, None)}
    for step in lattice(text):
        new: dict = {}
        read = [(out, paid, [0] if out == " " else [x for c in out for x in codes(c)]) for out, paid in step]
        for (a, b), (cost, so_far) in best.items():
            for out, paid, letters in read:
                x, y, total = a, b, cost + paid
                if letters == [0] and y == 0:
                    letters = []  # no word has begun
                for c in letters:
                    total += price(x, y, c)
                    x, y = y, c
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (so_far, out))
        best = new
    at = min(((cost + (model[a, b, 0] if b else 0.0), (a, b)) for (a, b), (cost, _) in best.items()))[1]
    out, node = [], best[at][1]
    while node:
        node, part = node
        out.append(part)
    return " ".join("".join(reversed(out)).split())


def cost_of(plain: str, model: np.ndarray) -> float:
    """The language model's cost of plain words."""
    c = [0, 0, *_CODE[list(plain.encode(errors="replace"))].tolist(), 0]
    return sum(map(model.item, c[:-2], c[1:-1], c[2:]))


def inner_words(plain: str, likely, model: np.ndarray) -> list[str]:
    """Words that ``likely`` takes and that a spaced-out run may hold besides those of its best path.

    Every letter of such a run may begin or end a word. Three letters can't tell "astupid" from
    "a stupid", so a reading counts whose cost is within ``NEARLY`` of the best one.
    """
    letters, ends = [], []
    for i, w in enumerate(plain.split()):
        letters += w
        ends += [False] * (len(w) - 1) + [True]
    found = []
    for i in range(len(letters)):
        for j in range(i + 3, min(len(letters), i + LONGEST) + 1):
            word = "".join(letters[i:j])
            if not likely(word):
                continue
            # The words around it as they are, up to the next word ends.
            a, b = i, j
            while a and not ends[a - 1]:
                a -= 1
            while b < len(letters) and not ends[b - 1]:
                b += 1
            best = "".join(c + " " * e for c, e in zip(letters[a:b], ends[a:b], strict=True)).strip()
            own = " ".join(filter(None, ("".join(letters[a:i]), word, "".join(letters[j:b]))))
            if cost_of(own, model) <= cost_of(best, model) + NEARLY:
                found.append(word)
    return found


def singles(word: str) -> list[str]:
    """A word of doubled letters with each of them once or twice; none if there are very many."""
    out = [""]
    at = 0
    for m in _TWICE.finditer(word):
        out = [w + word[at : m.start()] + m[0][:k] for w in out for k in (1, 2)]
        at = m.end()
        if len(out) > 256:
            return []
    return [w + word[at:] for w in out]


def suspicious(text: str) -> list[str]:
    """Strings of a lower-case text that may hide a word."""
    found = [_TRIM.sub("", m[0]) for m in _SPACED.finditer(text)]
    odd = _ODD_ASCII if text.isascii() else _ODD
    if odd.search(text):
        found += [s for w in set(text.split()) if odd.search(w) and (s := _TRIM.sub("", w)) and odd.search(s)]
    return [s for s in found if len(s) >= 3]


# Scores


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = LABELLED_ROWS) -> dict[bytes, float]:
    """Weights of features, from labelled texts whose id has a crc32 that 5 does not divide."""
    known = (
        labels.select(F.col("doc_id").alias("id_"), F.col("toxic").alias("toxic_"))
        .filter("id_ is not null and toxic_ is not null")
        .filter(remainder("id_", 5) != 0)
        .groupBy("id_")
        .agg(F.max("toxic_").alias("toxic_"))
    )
    sample = labelled_sample(known, rows, "id_")
    texts = docs.select(F.col("`doc_id`").alias("id_"), F.col(f"`{text}`").alias("text_"))
    # The sample is bounded by ``rows``, so it may go to all executors.
    own = texts.join(F.broadcast(sample), "id_").select("toxic_", "text_")

    def extract(ts):
        split = [words(t) if t else [] for t in ts]
        # Single words won't do: texts of one language share their least common word.
        triples = [[b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] for ws in split]
        least = [min(map(xxhash.xxh3_64_intdigest, own)) >> 1 for own in triples]
        return [least, [sorted({f for w in set(ws) for f in features(w)}) for ws in split]]

    seen = cut(
        map_text(own, extract, "least_ long, features_ array<binary>", ["toxic_"], "text_")
        .groupBy("least_")
        .agg(F.max_by("features_", F.size("features_")).alias("features_"), F.max("toxic_").alias("toxic_"))
    )
    counts = (
        seen.select("toxic_", F.explode("features_").alias("f"))
        .groupBy("f")
        .agg(F.sum("toxic_").alias("bad"), F.count("*").alias("n"))
    )
    share, z2 = F.col("bad") / F.col("n"), CONFIDENCE**2
    spread = CONFIDENCE * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))
    bound = (share + z2 / (2 * F.col("n")) - spread) / (1 + z2 / F.col("n"))
    counts = cut(counts)
    tried = counts.count()
    base = seen.agg(F.avg("toxic_")).first()[0] or 0.0
    if not 0 < base < 1:
        return {}
    # Texts times the divergence of the share from the base rate: the negative logarithm of
    # the chance to see such a share or a larger one, at least.
    part = lambda x, p: F.when(x > 0, x * F.log(x / F.lit(p))).otherwise(0.0)
    evidence = F.col("n") * (part(share, base) + part(1 - share, 1 - base))
    picked = (
        counts.filter(F.col("bad") >= LEAST_TEXTS)
        .filter((share > base) & (evidence >= float(np.log(max(tried, 1) / ACCIDENTS))))
        .select("f", bound.alias("w"), "bad", "n")
        .filter("w >= 0.2")
    )
    # All of them: each needs its evidence among the labelled rows, which are bounded.
    return without_borrowed({bytes(r["f"]): (float(r["w"]), int(r["bad"]), int(r["n"])) for r in picked.collect()})


def without_borrowed(picked: dict[bytes, tuple[float, int, int]]) -> dict[bytes, float]:
    """Weights of features, without beginnings that have theirs from a weighted word alone.

    ``picked``: feature -> weight, toxic texts, texts. What other words with a beginning say is
    left when the texts of its weighted words are taken away; the lesser of both weights
    counts. A beginning that no other word shares keeps its weight.
    """
    held: dict[bytes, list[int]] = {}
    for f, (_, bad, n) in picked.items():
        for begin in features(f)[1:] if not f.endswith(b"*") else ():
            total = held.setdefault(begin, [0, 0])
            total[0] += bad
            total[1] += n
    weights = {}
    for f, (w, bad, n) in picked.items():
        words_bad, words_n = held.get(f, (0, 0))
        rest, rest_bad = n - words_n, max(0, bad - words_bad)
        if words_n and rest > 0:
            share, z2 = min(1.0, rest_bad / rest), CONFIDENCE**2
            spread = CONFIDENCE * np.sqrt(share * (1 - share) / rest + z2 / (4 * rest * rest))
            w = min(w, float((share + z2 / (2 * rest) - spread) / (1 + z2 / rest)))
        if w >= 0.2:
            weights[f] = w
    return weights


class Scorer:
    """Scores texts with the weights of features and a language model."""

    def __init__(self, weights: dict[bytes, float], model: np.ndarray):
        self.weights, self.model = weights, model
        self.rest = 0.02 if weights else 0.0

    def start(self):
        weights, model = self.weights, self.model

        def weigh(word: bytes) -> float:
            return max((weights.get(f, 0.0) for f in features(word)), default=0.0)

        cache: dict[bytes, float] = {}
        known = lru_cache(20_000)(lambda s: viterbi(s, model))
        restore = lambda s: known(s) if len(s) <= LONGEST else viterbi(s, model)

        def of_word(word: bytes) -> float:
            got = weigh(word)
            if got < 0.5 and _TWICE.search(plain := word.decode(errors="replace")):
                # Decoding can only give one of these words, so it waits until one weighs more.
                each = singles(plain)
                if not each or any(weigh(w.encode()) > got for w in each):
                    got = max(got, *(weigh(w.encode()) for w in restore(plain).split()), 0.0)
            return got

        def score(text: str | None) -> float:
            if not text or not weights:
                return self.rest
            best = 0.0
            for w in set(words(text)):
                got = cache.get(w)
                if got is None:
                    if len(cache) > 100_000:
                        cache.clear()
                    got = cache[w] = of_word(w)
                best = max(best, got)
            if best < 0.5:
                for s in suspicious(text.lower()):
                    plain = restore(s)
                    best = max(best, *(weigh(w.encode()) for w in plain.split()), 0.0)
                    if best < 0.5 and _SPACED.fullmatch(s):
                        inner = inner_words(plain, lambda w: weights.get(w.encode(), 0.0) >= 0.5, model)
                        best = max(best, *(weights[w.encode()] for w in inner), 0.0)
            return max(best, self.rest)

        return score


def scored(
    docs: DataFrame, labels: DataFrame, keep: list[str], field: str = "score", text: str = "text", train: DataFrame | None = None
) -> DataFrame:
    """``keep`` and a score from 0 to 1 of each whole text."""
    source = docs if train is None else train
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(learn(source, labels, text), language_model(source, text)))
    started: list = []

    def run(texts):
        if not started:
            started.append(shared.value.start())
        return [list(map(started[0], texts))]

    return map_text(docs, run, f"`{field}` double", keep, text)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    field = fresh(docs.columns, "score_")
    return scored(docs, labels, docs.columns, field, text).filter(F.col(field) < threshold).drop(field)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


