"""Quality rules with adaptive thresholds. DataFrame functions only.

Each text is measured in one expression over its row. The shares that the rules look at are
gathered in mergeable quantile sketches (KLL), one per language and source; sketches of a
language's sources are merged for the language, and those of all languages for the corpus.
Fences are read from these sketches alone: the upper one is the 95th percentile, or four times
the spread of the lower half above the median if that is further out; word length has a lower
one too. A language's fences are pulled towards the corpus's and a source's towards its
language's, the more the fewer texts it has, without a step at any size. The fences are joined
back to the measures, and a text outside of a fence is not kept. Where 95 of 100 texts lack a
kind of character, the fence is zero but for that pull.

Defined results: null, empty and blank texts have no words and fail the base rule; null
languages and sources are groups of their own; repeated rows each get a result row; on an
empty table nothing is returned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import table
from firmaforge.session import cut

LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
MORE_LINES = 5
SKETCH_K = 800
SHRINK_ROWS = 300
REACH = 4.0
LOW, MIDDLE, HIGH = 0.05, 0.5, 0.95

SHARES = ("word_length", "symbols", "marks", "dup_lines", "repeated")
BELOW_TOO = ("word_length",)

_BLANK = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_MARKS = "!?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the text."""

    def covered(places):
        step = lambda acc, x: F.struct(
            x.alias("last"), (acc["total"] + F.least(F.lit(window), x - acc["last"])).alias("total")
        )
        return F.aggregate(places, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total")), step, lambda a: a["total"])

    def places(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(ordered, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h))),
    )
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(counted)


def measures(text: Column) -> Column:
    """Struct of a text's counts: words, lines, symbols, marks."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, _BLANK), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda s: F.trim(s, F.lit(" \t\n\x0b\f\r")) != "")
    of_lines = let(
        lines, lambda s: F.struct(F.size(s).alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines"))
    )
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    number = lambda chars: F.length(whole) - F.length(F.translate(whole, chars, ""))
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), number(_SYMBOLS).alias("n_symbols"), number(_MARKS).alias("n_marks")
    )


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], measures(F.col(f"`{text}`")).alias("m_"))
    found = {
        "n_words": "m_.w.n_words",
        "word_chars": "m_.w.word_chars",
        "n_symbols": "m_.n_symbols",
        "n_marks": "m_.n_marks",
        "n_lines": "m_.l.n_lines",
        "n_dup_lines": "m_.l.n_dup_lines",
        "n_repeat_words": "m_.w.n_repeat_words",
    }
    # Written, so that the sketches and the join don't measure the texts again.
    return cut(rows).select(*keep, *[F.col(v).cast("long").alias(k) for k, v in found.items()])


def shares() -> dict[str, Column]:
    """What the fences look at; null for a text without words."""
    of_words = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double"))
    return {
        "word_length": of_words("word_chars"),
        "symbols": of_words("n_symbols"),
        "marks": of_words("n_marks"),
        # One repeat among three lines says little: a few lines more are counted in.
        "dup_lines": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double") + MORE_LINES),
        "repeated": of_words("n_repeat_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """One row per language and source: a sketch of each share, of texts that pass the base rule."""
    return (
        rows.filter(~base_failed())
        .select(F.col(lang).alias("lang_"), F.col(source).alias("source_"), *[v.alias(k) for k, v in shares().items()])
        .groupBy("lang_", "source_")
        .agg(*[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in SHARES])
    )


def _fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and for each share its low, high (of this group alone) and its number of texts n."""

    def of(name):
        at = lambda q: F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(q)))
        low, middle, high = at(LOW), at(MIDDLE), at(HIGH)
        lower = middle - REACH * (middle - low) if name in BELOW_TOO else F.lit(-1.0)
        upper = F.greatest(high, middle + REACH * (middle - low))
        n = F.kll_sketch_get_n_double(name).cast("double")
        return F.struct(lower.alias("low"), upper.alias("high"), n.alias("n")).alias(name)

    return sketches.select(*keys, *[of(n) for n in SHARES])


def fences(groups: DataFrame, shrink_rows: int = SHRINK_ROWS) -> DataFrame:
    """Columns lang_, source_ and a struct low, high for each share.

    ``shrink_rows``: the number of texts at which a group's own fence and the wider group's
    weigh the same.
    """
    groups = cut(groups)
    merged = lambda df: df.agg(*[F.kll_merge_agg_double(n, SKETCH_K).alias(n) for n in SHARES])
    by_lang = cut(merged(groups.groupBy("lang_")))
    # One row of numbers: the corpus's fences.
    corpus = _fences(merged(by_lang.groupBy()), []).first()

    def pulled(own, wide):
        share = F.lit(float(shrink_rows)) / (own["n"] + F.lit(float(shrink_rows)))
        to = lambda side: (own[side] + (wide[side] - own[side]) * share).alias(side)
        return F.struct(to("low"), to("high"))

    fixed = lambda n: {side: F.lit(corpus[n][side]).cast("double") for side in ("low", "high")}
    of_lang = _fences(by_lang, ["lang_"]).select(
        F.col("lang_").alias("l_"), *[pulled(F.col(n), fixed(n)).alias(f"{n}_l") for n in SHARES]
    )
    joined = _fences(groups, ["lang_", "source_"]).join(of_lang, F.col("lang_").eqNullSafe(F.col("l_")))
    return joined.select("lang_", "source_", *[pulled(F.col(n), F.col(f"{n}_l")).alias(n) for n in SHARES])


def judged(rows: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """``rows`` with base_failed and kept."""
    inside = F.lit(True)
    for name, share in shares().items():
        limit = F.col(f"limits_.{name}")
        inside &= (share >= limit["low"]) & (share <= limit["high"])
    held = limits.select("lang_", "source_", F.struct(*SHARES).alias("limits_"))
    together = rows.join(
        held, F.col(lang).eqNullSafe(F.col("lang_")) & F.col(source).eqNullSafe(F.col("source_")), "left"
    )
    failed = base_failed()
    # A group without a passing text has no fences, and no text to judge by them.
    return together.select(
        *rows.columns, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept")
    )


def quality_rules(docs: DataFrame, doc_id="doc_id", lang="lang", source="source", text="text") -> DataFrame:
    """Measures, base_failed and kept of every row."""
    rows = measured(docs, [doc_id, lang, source], text)
    return judged(rows, fences(sketches(rows, lang, source)), lang, source)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
