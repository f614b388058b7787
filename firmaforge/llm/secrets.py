"""Secret scans: fixed patterns, and novelty measured by dictionary-primed zstandard.

A candidate is a long string behind a sensitive word, or a string of any characters that is
assigned to a name with a sensitive word (KEY=VALUE, query strings and quotes included). Names
in front of = are no part of a candidate, and neither are spans of the fixed patterns.
Its marginal compressed bytes are the bytes that the compressor, primed with a dictionary of
the corpus's identifiers, needs for the surrounding code with the candidate, less those for
the surrounding code alone. Words, paths and identifiers compress; keys don't. A candidate
that costs at least ``novelty`` bytes a character is a span of kind ``novel``.

Defined results: a null or empty text has no spans; whole texts are searched; spans count code
points, the end is exclusive; equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import fresh, map_text, table

# The patterns of the base spans, and the words of a sensitive context.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"(?ai:passw|passphrase|pwd|secret|token|key|auth|cred|bearer|private|signature|session|salt|jwt|hmac)"
)
# An = that is no padding parts a name from its value.
PART = re.compile(r"=+(?=[^=])")
# A value, and the name in front of it; the name's sensitive word is a word of its own, so
# "author" is none.
NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
ASSIGNS = re.compile(r":=|=>|[:=]")
VALUE = re.compile(r"""(?a)[\x20\t]*+(?:"([^"\n]{6,}+)"|'([^'\n]{6,}+)'|([^\s"'`,;&<>()\[\]{}]{6,}))""")
NAME_WORD = re.compile(
    r"(?ai:(?<![a-z])(?:passw(?:or)?ds?|passphrases?|pwd|secrets?|tokens?|(?:api|access|secret|private|auth|db|master)?keys?"
    r"|auth|authorization|cred(?:ential)?s?|bearer|private|signature|sig|session|salt|jwt|hmac)(?![a-z]))"
)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

IDENTIFIER = re.compile(r"([A-Za-z_][A-Za-z0-9_]{2,40})[\"']?\x20?$", re.ASCII)
DICTIONARY_BYTES = 16 << 10
NOVELTY = 0.5
NEAR = 48
LEAST_LONG = 16
LEAST_VALUE = 6  # as in the assign pattern
AROUND = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(spans)


def identifiers(text: str) -> list[str]:
    """Names in front of = and :, the identifiers that a text assigns to."""
    found = []
    for mark in "=:":
        at = text.find(mark)
        while at >= 0:
            if m := IDENTIFIER.search(text[max(0, at - 44) : at]):
                found.append(m[1])
            at = text.find(mark, at + 1)
    return found


def identifier_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each identifier is assigned to in all texts: columns name, n."""

    def run(batches):
        for batch in batches:
            count = Counter(x for t in batch.column(0).to_pylist() if t for x in identifiers(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["name", "n"]
            )

    part = docs.select(F.col(f"`{text}`")).mapInArrow(run, "name string, n long")
    return part.groupBy("name").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """The most used identifiers, most used last, where a zstandard dictionary is cheapest."""
    top = identifier_counts(docs, text).orderBy(F.desc("n"), "name").limit(DICTIONARY_BYTES // 4).collect()
    names, size = [], 0
    for row in top:
        size += len(row["name"]) + 3
        if size > DICTIONARY_BYTES:
            break
        names.append(row["name"])
    return "".join(f"{n} = " for n in reversed(names)).encode()


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = None
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=6, dict_data=primed, write_checksum=False, write_content_size=False
        )

    def marginal(self, text: str, start: int, end: int) -> int:
        own = text[start:end]
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        around = around.replace(own, "").encode(errors="replace")
        size = lambda data: len(self.compressor.compress(data))
        return size(around + b"\n" + own.encode(errors="replace")) - size(around + b"\n")

    def spans(self, text: str, base: list[tuple[int, int, int]], novelty: float) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for a, b in candidates(text):
            for start, end in outside(a, b, [*base, *out]):
                if end - start >= LEAST_VALUE and self.marginal(text, start, end) >= novelty * (end - start):
                    out.append((start, 3, end))
        return sorted(out)


def name_before(text: str, at: int) -> str:
    """The name that ends in front of ``at``, a quote and blanks between them, of any length."""
    while at and text[at - 1] in " \t":
        at -= 1
    at -= bool(at) and text[at - 1] in "\"'"
    start = at
    while start and text[start - 1] in NAME_LETTERS:
        start -= 1
    return text[start:at].lstrip("0123456789.-")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings to be measured, whole values of names first."""
    found = []
    done = 0
    for m in ASSIGNS.finditer(text):
        # The name decides first, so that a value is read for each sensitive name only.
        if m.start() < done or not (name := name_before(text, m.start())) or not NAME_WORD.search(CAMEL.sub("_", name)):
            continue
        if value := VALUE.match(text, m.end()):
            found.append(value.span(value.lastindex))
            done = value.end()
    for m in CANDIDATE.finditer(text):
        run, a, near = m[0], m.start(), max(0, m.start() - NEAR)
        bounds = [0, *(k for p in PART.finditer(run) for k in p.span()), len(run)]
        for i, j in zip(bounds[::2], bounds[1::2], strict=True):
            # The names in front within the string count, however long they are.
            if j - i >= LEAST_LONG and SENSITIVE.search(text[near : a + i]):
                found.append((a + i, a + j))
    return found


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of start to end without the spans."""
    left = []
    for a, _, b in sorted(s for s in spans if s[0] < end and start < s[2]):
        if a > start:
            left.append((start, a))
        start = max(start, b)
    if start < end:
        left.append((start, end))
    return left


def all_spans(text: str, measure: Novelty, novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, kind, end) of fixed patterns and novel strings, by start and kind."""
    base = base_spans(text)
    return sorted(base + measure.spans(text, base, novelty))


def scan(
    docs: DataFrame, keep: list[str], field: str = "spans", text: str = "text", novelty: float = NOVELTY
) -> DataFrame:
    """``keep`` and ``field``: array of (kind, start, end) of each whole text, by start and kind."""
    dictionary = identifier_dictionary(docs, text)

    def find(texts):
        measure = Novelty(dictionary)
        found = [all_spans(t, measure, novelty) if t else [] for t in texts]
        return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]]

    return map_text(docs, find, f"`{field}` array<struct<kind:string,start:int,end:int>>", keep, text)


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """All rows and columns of ``docs``; every span of a text is replaced by ``mark``."""
    names = docs.columns
    out = fresh(names, "clean_")
    dictionary = identifier_dictionary(docs, text)

    def clean(row_text, spans):
        parts, at = [], 0
        for start, _, end in spans:
            if start >= at:
                parts += [row_text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, row_text[at:]])

    def run(texts):
        measure = Novelty(dictionary)
        return [[clean(t, spans) if t and (spans := all_spans(t, measure)) else t for t in texts]]

    # One pass over the texts, and so one Python worker for each task.
    done = map_text(docs, run, f"`{out}` string", names, text)
    changed = ~F.col(out).eqNullSafe(F.col(f"`{text}`"))
    return done.select(
        *[
            F.col(out).alias(c)
            if c == text
            else F.when(changed, F.length(out)).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c)
            if c == length
            else F.col(f"`{c}`")
            for c in names
        ]
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text_of(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text_of(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
