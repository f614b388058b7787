"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern. The pattern lets a word begin with one
space and hold no other, so a text may be cut before its single spaces first and the pieces,
which repeat, into words once each. The ranked merges of a word are a fold in
Spark higher-order functions: its bytes (as pairs of hex digits) are parts, and each step
joins the two neighbours whose join has the lowest rank, leftmost first. Ranks stand in the
plan as one literal, a map split by the hash of its keys because a map column is searched from
front to back.

Words repeat, so the fold runs on distinct words: the most frequent ones (at most
``dictionary_words`` of ``WORD_BYTES`` bytes at most, thus of bounded size) are encoded once
and sent to the tasks. A fold costs some 70 microseconds a word, and distinct words grow with
the corpus, so folding every rare word does not fit the limits (see the README); rare words
are merged in the task that meets them, by the same rule and with the same result.

Decoding concatenates the binary pieces of the ids.

Defined results: null and empty texts have no ids and decode to nothing; no special tokens;
repeated rows each get a result row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import fresh, slices, table
from firmaforge.session import cut

WORD_BYTES = 64
LONG = 100
DICTIONARY_WORDS = 1 << 18
SHARDS = 1 << 15
NO_MERGE = (1 << 31) - 1
COUNTED_AT_ONCE = 400_000
KEPT_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _shard_of(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(SHARDS))


class Ranks:
    """The ranks of a vocabulary as one literal; pieces are strings of hex digits."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        # The shard of a piece is Spark's own hash of it; the vocabulary is a fixed file.
        # An Arrow table goes to the JVM as it is; rows of Python would start another set of workers.
        rows = {"piece": pa.array([k.hex() for k in ranks], pa.string()), "rank": pa.array(ranks.values(), pa.int32())}
        pieces = spark.createDataFrame(pa.table(rows), "piece string, rank int")
        parts: list[dict[str, int]] = [{} for _ in range(SHARDS)]
        for piece, rank, shard in pieces.select("piece", "rank", _shard_of(F.col("piece"))).collect():
            parts[shard][piece] = rank
        self.literal = F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<map<string,int>>")

    def encode(self, word: Column) -> Column:
        """The ids (array<int>) of one word."""
        return F.transform(F.array(self.literal), lambda table: fold(table, word))[0]


def fold(table: Column, word: Column) -> Column:
    """Fold the ranked merges of a word. ``table``: array of maps from piece to rank."""

    def rank(piece):
        return F.coalesce(table[_shard_of(piece)][piece], F.lit(NO_MERGE))

    digits = F.lower(F.hex(F.encode(word, "UTF-8")))
    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    end = F.array(F.lit("-"))

    def start(parts):
        ranks = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))),
        )
        return F.struct(parts.alias("parts"), ranks.alias("ranks"))

    def merge(state, k):
        # k: 1-based place of the left neighbour; "-" at both ends never merges.
        parts, ranks = state["parts"], state["ranks"]
        joined = F.concat(F.element_at(parts, k), F.element_at(parts, k + 1))
        m = F.size(parts)
        return F.struct(
            F.concat(F.slice(parts, 1, k - 1), F.array(joined), F.slice(parts, k + 2, m)).alias("parts"),
            F.concat(
                F.slice(ranks, 1, k - 2),
                F.array(
                    rank(F.concat(F.element_at(parts, k - 1), joined)),
                    rank(F.concat(joined, F.element_at(parts, k + 2))),
                ),
                F.slice(ranks, k + 2, m),
            ).alias("ranks"),
        )

    def step(state, _):
        best = F.array_min(state["ranks"])
        place = F.array_position(state["ranks"], best).cast("int")
        return F.when(best == NO_MERGE, state).otherwise(F.transform(F.array(place), lambda k: merge(state, k))[0])

    first = F.transform(F.array(F.concat(end, single, end)), start)[0]
    folded = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["parts"])
    ids = F.transform(F.filter(folded, lambda p: p != "-"), rank)
    whole = rank(digits)
    return F.when(n == 0, F.array().cast("array<int>")).when(whole != NO_MERGE, F.array(whole)).otherwise(ids)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in a task: the ids of one word."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    joins = [ranks.get(a + b, NO_MERGE) for a, b in zip(parts, parts[1:], strict=False)]
    while joins:
        best = min(joins)
        if best == NO_MERGE:
            break
        i = joins.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_MERGE)
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], NO_MERGE)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a heap of neighbours, for words of any length."""
    n = len(word)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, left[i], end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# Where a space has white space beside it or ends a text, the pattern has to see the whole
# text; texts with rare white space are not looked at more closely.
_RARE_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def pieces(text: str) -> list[str] | None:
    """The text cut at its single spaces (left out), or None if that might change its words."""
    if text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_SPACES):
        return None
    return text.split(" ")


def word_counts(docs: DataFrame, pattern: str, text: str = "text", at_once: int = COUNTED_AT_ONCE) -> DataFrame:
    """Columns word, n: how often each word of at most ``WORD_BYTES`` bytes stands in the texts."""

    def run(batches):
        find = regex.compile(pattern).findall
        inner: Counter = Counter()  # pieces with a space in front
        count: Counter = Counter()

        def out():
            for piece, n in inner.items():
                for word in find(" " + piece):
                    count[word] += n
            short = [w for w in count if len(w.encode()) <= WORD_BYTES]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(short, pa.string()), pa.array([count[w] for w in short], pa.int64())], names=["word", "n"]
            )
            inner.clear()
            count.clear()
            return batch

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    cut_ = pieces(t) if t else []
                    if cut_ is None:
                        count.update(find(t))
                    elif cut_:
                        count.update(find(cut_[0]))
                        inner.update(cut_[1:])
                if len(inner) + len(count) > at_once:
                    yield out()
        yield out()

    part = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest powers of two of ``n`` that are at most ``most`` words."""
    level = F.floor(F.log2("n")).cast("int")
    rows = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, 64
    for r in rows:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.filter(level >= least).select("word")


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    keep: list[str],
    finish,
    fields: str,
    text: str = "text",
    dictionary_words: int = DICTIONARY_WORDS,
    kept_pieces: int = KEPT_PIECES,
    counted_at_once: int = COUNTED_AT_ONCE,
) -> DataFrame:
    """``keep`` and ``fields``, which ``finish`` makes of each text's ids.

    ``finish`` gets the ids of a text as little-endian unsigned 32-bit integers (bytes) and
    returns a tuple of values. The pattern must let a word hold a space only in front. The
    last three parameters trade memory of a task for time and don't change results.
    """
    spark = docs.sparkSession
    rank = Ranks(spark, ranks)
    counts = cut(word_counts(docs, pattern, text, counted_at_once))
    # A fold is long work on few bytes, so its rows are dealt out and not left to their size.
    tasks = 2 * spark.sparkContext.defaultParallelism
    coded = frequent(counts, dictionary_words).repartition(tasks).select("word", rank.encode(F.col("word")).alias("ids"))
    known: dict[str, bytes] = {}
    for batch in coded.toArrow().to_batches():
        ids = batch.column(1)
        flat, at = np.asarray(ids.flatten()).astype("<u4").tobytes(), (np.asarray(ids.offsets) - ids.offsets[0].as_py()) * 4
        known.update((w, flat[a:b]) for w, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
    shared = spark.sparkContext.broadcast(known)
    del known
    vocabulary = spark.sparkContext.broadcast(ranks)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    name = fresh(keep, "text_")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(name))
    added = StructType.fromDDL(fields)
    schema = StructType([*(docs.schema[c] for c in keep), *added.fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def build(batches):
        find = regex.compile(pattern).findall
        have, table_of = shared.value, vocabulary.value
        own: dict[str, bytes] = {}  # by piece, with a space in front

        def word_ids(word):
            got = have.get(word)
            return got if got is not None else np.array(merge(word.encode(), table_of), "<u4").tobytes()

        def whole(text):
            return b"".join(map(word_ids, find(text)))

        def code(piece):
            got = own.get(piece)
            if got is None:
                if len(own) >= kept_pieces:
                    own.clear()
                got = own[piece] = whole(" " + piece)
            return got

        def ids_of(text):
            if not text:
                return b""
            cut_ = pieces(text)
            return whole(text) if cut_ is None else whole(cut_[0]) + b"".join(map(code, cut_[1:]))

        for batch in batches:
            for part in slices(batch, len(keep)):
                rows = [finish(ids_of(t)) for t in part.column(len(keep)).to_pylist()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *cols], names=schema.names)

    return source.mapInArrow(build, schema)


class Decoder:
    """Concatenates the binary pieces of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    decode = Decoder(ranks)

    def finish(ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids)).hexdigest()

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(table(spark, sf_dir, "documents"), ranks, pattern, ["doc_id"], finish, fields)
