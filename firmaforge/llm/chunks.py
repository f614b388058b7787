"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash rolls over the bytes of a text; where it is greater than at the ``LEAST_CHUNK`` places
on either side, a chunk ends. The hash sees ``REACH`` bytes, so where chunks end depends on some forty bytes
around, and the same passage gets the same chunks in any text, however much is inserted in
front of it. (An earlier rule, some bits zero and a least and a greatest size, left 2 % of passages of 51 short words
without a whole chunk in common.) A chunk whose 64-bit digest stands elsewhere too is a repeat;
the copy of the smallest document id (null ids last, then the first row, then the first place in
it) is the original. Repeats that touch form runs. The chunks at the ends of a passage differ
with its surroundings, so each run is an anchor: at its ends it is compared byte by byte with the
text that holds its outermost chunk, as far as they agree; a run too short to be reported is compared
with every text that holds a chunk of it, which may reach further. Runs that touch or overlap after that form
passages, and those of ``least_words`` whole words (or ``LEAST_BYTES`` bytes, for writing without
blanks) are reported.

A chunk that very many texts hold is counted before the shuffle and joined back by a join that
Spark may split; nothing gathers its holders. The comparison sends surroundings of ``NEAR`` bytes,
each asked for once however many copies refer to it; where two agree all along, a further round
sends eight times as much, until every one has ended.

Defined results: null and empty texts have no chunks; every row is a document of its own, also
where it repeats an id or has none; offsets are bytes of the UTF-8 text, the end exclusive, and an
end found by comparison never parts a character; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from firmaforge.llm.batches import slices, table
from firmaforge.session import cut

LEAST_CHUNK = 24
MOST_CHUNK = 80
LEAST_WORDS = 50
LEAST_BYTES = 600
NEAR = 256
REACH = 16

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n = len(data)
    if not n:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # doubling: after these steps a hash covers REACH bytes
        h[k:] += h[:-k] << np.uint32(k)
    # The greatest of the LEAST_CHUNK hashes that end at a place, by doubling too.
    top, width = h.copy(), 1
    while width < LEAST_CHUNK:
        k = min(width, LEAST_CHUNK - width)
        top[k:] = np.maximum(top[k:], top[:-k]) if n > k else top[k:]
        width += k
    peak = np.ones(n, bool)
    peak[1:] = h[1:] > top[:-1]
    if n > LEAST_CHUNK:
        peak[:-LEAST_CHUNK] &= h[:-LEAST_CHUNK] >= top[LEAST_CHUNK:]
    peak[: LEAST_CHUNK - 1] = peak[max(0, n - LEAST_CHUNK) :] = False
    out, at = [], 0
    for m in [*(np.flatnonzero(peak) + 1).tolist(), n]:
        while m - at > MOST_CHUNK:
            at += MOST_CHUNK - LEAST_CHUNK
            out.append(at)
        out.append(m)
        at = m
    return out


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns row, doc_id, text; written, so that a row keeps its number whatever is lost."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))


def _blank(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return (b == 32) | ((b >= 9) & (b <= 13))


def _word_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each offset: words that start before it, and words that end at it or before."""
    word = ~_blank(data)
    starts, stops = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    return tuple(np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (starts, stops))


def chunked(rows: DataFrame, placed: bool = True) -> DataFrame:
    """One row per chunk of :func:`numbered` rows: row, digest, start, and doc_id or its measures.

    placed: size, words that start before it, words that end in it or before, and whether it is
    the text's last; otherwise doc_id.
    """
    source = rows.select("row", "doc_id", "text")
    kind = source.schema["doc_id"].dataType
    more = "size int, before int, upto int, tail boolean" if placed else f"doc_id {kind.simpleString()}"

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                counts, digests, cols = [], [], [[], [], [], [], []]
                for t in part.column(2).to_pylist():
                    data = t.encode(errors="replace") if t else b""
                    z = ends(data)
                    a = [0, *z[:-1]] if z else []
                    counts.append(len(z))
                    digests += [digest(data[i:j]) for i, j in zip(a, z, strict=True)]
                    cols[0] += a
                    if placed and z:
                        starts, stops = _word_counts(data)
                        cols[1] += [j - i for i, j in zip(a, z, strict=True)]
                        cols[2] += starts[a].tolist()
                        cols[3] += stops[z].tolist()
                        cols[4] += [False] * (len(z) - 1) + [True]
                at = pa.array(np.repeat(np.arange(part.num_rows), counts))
                arrays = [part.column(0).take(at), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(cols[0], pa.int32())]
                names = ["row", "digest", "start"]
                if placed:
                    arrays += [pa.array(c, pa.int32()) for c in cols[1:4]] + [pa.array(cols[4], pa.bool_())]
                    names += ["size", "before", "upto", "tail"]
                else:
                    arrays.append(part.column(1).take(at))
                    names.append("doc_id")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, f"row long, digest long, start int, {more}")


def repeats(rows: DataFrame) -> DataFrame:
    """Chunks that stand in more than one place, each with another place that holds it.

    later: an earlier place holds it, and p_row, p_start, first_id tell the first one; otherwise
    it is itself the first, and they tell the last.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    held = (
        chunked(rows, placed=False)
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first.row <> last.row or first.start <> last.start")
    )
    later = (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    other = F.when(later, F.col("first")).otherwise(F.col("last"))
    return chunked(rows).join(held, "digest").select(
        "row", "start", "size", "before", "upto", "tail", later.alias("later"),
        other["row"].alias("p_row"), other["start"].alias("p_start"), F.col("first.doc_id").alias("first_id"),
    )


def runs(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of touching repeats, and what to compare at their ends.

    asks: side (-1 left, 1 right), place, words up to it, and the other text's place; none where the
    text itself ends. A run of fewer than ``least_words`` and ``LEAST_BYTES`` asks for each way in
    which it lies against another text, a longer one for that of its outermost chunk: what stands
    beyond it is less than a chunk, and can't decide whether it is reported.
    """
    found = repeats(rows)
    names = ["start", "size", "before", "upto", "tail", "later", "p_row", "p_start", "first_id"]
    gathered = found.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("found"))
    id_kind = found.schema["first_id"].dataType
    ids = pa.list_(to_arrow_type(id_kind))
    ask = pa.struct(
        [("side", pa.int32()), ("at", pa.int32()), ("words", pa.int32()), ("p_row", pa.int64()), ("p_at", pa.int32())]
    )

    def asked(run):
        lefts, rights = {}, {}
        first, last = run[0], run[-1]
        enough = last["upto"] - first["before"] >= least_words or last["start"] + last["size"] - first["start"] >= LEAST_BYTES
        for c in (first, last) if enough else run:
            way = (c["p_row"], c["p_start"] - c["start"])
            end = c["start"] + c["size"]
            lefts.setdefault(way, (-1, c["start"], c["before"], c["p_row"], c["p_start"]))
            rights[way] = (1, end, c["upto"], c["p_row"], c["p_start"] + c["size"])
        if enough:
            lefts, rights = dict([next(iter(lefts.items()))]), dict([list(rights.items())[-1]])
        out = list(lefts.values()) if first["start"] else []
        out += [] if last["tail"] else list(rights.values())
        return [dict(zip(("side", "at", "words", "p_row", "p_at"), a, strict=True)) for a in out]

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                own = batch.column(0)[one].as_py()
                chunks, parts = batch.column(1)[one].as_py(), []
                chunks.sort(key=lambda c: (c["later"], c["start"]))
                for c in chunks:
                    last = parts[-1][-1] if parts else None
                    if last and last["later"] == c["later"] and last["start"] + last["size"] == c["start"]:
                        parts[-1].append(c)
                    else:
                        parts.append([c])
                if not parts:
                    continue
                ints = lambda f: pa.array([f(p) for p in parts], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own] * len(parts), pa.int64()),
                        pa.array(np.arange(len(parts), dtype=np.int32)),
                        pa.array([p[0]["later"] for p in parts]),
                        ints(lambda p: p[0]["start"]),
                        ints(lambda p: p[-1]["start"] + p[-1]["size"]),
                        ints(lambda p: p[0]["before"]),
                        ints(lambda p: p[-1]["upto"]),
                        pa.array([list({c["first_id"]: 0 for c in p if c["later"]}) for p in parts], ids),
                        pa.array([asked(p) for p in parts], pa.list_(ask)),
                    ],
                    names=["row", "run", "later", "start", "end", "before", "upto", "first_ids", "asks"],
                )

    return gathered.mapInArrow(
        run,
        f"row long, run int, later boolean, start int, end int, before int, upto int, first_ids array<{id_kind.simpleString()}>, "
        "asks array<struct<side:int,at:int,words:int,p_row:long,p_at:int>>",
    )


def surroundings(rows: DataFrame, asks: DataFrame, near: int) -> DataFrame:
    """row, at, side, bytes: ``near`` bytes on one side of each place that ``asks`` names."""
    own = asks.select("row", "at", "side")
    other = asks.select(F.col("p_row").alias("row"), F.col("p_at").alias("at"), "side")
    # A text's places are no more than its chunks, and are made distinct before the shuffle.
    places = own.union(other).groupBy("row").agg(F.collect_set(F.struct("at", "side")).alias("places"))
    joined = rows.join(places, "row").select("row", "places", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                counts, ats, sides, bits = [], [], [], []
                for wanted, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = t.encode(errors="replace")
                    counts.append(len(wanted))
                    ats += [w["at"] for w in wanted]
                    sides += [w["side"] for w in wanted]
                    bits += [data[max(0, w["at"] - near) : w["at"]] if w["side"] < 0 else data[w["at"] : w["at"] + near] for w in wanted]
                at = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(ats, pa.int32()), pa.array(sides, pa.int32()), pa.array(bits, pa.binary())],
                    names=["row", "at", "side", "bytes"],
                )

    return joined.mapInArrow(run, "row long, at int, side int, bytes binary")


def agreement(own: bytes, other: bytes, side: int, near: int) -> tuple[int, int, bool]:
    """How many bytes agree next to a place, the words that start or end there, and if that is all."""
    n = min(len(own), len(other))
    a, b = (np.frombuffer(x, np.uint8)[::side][:n] for x in (own, other))
    differ = np.flatnonzero(a != b)
    n = int(differ[0]) if len(differ) else n
    if n == near:
        return n, 0, False
    # The byte after an end on the right, or the one that starts the passage on the left, must
    # not be in the middle of a character.
    inner = lambda k: 0 <= k < len(own) and own[k] & 0xC0 == 0x80
    while n and inner(len(own) - n if side < 0 else n):
        n -= 1
    if not n:
        return 0, 0, True
    word = ~_blank(own)
    if side < 0:
        first = word.copy()
        first[1:] &= ~word[:-1]
        return n, int(first[len(own) - n :].sum()), True
    last = word.copy()
    last[:-1] &= ~word[1:]
    return n, int(last[:n].sum()), True


def compared(rows: DataFrame, asks: DataFrame, near: int) -> DataFrame:
    """``asks`` with at and words moved as far as both texts agree, and done."""
    bits = cut(surroundings(rows, asks, near))
    other = bits.select(F.col("row").alias("p_row"), F.col("at").alias("p_at"), "side", F.col("bytes").alias("p_bytes"))
    joined = asks.join(bits, ["row", "at", "side"]).join(other, ["p_row", "p_at", "side"])
    names = ["row", "run", "side", "at", "words", "p_row", "p_at"]

    def run(batches):
        for batch in batches:
            side, own, other = (batch.column(i).to_pylist() for i in (2, 7, 8))
            got = [agreement(a, b, s, near) for a, b, s in zip(own, other, side, strict=True)]
            n, words = (np.array([g[i] for g in got], np.int32).reshape(-1) for i in (0, 1))
            s = np.array(side, np.int32)
            done = np.array([g[2] for g in got], bool)
            move = np.where(done, s * n, 0).astype(np.int32)
            at = batch.column(3).to_numpy() + move
            count = batch.column(4).to_numpy() + s * words
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(at), pa.array(count), *batch.columns[5:7], pa.array(done)], names=[*names, "done"]
            )

    fields = "row long, run int, side int, at int, words int, p_row long, p_at int, done boolean"
    return joined.select(*names, "bytes", "p_bytes").mapInArrow(run, fields)


def extended(rows: DataFrame, found: DataFrame, near: int = NEAR) -> DataFrame:
    """:func:`runs` with start, end, before and upto moved as far as any other text agrees."""
    asks = found.select("row", "run", F.explode("asks").alias("a")).select("row", "run", "a.*")
    ended = None
    while True:
        step = cut(compared(rows, asks, near))
        done = step.filter("done").drop("done")
        ended = done if ended is None else ended.union(done)
        asks = step.filter("not done").drop("done")
        if asks.isEmpty():
            break
        near *= 8
    edge = F.struct("at", "words")
    moved = ended.groupBy("row", "run").agg(
        F.min(F.when(F.col("side") < 0, edge)).alias("left"), F.max(F.when(F.col("side") > 0, edge)).alias("right")
    )
    left = F.coalesce(F.least(F.struct(F.col("start").alias("at"), F.col("before").alias("words")), "left"), F.col("left"))
    right = F.greatest(F.struct(F.col("end").alias("at"), F.col("upto").alias("words")), "right")
    return found.drop("asks").join(moved, ["row", "run"], "left").select(
        "row", "later", left["at"].alias("start"), right["at"].alias("end"),
        left["words"].alias("before"), right["words"].alias("upto"), "first_ids",
    )


def _passages(rows: DataFrame, least_words: int) -> DataFrame:
    """row, removed, shared, first_ids of the :func:`numbered` rows that have repeats."""
    found = extended(rows, cut(runs(rows, least_words)))
    id_kind = found.schema["first_ids"].dataType
    names = ["later", "start", "end", "before", "upto", "first_ids"]
    gathered = found.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("found"))

    def joined(parts):
        out = []
        for p in sorted(parts, key=lambda p: p["start"]):
            if out and p["start"] <= out[-1]["end"]:
                out[-1]["ids"].update(p["first_ids"])
                if p["end"] > out[-1]["end"]:
                    out[-1].update(end=p["end"], upto=p["upto"])
            else:
                out.append({**{k: p[k] for k in names[1:5]}, "ids": set(p["first_ids"])})
        return [p for p in out if p["upto"] - p["before"] >= least_words or p["end"] - p["start"] >= LEAST_BYTES]

    def run(batches):
        for batch in batches:
            cols = [[], [], []]
            for parts in batch.column(1).to_pylist():
                removed = joined([p for p in parts if p["later"]])
                spans = lambda ps: [{"start": p["start"], "end": p["end"]} for p in ps]
                cols[0].append(spans(removed))
                cols[1].append(spans(joined(parts)))
                ids = {i for p in removed for i in p["ids"]}
                cols[2].append(sorted(ids - {None}) + [None] * (None in ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["row", "removed", "shared", "first_ids"],
            )

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [span, span, to_arrow_type(id_kind)]
    one = "array<struct<start:int,end:int>>"
    return gathered.mapInArrow(run, f"row long, removed {one}, shared {one}, first_ids {id_kind.simpleString()}")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One result row per row with repeats: doc_id, removed, shared, first_ids.

    removed: passages (start, end) that an earlier place holds; shared: passages that stand
    in other places, the originals included; first_ids: documents of the originals.
    """
    rows = numbered(docs, doc_id, text)
    return rows.select("row", "doc_id").join(_passages(rows, least_words), "row").drop("row")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id and text of every row, without the passages that an earlier place holds."""
    rows = numbered(docs, doc_id, text)
    found = _passages(rows, least_words).filter(F.size("removed") > 0).select("row", "removed")
    joined = rows.join(found, "row", "left").select("doc_id", "removed", "text")

    def run(batches):
        for batch in batches:
            out = []
            for spans, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    data, parts, at = t.encode(), [], 0
                    for s in spans:
                        parts.append(data[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*parts, data[at:]]).decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(run, rows.select("doc_id", "text").schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = numbered(table(spark, sf_dir, "documents"))
    found = _passages(texts, LEAST_WORDS)
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long")
    spans = lambda c: F.coalesce(
        F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")
    )
    rows = texts.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_bytes",
        size("removed").alias("n_removed"),
        size("shared").alias("n_shared"),
        spans("removed").alias("removed"),
        (size("removed") > 0).alias("repeats"),
        F.coalesce("first_ids", F.array().cast(found.schema["first_ids"].dataType)).alias("first_ids"),
    )
