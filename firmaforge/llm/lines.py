"""Line dedup: hashes partitioned by range, sorted by document and place, streamed once.

Each line of each document becomes (hash of its key in two longs, document, place). Ranges of
(hash, document) are dealt to partitions, so a line that half of all documents hold is spread
over many, and a document's copies of a line stay together. Within a partition rows are sorted
by hash, document and place, and a stream over them holds back a line until enough documents
have it: at most ``min_docs - 1`` documents' places. A line that reaches the edge of its
partition may go on next door; its places there are left open, with its number of documents, and
settled by a join that gets a few rows of each partition.

The result has no text: one row per document with its number of lines and a bitmap of those that
stay, compressed with zlib. ``kept_text`` applies a bitmap.

Defined results: a null or empty text is one empty line; an empty key is never dropped; of
``keep_first`` the line of the smallest document (by id, then hash of its text) and place stays;
rows equal in id and text (null ids included) are one document with one bitmap, and count once;
repeated rows each get their row in the query; no rows, no bitmaps. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from firmaforge.llm.batches import slices, table
from firmaforge.session import cut

MIN_DOCS = 10
MIN_CHARS = 1

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def documents_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_hash (of id and text), text (never null): a document is told by the first two."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{doc_id}`")
    return docs.select(own.alias("doc_id"), F.xxhash64(F.lit(7), own, body).alias("doc_hash"), body.alias("text"))


def line_entries(own: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, doc_hash, place) of every line whose key is long enough."""
    lines = own.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = lines.select("doc_id", "doc_hash", "place", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= max(min_chars, 1)).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), F.col("key")).alias("h2"), "doc_id", "doc_hash", "place"
    )


def _distinct(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Without the rows that equal the one before them (repeated documents), and the last row."""
    if not batch.num_rows:
        return batch, last
    cells = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4)])
    other = np.ones(batch.num_rows, bool)
    other[1:] = (cells[:, 1:] != cells[:, :-1]).any(axis=0)
    other[0] = tuple(cells[:, 0].tolist()) != last
    return batch if other.all() else batch.filter(pa.array(other)), tuple(cells[:, -1].tolist())


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Places to drop, open places and counts of one sorted partition.

    ``state``: 0 drop; 1 open (dropped if the line has enough documents); 2 a number of documents
    of a line that touches an edge; 3 the first place of such a line.
    """

    def rows(batch, index, state, n):
        part = batch.take(pa.array(index)) if index is not None else batch
        size = part.num_rows
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(np.full(size, state)), pa.array(np.full(size, n))],
            names=[*part.schema.names, "state", "n"],
        )

    # The line that is being read: its hash, documents so far, last document, whether it began at
    # the edge, whether its first row is known (the head), and the rows held back.
    line = None

    def end(edge: bool) -> Iterator[pa.RecordBatch]:
        if line is None:
            return
        if line["edge"] or edge:
            yield rows(line["head"], None, 2, line["docs"])
            if keep_first:
                yield rows(line["head"], None, 3, 0)
            for b in line["held"]:
                yield rows(b, None, 1, 0)

    begun, last = False, None
    for batch in batches:
        batch, last = _distinct(batch, last)
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(h1))
        docs = np.add.reduceat(other.astype(np.int64), starts)
        if line is not None and line["hash"] == (h1[0], h2[0]):
            a, b = 0, int(stops[0])
            line["docs"] += int(docs[0]) - int(doc[0] == line["last"])
            line["last"] = doc[b - 1]
            own = batch.slice(a, b - a)
            if line["docs"] >= min_docs:
                for held in line["held"]:
                    yield rows(held, None, 0, 0)
                line["held"] = []
                yield rows(own, None, 0, 0)
            else:
                line["held"].append(own)
            if len(starts) == 1:
                continue
            starts, stops, docs = starts[1:], stops[1:], docs[1:]
        yield from end(False)
        # Lines that begin and end in this batch, all but the last and, at the edge, the first.
        inner = np.ones(len(starts), bool)
        inner[-1] = False
        if not begun:
            inner[0] = False
        drop = inner & (docs >= min_docs)
        if drop.any():
            marked = np.repeat(drop, stops - starts)
            if keep_first:
                marked[(starts - starts[0])[drop]] = False
            index = np.flatnonzero(marked) + starts[0]
            if len(index):
                yield rows(batch, index, 0, 0)
        for k in dict.fromkeys([0, len(starts) - 1] if not begun else [len(starts) - 1]):
            a, b = int(starts[k]), int(stops[k])
            own = batch.slice(a, b - a)
            line = {"hash": (h1[a], h2[a]), "docs": int(docs[k]), "last": doc[b - 1], "edge": not begun and k == 0,
                    "head": own.slice(0, 1), "held": []}
            # The head is kept apart where it stays.
            rest = own.slice(1) if keep_first else own
            if line["docs"] >= min_docs:
                if rest.num_rows:
                    yield rows(rest, None, 0, 0)
            elif rest.num_rows:
                line["held"].append(rest)
            if k < len(starts) - 1:
                yield from end(False)
        begun = True
    yield from end(True)


def dropped_places(entries: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, doc_hash, place) of lines that ``min_docs`` documents or more hold.

    With ``keep_first`` the first occurrence of each such line is not among them.
    """
    names = ["h1", "h2", "doc_id", "doc_hash", "place"]
    entries = entries.select(*names)
    dealt = entries.repartitionByRange("h1", "h2", "doc_id", "doc_hash").sortWithinPartitions(*names)
    schema = StructType([*entries.schema.fields, StructField("state", LongType()), StructField("n", LongType())])
    seen = cut(dealt.mapInArrow(lambda batches: _stream(batches, min_docs, keep_first), schema))
    place = ["doc_id", "doc_hash", "place"]
    frequent = seen.filter("state = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"))
    frequent = frequent.filter(F.col("docs") >= min_docs).drop("docs")
    out = seen.filter("state = 0").select(*place)
    out = out.unionByName(seen.filter("state = 1").join(frequent, ["h1", "h2"], "left_semi").select(*place))
    if keep_first:
        # Heads of one line, one for each partition that it touches: all but the first go.
        heads = seen.filter("state = 3").join(frequent, ["h1", "h2"], "left_semi")
        first = heads.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"))
        later = heads.join(first, ["h1", "h2"]).filter(~F.struct(*place).eqNullSafe(F.col("first")))
        out = out.unionByName(later.select(*place))
    return out


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, doc_hash, n_lines, n_dropped, keep (a compressed bitmap)."""
    own = documents_of(docs, doc_id, text)
    places = dropped_places(line_entries(own, min_chars), min_docs, keep_first)
    size = own.select("doc_id", "doc_hash", F.size(F.split("text", "\n", -1)).alias("size"), F.lit(None).cast("int").alias("place"))
    # Places of one document: no more than it has lines.
    found = size.unionByName(places.withColumn("size", F.lit(None).cast("int"))).groupBy("doc_id", "doc_hash")
    found = found.agg(F.max("size").cast("long").alias("n_lines"), F.collect_set("place").alias("places"))
    kept = [found.schema["doc_id"], found.schema["doc_hash"], found.schema["n_lines"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, maps = [], []
            for n, at in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                at = at.values.to_numpy(zero_copy_only=False)
                bits = np.ones(n, bool)
                bits[at] = False
                dropped.append(len(at))
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            arrays = [*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_hash", "n_lines", "n_dropped", "keep"])

    schema = StructType([*kept, *StructType.fromDDL("n_dropped long, keep binary").fields])
    return found.mapInArrow(run, schema)


def kept_text(text: str, keep: bytes) -> str:
    """The lines of ``text`` that its bitmap keeps."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return text if bits.all() else "\n".join([lines[i] for i in np.flatnonzero(bits)])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that the bitmap leaves."""
    docs = table(spark, sf_dir, "documents")
    maps = keep_bitmaps(docs)
    own = documents_of(docs)
    joined = own.join(
        maps.select(F.col("doc_id").alias("id"), F.col("doc_hash").alias("hash"), "n_lines", "n_dropped", "keep"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("hash")),
        "left",
    )
    return joined.select("doc_id", "n_lines", "n_dropped", "text", "keep").transform(digests_of_kept)


def digests_of_kept(joined: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of rows with text and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                kept = map(kept_text, part.column(3).to_pylist(), part.column(4).to_pylist())
                hexed = [hashlib.sha256(t.encode(errors="replace")).hexdigest() for t in kept]
                arrays = [*part.columns[:3], pa.array(hexed, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:3], "kept_sha256"])

    return joined.mapInArrow(run, StructType([*joined.schema.fields[:3], StructField("kept_sha256", StringType())]))
