"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A fingerprint is cut into 32 segments of two bits. Sorting the two bits of every segment
gives a word of the same length in which each segment holds its bit count in unary; the
number of differing bits of two such words is the Manhattan distance of the two vectors of
bit counts, and never more than the number of differing bits of the fingerprints.

The range join with radius ``distance`` runs on a grid: the 32 axes are dealt to ``groups``
groups, and of vectors within the radius at most ``distance`` groups differ. A grid cell is a
choice of the other groups with their coordinates, so each fingerprint stands in a few cells
and meets its neighbours in one of them at least. Pairs of a cell are kept if the Manhattan
distance allows it, and then if the fingerprints differ in ``distance`` bits at most.

A cell with more than ``cell_rows`` fingerprints (a large family of near copies) is not
paired. Fingerprints within distance two of one another are within one of a common word, so
the fingerprints of such cells are grouped by the 65 words within one bit of them; a group
holds 65 fingerprints at most and yields a star. This loses no link and makes no pairs, so
only ``distance`` 2 or less with the star, which is exact for 2, is offered.

Copies share a fingerprint and cost one row in all of this; components come from star
contraction over distinct fingerprints.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
repeated rows each get a result row; a null id takes part, but is never a component's smallest
id unless it has no other (then the component is null); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import fresh, map_text, table
from firmaforge.operators.components import connected_components
from firmaforge.session import cut

SHINGLE = 3
DISTANCE = 2
GROUPS = 5
CELL_ROWS = 200

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Majority of the bits of XXH64 (seed 42) over each text's shingles, as unsigned words."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        ws = t.encode(errors="replace").translate(_LOWER).split() if t else []
        n = max(len(ws) - shingle + 1, min(len(ws), 1))
        counts.append(n)
        if not n:
            continue
        line = b" ".join(ws)
        size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        end = np.cumsum(size) - 1
        last = min(shingle, len(ws)) - 1
        hashes += [digest(line[a:b], 42) for a, b in zip((end - size + 1)[:n].tolist(), end[last:].tolist(), strict=False)]
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts, np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.fromiter(hashes, np.uint64, len(hashes))
        at = (np.cumsum(counts) - counts)[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at)
            out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, keep: list[str], field: str, text: str = "text") -> DataFrame:
    """``keep`` and the fingerprint of each whole text as a signed long."""
    return map_text(docs, lambda ts: [pa.array(fingerprints(ts).view(np.int64))], f"`{field}` long", keep, text)


def unary(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary."""
    low = F.lit(0x5555555555555555)
    even, odd = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _masks(groups: int) -> list[int]:
    """Axes (segments) of each group as a mask of bits; sizes differ by one at most."""
    edges = [round(i * 32 / groups) * 2 for i in range(groups + 1)]
    return [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(u: Column, groups: int, distance: int) -> Column:
    """The grid cells of a vector: number of the choice of groups, and its coordinates there."""
    masks = _masks(groups)
    chosen = [_signed(sum(c)) for c in combinations(masks, groups - distance)]
    return F.array(
        *[F.struct(F.lit(i).cast("int").alias("grid"), u.bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(chosen)]
    )


def links(
    words: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Edges (a, b), a < b, that connect what is within ``distance`` bits. ``words``: distinct fp.

    Pairs of small cells are all of their links; large cells are joined by stars.
    """
    if not 0 <= distance <= 2 < groups:
        raise ValueError("distance is 0, 1 or 2, and there are more than 2 groups")
    vectors = words.select("fp", unary(F.col("fp")).alias("u"))
    placed = cut(vectors.select("fp", "u", F.inline(cells(F.col("u"), groups, distance))))
    held = cut(placed.groupBy("grid", "at").agg(F.count("*").alias("n")).filter("n > 1"))
    small = placed.join(held.filter(F.col("n") <= cell_rows).drop("n"), ["grid", "at"])
    left, right = small.alias("l"), small.alias("r")
    pairs = (
        left.join(right, ["grid", "at"])
        .filter("l.fp < r.fp")
        .filter(F.bit_count(F.col("l.u").bitwiseXOR(F.col("r.u"))) <= distance)
        .filter(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    dense = placed.join(held.filter(F.col("n") > cell_rows).drop("n"), ["grid", "at"]).select("fp").distinct()
    return pairs.union(stars(dense, distance))


def stars(words: DataFrame, distance: int) -> DataFrame:
    """Edges between words that share a word within one bit: for distance 2 the links' closure."""
    flips = [_signed(1 << b) for b in range(64)]
    about = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips]) if distance == 2 else None
    if distance == 0:
        return words.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a < b")
    if distance == 1:
        # Each link once: the word with the bit cleared.
        about = F.array(F.col("fp"), *[F.col("fp").bitwiseAND(F.lit(~m if m > 0 else (1 << 63) - 1)) for m in flips])
        near = words.select("fp", F.explode(F.array_distinct(about)).alias("w"))
        hubs = words.select(F.col("fp").alias("w"))
        return near.join(hubs, "w").filter("fp <> w").select(F.least("fp", "w").alias("a"), F.greatest("fp", "w").alias("b"))
    grouped = words.select("fp", F.explode(about).alias("w")).groupBy("w").agg(F.array_sort(F.collect_list("fp")).alias("g"))
    return (
        grouped.filter(F.size("g") > 1)
        .select(F.col("g")[0].alias("a"), F.explode(F.slice("g", 2, 64)).alias("b"))
        .distinct()
    )


def components(marked: DataFrame, doc_id: str, fp: str = "fp", **grid) -> DataFrame:
    """Columns fp and component (smallest id reachable) for every distinct fingerprint."""
    least = cut(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    linked = connected_components(links(least.select("fp"), **grid), "a", "b")
    rooted = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = cut(rooted)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(smallest, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **grid) -> DataFrame:
    """Columns doc_id, fp (signed long), component: one row for each row of ``docs``."""
    marked = cut(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), ["doc_id"], "fp"))
    return marked.join(components(marked, "doc_id", **grid), "fp")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **grid) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns.

    Rows that repeat an id are one document: one of them stays.
    """
    names = docs.columns
    kept = near_duplicates(docs, doc_id, text, **grid).filter(F.col("doc_id").eqNullSafe(F.col("component")))
    key = fresh(names, "kept_")
    ids = kept.select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(ids, docs[doc_id].eqNullSafe(ids[key]), "left_semi")
    repeated = docs.groupBy(F.col(f"`{doc_id}`")).count().filter("count > 1").limit(1).count()
    return out.dropDuplicates([doc_id]) if repeated else out


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
