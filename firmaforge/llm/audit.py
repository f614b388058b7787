"""Filter interaction audit: what each filter removes in every order of the filters.

Every document gets a mask of the filters it fails. Masks are counted per part, with as many
counts (documents, good ones, toxic ones) as are asked for; at most 2^n masks of a part are
left, whatever its size. From them a decision diagram is built per part: a level for each
filter, a low edge for "passes" and a high edge for "fails", and at each node the counts of all
documents below it; equal nodes are one. Swapping two adjacent levels rewrites the nodes of the
upper one in place, so the n! orders are visited by n! - 1 swaps (plain changes). In each order
the path of low edges from the root gives the steps: what the low child weighs is kept, what
the high child weighs is removed.

Copies are told by two 64-bit hashes of the text. The first id of each text that occurs more
than once is joined back to rows of a few bytes; a hot text is split by the adaptive join.

Defined results: a null text is an empty one; a null part is the part ""; a row without id never
fails the copy filter and fails no other; of repeated rows with the smallest id of a text none
fails it; a document is good (toxic) if any row of labels says so; no documents, no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import map_text, table
from firmaforge.session import cut

FILTERS = "ABCDE"

_NO_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # of bytes: at [\x20\x09-\x0D]
    n = len(words)
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUATION)))
    return (
        (n < 50)
        | (100 * len(set(words)) < 65 * n) << 1
        | (100 * len(text.translate(None, _NO_CAPITAL)) > 5 * points) << 2
        | any(s in text for s in _SYMBOLS) << 3
    )


def failure_masks(docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``keep`` and ``mask_``, the filters of :data:`FILTERS` that each document fails."""

    def measured(texts):
        data = [t.encode(errors="replace") if t else b"" for t in texts]
        digests = [xxhash.xxh3_128_intdigest(t) for t in data]
        low = [(d & (1 << 64) - 1) - (1 << 63) for d in digests]
        return [failures(t) for t in data], low, [(d >> 64) - (1 << 63) for d in digests]

    own = list(dict.fromkeys([doc_id, *keep]))
    facts = cut(map_text(docs, measured, "mask4_ int, low_ long, high_ long", own, text))
    first = facts.groupBy("low_", "high_").agg(F.min(doc_id).alias("first_"), F.count("*").alias("held_"))
    # Written down, so that the join has shuffles of its own, which the adaptive join may split.
    first = cut(first.filter("held_ > 1").drop("held_"))
    copy = F.coalesce(F.col(f"`{doc_id}`") > F.col("first_"), F.lit(False))
    return facts.join(first, ["low_", "high_"], "left").select(
        *[F.col(f"`{c}`") for c in keep], (F.col("mask4_") + F.when(copy, 16).otherwise(0)).alias("mask_")
    )


class Diagram:
    """Counts by mask as a decision diagram; ``order`` names the bit that each level decides."""

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(n))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        self.level: list[dict[tuple, int]] = [{} for _ in range(n)]
        leaves: dict[tuple, int] = {}

        def leaf(weight: tuple[int, ...]) -> int:
            if weight not in leaves:
                leaves[weight] = self._new(-1, -1, weight)
            return leaves[weight]

        def build(level: int, mask: int) -> int:
            if level == n:
                return leaf(counts.get(mask, (0,) * width))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        found = self.level[level].get((low, high))
        if found is None:
            weight = tuple(map(int.__add__, self.weight[low], self.weight[high]))
            found = self.level[level][low, high] = self._new(low, high, weight)
        return found

    def swap(self, i: int) -> None:
        """Exchange the filters of levels ``i`` and ``i + 1``; what is above and below stays."""
        upper = list(self.level[i].values())
        self.level[i], self.level[i + 1] = {}, {}
        low, high = self.low, self.high
        for u in upper:
            passed, failed = low[u], high[u]
            low[u], high[u] = (
                self._node(i + 1, low[passed], low[failed]),
                self._node(i + 1, high[passed], high[failed]),
            )
            self.level[i][low[u], high[u]] = u
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(bit, kept, removed) along the path on which everything passes."""
        node = self.root
        for bit in self.order:
            yield bit, self.weight[self.low[node]], self.weight[self.high[node]]
            node = self.low[node]


def plain_changes(n: int) -> Iterator[int]:
    """Places i to exchange with i + 1 so that all orders of n things come up once."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down
        down = not down


def orders(n: int, counts: dict[int, tuple[int, ...]], width: int) -> list[tuple[tuple[int, ...], list]]:
    """Every order of the filters and its steps."""
    diagram = Diagram(n, counts, width)
    out = [(tuple(diagram.order), list(diagram.steps()))]
    for i in plain_changes(n):
        diagram.swap(i)
        out.append((tuple(diagram.order), list(diagram.steps())))
    return out


def audit(masks: DataFrame, part: str = "part", mask: str = "mask_", filters: str = FILTERS) -> DataFrame:
    """Rows of part, filter_order and step, of masks with the flags ``good_`` and ``toxic_``."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    counted = masks.groupBy(F.col(part).alias("part"), F.col(mask).cast("int").alias("mask")).agg(
        F.count("*").alias("n"), one("good_").alias("good"), one("toxic_").alias("toxic")
    )
    # At most 2^n rows of a part: an array of bounded length.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    n = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["counts"]}
                found = orders(n, counts, 3)
                fails, alone, share = [0] * n, [0] * n, [0] * n
                for _, steps in found:
                    fails[steps[0][0]] = steps[0][2][0]  # first: all that fail it
                    alone[steps[-1][0]] = steps[-1][2][0]  # last: those that fail nothing else
                    for bit, _, removed in steps:
                        share[bit] += removed[0]
                rows = []
                for order, steps in found:
                    spelt = "".join(filters[b] for b in order)
                    for k, (bit, kept, removed) in enumerate(steps, 1):
                        rows.append((row["part"], spelt, k, kept[0], removed[0], fails[bit] - removed[0], alone[bit],
                                     removed[1], removed[2], share[bit]))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(names)]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *names])

    longs = ", ".join(f"{c} long" for c in names)
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {longs}")


def labelled(docs: DataFrame, labels: DataFrame, keep: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``keep`` with good_ and toxic_, which are true where any row of labels says so."""
    marks = labels.groupBy(F.col(f"`{doc_id}`").alias("labelled_")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good_"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic_"),
    )
    return docs.join(marks, F.col(f"`{doc_id}`") == F.col("labelled_"), "left").select(*keep, "good_", "toxic_")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce("source", F.lit("")).alias("part")
    )
    masks = failure_masks(docs, ["doc_id", "part"])
    return audit(labelled(masks, table(spark, sf_dir, "labels"), ["part", "mask_"]))
