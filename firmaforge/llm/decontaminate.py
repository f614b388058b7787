"""Benchmark decontamination on a stored, document-partitioned positional inverted index.

Training texts are tokenised once; for the terms that occur in the benchmark each document's
postings (term, positions) are stored in the shared folder. Document frequencies come from
the stored index. A test window is then searched as a phrase in every partition of the index:
the list of its rarest term, shifted by the term's offset, is intersected with the shifted
lists of the next rarer terms until all agree or none is left. Partitioning the index by
document means that no posting list, however common its term, is moved or gathered.

Besides exact phrases there are proximity matches: an item's three rarest terms lie within
``near`` words of one another.

The benchmark goes to the executors in blocks of at most ``block_words`` words; a larger one
is searched block by block and the results are united, so its size has no limit.

Defined results: null and empty texts have no words and no hits; an item without words is
ignored, a null item id counts its hits but is not listed; equal item ids count once; each
document row gets one result row, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.llm.batches import fresh, lists, map_text, table
from firmaforge.session import cut

WINDOW = 10
NEAR = 20
RARE = 3
BLOCK_WORDS = 300_000

# A-Z become a-z; every other byte below 0x80 but 0-9 and a-z separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode(errors="replace").translate(_WORD_BYTES).split() if text else []


def benchmark_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Columns item_id, words (array<binary>), n of the items that have words."""
    base = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return map_text(
        base, lambda texts: [w := [words(t) for t in texts], [len(x) for x in w]], "words array<binary>, n int", ["item_id"]
    ).filter("n > 0")


class Block:
    """Some items: their terms, windows and the windows' items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.terms = sorted({w for _, ws in items for w in ws})
        ids = {w: i for i, w in enumerate(self.terms)}
        owners: dict[tuple[int, ...], set] = {}
        rest: list[tuple[int | None, list[int]]] = []
        for item, ws in items:
            seq = [ids[w] for w in ws]
            rest.append((item, seq))
            for i in range(max(1, len(seq) - window + 1)):
                owners.setdefault(tuple(seq[i : i + window]), set()).add(item)
        self.windows = list(owners)
        self.owners = [sorted(x for x in o if x is not None) for o in owners.values()]
        self.items = rest

    def ranked(self, df: np.ndarray, rare: int) -> dict:
        """Arrays for the search: terms and offsets of each window from the rarest on."""
        width = max(map(len, self.windows))
        n = len(self.windows)
        term, off = np.full((n, width), -1, np.int32), np.zeros((n, width), np.int32)
        for i, w in enumerate(self.windows):
            order = sorted(range(len(w)), key=lambda k: (df[w[k]], k))
            term[i, : len(w)] = [w[k] for k in order]
            off[i, : len(w)] = order
        by_first = np.argsort(term[:, 0], kind="stable")
        term, off = term[by_first], off[by_first]
        length = (term >= 0).sum(1).astype(np.int32)
        own = [self.owners[i] for i in by_first]
        near = {}
        for item, seq in self.items:
            if item is not None:
                near[item, tuple(sorted(set(seq), key=lambda t: (df[t], t))[:rare])] = None
        near_terms = np.full((len(near), rare), -1, np.int32)
        for i, (_, ts) in enumerate(near):
            near_terms[i, : len(ts)] = ts
        return {
            "term": term,
            "off": off,
            "length": length,
            "own": np.array([x for o in own for x in o], np.int64),
            "own_at": np.cumsum([0, *map(len, own)]),
            "near_item": np.array([i for i, _ in near], np.int64),
            "near_terms": near_terms,
        }


def block_count(items: DataFrame, block_words: int) -> int:
    return max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))


def blocks(items: DataFrame, parts: int, window: int) -> Iterator[Block]:
    """The benchmark, block by block; each is bounded and goes to every executor."""
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)
        rows = [(r["item_id"], [bytes(w) for w in r["words"]]) for r in part.select("item_id", "words").collect()]
        if rows:
            yield Block(rows, window)


def postings(docs: DataFrame, terms: list[bytes], keep: list[str], text: str = "text") -> DataFrame:
    """The index: ``keep``, n_words_, terms_ and positions_ of the given terms, by term and position."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    state: dict = {}

    def index(texts):
        if not state:
            state.update({w: i for i, w in enumerate(shared.value)})
        get = state.get
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        ids = np.fromiter((get(w, -1) for w in chain.from_iterable(split)), np.int32, int(counts.sum()))
        doc = np.repeat(np.arange(len(split)), counts)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = ids >= 0
        ids, doc, pos = ids[known], doc[known], pos[known].astype(np.int32)
        order = np.argsort(doc * (len(state) + 1) + ids, kind="stable")
        per = np.bincount(doc, minlength=len(split))
        return [
            pa.array(counts),
            lists(ids[order], per, pa.int32()),
            lists(pos[order], per, pa.int32()),
        ]

    return map_text(docs, index, "n_words_ long, terms_ array<int>, positions_ array<int>", keep, text)


def document_frequency(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            col = batch.column(0)
            ids = col.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(col)), pc.list_value_length(col).to_numpy(zero_copy_only=False))
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
            total += np.bincount(ids[first], minlength=n_terms)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["term", "df"])

    rows = index.select("terms_").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for r in rows.collect():
        out[r["term"]] = r["df"]
    return out


def _runs(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _search(q: dict, n_words: np.ndarray, per_doc: np.ndarray, ids: np.ndarray, pos: np.ndarray, gap: int):
    """Phrase and proximity matches among some documents' postings.

    Returns (document, word) of hit words, (document, item) of phrases and of proximities.
    """
    docs = len(n_words)
    base = np.cumsum(n_words + gap) - (n_words + gap)
    where = np.repeat(base, per_doc) + pos
    size = int((n_words + gap).sum())
    seq = np.full(size + 1, -1, np.int32)
    seq[where] = ids
    by_term = np.lexsort((where, ids))
    ids, where = ids[by_term], where[by_term]

    # Exact phrases: the rarest term's list, shifted, meets the others in order of rarity.
    first = q["term"][:, 0]
    lo, hi = np.searchsorted(ids, first), np.searchsorted(ids, first, "right")
    hit, phrase_doc, phrase_item = np.zeros(size + 1, np.int32), [], []
    count = hi - lo
    step = 2_000_000
    edges = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + step, step)).clip(0, len(count)))
    for a, b in zip(edges, [*edges[1:], len(count)], strict=False):
        c = count[a:b]
        win = np.repeat(np.arange(a, b), c)
        start = where[np.repeat(lo[a:b], c) + _runs(c)] - q["off"][win, 0]
        ok = (start >= 0) & (start + q["length"][win] <= size)
        win, start = win[ok], start[ok]
        for k in range(1, q["term"].shape[1]):
            want = q["term"][win, k]
            ok = (want < 0) | (seq[start + q["off"][win, k]] == want)
            win, start = win[ok], start[ok]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + q["length"][win], -1)
        doc = np.searchsorted(base, start, "right") - 1
        pair = np.unique(np.stack([doc, win], 1), axis=0)
        owners = q["own_at"][pair[:, 1] + 1] - q["own_at"][pair[:, 1]]
        phrase_doc.append(np.repeat(pair[:, 0], owners))
        phrase_item.append(q["own"][np.repeat(q["own_at"][pair[:, 1]], owners) + _runs(owners)])
    hits = np.flatnonzero(np.cumsum(hit)[:size] > 0)
    hit_doc = np.searchsorted(base, hits, "right") - 1

    # Proximity: around each posting of an item's rarest term, look the others' lists up.
    t = q["near_terms"]
    lo, hi = np.searchsorted(ids, t[:, 0]), np.searchsorted(ids, t[:, 0], "right")
    count = hi - lo
    item = np.repeat(np.arange(len(t)), count)
    at = where[np.repeat(lo, count) + _runs(count)] if len(t) else np.empty(0, np.int64)
    big = size + 2 * gap + 2
    keys = ids.astype(np.int64) * big + where
    for k in range(1, t.shape[1]):
        want = t[item, k].astype(np.int64)
        i = np.searchsorted(keys, want * big + np.maximum(at - gap + 1, 0))
        ok = (want < 0) | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= want * big + at + gap - 1)) if len(keys) else want < 0
        item, at = item[ok], at[ok]
    near_doc = np.searchsorted(base, at, "right") - 1
    cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
    return (
        (hit_doc, hits - base[hit_doc] if docs else hits),
        _pairs(cat(phrase_doc), cat(phrase_item)),
        _pairs(near_doc, q["near_item"][item]),
    )


def _pairs(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[keep], item[keep]


def search(index: DataFrame, query: dict, keep: list[str], gap: int) -> DataFrame:
    """``keep``, n_words_, hits_ (words), items_ and near_ of every row of the index."""
    shared = index.sparkSession.sparkContext.broadcast(query)
    from pyspark.sql.types import StructType

    added = StructType.fromDDL("n_words_ long, hits_ array<int>, items_ array<long>, near_ array<long>")
    schema = StructType([index.schema[c] for c in keep] + added.fields)
    names = [f.name for f in schema]

    def run(batches):
        q = shared.value
        for batch in batches:
            n = np.asarray(batch.column(len(keep)))
            part = np.cumsum(n) // 1_000_000
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)] if len(n) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                terms, pos = piece.column(len(keep) + 1), piece.column(len(keep) + 2)
                found = _search(
                    q,
                    n[a:b],
                    pc.list_value_length(terms).to_numpy(zero_copy_only=False),
                    terms.flatten().to_numpy(zero_copy_only=False),
                    pos.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    gap,
                )
                cols = [
                    lists(v, np.bincount(d, minlength=b - a), kind)
                    for (d, v), kind in zip(found, (pa.int32(), pa.int64(), pa.int64()), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep) + 1], *cols], names=names)

    return index.mapInArrow(run, schema)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    near: int = NEAR,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
) -> DataFrame:
    """``keep``, n_words_, hits_ (hit word positions), items_ (phrases), near_ (proximities)."""
    items = cut(benchmark_words(benchmark))
    parts = block_count(items, block_words)
    row = fresh([*keep, text], "row_")
    names = list(keep)
    if parts > 1:
        # Row numbers are fixed by writing them down with the texts.
        docs = cut(docs.select(*dict.fromkeys([*keep, text])).withColumn(row, F.monotonically_increasing_id()))
        names.append(row)
    found = []
    for block in blocks(items, parts, window):
        index = cut(postings(docs, block.terms, names, text))
        found.append(search(index, block.ranked(document_frequency(index, len(block.terms)), RARE), names, near))
    if not found:
        none = lambda texts: [[len(words(t)) for t in texts], *[[[] for _ in texts]] * 3]
        fields = "n_words_ long, hits_ array<int>, items_ array<long>, near_ array<long>"
        return map_text(docs, none, fields, keep, text)
    if parts == 1:
        return found[0]
    every = reduce(DataFrame.union, found)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return (
        every.groupBy(row)
        .agg(*[F.first(c).alias(c) for c in [*keep, "n_words_"]], *map(merged, ("hits_", "items_", "near_")))
        .drop(row)
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns.

    A row is known by its id and a hash of its text, so rows that share an id are judged apart.
    """
    key, digest = fresh(docs.columns, "hit_id_"), fresh(docs.columns, "hit_digest_")
    own = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").alias(key), own.alias(digest), F.col(f"`{text}`").alias("text"))
    hit = matches(rows, benchmark, [key, digest]).filter(F.size("hits_") > 0).select(key, digest).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit[key]) & (own == hit[digest]), "left_anti")


def n_items(column):
    return F.size(column).cast("long")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.array_sort(F.transform("items_", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words_").alias("n_words"),
        n_items("hits_").alias("n_hit"),
        n_items("items_").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hits_") > 0).alias("contaminated"),
        n_items("near_").alias("n_near"),
    )
