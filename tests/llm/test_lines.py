"""Line dedup against a plain count, over many partitions, and its odd cases."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmaforge.llm import lines

DDL = "doc_id long, text string, place int, h1 string, keep int, key string"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(docs, least, first=False):
    """(id, text) -> lines that stay, of distinct documents."""
    own = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    held = {}
    for d in own:
        for k in {key(x) for x in (d[1] or "").split("\n")}:
            held.setdefault(k, []).append(d)
    out, seen = {}, set()
    for d in own:
        kept = []
        for x in (d[1] or "").split("\n"):
            k = key(x)
            often = k != "" and len(held[k]) >= least
            if not often or first and k not in seen:
                kept.append(x)
            seen.add(k)
        out[d] = kept
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    common = [f"Line number {i} of all" for i in range(40)]
    texts = [None, "", "\n\n", " \t\r\n", "x\n" * 5000, "A Line\r\na line\n\x0b A LINE \x0c", "é\nÉ", "a" * 100_000]
    for _ in range(150):
        own = [rng.choice(common) if rng.random() < 0.6 else f"u{rng.randrange(400)}" for _ in range(rng.randrange(1, 12))]
        own = [x.upper() if rng.random() < 0.2 else "  " + x + "\t" if rng.random() < 0.2 else x for x in own]
        texts.append("\n".join([*own, "", "HOT line"]))
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[20], out[20], (None, texts[30]), (None, texts[30]), (None, texts[31])]


def frame(spark, docs, parts=4):
    return spark.createDataFrame([(*d, 1, "h", 2, "k") for d in docs], DDL).repartition(parts)


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_bitmaps_like_a_plain_count(spark, docs, partitions, first):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        if first:  # of two texts without id the smaller hash is first
            docs = docs[:-1]
        df = frame(spark, docs)
        maps = lines.keep_bitmaps(df, min_docs=10, keep_first=first)
        own = lines.documents_of(df).dropDuplicates(["doc_id", "doc_hash"]).select("doc_id", "doc_hash", "text")
        same = F.col("m.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("m.doc_hash") == F.col("o.doc_hash"))
        got = maps.alias("m").join(own.alias("o"), same).select("m.*", "o.text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want = brute([(i, t or "") for i, t in docs], 10, first)
    assert len(got) == len(want)
    for r in got:
        kept = want[r.doc_id, r.text]
        assert lines.kept_text(r.text, bytes(r.keep)) == "\n".join(kept)
        n = r.text.count("\n") + 1
        assert (r.n_lines, r.n_dropped) == (n, n - len(kept))
    assert sum(r.n_dropped for r in got) > 500


def test_query_keeps_repeated_rows(spark, docs, tmp_path):
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = lines.op12_line_dedup(spark, str(tmp_path)).collect()
    want = brute([(i, t or "") for i, t in docs], 10)
    expected = sorted(
        (str(i), len((t or "").split("\n")), len((t or "").split("\n")) - len(want[i, t or ""]),
         hashlib.sha256("\n".join(want[i, t or ""]).encode()).hexdigest())
        for i, t in docs
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected


def test_no_rows(spark):
    assert lines.keep_bitmaps(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_stream_holds_back_few_rows_whatever_the_batches(size):
    rows = sorted((h, 0, d, d, p) for h in range(6) for d in range(3 * h + 1) for p in range(2))
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["h1", "h2", "doc_id", "doc_hash", "place"])
    out = [r for b in lines._stream(iter(table.to_batches(size)), 10, False) for r in b.to_pylist()]
    dropped = {(r["h1"], r["doc_id"], r["place"]) for r in out if r["state"] == 0}
    assert dropped == {(h, d, p) for h in range(6) if 3 * h + 1 >= 10 for d in range(3 * h + 1) for p in range(2)}
    assert {(r["h1"], r["n"]) for r in out if r["state"] == 2} == {(0, 1), (5, 16)}
    assert {r["h1"] for r in out if r["state"] == 1} == {0}
