"""The pipeline on whole tables and on rows with the odd cases; the registered queries."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firmaforge.llm import bpe, decontaminate, queries, secrets, simhash, toxicity
from firmaforge.llm.batches import fresh, labelled_sample, table

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@needs_tables
def test_stages_follow_one_another(spark, tmp_path):
    import tiktoken

    docs = table(spark, SF_DIR, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "byte_bpe":
            assert out.columns == table(spark, SF_DIR, "documents").columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    given = {r.doc_id: r for r in table(spark, SF_DIR, "documents").collect()}
    bench = [(r.item_id, decontaminate.words(r.text)) for r in table(spark, SF_DIR, "benchmark").collect()]

    toxic = toxicity.scored(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"), ["doc_id"])
    assert set(seen["toxicity"]) == {r.doc_id for r in toxic.filter("score < 0.5").collect()}

    fps = {i: int(simhash.fingerprints([r.text])[0]) for i, r in seen["toxicity"].items()}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert set(seen["simhash_near_dedup"]) == {i for i in fps if root(i) == i}

    windows = {tuple(w[k : k + 10]) for _, w in bench for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def leaks(text):
        ws = decontaminate.words(text)
        return any(tuple(ws[i : i + n]) in windows for n in sizes for i in range(len(ws) - n + 1))

    assert set(seen["benchmark_decontamination"]) == {i for i in seen["simhash_near_dedup"] if not leaks(given[i].text)}
    assert set(seen["secret_scans"]) == set(seen["byte_bpe"]) == set(seen["benchmark_decontamination"])
    ranks, pattern = bpe.tokenizer()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, r in seen["byte_bpe"].items():
        text = seen["secret_scans"][i].text or ""
        assert r.decoded == text and r.token_ids == coder.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        if secrets.base_spans(given[i].text or ""):
            assert text != given[i].text and "<secret>" in text
            assert seen["secret_scans"][i].n_chars == len(text)


@needs_tables
def test_stages_take_odd_rows(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, hits_ int, id_ int"
    rows = [
        (1, None, None, None, None, 1.0, 2, 3, 4), (2, "", "en", "s", 0, None, None, None, None),
        (2, "", "en", "s", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None),
        (3, "token = 'abcdefghi' " + "word " * 30_000, "en", "s", 5, 1.0, 1, 1, 1),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, ddl)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == [c.split()[0] for c in ddl.split(", ")], name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
        assert len(last) == (2 if data else 0)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_batches_have_few_bytes(spark, tmp_path, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "concat(id, repeat(' plain words', 1000))"
    docs = spark.range(0, 400, 1, 1).selectExpr("id doc_id", f"{text} text", "'en' lang", "'s' source", f"length({text}) n_chars")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    before = spark.conf.get(key)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        found = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(found) > 4 << 20 and max(found) <= corpus_pipeline.BATCH_BYTES + (1 << 16)


def test_ranks_need_no_python_workers(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("rows of Python")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", never)
    rank = bpe.Ranks(spark, {b"a": 0, b"b": 1, b"ab": 2})
    got = spark.range(1).select(rank.encode(F.lit("abba")).alias("ids")).first().ids
    assert got == [2, 1, 0]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    rows = got.count()
    if name == "op1_html_extraction":
        assert rows == table(spark, SF_DIR, "pages").count()
    elif name == "op11_filter_audit":  # all orders and steps of every source
        assert rows == 120 * 5 * table(spark, SF_DIR, "documents").select("source").distinct().count()
    elif name == "op13_embedding_whitening":
        assert rows == 32 * table(spark, SF_DIR, "embeddings").count()
    elif name != "pipeline":
        assert rows == table(spark, SF_DIR, "documents").count()
    else:
        assert 0 < rows <= table(spark, SF_DIR, "documents").count()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    at = {c[0]: i for i, c in enumerate(want.description)}
    expected = sorted(tuple(r[at[c]] for c in columns) for r in want.fetchall())
    got = queries.QUERIES[name](spark, SF_DIR).select(columns)
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_helpers(spark):
    assert fresh(["A", "b"], "a") == "_a"
    labels = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert labelled_sample(labels, 10_000).count() == 5000
    assert 350 < labelled_sample(labels, 500).count() < 650
