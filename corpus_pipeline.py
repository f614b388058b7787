"""The corpus pipeline: documents in, token ids out, each stage on all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

The stages share their executors, whose Python workers keep what the largest batch took. Spark
fills a batch to 10,000 rows or 64 MB by default, and a task holds it several times over, in the
JVM and in Python; here a batch ends at ``BATCH_BYTES``, whatever the length of its texts (a
longer text is a batch of its own). This is a setting of the session and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from firmaforge.llm import bpe, decontaminate, secrets, simhash, toxicity
from firmaforge.llm.batches import table
from firmaforge.session import cut

BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES``, for the plans of a stage, which run after it returns."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labels of these documents."""
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of SimHash links."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    small_batches(spark)
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, text (decoded from the ids)."""
    small_batches(spark)
    ranks, pattern = bpe.tokenizer()
    decode = bpe.Decoder(ranks)

    def finish(ids):
        return len(ids) // 4, np.frombuffer(ids, "<i4"), decode(ids).decode(errors="replace")

    fields = "n_tokens long, token_ids array<int>, decoded string"
    # Workers that ran the other stages hold memory of theirs, so this one takes less.
    small = dict(dictionary_words=1 << 16, kept_pieces=100_000, counted_at_once=150_000)
    return bpe.encode(docs, ranks, pattern, ["doc_id", "lang", "source"], finish, fields, **small)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_bpe", tokenize),
]

# The language model, the fitted weights, the novelty measure and the merges are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
