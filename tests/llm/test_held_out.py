"""Classifiers on rows that they did not learn from, and rows of odd ids or columns."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from firmaforge.llm import grades, language, toxicity
from firmaforge.llm.batches import table

SF_DIR = "/root/testdata/sf0.1"
stored = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def shares(rows):
    """Recall and precision of (truth, prediction) pairs."""
    hit = sum(1 for t, p in rows if t and p)
    return hit / max(1, sum(t for t, _ in rows)), hit / max(1, sum(p for _, p in rows))


@stored
def test_toxicity_held_out(spark):
    found = toxicity.op7_toxicity(spark, SF_DIR).filter("held_out")
    labels = table(spark, SF_DIR, "labels").filter("toxic is not null")
    rows = [(r.toxic == 1, r.predicted == 1) for r in found.join(labels, "doc_id").collect()]
    recall, precision = shares(rows)
    print(f"toxicity: {len(rows)} held out, recall {recall:.3f}, precision {precision:.3f}")
    assert len(rows) > 300 and recall >= 0.85 and precision >= 0.85


@stored
def test_language_held_out(spark):
    found = language.op9_language_id(spark, SF_DIR).filter("held_out")
    docs = table(spark, SF_DIR, "documents").filter("lang is not null").select("doc_id", "lang")
    rows = [r.lang == r.lang_pred for r in found.join(docs, "doc_id").collect()]
    print(f"language: {len(rows)} held out, accuracy {sum(rows) / len(rows):.4f}")
    assert len(rows) > 3000 and sum(rows) / len(rows) >= 0.98


@stored
def test_grades_held_out(spark):
    found = grades.op10_quality_classifier(spark, SF_DIR).filter("held_out")
    labels = table(spark, SF_DIR, "labels").filter("quality is not null")
    rows = [(r.quality == 1, r.selected) for r in found.join(labels, "doc_id").collect()]
    recall, precision = shares(rows)
    print(f"quality: {len(rows)} held out, recall {recall:.3f}, precision {precision:.3f}")
    assert len(rows) > 300 and recall >= 0.95 and precision >= 0.95


def test_odd_rows_are_scored(spark):
    ddl = "doc_id long, text string, lang string, score string, lang_pred int, id_ string, text_ string"
    rows = [(i, "the of and which" if i % 2 else "der und nicht schön", "en" if i % 2 else "de", "s", 1, "i", "t") for i in range(60)]
    odd = [(None, "the of", "en", "s", 1, "i", "t"), (90, "x² ½".replace("x", ""), None, None, None, None, None), (1, "der und", "de", "s", 1, "i", "t")]
    docs = spark.createDataFrame(rows + odd, ddl)
    got = language.identified(docs, language.fit(docs), ["doc_id"]).collect()
    assert len(got) == 63
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id != 1}
    assert by_id[None] == "en" and by_id[90] == "und" and by_id[2] == "de"
    rated = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, grade int")
    graded = grades.graded(docs, grades.fit(docs, rated), ["doc_id"], 1).collect()
    assert len(graded) == 63 and any(r.doc_id is None for r in graded)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.scored(docs, labels, ["doc_id"]).filter(F.col("doc_id").isNull()).count() == 1
