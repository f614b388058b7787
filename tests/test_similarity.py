import random

from pyspark.sql import functions as F

from firmaforge.functions import similarity as sim
from firmaforge.functions.similarity import _lcs_many


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_batch_counts_agree_with_the_table():
    random.seed(5)
    lengths = [0, 1, 7, 63, 64, 65, 128, 130, 300]
    a = ["".join(random.choices("abcş ", k=random.choice(lengths))) for _ in range(300)]
    b = ["".join(random.choices("abcş ", k=random.choice(lengths))) for _ in range(300)]
    assert _lcs_many(a, b).tolist() == [table(x, y) for x, y in zip(a, b)]
    assert _lcs_many([None, "a"], ["a", None]).tolist() == [0, 0]


def scores(spark, fn, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.s for r in df.select("i", fn(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]


def test_ratio(spark):
    pairs = [("kitten", "sitting"), ("Same", "sAME"), ("", "x"), (None, "x"), ("abc", "xyz")]
    wanted = [0.62, 1.0, 0.0, 0.0, 0.0]
    assert scores(spark, sim.ratio, pairs) == wanted
    assert scores(spark, lambda a, b: sim.ratio(a, b, arrow=True), pairs) == wanted


def test_token_sort_ratio_ignores_order_and_letters_beyond_ascii(spark):
    pairs = [("ACME TEKNOLOJI", "TEKNOLOJI ACME"), ("ŞAHİN ACME", "AHIN ACME"), ("ĞŞ", "ÇÖ"), ("", "")]
    assert scores(spark, lambda a, b: sim.token_sort_ratio(a, b, arrow=True), pairs) == [1.0, 1.0, 1.0, 0.0]


def test_exact(spark):
    assert scores(spark, sim.exact_similarity, [("A", "a"), ("a", "b"), ("", ""), (None, "a")]) == [1.0, 0.0, 0.0, 0.0]
