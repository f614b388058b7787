"""The filter audit against a plain loop over all orders, and its odd cases."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from firmaforge.llm import audit

DDL = "doc_id long, text string, source string, part_ int, mask_ string, good_ string, low_ int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    ws = WORD.findall(text)
    return [
        len(ws) < 50,
        100 * len(set(ws)) < 65 * len(ws),
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = [
        (s or "", [*fails(t or ""), i is not None and i > first[t or ""]], i in good, i in toxic) for i, t, s, *_ in rows
    ]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                cut = [d for d in left if d[1][k]]
                share[f] += len(cut)
                redundant = sum(d[1][k] for d in gone)
                alone = sum(d[1][k] and sum(d[1]) == 1 for d in own)
                left, gone = [d for d in left if not d[1][k]], gone + cut
                out[part, "".join(order), step] = [
                    len(left), len(cut), redundant, alone, sum(d[2] for d in cut), sum(d[3] for d in cut)
                ]
        for key, row in out.items():
            if key[0] == part:
                row.append(share[key[1][key[2] - 1]])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = " ".join(rng.choices("abcdefghij", k=60))
    texts = [None, "", " \t\n", "A", "É" * 30, base, base, base.upper(), " ".join(map(str, range(80))), "x # y", "word " * 30_000]
    texts += [" ".join(rng.choices([f"w{i}" for i in range(80)] + ["NOW", "50%"], k=rng.randrange(30, 120))) for _ in range(60)]
    out = [(i, t, rng.choice(["s", "t", None, ""]), 1, "m", "g", 2) for i, t in enumerate(texts)]
    out += [out[5], out[6], (None, base, "s", 1, "m", "g", 2), (None, "only here", None, 1, "m", "g", 2)]
    return out + [(100 + i, base, "hot", 1, "m", "g", 2) for i in range(40)]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, DDL).repartition(3).withColumn("part", F.coalesce("source", F.lit("")))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = audit.failure_masks(docs, ["doc_id", "part"])
    return audit.audit(audit.labelled(masks, marks, ["part", "mask_"]))


def test_all_orders_like_a_plain_loop(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, None, 1), (None, 1, 1), (6, 0, 1), (6, 1, 0)]
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in audited(spark, rows, labels).collect()}
    assert got == brute(rows, labels)
    assert len(got) == 4 // 4 * 600 * len({r[2] or "" for r in rows})


def test_no_documents_no_rows(spark):
    out = audited(spark, [], [])
    assert out.collect() == [] and out.columns[:3] == ["part", "filter_order", "step"]


def test_plain_changes_visit_every_order():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in audit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_swaps_share_equal_nodes():
    counts = {m: (1,) for m in range(32)}
    diagram = audit.Diagram(5, counts, 1)
    for i in audit.plain_changes(5):
        diagram.swap(i)
        assert [len(level) for level in diagram.level] == [1] * 5
