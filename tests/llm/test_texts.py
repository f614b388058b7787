"""Each operator against a brute-force version, and the cases of its docstring."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from firmaforge.llm import bpe, chunks, decontaminate, grades, language, quality, secrets, simhash, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, hits_ int, fp int"
COMMON = "the of and to in is that for with as on be at by this from or an are it".split()


def text_of(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = text_of(rng, 300)
    words = base.split()
    near = []
    for _ in range(30):
        w = list(words)
        w[rng.randrange(300)] = "changed"
        near.append(" ".join(w))
    texts = [
        None, "", " \n\t ", "One", "two words", "Tie tie TIE", "é" * 50, "a" * 70_000, "x \n" * 3000,
        *near, base, base, base, *[text_of(rng, rng.randrange(1, 200)) for _ in range(60)],
        text_of(rng, 20_000),
    ]
    out = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, "k", "s", 1, 2) for i, t in enumerate(texts)]
    out.append(out[-3])
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


# SimHash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    own = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= 2:
                r, s = root(a), root(b)
                parent[max(r, s)] = min(r, s)
    return {i: root(i) for i, _ in fps}


def test_fingerprints_match_spark_hash(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got & ((1 << 64) - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def _key(x):
    return -1 if x is None else x


@pytest.mark.parametrize("cell_rows", [1, 2, 200])
def test_simhash_links(spark, docs, rows, cell_rows):
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = brute_components(dict(fps).items())
    got = simhash.near_duplicates(docs, cell_rows=cell_rows).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp & ((1 << 64) - 1)) for r in got} == set(fps)
    assert {r.doc_id: r.component for r in got} == want


def test_simhash_chain_and_hot_cells(spark):
    rng = random.Random(1)
    words = [0]
    for _ in range(300):
        words.append(words[rng.randrange(len(words))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    words = sorted({w - (1 << 64) if w >> 63 else w for w in words})
    fps = spark.createDataFrame([(w,) for w in words], "fp long")
    want = brute_components([(w, w & ((1 << 64) - 1)) for w in words])
    for cell_rows in (4, 1000):
        edges = simhash.links(fps, cell_rows=cell_rows).collect()
        assert all(((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 2 for e in edges)
        from firmaforge.operators.components import connected_components

        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges), "a", "b").collect()}
        assert {w: got.get(w, w) for w in words} == want


def test_unary_distance_is_manhattan_and_a_lower_bound(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(63), rng.getrandbits(63) - (1 << 62)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", F.bit_count(simhash.unary(F.col("a")).bitwiseXOR(simhash.unary(F.col("b")))).alias("d")).collect()
    for r in got:
        a, b = r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)
        counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
        assert r.d == sum(abs(p - q) for p, q in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_one_of_each(docs, none, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    want = brute_components(dict((r[0], brute_fingerprint(r[1])) for r in rows).items())
    assert ids == sorted(set(want.values()))
    assert simhash.one_of_each(none).count() == simhash.near_duplicates(none).count() == 0


# Decontamination


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ws = word.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        own = word.findall(low(t))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            part = own[k : k + window]
            for i in range(len(ws) - len(part) + 1):
                if ws[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(ws), len(hit), sorted(x for x in found if x is not None)


@pytest.fixture(scope="module")
def items(rows):
    long = rows[-2][1].split()
    return [
        (1, " ".join(long[50:75])), (2, " ".join(long[60:90])), (2, " ".join(long[60:90])), (3, "TIE, tie"), (4, ""),
        (5, None), (None, "two words"), (10, "one"), (7, "the of and to in is that for with as on"), (8, "x x x"),
    ]


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_phrases(spark, docs, rows, items, block_words):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench, ["doc_id"], block_words=block_words).collect()
    want = sorted((r[0], *brute_hits(r[1], items)) for r in rows)
    assert sorted((r.doc_id, r.n_words_, len(r.hits_), sorted(r.items_)) for r in got) == want
    assert sum(w[2] > 0 for w in want) > 3


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "apple pear plum"), (2, "apple fig")], "item_id long, text string")
    texts = ["plum x x pear x apple", "apple " + "x " * 30 + "pear plum", "fig " * 3 + "x " * 18 + "apple", "fig " + "x " * 19 + "apple"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.near_ for r in decontaminate.matches(docs, bench, ["doc_id"]).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: []}


def test_contaminated_rows_go_apart(spark, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c"), (1, "clean"), (None, "a b c"), (None, None), (2, "")], "doc_id long, text string")
    got = decontaminate.without_contaminated(docs, bench)
    assert sorted(got.collect(), key=str) == sorted([(1, "clean"), (None, None), (2, "")], key=str)
    empty = bench.limit(0)
    assert decontaminate.without_contaminated(docs, empty).count() == 5
    assert decontaminate.matches(none, bench, ["doc_id"]).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    ranks, pattern = bpe.tokenizer()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("dictionary_words", [0, 40, 100_000])
def test_bpe(docs, rows, coder, dictionary_words):
    ranks, pattern, encoding = coder
    decode = bpe.Decoder(ranks)
    finish = lambda ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), decode(ids))
    got = bpe.encode(docs, ranks, pattern, ["doc_id"], finish, "n long, h string, d binary", dictionary_words=dictionary_words)
    want = []
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (r[1] or "").encode()))
    assert sorted((r.doc_id, r.n, r.h, bytes(r.d)) for r in got.collect()) == sorted(want)


def test_bpe_odd_characters(spark, coder, none):
    ranks, pattern, encoding = coder
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([*range(1, 0xD7FF), *range(0xE000, 0x11000)])) for _ in range(60)) for _ in range(40)]
    texts += ["".join(rng.choice("a \n\t\x1c\x1f\x85\xa0 　'sé1²") for _ in range(80)) for _ in range(40)]
    texts += ["".join(rng.choice("ab") for _ in range(400)), "<|endoftext|>", "'S 'll we'd  \n\n x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    finish = lambda ids: (np.frombuffer(ids, "<i4").tolist(),)
    got = bpe.encode(docs, ranks, pattern, ["doc_id"], finish, "ids array<int>")
    assert {r.doc_id: r.ids for r in got.collect()} == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}
    assert bpe.encode(none, ranks, pattern, ["doc_id"], finish, "ids array<int>").count() == 0


def test_long_words_merge_alike(coder):
    ranks, _, encoding = coder
    rng = random.Random(6)
    for word in ["ab" * 500, "a" * 999, "".join(rng.choices("etaoin", k=700)), "é" * 200]:
        assert bpe.merge_long(word.encode(), ranks) == encoding.encode_ordinary(word)
        assert bpe.merge(word[:90].encode(), ranks) == bpe.merge_long(word[:90].encode(), ranks) == encoding.encode_ordinary(word[:90])


def test_ranks_file_is_base64():
    assert base64.b64decode("IQ==") == b"!"


# Secrets


def brute_spans(text):
    out = []
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.ASCII | re.IGNORECASE):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans():
    rng = random.Random(7)
    pieces = ["token", "Token", "toKen", "ſecret", "API_KEY", "api_key", "passwd", " = ", ":", "=", '"', "'", " ", "abc12", "xyzzy99", "AKIA",
              "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=12))
        assert secrets.base_spans(text) == brute_spans(text)


def test_novel_strings_in_sensitive_places():
    measure = secrets.Novelty(b"user_name = session_id = request_token_id_2 = " * 3)
    text = "hmac signature of the key: Zq8kX2vLw9RtY4mN7bPc1s and request_token_id_2 request_token_id_2"
    spans = measure.spans(text, [], secrets.NOVELTY)
    assert [text[a:b] for a, _, b in spans] == ["Zq8kX2vLw9RtY4mN7bPc1s"]
    assert measure.spans("the page Zq8kX2vLw9RtY4mN7bPc1s stands alone", [], secrets.NOVELTY) == []


def test_novel_values_of_names():
    measure = secrets.Novelty(b"user_name = session_id = request_token_id_2 = " * 3)
    known = {
        "export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIKMDENGbPxRfiCYzzEXAMPLE": "wJalrXUtnFEMIKMDENGbPxRfiCYzzEXAMPLE",
        "signature=9fA3kQ02LmZx81PqRt77": "9fA3kQ02LmZx81PqRt77",
        "https://h/p?auth=9fA3kQ02LmZx81PqRt77&page=1": "9fA3kQ02LmZx81PqRt77",
        "dbPwd: 'tr0ub4dor&3 x'": "tr0ub4dor&3 x",
        "the auth key 8412907734412095551": "8412907734412095551",
        "sha_auth: " + "0123456789ab" * 2 + "XqPzRtW9kLmN": "XqPzRtW9kLmN",
    }
    for text, want in known.items():
        assert want in [text[a:b] for a, k, b in secrets.all_spans(text, measure) if k == 3], text
    for text in ("author: Somebody", "keyboard=something", "session_id = request_token_id_2"):
        assert secrets.all_spans(text, measure) == [], text


def test_redact_keeps_rows_and_columns(spark, none):
    text = 'é token = "abcdef123" and ' + "0" * 24
    rows = [(1, text, len(text), "a"), (2, "clean", 99, None), (None, None, None, None), (1, "", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    want = 'é <secret>" and <secret>'
    assert sorted(got.collect(), key=str) == sorted([(1, want, len(want), "a"), *rows[1:]], key=str)
    assert secrets.scan(none, ["doc_id"]).count() == 0


# Toxicity


def toxic_tables(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = text_of(rng, 60).split()
        if bad:
            words.insert(rng.randrange(60), rng.choice(["blockhead", "nitwit"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_insults_are_restored(spark):
    docs, labels = toxic_tables(spark)
    probe = ["you n1tw1t", "you n i t w i t here", "n.i.t.w.i.t", "niiiiitwit", "bl0ckhe@d!", "plain text", "nit wit", None, "", "12 $ 34"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(probe)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs.union(extra), labels, ["doc_id"]).collect()}
    assert [got[1000 + i] >= 0.5 for i in range(len(probe))] == [True] * 5 + [False] * 5
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))


def test_limits_of_the_channel():
    n = np.zeros((32, 32, 32))
    for text in ["you are an idiot and a stupid man", "imb\u00e9cile", "class"] * 300:
        c = toxicity._CODE[np.frombuffer(f"  {text}  ".encode(), np.uint8)].astype(int)
        np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    model = -np.log((n + 0.05) / (n.sum(2, keepdims=True) + 1.6))
    bad = {"idiot": 0.9, "stupid": 0.9, "ass": 0.9, "imb\u00e9cile": 0.9}
    score = toxicity.Scorer({w.encode(): v for w, v in bad.items()}, model).start()
    long = " ".join("youareanidiotandastupidman")
    for text in (long, " ".join("youarean" * 5) + " i d i o t", "what a s t u p i d man", "a s s", "idiiot", "1mb\u00e9cile", "imb\u00e9c1le"):
        assert score(text) == 0.9, text
    for text in ("class", "c l a s s", "you are a man", "y o u a r e a m a n"):
        assert score(text) < 0.5, text
    assert toxicity.viterbi("d.\u0443.\u0440.\u0430.\u043a", model).replace(" ", "").endswith("\u0443\u0440\u0430\u043a")


def test_toxic_rows_go(spark, none):
    docs, labels = toxic_tables(spark)
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == 400
    assert toxicity.without_toxic(none, labels).count() == 0


# Quality rules


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_measures(spark, docs, rows, none):
    rng = random.Random(9)
    more = ["a b c d e f g h " * 5 + text_of(rng, 30), "l1\nl1\n \n\nl2 #*$%&|<>", "w " * 8, "w " * 9, "p q r s t u v w z p q r s t u v w"]
    df = docs.select("doc_id", "text", "lang", "source").union(
        spark.createDataFrame([(900 + i, t, "de", "t") for i, t in enumerate(more)], "doc_id long, text string, lang string, source string")
    )
    want = {r[0]: brute_measures(r[1]) for r in rows} | {900 + i: brute_measures(t) for i, t in enumerate(more)}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.quality_rules(df).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert tuple(r[n] for n in names) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(none).count() == 0


def test_fences_differ_by_group(spark):
    rng = random.Random(10)
    rows = [(i, " ".join("".join(rng.choices("abcd", k=k)) for _ in range(50)), f"s{k}") for k in (4, 16) for i in range(60)]
    odd = [(1000, " ".join(["abcdabcdabcdabcd" + str(i) for i in range(50)]), "s4"), (1001, rows[-1][1].replace(" ", " # "), "s16")]
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows + odd], "doc_id long, text string, lang string, source string")
    measured = quality.measured(df, ["doc_id", "lang", "source"])
    limits = quality.fences(quality.sketches(measured, "lang", "source"), shrink_rows=10)
    got = quality.judged(measured, limits, "lang", "source").filter("not kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [1000, 1001]


def brute_kept(rows):
    """kept of (lang, source, measures) by plain quantiles of each group's sorted shares."""
    share = lambda n, chars, sym, marks, lines, dup, rep: (chars / n, sym / n, marks / n, dup / (lines + 5), rep / n)
    passed = [(g, share(*m)) for *g, m in rows if m[0] >= 20 and 100 * m[6] <= 30 * m[0]]

    def fences(pick):
        out = []
        for k in range(5):
            v = sorted(s[k] for g, s in passed if pick(g))
            low, middle, high = (v[max(0, -(-len(v) * p // 100) - 1)] for p in (5, 50, 95))
            reach = 4.0 * (middle - low)
            out.append((middle - reach if k == 0 else -1.0, max(high, middle + reach), len(v)))
        return out

    def pull(own, wide):
        return [tuple(a + (b - a) * (300 / (o[2] + 300)) for a, b in zip(o[:2], w[:2])) + (o[2],) for o, w in zip(own, wide)]

    limits, corpus = {}, fences(lambda g: True)
    for lang, source in {tuple(g) for g, _ in passed}:
        of_lang = pull(fences(lambda g: g[0] == lang), corpus)
        limits[lang, source] = pull(fences(lambda g: g == [lang, source]), of_lang)
    for lang, source, m in rows:
        ok = m[0] >= 20 and 100 * m[6] <= 30 * m[0]
        yield ok and all(f[0] - 1e-12 <= x <= f[1] + 1e-12 for x, f in zip(share(*m), limits[lang, source]))


def test_kept_is_by_quantiles_of_the_groups(spark):
    rng = random.Random(19)
    rows = []
    for i in range(600):
        words = ["".join(rng.choices("abcdef", k=rng.choice((3, 4, 5, 5, 6)))) for _ in range(rng.randrange(10, 60))]
        for mark in rng.choices(["", "#", "!", "\nsame line\nsame line\n", "abcdefabcdefabcdef"], k=2):
            if rng.random() < 0.15:
                words[rng.randrange(len(words))] += mark
        rows.append((i, " ".join(words), rng.choice(["de", "en", None]), rng.choice(["s1", "s1", "s2", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words"]
    found = quality.measured(df, ["doc_id", "lang", "source"]).orderBy("doc_id").collect()
    want = list(brute_kept([(r.lang, r.source, tuple(r[n] for n in names)) for r in found]))
    got = [r.kept for r in quality.quality_rules(df).orderBy("doc_id").collect()]
    assert got == want and 30 < got.count(False) < 300


# Substring dedup


def test_passages_resist_shifts(spark, none):
    rng = random.Random(11)
    shared = text_of(rng, 60)
    rows = [(i, text_of(rng, 40 + i) + " " + shared + " " + text_of(rng, 40)) for i in range(5)]
    rows += [(10 + i, text_of(rng, 120)) for i in range(5)] + [(20, None), (21, ""), (22, rows[0][1]), (5, rows[4][1]), (5, rows[4][1])]
    rows += [(None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.passages(docs).collect()}
    assert not got[0].removed and got[0].shared
    for i in (1, 2, 3, 4, 5):
        assert got[i].removed and 0 in got[i].first_ids + got[4].first_ids
        start = rows[i][1].encode().index(shared.encode()) if i < 5 else None
        if start is not None and i < 4:
            span = got[i].removed[0]
            assert span.start <= start and start + len(shared.encode()) <= span.end
    assert got[22].removed[-1].end == len(rows[0][1].encode())
    assert not any(got[i].removed for i in range(10, 15) if i in got)
    assert len(chunks.without_repeats(docs).collect()) == len(rows)
    assert chunks.passages(none).count() == 0


def test_passages_of_51_words_are_found_whole(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for i in range(150):
        passage = text_of(rng, 51)
        pair = [[text_of(rng, rng.randrange(1, 40)), text_of(rng, rng.randrange(1, 40))] for _ in range(2)]
        texts = [f"{a} {passage} {b}".encode() for a, b in pair]
        at = [t.index(passage.encode()) for t in texts]
        # By brute force: as far as both texts agree around the passage.
        left, right, size = 0, 0, len(passage.encode())
        while left < min(at) and texts[0][at[0] - left - 1] == texts[1][at[1] - left - 1]:
            left += 1
        while all(a + size + right < len(t) for a, t in zip(at, texts, strict=True)) and len(
            {t[a + size + right] for a, t in zip(at, texts, strict=True)}
        ) == 1:
            right += 1
        want[2 * i + 1] = (at[1] - left, at[1] + size + right)
        rows += [(2 * i + k, t.decode()) for k, t in enumerate(texts)]
    long = text_of(rng, 3000)
    rows += [(1000, "x " + long), (1001, "y " + long), (None, rows[0][1]), (None, rows[0][1]), (1002, " ".join(long.split()[:45]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.passages(docs).collect()
    removed = {r.doc_id: [tuple(s) for s in r.removed] for r in got if r.doc_id is not None}
    for i, span in want.items():
        assert len(removed[i]) == 1
        # A letter or two can differ where bytes agree in the middle of a character.
        assert all(abs(a - b) <= 3 for a, b in zip(removed[i][0], span, strict=True)), (i, removed[i], span)
    assert removed[1001] == [(1, len(rows[301][1].encode()))]
    assert not removed.get(1002) and not any(removed.get(i) for i in range(0, 300, 2))
    assert [[tuple(s) for s in r.removed] for r in got if r.doc_id is None] == [[(0, len(rows[0][1].encode()))]] * 2
    # Few bytes at a time give the same, in more rounds.
    texts = chunks.numbered(docs)
    found = chunks.cut(chunks.runs(texts))
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert plain(chunks.extended(texts, found, 4)) == plain(chunks.extended(texts, found))


def test_chunks_are_cut_by_content():
    rng = random.Random(12)
    data = text_of(rng, 3000).encode()
    a = {data[i:j] for i, j in zip([0, *chunks.ends(data)], chunks.ends(data))}
    moved = b"inserted " + data
    b = {moved[i:j] for i, j in zip([0, *chunks.ends(moved)], chunks.ends(moved))}
    assert len(a & b) > 0.98 * len(a)
    assert chunks.ends(b"") == [] and chunks.ends(b"a") == [1]
    assert max(np.diff([0, *chunks.ends(b"a" * 5000)])) <= chunks.MOST_CHUNK


# Language


def test_languages(spark, none):
    rng = random.Random(13)
    vocab = {"en": "the of and which with from", "de": "der und nicht über für schön", "fr": "le très où ça était été", "es": "el niño qué más así está"}
    rows = []
    for i in range(600):
        lang = sorted(vocab)[i % 4]
        rows.append((i, " ".join(rng.choice(vocab[lang].split()) for _ in range(30)), lang))
    rows += [(700, None, "en"), (701, "123 !!", "en"), (702, "", None), (703, "the of", None), (704, "der und", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs, model, ["doc_id"]).collect()}
    assert sum(got[i][0] == rows[i][2] for i in range(600)) > 590
    assert [got[i][0] for i in (700, 701, 702)] == ["und"] * 3 and got[703][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    blank = language.fit(none)
    assert [r.lang_pred for r in language.identified(docs.limit(3), blank, ["doc_id"]).collect()] == ["und"] * 3


# Graded quality


def test_ordinal_grades(spark, none):
    rng = random.Random(14)
    rows, ratings = [], []
    for i in range(600):
        g = i % 3
        rows.append((i, " ".join(w + ["%%%", "!", ""][g] if rng.random() < 0.5 else w for w in text_of(rng, 80).split())))
        ratings.append((i, g))
    rows += [(700, None), (701, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(ratings + [(None, 1), (5, None)], "doc_id long, grade int")
    model = grades.fit(docs, rated)
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.thresholds()) > 0)
    got = {r.doc_id: r for r in grades.graded(docs, model, ["doc_id"], 1).collect()}
    assert sum(abs(got[i].expected_grade - i % 3) < 0.5 for i in range(600)) > 570
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    blank = grades.fit(docs, rated.limit(0))
    assert {r.expected_grade for r in grades.graded(docs, blank, ["doc_id"], 1).collect()} == {0.0}
    assert grades.graded(none, model, ["doc_id"], 1).count() == 0


def test_beginnings_of_weighted_words_need_texts_of_their_own():
    picked = {
        b"loser": (0.95, 80, 80), b"lose*": (0.8, 82, 110),  # others that begin so are clean
        b"idiot": (0.95, 80, 80), b"idio*": (0.96, 100, 100),  # others are as bad
        b"moron": (0.9, 40, 40), b"moro*": (0.9, 40, 40), b"vile*": (0.7, 30, 32),
    }
    got = toxicity.without_borrowed(picked)
    assert set(got) == set(picked) - {b"lose*"}
    assert got[b"moro*"] == 0.9 and got[b"vile*"] == 0.7 and 0.8 < got[b"idio*"] < 0.96
