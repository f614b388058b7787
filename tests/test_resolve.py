import itertools
import random

import pytest
from pyspark.sql import functions as F

from firmaforge import schemas
from firmaforge.functions.similarity import _lcs_many
from firmaforge.operators import resolve as r
from firmaforge.operators.components import connected_components

FLAT = (
    "id string, legal_name string, city string, website_url string, phones array<string>, "
    "emails array<string>, address string"
)
SCENARIOS = [
    ("1", "ABC Teknoloji A.Ş.", "İstanbul", "https://www.abctech.example", ["+902123456789"], ["info@abctech.example"], None),
    ("2", "ABC TEKNOLOJI ANONIM SIRKETI", "Istanbul", "https://abctech.example", ["0212 345 67 89"], ["contact@abctech.example"], None),
    ("3", "ABC Teknik Ltd", "Ankara", "https://abcteknik.example", ["+903121112233"], ["info@abcteknik.example"], None),
    ("4", "XYZ Gıda", "İzmir", "https://xyz.example", ["+902324445566"], [], None),
    ("5", "Yalnız", "Bursa", None, [], [], None),
    ("6", "Başka Firma", "İstanbul", "https://baska.example", ["+902123456789"], [], None),
]


def pairs(df):
    return {(m.company_a_id, m.company_b_id): m for m in df.collect()}


def test_scenarios(spark):
    feats = r.match_features(spark.createDataFrame(SCENARIOS, FLAT))
    found = pairs(r.find_matches(feats))
    assert set(found) == {("1", "2")}
    match = found["1", "2"]
    assert match.match_type == "fuzzy"
    assert match.match_fields["domain"] == match.match_fields["phone"] == match.match_fields["email"] == 1.0
    assert 0.70 <= match.match_score <= 0.90
    # The blocking key as one text needs the same spelling of the city.
    assert pairs(r.find_matches(feats, compat=True)) == {}


def test_same_name_without_addresses_is_for_review(spark):
    rows = [
        ("1", "Acme A.Ş.", None, "https://a.example", ["02121112233"], ["info@a.example"], None),
        ("2", "ACME A.Ş.", None, "http://www.a.example/x", ["+90 212 111 22 33"], ["sales@a.example"], None),
    ]
    found = pairs(r.find_matches(r.match_features(spark.createDataFrame(rows, FLAT))))
    match = found["1", "2"]
    assert abs(match.match_score - 0.90) < 1e-9 and match.requires_review and match.match_type == "fuzzy"
    assert r.review_queue(r.find_matches(r.match_features(spark.createDataFrame(rows, FLAT)))).count() == 1


def test_equal_addresses_make_it_exact(spark):
    rows = [
        ("1", "Acme A.Ş.", None, "https://a.example", ["02121112233"], ["info@a.example"], "Ata Cad. 1"),
        ("2", "Acme", None, "a.example", ["2121112233"], ["x@a.example"], "ata cad. 1"),
    ]
    rows[1] = (*rows[1][:-1], "Ata Cad. 1")
    match = pairs(r.find_matches(r.match_features(spark.createDataFrame(rows, FLAT))))["1", "2"]
    assert abs(match.match_score - 1.0) < 1e-9 and match.match_type == "exact" and not match.requires_review


def test_candidate_rules():
    assert r.candidate_rules(r.WEIGHTS, 0.70) == [
        ("domain", "phone"), ("domain", "email"), ("domain", "legal_name", "address"),
    ]
    assert r.candidate_rules(r.WEIGHTS, 0.95) == [("domain", "phone", "email")]
    with pytest.raises(ValueError):
        r.candidate_rules(r.WEIGHTS, 0.30)


def brute_force(feats):
    def ratio(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        common = int(_lcs_many([a], [b])[0])
        return round(100 * (2 * common / (len(a) + len(b)))) / 100

    out = {}
    for a, b in itertools.combinations(sorted(feats, key=lambda x: x.id), 2):
        parts = {
            "domain": float(a.domain != "" and a.domain == b.domain),
            "legal_name": ratio(a.name, b.name) if a.has_name and b.has_name else 0.0,
            "phone": float(bool(set(a.phones) & set(b.phones))),
            "email": float(bool(set(a.hosts) & set(b.hosts))),
            "address": ratio(a.address, b.address) if a.address and b.address else 0.0,
        }
        total = sum(parts[k] * w for k, w in r.WEIGHTS.items()) / sum(r.WEIGHTS.values())
        if total >= 0.70:
            out[a.id, b.id] = round(total, 9)
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    """One site holds a third of all rows; many rows are copies; some addresses are long."""
    random.seed(11)
    names = ["Acme Teknoloji A.Ş.", "ACME Teknoloji Ltd", "Acme Tekno", "Beta Gıda San Tic", "Beta Gida Sanayi", "Ğşü", ""]
    long = "Mah. " + "abcdefghij " * 12
    addresses = [None, "Cad. 1 Istanbul", "Cad. 1 İstanbul", long, long[:50] + long[51:], long + "x", long * 4, (long * 4)[:200] + (long * 4)[203:]]
    rows = []
    for i in range(80):
        site = "hot.example" if i % 3 == 0 else random.choice(["a.example", "b.example/x", None])
        rows.append(
            (
                f"{i:04d}",
                random.choice(names),
                None,
                site,
                random.sample(["0212 345 67 89", "+902123456789", "05321234567", "5321234567"], random.randint(0, 2)),
                random.sample(["info@a.example", "x@b.example", "bad"], random.randint(0, 2)),
                random.choice(addresses),
            )
        )
    rows += [(f"c{i:03d}", *rows[3][1:]) for i in range(15)]
    return r.match_features(spark.createDataFrame(rows, FLAT)).cache()


def test_matches_agree_with_brute_force(crowd):
    # Three rows a slice: the hot site is cut into many tiles.
    found = r.expand_matches(crowd, r.MatchConfig(slice_rows=3)).collect()
    got = {(m.company_a_id, m.company_b_id): round(m.match_score, 9) for m in found}
    assert len(got) == len(found)
    assert got == brute_force(crowd.collect())


def test_copies_are_tied_to_the_first_only(crowd):
    assert r.find_matches(crowd).count() < len(brute_force(crowd.collect()))


def test_near_equal_long_addresses_match(spark):
    base = "".join(random.Random(1).choices("abcdefgh ", k=450)).replace("  ", "x ").strip() + "z"
    edited = base[:100] + base[101:300] + "q" + base[300:]
    rows = [
        ("1", "Acme", None, "a.example", ["02121112233"], [], base),
        ("2", "Acme", None, "a.example", ["02129998877"], [], edited),
    ]
    match = pairs(r.find_matches(r.match_features(spark.createDataFrame(rows, FLAT))))["1", "2"]
    assert abs(match.match_score - 0.70) < 1e-9


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("hub", "s0")]
    chain += [("hub", f"s{i}") for i in range(50)]
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame(chain, "a string, b string")
    got = {c.node: c.component for c in connected_components(edges, "a", "b").collect()}
    assert len(got) == 41 + 2 + 51
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"}
    assert got["x"] == got["y"] == "x" and {got[f"s{i}"] for i in range(50)} == {"hub"}


def company(id_, name, phone, mail, address, **more):
    return dict(
        id=id_,
        identity=dict(legal_name=name, trade_name=more.get("trade"), city=more.get("city")),
        web_presence=dict(website_url="https://a.example", social_links=more.get("links")),
        contacts=dict(emails_public=[mail], phones_public=[phone], address_public=address),
        business_meta=dict(keywords=more.get("keywords", [])),
        provenance=[dict(source_url=f"https://src.example/{id_}", source_type="manual")],
        confidence_score=more.get("confidence", 1.0),
    )


def test_merge(spark):
    long = "Ata Caddesi 1 Kızılay Ankara"
    rows = [
        company("1", "Acme A.Ş.", "02121112233", "info@a.example", long, links={"x": "1", "y": "1"}, keywords=["b"], confidence=1.0),
        company("2", "ACME", "02121112233", "sales@a.example", long, trade="Acme Co", city="Ankara", links={"y": "2"}, keywords=["a", "b"], confidence=0.5),
        company("3", "Acme", "2121112233", "info@a.example", long + " TR", links={}, keywords=["c"], confidence=0.0),
        company("9", "Other", "02129990000", "info@o.example", "x"),
    ]
    df = spark.createDataFrame(rows, schemas.COMPANY)
    done = r.resolve(df)
    out = {c.id: c for c in done.companies.collect()}
    assert set(out) == {"1", "9"}
    one = out["1"]
    assert one.identity.legal_name == "Acme A.Ş." and one.identity.trade_name == "Acme Co" and one.identity.city == "Ankara"
    assert one.contacts.emails_public == ["info@a.example", "sales@a.example"]
    assert one.contacts.phones_public == ["02121112233", "2121112233"]
    assert one.contacts.address_public == long + " TR"
    assert one.web_presence.social_links == {"x": "1", "y": "2"}
    assert one.business_meta.keywords == ["a", "b", "c"]
    assert one.confidence_score == ((1.0 + 0.5) / 2 + 0.0) / 2
    assert r.merged_provenance(df, done.groups).filter("id = '1'").count() == 3
    assert {(a.kind, a.name) for a in r.aliases(df, done.groups).collect()} == {
        ("legal", "Acme A.Ş."), ("legal", "ACME"), ("legal", "Acme"), ("trade", "Acme Co"),
    }
    again = r.resolve(done.companies)
    assert sorted(c.id for c in again.companies.collect()) == ["1", "9"]
    untouched = r.resolve(df, auto_merge=False)
    # 1 and 2 are copies; what 3 has with the first holds for both.
    assert untouched.companies.count() == 4 and untouched.matches.count() == 2


def test_running_mean_of_a_long_group(spark):
    random.seed(4)
    values = [random.random() for _ in range(500)]
    rows = [("g", f"{i:05d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, o string, v double")
    wanted = values[0]
    for v in values[1:]:
        wanted = (wanted + v) / 2
    assert abs(r.running_mean(df, "g", "o", "v").first().v - wanted) < 1e-15


def test_blocking_keys(spark):
    df = spark.createDataFrame(SCENARIOS, FLAT)
    keys = r.blocking_keys(F.col("legal_name"), F.col("website_url"), F.col("phones"), F.col("city"))
    got = {x.id: x.k for x in df.select("id", keys.alias("k")).collect()}
    assert got["1"] == ["domain:abctech.example", "name:ABC", "phone:+90212", "city:İSTANBUL"]
    assert got["5"] == ["name:YAL", "city:BURSA"]
    text = df.select(r.composite_key(F.array().cast("array<string>"))).first()[0]
    assert text == "unknown"


def many_firms(spark, n):
    """One site, one number and one mail host for all; names of three words and a number."""
    rng = random.Random(3)
    syllables = [a + b for a in "bcdfghjklmnprstvz" for b in "aeiou"]
    words = ["".join(rng.choices(syllables, k=rng.randrange(2, 5))) for _ in range(2000)]
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(words, k=3)) + f" {rng.randrange(100)}"
        if i % 10 == 1:  # a slip of the one before
            k = rng.randrange(len(name))
            name = rows[-1][1][:k] + rows[-1][1][k + 1 :]
        rows.append((f"{i:06d}", name, None, "hot.example", ["02121112233"], ["i@hot.example"], f"Street {i % 50}"))
    return r.match_features(spark.createDataFrame(rows, FLAT))


def test_grams_find_all_matches_and_few_others(spark):
    cfg = r.MatchConfig()
    assert r.least_name_similarity(cfg.weights, r.candidate_rules(cfg.weights, 0.95), 0, 0.95) == pytest.approx(0.8)
    feats = many_firms(spark, 2000)
    prof = r._prepared(feats, False)[1]
    pairs = r.candidate_pairs(prof, cfg, cfg.exact).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    met = pairs.count()
    found = pairs_of(r.profile_matches(prof, cfg, cfg.exact))
    assert len(found) >= 150
    # Of two million pairs with equal flags a few candidates for each match are scored.
    assert met == pairs.distinct().count() < 20 * len(found)
    some = sorted(feats.filter("id < '000150'").collect(), key=lambda x: x.id)
    want = {k for k, score in brute_force(some).items() if score >= 0.95}
    assert {k for k in found if max(k) < "000150"} == want and len(want) >= 10


def test_few_profiles_of_a_key_stand_under_it_once(spark):
    """Records are not multiplied by the letter pairs of their names unless many share the flags."""
    cfg = r.MatchConfig()
    rows = [(f"{i:03d}", f"Amber Trading Company F{i}", None, f"s{i // 4}.example", ["02121112233"], [f"i@s{i // 4}.example"], "Street 1") for i in range(80)]
    prof = r._prepared(r.match_features(spark.createDataFrame(rows, FLAT)), False)[1]
    seen = []
    tiled = r._tiled
    try:
        r._tiled = lambda keyed, rows: seen.append(keyed.count()) or tiled(keyed, rows)
        pairs = {rows: pairs_of(r.profile_matches(prof, r.MatchConfig(gram_rows=rows), cfg.exact)) for rows in (32, 3)}
    finally:
        r._tiled = tiled
    assert seen[0] == 80 and seen[1] > 400
    assert pairs[32] == pairs[3] and len(pairs[3]) > 20


def pairs_of(df):
    return {(m.company_a_id, m.company_b_id) for m in df.select("company_a_id", "company_b_id").collect()}


# Scores are multiples of 0.0005, so that none is equal to one of these.
@pytest.mark.parametrize("threshold", [0.79025, 0.92025, 0.97025])
def test_candidates_at_any_threshold(spark, threshold):
    feats = many_firms(spark, 60).unionByName(
        r.match_features(spark.createDataFrame([(f"x{i}", n, None, "hot.example", ["02121112233"], ["i@hot.example"], "Street 1")
                                                for i, n in enumerate(["", "a", "ab", "ba", "a b", "ğ", "...", "aaaa aaaa", "aaaa aaab"])], FLAT))
    )
    want = {k for k, score in brute_force(feats.collect()).items() if score >= threshold}
    assert pairs_of(r.profile_matches(r._prepared(feats, False)[1], threshold=threshold)) == want
