import re

from pyspark.sql import functions as F

from firmaforge.functions import privacy as p
from firmaforge.operators import compliance


def test_detect(apply):
    values = ["id 12345678901", "card 1234-5678 90123456", "u12345678", "TR33 0006", "Ada Byron", "Acme Group", "plain"]
    assert apply(p.detect_pii, values) == [
        ["tc_kimlik"], ["credit_card"], ["passport"], [], ["personal_name"], [], [],
    ]
    assert apply(p.has_pii, values) == [True, True, True, False, True, False, False]
    assert apply(p.detect_pii, ["TR3300061234567ABCD"]) == [["iban"]]


def test_corporate_email(apply):
    values = ["ada.byron@example.com", "info7@example.com", "web7@example.com", "web@example.com", "nothing", None]
    assert apply(p.is_corporate_email, values) == [False, True, False, True, False, False]
    assert apply(p.is_contact_email, ["sales.tr@x.co", "ada.b@x.co", "ada1@x.co", "ada@x.co"]) == [True, False, False, True]


def test_mask(apply):
    values = ["id 12345678901, mail ada.byron@example.com or info@example.com", "a1@x.com no number"]
    assert apply(p.mask_pii, values) == [
        "id [REDACTED], mail [EMAIL_REDACTED] or info@example.com",
        "[EMAIL_REDACTED] no number",
    ]


def test_masked_text_holds_no_pattern(apply):
    values = ["1234 5678 9012 3456 x 98765432109 y B12345678 z TR3300061234567ABCD"]
    masked = apply(p.mask_pii, values)[0]
    assert not any(re.search(pattern, masked, re.I) for pattern in p.PII_PATTERNS.values())


def test_recursive_filter(spark):
    ddl = (
        "id string, t string, l array<string>, s struct<a:string, n:int>, "
        "ls array<struct<a:string>>, m map<string,string>, k array<int>"
    )
    bad = "no 12345678901"
    row = ("12345678901", bad, [bad, "ok", None], (bad, 1), [(bad,), None], {"x": bad, "y": None}, [1])
    out = p.filter_pii(spark.createDataFrame([row, (None,) * 7], ddl), keep=("id",)).collect()
    assert out[0].asDict(recursive=True) == {
        "id": "12345678901",
        "t": "no [REDACTED]",
        "l": ["ok", None],
        "s": {"a": "no [REDACTED]", "n": 1},
        "ls": [{"a": "no [REDACTED]"}, None],
        "m": {"x": "no [REDACTED]", "y": None},
        "k": [1],
    }
    assert set(out[1].asDict().values()) == {None}


def test_strict_filter_takes_names_and_mails(spark):
    df = spark.createDataFrame([("Ada Byron", ["ada.b@x.com", "info@x.com"])], "t string, l array<string>")
    assert p.filter_pii(df, strict=True).first().asDict() == {"t": "[NAME_REDACTED]", "l": ["info@x.com"]}
    assert p.filter_pii(df).first().asDict() == {"t": "Ada Byron", "l": ["ada.b@x.com", "info@x.com"]}


def test_change_hash_ignores_order_and_sees_nulls(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    one = [r[0] for r in df.select(p.change_hash("x", "y")).collect()]
    two = [r[0] for r in df.select(p.change_hash("y", "x")).collect()]
    assert one == two and one[0] != one[1]


def test_requests(spark):
    firms = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "id string, legal_name string")
    asked = spark.createDataFrame(
        [("delete", "1", "r"), ("export", "B", "r"), ("export", "2", "r"), ("suppress", "3", "r"), ("x", "3", "r")],
        "action string, identifier string, requester string",
    )
    none = spark.createDataFrame([], "id_hash string")
    out = compliance.process_requests(asked, firms, firms, none, at="2024-06-01 00:00:00")
    flagged = {r.id: r.gdpr_suppressed for r in out["master"].collect()}
    assert flagged == {"1": True, "2": False, "3": False}
    assert sorted(r.id for r in out["search_set"].collect()) == ["2", "3"]
    assert [r.id for r in out["exports"].collect()] == ["2"]
    assert out["suppressed"].count() == 2
    assert sorted(r.status for r in out["audit"].collect()) == ["accepted", "completed", "completed", "completed", "rejected"]
    kept = compliance.without_suppressed(firms, out["suppressed"], "id")
    assert [r.id for r in kept.collect()] == ["2"]


def test_retention_and_overdue(spark):
    days = spark.createDataFrame([("2023-06-02",), ("2023-06-01",), ("2022-05-01",)], "d string").select(
        F.col("d").cast("date").alias("d")
    )
    status = compliance.retention_status(F.col("d"), F.lit("2024-06-01").cast("date"))
    assert [r[0] for r in days.select(status).collect()] == ["active", "archive", "expired"]
    log = spark.sql("SELECT timestamp'2024-04-01' AS timestamp, CAST(NULL AS timestamp) AS completion_date")
    assert compliance.overdue(log, F.lit("2024-06-01").cast("date")).count() == 1


def test_minimisation(spark):
    df = spark.createDataFrame(
        [("1", ["a"], "x"), ("2", [], None)], "id string, personal_emails array<string>, religion string"
    )
    out = {r.company_id: sorted(r.issues) for r in compliance.minimisation_report(df).collect()}
    assert out == {"1": ["personal_emails", "religion"], "2": ["religion"]}
