import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vitaframe.functions import redact


def python_redact(text, order=redact.SEQUENTIAL):
    """The sequential rules, restated with Python's own regex engine."""

    def mark(label, value):
        return f"{label}_[{hashlib.sha256(value.encode()).hexdigest()[:8]}]"

    for kind in order:
        pattern, ignore_case = redact.PII_PATTERNS[kind]
        text = re.sub(pattern, lambda m, k=kind: mark(k, m.group(0)), text, flags=re.I if ignore_case else 0)

    def path(m):
        return m.group(0).replace(m.group(1), mark("user", m.group(1)))

    return re.sub(redact.USER_PATH, path, text, flags=re.I)


# texts, and the kinds of what is found in them, in text order
CASES = {
    "Lena Brook answers lena.brook@post.example and +49 30 5550 1234 after lunch": ["name", "email", "phone"],
    "slides are at https://slides.example.net/q3?x=1, notes at www.notes.example": ["url", "url"],
    "they moved to 77 Harbour Lane last year": ["name"],
    "no. 987-65-4321 and 5500-0000-0000-0004": ["phone", "phone"],
    "saved under /Users/lbrook/papers/cv.docx": ["user"],
    "nothing to see": [],
}


def test_known_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r.t: r.r for r in df.select("t", redact.redact_text(F.col("t")).alias("r")).collect()}
    assert got == {t: python_redact(t) for t in CASES}
    assert {t: re.findall(r"(email|name|phone|url|user)_\[[0-9a-f]{8}\]", r) for t, r in got.items()} == CASES


@pytest.mark.parametrize("order", [redact.SEQUENTIAL, redact.SPECIFIC_FIRST])
def test_whole_documents_equal_python(spark, data, order):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = ["/home/home/x", r"C:\Users\Zoë\a /home/zoë", "Ä Äb Cd Ef", "４１１１ 1111 1111 1111", "", "a@b.co|x@y.zz"]
    df = docs.select("text").union(spark.createDataFrame([(e,) for e in extra], "text string"))
    for row in df.select("text", redact.redact_text(F.col("text"), order).alias("r")).collect():
        assert row.r == python_redact(row.text, order)


def test_placeholders_are_stable(spark):
    df = spark.range(2).select(redact.redact_text(F.lit("mail a@example.com")).alias("r"))
    assert df.distinct().count() == 1


def test_null_stays_null(spark):
    assert spark.range(1).select(redact.redact_text(F.lit(None).cast("string"))).first()[0] is None


def test_nested_fields_and_falsy_values(spark):
    df = spark.sql(
        "SELECT named_struct('email', 'me@post.example', 'phone', '030 5550 77', 'full_name', 'Lena Brook', 'password', 'hush', "
        "'normal_field', 'just a remark', 'token', '', 'key_count', 0, 'ok', true) AS e, map('mobile', '1', 'x', 'a@b.org') AS m, "
        "array(named_struct('note', 'call 555 123 4567 8')) AS l"
    )
    row = redact.redact_log_events(df).first()
    mark = lambda label, value: f"{label}_[{hashlib.sha256(value.encode()).hexdigest()[:8]}]"
    assert row.e.email == mark("email", "me@post.example") and row.e.phone == mark("phone", "030 5550 77")
    assert row.e.full_name == mark("name", "Lena Brook") and row.e.password == mark("secret", "hush")
    assert row.e.normal_field == "just a remark"
    assert row.e.token == "" and row.e.key_count == "0" and row.e.ok is True
    assert row.m["mobile"].startswith("phone_[") and row.m["x"].startswith("email_[")
    assert "phone_[" in row.l[0].note
    assert row._pii_redacted is True


def test_field_name_matching_modes():
    assert redact.is_pii_field("description") and not redact.is_pii_field("description", "word")
    assert redact.is_pii_field("file_name", "word") and redact.is_pii_field("IP_address")
    assert redact.field_label("home_address") == "address" and redact.field_label("token") == "pii"


def test_map_values_under_personal_keys_of_any_type(spark):
    df = spark.sql(
        "SELECT map('phone', 5551234567L, 'n', 7L) AS a, map('ssn', array('x'), 'tags', array('y')) AS b, map('description', 'plain') AS c"
    )
    row = redact.redact_frame(df, match="word").first()
    assert row.a["phone"].startswith("phone_[") and row.a["n"] == "7"
    assert row.b["ssn"].startswith("pii_[") and row.b["tags"] == '["y"]'
    assert row.c["description"] == "plain"
    assert redact.redact_frame(df.select("c")).first().c["description"].startswith("ip_[")
