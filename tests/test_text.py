from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from vitaframe.functions import files, text
from vitaframe.functions.dates import date_or_text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_title_case_equals_python(spark):
    for s in ("o'neil-c3po", "JAVA script", "c++/x", "élan vital", "", "123abc def", "node.js"):
        assert one(spark, text.title_case(F.lit(s))) == s.title()


def test_strip_equals_python(spark):
    for s in ("\u3000 a b\x1c\n", "\x0b\x85x\u2003", "  ", "plain"):
        assert one(spark, text.strip(F.lit(s))) == s.strip()


def test_human_size_rounds_like_python(spark):
    sizes = [0, 1, 1023, 1024, 492800, 3328, 10485760, 5 * 1024**3, 1536]
    units = ["B", "KB", "MB", "GB"]

    def expected(n):
        if n == 0:
            return "0 B"
        value, i = float(n), 0
        while value >= 1024 and i < 3:
            value, i = value / 1024, i + 1
        return f"{Decimal(value).quantize(Decimal('0.1'), ROUND_HALF_EVEN)} {units[i]}"

    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for row in df.select("n", text.human_size(F.col("n")).alias("s")).collect():
        assert row.s == expected(row.n)


def test_rounded_uses_the_binary_value(spark):
    assert one(spark, text.rounded(F.lit(17.935), 2)) == 17.93
    assert one(spark, text.rounded(F.lit(2.5), 0)) == 3.0


def test_types_and_checks(spark):
    cases = {"a.pdf": "pdf", "b.DOCX": "docx", ".pdf": "unknown", "x.tar.txt": "txt", "c.": "unknown", "plain": "unknown"}
    for name, kind in cases.items():
        assert one(spark, files.detect_type(F.lit("/d/" + name))) == kind
    mime = F.lit("text/markdown")
    assert one(spark, files.detect_type(F.lit("readme.md"), mime)) == "txt"
    assert one(spark, files.upload_errors(F.lit("a.exe"), F.lit(0))) == [
        'File type ".exe" is not supported. Please upload .pdf or .docx files.',
        "File appears to be empty. Please select a valid file.",
    ]
    assert one(spark, files.has_allowed_extension(F.lit(None).cast("string"))) is False


def test_dates(spark):
    cases = {"2024-02-03": "2024-02-03", "2024-2": "2024-02-01", "2024": "2024-01-01", "3/2021": "2021-03-01",
             "12/31/2020": "2020-12-31", "Spring 2019": None, "2019-13": None, "2/30/2020": None}
    for s, want in cases.items():
        got = one(spark, date_or_text(F.lit(f" {s} ")))
        assert (str(got.parsed) if got.parsed else None, got.raw) == (want, s)


def test_date_range_labels(spark):
    lit = lambda x: F.lit(x).cast("string")
    label = lambda *a, cur=False: one(spark, text.date_range_label(lit(a[0]), lit(a[1]), F.lit(cur), lit(a[2])))
    assert label("2020-01", "2021-05-07", None) == "Jan 2020 - May 2021"
    assert label("2020", None, None, cur=True) == "Jan 2020 - Present"
    assert label(None, "present", None) == "Present"
    assert label("x", "y", "raw text") == "raw text"
    assert label(None, None, None) == ""
