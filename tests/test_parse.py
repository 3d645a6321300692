from pyspark.sql import functions as F

from vitaframe.functions.extract import KEEP_ALL, PUBLISHED_LIMITS
from vitaframe.operators.lines import carry_forward, section_lines
from vitaframe.plans import parse
from vitaframe.plans import profile as P
from vitaframe.sources import documents as D

RESUME = """Jane Roe
jane.roe@example.com  +1 (555) 123-4567
https://github.com/jane www.jane.dev
12
Summary
Engineer with many years of data work. Short. Likes big clusters and small diffs.

Work Experience
Senior Engineer at Foo Inc
2019 - 2022
• built pipelines
- led team

Data Analyst
2015 to present
stuff here
Education
Bachelor of Science, State University 2014
Honors program
Technical  Skills:
Skills: Python, ReactJS; K8s
Technologies: C++ | SQL - Go
Projects
Foo project name
does things

Bar project
Awards
- Best person award
the end"""


def plain(spark, text, limits=PUBLISHED_LIMITS, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return parse.parse_plain(df, limits=limits, **kw).first().result


def test_plain_resume(spark):
    r = plain(spark, RESUME)
    s = r.sections
    assert s.contact.email == "jane.roe@example.com" and s.contact.phone == "+1 (555) 123-4567"
    assert s.contact.urls == ["https://github.com/jane", "www.jane.dev"]
    assert s.summary == "Engineer with many years of data work. Likes big clusters and small diffs"
    assert [(j.title, j.company, j.duration) for j in s.experience] == [
        ("", "Senior Engineer at Foo Inc", "2019 - 2022"),
        ("Data Analyst", "", "2015 to present"),
    ]
    assert s.experience[0].responsibilities == ["built pipelines", "led team"]
    assert [p.name for p in s.projects] == ["Foo project name", "Bar project"]
    # "Skills: Python, ..." is a short line with a section word, hence a header of its own.
    assert s.skills == ["SQL", "Go"]
    assert s.achievements == ["Best person award"]  # the last line never counts
    assert abs(r.metadata.confidence_score - 0.56) < 1e-9


def test_compat_forgets_blank_lines(spark):
    assert len(plain(spark, RESUME, compat=True).sections.experience) == 1


def test_plain_without_sections_and_blank(spark):
    loose = plain(spark, "nothing but python here")
    assert loose.sections.skills == ["Python"]
    assert "No clear sections detected - using heuristic extraction" in loose.warnings
    blank = plain(spark, " \n ")
    assert "No text content extracted from PDF" in blank.warnings and blank.sections.skills == []


def test_txt_goes_through_the_line_extractor(spark):
    r = plain(spark, RESUME, is_pdf=F.lit(False))
    assert r.extraction_method == "txt_lines"
    assert r.warnings == ["TXT files have limited parsing capabilities"]


def styled(spark, text, bold):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    paragraphs = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), x.rlike(bold).alias("is_bold")))
    return parse.parse_styled(df.withColumn("paragraphs", paragraphs)).first()


def test_styled_resume(spark):
    row = styled(spark, RESUME, "^(Summary|Work|Education|Technical|Projects|Awards)")
    s = row.result.sections
    assert row.sections_found == ["summary", "experience", "education", "skills", "projects", "achievements"]
    assert [(j.title, j.company) for j in s.experience] == [
        ("Senior Engineer at Foo Inc", ""), ("Data Analyst", "2015 to present"),
    ]
    assert s.education[0].degree == "Bachelor of Science, State" and s.education[0].institution == "University 2014"
    assert s.education[0].year == "2014"
    assert row.result.metadata.confidence_score == 1.0 and row.result.warnings == []


def test_capital_headers_count_without_bold(spark):
    row = styled(spark, "X\nEDUCATION\nBSc, Ocean College 1999", "^never$")
    assert row.result.sections.education[0].institution == "College 1999"


def test_carry_forward_does_not_depend_on_chunks(spark):
    rows = [(1, i, "h%d" % i if i % 37 == 5 else None) for i in range(400)] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, h string")
    small = carry_forward(df, F.col("h"), "s", chunk=7).select("doc_id", "line_no", "s", "_last").collect()
    whole = carry_forward(df, F.col("h"), "s", chunk=10_000).select("doc_id", "line_no", "s", "_last").collect()
    assert sorted(small) == sorted(whole)
    assert {(r.line_no, r.s) for r in small if r.doc_id == 1 and r.line_no in (4, 5, 41, 42)} == {(4, None), (5, "h5"), (41, "h5"), (42, "h42")}


def test_section_lines_are_lines(spark):
    df = spark.createDataFrame([(1, RESUME)], "doc_id int, text string")
    lines = D.line_rows(df)
    content = section_lines(lines)
    assert content.join(lines, ["doc_id", "line_no", "line"], "left_anti").count() == 0
    assert content.where("line = 'the end'").count() == 0


def test_routing_and_job_rows(spark):
    df = spark.createDataFrame(
        [(1, "pdf", RESUME), (2, "docx", RESUME), (3, "txt", RESUME), (4, "jpg", "x"), (5, None, "x")],
        "doc_id int, file_type string, text string",
    ).withColumn("paragraphs", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(False).alias("is_bold"))))
    rows = {r.doc_id: r for r in parse.parse_documents(df).collect()}
    assert {k: r.status for k, r in rows.items()} == {1: "completed", 2: "completed", 3: "completed", 4: "failed", 5: "failed"}
    assert rows[4].error == "Unsupported file type: jpg" and rows[4].result is None
    assert rows[2].result.extraction_method == "docx_deterministic"


def test_profile_keeps_links_durations_and_string_achievements(spark):
    df = spark.createDataFrame([(1, RESUME)], "doc_id int, text string")
    p = P.with_profiles(parse.parse_plain(df), F.lit("/up/cv.pdf"), F.lit("2024-01-01").cast("timestamp")).first().profile
    assert p.source_file == "cv.pdf" and p.metadata.file_type == "pdf"
    assert p.contact.github == "https://github.com/jane" and p.contact.website == "www.jane.dev"
    assert p.experience[0].dates.raw_date_text == "2019 - 2022" and p.education[0].dates.raw_date_text == "2014"
    assert p.achievements[0].title == "Best person award"


def test_profile_schema_matches_its_ddl(spark):
    df = spark.createDataFrame([(1, RESUME)], "doc_id int, text string")
    at = F.lit("2024-01-01").cast("timestamp")
    built = P.with_profiles(parse.parse_plain(df), F.lit("a"), at)
    want = spark.createDataFrame([], P.PROFILE_COLUMNS_DDL)
    assert [(f.name, f.dataType.simpleString()) for f in built.schema["profile"].dataType.fields] == [
        (f.name, f.dataType.simpleString()) for f in want.schema.fields
    ]


def test_grouped_skill_count(spark):
    c = F.create_map(F.lit("a"), F.array(F.lit("x"), F.lit("y")), F.lit("b"), F.array(F.lit("z")))
    assert spark.range(1).select(parse.grouped_skill_count(c)).first()[0] == 3


def test_nothing_is_cut_without_limits(spark):
    jobs = "\n\n".join(f"Engineer number {i} at Foo Inc\n2001 - 2002" for i in range(14))
    text = f"Experience\n{jobs}\nSkills\n{', '.join(f'lang{i}' for i in range(30))}\nAwards\n- Best person award\nthe end"
    full, cut = plain(spark, text, KEEP_ALL).sections, plain(spark, text).sections
    assert len(full.experience) == 14 and len(cut.experience) == 10
    assert len(full.skills) == 30 and len(cut.skills) == 20
    assert full.achievements == ["Best person award", "the end"] and cut.achievements == ["Best person award"]


def test_sections_that_are_not_read_are_not_worked_out(spark):
    docs = spark.createDataFrame([(1, "Ana\nmail a@b.org http://x.org\nSkills\nSQL, Go\n\nEducation\nPhD Physics\nthesis")], "id int, text string")
    parsed = parse.parse_plain(docs, boundary="ascii")
    few = parsed.select(F.size("result.sections.skills").alias("skills"), F.size("result.sections.education").alias("schools"))
    assert tuple(few.first()) == (2, 1)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "http" not in plan  # the links of the contact
    whole = parsed.first().result
    assert (whole.sections.contact.email, whole.sections.contact.urls) == ("a@b.org", ["http://x.org"])


def test_parser_json_is_read_once_per_object(spark):
    """One pass over the fields of an object, also where fields or items are of another type."""
    text = (
        '{"file_path": "/a/b.pdf", "sections": {"contact": {}, "experience": [{"title": "T", "dates": {"start": "2020-1"}}, "x", null, 3], '
        '"skills": ["SQL", 7, {"name": "", "years_experience": "3"}, null, {"name": "Go", "aliases": "no"}], "achievements": ["", {"name": "B"}, {}, true], "summary": "s"}}'
    )
    df = spark.createDataFrame([(text,), ("5",), ("{",)], "j string")
    made = df.select(P.profile_of_json(F.col("j"), F.lit("2024-01-01").cast("timestamp")).alias("p"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("variant_get(") < 25
    p, other, broken = (r.p for r in made.collect())
    assert broken is None and other.source_file == "unknown.docx" and other.skills == []
    assert [(x.position, x.dates.start_date) for x in p.experience] == [("T", "2020-01-01")]
    assert [(x.name, x.years_experience) for x in p.skills] == [("SQL", None), ('{"name":"","years_experience":"3"}', 3), ("Go", None)]
    assert [x.title for x in p.achievements] == ["", "B", "Achievement"]
    assert p.contact.email is None and p.contact.social_profiles == {} and p.summary.text == "s" and p.metadata.file_type == "pdf"
