import json

import pytest
from pyspark.sql import functions as F

from vitaframe.operators import validate as V

OK = {
    "schema_version": "1.0.0", "extraction_method": "x", "source_file": "a.pdf",
    "metadata": {"extractor_version": "1", "extraction_timestamp": "2031-03-02T11:40:07.250Z", "confidence_score": 0.61},
}
FULL = {
    **OK,
    "generated_at": "2031-03-02T11:40:07.250Z",
    "contact": {"full_name": "Mira Quill", "email": "m.quill@mail.example", "phone": "+44 20 7946 0018", "social_profiles": {"x": "y"}},
    "summary": {"text": "Engineer", "keywords": ["a", "b"]},
    "experience": [{"company": "C", "position": "P", "dates": {"start_date": "2022-01-01", "end_date": "later", "is_current": False}, "technologies": ["Python"]}],
    "skills": [{"name": "Python", "category": "programming", "years_experience": 3}],
    "additional_sections": {"hobbies": ["age"]},
}


def check(spark, profile, strict=True):
    text = profile if isinstance(profile, str) else json.dumps(profile)
    return V.validate(spark.createDataFrame([(text,)], "j string"), "j", strict).first()


def test_valid_profiles(spark):
    for p in (OK, FULL):
        r = check(spark, p)
        assert r.is_valid and r.errors == [] and r.schema_version == "1.0.0"


@pytest.mark.parametrize(
    "change, error",
    [
        ({"contact": {"email": "bad"}}, "Field 'contact -> email': Value error, Invalid email format"),
        ({"contact": {"social_profiles": {"x": 1}}}, "Field 'contact -> social_profiles -> x': Input should be a valid string"),
        ({"source_file": None}, "Field 'source_file': Input should be a valid string"),
        ({"education": [{"gpa": "x" * 21}]}, "Field 'education -> 0 -> gpa': String should have at most 20 characters"),
        ({"summary": {"keywords": ["a", 3]}}, "Field 'summary -> keywords -> 1': Input should be a valid string"),
        ({"metadata": {**OK["metadata"], "confidence_score": "high"}}, "Field 'metadata -> confidence_score': Input should be a valid number"),
        ({"generated_at": "yesterday-ish"}, "Field 'generated_at': Input should be a valid datetime"),
        ({"skills": None}, "Field 'skills': Input should be a valid list"),
    ],
)
def test_single_errors(spark, change, error):
    r = check(spark, {**OK, **change})
    assert not r.is_valid and r.errors == [error]


def test_versions(spark):
    assert check(spark, {**OK, "schema_version": "2.0.0"}).errors == ["Incompatible schema version: 2.0.0 (current: 1.0.0)"]
    assert check(spark, {**OK, "schema_version": "1.0"}).warnings == ["Migrated schema from 1.0 to 1.0.0"]
    lenient = check(spark, {**OK, "schema_version": "2.0.0"}, strict=False)
    assert lenient.is_valid and lenient.warnings == ["Incompatible schema version: 2.0.0 (current: 1.0.0)"]


def test_lenient_drops_only_top_level_fields(spark):
    assert check(spark, {**OK, "experience": "none"}, False).is_valid
    assert not check(spark, {**OK, "experience": ["none"]}, False).is_valid
    assert not check(spark, {k: v for k, v in OK.items() if k != "metadata"}, False).is_valid


def test_unreadable_json(spark):
    assert check(spark, "{bad").errors == ["Invalid JSON"]
    assert check(spark, "[1]").errors == ["Invalid JSON"]


def test_prohibited_keys_at_any_depth(spark):
    deep = {"Age": 1}
    for i in range(40):
        deep = {f"l{i}": deep}
    rows = [(1, json.dumps(deep)), (2, json.dumps({"l": [{"age": 1}], "t": '{"age": 1}', "wage": 1})), (3, None), (4, "nonsense")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = V.prohibited_paths(df, "j", "id").collect()
    assert [r.id for r in got] == [1] and got[0].path.endswith(".l0.Age") and got[0].path.count(".") == 41


def test_disallowed_contact_keys(spark):
    c = F.lit('{"email": 1, "age": 2}')
    assert spark.range(1).select(V.disallowed_contact_keys(c)).first()[0] == ["age"]


# ------------------------------------------------------------------ every rule broken once


def broken(rule, typed=False):
    """Values that break a rule, and what is said of them."""
    if isinstance(rule, V.Leaf) and rule.kind == "string_map":
        return [({"k": None if typed else 1}, " -> k", V.MESSAGES["string"])]
    if isinstance(rule, V.Leaf):
        out = [] if typed else [({"int": 1.5, "bool": "maybe"}.get(rule.kind, [1]), "", V.MESSAGES["category" if rule.check == "category" else rule.kind])]
        if rule.longest:
            text = "a@b." + "c" * rule.longest if rule.check == "email" else "1" * (rule.longest + 1)
            out.append((text, "", f"String should have at most {rule.longest} characters"))
        if rule.check:
            out.append(("neither of them", "", V.MESSAGES[rule.check]))
        return out
    if isinstance(rule, V.Strings):
        return [(["a", None if typed else 2], " -> 1", V.MESSAGES["string"])]
    return []


def cases(model, typed=False, where=(), prefix=""):
    """``(path of keys and indexes, value, error)`` for every field of a model."""
    for name, rule in model.fields.items():
        if name == "schema_version":
            continue
        path = f"{prefix}{name}"
        for value, more, text in broken(rule, typed):
            yield (*where, name), value, f"Field '{path}{more}': {text}"
        if rule.required:
            yield (*where, name), "absent", f"Field '{path}': {V.MESSAGES['missing']}"
        if not typed and not rule.nullable:
            yield (*where, name), None, f"Field '{path}': {V._null_message(rule)}"
        if isinstance(rule, V.Model):
            yield from cases(rule, typed, (*where, name), f"{path} -> ")
        if isinstance(rule, V.Models):
            yield from cases(rule.item, typed, (*where, name, 0), f"{path} -> 0 -> ")


def with_value(profile, where, value):
    """The profile with one value set (or left out), and what the way there needs."""
    out = json.loads(json.dumps(profile))
    at, rules = out, V.PROFILE_RULES
    for step in where[:-1]:
        if step == 0:
            if not at:
                at.append({n: "x" for n, r in rules.fields.items() if r.required})
            at = at[0]
            continue
        rule = rules.fields[step]
        rules = rule.item if isinstance(rule, V.Models) else rule
        at = at.setdefault(step, [] if isinstance(rule, V.Models) else {})
    if value == "absent":
        at.pop(where[-1], None)
    else:
        at[where[-1]] = value
    return out


def test_every_rule_of_json_profiles(spark):
    every = list(cases(V.PROFILE_RULES))
    assert len(every) > 100
    rows = [(i, json.dumps(with_value(OK, where, value))) for i, (where, value, _) in enumerate(every)]
    got = {r.i: r.errors for r in V.validate(spark.createDataFrame(rows, "i int, j string"), "j").select("i", "errors").collect()}
    assert [(every[i][0], got[i]) for i in range(len(every)) if every[i][2] not in got[i] or len(got[i]) > 2] == []
    exact = [i for i in range(len(every)) if got[i] == [every[i][2]]]
    assert len(exact) > 0.9 * len(every)  # a text can break a length and a format at once


def test_every_rule_of_typed_profiles(spark):
    from vitaframe.sources.tables import profiles_from_json

    every = list(cases(V.PROFILE_RULES, typed=True))
    assert len(every) > 60
    rows = [(i, json.dumps(with_value(OK, where, value))) for i, (where, value, _) in enumerate(every)]
    rows += [(-1, json.dumps(FULL)), (-2, json.dumps(OK)), (-3, "{bad")]
    typed = profiles_from_json(spark.createDataFrame(rows, "i int, j string"), "j")
    got = {r.i: r.errors for r in V.validate_profiles(typed).select("i", "errors").collect()}
    assert got[-1] == got[-2] == [] and got[-3] == ["Invalid JSON"]
    assert [(every[i][0], got[i]) for i in range(len(every)) if every[i][2] not in got[i] or len(got[i]) > 2] == []


def test_cleaned_profiles(spark):
    from vitaframe.sources.tables import profiles_from_json

    rows = [
        (1, {**FULL, "experience": "none", "unknown": 1, "schema_version": "1.0"}),
        (2, {**OK, "skills": None, "summary": {"text": "T"}}),
        (3, {**OK, "contact": {"email": "bad"}}),
        (4, {k: v for k, v in OK.items() if k != "schema_version"}),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in rows] + [(5, "{bad")], "i int, j string")
    got = {r.i: r.cleaned and json.loads(r.cleaned) for r in V.clean(df, "j").collect()}
    assert got[1] == {k: v for k, v in FULL.items() if k != "experience"}
    assert got[2] == {**OK, "summary": {"text": "T"}} and got[4] == OK
    assert got[3] is None and got[5] is None
    strict = {r.i: r.cleaned for r in V.clean(df, "j", strict=True).collect()}
    assert strict[1] is None and json.loads(strict[4]) == OK
    typed = V.clean_profiles(profiles_from_json(df, "j").withColumn("profile", F.col("profile").withField("summary", F.when(F.col("i") == 2, F.col("profile.summary")))))
    rows = {r.i: r for r in typed.collect()}
    assert rows[1].profile.contact.email == "m.quill@mail.example" and rows[1].profile.schema_version == "1.0.0"
    assert rows[2].profile.summary.text == "T" and rows[4].profile.schema_version == "1.0.0"
    assert rows[3].profile is None and rows[5].profile is None
