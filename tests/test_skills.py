from pyspark.sql import functions as F

from vitaframe.operators import skills as K

CASES = {
    "React.js": ("React", "frameworks", 0.95),
    "Python 3": ("Python", "programming", 0.95),
    "Knowledge of SQL": ("SQL", "databases", 0.95),
    "K8s": ("Kubernetes", "cloud", 0.95),
    "AWS": ("Aws", "cloud", 0.7),
    "Spring Framework": ("Spring", "frameworks", 0.7),
    ".NET": ("Net", "other", 0.7),
    "Risk Management": ("Risk Management", "soft_skills", 0.7),
}


def frame(spark, raws):
    return spark.createDataFrame([(1, i, r) for i, r in enumerate(raws)], "doc_id int, pos int, raw string")


def test_known_cases(spark):
    dim = K.lookup_table(K.dictionary(spark))
    got = {r.raw: (r.canonical_name, r.category, r.confidence_score) for r in K.normalize_rows(frame(spark, CASES), dim).collect()}
    assert got == CASES


def test_keys_can_be_spellings(spark):
    dim = K.lookup_table(K.dictionary(spark, index_keys=True))
    assert K.normalize_rows(frame(spark, ["AWS"]), dim).first().canonical_name == "Amazon Web Services"


def test_array_form_equals_row_form(spark):
    raws = ["python", "Python 3", " ", "k8s", "Kube", "zebra", "Zebra 2", "SQL", "AWS"]
    dim = K.lookup_table(K.dictionary(spark))
    rows = K.normalize_lists_by_row(frame(spark, raws), dim).collect()
    want = sorted((r.category, r.canonical_name, r.raw) for r in rows)
    arr = spark.createDataFrame([(1, raws)], "doc_id int, r array<string>")
    got = K.normalize_lists(arr, dim, "r").first().skills
    assert [(s.category, s.canonical_name, s.name) for s in got] == want
    assert len(got) < len(raws)


def test_custom_aliases(spark):
    add = spark.createDataFrame(
        [(1, "python", "snake", "tools"), (2, "Foo Lang", "foo", "programming"), (3, "Bar", "snake", None), (4, "PYTHON", "Py", None)],
        "seq int, canonical_name string, alias string, category string",
    )
    spellings = K.add_custom_aliases(K.dictionary(spark), add)
    dim = {r.alias_lower: (r.canonical, r.category) for r in K.alias_rows(spellings).collect()}
    assert dim["snake"] == ("Bar", "other")  # the last addition wins the spelling
    assert dim["foo"] == dim["foo lang"] == ("Foo Lang", "programming")
    assert dim["py"] == ("Python", "programming")
    lists = {r.canonical: r.aliases for r in K.lookup_table(spellings).lists.select(F.col("_name").alias("canonical"), "aliases").collect()}
    assert lists["Python"] == ["python3", "py", "python 3", "python3.x", "snake"]


def test_suggestions(spark):
    terms = spark.createDataFrame([("ja",), ("sql",), ("x",)], "term string")
    out = K.suggest(terms, K.alias_rows(K.dictionary(spark))).orderBy("term", "rank").collect()
    assert [(r.term, r.canonical) for r in out] == [
        ("ja", "JavaScript"), ("ja", "Java"), ("ja", "Django"),
        ("sql", "SQLite"), ("sql", "SQL"), ("sql", "PostgreSQL"), ("sql", "MySQL"),
    ]


def test_small_dictionary_is_broadcast_and_a_large_one_is_not(spark):
    spellings = K.dictionary(spark)
    skills = spark.range(10).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit("K8s").alias("raw"))
    plan = lambda dim: K.normalize_rows(skills, dim)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(K.lookup_table(spellings)) and "SortMergeJoin" not in plan(K.lookup_table(spellings))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        assert "BroadcastHashJoin" not in plan(K.lookup_table(spellings))
        assert K.normalize_rows(skills, K.lookup_table(spellings)).first().canonical_name == "Kubernetes"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_lists_of_documents(spark):
    docs = [(1, ["K8s", " ", None, "python 3", "Python", "Knitting"]), (2, []), (3, ["sql"]), (4, None)]
    lists = spark.createDataFrame(docs, "doc_id int, r array<string>")
    got = {r.doc_id: [(s.canonical_name, s.name, s.category) for s in r.skills] for r in K.normalize_lists(lists, K.lookup_table(K.dictionary(spark)), "r").collect()}
    assert got == {
        1: [("Kubernetes", "K8s", "cloud"), ("Knitting", "Knitting", "other"), ("Python", "python 3", "programming")],
        2: [], 3: [("SQL", "sql", "databases")], 4: [],
    }


def test_a_million_aliases_of_one_name(spark):
    n = 1_000_000
    added = spark.range(n).select(F.col("id").alias("seq"), F.lit("Foo Lang").alias("canonical_name"), F.concat(F.lit("foo-"), F.col("id")).alias("alias"), F.lit("programming").alias("category"))
    dim = K.lookup_table(K.add_custom_aliases(K.dictionary(spark), added))
    raws = ["foo-7", "foo-999999", "K8s", "nothing known"]
    rows = {r.raw: r for r in K.normalize_rows(frame(spark, raws), dim).select("raw", "canonical_name", F.size("aliases").alias("n")).collect()}
    assert {k: (v.canonical_name, v.n) for k, v in rows.items()} == {
        "foo-7": ("Foo Lang", n), "foo-999999": ("Foo Lang", n), "K8s": ("Kubernetes", rows["K8s"].n), "nothing known": ("Nothing Known", 0)
    }
    kept = K.normalize_lists_by_row(frame(spark, raws), dim).select("canonical_name")
    assert sorted(r.canonical_name for r in kept.collect()) == ["Foo Lang", "Kubernetes", "Nothing Known"]
    lists = K.normalize_lists(spark.createDataFrame([(1, raws)], "doc_id int, r array<string>"), dim, "r")
    groups = lists.select(F.explode(K.by_category(F.col("skills"))).alias("g")).select("g.category", "g.skills").collect()
    assert {r.category: r.skills for r in groups} == {"cloud": ["Kubernetes"], "other": ["Nothing Known"], "programming": ["Foo Lang"]}
