import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from vitaframe.functions import crypto
from vitaframe.queries import QUERIES, base
from vitaframe.sources import documents as D
from vitaframe.sources import files as S
from vitaframe.sources import tables as T


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_ingest_store_and_record(spark, tmp_path):
    for name, data in {"a.pdf": b"one", "b.docx": b"two", "c.exe": b"x", "empty.pdf": b""}.items():
        put(tmp_path / "in" / name, data)
    listing = S.list_files(spark, str(tmp_path / "in"))
    refused = {r.file_name: len(r.errors) for r in S.refused_uploads(listing).collect()}
    assert refused == {"c.exe": 1}  # Spark's listing leaves empty files out
    at = F.lit("2024-02-29 10:00:00").cast("timestamp")
    accepted = S.accepted_uploads(listing, "run1", at, "admin")
    rows = {r.file_name: r for r in accepted.collect()}
    assert set(rows) == {"a.pdf", "b.docx"}
    assert rows["a.pdf"].file_path == "original/2024/02/run1/a.pdf" and rows["a.pdf"].mime_type == "application/pdf"
    assert [r.id for r in accepted.orderBy("id").collect()] == sorted(r.id for r in rows.values())  # stable ids

    key = F.unhex(F.sha2(F.lit("k"), 256))
    S.store_content(accepted, str(tmp_path / "store"), key)
    assert os.path.isdir(tmp_path / "store" / "original" / "year=2024" / "month=02")
    stored = spark.read.parquet(str(tmp_path / "store" / "original"))
    back = stored.select("file_name", crypto.decrypt_or_plain(F.col("content"), key).cast("string").alias("c"))
    assert dict(map(tuple, back.collect())) == {"a.pdf": "one", "b.docx": "two"}

    owner = spark.createDataFrame([("admin", "admin@x.local")], "id string, email string")
    for run in ("run1", "run2"):
        S.record_uploads(spark, S.accepted_uploads(listing, run, at, "admin"), str(tmp_path / "cat"), owner)
    read = lambda t: spark.read.parquet(str(tmp_path / "cat" / t))
    assert (read("artifacts").count(), read("resumes").count(), read("users").count()) == (4, 4, 1)
    linked = read("resumes").select(F.col("id").alias("resume_id")).join(read("artifacts"), "resume_id")
    assert linked.count() == 4


def test_a_run_may_be_repeated_or_end_between_two_tables(spark, tmp_path, monkeypatch):
    for name, data in {"a.pdf": b"one", "b.docx": b"two"}.items():
        put(tmp_path / "in" / name, data)
    listing = S.list_files(spark, str(tmp_path / "in"))
    owner = spark.createDataFrame([("admin", "admin@x.local")], "id string, email string")
    root = str(tmp_path / "cat")
    names = ("artifacts", "resumes", "users")
    rows = lambda: {t: sorted(map(str, S.catalog_table(spark, root, t).collect())) for t in names}

    def run(day):
        at = S.started_at(spark, root, "r1", F.lit(f"2024-02-{day} 10:00:00").cast("timestamp"))
        accepted = S.accepted_uploads(listing, "r1", at, "admin")
        S.store_content(accepted, root)
        S.record_uploads(spark, accepted, root, owner)

    whole = S.replace_runs

    def ends_early(frame, path, *by):
        if path.endswith("/users"):
            raise OSError("the driver is lost")
        whole(frame, path, *by)

    monkeypatch.setattr(S, "replace_runs", ends_early)
    with pytest.raises(OSError):
        run(10)
    assert S.read_or_none(spark, f"{root}/runs") is None  # nothing to be seen yet
    monkeypatch.setattr(S, "replace_runs", whole)
    run(11)
    first = rows()
    assert [len(first[t]) for t in names] == [2, 2, 1] and all("10, 10, 0" in r for r in first["artifacts"])
    run(29)
    assert rows() == first and spark.read.parquet(f"{root}/original").count() == 2
    other = S.accepted_uploads(listing, "r2", F.lit("2024-03-01").cast("timestamp"), "admin")
    S.record_uploads(spark, other, root, owner)
    assert [len(v) for v in rows().values()] == [4, 4, 1]
    S.record_uploads(spark, other.limit(0), root, owner)
    assert [len(v) for v in rows().values()] == [4, 4, 1]


def test_event_batches_are_recorded_once(spark, tmp_path):
    from vitaframe.streaming import jobs as J

    events = spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01' AS ts, 'parse_success' AS metric_type, 1.0D AS value")
    for batch in (0, 1, 1, 0):
        J.append_event_batch(events, str(tmp_path / "in"), batch)
    J.run_to_parquet(J.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    J.append_event_batch(events, str(tmp_path / "in"), 1)
    J.run_to_parquet(J.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_newest_paths(spark):
    listing = spark.createDataFrame([("a/r1/x", 1), ("a/r2/x", 5), ("a/r3/x", 5), ("a/r9/y/x", 9), ("b", 1)], "path string, modificationTime int")
    asked = spark.createDataFrame([("a/[RUN_ID]/x",), ("[RUN_ID]/r1/x",), ("a/r1/x",), ("a/[RUN_ID]",), (None,), ("[RUN_ID]",)], "path string")
    got = {r.path: r.found for r in S.newest_paths(asked, listing).collect()}
    assert got == {"a/[RUN_ID]/x": "a/r3/x", "[RUN_ID]/r1/x": "a/r1/x", "a/r1/x": "a/r1/x", "a/[RUN_ID]": None, None: None, "[RUN_ID]": "b"}


def test_manifests_as_text(spark):
    good = json.dumps({"fixtures": [{"id": "a", "filename": "a.pdf"}, {"id": "b"}], "more": 1})
    df = spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, "{}"), (5, '{"fixtures": []}'), (6, "[1]")], "n int, m string")
    got = sorted(((r.n, r.fixture and r.fixture.id, r.read_error) for r in T.manifests(df, "m").collect()), key=str)
    assert got[:5] == [(1, "a", None), (1, "b", None), (2, None, "Invalid JSON"), (3, None, "Invalid JSON"), (4, None, "No fixtures")]
    assert got[5] == (5, None, None)


def test_placeholder_finds_the_newest(spark, tmp_path):
    put(tmp_path / "r1" / "cv.pdf", b"1")
    time.sleep(1.1)
    put(tmp_path / "r2" / "cv.pdf", b"2")
    found = S.resolve_placeholder(spark, f"{tmp_path}/[RUN_ID]/cv.pdf").first().path
    assert found.endswith("/r2/cv.pdf")


def test_manifest(spark, tmp_path):
    doc = {"fixtures": [{"id": "a", "filename": "a.pdf", "expected_sections": {"skills": True}, "test_tags": ["t"], "parsing_expectations": {"success_rate": 95}}]}
    put(tmp_path / "m.json", json.dumps(doc, indent=1).encode())
    row = T.fixtures(spark, str(tmp_path / "m.json")).first()
    assert row.expected_sections == {"skills": True} and row.parsing_expectations.success_rate == 95


def test_profiles_round_trip_through_json(spark, tmp_path):
    text = '{"schema_version":"1.0.0","source_file":"a.pdf","experience":[{"company":"C"}],"generated_at":"2024-01-01T00:00:00"}'
    df = T.profiles_from_json(spark.createDataFrame([(text,), ("{oops",)], "j string"), "j")
    assert sorted(str(r.read_error) for r in df.collect()) == ["Invalid JSON", "None"]
    loose = '{"source_file": "cv.pdf", "experience": "none", "summary": {"text": "t"}}'
    odd = T.profiles_from_json(spark.createDataFrame([(loose,), (None,)], "j string"), "j").collect()
    assert odd[0].read_error == "Field of another type" and odd[1].read_error == "Invalid JSON" and odd[1].profile is None
    assert odd[0].profile.source_file == "cv.pdf" and odd[0].profile.experience is None and odd[0].profile.summary.text == "t"
    T.write_profiles(df.where("read_error IS NULL"), str(tmp_path / "p"))
    line = json.loads(spark.read.text(str(tmp_path / "p")).first().value)
    assert line["experience"][0]["company"] == "C" and line["generated_at"] == "2024-01-01T00:00:00.000000"


def test_pages_and_fallback(spark):
    rows = [(1, 2, "b", "B"), (1, 1, "a", "A"), (1, 3, "", "C"), (2, 1, " ", "x"), (2, 2, None, "y"), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, primary string, fallback string")
    got = {r.doc_id: (r.text, r.used_fallback) for r in D.assemble_pages(df).collect()}
    assert got == {1: ("a\n\nb", False), 2: ("x\n\ny", True), 3: ("", True)}


def test_runs_to_paragraphs_to_documents(spark):
    runs = spark.createDataFrame(
        [(1, 0, 1, "b", None, 12), (1, 0, 0, "a", False, None), (1, 1, 0, "Skills", True, None)],
        "doc_id int, idx int, run_no int, text string, bold boolean, size int",
    )
    paragraphs = D.paragraphs_of_runs(runs)
    got = {r.idx: (r.text, r.is_bold, r.font_size, r.runs) for r in paragraphs.collect()}
    assert got == {0: ("ab", False, 12, ["a", "b"]), 1: ("Skills", True, None, ["Skills"])}
    docs = D.documents_of_paragraphs(paragraphs.withColumn("style", F.lit(None).cast("string")))
    assert [p.text for p in docs.first().paragraphs] == ["ab", "Skills"]


def test_small_input_is_spread_and_large_is_not(spark, data, monkeypatch):
    df = T.table(spark, data, "documents")
    assert T.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(T, "_BYTES_PER_CORE", 1)
    assert "Exchange" not in T.spread_small(df)._jdf.queryExecution().executedPlan().toString()


def test_encryption_key_comes_from_the_session(spark):
    spark.conf.set("spark.vitaframe.encryption.key", "s3cret")
    key = crypto.key_from_conf(spark)
    df = spark.createDataFrame([("x",), (None,)], "t string")
    check = crypto.round_trip_check(df, "t", key).first()
    assert check.healthy and check.values_checked == 1
    sealed = df.select(crypto.encrypt(F.col("t"), key).alias("c"))
    sealed.collect()
    plan = sealed._jdf.queryExecution().toString().lower()
    derived = hashlib.sha256(b"s3cret").digest()
    assert "s3cret" not in plan and derived.hex() not in plan and str(list(derived))[1:40] not in plan


def test_resumes_of_large_tables_come_in_tasks_of_bounded_size(spark, data, monkeypatch):
    """A large table is not left in whole splits or row groups, where parsing makes tasks of hours."""
    monkeypatch.setattr(T, "_BYTES_PER_CORE", 1)
    assert "Exchange" in base.resumes(spark, data)._jdf.queryExecution().executedPlan().toString()
    df = T.table(spark, data, "documents").select("doc_id", "text")
    wide = T.spread(df, task_bytes=1000)
    assert wide.rdd.getNumPartitions() > 3 * spark.sparkContext.defaultParallelism
    assert wide.exceptAll(df).isEmpty() and wide.count() == df.count()


@pytest.mark.parametrize("name", ["paragraphs_from_runs", "documents_from_pages"])
def test_rows_made_of_a_text_are_grouped_where_they_lie(spark, data, name):
    """Texts are shuffled once, by document; their words and lines are not."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(doc_id" in plan
