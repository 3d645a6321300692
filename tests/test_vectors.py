import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaframe.operators import vectors as E


@pytest.fixture(scope="module")
def embeddings(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


def brute(df, queries, k):
    rows = df.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], dtype="float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries.collect():
        v = np.array(q.embedding, dtype="float64")
        sims = np.round(m @ (v / np.linalg.norm(v)), E.DECIMALS)
        order = np.lexsort((ids, -sims))[:k]
        out[q.query_id] = [int(i) for i in ids[order]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_exact_equals_brute_force_in_batches(spark, embeddings, monkeypatch):
    queries = embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    want = brute(embeddings, queries, 4)
    assert found(E.nearest(embeddings, queries, 4)) == want
    monkeypatch.setattr(E, "QUESTIONS", 16)  # many blocks
    monkeypatch.setattr(E, "ROWS", 32)
    assert found(E.nearest(embeddings, queries, 4)) == want


def test_ties_zero_vectors_and_wrong_lengths(spark):
    rows = [(i, [1.0, 0.0]) for i in (5, 3, 9)] + [(1, [0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    assert found(E.nearest(df, q, 2)) == {0: [3, 5]}


def test_recall_never_falls_and_ends_at_one(spark, embeddings):
    queries = E.mean_vectors(embeddings, "label", "embedding").select(F.col("label").cast("long").alias("query_id"), "embedding")
    exact = E.nearest(embeddings, queries, 5).cache()
    index = E.InvertedLists.build(embeddings, lists=8)
    recalls = [E.recall(index.search(queries, 5, nprobe=n, exact=False), exact).first().recall for n in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_stored_index_gives_the_same(spark, embeddings, tmp_path):
    queries = embeddings.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    index = E.InvertedLists.build(embeddings, lists=4)
    index.write(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert found(index.search(queries, 3, 2, index=stored)) == found(index.search(queries, 3, 2))


def test_exact_through_lists(spark, embeddings, monkeypatch):
    monkeypatch.setattr(E, "QUESTIONS", 16)
    monkeypatch.setattr(E, "ROWS", 32)
    queries = embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = E.InvertedLists.build(embeddings, lists=8, train_rows_per_list=5)
    assert found(index.search(queries, 6, nprobe=1)) == brute(embeddings, queries, 6)
    effort = index.effort(queries, 6, nprobe=1).collect()
    assert len(effort) == queries.count() and all(1 <= r.opened <= r.lists <= 8 for r in effort)


def test_far_lists_stay_closed(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    rows = [(f"v{c}-{i}", (centres[c] + rng.normal(0, 0.01, 8)).tolist()) for c in range(8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", centres[3].tolist())], "query_id string, embedding array<double>")
    index = E.InvertedLists.build(df, lists=8)
    assert index.effort(queries, 5, nprobe=1).first().opened < 8
    assert found(index.search(queries, 5, nprobe=1)) == found(E.nearest(df, queries, 5))


def test_any_id_any_length_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(f"é{i}" if i % 2 else f"z{i}", rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(60)]
    odd = [("nan", [1.0, float("nan"), 0.0]), ("inf", [1.0, float("inf"), 0.0]), ("gap", [1.0, None, 0.0]), ("zero", [0.0] * 3), ("none", None), ("empty", [])]
    huge = [("huge", [1e200, 1e200, 0.0]), (None, [1e-200, 1e-200, 0.0])]
    df = spark.createDataFrame(rows + odd + huge, "vec_id string, embedding array<double>")
    asked = [(f"q{i}", rows[i][1]) for i in range(0, 60, 7)] + [("q", [1.0, 1.0, 0.0]), ("bad", [0.0] * 3), ("alone", [1.0] * 9), ("q0", rows[0][1])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    want = {}
    for name, v in asked:
        v = np.array(v)
        near = []
        for key, x in rows + huge:
            if len(x) == len(v) and v.any():
                x = np.array(x) / max(map(abs, x))
                near.append((-round(float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 6), key is None, key))
        want.setdefault(name, []).extend(key for _, _, key in sorted(near)[:4])
    want = {name: sorted(keys, key=str) for name, keys in want.items() if keys}
    got = found(E.nearest(df, queries, 4))
    assert {name: sorted(keys, key=str) for name, keys in got.items()} == want
    through = found(E.InvertedLists.build(df, lists=3).search(queries, 4, nprobe=1))
    assert {name: sorted(keys, key=str) for name, keys in through.items()} == want
    reasons = {(r.vec_id, r.reason) for r in E.refused(df, 3).collect()}
    assert {("nan", "not finite"), ("inf", "not finite"), ("gap", "null component"), ("zero", "zero"), ("none", "null"), ("empty", "length")} <= reasons


def test_most_rows_in_one_list(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS", 50)
    monkeypatch.setattr(E, "QUESTIONS", 4)
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(1000 + i, [0.0, 1.0 + i]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.001]) for i in range(30)], "query_id bigint, embedding array<double>")
    got = found(E.InvertedLists.build(df, lists=2).search(queries, 3, nprobe=1))
    assert got == {i: [0, 1, 2] for i in range(30)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0])], "query_id bigint, embedding array<double>")
    assert E.nearest(empty, queries).count() == 0 and E.InvertedLists.build(empty, lists=2).search(queries).count() == 0
    some = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")
    assert E.nearest(some, queries.limit(0)).count() == 0


def test_share_in_half_the_lists(spark, embeddings, data):
    from vitaframe.queries import QUERIES

    got = QUERIES["recall_of_half_the_lists"](spark, data).first()
    asked = embeddings.where("vec_id % 50 = 0").count()
    assert got.expected == asked * 5 and got.recall == round(got.found / got.expected, 4)


def test_similarities_are_held_in_tiles():
    """Neither vectors nor questions make the memory of a product grow; ties still go to the first."""
    made = np.random.default_rng(1)
    questions, vectors = made.integers(-2, 3, (E.STEP, 4)).astype(float), made.integers(-2, 3, (10 * E.TILE, 4)).astype(float)
    tracemalloc.start()
    sims, at = E._best(questions, vectors, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * E.STEP * E.TILE * 8
    whole = np.round(questions @ vectors.T, E.DECIMALS)
    order = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    assert (at == order).all() and (sims == np.take_along_axis(whole, order, 1)).all()
