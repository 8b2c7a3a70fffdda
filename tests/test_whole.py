"""Queries over whole tables, by brute force and against their SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sylvan.operators import evaluate
from sylvan.plans import catalogue


def test_the_stated_vectors_are_queries_over_all(spark, tmp_path):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(60, 8)).astype(np.float32)
    vectors[7] = vectors[3]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want = {(i, n, j) for i in range(0, 60, 20) for n, j in enumerate(sorted(range(60), key=lambda j: (-cosine[i, j], j))[:10], 1)}
    got = catalogue.QUERIES["embed_topk"](spark, str(tmp_path)).collect()
    assert {(x.query_id, x.rank, x.vec_id) for x in got} == want and len(got) == 30
    assert all(abs(x.cosine - cosine[x.query_id, x.vec_id]) < 2e-6 for x in got)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert set(con.execute(catalogue.ORACLE["embed_topk"]).fetchall()) == {(x.query_id, x.vec_id, x.cosine, x.rank) for x in got}
    every = evaluate.cosine_top(*(lambda v: (v, v.select(F.col("vec_id").alias("query_id"), "embedding")))(spark.read.parquet(f"{tmp_path}/embeddings.parquet")))
    assert every.count() == 600


def test_vectors_without_a_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    got = evaluate.cosine_top(v, v.select(F.col("vec_id").alias("query_id"), "embedding"), 4).collect()
    by = {i: [(x.vec_id, x.cosine) for x in sorted(got, key=lambda x: x.rank) if x.query_id == i] for i in (1, 2)}
    assert by == {1: [(1, 1.0), (4, 0.707107), (2, None), (3, None)], 2: [(1, None), (2, None), (3, None), (4, None)]}


def test_every_relevant_document_supports(spark, tmp_path):
    docs = [(i, "x", "en", "s" if i < 20 else "u", 100 - i) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good = {2, 5, 8, 12, 15, 20, 21, 22}
    spark.createDataFrame([(i, int(i in good), 0) for i in range(24)] + [(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.query_id: (r.sp_recall, r.covered) for r in catalogue.QUERIES["sp_recall"](spark, str(tmp_path)).collect()}
    assert got == {"s": (0.6, 0.0), "u": (1.0, 1.0)}


def test_every_pair_of_turns_is_scored(spark, tmp_path):
    texts = ["The cat sat", "a cat ran", "12 million dollars", "$12", "alone at last", "", "x y", "y x"]
    turns = [("a", i, x) for i, x in enumerate(texts)] + [("b", i, x) for i, x in enumerate(texts[:3])] + [("c", 0, "p"), ("c", 3, "q")]
    spark.createDataFrame(turns, "conv_id string, turn int, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.query_id, r.pair): (r.em, r.f1) for r in catalogue.QUERIES["qa_f1"](spark, str(tmp_path)).collect()}
    assert got == {("a", 0): (0.0, 0.5), ("a", 1): (1.0, 1.0), ("a", 2): (0.0, 0.0), ("a", 3): (0.0, 1.0), ("b", 0): (0.0, 0.5)}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    # a pair is two neighbouring turns, in SQL as in the plan
    assert {x[:2]: x[2:] for x in con.execute(catalogue.ORACLE["qa_f1"]).fetchall()} == got
