import numpy as np
from pyspark.sql import functions as F

from promptbook.llm.vector_neighbors import nearest


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 24))
    x = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.25, size=(3000, 24))
    df = spark.createDataFrame([(f"v{i:05d}", [float(t) for t in r]) for i, r in enumerate(x)], "i string, e array<float>")
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(df, "i", "e", 24, 5, 0.8, window=64).collect()}
    want = brute(x, 5, 0.8)
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_every_kind_of_bad_vector_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", None), ("d", [1.0]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", [0.0, 0.0]), (None, [1.0, 0.0]), ("h", [None, 1.0]), ("i", [1e30, 1e29])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "i string, e array<float>, key int, u string")
    got = {(r.id, r.neighbour) for r in nearest(df, "i", "e", 2, 5).collect()}
    assert got == {(p, q) for p in "abi" for q in "abi" if p != q}
    assert nearest(df.where("false"), "i", "e", 2).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(0)
    other = spark.createDataFrame([(f"o{i:03d}", [float(t) for t in v]) for i, v in enumerate(rng.normal(size=(200, 8)))], "i string, e array<float>")
    copies = spark.range(100).select(F.format_string("c%03d", "id").alias("i"), F.array(*[F.lit(float(t)).cast("float") for t in (1, 2, 3, 4, 5, 6, 7, 8)]).alias("e"))
    got = nearest(other.unionByName(copies), "i", "e", 8, 5, 0.99).where("id like 'c%'").groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()
    first = [f"c{i:03d}" for i in range(6)]
    assert len(got) == 100
    for r in got:
        assert r.n == [f for f in first if f != r.id][:5]


def test_a_third_of_all_rows_are_one_bundle_of_different_vectors(spark):
    rng = np.random.default_rng(4)
    n, third, dim = 6_000, 2_000, 24
    x = np.repeat(rng.normal(size=(n // 20, dim)), 20, axis=0) + rng.normal(scale=0.3, size=(n, dim))
    x[:third] = rng.normal(size=dim) + rng.normal(scale=0.05, size=(third, dim))
    place = rng.permutation(n)
    x = x[place].astype(np.float32)
    df = spark.createDataFrame([(f"v{i:05d}", r.tolist()) for i, r in enumerate(x)], "i string, e array<float>")
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(df, "i", "e", dim, 5, 0.85, window=16).collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    rows = np.flatnonzero(place < third)[:500]
    s = u[rows] @ u.T
    s[np.arange(len(rows)), rows] = -2
    want = {(int(i), int(j)) for i, r in zip(rows, s) for j in np.argsort(-r)[:5]}
    assert len(got & want) / len(want) > 0.8
