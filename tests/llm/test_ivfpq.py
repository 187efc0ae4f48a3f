"""Recall against brute force, exact scores, ties and vectors that take no part."""
import numpy as np

from assayframe.llm import ivfpq


def exact(ids, x, q, k=20):
    s = (x * x[q]).sum(1)
    s[ids == ids[q]] = -np.inf
    top = np.lexsort((ids, -s))[:k]
    return ids[top], s[top]


def test_recall_on_whole_table(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    got = ivfpq.op2_ivf_pq_search(spark, d).toPandas()
    assert sorted(got["query_id"].unique()) == sorted(ids[ids % 20 == 0])
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        want, _ = exact(ids, x, int(np.flatnonzero(ids == q)[0]))
        hits += len(set(want) & set(g["vec_id"]))
        total += 20
        s = [(x[ids == v][0] * x[ids == q][0]).sum() for v in g["vec_id"]]
        assert np.allclose(g["score"], s, rtol=0, atol=1e-12)
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
    assert hits / total >= 0.9
    assert ivfpq.RERANK < 0.1 * len(ids)  # the quantiser chooses what is ranked exactly


def test_clustered_vectors_and_extra_columns(spark):
    """Tight clusters of unequal size: most queries' bars lie above or below their whole cluster."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16)) * 3
    x = (centers[np.minimum(29, rng.geometric(0.15, 4000) - 1)] + rng.normal(size=(4000, 16)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int, list string")
    v = ivfpq.valid_vectors(df, "vec_id", "embedding")
    assert v.schema["vec"].dataType.simpleString() == "array<float>"
    got = ivfpq.search(v, v.where("vec_id % 20 = 0"), sample_rows=800).toPandas()
    ids, x = np.arange(4000), x.astype(float)
    found = [len(set(exact(ids, x, q)[0]) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(found) == 200 and np.mean(found) >= 0.9 and got.groupby("query_id").size().eq(20).all()


def test_ties_and_invalid(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (180, [None, 1.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(a, b, 1.5, [2]) for a, b in rows], "vec_id long, embedding array<double>, score double, codes array<int>")
    v = ivfpq.valid_vectors(df, "vec_id", "embedding")
    assert v.count() == 30
    got = ivfpq.search(v, v.where("vec_id % 20 = 0")).toPandas()
    assert got[got["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == list(range(1, 21))
    assert got[got["query_id"] == 20].sort_values("rank")["vec_id"].tolist() == list(range(20))
    few = ivfpq.search(v.where("vec_id < 3"), v.where("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert ivfpq.search(v.limit(0), v.limit(0)).collect() == []


def test_hot_vector_is_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "BLOCK", 64)
    monkeypatch.setattr(ivfpq, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = ivfpq.search(v, v.where("vec_id % 20 = 0")).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = []
    for q, g in got.groupby("query_id"):
        want, score = exact(ids, x, int(np.flatnonzero(ids == q)[0]))
        found.append(np.mean(np.sort(g["score"])[::-1] >= score - 1e-9))
        if q < 300:
            assert g.sort_values("rank")["vec_id"].tolist() == want.tolist()
    assert np.mean(found) >= 0.9


def test_doubles_beyond_floats(spark):
    """Finite components above the range of a float take part and come in the order of their products."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * 1e150
    v = ivfpq.valid_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = ivfpq.search(v, v.where("vec_id % 20 = 0"), k=5).toPandas()
    assert len(got) == 15
    for q, g in got.groupby("query_id"):
        ids, score = exact(np.arange(60), x, q, 5)
        g = g.sort_values("rank")
        assert g["vec_id"].tolist() == ids.tolist() and np.allclose(g["score"], score, rtol=1e-12)


def test_recall_on_long_isotropic_vectors(spark):
    """Parts of 16 components each lose most of the order: the trials make up for it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 256))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vec array<float>")
    got = ivfpq.search(v, v.where("vec_id % 60 = 0")).toPandas()
    ids, x = np.arange(len(x)), x.astype(float)
    found = [len(set(exact(ids, x, q)[0]) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(found) == 100 and np.mean(found) >= 0.9
