import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import vectors as V


def brute(q, qids, b, bids, k, exclude_self=False):
    out = {}
    for i, qi in enumerate(qids):
        d = ((b - q[i]) ** 2).sum(1)
        if exclude_self:
            d = np.where(bids == qi, np.inf, d)
        order = np.lexsort((bids, np.round(d, 6)))
        order = [j for j in order if np.isfinite(d[j])][:k]
        out[qi] = [int(bids[j]) for j in order]
    return out


def frame(spark, ids, X, idc="id"):
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)],
                                 f"{idc} long, vec array<float>")


@pytest.mark.parametrize("q_block,b_block,method", [(1024, 16384, "scan"), (1024, 16384, "blocks"),
                                                    (7, 13, "blocks")])
def test_knn_exact_matches_brute_force_over_many_blocks(spark, q_block, b_block, method):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 8)).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    ids = np.arange(1000, 1120)
    base = frame(spark, ids, X)
    qs = frame(spark, ids[:30], X[:30], "query_id")
    got = V.knn_exact(qs, base.repartition(5), k=5, q_block=q_block, b_block=b_block, exclude_self=True,
                      method=method).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.id)
    want = brute(X[:30].astype(np.float64), ids[:30], X.astype(np.float64), ids, 5, True)
    assert res == want


def test_small_base_equals_exact(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(60, 4)).astype(np.float32)
    C = rng.normal(size=(5, 4)).astype(np.float32)
    qs = frame(spark, np.arange(60), X, "query_id")
    cent = frame(spark, np.arange(5), C)
    a = sorted(tuple(r) for r in V.knn_small_base(qs, cent, 3).collect())
    b = sorted(tuple(r) for r in V.knn_exact(qs, cent, 3, method="blocks").collect())
    assert a == b


def test_fewer_vectors_than_k_and_duplicate_ties(spark):
    X = np.array([[1, 0], [1, 0], [0, 1]], dtype=np.float32)
    base = frame(spark, [5, 3, 9], X)
    qs = frame(spark, [1], np.array([[1, 0]], dtype=np.float32), "query_id")
    got = [(r.rank, r.id) for r in V.knn_exact(qs, base, k=10).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 5), (3, 9)]  # tie at distance 0 -> smaller id first


def test_valid_hits_keep_first_chunk(spark):
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, -1), (1, 3, 2)], "query_id long, rank int, id long")
    ct = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    assert sorted(r.id for r in V.valid_hits(hits, ct).collect()) == [1, 2]


def _clustered(n=300, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(10, dim))
    X = centers[rng.integers(0, 10, n)] + 0.05 * rng.normal(size=(n, dim))
    return (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)


def test_ivf_and_lsh_recall_on_clustered_vectors(spark):
    X = _clustered()
    ids = np.arange(len(X))
    base = frame(spark, ids, X)
    qs = base.select(F.col("id").alias("query_id"), "vec")
    exact = V.knn_exact(qs, base, k=10, exclude_self=True)
    cent, _ = V.ivf_train(base, nlist=10)
    assigned = V.ivf_assign(base, cent)
    ivf = V.ivf_search(qs, assigned, cent, k=10, nprobe=3, exclude_self=True)
    lsh, stats = V.lsh_search(qs, base, k=10, exclude_self=True)
    for approx in (ivf, lsh):
        rec = V.ann_recall(approx, exact, stats, len(X), 10).agg(F.avg("recall")).first()[0]
        assert rec >= 0.9
        assert approx.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_hot_ivf_list_is_split(spark):
    """A list with most of the vectors is cut into salted sub-blocks; the
    result is the same as with one block."""
    X = _clustered(200, 8, 4)
    base = frame(spark, np.arange(200), X)
    qs = base.select(F.col("id").alias("query_id"), "vec").limit(20)
    cent, _ = V.ivf_train(base, nlist=4)
    assigned = V.ivf_assign(base, cent)
    a = sorted(V.ivf_search(qs, assigned, cent, k=5, nprobe=2).collect())
    b = sorted(V.ivf_search(qs, assigned, cent, k=5, nprobe=2, max_block=7).collect())
    assert a == b


def test_embedding_is_unit_or_zero(spark):
    idx = spark.createDataFrame([("fence", 1, 2, 3), ("gate", 1, 1, 1), ("wall", 2, 1, 5)],
                                "term string, chunk_id long, tf long, df long")
    vecs = V.embed_corpus(idx, F.lit(10.0), dim=16).collect()
    for r in vecs:
        assert abs(np.linalg.norm(np.array(r.vec, dtype=np.float64)) - 1) < 1e-5


def test_stored_ivf_index_equals_in_memory_search(spark):
    from docsift.session import scratch_path
    X = _clustered(240, 8, 6)
    base = frame(spark, np.arange(240), X)
    qs = base.select(F.col("id").alias("query_id"), "vec").limit(30)
    ivf = V.ivf_build(base, scratch_path(spark, "t-ivf"), nlist=12, max_block=9)
    a = sorted(tuple(r) for r in V.ivf_query(qs, ivf, k=5, nprobe=2).collect())
    assigned = V.ivf_assign(base, ivf.centroids)
    b = sorted(tuple(r) for r in V.ivf_search(qs, assigned, ivf.centroids, k=5, nprobe=2).collect())
    assert a == b


def test_bounded_kernels_give_same_answers(spark, monkeypatch):
    """Tiny pair/matrix budgets force the sliced and big-key paths; the
    answers must not change."""
    X = _clustered(200, 8, 8)
    base = frame(spark, np.arange(200), X)
    qs = base.select(F.col("id").alias("query_id"), "vec")
    cent, _ = V.ivf_train(base, nlist=3)
    assigned = V.ivf_assign(base, cent)
    ref_ivf = sorted(tuple(r) for r in V.ivf_search(qs, assigned, cent, k=5, nprobe=2).collect())
    ref_knn = sorted(tuple(r) for r in V.knn_exact(qs, base, k=5, method="scan").collect())
    monkeypatch.setattr(V, "PAIR_BATCH", 50)
    monkeypatch.setattr(V, "MAX_DIST_ELEMS", 64)
    assert sorted(tuple(r) for r in V.ivf_search(qs, assigned, cent, k=5, nprobe=2).collect()) == ref_ivf
    assert sorted(tuple(r) for r in V.knn_exact(qs, base, k=5, method="scan").collect()) == ref_knn


def test_matched_kernel_big_key_path_is_exact(monkeypatch):
    import pandas as pd
    rng = np.random.default_rng(0)
    Q, B = rng.normal(size=(40, 6)), rng.normal(size=(90, 6))
    qp = pd.DataFrame({"list_id": rng.integers(0, 3, 40), "salt": 0, "query_id": np.arange(40), "qvec": list(Q)})
    bp = pd.DataFrame({"list_id": rng.integers(0, 3, 90), "salt": 0, "id": np.arange(1000, 1090), "bvec": list(B)})
    cols = ["query_id", "id"]
    ref = V._matched_topk_kernel(5, False, ["list_id", "salt"])(qp, bp).sort_values(cols).reset_index(drop=True)
    monkeypatch.setattr(V, "PAIR_BATCH", 10)
    monkeypatch.setattr(V, "MAX_DIST_ELEMS", 16)
    got = V._matched_topk_kernel(5, False, ["list_id", "salt"])(qp, bp).sort_values(cols).reset_index(drop=True)
    assert ref[cols].equals(got[cols]) and np.allclose(ref["dist"], got["dist"])


def test_more_centroids_than_a_broadcast_takes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    base = spark.createDataFrame(data + [(3, data[50][1])], "id long, vec array<double>")  # an id on two vectors
    qs = spark.createDataFrame(data[:30], "query_id long, vec array<double>")
    cent = V.seeded_centroids(base.filter("id <> 3"), 2)
    want = sorted((r.id, r.list_id) for r in V.ivf_assign(base, cent).collect())
    hits = lambda: sorted(tuple(r) for r in V.ivf_search(qs, V.ivf_assign(base.filter("id <> 3"), cent), cent, k=5, nprobe=4).collect())
    found = hits()
    monkeypatch.setattr(V, "MAX_CENTROIDS", 16)
    assert sorted((r.id, r.list_id) for r in V.ivf_assign(base, cent).collect()) == want
    assert hits() == found
