import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import sweep
from docsift.operators import vectors as V


def frame(spark, ids, x, idc="id", kind="float"):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], f"{idc} long, vec array<{kind}>")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sweep, "PACK_ROWS", 20)
    monkeypatch.setattr(sweep, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(sweep, "TILE_ROWS", 16)
    monkeypatch.setattr(sweep, "TILE_QUERIES", 7)
    monkeypatch.setattr(sweep, "SMALL_PAIRS", 9)


def data():
    x = np.random.default_rng(4).normal(size=(150, 6))
    x[100:120] = x[:20]  # equal vectors
    ids = np.arange(150)
    ids[140:] = ids[:10]  # ids of two vectors
    return ids, x


@pytest.mark.parametrize("kind,scale", [("float", 1), ("double", 1000)])
def test_blocks_equal_a_scan_and_copy_neither_side(spark, small, kind, scale):
    ids, x = data()
    base = frame(spark, ids, x * scale, kind=kind).repartition(3)
    qs = base.select(F.col("id").alias("query_id"), "vec")
    got = V.knn_exact(qs, base, 5, exclude_self=True, method="blocks")
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate explode(sequence" not in plan
    key = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.dist, 4)) for r in d.collect())
    assert key(got) == key(V.knn_exact(qs, base, 5, exclude_self=True, method="scan"))
    assert V.knn_exact(qs, base.limit(0), 5, method="blocks").count() == 0
    assert key(V.knn_exact(qs.limit(4), base.limit(3), 5, method="blocks")) == key(V.knn_exact(qs.limit(4), base.limit(3), 5, method="scan"))


def test_lsh_by_blocks_measures_what_shares_a_bucket(spark, small):
    ids, x = data()
    base = frame(spark, ids[:140], x[:140])
    qs = base.select(F.col("id").alias("query_id"), "vec")
    got, stats = V.lsh_search(qs, base, k=4, bucket_length=0.8, and_width=2, tables=5, exclude_self=True)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    feats = base.select("id", array_to_vector(F.col("vec")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.8, numHashTables=10, seed=11).fit(feats)
    h = {r.id: [int(v[0]) for v in r.hashes] for r in model.transform(feats).collect()}
    f = x.astype(np.float32).astype(np.float64)
    want, share = [], {}
    for q in range(140):
        same = [sum(h[q][2 * t:2 * t + 2] == h[b][2 * t:2 * t + 2] for t in range(5)) for b in range(140)]
        share[q] = sum(same)
        d = ((f[:140] - f[q]) ** 2).sum(1).round(6)
        near = [b for b in range(140) if same[b] and b != q]
        near = near if len(near) >= 4 else [b for b in range(140) if b != q]
        want += [(q, n + 1, b) for n, b in enumerate(sorted(near, key=lambda b: (d[b], b))[:4])]
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == want
    assert {r.query_id: r.evaluated for r in stats.collect()} == share


def test_wide_hashes_have_codes_of_their_own():
    rng = np.random.default_rng(0)
    b, q = rng.integers(-2 ** 40, 2 ** 40, (50, 3)), rng.integers(-2 ** 40, 2 ** 40, (30, 3))
    q[:10] = b[:10]
    q[10:15] = b[10:15] + [0, 0, 1]
    table = V._Buckets(b)
    assert not table.plain
    at, has = table.places(q)
    assert has.tolist() == [True] * 10 + [False] * 20
    assert [table.order[table.start[p]] for p in at[:10]] == list(range(10))
