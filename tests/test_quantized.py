import numpy as np
import pytest

from docsift.operators import quantized as PQ
from docsift.operators import sweep
from docsift.operators import vectors as V

SCHEMA = "id long, vec array<float>, list_id int"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v, 1) for i, v in enumerate(x)], SCHEMA)


def asked(df):
    return df.selectExpr("id as query_id", "vec")


def test_recall_with_a_tenth_measured(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[:300] = x[300:600] + rng.normal(scale=0.05, size=(300, 32))
    base = frame(spark, [v.tolist() for v in x])
    index = PQ.build(base, str(tmp_path))
    assert index.codes.count() == 1500
    got = PQ.search(asked(base), index, k=10, refine=120, exclude_self=True)
    exact = V.knn_exact(asked(base), base, k=10, exclude_self=True)
    r = V.ann_recall(got, exact, PQ.measured(asked(base), index, 120), 1500, 10).toPandas()
    assert len(r) == 1500 and r["recall"].mean() >= 0.9 and r["candidate_share"].max() <= 0.1
    both = got.join(exact.withColumnRenamed("dist", "d").drop("rank"), ["query_id", "id"])
    assert both.filter("abs(dist - d) > 1e-6").count() == 0


def test_everything_refined_is_exact(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(200, 10)), 1).astype(np.float32)  # ten dims: a last slice of two; ties
    base = frame(spark, [v.tolist() for v in x])
    index = PQ.build(base, str(tmp_path), lists=7)
    exact = sorted(map(tuple, V.knn_exact(asked(base), base, k=5).collect()))
    assert sorted(map(tuple, PQ.search(asked(base), index, k=5, refine=200, nprobe=7).collect())) == exact
    monkeypatch.setattr(PQ, "MAX_SCAN_QUERIES", 60)  # several blocks of queries
    assert sorted(map(tuple, PQ.search(asked(base), index, k=5, refine=200, nprobe=7).collect())) == exact
    few = PQ.search(asked(base), index, k=200, refine=3, nprobe=1)
    assert few.groupBy("query_id").count().filter("count <> 200").count() == 0  # short queries are completed


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3,
                                  [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 2.0]),
                                   (6, [0.0, 0.0])]])
def test_odd_tables(spark, tmp_path, rows):
    base = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    index = PQ.build(base, str(tmp_path))
    got = {r.query_id: r.id for r in PQ.search(asked(base), index, k=1).collect()}
    good = {i for i, v in rows if i is not None and v is not None and len(v) == 2 and all(c is not None and c == c for c in v)}
    assert got == {i: i for i in good}


def test_swept_candidates_are_those_of_the_code_scan(spark, tmp_path, monkeypatch):
    """Several blocks and groups of queries; no candidate is a row, and measured() searches no second time."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    base = frame(spark, [v.tolist() for v in x])
    index = PQ.build(base, str(tmp_path), lists=9)
    qs = asked(base)
    near = {}
    for r in PQ.candidates(qs, index, 15, 6, True).collect():
        near.setdefault(r.query_id, []).append(r.id)
    monkeypatch.setattr(sweep, "PACK_ROWS", 30)
    monkeypatch.setattr(sweep, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(sweep, "TILE_ROWS", 16)
    monkeypatch.setattr(PQ, "MAX_SCAN_QUERIES", 50)
    got = {}
    res = PQ.search(qs, index, k=4, refine=15, nprobe=6, exclude_self=True)
    for r in res.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2).round(6)
    assert got == {q: sorted(near[q], key=lambda i: (d[q, i], i))[:4] for q in near} and len(got) == 400
    monkeypatch.setattr(sweep, "swept", None)
    assert {r.evaluated for r in PQ.measured(qs, index, 15, 6).collect()} == {15}
