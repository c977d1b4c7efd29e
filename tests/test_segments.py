import os
import random

import pytest

from docsift.operators import lexical as L
from docsift.operators.segments import SegmentedIndex, fingerprint


@pytest.fixture()
def passages(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["hot"] * 30
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for i in range(1, 301)]
    return rows + [(900, None), (901, "the of and"), (902, "hot hot hot")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def rebuilt(spark, rows, queries, k=5):
    return hits(L.bm25_top(queries, frame(spark, rows), k))


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in df.collect())


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, "w1 hot w2 w2"), (2, "hot"), (3, "nowhere"), (4, ""), (5, "w7 reworded")],
                                 "query_id long, text string")


def test_changes_equal_a_rebuild(spark, passages, queries, tmp_path):
    index = SegmentedIndex.create(spark, str(tmp_path))
    assert hits(index.search(queries)) == []
    live = dict(passages)
    for part in range(4):
        index = index.add(frame(spark, [r for r in passages if r[0] % 4 == part]))
    assert hits(index.search(queries)) == rebuilt(spark, list(live.items()), queries)
    gone = [i for i in live if i % 3 == 0]
    index = index.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], None, 12345]], "chunk_id long"))
    live = {i: t for i, t in live.items() if i % 3}
    assert hits(index.search(queries)) == rebuilt(spark, list(live.items()), queries)
    merged = index.merge()
    assert len(merged.segments) == 1 and merged.deletions == []
    assert hits(merged.search(queries)) == rebuilt(spark, list(live.items()), queries)
    again = {i: "w7 reworded hot" for i in (3, 4, 6)}  # deleted, live, deleted
    new = merged.update(frame(spark, list(again.items())))
    live.update(again)
    assert hits(new.search(queries)) == rebuilt(spark, list(live.items()), queries)
    assert new.is_current(frame(spark, list(live.items())))
    assert not merged.is_current(frame(spark, list(live.items())))
    assert hits(SegmentedIndex.open(spark, str(tmp_path)).search(queries)) == hits(new.search(queries))
    assert hits(index.search(queries)) != hits(new.search(queries))  # an opened version stays as it is


def test_an_addition_writes_only_its_own_segment(spark, passages, tmp_path):
    index = SegmentedIndex.create(spark, str(tmp_path)).add(frame(spark, passages[:50]))

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs
                if f.endswith(".parquet")}
    before = files()
    new = index.add(frame(spark, passages[50:60]))
    after = files()
    assert all(after[f] == t for f, t in before.items())
    added = {os.path.relpath(f, tmp_path).split(os.sep)[0] for f in after if f not in before}
    assert added == {"manifest", new.segments[-1]}


def test_merges_by_tiers(spark, passages, tmp_path, queries):
    index = SegmentedIndex.create(spark, str(tmp_path)).add(frame(spark, passages[:200]))
    for i in range(4):
        index = index.add(frame(spark, passages[200 + i:201 + i]))
    index = index.delete(spark.createDataFrame([(passages[0][0],), (passages[201][0],)], "chunk_id long"))
    merged = index.merge()
    assert index.segments[0] in merged.segments and len(merged.segments) == 2
    live = [r for k, r in enumerate(passages[:204]) if k not in (0, 201)]
    assert hits(merged.search(queries)) == rebuilt(spark, live, queries)


def test_fingerprint_tells_tables_apart(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    one = fingerprint(frame(spark, rows))
    assert one == fingerprint(frame(spark, rows[::-1]))
    assert one != fingerprint(frame(spark, [(1, "b"), (2, "a"), (3, None)]))
    assert fingerprint(frame(spark, [])) == 0
