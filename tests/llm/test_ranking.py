import math
import random
import re
from collections import Counter

import duckdb
import pytest

from docsift.llm import ranking

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=20):
    terms = lambda t: WORD.findall((t or "").translate(LOWER))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(str(item), r + 1, str(None if null else i), -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(df):
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in df.collect())


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(60)] + ["rare%d" % i for i in range(300)] + ["été", "漢字", "İ"]
    pick = lambda: vocab[min(int(rng.expovariate(0.02)), len(vocab) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(900)]
    docs += [(5000 + i, "w1, W2; rare7 rare8!") for i in range(300)]  # a group of copies: ties
    docs += [(None, "w1 w2 rare9"), (None, None), (3, ""), (4, "?!"), (6, "w3 " * 30_000 + "rare1"), (7, docs[7][1])]
    items = [(i, " ".join(pick() for _ in range(rng.randint(1, 25)))) for i in range(25)]
    items += [(30, "w1 W1 w2 rare7"), (31, "nowhere"), (32, ""), (33, None), (None, "rare9 w1"), (30, "w1 W1 w2 rare7"), (34, "Été 漢字?")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, term string"),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int"))


def test_equals_brute_force(spark, tables):
    d, q = frames(spark, *tables)
    want = brute(*tables)
    assert got(ranking.ranked(d.repartition(3), q)) == want
    assert got(ranking.ranked(d, q, pass_rows=100)) == want  # several passes


def test_small_blocks_and_other_shares_change_nothing(spark, tables, monkeypatch):
    d, q = frames(spark, *tables)
    want = brute(*tables, k=3)
    for docs, share, span in ((300, 5, 16), (10_000, 10 ** 9, 4), (600, 1, 64)):  # all lists long; all short
        monkeypatch.setattr(ranking, "BLOCK_DOCS", docs)
        monkeypatch.setattr(ranking, "SHORT_SHARE", share)
        monkeypatch.setattr(ranking, "RANGE_DOCS", span)
        seen = []
        assert got(ranking.ranked(d, q, k=3, ranges=seen)) == want
        assert all(scored <= met for met, scored in seen)


def test_ranges_are_skipped(spark):
    docs = [(i, "common words " + " ".join(f"x{(i * 7 + j) % 5}" for j in range(8))) for i in range(4000)]
    docs += [(9000 + i, "common words rare thing") for i in range(30)]
    seen = []
    d, q = frames(spark, docs, [(1, "common rare thing words")])
    assert got(ranking.ranked(d, q, k=5, ranges=seen)) == brute(docs, [(1, "common rare thing words")], k=5)
    met, scored = seen[0]
    assert scored * 4 < met


def test_empty_tables(spark):
    d, q = frames(spark, [], [(1, "a")])
    assert ranking.ranked(d, q).count() == 0
    d, q = frames(spark, [(1, "a")], [])
    assert ranking.ranked(d, q).count() == 0


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = sorted(con.sql(ranking.OP13_SQL).fetchall())
    assert sorted(tuple(r) for r in ranking.op13_ranked_search(spark, d).collect()) == want
