import hashlib
from fractions import Fraction

import duckdb
import pytest

from docsift.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, key string"


def brute(docs, weights=(5, 2, 1), percent=150, epochs=2):
    """Targets by rounds of exact fractions, then documents in hash order."""
    sized = [(i, s, len((t or "").encode().split()), t or "") for i, t, s, *_ in docs]
    size = {}
    for _, s, n, _ in sized:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = Fraction(percent * sum(size.values()), 100) - sum(epochs * size[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        target = {s: Fraction(epochs * size[s]) if s in full else rest * w[s] / open_w for s in order}
        more = {s for s in order if target[s] > epochs * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s in order:
        mine = [(hashlib.md5("|".join(["mix", "null" if i is None else str(i), "null" if s is None else s, t]).encode())
                 .hexdigest(), i, n) for i, x, n, t in sized if x == s]
        words = int(target[s] + Fraction(1, 2))
        whole = words // size[s] if size[s] else 0
        part, at = words - whole * size[s], 0
        for key in sorted({m[0] for m in mine}):
            same = [m for m in mine if m[0] == key]
            n = same[0][2]
            extra = min(n, max(0, (part - at) // len(same)))
            out += [(i, n, size[s], float(target[s]), whole * n + extra) for _, i, _ in same]
            at += n * len(same)
    return out


def got(df):
    return sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in df.collect())


def wanted(docs):
    return sorted((str(i), *rest) for i, *rest in brute(docs))


@pytest.fixture(scope="module")
def rows():
    rows = [(i, "w " * (i % 17), f"src{i % 5}", 1, "k") for i in range(300)]
    rows += [(1000 + i, "hot word " * (i % 40), "src0", 1, "k") for i in range(400)]
    rows += [(None, "no id here", "src1", 1, "k"), (None, "no id here", "src1", 1, "k"), (None, None, None, 1, "k")]
    rows += [(7, "x " * 20_000, "é", 1, "k"), (8, "", "empty", 1, "k"), (9, "a\x0b\x0c\r\n\tb c", None, 1, "k")]
    return rows + [(5, "equal rows of one id", "tiny", 1, "k")] * 7


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(mixing.mixed(df)) == wanted(rows)
    assert got(mixing.mixed(df.repartition(11))) == wanted(rows)


def test_taken_words_meet_targets(spark, rows):
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        x = by.setdefault((r.source_size, r.target), [0])
        x[0] += r.taken
    for (_, target), (taken,) in by.items():
        assert abs(taken - target) <= 7  # the most equal rows there are
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r.size for r in out))


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1, "k")], [(1, "a b c", "s", 1, "k")],
                                  [(k, "one " * 10 ** k, f"s{k}", 1, "k") for k in range(5)]])
def test_small_tables(spark, rows):
    assert got(mixing.mixed(spark.createDataFrame(rows, SCHEMA))) == wanted(rows)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    want = sorted(con.sql(mixing.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.op11_mix_sources(spark, d).collect()) == want
