import random
from collections import defaultdict

from docsift.llm import ngram_join as nj
from docsift.llm.components import components


def brute(rows, width=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least[top(i)], d)
    return sorted(((d, len(s), least[top(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")
    return sorted((tuple(r) for r in nj.near_duplicates(df).collect()), key=str)


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("uvwxyz") * 3
        out.append(" ".join(w))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(11)
    vocab = [a + b for a in "abcdefgh" for b in "klmnop"]
    base = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = " ".join(base(12))
    texts = [None, "", "  \t\n", "one", "ONE", "one two three four", "One two  three four", "one two three four five"]
    texts += [f"{line}\n{' '.join(base(rng.choice([2, 6, 20, 60])))}" for _ in range(40)]
    for size, n, edits in ((30, 25, 2), (90, 40, 4), (200, 20, 10)):
        texts += copies(rng, base(size), n, edits)
    texts += ["long " * 20_000, " ".join(vocab * 200)]
    texts += texts[20:30]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, "one two three four"), (1, texts[0]), (4, "an id that is taken twice")]
    assert found(spark, rows) == brute(rows)


def test_bounds_alone_decide_what_stars_leave(spark, monkeypatch):
    """With a single star round most links must come from the head answers."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = list(enumerate(copies(rng, base, 80, 3)))
    monkeypatch.setattr(nj, "STARS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, comps = nj.similar_links(df, stars=1)
    got = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(df).collect()}
    assert got == {d: c for d, _, c in brute(rows)}
    assert comps.select("node").distinct().count() <= members.select("node").distinct().count()


def test_empty_table(spark):
    assert found(spark, []) == []


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 300)]
    df = spark.createDataFrame([*edges, (None, 1), (7, None)], "u long, v long")
    got = dict(components(df).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200, 202: 200}


def test_rows_without_an_id_connect_documents(spark):
    w = [f"w{i}" for i in range(80)]
    a, b, c, d = w[:70], w[7:70] + w[70:], w[3:70] + w[70:75], w[30:]
    rows = [(1, a), (None, c), (2, b), (None, c), (9, d), (None, d[1:]), (7, d[2:] + ["end"])]
    rows = [(i, " ".join(x)) for i, x in rows]
    want = brute(rows)
    assert [r[2] for r in want if r[0] == 2] == [1]
    assert found(spark, rows) == want


def test_many_variants_that_hardly_link(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(copies(rng, [f"b{i}" for i in range(140)], 150, 9))]
    rows += [(None if i % 3 == 0 else 1000 + i, t) for i, t in enumerate(copies(rng, [f"c{i}" for i in range(60)], 60, 4))]
    assert found(spark, rows) == brute(rows)


def test_sets_are_compared_in_spark_rows(spark):
    """The pipeline's executor memory: both sets of every pair went to Python in batches of 10,000 pairs."""
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4, 5]), (3, [9])], "node long, set array<bigint>")
    pairs = spark.createDataFrame([(1, 2, 7), (1, 3, 8), (2, 2, 9)], "u long, v long, lists int")
    got = nj.shared_counts(pairs, sets)
    assert sorted(got.select("u", "v", "lists", "u_n", "v_n", "shared").collect()) == [
        (1, 2, 7, 3, 4, 2), (1, 3, 8, 3, 1, 0), (2, 2, 9, 4, 4, 4)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_values_are_counted_in_place():
    import numpy as np
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 5, 1000):
        x = rng.integers(-9, 300, size)
        values, n = np.unique(x, return_counts=True)
        for least in (2, 3):
            got = nj.repeated(x.copy(), least)
            assert [list(g) for g in got] == [list(values[n >= least]), list(n[n >= least])]
