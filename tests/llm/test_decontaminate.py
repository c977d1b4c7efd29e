import hashlib
import random
import re

from docsift.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    windows = [(i, w[k:k + width]) for i, t in items if i is not None and (w := words(t))
               for k in range(max(len(w) - width, 0) + 1)]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k:k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(i)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, pos int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, win int")
    return sorted((tuple(r) for r in dc.decontaminate(d, b).drop("item_ids").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "Rare", "élan", "x9", "Ünter", "zeta"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 14]))) for i in range(12)] + [(99, None), (98, ""), (None, "the of"), (5, "the the")]
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(30)] + [(40, None), (41, ""), (42, "?!"), (None, items[3][1])]
    docs += [(50 + k, f"{text(4)} {t} {text(3)}") for k, (_, t) in enumerate(items) if t] + docs[:3]
    docs.append((0, "another text under an id that is taken"))
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs = [(1, "a b c"), (2, None)]
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, [], [(1, "a b")]) == []


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "filler " * 200_000 + item + " end"), (2, item.upper())]
    assert found(spark, docs, [(7, item)]) == brute(docs, [(7, item)])


def test_repeated_passage_of_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    items = [(i, passage) for i in range(200)] + [(200, "p9 p0 p1")]
    docs = [(1, (passage + " ") * 3000), (1, (passage + " ") * 3000), (2, "q " + passage), (3, "p0 p1")]
    whole = hashlib.sha256(",".join(sorted(map(str, range(201)))).encode()).hexdigest()
    got = found(spark, docs, items)
    assert got[0] == got[1] == (1, 30000, 30000, 201, whole, True)
    assert got[2][:4] == (2, 11, 10, 200) and got[3][:4] == (3, 2, 0, 0)


def test_spans(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 5]))) for i in range(6)]
    docs = [(i, text(30)) for i in range(10)] + [(20, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dc.phrase_spans(d, b, width=4).collect()))
    want = set()
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 4, 0) + 1):
            run = w[k:k + 4]
            for doc, dt in docs:
                x = words(dt)
                want |= {(doc, i, s, len(run)) for s in range(len(x) - len(run) + 1) if x[s:s + len(run)] == run}
    assert got == sorted(want)


def test_proximity(spark):
    rng = random.Random(9)
    vocab = ["Alpha", "beta", "gamma", "x", "y", "z"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 60])))) for i in range(20)]
    docs += [(30, None), docs[0], (None, "alpha beta")]
    pairs = [(0, "alpha", "BETA"), (1, "gamma", "gamma"), (2, "alpha", "nowhere"), (3, None, "beta"), (4, "beta", "alpha")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, pos int")
    p = spark.createDataFrame(pairs, "pair_id int, a string, b string")
    got = sorted(map(tuple, dc.near_words(d, p, 3).collect()), key=str)
    want = [(doc, k, i, j) for doc, t in docs for k, a, b in pairs if a and b for w in [words(t)]
            for i, x in enumerate(w) if x == a.lower() for j, y in enumerate(w) if y == b.lower() and i != j and abs(i - j) <= 3]
    assert got == sorted(want, key=str)
