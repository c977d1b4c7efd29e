import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docsift.llm import alignment as al
from docsift.llm.pack import tokenizer_path

A, B = tokenizer_path(al.A_TOKENIZER), tokenizer_path(al.B_TOKENIZER)
ODD = ["It's a TEST... “foo”. été <|endoftext|>x. <s> </s> a b c\x1cd ﬁ İstanbul ΣΑΣ.", "", None, " ", "   ", " lead", "trail ",
       "12,345! don't!! we'll?x 'twas (a)b) ́x ‍ 漢字。 😀! \t\n", "▁ ▁▁ x", "a ▁b", "a  b \n\n c", "\x00\x01", "word " * 9000,
       "漢字" * 9000, " " * 300, "x" * 5000, "tab\tx 　 y\xa0z \x85 w", "a \n b", "a\n b c"]


def brute(docs):
    """Whole texts through both libraries; every A token against every B token near it."""
    import sentencepiece
    from tokenizers import Tokenizer
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    chars = al.byte_characters()
    made = []
    for i, t in docs:
        raw = (" " + (t or "")).encode()
        a = tok.encode(" " + t, add_special_tokens=False) if t else None
        ai, at = (a.ids, a.tokens) if t else ([], [])
        bi = sp.encode(t) if t else []
        ab = [bytes(chars[c] for c in x) for x in at]
        bb = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode()
              for k, p in zip(bi, [sp.id_to_piece(k) for k in bi])]
        if not t or b"".join(ab) != raw or b"".join(bb) != raw:
            made.append((i, [], [], [], []))
            continue
        ae, be = np.cumsum([len(x) for x in ab]), np.cumsum([len(x) for x in bb])
        links, lo = [], 0
        for x, end, n in zip(ai, ae, map(len, ab)):
            while be[lo] <= end - n:
                lo += 1
            j = lo
            while j < len(be) and be[j] - len(bb[j]) < end:
                links.append((x, bi[j]))
                j += 1
        ends, groups, p, q = sorted(set(ae) & set(be)), [], 0, 0
        for e in ends:
            p2, q2 = int(np.searchsorted(ae, e)) + 1, int(np.searchsorted(be, e)) + 1
            groups.append(",".join(map(str, ai[p:p2])) + "|" + ",".join(map(str, bi[q:q2])))
            p, q = p2, q2
        made.append((i, ai, bi, links, groups))
    count = Counter(x for *_, links, _ in made for x in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted((str(i), len(ai), len(bi), len(g), len(ln), sum(count[x] == top[x[1]] for x in ln), sum(count[x] for x in ln),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, ai, bi, ln, g in made)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ODD[0]), (None, "no id")]
    rows += [(100 + k, "".join(rng.choice("ab  é\n漢😀\x00The tion<s>12.,ing'") for _ in range(rng.randint(1, 60)))) for k in range(300)]
    return rows


def test_equals_brute_force_on_both_paths(spark, docs, monkeypatch):
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in docs], "doc_id long, text string, n_a int, pair string").repartition(5)
    want = brute(docs)
    assert got(al.aligned(df, A, B)) == want
    monkeypatch.setattr(al, "FAN", 2)
    assert got(al.aligned(df, A, B, broadcast_pairs=0, bucket_pairs=40)) == want


def test_small_tree_changes_nothing(spark, docs):
    partials = al.stored(al.task_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), A, B), "p")
    want = {r.pair: r.n for r in partials.groupBy("pair").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    hashes = al.stored(al.hashed_pairs(partials, 8), "h")
    counted = hashes.join(al.dense_counts(partials, hashes, 8, fan=2), "bucket")
    assert {r.pair: r.n for r in al.pair_counts(counted).collect()} == want


def test_small_parts_change_nothing(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = got(al.aligned(df, A, B))
    monkeypatch.setattr(al, "PART_CHARS", 50)
    assert got(al.aligned(df, A, B)) == want
    monkeypatch.setattr(al, "MEMO_UNITS", 2)
    assert got(al.aligned(df, A, B)) == want


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 30_000))
    sizes, words = al.perfect_hash(keys)
    h = al.PairHash(1, [sizes], [words])
    zero = np.zeros(len(keys), np.int64)
    slots = h.slots(keys, zero)
    assert sorted(slots) == list(range(len(keys)))
    ordered = np.empty_like(keys)
    ordered[slots] = keys
    with pytest.raises(ValueError):
        h.verified(keys + 1, zero, ordered)


def test_empty_table(spark):
    for rows in ([], [(1, None)]):
        out = al.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
        assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "")][:len(rows)]


def test_each_text_is_read_once(spark, docs):
    from pyspark.sql import functions as F
    for bound in (al.BROADCAST_PAIRS, 0):
        read = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def counted(t):
            read.add(1)
            return t

        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text", counted("text"))
        assert len(al.aligned(df, A, B, broadcast_pairs=bound, bucket_pairs=400).collect()) == read.value == len(docs)


def test_few_pairs_at_a_time_change_nothing(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = got(al.aligned(df, A, B))
    monkeypatch.setattr(al, "PART_PAIRS", 3)
    assert got(al.aligned(df, A, B)) == want
