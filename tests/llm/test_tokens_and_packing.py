import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docsift.llm import pack
from docsift.llm import token_counts as tc

ODD = ["It's a TEST... “foo”. été <|endoftext|>x. <|ENDOFTEXT|> a b c\x1cd ﬁ İstanbul ΣΑΣ.",
       "12,345! don't!! we'll?x 'twas (a)b) ́x ‍ 漢字。 😀! \t\n", "", None, "   ", "▁ ▁▁<s></s>", "a  b \n\n c",
       "x" * 5000, "\x00\x01", "word " * 9000, "漢字" * 9000, " " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)]
    rows += [(0, ODD[0], "clash", 1), (None, "no id", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece
    path = pack.tokenizer_path(tc.TOKENIZER)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096)
                  for r in docs.collect())
    for chunk in (7, 1000, tc.CHUNK_CHARS):
        got = tc.count_tokens(docs, path, chunk_chars=chunk).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tc.count_tokens(docs.limit(0), path).count() == 0


def test_state_maps_compose_anywhere():
    import sentencepiece
    path = pack.tokenizer_path(tc.TOKENIZER)
    sp, tr, rng = sentencepiece.SentencePieceProcessor(model_file=path), tc.compiled(path), random.Random(5)
    for _ in range(1500):
        x = "".join(rng.choice("ab  é\n漢😀\x00▁The tion<s>12.,ing") for _ in range(rng.randint(1, 40)))
        y, k = (" " + x).replace(" ", tc.SPACE), rng.randint(1, 9)
        maps = [tr.state_map(y[i:i + k]) for i in range(0, len(y), k)]
        assert tr.compose(maps) == len(sp.encode(x)), repr(x)


def test_bounded_tables_change_nothing(monkeypatch):
    import sentencepiece
    path = pack.tokenizer_path(tc.TOKENIZER)
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    monkeypatch.setattr(tc, "MAX_STATES", 20)
    monkeypatch.setattr(tc, "MEMO_SEGMENTS", 3)
    tr = tc.Transducer(path)
    for _ in range(200):
        x = "".join(rng.choice("abcdefgh tionsé") for _ in range(60))
        assert tr.compose([tr.state_map((" " + x).replace(" ", tc.SPACE))]) == len(sp.encode(x))


def test_packing_is_whole_and_exact(spark, docs):
    from tokenizers import Tokenizer
    path = pack.tokenizer_path(pack.TOKENIZER)
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = pack.pack_documents(docs, path, keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack.pack_documents(docs.limit(0), path).count() == 0


def test_word_ids_with_a_full_memo(monkeypatch):
    path = pack.tokenizer_path(pack.TOKENIZER)
    whole = list(pack.WordIds(path)(ODD))
    monkeypatch.setattr(pack, "MEMO_WORDS", 2)
    few = pack.WordIds(path)
    assert list(few(ODD)) == whole
    want = [np.array(few.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]
    assert whole == want


def test_patterns():
    rng = random.Random(1)
    for _ in range(400):
        cap = rng.choice([5, 10, 30, 64])
        c = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        used = Counter()
        for runs, bins in pack.bin_patterns(c, cap):
            assert bins > 0 and sum(x * t for x, t in runs) <= cap
            for x, t in runs:
                used[x] += t * bins
        assert used == Counter(c)
    # Exact complements: one, two and three pieces that fill a gap.
    assert pack.bin_patterns({7: 2, 3: 2}, 10) == [([(7, 1), (3, 1)], 2)]
    assert sum(b for _, b in pack.bin_patterns({6: 1, 3: 1, 1: 1}, 10)) == 1
    assert sum(b for _, b in pack.bin_patterns({4: 1, 3: 1, 2: 1, 1: 1}, 10)) == 1
    assert pack.bin_patterns({}, 10) == []


def test_many_pieces_of_one_length_are_ranked_in_buckets(spark):
    pieces = spark.range(5000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "1L AS ids_crc32", "id AS salt")
    got = pack.packed(pieces, capacity=10, bucket_rows=100).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
    assert len({r.sequence_id for r in got}) == 1667


def test_words_are_encoded_once_a_worker(monkeypatch):
    """op10's CPU time: every task encoded again what its worker had encoded for the task before."""
    path = pack.tokenizer_path(pack.TOKENIZER)
    assert pack._tokenizer(path) is pack._tokenizer(path)
    monkeypatch.setattr(pack, "MEMO_WORDS", 5)
    tok = pack.WordIds(path)
    texts = ["red, dog owl red, zebra", "a full memo takes no more", "red, dog full memo"]
    for _ in range(2):
        assert list(tok(texts)) == [np.array(tok.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(tok.memo) == 5


def test_words_of_few_texts_are_held_at_a_time():
    import tracemalloc
    tok = pack.WordIds(pack.tokenizer_path(pack.TOKENIZER))
    texts = [" ".join(f"w{k}" for k in range(i, i + 200)) for i in range(100)] * 50
    want = list(tok(texts[:100]))  # the memo knows all words from here on
    tracemalloc.start()
    for k, ids in enumerate(tok(texts)):
        assert ids == want[k % 100]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # 1,000,000 words would take 37 MB and more


def test_a_worker_keeps_words_until_another_operator_runs():
    from docsift.llm import common
    path = pack.tokenizer_path(pack.TOKENIZER)
    tok = pack._tokenizer(path)
    assert pack._tokenizer(path) is tok
    common.worker_memo(None)
    assert pack._tokenizer(path) is not tok


def test_closing_punctuation_takes_no_memo_entries_of_its_own():
    """op10's CPU time: a word was remembered, and encoded, anew for each punctuation behind it."""
    tok = pack.WordIds(pack.tokenizer_path(pack.TOKENIZER))
    texts = ["Zebra. zebra, zebra!! (zebra) zebra", ".zebra !zebra zebra.a. zebra.\tzebra)\x0b", "<|x Zebra.", "é. aé, 9%..", None]
    want = [np.array(tok.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tok(texts)) == want
    assert b"zebra" in tok.memo and not {b"zebra.", b"zebra,", b"zebra!!", b"zebra)"} & set(tok.memo)
