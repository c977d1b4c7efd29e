import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import prep as C
from docsift.operators.ids import running_offsets
from docsift.plans import corpus
from docsift.sources import files as A


def py_chunks(text, m=256):
    """Plain-Python statement of C7 + C8: pieces of at most m words per line,
    merged greedily in order while the sum stays within m."""
    pieces = []
    for line in (text or "").split("\n"):
        w = [x for x in line.split(" ") for x in x.split("\t") if x]
        w = [x for x in " ".join(w).split() if x]
        for i in range(0, len(w), m):
            pieces.append(w[i:i + m])
    chunks = []
    for p in pieces:
        if chunks and chunks[-1][0] + len(p) <= m:
            chunks[-1] = (chunks[-1][0] + len(p), chunks[-1][1] + [" ".join(p)])
        else:
            chunks.append((len(p), [" ".join(p)]))
    return [(n, "\n".join(t)) for n, t in chunks]


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


WINDOW_CASES = [
    "", words(1), words(255), words(256), words(257), words(513),
    "\n\n" + words(3) + "\n\n\n" + words(2) + "\n",
    words(200) + "\n" + words(56, "x"), words(200) + "\n" + words(57, "x"),
]


@pytest.mark.parametrize("text", WINDOW_CASES)
def test_chunking_matches_python(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["n_tokens"], r["text"]) for r in C.chunk_documents(df).orderBy("pos").collect()]
    assert got == py_chunks(text)
    assert all(n <= 256 for n, _ in got)


def test_chunking_keeps_every_word_in_order(spark):
    rnd = random.Random(3)
    docs = []
    for d in range(20):
        lines = [words(rnd.randint(0, 400), f"d{d}l{i}_") for i in range(rnd.randint(0, 12))]
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = C.chunk_documents(df)
    for d, text in docs:
        got = [r["text"] for r in out.filter(F.col("doc_id") == d).orderBy("pos").collect()]
        assert " ".join(" ".join(got).split()) == " ".join(text.split())


def test_null_text_gives_no_chunks(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert C.chunk_documents(df).count() == 0


@pytest.mark.parametrize("n_pages,expected", [
    (0, []), (1, [(1, 1, 1)]), (10, [(1, 1, 10)]), (11, [(1, 1, 10), (2, 11, 11)]),
    (25, [(1, 1, 10), (2, 11, 20), (3, 21, 25)])])
def test_page_ranges(spark, n_pages, expected):
    m = spark.createDataFrame([("/data/s/doc_1.pdf", n_pages)], "document_name string, n_pages int")
    got = [(r.split_no, r.first_page, r.last_page) for r in C.page_ranges(m).orderBy("split_no").collect()]
    assert got == expected
    built = C.build_manifest(m).first()
    assert built.n_splits == len(expected)
    names = [p.split_path for p in C.parse_split_list(C.build_manifest(m)).orderBy("split_no").collect()]
    assert names == [f"/splits/doc_1.pdf_split_{a}_{b}.pdf" for _, a, b in expected]


def sequential_ids(counts):
    """The reference's loop: a running id, a summary after every fifth
    chunk of a document."""
    out, nxt = [], 1
    for d, n in counts:
        for pos in range(1, n + 1):
            out.append((d, "chunk", nxt))
            nxt += 1
            if pos % 5 == 0:
                out.append((d, "summary", nxt))
                nxt += 1
    return out


def test_interleaved_ids_equal_sequential_loop(spark):
    sizes = [0, 1, 4, 5, 6, 10, 13]
    docs = [(i + 1, "\n".join(words(250, f"d{i}p{j}_") for j in range(n))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ct = corpus.chunk_table(df)
    got = sorted((r.document_id, r.kind, r.chunk_id) for r in ct.collect())
    want = sorted(sequential_ids([(i + 1, n) for i, n in enumerate(sizes)]))
    assert got == want
    ids = [r[2] for r in got]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_running_offsets_across_blocks(spark):
    rnd = random.Random(5)
    keys = sorted(rnd.sample(range(0, 5000), 300))
    data = [(k, rnd.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(data, "k long, n long")
    got = {r.k: r.offset for r in running_offsets(df, "k", "n", shift=4).collect()}
    acc = 0
    for k, n in data:
        assert got[k] == acc
        acc += n


def test_convert_pages_and_enrich(spark):
    html = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a>x</a></nav>'
            '<!-- c --><h1>Head &amp; one</h1><p>First <b>para</b>.</p><p>Second &quot;q&quot;</p>'
            '<footer>&copy; f</footer></body></html>')
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<html><nav>only</nav></html>")],
                                  "page_id long, url string, html string")
    items = C.convert_pages(pages)
    got = [(r.item_no, r.label, r.text) for r in items.orderBy("page_id", "item_no").collect()]
    assert got == [(1, "heading", "Head & one"), (2, "paragraph", "First para."), (3, "paragraph", 'Second "q"')]
    enr = [r.enriched for r in C.enrich_chunks(items).orderBy("item_no").collect()]
    assert enr == ["Head & one\nFirst para.", 'Head & one\nSecond "q"']
    bad = [(r.page_id, r.reason) for r in C.conversion_failures(pages).collect()]
    assert bad == [(2, "no text")]


def test_clean_file_names_reports_collisions(spark):
    paths = spark.createDataFrame([("/a/x,y.pdf",), ("/a/xy.pdf",), ("/b,c/d.pdf",)], "path string")
    got = {r.old_path: (r.new_path, r.renamed, r.n_same_name) for r in A.clean_file_names(paths).collect()}
    assert got["/a/x,y.pdf"] == ("/a/xy.pdf", True, 2)
    assert got["/a/xy.pdf"] == ("/a/xy.pdf", False, 2)
    assert got["/b,c/d.pdf"] == ("/b,c/d.pdf", False, 1)


def test_dense_rank_ids_are_dense_and_ordered(spark):
    from docsift.operators.ids import dense_rank_ids
    keys = [5, 70000, 3, 131072, 9, 65536]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.id for r in dense_rank_ids(df, "k", shift=4).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_offsets_over_names_hashes_and_ranges(spark):
    from docsift.operators.ids import dense_ids, range_offsets
    rnd = random.Random(6)
    data = [(f"k{rnd.getrandbits(60):x}" if i else None, rnd.getrandbits(62) * rnd.choice((1, -1)), rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "name string, hash long, n int").repartition(5)
    for shift in (3, 19):  # many ranges, one
        for key, at in (("name", 0), ("hash", 1)):
            acc = 0
            got = {r[key]: r.offset for r in range_offsets(df, [key], "n", shift=shift).collect()}
            for r in sorted(data, key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0)):
                assert got[r[at]] == acc
                acc += r[2]
    ids = dense_ids(spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), ("a", 9)], "f string, d int"), ["f"], tie_cols=["d"])
    assert sorted((r.id, r.f, r.d) for r in ids.collect()) == [(1, "a", 9), (2, "a", 9), (3, "b", 1), (4, "b", 2)]
    assert range_offsets(df.limit(0), ["name"], "n").count() == 0


def test_one_key_for_most_rows_gets_one_rank(spark):
    from docsift.operators.ids import dense_rank_ids
    df = spark.createDataFrame([("hot",)] * 300 + [("a",), (None,), ("z",)], "k string")
    got = {(r.k, r.id) for r in dense_rank_ids(df, "k", shift=2).collect()}
    assert got == {(None, 1), ("a", 2), ("hot", 3), ("z", 4)}


def test_groups_are_not_filtered_below_the_chunk_stages(spark):
    """a filter on the number of chunks would inline chunking into itself, once per chunk."""
    docs = spark.createDataFrame([(1, "\n".join(f"w{i} " * 200 for i in range(11))), (2, "a b"), (3, None)], "doc_id long, text string")
    groups = C.chunk_groups(C.chunk_arrays(docs))
    assert "Filter (size(" not in groups._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.grp) for r in groups.collect()) == [(1, 0), (1, 1)]


def test_summaries_of_groups_stay_in_their_row(spark):
    """one exchange, no row for each word; rows of one key are one group, null keys are none."""
    from docsift.operators.summarize import extractive_summary
    rows = [(1, 0, "Red cat. The of. Red dog! Blue cat"), (1, 1, "A b. C d"), (1, 1, "Zeta b. C"), (2, 0, None), (2, 1, " .!? the"),
            (None, 0, "Red cat. Red"), (3, 0, ". ".join(f"w{i} w{i % 3}" for i in range(12)))]
    out = extractive_summary(spark.createDataFrame(rows, "doc_id long, grp int, text string"), ["doc_id", "grp"], "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.grp))
    assert [(r.doc_id, r.grp, r.summary) for r in got] == [
        (None, 0, ""), (1, 0, "Red cat. Red dog. Blue cat."), (1, 1, "Zeta b. C d."), (1, 1, "Zeta b. C d."), (2, 0, ""), (2, 1, ""),
        (3, 0, ". ".join(f"w{i} w{i % 3}" for i in range(8)) + ".")]
