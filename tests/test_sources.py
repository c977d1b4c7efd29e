import os
import tempfile

from pyspark.sql import functions as F

from docsift.operators import incremental as D
from docsift.operators import lookup as B
from docsift.sources import files as A
from docsift.sources import tables as TB


def test_discover_files_case_insensitive_and_recursive(spark):
    root = tempfile.mkdtemp(prefix="docsift-files-")
    for rel in ["a/x.pdf", "a/b/y.PDF", "c/z.json", "c/w.txt", "d.Json"]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(b"%PDF-1.4")
    got = sorted(os.path.relpath(r.path.replace("file:", ""), root) for r in A.discover_files(spark, root).collect())
    assert got == ["a/b/y.PDF", "a/x.pdf", "c/z.json", "d.Json"]
    plan = A.discover_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_jsonl_both_shapes_and_malformed_line(spark):
    root = tempfile.mkdtemp(prefix="docsift-jsonl-")
    os.makedirs(f"{root}/kind=chunk")
    os.makedirs(f"{root}/kind=summary")
    with open(f"{root}/kind=chunk/part-0.json", "w") as f:
        f.write('{"document_id": 1, "chunk_id": 1, "text": "a"}\n{broken\n{"document_id": 1, "chunk_id": 2, "text": "b"}\n')
    with open(f"{root}/kind=summary/part-0.json", "w") as f:
        f.write('{"text": "s", "document_id": 1, "id": 3, "embedding": 3}\n')
    got = A.read_chunk_lines(spark, root).collect()
    good = sorted((r.chunk_id, r.kind, r.text) for r in got if r._bad is None)
    assert good == [(1, "chunk", "a"), (2, "chunk", "b"), (3, "summary", "s")]
    assert len([r for r in got if r._bad is not None]) == 1


def test_tables_create_drop_insert_delete_update(spark):
    name = "docsift_test_table"
    TB.drop_table(spark, name)
    TB.create_table(spark, name, "id BIGINT, flag BOOLEAN")
    TB.create_table(spark, name, "id BIGINT, flag BOOLEAN")  # idempotent
    TB.insert_rows(spark, name, spark.createDataFrame([(1, False), (2, None), (3, True)], "id long, flag boolean"))
    t = spark.table(name)
    assert t.count() == 3
    # a NULL predicate keeps the row, like SQL DELETE
    kept = sorted(r.id for r in TB.delete_rows(t, F.col("flag")).collect())
    assert kept == [1, 2]
    upd = {r.id: r.flag for r in TB.update_rows(t, "flag", True, "id", 2).collect()}
    assert upd == {1: False, 2: True, 3: True}
    TB.drop_table(spark, name)
    TB.drop_table(spark, name)


def test_index_roundtrip_detects_stale_corpus(spark):
    ct = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string")
    path = tempfile.mkdtemp(prefix="docsift-index-") + "/idx"
    TB.save_index({"t": ct}, ct, path)
    assert TB.load_index(spark, path, ["t"], ct) is not None
    changed = spark.createDataFrame([(1, "a"), (2, "c")], "chunk_id long, text string")
    assert TB.load_index(spark, path, ["t"], changed) is None


def test_name_contains_is_literal(spark):
    names = spark.createDataFrame([("/d/a_b.pdf",), ("/d/a%b.pdf",), ("/d/axb.pdf",), ("/src10/x.pdf",)],
                                  "document_name string")
    wanted = ["a_b", "%", "src1", "x", "/d", ".pdf", "nowhere", "", "/src10/x.pdf and more"]
    needles = spark.createDataFrame([(w,) for w in wanted] + [(None,)], "needle string")
    got = sorted((r.needle, r.document_name) for r in B.name_contains(names, needles).collect())
    assert got == sorted((w, r.document_name) for w in wanted for r in names.collect() if w in r.document_name)


def test_incremental_flags(spark):
    m = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True)], "doc_id long, chunked boolean")
    done = spark.createDataFrame([(1, 3), (2, 0), (3, 0)], "doc_id long, n_chunks long")
    todo = sorted(r.doc_id for r in D.skip_processed(m, done).collect())
    assert todo == [2, 3, 4]
    marked = {r.doc_id: r.chunked for r in D.mark_chunked(m, done).collect()}
    assert marked == {1: True, 2: True, 3: False, 4: True}
    rec = {r.doc_id: r.chunked for r in D.reconcile_flags(m, done).collect()}
    assert rec == {1: True, 2: False, 3: False, 4: False}


def test_update_from_table(spark):
    m = spark.createDataFrame([(1, False), (2, False), (3, True)], "doc_id long, chunked boolean")
    upd = spark.createDataFrame([(2, True), (3, False)], "doc_id long, chunked boolean")
    got = {r.doc_id: r.chunked for r in TB.update_from(m, upd, "doc_id", "chunked").collect()}
    assert got == {1: False, 2: True, 3: False}
