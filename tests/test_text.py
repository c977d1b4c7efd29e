import string

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as tx


def py_tokens(text):
    if text is None:
        return None
    out = []
    for t in text.lower().split():
        t = t.strip(string.punctuation)
        if t and t not in tx.STOP_WORDS:
            out.append(t)
    return out


CASES = ["Fence, fence", "--", "it's a dog's life", "tab\tseparated\twords", "", None,
         "ÉCOLE Über Ça", "  leading and trailing  ", "the and of", "A.B. (x) [y]!"]


@pytest.mark.parametrize("text", CASES)
def test_bm25_tokens_match_python(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(tx.bm25_tokens(F.col("text")).alias("t")).first()["t"]
    assert got == py_tokens(text)


def test_first_quoted(spark):
    rows = [("no quotes here",), ('Sure: "x y" ok',), ('""',), ('a "multi\nline" b "second"',), ("  pad  ",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(tx.first_quoted(F.col("s"))).collect()]
    assert got == ["no quotes here", "x y", "", "multi\nline", "pad"]


def test_strip_and_flatten_and_basename(spark):
    df = spark.createDataFrame([("LEAD body\nline", "/a/b/doc_1.pdf.json")], "t string, p string")
    r = df.select(tx.strip_boilerplate(F.col("t"), "LEAD ").alias("a"),
                  tx.flatten_newlines(F.col("t")).alias("b"),
                  tx.source_basename(F.col("p")).alias("c")).first()
    assert r["a"] == "body\nline"
    assert r["b"] == "LEAD body line"
    assert r["c"] == "doc_1.pdf"


def test_stop_word_list_is_the_spark_english_list():
    from pyspark.ml.feature import StopWordsRemover  # noqa: F401 (needs a JVM only when loading)
    assert len(tx.STOP_WORDS) == 181 and len(set(tx.STOP_WORDS)) == 181
