"""Quality rules and language identification."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import language, quality
from docsift.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


def auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality_rules(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert auc([(r.quality, r.score) for r in rows]) > 0.97
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_rules_and_compiled_scores(spark):
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 1.0)
      Predict: 0.0
     Else (feature 1 > 1.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 3.5)
      Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 1.0)
"""
    rules = quality.tree_rules(debug)
    assert rules == [((0, "<=", 2.5),), ((0, "<=", 2.5), (1, "<=", 1.0)), ((0, "<=", 2.5), (1, ">", 1.0)), ((0, ">", 2.5),),
                     ((0, "<=", 3.5), (0, ">", 2.5)), ((1, "<=", 1.0),)]
    e = quality.RuleEnsemble(0.5, [(rules[4], 2.0), (rules[5], -1.0)], ["a", "b"])
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0), (9.0, 2.0)], "a double, b double").select(e.score().alias("s"))
    want = [1 / (1 + 2.718281828459045 ** -m) for m in (1.5, 2.5, 0.5)]
    assert [r.s for r in df.collect()] == pytest.approx(want)


ODD = [(1, None), (2, ""), (3, "?!"), (4, "a" * 300_000), (None, "text"), (1, None), (7, "12 34 _ ²")]


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, t, "x", 9.0) for i, t in ODD], "doc_id long, text string, upper string, score double")
    empty = quality.RuleEnsemble(0.0, [])
    got = quality.scored(docs, empty, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    e = quality.train(docs, none)
    assert e.weighted == [] and quality.scored(docs.limit(0), e, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.scored(docs, quality.train(docs, one), ["doc_id"]).collect())


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = (language.identify(docs, language.learn(docs), ["doc_id", "lang"])
           .withColumn("h", held_out(F.col("doc_id"))).filter("h").collect())
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_backoff_order():
    import numpy as np
    v = lambda *x: np.array(x, dtype="float32")
    m = language.BackoffModel(["a", "b"], {"known": v(-1, -2)}, {5: {"<abcd": v(-3, -4)}, 2: {"zz": v(-5, -6), "<z": v(-7, -8)}, 1: {"q": v(-9, -1)}})
    assert m.word("known").tolist() == [-1, -2]
    assert m.word("abcdef").tolist() == [-3, -4]  # its one known 5-gram, nothing shorter
    assert m.word("zzz").tolist() == [(-5 * 2 - 7) / 3, (-6 * 2 - 8) / 3] or np.allclose(m.word("zzz"), [(-5 * 2 - 7) / 3, (-6 * 2 - 8) / 3])
    assert m.word("q").tolist() == [-9, -1]
    assert m.word("ж").tolist() == [0, 0] and m.word("²") is None


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in ODD], "doc_id long, text string, lang string, lang_pred string")
    got = language.identify(docs, language.learn(docs), ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}  # nothing to learn from
    taught = docs.union(spark.createDataFrame([(k, "hello world again", "en", "") for k in range(9)], docs.schema))
    model = language.learn(taught)
    by = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert by == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (7, "und")}
    assert language.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_a_language_of_one_short_document(spark):
    import random
    rnd = random.Random(3)
    vocab = {x: [f"{x}{a}{b}{c}" for a in "aeiou" for b in "bdfgklmnrst" for c in "aeiou"] for x in ("q", "w")}
    text = lambda x: " ".join(rnd.choices(vocab[x], [1 / (k + 1) for k in range(len(vocab[x]))], k=80))
    rows = [(k, text(x), x) for k, x in enumerate(["q", "w"] * 200)]
    learns = spark.range(1000, 1100).filter(language.training_row(F.col("id"))).first()[0]
    schema = "doc_id long, text string, lang string"
    for rare in ("zorvi plumta hexka", "zorvi plumta hexka zorvi zorvi " + " ".join(vocab["q"][40:90]), "12 34"):
        docs = spark.createDataFrame(rows + [(learns, rare, "rare")], schema)
        asked = spark.createDataFrame(rows + [(9999, "hexka zorvi plumta", "rare")], schema)
        got = language.identify(asked, language.learn(docs), ["doc_id", "lang"]).collect()
        assert all(r.lang == r.lang_pred for r in got if r.lang != "rare")
        assert rare == "12 34" or [r.lang_pred for r in got if r.lang == "rare"] == ["rare"]


def test_language_model_is_small_where_it_is_read():
    import pickle
    import tracemalloc
    langs = ["a", "b", "c", "d", "e"]
    table = {f"w{i}": np.full(5, -i, dtype="float32") for i in range(50_000)}
    blob = pickle.dumps(language.BackoffModel(langs, table, {5: {k: -v for k, v in table.items()}}))
    tracemalloc.start()
    model = pickle.loads(blob)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert list(model.word("w77")) == [-77.0] * 5
    assert held < 15_000_000  # with an array for each key 25 MB
