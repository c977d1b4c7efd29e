from conftest import rows
from docsift.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def linked(spark, data):
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}


def test_levels():
    assert quotes.quote_level("> > a") == (2, "a")
    assert quotes.quote_level(">>a") == (2, "a")
    assert quotes.quote_level("a > b") == (0, "a > b")
    body, q = quotes.parsed("Anna wrote:\n> one two\n>> three\n> four\nmine\n")
    assert body == "mine"
    assert q == [(1, "one two"), (2, "three"), (1, "four")]


def test_links_threads_and_depth(spark):
    got = linked(spark, [
        (1, 0, "user", "The first message says this.\nAnd a second line here."),
        (1, 1, "assistant", "On Monday user wrote:\n> the FIRST message   says this.\n> And a second line here.\nMy own answer text."),
        (1, 2, "user", "> > The first message says this.\n> My own answer text.\nThanks a lot for that."),
        (2, 0, "user", "> Thanks a lot for that.\nQuoted from elsewhere today."),
        (3, 0, "user", "> never written by anyone at all\nNo source for this."),
        (3, 1, "user", None), (3, 2, "user", ""), (None, 1, "user", "> My own answer text.\nx"),
    ])
    assert got[1, 1]["body"] == "My own answer text."
    assert (got[1, 1]["reply_conv"], got[1, 1]["reply_turn"]) == (1, 0)
    assert (got[1, 2]["reply_conv"], got[1, 2]["reply_turn"]) == (1, 1)  # the outermost level, not the nested one
    assert got[1, 2]["n_linked"] == 2
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (1, 2)
    assert [got[k]["depth"] for k in [(1, 0), (1, 1), (1, 2), (2, 0)]] == [0, 1, 2, 3]
    assert {(got[k]["thread_conv"], got[k]["thread_turn"]) for k in [(1, 0), (1, 1), (1, 2), (2, 0)]} == {(1, 0)}
    assert got[3, 0]["reply_conv"] is None and got[3, 0]["body"] == "No source for this."
    assert got[3, 1]["body"] == got[3, 2]["body"] == ""
    assert got[None, 1]["reply_conv"] is None
    assert got[2, 0]["chat"] == "<|user|>\nQuoted from elsewhere today.\n<|end|>"


def test_brute_force_long_chain_repeats_and_empty(spark):
    data = [(7, t, "user", (f"> message number {t - 1} is here\n" if t else "") + f"message number {t} is here")
            for t in range(20)]
    got = linked(spark, data)
    assert all(got[7, t]["depth"] == t and got[7, t]["thread_turn"] == 0 for t in range(20))
    twice = spark.createDataFrame([(*r, "") for r in data + data], SCHEMA)
    assert quotes.link_quotes(twice).count() == 40
    assert rows(quotes.link_quotes(twice.limit(0))) == []


def test_short_and_spaceless_passages(spark):
    got = linked(spark, [
        (1, 0, "user", "Yes"), (1, 1, "user", "> yes\nWhy so?"), (1, 2, "user", "> Why so?\n我们明天下午三点在公司门口见面"),
        (1, 3, "user", "> 我们明天下午三点在公司门口见面\n好的"), (1, 4, "user", "> 好的\nok"),
        (2, 0, "user", "> Yes\n> 好的\nsomething else"), (2, 1, "user", "> 我们明天下午三点在公司门口见面\nx"),
    ])
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items()}
    assert [reply[1, t] for t in range(5)] == [(None, None), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert reply[2, 0] == (None, None) and got[2, 0]["n_linked"] == 0  # too short to name another conversation
    assert reply[2, 1] == (1, 2)
