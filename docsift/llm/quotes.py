"""Chat formatting by quotation linking.

A message's text is parsed into quote levels (leading ``>`` marks). Quoted
passages and the unquoted passages of every message are normalised (lower
case, single spaces) and hashed; joining the hashes finds the message that
a passage comes from: the earliest with it before the quoting one in the same
conversation, else the earliest of all that precedes it in (conv_id, turn)
order. Passages under ``MIN_WORDS`` words ("Yes, agreed") are the same in many
conversations by chance and link within theirs only. A message replies to the source of its longest passage of the outermost
level. Reply chains are followed by doubling, and each message
gets its thread, its depth in it and its text without quotes, so that sorting by
(thread_conv, thread_turn, depth, conv_id, turn) gives conversations in which
every message follows what it replies to.

Originals are aggregates by hash that combine before the shuffle, so a line
that everyone uses costs one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import stored, table

MIN_WORDS = 3
_MARKS = re.compile(r"^(?: {0,3}>)+ ?")
# Letters of scripts that set no spaces: two count as a word.
_SPACELESS = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")


def quote_level(line: str) -> tuple[int, str]:
    """(number of leading quote marks, the line without them)."""
    m = _MARKS.match(line)
    return (m[0].count(">"), line[m.end():]) if m else (0, line)


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def _key(passage: str) -> int:
    return int.from_bytes(hashlib.blake2b(passage.encode(), digest_size=8).digest(), "little", signed=True)


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, [(level, quoted passage), ...]): a passage is a run
    of lines of one level. A line that only announces the quote behind it
    goes with it."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        level, rest = quote_level(line)
        if not level:
            own.append(line)
        else:
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ATTRIBUTION.match(own[-1]):
                    own.pop()
            if level != last:
                quotes.append((level, []))
            quotes[-1][1].append(rest)
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in quotes]


def telling(n: str) -> bool:
    """Whether a normalised passage has ``MIN_WORDS`` words or more."""
    rest, letters = _SPACELESS.subn(" ", n)
    return 2 * len(rest.split()) + letters >= 2 * MIN_WORDS


def units(text: str) -> dict[int, tuple[int, bool]]:
    """Hash to (length, ``telling``) of the passages that may be quoted or recognised: the whole,
    its paragraphs and its lines, all that aren't empty."""
    out: dict[int, tuple[int, bool]] = {}
    for part in [text, *re.split(r"\n\s*\n", text), *text.split("\n")]:
        n = normalised(part)
        if n:
            out[_key(n)] = len(n), telling(n)
    return out


_PARSED = ("body string, n_quotes int, quotes array<struct<level:int,hash:bigint,len:int,telling:boolean>>, "
           "units array<bigint>")


def parse_column(text: Column) -> Column:
    @F.pandas_udf(_PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b:
                body, quotes = parsed(t)
                top = min((level for level, _ in quotes), default=0)
                found = [{"level": level - top, "hash": h, "len": n, "telling": tells}
                         for level, q in quotes for h, (n, tells) in units(q).items()]
                rows.append((body, len(quotes), found, list(units(body))))
            yield pd.DataFrame(rows, columns=["body", "n_quotes", "quotes", "units"])

    return run(text)


def _followed(links: DataFrame) -> DataFrame:
    """links (conv, turn, p_conv, p_turn) -> (conv, turn, t_conv, t_turn, depth): the
    end of each reply chain, by doubling. Parents precede in (conv, turn) order, so chains end."""
    now = stored(links.select("conv", "turn", F.col("p_conv").alias("t_conv"), F.col("p_turn").alias("t_turn"),
                              F.lit(1).alias("depth"), F.lit(True).alias("moved")), "chains")
    while not now.filter("moved").isEmpty():
        ahead = now.select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("t_conv").alias("n_conv"),
                           F.col("t_turn").alias("n_turn"), F.col("depth").alias("more"))
        now = stored(now.join(ahead, ["t_conv", "t_turn"], "left")
                     .select("conv", "turn", F.coalesce("n_conv", "t_conv").alias("t_conv"),
                             F.coalesce("n_turn", "t_turn").alias("t_turn"),
                             (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                             F.col("more").isNotNull().alias("moved")), "chains")
    return now.drop("moved")


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> a row for each: conv_id, turn,
    role, body, n_quotes, n_linked (its quoted passages found elsewhere), reply_conv and reply_turn (null if it
    replies to none), thread_conv, thread_turn, depth, chat.

    Null and empty texts have an empty body and no quotes. Rows with a null
    conv_id or turn link with nothing and are their own thread. Quoted passages
    under ``MIN_WORDS`` words link within their conversation only. Rows that share
    (conv_id, turn) are one message for links to it; each row keeps its own
    body. Other columns are not read; an empty table gives no rows."""
    m = stored(messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                               "role", parse_column(F.col("text")).alias("p"))
               .select("conv", "turn", "role", "p.*").withColumn("row", F.expr("uuid()")), "messages")
    valid = m.filter("conv is not null and turn is not null")
    q = (valid.select("row", "conv", "turn", F.explode("quotes").alias("q"))
         .select("row", "conv", "turn", "q.level", "q.hash", "q.len", "q.telling"))
    wanted = q.select("hash").distinct()
    u = valid.select("conv", "turn", F.explode("units").alias("hash")).join(wanted, "hash", "left_semi")
    here = u.groupBy("conv", "hash").agg(F.min("turn").alias("h_turn"))
    first = u.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("g"))
    found = (q.join(here, ["conv", "hash"], "left").join(first, "hash", "left")
             .withColumn("to", F.when(F.col("h_turn") < F.col("turn"), F.struct("conv", F.col("h_turn").alias("turn")))
                         .when(F.col("telling") & (F.col("g") < F.struct("conv", "turn")), F.col("g")))
             .filter("to is not null"))
    # The longest passage of the outermost level names the message replied to.
    by_row = stored(found.groupBy("row", "conv", "turn").agg(
        F.count_distinct("hash").alias("n_linked"),
        F.max(F.struct((-F.col("level")).alias("outer"), "len", "to")).alias("best")), "replies")
    by_message = (by_row.groupBy("conv", "turn").agg(F.max("best").alias("best"))
                  .select("conv", "turn", F.col("best.to.conv").alias("p_conv"), F.col("best.to.turn").alias("p_turn")))
    chains = _followed(by_message)
    out = (m.join(by_row.select("row", "n_linked", F.col("best.to").alias("to")), "row", "left")
           .join(chains, ["conv", "turn"], "left"))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "body", "n_quotes",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("to.conv").alias("reply_conv"),
        F.col("to.turn").alias("reply_turn"), F.coalesce("t_conv", "conv").alias("thread_conv"),
        F.when(F.col("t_conv").isNull(), F.col("turn")).otherwise(F.col("t_turn")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("chat"))


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


QUERIES = {"op9_quote_linking": op9_quote_linking}
SQL: dict[str, str] = {}
