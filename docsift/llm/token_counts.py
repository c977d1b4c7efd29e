"""Token counts by a compiled finite-state transducer.

``Transducer`` turns a BPE vocabulary (a sentencepiece model) into a
deterministic transducer over characters. In every BPE encoding a prefix of
the tokens is the encoding of that prefix of the text, and a sequence of
tokens is an encoding just when each two neighbours are the encoding of their
concatenation. Hence after each character the last token is the longest
vocabulary piece ending there that may follow the last token at its own start.
A state is the piece-trie node of the longest text suffix that begins a piece,
with the last token and relative count at each position such a piece could
start; a transition carries the change in the token count. States and
transitions are compiled when first met, and kept up to a bound.

Texts are counted in chunks. Where no piece spans two neighbouring characters,
the transducer restarts whatever came before, so the state map of a chunk is
(what precedes its first restart, count between first and last restart, what
follows the last). Maps compose associatively; a document's chunk maps are
composed in order, so that no task needs a long text in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import stored, table
from docsift.llm.pack import tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK_CHARS = 32_768
MAX_STATES = 150_000
MEMO_SEGMENTS = 700_000
SPACE = "▁"


class Vocabulary:
    """Pieces with merge ranks (the best merges first) and, for each piece
    that its own merges build, its last merge."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._require(sp)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {x: k for k, x in enumerate(scores)}  # of equal scores the leftmost merges first
        self.rank = {sp.id_to_piece(i): place[sp.get_score(i)] for i in plain}
        self.split: dict[str, tuple[str, str]] = {}
        self.pieces = {p for p in self.rank if len(p) == 1}
        for p in sorted(self.rank, key=len):
            if len(p) > 1 and (parts := self._last_merge(p)):
                self.split[p] = parts
                self.pieces.add(p)

    @staticmethod
    def _require(sp) -> None:
        """The compiler covers BPE with byte fallback, white space kept as
        it is, and a leading space put before the text."""
        probes = {"  a": None, "a  b ": None, "ﬁÅÅ 　 x": None, "\t\n": None}
        for text in probes:
            if sp.decode(sp.encode(text)) != text:
                raise ValueError(f"this model's normalizer changes {text!r}")
        if sp.id_to_piece(sp.encode("a")[0])[0] != SPACE:
            raise ValueError("this model puts no space before the text")

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The merge that completes ``piece``; None if merging doesn't build it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` from characters ends in ``a``, ``b``:
        undo the later of the two neighbours' merges again and again; no merge
        across the border may come before the one undone."""
        rank, split = self.rank, self.split
        before = 1 << 60  # merges across the border of a lower rank would have come first
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            ra = rank[a] if a in split else -1
            rb = rank[b] if b in split else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, split[a][1]
            else:  # at equal ranks b came later, and the merge across stands further left
                before, b = rb + 1, split[b][0]


class Transducer:
    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        pieces = self.vocab.pieces
        self.chars = {p for p in pieces if len(p) == 1}
        self.bigrams = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.starts = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.follow: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}
        self._clear()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"follow": {}, "memo": {}, "ids": {}, "states": [], "edges": []}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    def _clear(self) -> None:
        # State 0: before a segment; no last token, nothing read.
        self.ids = {("", (("", 0),)): 0}
        self.states = [("", (("", 0),))]
        self.edges: list[dict[str, tuple[int, int]]] = [{}]

    def _may_follow(self, a: str, b: str) -> bool:
        ok = self.follow.get((a, b))
        if ok is None:
            if len(self.follow) > MAX_STATES:
                self.follow.clear()
            ok = self.follow[a, b] = self.vocab.may_follow(a, b)
        return ok

    def _compile(self, state: int, ch: str) -> tuple[int, int]:
        """The transition from ``state`` by ``ch``: next state, change in count.
        Where no piece spans the last character and ``ch``, it is that of state
        0; a character that is no piece counts its UTF-8 bytes and leads there."""
        suffix, back = self.states[state]  # back[k]: last token and relative count k characters ago
        if ch not in self.chars:
            edge = self.edges[state][ch] = (0, len(ch.encode()))
            return edge
        if suffix and suffix[-1] + ch not in self.bigrams:
            edge = self.edges[state][ch] = self.edges[0].get(ch) or self._compile(0, ch)
            return edge
        read = suffix + ch
        token = next(t for n in range(min(len(read), len(back)), 0, -1)
                     if (t := read[-n:]) in self.vocab.pieces
                     and (not back[n - 1][0] or self._may_follow(back[n - 1][0], t)))
        change = back[len(token) - 1][1] + 1
        while read not in self.starts:
            read = read[1:]
        # Positions at which no piece can have begun are forgotten, so that more texts share a state.
        now = ((token, 0), *((t, c - change) if read[len(read) - k:] in self.starts else ("", 0)
                             for k, (t, c) in enumerate(back[:len(read)], 1)))
        new = self.ids.setdefault((read, now), len(self.states))
        if new == len(self.states):
            self.states.append((read, now))
            self.edges.append({})
        edge = self.edges[state][ch] = (new, change)
        return edge

    def restarts(self, text: str) -> Iterator[int]:
        """Positions inside ``text`` at which the transducer restarts."""
        return (i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.bigrams)

    def count(self, text: str) -> int:
        """Tokens of ``text`` (spaces written as SPACE), from state 0."""
        state = total = 0
        edges = self.edges
        for ch in text:
            edge = edges[state].get(ch) or self._compile(state, ch)
            state = edge[0]
            total += edge[1]
        if len(self.states) > MAX_STATES:
            self._clear()
        return total

    def _words(self, words: list[str]) -> int:
        """Tokens of segments that a restart ends, most of them seen before."""
        memo, total = self.memo, 0
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            pass
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.count(w)
                if len(memo) < MEMO_SEGMENTS:
                    memo[w] = n
            total += n
        return total

    def state_map(self, chunk: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, restarted): for any text before the chunk. Without
        a restart the chunk is all head."""
        first = next(self.restarts(chunk), None)
        if first is None:
            return chunk, 0, "", False
        last = next(i for i in range(len(chunk) - 1, 0, -1) if chunk[i - 1:i + 1] not in self.bigrams)
        return chunk[:first], self._words(_SEGMENT.findall(chunk, first, last)), chunk[last:], True

    def compose(self, maps: list[tuple[str, int, str, bool]]) -> int:
        """Tokens of a text from its chunks' maps in order: a left fold of the
        associative composition, whose exit state is the open text."""
        total, open_parts = 0, []
        for head, n, tail, restarted in maps:
            open_parts.append(head)
            if restarted:
                total += self.count("".join(open_parts)) + n
                open_parts = [tail]
        return total + self.count("".join(open_parts))


#: Runs of spaces with the word behind them: between them the transducer always restarts.
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")

_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Null and empty texts have no bytes and no tokens; repeated rows give a row
    each; other columns are not read. The vocabulary (bounded by the model
    file) goes to the tasks compiled; states are compiled there.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled(path))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tr = shared.value
        for b in batches:
            got = [tr.state_map(c.replace(" ", SPACE)) for c in b["chunk"]]
            out = b[["doc", "row", "n_bytes", "n_chunks", "nth"]].astype({"doc": "Int64"})
            alone = [k == 1 for k in b["n_chunks"]]  # a text of one chunk is complete at once
            out["head"] = ["" if one else m[0] for m, one in zip(got, alone)]
            out["n"] = [m[1] for m in got]
            out["tail"] = ["" if one else m[2] for m, one in zip(got, alone)]
            out["restarted"] = [m[3] for m in got]
            out["n_tokens"] = [tr.compose([m]) if one else -1 for m, one in zip(got, alone)]
            yield out

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tr = shared.value
        for b in batches:
            n = [tr.compose([(m["head"], m["n"], m["tail"], m["restarted"]) for m in sorted(ms, key=lambda m: m["nth"])])
                 for ms in b["maps"]]
            yield b[["doc", "n_bytes"]].astype({"doc": "Int64"}).assign(n_tokens=n)

    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.when(text == "", text).otherwise(F.concat(F.lit(" "), text))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("spaced") / chunk_chars), F.lit(1)) - 1),
                         lambda k: F.substring(F.col("spaced"), k * chunk_chars + 1, F.lit(chunk_chars)))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"),
                        spaced.alias("spaced"))
            .select("doc", "n_bytes", chunks.alias("chunks"),
                    F.when(F.length("spaced") > chunk_chars, F.expr("uuid()")).alias("row"))
            .select("doc", "row", "n_bytes", F.size("chunks").alias("n_chunks"),
                    F.posexplode("chunks").alias("nth", "chunk")))
    mapped = stored(rows.mapInPandas(maps, "doc long, row string, n_bytes long, n_chunks int, nth int, head string, "
                                           "n long, tail string, restarted boolean, n_tokens long"), "chunk_maps")
    long = (mapped.filter("n_chunks > 1").groupBy("row", "doc", "n_bytes")
            .agg(F.collect_list(F.struct("nth", "head", "n", "tail", "restarted")).alias("maps"))
            .mapInPandas(fold, "doc long, n_bytes long, n_tokens long"))
    return (mapped.filter("n_chunks = 1").select("doc", "n_bytes", "n_tokens").union(long)
            .select(F.col("doc").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
