"""N-gram Jaccard self-join with set-relation skipping.

Documents whose sets of word 5-grams are equal form a class, and one set per
class takes part. Sets link when 100 * |intersection| >= 80 * |union|.

1. A set's prefix (its first |x| - ceil(0.8 |x|) + 1 shingles in one global
   order) must meet the prefix of every set it links with, and in as many
   shingles as ``least_lists`` says. The order puts shingles that are frequent
   anywhere last, so lists stay short; any order is right, so the frequent
   shingles need no exact counts.
2. Index lists hold a prefix shingle's sets in blocks of sizes, and of one head
   each (below). Size and position bounds skip whole blocks: what two sets
   can still share from their positions on must reach what a link needs.
3. Stars: every set of a list block meets that block's first set, never every
   other set of the block. A set's head is the star centre it meets most; sets
   meet across heads only where their heads' blocks share enough lists.
4. Answers are derived between similar sets. For x of head l, |x - l| and |l - x|
   are computed once; for any y of head m, |x & y| lies between
   |l & m| - |l - x| - |m - y| and |l & m| + |x - l| + |y - m|. One comparison
   of two heads so decides most pairs of their sets; only what the bounds
   leave open is compared itself. Pairs that are connected already, need no
   answer, since what is asked for is reachability.

Nothing is capped: a pair is left out only if a bound excludes it or its two
sets are connected already. Shingles and classes are 64-bit hashes of words
(a pair of texts collides with probability 2^-64).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docsift.llm.common import BROADCAST_ROWS, sized_broadcast, stored, table, worker_memo
from docsift.llm.components import components

WORDS = 5
#: A shingle that this many different sets of a batch hold is reported as frequent there.
BATCH_FREQUENT = 2
#: The frequent shingles that the global order puts last: at most so many are broadcast (12 bytes each).
MAX_FREQUENT = 400_000
STARS = 2
#: Index lists that candidates share at least, where their sizes allow so many.
COMMON = 3

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = WORDS, step: int = 1 << 19) -> list[np.ndarray]:
    """``_sets`` of texts of ``step`` characters together (or one longer text) at a
    time, so that a task never holds the words of a whole batch."""
    out, at, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > step:
            out.extend(_sets(texts[at:i], width))
            at, held = i, 0
        held += len(t or "") + 1
    return out + _sets(texts[at:], width)


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each whole text: A-Z are
    lower-cased, words end at ASCII white space; a text of fewer words has its whole
    sequence as the one shingle; no words, an empty set."""
    words, ends = [], []
    for t in texts:
        words.extend((t or "").encode().lower().split())
        ends.append(len(words))
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = h * _M[0]
        for k in range(1, width):
            nxt = np.zeros_like(h)
            nxt[:len(h) - k] = h[k:]
            x = _mix(x + nxt) * _M[0]
        out, at = [], 0
        for end in ends:
            n = end - at
            if n >= width:
                out.append(np.unique(x[at:end - width + 1].view(np.int64)))
            elif n:
                s = np.array([n], dtype=np.uint64)
                for w in h[at:end]:
                    s = _mix(s * _M[0] + w)
                out.append(s.view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            at = end
    return out


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def repeated(x: np.ndarray, least: int = BATCH_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of those that ``x`` holds ``least`` times (2 or more). ``x`` is
    sorted in place, and nothing else of its length is made but a flag for each value."""
    x.sort()
    same = np.zeros(len(x) + 1, dtype=bool)
    same[1:-1] = x[1:] == x[:-1]
    edges = np.flatnonzero(same[1:] != same[:-1])  # a run's first place, then its last
    first, n = edges[::2], edges[1::2] - edges[::2] + 1
    return x[first[n >= least]], n[n >= least]


def _slices(b: pd.DataFrame, rows: int = 1000) -> Iterator[pd.DataFrame]:
    """A batch, few rows at a time, so that a task never holds the sets of all."""
    return (b.iloc[i:i + rows] for i in range(0, len(b), rows))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, unnamed): ``unnamed`` tells the texts of rows without an id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"),
                       F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("unnamed"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc, node, n, unnamed) of every row, node being the class of equal sets;
    (shingle, n) that batches report as frequent)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        for b in batches:
            sets = shingle_sets(list(b["text"]))
            nodes = [_node(s) for s in sets]
            yield pd.DataFrame({"doc": b["doc"].astype("Int64"), "node": nodes, "n": [len(s) for s in sets],
                                "shingle": pd.array([None] * len(b), dtype="Int64"), "unnamed": b["unnamed"].astype("Int64")})
            held = np.concatenate([*{k: s for k, s in zip(nodes, sets)}.values(), np.zeros(0, np.int64)])
            del sets
            shingles, n = repeated(held)
            none = pd.array([None] * len(n), dtype="Int64")
            yield pd.DataFrame({"doc": none, "node": 0, "n": n, "shingle": shingles, "unnamed": none})

    seen = stored(_texts(docs, id_col, text_col).mapInPandas(run, "doc long, node long, n long, shingle long, unnamed long"), "classes")
    counts = stored(seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    # The most frequent, down to the step of counts at which they would be too many; the steps are
    # fewer than a thousand.
    steps = counts.groupBy(F.floor(16 * F.log("n")).cast("int").alias("step")).agg(F.count("*").alias("k")).collect()
    total, least = 0, 1 << 30
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["k"]
        if total > MAX_FREQUENT:
            break
        least = r["step"]
    frequent = counts.filter(F.floor(16 * F.log("n")) >= least)
    return seen.filter("shingle is null").select("doc", "node", "n", "unnamed"), frequent


def prefix_entries(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: (shingle, node, n, pos) of each class's prefix, pos from 0."""
    rows = frequent.toArrow()  # at most MAX_FREQUENT rows of 16 bytes
    keys, counts = (rows.column(c).to_numpy() for c in ("shingle", "n"))
    place = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), dtype=np.int32)
    rank[np.lexsort((keys, counts))] = np.arange(len(keys))  # rarer ones first
    shared = docs.sparkSession.sparkContext.broadcast((keys[place], rank[place]))
    del rows, keys, counts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        keys, rank = shared.value
        seen: set[int] = set()
        for b in chain.from_iterable(map(_slices, batches)):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingle_sets(list(b["text"])):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                n = len(s)
                prefix = n - -(-4 * n // 5) + 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    late = keys[at] == s
                    rare = s[~late]
                    if len(rare) < prefix:
                        s = np.concatenate([rare, s[late][np.argsort(rank[at[late]])]])
                    else:
                        s = rare
                s = s[:prefix]
                for c, v in zip(cols, (s, np.full(len(s), node), np.full(len(s), n), np.arange(len(s)))):
                    c.append(v)
            if len(seen) > 500_000:  # only spares work: the index drops doubles itself
                seen.clear()
            if cols[0]:
                yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(("shingle", "node", "n", "pos"), cols)})

    entries = _texts(docs, id_col, text_col).mapInPandas(run, "shingle long, node long, n int, pos int")
    # Sizes that can link lie in the same block of sizes or a neighbouring one.
    return entries.withColumn("block", F.floor(F.log(1.25, "n") + 1e-9).cast("int"))


def linked(n1: str, n2: str, shared: str):
    """100 * |intersection| >= 80 * |union|."""
    return f"180 * ({shared}) >= 80 * ({n1} + {n2})"


def sizes_link(n1: str, n2: str) -> str:
    return f"100 * least({n1}, {n2}) >= 80 * greatest({n1}, {n2})"


def least_lists(n1: str, n2: str, most: str) -> str:
    """How many prefix shingles linked sets share at least: all but
    |x| - |x & y| of the shingles of the prefix that ends first, and it lies in
    the other's prefix. For blocks: least sizes, and the ``most`` of both."""
    return f"1 - (4 * {most} + 4) div 5 + (4 * ({n1} + {n2}) + 8) div 9"


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored pairs (u, v, ...) of nodes, with u_n, v_n and ``shared`` = |u & v| from
    the whole sets. Of sets, only those of counted few pairs are shuffled. They meet in
    Spark's rows: batches of both sets for Python would lie beside the heap."""
    u = sets.select(F.col("node").alias("u"), F.col("set").alias("u_set"))
    v = sets.select(F.col("node").alias("v"), F.col("set").alias("v_set"))
    if pairs.count() <= BROADCAST_ROWS:
        u, v = (x.join(F.broadcast(pairs.select(k)), k, "left_semi") for x, k in ((u, "u"), (v, "v")))
    return (pairs.join(u, "u").join(v, "v")
            .withColumns({"u_n": F.size("u_set").cast("long"), "v_n": F.size("v_set").cast("long"),
                          "shared": F.size(F.array_intersect("u_set", "v_set")).cast("long")})
            .drop("u_set", "v_set"))


def set_table(docs: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the given nodes, from one document of each class: that of the
    smallest id, or a text of rows without an id where a class has no other. Counted
    few of these go to the texts; else both meet in one shuffle."""
    one = stored(members.join(nodes, "node").groupBy("node")
                 .agg(F.min("doc").alias("doc"), F.min("unnamed").alias("unnamed")), "chosen")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        for b in chain.from_iterable(map(_slices, batches)):
            sets = shingle_sets(list(b["text"]))
            out = pd.DataFrame({"node": b["node"], "set": sets})
            # An id may be on several texts; only the class's own one counts.
            yield out[[_node(s) == k for s, k in zip(sets, b["node"])]]

    texts, sent = _texts(docs, id_col, text_col), F.broadcast if one.count() <= BROADCAST_ROWS else lambda df: df
    rows = (texts.drop("unnamed").join(sent(one.filter("doc is not null").select("node", "doc")), "doc")
            .dropDuplicates(["doc", "node", "text"]).select("node", "text"))
    unnamed = (texts.filter("doc is null").join(sent(one.filter("doc is null").select("node", "unnamed")), "unnamed")
               .dropDuplicates(["unnamed", "node", "text"]).select("node", "text"))
    return stored(rows.unionByName(unnamed).mapInPandas(run, "node long, set array<bigint>"), "sets")


def star_pairs(entries: DataFrame, round_no: int) -> DataFrame:
    """(u, v, lists): each set with the first sets of the blocks of its lists and of
    the blocks of the next smaller sizes, where they share enough lists. Sets of
    most copies and star pairs come first (``weight``), as others tend to derive
    from them; else an order that each round changes."""
    e = entries.withColumn("h", F.xxhash64("node", F.lit(round_no)))
    first = (e.groupBy("shingle", "block").agg(F.max(F.struct("weight", "h", "node", "n")).alias("f"))
             .select("shingle", "block", F.col("f.node").alias("c"), F.col("f.n").alias("c_n")))
    mine = e.select("shingle", F.explode(F.array("block", F.col("block") - 1)).alias("block"), "node", "n")
    return (mine.join(first, ["shingle", "block"]).filter("c <> node").filter(sizes_link("c_n", "n"))
            .groupBy(F.least("c", "node").alias("u"), F.greatest("c", "node").alias("v"),
                     (F.col("c_n") + F.col("n")).alias("both"), F.greatest("c_n", "n").alias("most"))
            .agg(F.count("*").alias("lists"))
            .filter(f"lists >= {least_lists('both', '0', 'most')}").select("u", "v", "lists"))


def followed_heads(stars: DataFrame) -> DataFrame:
    """(node, head): the star centre of most pairs that a set meets, if it
    has more than the set itself. A head that would follow another stands for itself."""
    both = stars.select("u", "v", "lists").union(stars.select("v", "u", "lists"))
    degree = both.groupBy("u").agg(F.count("*").alias("degree"))
    nearest = stored(both.join(degree.toDF("v", "degree"), "v").groupBy(F.col("u").alias("node"))
                     .agg(F.max(F.struct("degree", "lists", "v")).alias("b"))
                     .join(degree.toDF("node", "own"), "node")
                     .filter(F.struct("b.degree", "b.v") > F.struct("own", "node"))
                     .select("node", F.col("b.v").alias("head")), "nearest")
    return stored(nearest.join(nearest.select(F.col("node").alias("head")), "head", "left_anti"), "heads")


def head_pairs(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """(u, v): heads of which some sets could link, by the blocks of their lists.

    Of the shingles that linked sets share, the k-th in the global order lies
    where both still hold what they must share, less k - 1. So blocks meet only
    at positions that the first ``COMMON`` of them can have; sets whose rare
    shingles are all their own meet nowhere, however many sets a list holds."""
    # Stored, as both sides of the join read them.
    blocks = stored(entries.join(sized_broadcast(heads), "node", "left").withColumn("head", F.coalesce("head", "node"))
                    .groupBy("shingle", "block", "head")
                    .agg(F.min("n").alias("n"), F.max("n").alias("most"), F.min("pos").alias("pos")), "blocks")
    cols = ("head", "n", "most", "pos")
    a = blocks.select("shingle", F.explode(F.array("block", F.col("block") - 1)).alias("block"), F.col("block").alias("a_block"),
                      *[F.col(c).alias(f"a_{c}") for c in cols])
    b = blocks.select("shingle", "block", *[F.col(c).alias(f"b_{c}") for c in cols])
    left = f"least(a_most - a_pos, b_most - b_pos) + {COMMON - 1}"
    met = (a.join(b, ["shingle", "block"])
           .filter("a_head <> b_head and (a_block > block or a_head < b_head)")
           .filter("100 * a_most >= 80 * b_n and 100 * b_most >= 80 * a_n")
           .filter(f"180 * ({left}) >= 80 * (a_n + b_n)")
           .groupBy("a_head", "b_head", "a_block", "block")
           .agg(F.count("*").alias("lists"), F.min("a_n").alias("a_n"), F.min("b_n").alias("b_n"),
                F.max(F.greatest("a_most", "b_most")).alias("most"),
                F.max(F.expr("180 * least(a_most - a_pos, b_most - b_pos) - 80 * (a_n + b_n)")).alias("reach")))
    return (met.filter(f"reach >= 0 and lists >= least({COMMON}, {least_lists('a_n', 'b_n', 'most')})")
            .select(F.least("a_head", "b_head").alias("u"), F.greatest("a_head", "b_head").alias("v")).distinct())


def open_pairs(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, sure) of sets in different components that the answers of their
    heads (u, v, shared) leave possible. nodes: (node, head, n, plus, minus, comp)."""
    span = nodes.groupBy("head").agg(F.max("plus").alias("plus"), F.min("n").alias("n"))
    wide = (answers.join(span.toDF("u", "u_plus", "u_n"), "u").join(span.toDF("v", "v_plus", "v_n"), "v")
            .filter(linked("u_n", "v_n", "shared + u_plus + v_plus")))
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns])
    half = (wide.select("u", "v", "shared", "v_plus", "v_n").join(a, F.col("u") == F.col("a_head"))
            .filter(linked("a_n", "v_n", "shared + a_plus + v_plus")).drop("v_plus", "v_n"))
    return (half.join(b, F.col("v") == F.col("b_head"))
            .filter("a_comp <> b_comp").filter(sizes_link("a_n", "b_n"))
            .filter(linked("a_n", "b_n", "shared + a_plus + b_plus"))
            .select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v"),
                    F.expr(linked("a_n", "b_n", "shared - a_minus - b_minus")).alias("sure")).distinct())


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stars: int = STARS) -> tuple[DataFrame, DataFrame]:
    """(members (doc, node, n, unnamed), comps (node, comp)): the classes and their
    connected components; a node without links has no row in comps."""
    members, frequent = classes(docs, id_col, text_col)
    lists = Window.partitionBy("shingle").orderBy("node")
    # One shuffle by shingle drops a class's doubles and shingles of one class.
    entries = (prefix_entries(docs, frequent, id_col, text_col).repartition("shingle")
               .dropDuplicates(["shingle", "node"])
               .withColumns({"prev": F.lag("node").over(lists), "next": F.lead("node").over(lists)})
               .filter("prev is not null or next is not null").drop("prev", "next"))
    entries = stored(entries, "entries")

    copies = members.groupBy("node").agg(F.count("*").alias("weight")).filter("weight > 1")
    weights, met = stored(copies, "weights"), None
    for k in range(stars):
        weighed = entries.join(sized_broadcast(weights), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        found = stored(star_pairs(weighed, k), "stars")
        met = found if met is None else met.unionByName(found)
        ends = met.select(F.col("u").alias("node")).union(met.select("v")).withColumn("weight", F.lit(1))
        weights = stored(copies.union(ends).groupBy("node").agg(F.sum("weight").alias("weight")), "weights")
    met = met.groupBy("u", "v").agg(F.max("lists").alias("lists"))
    heads = followed_heads(met)
    across = stored(head_pairs(entries, heads), "head_pairs")

    pairs = stored(met.select("u", "v").union(across).distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = set_table(docs, members, nodes, id_col, text_col)
    compared = stored(shared_counts(pairs, sets), "compared")
    # Sets that don't link with their head stand for themselves, and meet what they could link with.
    # Their former head's blocks held theirs, so all the sets needed are there.
    link = linked("u_n", "v_n", "shared")
    ends = compared.filter(link).select("u", "v")
    heads = stored(heads.join(ends.union(ends.select("v", "u")).toDF("node", "head"), ["node", "head"], "left_semi"), "heads")
    across = stored(head_pairs(entries, heads), "head_pairs")
    fresh = stored(across.join(compared.select("u", "v"), ["u", "v"], "left_anti"), "fresh_pairs")
    compared = compared.unionByName(stored(shared_counts(fresh, sets), "compared"))
    links = compared.filter(link).select("u", "v")
    comps = components(links)

    # What a set has more and less than its head; a head's own row has neither.
    known = compared.select("u", "v", "u_n", "v_n", "shared").union(compared.select("v", "u", "v_n", "u_n", "shared"))
    near = known.toDF("node", "head", "n", "head_n", "shared").join(heads.select("node", "head"), ["node", "head"])
    alone = (known.select(F.col("u").alias("node"), F.col("u_n").alias("n")).distinct()
             .join(heads.select("node"), "node", "left_anti"))
    info = (near.select("node", "head", "n", (F.col("n") - F.col("shared")).alias("plus"),
                        (F.col("head_n") - F.col("shared")).alias("minus"))
            .union(alone.select("node", F.col("node").alias("head"), "n", F.lit(0).cast("long"), F.lit(0).cast("long"))))
    info = stored(info.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "followers")
    answers = across.join(compared, ["u", "v"]).select("u", "v", "shared")
    possible = stored(open_pairs(answers, info), "open_pairs")
    asked = stored(possible.filter("not sure").select("u", "v").join(compared.select("u", "v"), ["u", "v"], "left_anti"), "asked_pairs")
    checked = shared_counts(asked, sets).filter(linked("u_n", "v_n", "shared"))
    late = stored(possible.filter("sure").select("u", "v").union(checked.select("u", "v")), "late_links")
    if not late.isEmpty():
        comps = components(links.union(late))
    return members, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own
    included. Equal sets link. Null texts and texts without words have no
    shingles and link with nothing (their component is their own id); rows with a
    null id link as any other and so may connect documents, but keep a null component and
    give no id; repeated rows give a row each; other columns are not read; an empty table gives no rows."""
    members, comps = similar_links(docs, id_col, text_col)
    least = (members.filter("n > 0 and doc is not null").groupBy("node").agg(F.min("doc").alias("least"), F.count("*").alias("rows"))
             .join(comps, "node", "left"))
    least = stored(least.filter("rows > 1 or comp is not null").drop("rows").withColumn("comp", F.coalesce("comp", "node")), "least")
    first = least.groupBy("comp").agg(F.min("least").alias("first"))
    # A row for each class that is more than one document; all others are their own component.
    named = stored(least.join(first, "comp").select("node", "first"), "component_ids")
    return (members.join(sized_broadcast(named), "node", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.coalesce("first", "doc")).otherwise(F.col("doc"))
                    .alias("component_id")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
SQL: dict[str, str] = {}
