"""Approximate nearest neighbours over quantised lists (product quantisation).

1. On a bounded sample (``SAMPLE_ROWS`` of smallest hash) the driver fits the
   centres of about sqrt(N) lists, at most ``MAX_LISTS``, and for every slice of ``SLICE``
   dimensions a codebook of residuals to the centres. Every vector is indexed.
2. A vector is stored as its list, one byte a slice, and the number
   2 c.r + |r|^2 of its centre c and decoded residual r. The squared distance of
   a query q is then |q - c|^2 - 2 q.r plus that number, and q.r is a sum of one table
   value a slice, the tables being the query's alone.
3. A search estimates distances to the vectors that the codes stand for, in the lists that
   its queries probe, keeps ``refine`` candidates a query, and measures only those on the
   original vectors.

Blocks of codes and vectors come to the queries in turn (``sweep``), so that no candidate
is a row; where ids repeat, the codes are scanned in place, and candidates joined to vectors.
Queries beyond ``SWEEP_BLOCKS`` broadcasts' size go in groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators import sweep
from docsift.operators.vectors import (DIST_DIGITS, MAX_BROADCAST_QUERY_FLOATS, MAX_SCAN_QUERIES, _completed, _final_topk, _hits)
from docsift.session import drop_path

SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
CODES = 256
SLICE = 4
REFINE = 120
PROBE_SHARE = 0.75
ROUNDS = 12
QUERY_STEP = 256
SWEEP_BLOCKS = 4  # times MAX_SCAN_QUERIES queries are swept at once


def _means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of a bounded sample; empty centres take the farthest rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, dist = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.nonzero(n == 0)[0]
        if len(empty):
            c[empty] = x[np.argsort(-dist, kind="stable")[:len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    near, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), step):
        d = (x[i:i + step] ** 2).sum(1)[:, None] - 2 * x[i:i + step] @ c.T + (c ** 2).sum(1)
        near[i:i + step] = d.argmin(1)
        dist[i:i + step] = d.min(1)
    return near, dist


@dataclass
class Quantizer:
    """Centres (lists x dims) and codebooks, one (codes x width) a slice of dimensions."""
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    @staticmethod
    def fit(x: np.ndarray, lists: int, width: int = SLICE, seed: int = 7) -> "Quantizer":
        centres = _means(x, lists, seed)
        residual = x - centres[_nearest(x, centres)[0]]
        cuts = [slice(i, min(i + width, x.shape[1])) for i in range(0, x.shape[1], width)]
        return Quantizer(centres, [_means(residual[:, s], CODES, seed + 1 + k) for k, s in enumerate(cuts)], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, 2 c.r + |r|^2) of every row."""
        near, _ = _nearest(x, self.centres)
        c = self.centres[near]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        r = np.empty_like(x)
        for k, (s, book) in enumerate(zip(self.cuts, self.books)):
            codes[:, k] = _nearest(x[:, s] - c[:, s], book)[0]
            r[:, s] = book[codes[:, k]]
        return near, codes, (2 * c * r + r * r).sum(1)

    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        x = self.centres[near].astype(np.float32)
        for k, (s, book) in enumerate(zip(self.cuts, self.books)):
            x[:, s] += book[codes[:, k]]
        return x

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, slices, codes): the products of a query's slices and the codebooks."""
        out = np.zeros((len(q), len(self.cuts), CODES), np.float32)
        for k, (s, book) in enumerate(zip(self.cuts, self.books)):
            out[:, k, :len(book)] = q[:, s] @ book.T
        return out


@dataclass
class QuantizedIndex:
    """codes (id, list_id, code, term), stored partitioned by ``lb``; vectors (id, vec). ``unique``:
    no id is repeated. ``swept``: what was found for queries, which ``search`` and ``measured`` share."""
    quantizer: Quantizer | None
    codes: DataFrame
    vectors: DataFrame
    n_dirs: int
    unique: bool = False
    swept: list = field(default_factory=list)


def usable(base: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of an id and a vector without null or non-finite components."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return base.filter(F.col(id_col).isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)


def build(base: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> QuantizedIndex:
    """Index every usable row of base(id, vec) under ``path``. Vectors of another
    length than that of most sampled rows are left out; an empty base gives an empty index."""
    from docsift.session import cut_lineage
    spark = base.sparkSession
    base = cut_lineage(usable(base).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")), "pq-base")
    n = base.count()
    sample = [np.array(r[0], np.float64) for r in base.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()]
    if not n:
        codes = spark.createDataFrame([], "id long, list_id int, code binary, term float, lb int")
        return QuantizedIndex(None, codes, base, 1)
    sizes = [len(v) for v in sample]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d))
    x = np.stack([v for v in sample if len(v) == dims])
    base = base.filter(F.size("vec") == dims)
    quantizer = Quantizer.fit(x, lists or min(MAX_LISTS, max(1, round(math.sqrt(n)))))
    shared = spark.sparkContext.broadcast(quantizer)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i:i + 4096]
                near, codes, term = shared.value.encode(np.stack(part["vec"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "list_id": near.astype(np.int32),
                                    "code": [c.tobytes() for c in codes], "term": term.astype(np.float32)})

    n_dirs = min(256, len(quantizer.centres))
    coded = (base.mapInPandas(run, "id long, list_id int, code binary, term float")
             .withColumn("lb", F.col("list_id") % n_dirs))
    files = max(1, math.ceil(n / n_dirs / 500_000))
    # a list that holds most vectors is written by several tasks
    (coded.repartition("lb", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("list_id", "id")
     .write.mode("overwrite").partitionBy("lb").parquet(f"{path}/codes"))
    base.write.mode("overwrite").parquet(f"{path}/vectors")
    shared.destroy()
    return QuantizedIndex(quantizer, spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), n_dirs, _unique(base, "id"))


def _unique(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0


def _probes(z: Quantizer, q: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """(|q - c|^2 of every list, lists each query probes)."""
    d = (q ** 2).sum(1)[:, None] - 2 * q @ z.centres.T + (z.centres ** 2).sum(1)
    return d, np.argpartition(d, nprobe - 1, axis=1)[:, :nprobe] if nprobe < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(q), 1))


def _nprobe(z: Quantizer, nprobe: int | None) -> int:
    return min(len(z.centres), nprobe or max(1, math.ceil(len(z.centres) * PROBE_SHARE)))


def candidates(queries: DataFrame, index: QuantizedIndex, refine: int = REFINE, nprobe: int | None = None,
               exclude_self: bool = False) -> DataFrame:
    """(query_id, id, dist): each query's ``refine`` nearest by codes among the lists it probes."""
    spark, z = queries.sparkSession, index.quantizer
    nprobe = _nprobe(z, nprobe)
    dims, sc = z.centres.shape[1], spark.sparkContext
    from docsift.session import cut_lineage
    q = cut_lineage(usable(queries, "query_id").filter(F.size("vec") == dims).select(F.col("query_id").cast("long").alias("query_id"), "vec"), "pq-queries")
    block = max(1, min(MAX_SCAN_QUERIES, MAX_BROADCAST_QUERY_FLOATS // dims))
    blocks = max(1, math.ceil(q.count() / block * 1.2))
    out = None
    for k in range(blocks):
        mine = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else q
        rows = mine.collect()  # about ``block`` queries
        if not rows:
            continue
        qid = np.array([r[0] for r in rows], np.int64)
        qm = np.array([r[1] for r in rows], np.float64)
        probed = sorted({int(x) % index.n_dirs for x in np.unique(_probes(z, qm, nprobe)[1])})
        shared = sc.broadcast((z, qid, qm, nprobe, refine, exclude_self))
        codes = index.codes.filter(F.col("lb").isin(probed)).select("id", "list_id", "code", "term")
        found = codes.mapInPandas(_scan(shared), "query_id long, id long, dist double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= refine).drop("r")


def _scan(shared):
    def run(batches):
        z, qid, qm, nprobe, refine, exclude_self = shared.value
        # at most twice ``refine`` candidates a query are held
        best_id = np.zeros((len(qid), 0), np.int64)
        best_d = np.zeros((len(qid), 0), np.float32)
        for b in batches:
            lists = b["list_id"].to_numpy()
            order = np.argsort(lists, kind="stable")
            ids, lists, terms = b["id"].to_numpy()[order], lists[order], b["term"].to_numpy()[order]
            codes = np.frombuffer(b"".join(b["code"].iloc[order]), np.uint8).reshape(len(b), -1)
            present, start = np.unique(lists, return_index=True)
            ends = np.append(start[1:], len(lists))
            new_id, new_d = [], []
            for i in range(0, len(qid), QUERY_STEP):
                q = qm[i:i + QUERY_STEP]
                to_list, probes = _probes(z, q, nprobe)
                asks = np.zeros((len(q), len(z.centres)), bool)
                asks[np.arange(len(q))[:, None], probes] = True
                tables = z.tables(q)
                d = np.full((len(q), len(ids)), np.inf, np.float32)
                for x, lo, hi in zip(present, start, ends):
                    who = np.nonzero(asks[:, x])[0]
                    if not len(who):
                        continue
                    dot = np.zeros((len(who), hi - lo), np.float32)
                    for k in range(codes.shape[1]):
                        dot += tables[who, k][:, codes[lo:hi, k]]
                    d[who, lo:hi] = to_list[who, x, None] - 2 * dot + terms[lo:hi]
                if exclude_self:
                    d[qid[i:i + QUERY_STEP, None] == ids] = np.inf
                keep = min(refine, d.shape[1])
                at = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                new_id.append(ids[at])
                new_d.append(np.take_along_axis(d, at, 1))
            best_id = np.concatenate([best_id, np.concatenate(new_id)], axis=1)
            best_d = np.concatenate([best_d, np.concatenate(new_d)], axis=1)
            if best_d.shape[1] > refine:
                at = np.argpartition(best_d, refine - 1, axis=1)[:, :refine]
                best_id, best_d = np.take_along_axis(best_id, at, 1), np.take_along_axis(best_d, at, 1)
        some = np.isfinite(best_d)
        yield pd.DataFrame({"query_id": np.repeat(qid, some.sum(1)), "id": best_id[some], "dist": best_d[some].astype(np.float64)})
    return run


def _code_arrays(b: pd.DataFrame) -> tuple:
    codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
    return b["id"].to_numpy(), b["list_id"].to_numpy(), codes, sweep.stack(b["vec"])


def _swept(queries: DataFrame, index: QuantizedIndex, k: int | None, refine: int, nprobe: int | None,
           exclude_self: bool) -> DataFrame | None:
    """(query_id, ids, dists, evaluated): the ``k`` nearest of each query's ``candidates`` and how
    many these are; computed once for the same queries (``k`` None: of any k). None where ids repeat."""
    from docsift.session import cut_lineage
    z, key = index.quantizer, (refine, nprobe, exclude_self)
    if z is None or not index.unique:
        return None
    for theirs, had, most, found in index.swept:
        if theirs is queries and had == key and (k or 0) <= most:
            return found
    spark = queries.sparkSession
    asked = usable(queries, "query_id").filter(F.size("vec") == z.centres.shape[1])
    q = cut_lineage(asked.select(F.col("query_id").cast("long").alias("query_id"), "vec"), "pq-queries")
    if not _unique(q, "query_id"):
        return None
    n = q.count()
    shared = spark.sparkContext.broadcast(z)
    packs, path = sweep.packed(index.codes.select("id", "list_id", "code").join(index.vectors, "id").select("id", "list_id", "code", "vec"),
                               _code_arrays, "pq-packs")
    groups = max(1, math.ceil(n / (SWEEP_BLOCKS * MAX_SCAN_QUERIES)))
    parts = []
    for g in range(groups):  # what a sweep holds of a query is larger than the query
        mine = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) if groups > 1 else q
        parts.append(sweep.swept(mine, math.ceil(n / groups), packs, "ids array<long>, keys array<double>, dists array<double>",
                                 _candidate_kernel(shared, k or 1, refine, _nprobe(z, nprobe), exclude_self), "pq-best",
                                 "ids array<long>, dists array<double>, evaluated long")[1])
    drop_path(spark, path)
    found = spark.read.parquet(*parts)
    index.swept.append((queries, key, k or 1, found))
    return found


def _candidate_kernel(quantizer, k: int, refine: int, nprobe: int, exclude_self: bool):
    """Kernel of ``sweep.swept``: a query's ``refine`` nearest by codes in the lists it probes, each
    measured when it is found; the last block leaves the ``k`` nearest of them."""
    def make(shared, last: bool):
        def run(batches):
            z = quantizer.value
            ids, lists, codes, vecs = (np.concatenate(x) for x in zip(*shared.value))
            block = sweep.Block(ids, vecs, z.decode(lists, codes))
            lists, step = lists[block.ok], 2 * sweep.TILE_ROWS
            for b in batches:
                if not len(b):
                    continue
                q = sweep.Queries(b["query_id"].to_numpy(), sweep.stack(b["vec"]), block)
                found = sweep.Found(len(b), refine)
                if "ids" in b:
                    found.resume(b["ids"], b["dists"], b["keys"], DIST_DIGITS)
                for i in range(0, len(b), sweep.TILE_QUERIES):
                    rows = np.arange(i, min(len(b), i + sweep.TILE_QUERIES))
                    asks = np.zeros((len(rows), len(z.centres)), bool)
                    np.put_along_axis(asks, _probes(z, q.vecs[rows], nprobe)[1], True, axis=1)
                    for j in range(0, len(block.ids), step):
                        products = q.rows[rows] @ block.rows[j:j + step].T
                        limit = found.key[rows, -1]
                        new = np.flatnonzero(np.isinf(limit))
                        products[new] = np.where(asks[new][:, lists[j:j + step]], products[new], -np.inf)
                        qi, bi = sweep.near_pairs(q, rows, products, limit, refine + exclude_self, 0.0)
                        key = q.square[rows[qi]] - 2.0 * products[qi, bi]
                        mine = asks[qi, lists[j + bi]] & (key <= limit[qi])
                        qi, bi, key = rows[qi[mine]], j + bi[mine], key[mine]
                        if exclude_self:
                            other = q.ids[qi] != block.ids[bi]
                            qi, bi, key = qi[other], bi[other], key[other]
                        found.offer(qi, block.ids[bi], key, sweep.squares(q.vecs, qi, block.vecs, bi))
                if last:
                    n = np.isfinite(found.key).sum(1)
                    at = np.lexsort((found.id, np.round(found.dist, DIST_DIGITS)), axis=-1)[:, :k]
                    near, dist = np.take_along_axis(found.id, at, 1), np.take_along_axis(found.dist, at, 1)
                    yield pd.DataFrame({"query_id": b["query_id"], "ids": [x[:m] for x, m in zip(near, n)],
                                        "dists": [x[:m] for x, m in zip(dist, n)], "evaluated": n})
                else:
                    yield b.assign(ids=found.lists(found.id), keys=found.lists(found.key), dists=found.lists(found.dist))
        return run
    return make


def search(queries: DataFrame, index: QuantizedIndex, k: int = 10, refine: int = REFINE, nprobe: int | None = None,
           exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, dist): queries(query_id, vec) by their ``refine`` best codes,
    measured exactly. Queries whose probes hold fewer than ``k`` rows are answered exactly;
    unusable queries have no rows."""
    if index.quantizer is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, dist double")
    asked = usable(queries, "query_id").filter(F.size("vec") == index.quantizer.centres.shape[1])
    best = _swept(queries, index, k, refine, nprobe, exclude_self)
    if best is not None:
        return _completed(_final_topk(_hits(best), k), asked.select("query_id", "vec"), index.vectors, k, exclude_self)
    near = candidates(queries, index, refine, nprobe, exclude_self).select("query_id", "id")
    full = (near.join(index.vectors, "id").join(asked.select("query_id", F.col("vec").alias("q")).dropDuplicates(["query_id"]), "query_id"))
    square = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    dist = F.aggregate(F.zip_with("q", "vec", square), F.lit(0.0), lambda a, x: a + x)
    measured_ = full.select("query_id", "id", F.round(dist, DIST_DIGITS).alias("dist"))
    return _completed(_final_topk(measured_, k), asked.select("query_id", "vec"), index.vectors, k, exclude_self)


def measured(queries: DataFrame, index: QuantizedIndex, refine: int = REFINE, nprobe: int | None = None,
             exclude_self: bool = True) -> DataFrame:
    """(query_id, evaluated): vectors that a search measures exactly."""
    best = _swept(queries, index, None, refine, nprobe, exclude_self)
    if best is not None:
        return best.filter("evaluated > 0").select("query_id", "evaluated")
    return (candidates(queries, index, refine, nprobe, exclude_self).groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("evaluated")))
