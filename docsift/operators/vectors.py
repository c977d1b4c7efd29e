"""Vector retrieval.

No (query, vector) pair is ever a row: numpy computes distance matrices and
only the local top-k per query leaves a task. The final top-k is a window
with a partial WindowGroupLimit.

* exact (G2): few queries are broadcast and the base is scanned in place; of
  more, each is met by every block of the base in turn (``sweep``).
* IVF (G3, G4): vectors live in k-means lists; a query meets only the lists
  of its ``nprobe`` nearest centroids. A list that holds a large share of
  all vectors is split into salted sub-blocks, so no task gets a hot list.
* LSH (G5): bucketed random projections; a query meets the vectors of its
  buckets, a block of the base after the other (``sweep``). Queries with fewer than k candidates
  are answered by the exact path, so no result is cut short.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions.arrays import explode_rows
from docsift.operators import sweep
from docsift.operators.broadcast import broadcast_if_small
from docsift.session import drop_path

EMBED_DIM = 256
DIST_DIGITS = 6
Q_BLOCK = 1024
B_BLOCK = 8192

_CAND = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("dist", T.DoubleType()),
])


# ----------------------------------------------------------------- G1 embed
def term_bucket(term, dim: int = EMBED_DIM):
    h = F.md5(term)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def term_sign(term):
    h = F.md5(term)
    return F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, F.lit(1.0)).otherwise(F.lit(-1.0))


def idf_weight(n, df):
    return F.log(F.lit(1.0) + n / df)


def dense_vectors(weights: DataFrame, key: str, dim: int = EMBED_DIM) -> DataFrame:
    """(key, term, w) -> (key, vec array<float>): signed feature hashing of
    the weighted terms, L2-normalised."""
    return _dense(weights.repartition(key).select(key, term_bucket(F.col("term"), dim).alias("b"),
                                 (term_sign(F.col("term")) * F.col("w")).alias("v")), key, dim)


def _dense(values: DataFrame, key: str, dim: int) -> DataFrame:
    """``values(key, b, v)``, summed by bucket and normalised. Callers have
    dealt the rows by key; both aggregates run on that partitioning."""
    s = values.groupBy(key, "b").agg(F.sum("v").alias("v"))
    e = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("e"))
    # Entries sorted by bucket: each gives the zeros of the gap before it and
    # its value, so the work is linear (no per-dimension lookup). Dense vector
    # and its norm are separate projections: referenced inside the normalising
    # lambda they would be re-evaluated per element.
    gap = lambda x, j: x["b"] - F.when(j > 0, F.element_at("e", F.greatest(j, F.lit(1)))["b"]).otherwise(F.lit(-1)) - 1
    filled = F.flatten(F.transform("e", lambda x, j: F.concat(F.array_repeat(F.lit(0.0), gap(x, j)), F.array(x["v"]))))
    dense = e.select(key, filled.alias("d0"))
    dense = dense.select(key, F.concat("d0", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("d0"))).alias("d"))
    normed = dense.select(key, "d", F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)).alias("nm"))
    return normed.select(key, F.transform("d", lambda x: F.when(F.col("nm") > 0, x / F.col("nm"))
                                          .otherwise(F.lit(0.0))).cast("array<float>").alias("vec"))


def embed_corpus(index: DataFrame, n_passages, dim: int = EMBED_DIM, terms: DataFrame | None = None) -> DataFrame:
    """G1 default for the corpus: weights tf * ln(1 + N/df) straight from the
    BM25 index rows (term, chunk_id, tf, df), so nothing is re-tokenised. With
    ``terms`` (term, df) of the index's words, unique, ``index`` needs no df, and
    a word is hashed once, not once per posting."""
    if terms is None:
        w = index.select(F.col("chunk_id"), "term",
                         (F.col("tf") * idf_weight(n_passages, F.col("df"))).alias("w"))
        return dense_vectors(w, "chunk_id", dim)
    hashed = terms.select("term", term_bucket(F.col("term"), dim).alias("b"),
                          (term_sign(F.col("term")) * idf_weight(n_passages, F.col("df"))).alias("_unit"))
    # dealt by passage before the words meet their numbers: what moves is small
    return _dense(index.select("chunk_id", "term", "tf").repartition("chunk_id").join(broadcast_if_small(hashed), "term")
                  .select("chunk_id", "b", (F.col("tf") * F.col("_unit")).alias("v")), "chunk_id", dim)


def embed_queries(qterms: DataFrame, dfs: DataFrame, n_passages, dim: int = EMBED_DIM) -> DataFrame:
    """G1 default for queries: (query_id, term, qn) with the corpus df; words
    unknown to the corpus carry no weight. Queries with none get a zero
    vector, so every query has a row."""
    w = (qterms.join(dfs.select("term", "df"), "term")
         .select("query_id", "term", (F.col("qn") * idf_weight(n_passages, F.col("df"))).alias("w")))
    vecs = dense_vectors(w, "query_id", dim)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    ids = qterms.select("query_id").distinct()
    return (ids.join(vecs, "query_id", "left")
            .select("query_id", F.coalesce(F.col("vec"), zero).alias("vec")))


def sparse_rows(vecs: DataFrame, key: str) -> DataFrame:
    """(key, bucket, value) for the non-zero coordinates (for inspection and
    the SQL check)."""
    return (vecs.select(key, F.posexplode("vec").alias("bucket", "v"))
            .select(key, F.col("bucket").cast("int").alias("bucket"),
                    F.round(F.col("v").cast("double"), DIST_DIGITS).alias("value"))
            .filter(F.col("value") != 0))


# ------------------------------------------------------------ block kernel
PAIR_BATCH = 1_000_000


def _empty_cand() -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"),
                         "dist": pd.Series([], dtype="float64")})


def _matched_topk_kernel(k: int, exclude_self: bool, match: list[str]):
    """Kernel for keyed search (IVF lists, LSH buckets): a group holds many
    keys; a query meets only the base rows with its key. Pairs are formed
    per batch of keys (at most PAIR_BATCH pairs at a time), deduplicated per
    (query, id), and only the local top-k per query (ties kept) is emitted."""
    def fn(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(bpdf) == 0:
            return _empty_cand()
        q = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64)
        b = np.stack(bpdf["bvec"].to_numpy()).astype(np.float64)
        qn, bn = (q * q).sum(1), (b * b).sum(1)
        qid_all = qpdf["query_id"].to_numpy(dtype=np.int64)
        bid_all = bpdf["id"].to_numpy(dtype=np.int64)
        qk = qpdf[match].assign(qi=np.arange(len(qpdf)))
        bk = bpdf[match].assign(bi=np.arange(len(bpdf)))
        qc = qk.groupby(match).size().rename("nq")
        bc = bk.groupby(match).size().rename("nb")
        cost = pd.concat([qc, bc], axis=1, join="inner")
        cost = (cost["nq"] * cost["nb"]).sort_index()
        parts = []
        # a key whose pairs alone exceed the batch is searched densely in
        # query slices (bounded matrix), never as one merge
        big = cost[cost > PAIR_BATCH]
        if len(big):
            qpos, bpos = qk.groupby(match).indices, bk.groupby(match).indices
            qi_all, bi_all = qk["qi"].to_numpy(), bk["bi"].to_numpy()
            for key in big.index:
                qi, bi = qi_all[qpos[key]], bi_all[bpos[key]]
                parts.append(_local_topk_sliced(q[qi], qid_all[qi], b[bi], bid_all[bi], k, exclude_self))
            cost = cost[cost <= PAIR_BATCH]
        batch_no = (cost.cumsum() // PAIR_BATCH).rename("_batch").reset_index()
        qk = qk.merge(batch_no, on=match)
        bk = bk.merge(batch_no, on=match)
        for _, qb in qk.groupby("_batch"):
            bb = bk[bk["_batch"] == qb["_batch"].iloc[0]]
            pr = qb.merge(bb, on=match)
            if len(pr) == 0:
                continue
            qi, bi = pr["qi"].to_numpy(), pr["bi"].to_numpy()
            d = qn[qi] + bn[bi] - 2.0 * np.einsum("ij,ij->i", q[qi], b[bi])
            parts.append(pd.DataFrame({"query_id": qid_all[qi], "id": bid_all[bi],
                                       "dist": np.maximum(d, 0.0) + 0.0}))
        if not parts:
            return _empty_cand()
        c = pd.concat(parts, ignore_index=True).drop_duplicates(["query_id", "id"])
        if exclude_self:
            c = c[c["query_id"] != c["id"]]
        c = c.assign(_r=np.round(c["dist"].to_numpy(), DIST_DIGITS)).sort_values(["query_id", "_r", "id"])
        c = c[c.groupby("query_id").cumcount() < k]
        return c[["query_id", "id", "dist"]].reset_index(drop=True)
    return fn


def _topk_kernel(k: int, exclude_self: bool):
    def fn(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(bpdf) == 0:
            return _empty_cand()
        q = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64)
        b = np.stack(bpdf["bvec"].to_numpy()).astype(np.float64)
        return _local_topk_sliced(q, qpdf["query_id"].to_numpy(dtype=np.int64), b,
                                  bpdf["id"].to_numpy(dtype=np.int64), k, exclude_self)
    return fn


def _cogroup_topk(qk: DataFrame, bk: DataFrame, keys: list[str], k: int,
                  exclude_self: bool = False) -> DataFrame:
    # Distinct names per side: both sides may come from one DataFrame (a
    # k-NN graph), and cogroup must not see the same attribute twice.
    # Keys get one type on both sides: equal values must hash alike, or the
    # two sides of a group land in different partitions.
    q = qk.select(*[F.col(c).cast(bk.schema[c].dataType).alias(c) for c in keys],
                  F.col("query_id").alias("query_id"), F.col("vec").alias("qvec"))
    b = bk.select(*[F.col(c).alias(c) for c in keys], F.col("id").alias("id"), F.col("vec").alias("bvec"))
    return (q.groupBy(*keys).cogroup(b.groupBy(*keys))
            .applyInPandas(_topk_kernel(k, exclude_self), _CAND))


def _final_topk(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("dist", DIST_DIGITS).asc(), F.col("id").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", F.round("dist", DIST_DIGITS).alias("dist")))


def _parallelism(spark) -> int:
    return max(1, int(spark.sparkContext.defaultParallelism))


def _local_topk_rows(q: np.ndarray, qid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int,
                     exclude_self: bool) -> pd.DataFrame:
    """Local top-k per query (exact ties at the k-th distance kept) of one
    query block against one base block."""
    d = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (q @ b.T)
    d = np.maximum(d, 0.0) + 0.0
    if exclude_self:
        d[qid[:, None] == bid[None, :]] = np.inf
    dr = np.round(d, DIST_DIGITS)
    kk = min(k, d.shape[1])
    if kk == 1 and not exclude_self:  # all queries at once; base rows by id, so ties go to the smaller
        order = np.argsort(bid, kind="stable")
        best = order[np.argmin(dr[:, order], axis=1)]
        return pd.DataFrame({"query_id": qid.astype(np.int64), "id": bid[best].astype(np.int64),
                             "dist": d[np.arange(len(d)), best]})
    kth = np.partition(dr, kk - 1, axis=1)[:, kk - 1]
    out_q, out_b, out_d = [], [], []
    for i in range(d.shape[0]):
        if not np.isfinite(kth[i]):
            idx = np.nonzero(np.isfinite(dr[i]))[0]
        else:
            idx = np.nonzero(dr[i] <= kth[i])[0]
        if len(idx) > kk:
            idx = idx[np.lexsort((bid[idx], dr[i, idx]))[:kk]]
        out_q.append(np.full(len(idx), qid[i]))
        out_b.append(bid[idx])
        out_d.append(d[i, idx])
    if not out_q:
        return _empty_cand()
    return pd.DataFrame({"query_id": np.concatenate(out_q).astype(np.int64),
                         "id": np.concatenate(out_b).astype(np.int64),
                         "dist": np.concatenate(out_d)})


MAX_DIST_ELEMS = 1 << 22  # distance-matrix cells held at once by one kernel call


def _local_topk_sliced(q: np.ndarray, qid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int,
                       exclude_self: bool) -> pd.DataFrame:
    """``_local_topk_rows`` over query slices, so the distance matrix never
    exceeds MAX_DIST_ELEMS cells (a query's answer depends on its row only,
    so slicing is exact)."""
    if len(q) == 0 or len(b) == 0:
        return _empty_cand()
    step = max(1, MAX_DIST_ELEMS // max(1, len(b)))
    if step >= len(q):
        return _local_topk_rows(q, qid, b, bid, k, exclude_self)
    parts = [_local_topk_rows(q[i:i + step], qid[i:i + step], b, bid, k, exclude_self)
             for i in range(0, len(q), step)]
    return pd.concat(parts, ignore_index=True)


def _keep_topk(c: pd.DataFrame, k: int) -> pd.DataFrame:
    c = c.assign(_r=np.round(c["dist"].to_numpy(), DIST_DIGITS)).sort_values(["query_id", "_r", "id"])
    return c[c.groupby("query_id").cumcount() < k][["query_id", "id", "dist"]]


def _scan_kernel(bq, k: int, exclude_self: bool):
    """mapInPandas over base partitions: the broadcast query matrix meets
    each Arrow batch of base rows; one partition emits at most k rows per
    query."""
    def fn(batches):
        qid, q = bq.value
        best = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            b = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            c = _local_topk_sliced(q, qid, b, pdf["id"].to_numpy(dtype=np.int64), k, exclude_self)
            best = c if best is None else _keep_topk(pd.concat([best, c], ignore_index=True), k)
        if best is not None and len(best):
            yield best.reset_index(drop=True)
    return fn


MAX_BROADCAST_QUERY_FLOATS = 1 << 22  # 4M vector components (16 MB as float32) per broadcast
MAX_SCAN_QUERIES = 1 << 14


# ------------------------------------------------------------------ G2
ROUND_SLACK = 10.0 ** -DIST_DIGITS  # distances as near as this may be equal once rounded


def _vector_arrays(b: pd.DataFrame) -> tuple:
    return b["id"].to_numpy(dtype=np.int64), sweep.stack(b["vec"])


def _best_rows(b: pd.DataFrame, found: sweep.Found, last: bool, **more) -> pd.DataFrame:
    new = {"ids": found.lists(found.id), "dists": found.lists(found.dist), **more}
    return pd.DataFrame({"query_id": b["query_id"], **new}) if last else b.assign(**new)


def _nearest_kernel(k: int, exclude_self: bool):
    """Kernel of ``sweep.swept``: queries and all rows of a block, by matrix products of tiles."""
    def make(shared, last: bool):
        def run(batches):
            ids, vecs = (np.concatenate(x) for x in zip(*shared.value))
            block = sweep.Block(ids, vecs)
            wanted = (k + exclude_self) * block.repeats
            for b in batches:
                if not len(b):
                    continue
                q = sweep.Queries(b["query_id"].to_numpy(dtype=np.int64), sweep.stack(b["vec"]), block)
                found = sweep.Found(len(b), k)
                if "ids" in b:
                    found.resume(b["ids"], b["dists"], None, DIST_DIGITS)
                for i in range(0, len(b), sweep.TILE_QUERIES):
                    rows = np.arange(i, min(len(b), i + sweep.TILE_QUERIES))
                    for j in range(0, len(block.ids), sweep.TILE_ROWS):
                        products = q.rows[rows] @ block.rows[j:j + sweep.TILE_ROWS].T
                        qi, bi = sweep.near_pairs(q, rows, products, found.key[rows, -1], wanted, ROUND_SLACK)
                        qi, bi = rows[qi], j + bi
                        if exclude_self:
                            other = q.ids[qi] != block.ids[bi]
                            qi, bi = qi[other], bi[other]
                        dist = sweep.squares(q.vecs, qi, block.vecs, bi)
                        found.offer(qi, block.ids[bi], np.round(dist, DIST_DIGITS), dist)
                yield _best_rows(b, found, last)
        return run
    return make


def _hits(best: DataFrame) -> DataFrame:
    """(query_id, id, dist) of the lists that a sweep found."""
    return best.select("query_id", F.explode(F.arrays_zip("ids", "dists")).alias("h")).select("query_id", F.col("h.ids").alias("id"), F.col("h.dists").alias("dist"))


def _no_hits(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, id long, dist double")


def knn_exact(queries: DataFrame, base: DataFrame, k: int = 10, exclude_self: bool = False,
              q_block: int = Q_BLOCK, b_block: int = B_BLOCK,
              n_queries: int | None = None, n_base: int | None = None,
              method: str = "auto") -> DataFrame:
    """Exact top-k by squared L2: queries(query_id, vec) x base(id, vec) ->
    (query_id, rank, id, dist).

    * ``scan`` (a query batch of checked, bounded size): the query matrix is
      broadcast and every base partition is scanned in place by
      ``mapInPandas`` -- the base is never shuffled.
    * ``blocks`` (any size): every query is met by each block of the base, which
      come to it in turn (``sweep``); neither side is copied or shuffled by block.
    * ``cogroup`` (a small base of any size): both sides get block keys and
      ``cogroup`` pairs each query block with each base block once."""
    spark = queries.sparkSession
    if method == "auto":
        # the scan path's bounded collect doubles as the size check
        method = "scan" if (n_queries is None or n_queries <= MAX_SCAN_QUERIES) else "blocks"
    if method == "scan":
        rows = queries.select("query_id", "vec").limit(MAX_SCAN_QUERIES + 1).collect()
        dim = len(rows[0][1]) if rows else 0
        if len(rows) <= MAX_SCAN_QUERIES and len(rows) * dim <= MAX_BROADCAST_QUERY_FLOATS:
            if not rows:
                return spark.createDataFrame([], "query_id long, rank int, id long, dist double")
            qid = np.array([r[0] for r in rows], dtype=np.int64)
            qm = np.array([r[1] for r in rows], dtype=np.float64)
            bq = spark.sparkContext.broadcast((qid, qm))
            cand = base.select("id", "vec").mapInPandas(_scan_kernel(bq, k, exclude_self), _CAND)
            return _final_topk(cand, k)
    nq = queries.count() if n_queries is None else n_queries
    if method != "cogroup":
        packs, path = sweep.packed(base.select(F.col("id").cast("long").alias("id"), "vec"), _vector_arrays, "knn-packs")
        best, _ = sweep.swept(queries.select(F.col("query_id").cast("long").alias("query_id"), "vec"), nq, packs,
                              "ids array<long>, dists array<double>", _nearest_kernel(k, exclude_self), "knn-best")
        drop_path(spark, path)
        return _final_topk(_hits(best) if best is not None else _no_hits(spark), k)
    nb = base.count() if n_base is None else n_base
    qb = max(1, math.ceil(nq / q_block))
    bb = max(1, math.ceil(nb / b_block), min(_parallelism(spark), max(1, nb // 64)))
    qk = (queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int"))
          .withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(bb - 1)))))
    bk = (base.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(bb)).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    return _final_topk(_cogroup_topk(qk, bk, ["qb", "bb"], k, exclude_self), k)


MAX_CENTROIDS = 1 << 14  # lists whose matrix is broadcast; more are met in blocks


def _matrix(small: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of a table of at most MAX_CENTROIDS rows, None for a larger one."""
    rows = small.select("id", "vec").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        return None
    return (np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64))


def _in_blocks(queries: DataFrame, small: DataFrame, k: int) -> DataFrame:
    """Top-k against more centroids than a broadcast takes. Blocks of queries are
    as large as a scan's, so that the centroids are copied to few of them."""
    return knn_exact(queries, small, k, method="cogroup", q_block=MAX_SCAN_QUERIES)


def knn_small_base(queries: DataFrame, small: DataFrame, k: int) -> DataFrame:
    """Top-k of every query against a small base (centroids). The base matrix
    of at most MAX_CENTROIDS rows is broadcast and the queries are scanned in place;
    each query's whole answer is computed in one task, so no shuffle and no
    global window are needed. A larger base meets the queries block by block."""
    matrix = _matrix(small)
    if matrix is None:
        return _in_blocks(queries, small, k)
    bb = queries.sparkSession.sparkContext.broadcast(matrix)

    def fn(batches):
        ids, b = bb.value
        for pdf in batches:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            q = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            c = _local_topk_sliced(q, pdf["query_id"].to_numpy(dtype=np.int64), b, ids, k, False)
            c = _keep_topk(c, k)
            c = c.assign(rank=c.groupby("query_id").cumcount().astype("int32") + 1,
                         dist=np.round(c["dist"].to_numpy(), DIST_DIGITS))
            yield c[["query_id", "rank", "id", "dist"]]
    return queries.select("query_id", "vec").mapInPandas(fn, "query_id long, rank int, id long, dist double")


def vectors_from_table(emb: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return emb.select(F.col(id_col).cast("bigint").alias("id"), F.col("embedding").alias("vec"))


# ------------------------------------------------------------- G3, G4 IVF
def ivf_train(base: DataFrame, nlist: int = 100, seed: int = 7, max_iter: int = 20):
    """K-means centroids with Spark ML (distributed Lloyd iterations).
    Returns (centroids(list_id, vec), model)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = base.select("id", array_to_vector(F.col("vec")).alias("features"))
    if nlist > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} lists")
    k = int(min(nlist, max(1, feats.count())))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    spark = base.sparkSession
    # k rows (k = nlist, a parameter): the centroid table is bounded.
    cent = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "list_id long, vec array<double>")
    return cent, model


def seeded_centroids(base: DataFrame, every: int) -> DataFrame:
    """(list_id, vec): every ``every``-th vector by id as a list's centre -- no
    training, the same on every run. Their number grows with the base."""
    return base.filter(F.col("id") % every == 0).select(F.col("id").alias("list_id"), "vec")


def ivf_assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, vec, list_id) -- every vector to its nearest centroid, in
    place: a matrix of at most MAX_CENTROIDS centroids is broadcast, the base isn't
    shuffled or joined. More centroids meet the vectors in blocks."""
    cent = centroids.select(F.col("list_id").alias("id"), "vec")
    matrix = _matrix(cent)
    if matrix is None:
        from docsift.session import cut_lineage
        # ids may repeat, so each row has a key of its own, written with it
        keyed = cut_lineage(base.select("id", "vec", F.monotonically_increasing_id().alias("query_id")), "ivf-rows")
        near = _in_blocks(keyed.select("query_id", "vec"), cent, 1).select("query_id", F.col("id").alias("list_id"))
        return keyed.join(near, "query_id").select("id", "vec", "list_id")
    bb = base.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("long")
    def nearest(vec: pd.Series) -> pd.Series:
        ids, b = bb.value
        if not len(vec):
            return pd.Series([], dtype="int64")
        q = np.stack(vec.to_numpy()).astype(np.float64)
        return _local_topk_sliced(q, np.arange(len(q)), b, ids, 1, False)["id"].reset_index(drop=True)

    return base.select("id", "vec", nearest("vec").alias("list_id"))


def _completed(res: DataFrame, queries: DataFrame, base: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Queries whose probes held fewer than ``k`` rows are answered exactly,
    so every query has min(k, rows of the base) hits."""
    from docsift.session import cut_lineage
    approx = cut_lineage(res, "ann-approx")
    full = approx.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.join(full.select("query_id"), "query_id", "left_anti")
    return (approx.join(full.select("query_id"), "query_id", "left_semi")
            .unionByName(knn_exact(short, base, k, exclude_self)))


def _salted(base_keyed: DataFrame, key: str, max_block: int) -> tuple[DataFrame, DataFrame]:
    """Split every key group into ceil(size/max_block) salted sub-blocks.
    Returns (base with 'salt', sizes(key, n_salt))."""
    sizes = (base_keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
             .select(key, F.greatest(F.lit(1), F.ceil(F.col("n") / max_block)).cast("int").alias("n_salt")))
    b = (base_keyed.join(sizes, key)
         .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("n_salt")).cast("int")))
    return b, sizes


def ivf_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int = 10,
               nprobe: int = 8, exclude_self: bool = False, max_block: int = B_BLOCK) -> DataFrame:
    """Probe the ``nprobe`` nearest lists, exact distances inside them."""
    probes = knn_small_base(queries, centroids.select(F.col("list_id").alias("id"), "vec"), k=nprobe)
    from docsift.session import cut_lineage
    assigned = cut_lineage(assigned, "ivf-assigned")  # read for the sizes, the lists and the short queries
    b, sizes = _salted(assigned, "list_id", max_block)
    qk = (queries.join(probes.select("query_id", F.col("id").alias("list_id")), "query_id")
          .join(sizes, "list_id")
          .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1))))
    # one group per (list, salt): at most about max_block base rows, however large the base
    cand = _cogroup_topk(qk, b, ["list_id", "salt"], k, exclude_self)
    return _completed(_final_topk(cand, k), queries, assigned.select("id", "vec"), k, exclude_self)


@dataclass
class IvfIndex:
    """A stored IVF index: centroids (list_id, vec), the vectors with their
    list and salt, written partitioned by ``lb`` = list_id % n_dirs, and the
    per-list salt counts. A search reads only the directories of the lists
    its queries probe."""
    centroids: DataFrame
    lists: DataFrame
    sizes: DataFrame
    n_dirs: int


def ivf_build(base: DataFrame, path: str, nlist: int = 100, max_block: int = B_BLOCK,
              max_dirs: int = 1024, max_iter: int = 10) -> IvfIndex:
    spark = base.sparkSession
    cent, _ = ivf_train(base, nlist, max_iter=max_iter)
    cent.write.mode("overwrite").parquet(f"{path}/centroids")
    cent = spark.read.parquet(f"{path}/centroids")
    from docsift.session import cut_lineage
    assigned = cut_lineage(ivf_assign(base, cent), "ivf-assigned")
    b, sizes = _salted(assigned, "list_id", max_block)
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    n_dirs = int(min(max_dirs, max(1, nlist)))
    # (list, salt) spreads a hot list over several writer tasks and files
    (b.select("id", "vec", "list_id", "salt", (F.col("list_id") % n_dirs).cast("int").alias("lb"))
     .repartition("lb", "salt").write.mode("overwrite").partitionBy("lb").parquet(f"{path}/lists"))
    return IvfIndex(cent, spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/sizes"), n_dirs)


def ivf_query(queries: DataFrame, ivf: IvfIndex, k: int = 10, nprobe: int = 8,
              exclude_self: bool = False) -> DataFrame:
    """Search a stored IVF index. The probed list set is bounded by nlist;
    its directories are the only ones read (static partition pruning)."""
    probes = knn_small_base(queries, ivf.centroids.select(F.col("list_id").alias("id"), "vec"), k=nprobe)
    probes = probes.select("query_id", F.col("id").alias("list_id"))
    dirs = sorted({int(r[0]) % ivf.n_dirs for r in probes.select("list_id").distinct().collect()})
    lists = ivf.lists.filter(F.col("lb").isin(dirs))
    qk = (queries.join(probes, "query_id").join(ivf.sizes, "list_id")
          .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1))))
    cand = _cogroup_topk(qk, lists, ["list_id", "salt"], k, exclude_self)
    return _completed(_final_topk(cand, k), queries, ivf.lists.select("id", "vec"), k, exclude_self)


# ----------------------------------------------------------------- G5 LSH
def lsh_search(queries: DataFrame, base: DataFrame, k: int = 10, bucket_length: float = 0.3,
               and_width: int = 6, tables: int = 60, seed: int = 11, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Approximate top-k by bucketed random projections (Spark ML's
    BucketedRandomProjectionLSH supplies ``and_width * tables`` projections;
    every ``and_width`` of them form one bucket key, and a vector lives in
    ``tables`` buckets). Returns (result, stats(query_id, evaluated)), where
    ``evaluated`` counts distance computations. Queries whose buckets give
    fewer than k candidates are answered exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    bf = base.select("id", array_to_vector(F.col("vec")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                        bucketLength=bucket_length, numHashTables=and_width * tables,
                                        seed=seed).fit(bf)

    def hashed(df, idc):
        h = model.transform(df.select(F.col(idc).cast("long").alias(idc), "vec", array_to_vector(F.col("vec")).alias("features")))
        return h.select(idc, "vec", F.transform("hashes", lambda v: vector_to_array(v)[0].cast("bigint")).alias("hs"))

    spark = queries.sparkSession
    packs, path = sweep.packed(hashed(base, "id"), _hash_arrays, "lsh-packs")
    vec = queries.schema["vec"].dataType.simpleString()
    asked = hashed(queries, "query_id").mapInPandas(_hash_bytes, f"query_id long, vec {vec}, hs binary")
    best, _ = sweep.swept(asked, queries.count(), packs, "ids array<long>, dists array<double>, evaluated long",
                          _bucket_kernel(k, exclude_self, and_width, tables), "lsh-best")
    drop_path(spark, path)
    if best is None:
        none = queries.select("query_id", F.lit(0).cast("long").alias("evaluated")).distinct()
        return _completed(_final_topk(_no_hits(spark), k), queries, base, k, exclude_self), none
    # rows of one query id are one query
    stats = best.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))
    cand = _hits(best).groupBy("query_id", "id").agg(F.min("dist").alias("dist"))
    return _completed(_final_topk(cand, k), queries, base, k, exclude_self), stats


def _narrow(column: pd.Series) -> np.ndarray:
    """Hash values in the smallest whole numbers that hold them."""
    h = sweep.stack(column)
    low, high = int(h.min(initial=0)), int(h.max(initial=0))
    return h.astype(np.result_type(np.min_scalar_type(min(low, -1)), np.min_scalar_type(min(-high - 1, -1))))


def _hash_arrays(b: pd.DataFrame) -> tuple:
    return (*_vector_arrays(b), _narrow(b["hs"]))


def _hash_bytes(batches):
    for b in batches:
        if len(b):
            yield b.assign(hs=[h.tobytes() for h in _narrow(b["hs"])])


def _hash_matrix(column: pd.Series, width: int) -> np.ndarray:
    rows = column.to_numpy()
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), f"i{len(rows[0]) // width}").reshape(len(rows), width)
    return np.stack([np.frombuffer(r, f"i{len(r) // width}").astype(np.int64) for r in rows])


class _Buckets:
    """The buckets of one table of hashes over a block: equal hashes have equal codes, and only those."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes.astype(np.int64)
        self.low, self.high = self.hashes.min(0), self.hashes.max(0)
        spans = [int(b) - int(a) + 1 for a, b in zip(self.low, self.high)]
        self.plain = math.prod(spans) < 1 << 62
        if self.plain:
            self.by = np.array([math.prod(spans[i + 1:]) for i in range(len(spans))], np.int64)
            self._sorted((self.hashes - self.low) @ self.by, math.prod(spans))

    def _sorted(self, codes: np.ndarray, most: int) -> None:
        codes = codes.astype(np.int16 if most < 1 << 15 else np.int64)  # short numbers are sorted much faster
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        self.codes, self.start, self.size = np.unique(codes[self.order], return_index=True, return_counts=True)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row's bucket, whether the block has it)."""
        h = hashes.astype(np.int64)
        if self.plain:
            inside = ((h >= self.low) & (h <= self.high)).all(1)
            codes = np.where(inside, (np.clip(h, self.low, self.high) - self.low) @ self.by, -1)
        else:
            codes = np.unique(np.concatenate([self.hashes, h]), axis=0, return_inverse=True)[1].ravel()
            self._sorted(codes[:len(self.hashes)], 1 << 62)
            codes = codes[len(self.hashes):]
        at = np.searchsorted(self.codes, codes).clip(max=len(self.codes) - 1)
        return at, self.codes[at] == codes


def _bucket_kernel(k: int, exclude_self: bool, width: int, tables: int):
    """Kernel of ``sweep.swept``: queries and the rows of a block that share a bucket with them,
    by a matrix product for each bucket; those of few pairs are measured together."""
    def make(shared, last: bool):
        def run(batches):
            ids, vecs, hashes = (np.concatenate(x) for x in zip(*shared.value))
            block = sweep.Block(ids, vecs)
            hashes = hashes[block.ok]
            wanted = (k + exclude_self) * block.repeats
            buckets = [_Buckets(hashes[:, t * width:(t + 1) * width]) for t in range(tables if len(hashes) else 0)]
            for b in batches:
                if not len(b):
                    continue
                q = sweep.Queries(b["query_id"].to_numpy(dtype=np.int64), sweep.stack(b["vec"]), block)
                found = sweep.Found(len(b), k, distinct=True)
                evaluated = np.zeros(len(b), np.int64)
                if "ids" in b:
                    found.resume(b["ids"], b["dists"], None, DIST_DIGITS)
                    evaluated += b["evaluated"].to_numpy()
                asked = _hash_matrix(b["hs"], width * tables)
                for t, table in enumerate(buckets):
                    at, has = table.places(asked[:, t * width:(t + 1) * width])
                    evaluated += np.where(has, table.size[at], 0)
                    qi, bi = _bucket_pairs(q, block, table, at, np.flatnonzero(has & q.ok), found, wanted)
                    if exclude_self:
                        other = q.ids[qi] != block.ids[bi]
                        qi, bi = qi[other], bi[other]
                    dist = sweep.squares(q.vecs, qi, block.vecs, bi)
                    found.offer(qi, block.ids[bi], np.round(dist, DIST_DIGITS), dist)
                yield _best_rows(b, found, last, evaluated=evaluated)
        return run
    return make


def _bucket_pairs(q: sweep.Queries, block: sweep.Block, table: _Buckets, at: np.ndarray, asks: np.ndarray,
                  found: sweep.Found, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of the table's buckets that may be among the nearest."""
    asks = asks[np.argsort(at[asks], kind="stable")]
    places, first, n = np.unique(at[asks], return_index=True, return_counts=True)
    out_q, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = n * table.size[places] <= sweep.SMALL_PAIRS
    for p, i, m in zip(places[small], first[small], n[small]):
        rows = table.order[table.start[p]:table.start[p] + table.size[p]]
        out_q.append(np.repeat(asks[i:i + m], len(rows)))
        out_b.append(np.tile(rows, m))
    for p, i, m in zip(places[~small], first[~small], n[~small]):
        rows = table.order[table.start[p]:table.start[p] + table.size[p]]
        for j in range(0, len(rows), sweep.TILE_ROWS):
            part = rows[j:j + sweep.TILE_ROWS]
            near = block.rows[part].T
            for x in range(i, i + m, sweep.TILE_QUERIES):
                who = asks[x:min(i + m, x + sweep.TILE_QUERIES)]
                qi, bi = sweep.near_pairs(q, who, q.rows[who] @ near, found.key[who, -1], wanted, ROUND_SLACK)
                out_q.append(who[qi])
                out_b.append(part[bi])
    return np.concatenate(out_q), np.concatenate(out_b)


def ann_recall(approx: DataFrame, exact: DataFrame, stats: DataFrame, n_base: int, k: int) -> DataFrame:
    """recall@k and candidate share per query."""
    hit = (exact.select("query_id", "id")
           .join(approx.select("query_id", "id", F.lit(1).alias("h")), ["query_id", "id"], "left"))
    rec = hit.groupBy("query_id").agg((F.sum(F.coalesce("h", F.lit(0))) / F.lit(k)).alias("recall"))
    return (rec.join(stats, "query_id", "left")
            .select("query_id", "recall", F.coalesce("evaluated", F.lit(0)).alias("evaluated"),
                    (F.coalesce("evaluated", F.lit(0)) / F.lit(n_base)).alias("candidate_share")))


def valid_hits(hits: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Only ids that exist in the chunk table survive (padding, -1 or
    stale ids drop); every real chunk, the first one included, is kept."""
    return hits.join(chunk_table.select(F.col("chunk_id").alias("id")), "id", "left_semi")
