"""Hybrid retrieval and answer (G8, H1-H10), for a whole batch of queries.

Every step is keyed by query_id, so queries never mix (each gets its own
lexical list, re-ranking and summary). Candidate lists are bounded per
query (10 + 3), so per-query windows and groups are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.arrays import explode_rows
from docsift.functions import models as M
from docsift.functions import text as tx
from docsift.operators import lexical as lx
from docsift.operators import vectors as vx
from docsift.operators import word_lists as wl
from docsift.operators.broadcast import broadcast_if_small
from docsift.operators.segments import fingerprint
from docsift.operators.summarize import extractive_summary

SEMANTIC_K = 10
CHUNK_BLOCK_SHIFT = 16   # at least so many id bits share a directory
MAX_CHUNK_BLOCKS = 4096  # and more of them, so that directories stay few
MAX_BROADCAST_SOURCES = 4_000_000  # one name a document, as many as have their offsets broadcast
LEXICAL_K = 3
LEXICAL_POOL = 5
FINAL_K = 6


@dataclass
class SearchIndex:
    """Everything a search needs, derived once from the chunk table."""
    chunks: DataFrame        # chunk_id, document_id, pos, kind, text
    bm25: DataFrame          # term, chunk_id, tf, df, w
    idf: DataFrame           # term, df, idf
    vectors: DataFrame       # id, vec
    n_passages: object       # scalar column (or literal)
    sources: DataFrame       # document_id, source

    n_chunks: int = 0
    ivf: object = None       # optional vx.IvfIndex over the chunk vectors
    term_buckets: int = 0    # bucket count of the bm25 index partitions
    chunk_blocks: DataFrame = None  # chunks + cb (chunk_id >> block_shift), partitioned by cb
    idf_buckets: DataFrame = None   # idf + tb, partitioned by tb
    block_shift: int = CHUNK_BLOCK_SHIFT

    @staticmethod
    def build(chunks: DataFrame, sources: DataFrame, embedder=None, materialize=None,
              ivf_lists: int | None = None) -> "SearchIndex":
        """Offline build. ``materialize`` cuts lineage (Parquet in the shared
        checkpoint folder by default), so searches and size checks never
        recompute chunking, tokenising or embedding. ``ivf_lists`` also
        builds an IVF index over the chunk vectors for approximate semantic
        search that reads only the probed lists."""
        from docsift.session import cut_lineage, scratch_path, store_partitioned
        materialize = materialize or cut_lineage
        spark = chunks.sparkSession
        # the chunk table is stored once, partitioned by chunk-id block (ids
        # are dense, so blocks are even, and at most MAX_CHUNK_BLOCKS)
        top = chunks.agg(F.max("chunk_id")).first()[0] or 0
        shift = max(CHUNK_BLOCK_SHIFT, (top // MAX_CHUNK_BLOCKS).bit_length())
        # the source name is joined in once here, so a search's text lookup
        # reads only the pruned blocks and never the document table
        blocks = store_partitioned(
            chunks.join(broadcast_if_small(sources, MAX_BROADCAST_SOURCES), "document_id", "left")
            .withColumn("cb", F.shiftright("chunk_id", shift).cast("int")),
            "chunk-blocks", "cb", spread_col="chunk_id")
        chunks = blocks.select("chunk_id", "document_id", "pos", "kind", "text")
        psg = lx.passages(chunks)
        index, idf, stats = lx.bm25_build(psg, materialize)
        n = F.lit(float(stats["n_passages"]))
        if embedder is None and stats["known"] is not None:  # in the passages' rows, one for each chunk
            vectors = (wl.embed_lists(stats["lists"], stats["known"], float(stats["n_passages"]), vx.EMBED_DIM)
                       .withColumnRenamed("chunk_id", "id"))
        elif embedder is None:
            vec = vx.embed_corpus(stats["postings"], n, terms=idf.select("term", "df"))
            zero = F.array_repeat(F.lit(0.0).cast("float"), vx.EMBED_DIM)
            vectors = (chunks.select("chunk_id").join(vec, "chunk_id", "left")
                       .select(F.col("chunk_id").alias("id"), F.coalesce("vec", zero).alias("vec")))
        else:
            vectors = chunks.select(F.col("chunk_id").alias("id"), embedder(F.col("text")).alias("vec"))
        vectors = materialize(vectors)
        ivf = None
        if ivf_lists:
            ivf = vx.ivf_build(vectors, scratch_path(spark, "ivf"), ivf_lists)
        n_tb = int(stats["term_buckets"])
        idf_b = store_partitioned(idf.withColumn("tb", lx.term_bucket(F.col("term"), n_tb)), "idf-buckets", "tb", spread_col="term")
        return SearchIndex(chunks, index, idf_b.drop("tb"), vectors, n, sources, int(stats["n_passages"]),
                           ivf, n_tb, blocks, idf_b, shift)

    def save(self, path: str) -> None:
        """A10: every part under ``path``, the row of numbers last, so that a
        half-written index is not taken for one."""
        spark = self.chunks.sparkSession
        self.chunk_blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("cb").parquet(f"{path}/chunks")
        by_term = ["tb"] if "tb" in self.bm25.columns else []
        self.bm25.write.mode("overwrite").option("compression", "zstd").partitionBy(*by_term).parquet(f"{path}/bm25")
        self.idf_buckets.write.mode("overwrite").option("compression", "zstd").partitionBy("tb").parquet(f"{path}/idf")
        self.vectors.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
        self.sources.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/sources")
        if self.ivf is not None:
            self.ivf.centroids.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/ivf/centroids")
            self.ivf.sizes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/ivf/sizes")
            self.ivf.lists.write.mode("overwrite").option("compression", "zstd").partitionBy("lb").parquet(f"{path}/ivf/lists")
        dirs = self.ivf.n_dirs if self.ivf is not None else 0
        mark = str(fingerprint(self.chunks))
        spark.createDataFrame([(self.n_chunks, self.term_buckets, self.block_shift, dirs, mark)],
                              "n_chunks long, term_buckets int, block_shift int, ivf_dirs int, fingerprint string"
                              ).write.mode("overwrite").parquet(f"{path}/numbers")

    @staticmethod
    def load(spark, path: str, chunks: DataFrame | None = None) -> "SearchIndex | None":
        """The index saved under ``path``; None where there is none. With
        ``chunks`` (chunk_id, text), the table that it should be of, None for an index of any other."""
        from pyspark.errors import AnalysisException
        read = spark.read.parquet
        try:
            n = read(f"{path}/numbers").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if chunks is not None and n["fingerprint"] != str(fingerprint(chunks)):
            return None
        blocks, idf = read(f"{path}/chunks"), read(f"{path}/idf")
        ivf = (vx.IvfIndex(read(f"{path}/ivf/centroids"), read(f"{path}/ivf/lists"), read(f"{path}/ivf/sizes"), n["ivf_dirs"])
               if n["ivf_dirs"] else None)
        return SearchIndex(blocks.select("chunk_id", "document_id", "pos", "kind", "text"), read(f"{path}/bm25"),
                           idf.drop("tb"), read(f"{path}/vectors"), F.lit(float(n["n_chunks"])), read(f"{path}/sources"),
                           n["n_chunks"], ivf, n["term_buckets"], blocks, idf, n["block_shift"])

    def idf_for(self, queries: DataFrame, text_col: str = "text") -> DataFrame:
        """The idf rows a query batch can need: only the term buckets of its
        words are read (at most ``term_buckets`` values)."""
        if self.idf_buckets is None:
            return self.idf
        qt = queries.select(F.explode_outer(tx.bm25_tokens(F.col(text_col))).alias("term"))
        tbs = [r[0] for r in qt.filter(F.col("term").isNotNull())
               .select(lx.term_bucket(F.col("term"), self.term_buckets)).distinct().collect()]
        return self.idf_buckets.filter(F.col("tb").isin(tbs)).drop("tb")


# ------------------------------------------------------------------ H1
def resolve_sources(hits: DataFrame, documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """H1: hit -> document filename -> manifest name, by basename equality.
    ``documents(id, filename)``, ``manifest(document_name)``."""
    d = documents.select(F.col("id").alias("document_id"),
                         tx.source_basename(F.col("filename")).alias("_base"))
    m = manifest.select(F.col("document_name").alias("source"),
                        F.substring_index("document_name", "/", -1).alias("_base"))
    return hits.join(d, "document_id", "left").join(m, "_base", "left").drop("_base")


def _attach(hits: DataFrame, idx: SearchIndex) -> DataFrame:
    """Text and source of the hits. ``hits`` is written first (it is small)
    and joined on block and id: Spark prunes the blocks without hits at run
    time, and reads the search's result instead of searching again."""
    from docsift.session import cut_lineage
    if idx.chunk_blocks is None:
        c = idx.chunks.select("chunk_id", "document_id", "text")
        return hits.join(c, "chunk_id").join(idx.sources, "document_id", "left").drop("document_id")
    # ids count from 1; the comparison lets Spark see that the hits are selective
    hits = (cut_lineage(hits, "hits").filter("chunk_id > 0")
            .withColumn("cb", F.shiftright("chunk_id", idx.block_shift).cast("int")))
    return hits.join(idx.chunk_blocks.select("cb", "chunk_id", "text", "source"), ["cb", "chunk_id"]).drop("cb")


# ------------------------------------------------------------------ G8, F6
def semantic_hits(queries: DataFrame, idx: SearchIndex, k: int = SEMANTIC_K,
                  rewrite=M.default_rewrite, query_embedder=None, method: str = "exact",
                  nprobe: int = 8, idf: DataFrame | None = None,
                  rewritten: DataFrame | None = None) -> DataFrame:
    """G8 ranking: rewrite -> embed -> top-k -> (query_id, rank, chunk_id,
    score); score is the squared L2 distance. ``method='ivf'`` searches the
    index's IVF lists (approximate, reads only the probed lists). The
    rewriter and the query embedder run once: their results are written
    before anything reads them twice (``rewritten``: done by the caller)."""
    from docsift.session import cut_lineage
    rq = rewritten if rewritten is not None else cut_lineage(rewrite(queries.select("query_id", "text")), "rewritten")
    if query_embedder is None:
        idf = idx.idf_for(rq) if idf is None else idf
        qv = vx.embed_queries(lx.query_terms(rq), idf, idx.n_passages, vx.EMBED_DIM)
        zero = F.array_repeat(F.lit(0.0).cast("float"), vx.EMBED_DIM)
        qv = (rq.select("query_id").join(qv, "query_id", "left")
              .select("query_id", F.coalesce("vec", zero).alias("vec")))
    else:
        qv = rq.select("query_id", query_embedder(F.col("text")).alias("vec"))
    qv = cut_lineage(qv, "query-vectors")
    if method == "ivf":
        hits = vx.ivf_query(qv, idx.ivf, k, nprobe)
    else:
        hits = vx.knn_exact(qv, idx.vectors, k, n_base=idx.n_chunks)
    return hits.select("query_id", "rank", F.col("id").alias("chunk_id"), F.col("dist").alias("score"))


def bm25_hits(queries: DataFrame, idx: SearchIndex, k: int = LEXICAL_K,
              pool: int = LEXICAL_POOL) -> DataFrame:
    """F6 ranking: the ``pool`` best passages, of which the ``k`` best are
    kept: (query_id, rank, chunk_id, score)."""
    top = lx.top_k(lx.bm25_scores(queries, idx.bm25, term_buckets=idx.term_buckets), pool)
    return top.filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def semantic_search(queries: DataFrame, idx: SearchIndex, k: int = SEMANTIC_K, **kw) -> DataFrame:
    """Semantic hits with text and source."""
    return _attach(semantic_hits(queries, idx, k, **kw), idx)


def bm25_search(queries: DataFrame, idx: SearchIndex, k: int = LEXICAL_K,
                pool: int = LEXICAL_POOL) -> DataFrame:
    """lexical hits with text and source (the same chunk for both)."""
    return _attach(bm25_hits(queries, idx, k, pool), idx)


# ------------------------------------------------------------------ H2-H4
def hybrid_lists(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """H2: both ranked lists side by side, told apart by ``origin``."""
    cols = ["query_id", "rank", "chunk_id", "origin", "score", "source", "text"]
    return (semantic.withColumn("origin", F.lit("semantic")).select(*cols)
            .unionByName(lexical.withColumn("origin", F.lit("lexical")).select(*cols)))


def hybrid_concat(lists: DataFrame, semantic_k: int = SEMANTIC_K) -> DataFrame:
    """H3: semantic hits first, then lexical; ``pos`` is the place in the
    concatenation (bag union, duplicates kept)."""
    return lists.withColumn("pos", F.when(F.col("origin") == "semantic", F.col("rank"))
                            .otherwise(F.lit(semantic_k) + F.col("rank")))


def dedupe_candidates(cands: DataFrame) -> DataFrame:
    """H4: candidates with identical text collapse; the last position wins."""
    w = Window.partitionBy("query_id", "text").orderBy(F.col("pos").desc())
    return cands.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# ------------------------------------------------------------------ H5-H8
def rerank_scores(cands: DataFrame, queries: DataFrame, idf: DataFrame, reranker=None) -> DataFrame:
    """H5: relevance of each candidate to its query. ``reranker`` is a U2
    model UDF (query text, candidate text) -> score; the default is the
    idf-weighted coverage of the distinct query words by the candidate's
    words, in [0, 1]."""
    if reranker is not None:
        q = queries.select("query_id", F.col("text").alias("_qtext"))
        return (cands.drop("score").join(q, "query_id")
                .withColumn("score", F.round(reranker(F.col("_qtext"), F.col("text")), 6)).drop("_qtext"))
    q = queries.select("query_id", F.array_distinct(tx.bm25_tokens(F.col("text"))).alias("qt"))
    c = cands.join(q, "query_id")
    shared = explode_rows(c, ["query_id", "pos"],
                          F.array_intersect("qt", tx.bm25_tokens(F.col("text"))), "term")
    num = (idf.select("term", "idf").join(shared, "term")
           .groupBy("query_id", "pos").agg(F.sum("idf").alias("num")))
    qterms = q.select("query_id", F.explode("qt").alias("term"))
    den = (idf.select("term", "idf").join(qterms, "term")
           .groupBy("query_id").agg(F.sum("idf").alias("den")))
    score = F.when(F.coalesce("den", F.lit(0.0)) > 0,
                   F.coalesce("num", F.lit(0.0)) / F.col("den")).otherwise(F.lit(0.0))
    return (cands.drop("score").join(num, ["query_id", "pos"], "left").join(den, "query_id", "left")
            .withColumn("score", F.round(score, 6)).drop("num", "den"))


def rerank_topk(scored: DataFrame, k: int = FINAL_K) -> DataFrame:
    """H6: the k best by re-rank score (ties: earlier position)."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.col("pos").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def answer_context(top: DataFrame) -> DataFrame:
    """H7: (query_id, context) -- final texts concatenated in rank order."""
    return (top.groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("xs"))
            .select("query_id", F.array_join(F.transform("xs", lambda x: x["text"]), "").alias("context")))


def answer_summary(context: DataFrame, summarizer=None) -> DataFrame:
    """H8: one summary row per query (rank 0, origin 'summary')."""
    if summarizer is None:
        s = extractive_summary(context, ["query_id"], "context")
    else:
        s = summarizer(context, ["query_id"], "context")
    return s.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("chunk_id"),
                    F.lit("summary").alias("origin"), F.lit(None).cast("string").alias("source"),
                    F.lit(None).cast("double").alias("score"), F.col("summary").alias("text"))


RESULT_COLS = ["query_id", "rank", "chunk_id", "origin", "source", "score", "text"]


def hybrid_search(queries: DataFrame, idx: SearchIndex, summarizer=None,
                  rewrite=M.default_rewrite, with_summary: bool = True, materialize=None,
                  semantic_method: str = "exact", nprobe: int = 8, reranker=None,
                  query_embedder=None) -> DataFrame:
    """H9: G8 + F6 -> H3 -> H4 -> H5 -> H6 (+ H8) for a batch of queries.
    (query_id, rank, chunk_id, origin, source, score, text).

    The candidate table (at most 13 rows per query) and the final top-6 are
    each written once: re-ranking, context and summary all branch from them,
    and without the cut every branch would re-run both searches."""
    from docsift.session import cut_lineage
    materialize = materialize or cut_lineage
    # this batch's slice of the idf table: words of the queries and of their rewrites
    rewritten = materialize(rewrite(queries.select("query_id", "text")))
    words = queries.select("query_id", "text").unionByName(rewritten.select("query_id", "text"))
    idf = materialize(idx.idf_for(words))
    sem = semantic_hits(queries, idx, SEMANTIC_K, rewrite, query_embedder=query_embedder,
                        method=semantic_method, nprobe=nprobe, idf=idf, rewritten=rewritten)
    lex = bm25_hits(queries, idx, LEXICAL_K)
    hits = (sem.withColumn("origin", F.lit("semantic"))
            .unionByName(lex.withColumn("origin", F.lit("lexical"))))
    lists = _attach(hits, idx).select("query_id", "rank", "chunk_id", "origin", "score", "source", "text")
    cands = materialize(dedupe_candidates(hybrid_concat(lists)))
    top = rerank_topk(rerank_scores(cands, queries, idf, reranker))
    top = materialize(top.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "origin",
                                 "source", "score", "text"))
    if not with_summary:
        return top
    summ = answer_summary(answer_context(top), summarizer)
    return top.unionByName(summ.select(*RESULT_COLS))
