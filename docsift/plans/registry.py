"""Query registry: one entry per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the given tables, with its SQL twin."""

from __future__ import annotations

import dataclasses
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.arrays import explode_rows, posexplode_rows
from docsift.functions import models as M
from docsift.functions import text as tx
from docsift.operators import hybrid as H
from docsift.operators import incremental as D
from docsift.operators import lexical as L
from docsift.operators import lookup as B
from docsift.operators import prep as C
from docsift.operators import quantized as PQ
from docsift.operators import segments as G
from docsift.operators import vectors as V
from docsift.operators.summarize import extractive_summary
from docsift.plans import corpus
from docsift.plans import oracle as O
from docsift.session import scratch_path
from docsift.sources import files as A
from docsift.sources import tables as TB
from docsift.sources.fixtures import comma_names, done_outputs, manifest_seed, table

QUERIES: dict = {}
SQL: dict = {}

# what the fixture's summary model begins its answers with (E4 takes it away)
LEAD_IN = "The main points of this text are:"


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


# ------------------------------------------------------------ shared inputs
_MEMO: dict = {}


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("bigint").alias("query_id"), "text")


def search_index(spark: SparkSession, sf: str) -> H.SearchIndex:
    """Built once per session and data folder, like an index file that is
    only rebuilt when absent."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _MEMO:
        d = docs(spark, sf)
        _MEMO[key] = H.SearchIndex.build(corpus.chunk_table(d), corpus.document_sources(d))
    return _MEMO[key]


def chunks(spark, sf) -> DataFrame:
    return search_index(spark, sf).chunks


def manifest(spark, sf) -> DataFrame:
    return manifest_seed(docs(spark, sf))


def built_manifest(spark, sf) -> DataFrame:
    return C.build_manifest(manifest(spark, sf))


def model_output(spark, sf) -> DataFrame:
    """Fixture model output over conversation turns."""
    c = table(spark, sf, "conversations")
    rid = F.col("conv_id") * 1000 + F.col("turn")
    raw = (F.when(rid % 10 == 0, F.lit('""'))
           .when(F.col("turn") % 2 == 0, F.concat(F.lit('Sure: "'), F.col("text"), F.lit('" ok')))
           .otherwise(F.col("text")))
    return c.select("conv_id", "turn", raw.alias("raw"))


# SQL inputs
SQL_MANIFEST = (f"mf AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, {O.doc_name()} AS document_name, "
                f"CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_pages, "
                f"(doc_id % 3 = 0) AS chunked, source FROM documents)")
SQL_RANGES = """rg AS (SELECT document_name, n_pages, CAST(i AS INTEGER) AS split_no, CAST(f AS INTEGER) AS first_page,
       CAST(least(f + 9, n_pages) AS INTEGER) AS last_page
  FROM (SELECT document_name, n_pages, generate_subscripts(fs, 1) AS i, unnest(fs) AS f
        FROM (SELECT document_name, n_pages, range(1, n_pages + 1, 10) AS fs FROM mf WHERE n_pages >= 1)))"""
SQL_SPLIT_NAME = ("'/splits/' || split_part(document_name, '/', -1) || '_split_' || CAST(first_page AS VARCHAR) "
                  "|| '_' || CAST(last_page AS VARCHAR) || '.pdf'")
SQL_BUILT = f"""bm AS (SELECT document_name, coalesce(string_agg({SQL_SPLIT_NAME}, ', ' ORDER BY split_no), '') AS document_splits,
       CAST(count(split_no) AS INTEGER) AS n_splits, false AS chunked
  FROM mf LEFT JOIN rg USING (document_name, n_pages) GROUP BY document_name)"""
SQL_DOCTABLE = ("dt AS (SELECT CAST(doc_id AS BIGINT) AS id, '/chunks/doc_' || CAST(doc_id AS VARCHAR) || '.pdf.json' "
                "AS filename, 'pdf' AS doctype, '' AS text FROM documents)")
SQL_MODEL_OUT = """mo AS (SELECT conv_id, turn, CASE WHEN (conv_id * 1000 + turn) % 10 = 0 THEN '""'
   WHEN turn % 2 = 0 THEN 'Sure: "' || text || '" ok' ELSE text END AS raw FROM conversations)"""
SQL_COUNTS = "cc AS (SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id)"
SQL_DONE = ("dn AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chunks END AS n_chunks "
            "FROM cc WHERE doc_id % 3 = 0)")

CT = O.with_(O.CHUNK_TABLE)
IDX = [O.CHUNK_TABLE, O.BM25, O.QUERIES]


def _w(*parts) -> str:
    return O.with_(*parts)


# ======================================================= A: sources/tables
def _listing(d: DataFrame) -> DataFrame:
    src, i = F.col("source"), F.col("doc_id").cast("string")
    paths = F.array(
        F.concat(F.lit("/data/"), src, F.lit("/doc_"), i, F.lit(".pdf")),
        F.concat(F.lit("/chunks/doc_"), i, F.lit(".pdf.json")),
        F.concat(F.lit("/data/"), src, F.lit("/doc_"), i, F.lit(".txt")),
        F.concat(F.lit("/data/"), src, F.lit("/scan_"), i, F.lit(".PDF")))
    return d.select(F.explode(paths).alias("path"))


@register("discover_files", """SELECT path FROM (SELECT unnest(['/data/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.pdf',
  '/chunks/doc_' || CAST(doc_id AS VARCHAR) || '.pdf.json', '/data/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt',
  '/data/' || source || '/scan_' || CAST(doc_id AS VARCHAR) || '.PDF']) AS path FROM documents)
WHERE regexp_matches(path, '(?i)\\.(pdf|json)$')""")
def q_discover_files(spark, sf):
    return A.source_paths(_listing(docs(spark, sf)))


@register("clean_file_names", """WITH p AS (SELECT '/data/' || source || '/doc_' || CAST(doc_id AS VARCHAR)
   || CASE WHEN doc_id % 7 = 0 THEN ', draft' ELSE '' END || '.pdf' AS path FROM documents),
n AS (SELECT path AS old_path, regexp_extract(path, '^(.*/)?[^/]*$', 1) || replace(split_part(path, '/', -1), ',', '') AS new_path FROM p)
SELECT old_path, new_path, old_path <> new_path AS renamed, count(*) OVER (PARTITION BY new_path) AS n_same_name FROM n""")
def q_clean_file_names(spark, sf):
    return A.clean_file_names(comma_names(docs(spark, sf)))


def _chunk_lines(spark, sf) -> str:
    ct = chunks(spark, sf)
    path = scratch_path(spark, "chunk-lines")
    A.write_chunk_lines(ct.filter(F.col("kind") == "chunk"), path)
    A.append_summary_lines(ct.filter(F.col("kind") == "summary"), path)
    return path


@register("write_chunk_lines", CT + " SELECT document_id, chunk_id, text FROM ct WHERE kind = 'chunk'")
def q_write_chunk_lines(spark, sf):
    path = scratch_path(spark, "chunk-lines")
    A.write_chunk_lines(chunks(spark, sf).filter(F.col("kind") == "chunk"), path)
    return spark.read.schema(A.CHUNK_LINE).json(f"{path}/kind=chunk")


@register("read_chunk_lines", CT + " SELECT document_id, chunk_id, kind, text FROM ct")
def q_read_chunk_lines(spark, sf):
    return A.read_chunk_lines(spark, _chunk_lines(spark, sf)).select("document_id", "chunk_id", "kind", "text")


@register("append_summary_lines", CT + " SELECT text, document_id, chunk_id AS id, chunk_id AS embedding FROM ct WHERE kind = 'summary'")
def q_append_summary_lines(spark, sf):
    path = _chunk_lines(spark, sf)
    ct = chunks(spark, sf)
    A.append_summary_lines(ct.filter(F.col("kind") == "summary"), path)  # a re-run adds nothing
    return spark.read.schema(A.SUMMARY_LINE).json(f"{path}/kind=summary").select(*A.SUMMARY_LINE.names)


def _tname(prefix: str) -> str:
    return f"{prefix}_{os.urandom(4).hex()}"


@register("create_drop_table", _w(SQL_DOCTABLE) + " SELECT id, filename, doctype, text FROM dt")
def q_create_drop_table(spark, sf):
    name, loc = _tname("docsift_document"), scratch_path(spark, "table-document")
    for _ in range(2):  # idempotent
        TB.create_table(spark, name, "id BIGINT, filename STRING, doctype STRING, text STRING", loc)
    TB.insert_rows(spark, name, C.document_table(docs(spark, sf)))
    TB.drop_table(spark, name)
    TB.drop_table(spark, name)
    return spark.read.parquet(loc)


@register("insert_rows", _w(SQL_DOCTABLE) + " SELECT id, filename, doctype, text FROM dt")
def q_insert_rows(spark, sf):
    name = _tname("docsift_document")
    TB.create_table(spark, name, "id BIGINT, filename STRING, doctype STRING, text STRING")
    d = docs(spark, sf)
    TB.insert_rows(spark, name, C.document_table(d.filter(F.col("lang") == "en")))
    TB.insert_rows(spark, name, C.document_table(d.filter(~(F.col("lang") == "en") | F.col("lang").isNull())))
    return spark.table(name)


@register("delete_rows", _w(SQL_MANIFEST) + " SELECT doc_id, document_name, n_pages, chunked FROM mf WHERE NOT chunked")
def q_delete_rows(spark, sf):
    return TB.snapshot(TB.delete_rows(manifest(spark, sf), F.col("chunked")), "manifest")


@register("update_rows", _w(SQL_MANIFEST) + """ SELECT doc_id, document_name, n_pages,
  CASE WHEN source = 'src0' THEN true ELSE chunked END AS chunked, source FROM mf""")
def q_update_rows(spark, sf):
    m = manifest(spark, sf).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return TB.snapshot(TB.update_rows(m, "chunked", True, "source", "src0"), "manifest")


@register("index_roundtrip", _w(*IDX) + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_index_roundtrip(spark, sf):
    path = scratch_path(spark, "index")
    index = search_index(spark, sf)
    index.save(path)
    got = H.SearchIndex.load(spark, path, index.chunks)
    return got.idf.select("term", "df", F.round("idf", 6).alias("idf"))


# ======================================================= B: lookups
@register("select_filtered", CT + " SELECT * FROM ct WHERE kind = 'summary' AND pos = 6")
def q_select_filtered(spark, sf):
    return TB.select_where(chunks(spark, sf), kind="summary", pos=6)


BTOP5 = _w(*IDX, O.BM25_SEARCH)


@register("lookup_chunks", BTOP5 + """ SELECT b.query_id, b.rank, b.chunk_id, ct.text, ct.document_id
  FROM btop b JOIN ct USING (chunk_id) WHERE rank <= 5""")
def q_lookup_chunks(spark, sf):
    idx = search_index(spark, sf)
    hits = L.top_k(L.bm25_scores(bench_queries(spark, sf), idx.bm25, term_buckets=idx.term_buckets), 5).select("query_id", "rank", "chunk_id")
    return B.lookup_chunks(hits, idx.chunks)


@register("lookup_document_name", _w(*IDX, O.BM25_SEARCH, SQL_DOCTABLE) + """ SELECT b.query_id, b.rank, b.chunk_id,
  ct.document_id, dt.filename FROM btop b JOIN ct USING (chunk_id) LEFT JOIN dt ON dt.id = ct.document_id WHERE rank <= 5""")
def q_lookup_document_name(spark, sf):
    idx = search_index(spark, sf)
    hits = L.top_k(L.bm25_scores(bench_queries(spark, sf), idx.bm25, term_buckets=idx.term_buckets), 5).select("query_id", "rank", "chunk_id")
    hits = hits.join(idx.chunks.select("chunk_id", "document_id"), "chunk_id")
    return B.lookup_document_name(hits, C.document_table(docs(spark, sf)))


@register("pending_documents", _w(SQL_MANIFEST) + " SELECT document_name FROM mf WHERE NOT chunked")
def q_pending_documents(spark, sf):
    return B.pending_documents(manifest(spark, sf))


@register("document_splits", _w(SQL_MANIFEST, SQL_RANGES, SQL_BUILT) + """ SELECT document_name,
  CAST(i AS INTEGER) AS split_no, ltrim(p) AS split_path FROM (SELECT document_name, generate_subscripts(ps, 1) AS i,
  unnest(ps) AS p FROM (SELECT b.document_name, string_split(b.document_splits, ',') AS ps
  FROM bm b JOIN mf USING (document_name) WHERE NOT mf.chunked))""")
def q_document_splits(spark, sf):
    return B.document_splits(B.pending_documents(manifest(spark, sf)), built_manifest(spark, sf))


@register("name_contains", _w(SQL_MANIFEST) + """ SELECT m.document_name, n.needle FROM mf m
  JOIN (SELECT DISTINCT source AS needle FROM documents) n ON instr(m.document_name, n.needle) > 0""")
def q_name_contains(spark, sf):
    needles = docs(spark, sf).select(F.col("source").alias("needle")).distinct()
    return B.name_contains(manifest(spark, sf), needles)


# ======================================================= C: preparation
@register("page_ranges", _w(SQL_MANIFEST, SQL_RANGES) + " SELECT document_name, split_no, first_page, last_page FROM rg")
def q_page_ranges(spark, sf):
    return C.page_ranges(manifest(spark, sf))


@register("split_names", _w(SQL_MANIFEST, SQL_RANGES) + f""" SELECT document_name, split_no, first_page, last_page,
  {SQL_SPLIT_NAME} AS split_name FROM rg""")
def q_split_names(spark, sf):
    return C.split_names(manifest(spark, sf))


@register("build_manifest", _w(SQL_MANIFEST, SQL_RANGES, SQL_BUILT) + " SELECT * FROM bm")
def q_build_manifest(spark, sf):
    return built_manifest(spark, sf)


@register("parse_split_list", _w(SQL_MANIFEST, SQL_RANGES, SQL_BUILT) + """ SELECT document_name, CAST(i AS INTEGER) AS split_no,
  ltrim(p) AS split_path FROM (SELECT document_name, generate_subscripts(ps, 1) AS i, unnest(ps) AS p
  FROM (SELECT document_name, string_split(document_splits, ',') AS ps FROM bm)) WHERE ltrim(p) <> ''""")
def q_parse_split_list(spark, sf):
    return C.parse_split_list(built_manifest(spark, sf))


def _sql_items() -> str:
    drop = "(?is)<!--.*?-->|" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in ("head", "script", "style", "nav", "footer"))
    s = f"regexp_replace(html, '{drop}', '', 'g')"
    s = f"regexp_replace({s}, '{C._HEADING_OPEN}', chr(1) || chr(2), 'g')"
    s = f"regexp_replace({s}, '{C._BLOCK_TAG}', chr(1), 'g')"
    s = f"regexp_replace({s}, '{C._ANY_TAG}', '', 'g')"
    parts = f"list_filter(list_transform(string_split({s}, chr(1)), lambda x: trim(x)), lambda x: x <> '' AND x <> chr(2))"
    dec = "trim(replace(raw, chr(2), ''))"
    for k, v in C.ENTITIES:
        dec = f"replace({dec}, {O._q(k)}, {O._q(v)})"
    return f"""it AS (SELECT page_id, CAST(i AS INTEGER) AS item_no,
  CASE WHEN starts_with(raw, chr(2)) THEN 'heading' ELSE 'paragraph' END AS label, {dec} AS text
  FROM (SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS raw FROM (SELECT page_id, {parts} AS ps FROM pages)))"""


SQL_ITEMS = _sql_items()


@register("convert_pages", _w(SQL_ITEMS) + " SELECT * FROM it")
def q_convert_pages(spark, sf):
    return C.convert_pages(table(spark, sf, "pages"))


SQL_BROKEN_PAGES = """bp AS (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '  ' WHEN page_id % 7 = 1 THEN NULL
  WHEN page_id % 7 = 2 THEN '<html><body><div></div></body></html>' ELSE html END AS html FROM pages)"""


def broken_pages(spark, sf) -> DataFrame:
    """The given pages, some without input or text, as a crawl has them."""
    k = F.col("page_id") % 7
    html = (F.when(k == 0, F.lit("  ")).when(k == 1, F.lit(None).cast("string"))
            .when(k == 2, F.lit("<html><body><div></div></body></html>")).otherwise(F.col("html")))
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


@register("conversion_failures", _w(SQL_BROKEN_PAGES, SQL_ITEMS.replace("FROM pages", "FROM bp"))
          + """ SELECT page_id, url, CASE WHEN html IS NULL OR trim(html) = ''
  THEN 'empty input' ELSE 'no text' END AS reason FROM bp
  WHERE page_id NOT IN (SELECT page_id FROM it WHERE label = 'paragraph')""")
def q_conversion_failures(spark, sf):
    return C.conversion_failures(broken_pages(spark, sf))


@register("enrich_chunks", _w(SQL_ITEMS) + """ SELECT page_id, item_no, heading, text, concat_ws(chr(10), heading, text) AS enriched
  FROM (SELECT *, last_value(CASE WHEN label = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY item_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM it) WHERE label = 'paragraph'""")
def q_enrich_chunks(spark, sf):
    return C.enrich_chunks(C.convert_pages(table(spark, sf, "pages")))


@register("token_windows", f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, line_no, {O.words('line')} AS w FROM l),
p AS (SELECT doc_id, line_no, w, generate_subscripts(st, 1) AS piece_no, unnest(st) AS s
      FROM (SELECT doc_id, line_no, w, range(1, len(w) + 1, 256) AS st FROM w WHERE len(w) > 0))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(piece_no AS INTEGER) AS piece_no,
  CAST(len(w[s:s + 255]) AS INTEGER) AS n_tokens, array_to_string(w[s:s + 255], ' ') AS text FROM p""")
def q_token_windows(spark, sf):
    return C.token_windows(docs(spark, sf))


@register("chunk_documents", _w(O.CHUNKS) + " SELECT * FROM ch")
def q_chunk_documents(spark, sf):
    return C.chunk_documents(docs(spark, sf))


@register("assign_chunk_ids", _w(O.CHUNKS, """cn AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id),
co AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cn)""")
          + " SELECT ch.doc_id, pos, n_tokens, text, CAST(off + pos AS BIGINT) AS chunk_id FROM ch JOIN co USING (doc_id)")
def q_assign_chunk_ids(spark, sf):
    return C.assign_chunk_ids(C.chunk_documents(docs(spark, sf)))


SQL_GROUPS = """gr AS (SELECT doc_id, CAST(g AS INTEGER) AS grp, array_to_string(list_transform(chunks[g * 5 + 1:g * 5 + 5],
  lambda c: c.text), '') AS text FROM (SELECT doc_id, chunks, unnest(range(0, len(chunks) // 5)) AS g FROM ca))"""


@register("chunk_groups_of_five", _w(O.CHUNK_ARRAYS, SQL_GROUPS) + " SELECT * FROM gr")
def q_chunk_groups(spark, sf):
    return C.chunk_groups(C.chunk_arrays(docs(spark, sf)))


@register("summary_chunks", _w(O.CHUNK_ARRAYS, SQL_GROUPS, O.summary_ctes("sm", "gr", ["doc_id", "grp"]))
          + " SELECT doc_id, grp, summary FROM sm_out")
def q_summary_chunks(spark, sf):
    return extractive_summary(C.chunk_groups(C.chunk_arrays(docs(spark, sf))), ["doc_id", "grp"], "text")


@register("interleave_summaries", CT + " SELECT * FROM ct")
def q_interleave(spark, sf):
    return corpus.chunk_table(docs(spark, sf))


@register("document_table", _w(SQL_DOCTABLE) + " SELECT * FROM dt")
def q_document_table(spark, sf):
    return C.document_table(docs(spark, sf))


@register("document_ids", _w(SQL_DOCTABLE) + """ SELECT CAST(row_number() OVER (ORDER BY filename, id) AS BIGINT) AS id,
  CAST(id AS BIGINT) AS document_id, filename FROM dt""")
def q_document_ids(spark, sf):
    return C.document_ids(docs(spark, sf))


# Chunk ids over hashed document keys, which lie anywhere in the range of their type.
@register("assign_chunk_ids_hashed", _w(O.CHUNKS, """hk AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_key, pos, text FROM ch),
cn AS (SELECT doc_key, count(*) AS n FROM hk GROUP BY doc_key),
co AS (SELECT doc_key, coalesce(sum(n) OVER (ORDER BY doc_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cn)""")
          + " SELECT doc_key, pos, text, CAST(off + pos AS BIGINT) AS chunk_id FROM hk JOIN co USING (doc_key)")
def q_assign_chunk_ids_hashed(spark, sf):
    c = C.chunk_documents(docs(spark, sf)).select(F.md5(F.col("doc_id").cast("string")).alias("doc_key"), "pos", "text")
    return C.assign_chunk_ids(c, "doc_key")


# ======================================================= D: incremental
def _done(spark, sf):
    counts = C.chunk_documents(docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return done_outputs(counts)


@register("skip_processed", _w(O.CHUNKS, SQL_COUNTS, SQL_DONE, SQL_MANIFEST) + """ SELECT doc_id, document_name FROM mf
  WHERE doc_id NOT IN (SELECT doc_id FROM dn WHERE n_chunks > 0)""")
def q_skip_processed(spark, sf):
    return D.skip_processed(manifest(spark, sf).select("doc_id", "document_name"), _done(spark, sf))


@register("mark_chunked", _w(O.CHUNKS, SQL_COUNTS, SQL_DONE, SQL_MANIFEST) + """ SELECT mf.doc_id, mf.document_name,
  mf.doc_id % 5 = 0 OR coalesce(dn.n_chunks, 0) > 0 AS chunked FROM mf LEFT JOIN dn USING (doc_id)""")
def q_mark_chunked(spark, sf):
    # flags set before, among them some without an output: they stay set
    before = manifest(spark, sf).select("doc_id", "document_name", (F.col("doc_id") % 5 == 0).alias("chunked"))
    return D.mark_chunked(before, _done(spark, sf))


@register("reconcile_flags", _w(O.CHUNKS, SQL_COUNTS, SQL_DONE, SQL_MANIFEST) + """ SELECT mf.doc_id, mf.document_name,
  mf.n_pages, coalesce(dn.n_chunks, 0) > 0 AS chunked FROM mf LEFT JOIN dn USING (doc_id)""")
def q_reconcile_flags(spark, sf):
    m = manifest(spark, sf).select("doc_id", "document_name", "n_pages", "chunked")
    return D.reconcile_flags(m, _done(spark, sf))


# ======================================================= E: text functions
@register("bm25_tokens", f"""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({O.raw_tokens('text')}) AS token
  FROM documents) GROUP BY doc_id, token""")
def q_bm25_tokens(spark, sf):
    return (explode_rows(docs(spark, sf), ["doc_id"], tx.raw_tokens(F.col("text")), "token")
            .groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")))


@register("drop_stop_words", f"""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({O.tokens('text')}) AS token
  FROM documents) GROUP BY doc_id, token""")
def q_drop_stop_words(spark, sf):
    return (explode_rows(docs(spark, sf), ["doc_id"], tx.bm25_tokens(F.col("text")), "token")
            .groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")))


@register("first_quoted", _w(SQL_MODEL_OUT) + """ SELECT conv_id, turn, CASE WHEN regexp_matches(trim(raw), '(?s)"(.*?)"')
  THEN regexp_extract(trim(raw), '(?s)"(.*?)"', 1) ELSE trim(raw) END AS answer FROM mo""")
def q_first_quoted(spark, sf):
    return model_output(spark, sf).select("conv_id", "turn", tx.first_quoted(F.col("raw")).alias("answer"))


@register("strip_boilerplate", f"""SELECT conv_id, turn, replace(CASE WHEN turn % 3 = 0 THEN {O._q(LEAD_IN)} || ' ' || text
  ELSE text END, {O._q(LEAD_IN)}, '') AS text FROM conversations""")
def q_strip_boilerplate(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(LEAD_IN + " "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.strip_boilerplate(raw, LEAD_IN).alias("text"))


@register("flatten_newlines", "SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations")
def q_flatten_newlines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.flatten_newlines(F.col("text")).alias("text"))


@register("source_basename", _w(SQL_DOCTABLE) + " SELECT id, replace(split_part(filename, '/', -1), '.json', '') AS basename FROM dt")
def q_source_basename(spark, sf):
    return C.document_table(docs(spark, sf)).select("id", tx.source_basename(F.col("filename")).alias("basename"))


@register("trim_passages", CT + " SELECT chunk_id, trim(text) AS text FROM ct")
def q_trim_passages(spark, sf):
    return L.passages(chunks(spark, sf))


# ======================================================= F: BM25
@register("bm25_postings", _w(*IDX) + " SELECT chunk_id, term, tf, dl FROM post")
def q_bm25_postings(spark, sf):
    psg = L.passages(chunks(spark, sf))
    return L.bm25_postings(psg, L.unique_ids(psg)).withColumn("dl", F.col("dl").cast("bigint"))


@register("bm25_corpus_stats", _w(*IDX) + " SELECT n AS n_passages, round(avgdl, 6) AS avgdl FROM stats")
def q_bm25_corpus_stats(spark, sf):
    return L.bm25_corpus_stats(L.passages(chunks(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


@register("bm25_idf", _w(*IDX) + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_bm25_idf(spark, sf):
    psg = L.passages(chunks(spark, sf))
    return L.bm25_idf(L.bm25_postings(psg, L.unique_ids(psg)), L.bm25_corpus_stats(psg)).withColumn("idf", F.round("idf", 6))


@register("bm25_scores", _w(*IDX, O.BM25_SEARCH) + " SELECT query_id, chunk_id, round(score, 6) AS score FROM bsc")
def q_bm25_scores(spark, sf):
    s = L.bm25_scores(bench_queries(spark, sf), search_index(spark, sf).bm25,
                      term_buckets=search_index(spark, sf).term_buckets)
    return s.withColumn("score", F.round("score", 6))


@register("bm25_top5", _w(*IDX, O.BM25_SEARCH) + " SELECT query_id, rank, chunk_id, score FROM btop WHERE rank <= 5")
def q_bm25_top5(spark, sf):
    s = L.bm25_scores(bench_queries(spark, sf), search_index(spark, sf).bm25,
                      term_buckets=search_index(spark, sf).term_buckets)
    return L.top_k(s, 5).select("query_id", "rank", "chunk_id", "score")


SQL_BM25_SEARCH = _w(*IDX, O.BM25_SEARCH, O.SOURCES) + """ SELECT b.query_id, b.rank, b.chunk_id, b.score, src.source, ct.text
  FROM btop b JOIN ct USING (chunk_id) LEFT JOIN src ON src.document_id = ct.document_id WHERE rank <= 3"""


def grown_index(spark, sf) -> G.SegmentedIndex:
    """The chunks in four additions, every eleventh deleted, half of those put
    back with a text of their own, segments merged."""
    c = chunks(spark, sf).select("chunk_id", "text")
    index = G.SegmentedIndex.create(spark, scratch_path(spark, "segments"))
    for part in range(4):
        index = index.add(c.filter(F.col("chunk_id") % 4 == part))
    index = index.delete(c.filter(F.col("chunk_id") % 11 == 0).select("chunk_id"))
    changed = c.filter(F.col("chunk_id") % 22 == 0).withColumn("text", F.concat("text", F.lit(" reworded")))
    return index.merge().update(changed)


# The same hits as an index rebuilt from the final table.
@register("bm25_segments", _w(O.CHUNK_TABLE, O.BM25.replace("trim(text) AS text FROM ct)", """trim(CASE WHEN chunk_id % 22 = 0
  THEN text || ' reworded' ELSE text END) AS text FROM ct WHERE chunk_id % 11 <> 0 OR chunk_id % 22 = 0)"""), O.QUERIES, O.BM25_SEARCH)
          + " SELECT query_id, rank, chunk_id, score FROM btop WHERE rank <= 5")
def q_bm25_segments(spark, sf):
    return grown_index(spark, sf).search(bench_queries(spark, sf), 5)


@register("bm25_search", SQL_BM25_SEARCH)
def q_bm25_search(spark, sf):
    return H.bm25_search(bench_queries(spark, sf), search_index(spark, sf))


# ======================================================= G: vectors
@register("embed_texts", _w(*IDX, O.CORPUS_VECTORS) + " SELECT chunk_id, b AS bucket, round(v, 6) AS value FROM cv WHERE round(v, 6) <> 0")
def q_embed_texts(spark, sf):
    idx = search_index(spark, sf)
    return V.sparse_rows(idx.vectors.withColumnRenamed("id", "chunk_id"), "chunk_id")


def _emb(spark, sf) -> DataFrame:
    return V.vectors_from_table(table(spark, sf, "embeddings"))


SQL_KNN_GRAPH = """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, embedding AS v FROM embeddings),
d AS (SELECT a.id AS query_id, b.id AS id, list_sum(list_transform(range(1, len(a.v) + 1),
        lambda i: (CAST(a.v[i] AS DOUBLE) - CAST(b.v[i] AS DOUBLE)) ** 2)) AS dist FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT query_id, id, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), id)
        AS INTEGER) AS rank FROM d)
SELECT query_id, rank, id, dist FROM r WHERE rank <= 10"""


@register("knn_exact", SQL_KNN_GRAPH)
def q_knn_exact(spark, sf):
    e = _emb(spark, sf)
    return V.knn_exact(e.select(F.col("id").alias("query_id"), "vec"), e, k=10, exclude_self=True)


@register("knn_exact_blocks", SQL_KNN_GRAPH)
def q_knn_exact_blocks(spark, sf):
    """The path for query sets of any size: both sides in blocks."""
    e = _emb(spark, sf)
    return V.knn_exact(e.select(F.col("id").alias("query_id"), "vec"), e, k=10, exclude_self=True, method="blocks")


# IVF over fixed centres (every tenth vector), which SQL can state too; k-means as the trainer is held
# against exact search in the tests and the bench.
IVF_EVERY, IVF_PROBES = 10, 8
SQL_IVF = f"""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, embedding AS v FROM embeddings),
c AS (SELECT id AS list_id, v FROM e WHERE id % {IVF_EVERY} = 0),
ed AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(range(1, len(a.v) + 1),
        lambda i: (CAST(a.v[i] AS DOUBLE) - CAST(b.v[i] AS DOUBLE)) ** 2)), 6) AS dist FROM e a JOIN e b ON true),
near AS (SELECT a AS id, b AS list_id, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k
         FROM ed JOIN c ON c.list_id = ed.b),
asg AS MATERIALIZED (SELECT id, list_id FROM near WHERE k = 1)"""


def _ivf(spark, sf):
    e = _emb(spark, sf)
    cent = V.seeded_centroids(e, IVF_EVERY)
    return e, cent, V.ivf_assign(e, cent)


@register("ivf_assign", SQL_IVF + " SELECT id, list_id FROM asg")
def q_ivf_assign(spark, sf):
    _, _, assigned = _ivf(spark, sf)
    return assigned.select("id", "list_id")


@register("ivf_search", SQL_IVF + f""", probed AS (SELECT n.id AS query_id, g.id FROM near n JOIN asg g USING (list_id)
   WHERE n.k <= {IVF_PROBES} AND n.id <> g.id),
held AS (SELECT query_id, count(*) AS n FROM probed GROUP BY 1),
cand AS (SELECT query_id, id FROM probed JOIN held USING (query_id) WHERE n >= 10 UNION ALL
   SELECT a, b FROM ed LEFT JOIN held ON held.query_id = ed.a WHERE a <> b AND coalesce(n, 0) < 10)
SELECT query_id, rank, id, dist FROM (SELECT query_id, id, dist, CAST(row_number() OVER (PARTITION BY query_id
   ORDER BY dist, id) AS INTEGER) AS rank FROM cand JOIN ed ON ed.a = cand.query_id AND ed.b = cand.id) WHERE rank <= 10""")
def q_ivf_search(spark, sf):
    e, cent, assigned = _ivf(spark, sf)
    q = e.select(F.col("id").alias("query_id"), "vec")
    return V.ivf_search(q, assigned, cent, k=10, nprobe=IVF_PROBES, exclude_self=True)


@register("ann_search")
def q_ann_search(spark, sf):
    e = _emb(spark, sf)
    res, _ = V.lsh_search(e.select(F.col("id").alias("query_id"), "vec"), e, k=10, exclude_self=True)
    return res


@register("ann_recall")
def q_ann_recall(spark, sf):
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), "vec")
    approx, stats = V.lsh_search(q, e, k=10, exclude_self=True)
    exact = V.knn_exact(q, e, k=10, exclude_self=True)
    return V.ann_recall(approx, exact, stats, e.count(), 10)


@register("ann_search_quantized")
def q_ann_search_quantized(spark, sf):
    e = _emb(spark, sf)
    index = PQ.build(e, scratch_path(spark, "pq"))
    return PQ.search(e.select(F.col("id").alias("query_id"), "vec"), index, k=10, exclude_self=True)


@register("ann_recall_quantized")
def q_ann_recall_quantized(spark, sf):
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), "vec")
    index = PQ.build(e, scratch_path(spark, "pq"))
    approx = PQ.search(q, index, k=10, exclude_self=True)
    exact = V.knn_exact(q, e, k=10, exclude_self=True)
    return V.ann_recall(approx, exact, PQ.measured(q, index), e.count(), 10)


SQL_SEMANTIC = _w(*IDX, O.CORPUS_VECTORS, O.SEMANTIC, O.SOURCES)


@register("valid_hits", SQL_SEMANTIC + " SELECT query_id, rank, chunk_id FROM stop WHERE rank <= 10")
def q_valid_hits(spark, sf):
    idx = search_index(spark, sf)
    s = H.semantic_search(bench_queries(spark, sf), idx).select("query_id", "rank", F.col("chunk_id").alias("id"))
    # a padded hit and one on a chunk that is gone, as an index file may return them
    q = bench_queries(spark, sf).select("query_id")
    s = (s.unionByName(q.select("query_id", F.lit(11).alias("rank"), F.lit(-1).cast("long").alias("id")))
         .unionByName(q.select("query_id", F.lit(12).alias("rank"), F.lit(idx.n_chunks + 1000).cast("long").alias("id"))))
    return V.valid_hits(s, idx.chunks).withColumnRenamed("id", "chunk_id")


@register("semantic_search", SQL_SEMANTIC + """ SELECT b.query_id, b.rank, b.chunk_id, b.score, src.source, ct.text
  FROM stop b JOIN ct USING (chunk_id) LEFT JOIN src ON src.document_id = ct.document_id WHERE rank <= 10""")
def q_semantic_search(spark, sf):
    return H.semantic_search(bench_queries(spark, sf), search_index(spark, sf))


INDEX_LISTS = 16


def ivf_index(spark, sf) -> H.SearchIndex:
    """The search index with k-means lists over its chunk vectors."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf), "ivf")
    if key not in _MEMO:
        idx = search_index(spark, sf)
        _MEMO[key] = dataclasses.replace(idx, ivf=V.ivf_build(idx.vectors, scratch_path(spark, "ivf"), INDEX_LISTS))
    return _MEMO[key]


# With all lists probed the IVF path must give the exact answer, which SQL states; fewer probes trade
# recall for reads (measured in the bench and the tests).
@register("semantic_search_ivf", SQL_SEMANTIC + """ SELECT b.query_id, b.rank, b.chunk_id, b.score, src.source, ct.text
  FROM stop b JOIN ct USING (chunk_id) LEFT JOIN src ON src.document_id = ct.document_id WHERE rank <= 10""")
def q_semantic_search_ivf(spark, sf):
    return H.semantic_search(bench_queries(spark, sf), ivf_index(spark, sf), method="ivf", nprobe=INDEX_LISTS)


# ======================================================= H: hybrid
SQL_HYB = _w(*IDX, O.BM25_SEARCH, O.CORPUS_VECTORS, O.SEMANTIC, O.SOURCES, O.HYBRID)


def _lists(spark, sf):
    idx, q = search_index(spark, sf), bench_queries(spark, sf)
    return H.hybrid_lists(H.semantic_search(q, idx), H.bm25_search(q, idx))


@register("resolve_sources", _w(*IDX, O.CORPUS_VECTORS, O.SEMANTIC, SQL_MANIFEST, SQL_DOCTABLE) + """ SELECT s.query_id, s.rank,
  s.chunk_id, ct.document_id, mf.document_name AS source FROM stop s JOIN ct USING (chunk_id)
  LEFT JOIN dt ON dt.id = ct.document_id
  LEFT JOIN mf ON split_part(mf.document_name, '/', -1) = replace(split_part(dt.filename, '/', -1), '.json', '')
  WHERE s.rank <= 10""")
def q_resolve_sources(spark, sf):
    idx = search_index(spark, sf)
    s = H.semantic_search(bench_queries(spark, sf), idx).select("query_id", "rank", "chunk_id")
    s = s.join(idx.chunks.select("chunk_id", "document_id"), "chunk_id")
    return H.resolve_sources(s, C.document_table(docs(spark, sf)), manifest(spark, sf))


@register("hybrid_lists", SQL_HYB + " SELECT query_id, rank, chunk_id, origin, score, source, text FROM cand1")
def q_hybrid_lists(spark, sf):
    return _lists(spark, sf)


@register("hybrid_concat", SQL_HYB + " SELECT query_id, rank, chunk_id, origin, score, source, text, pos FROM cand1")
def q_hybrid_concat(spark, sf):
    return H.hybrid_concat(_lists(spark, sf))


@register("dedupe_candidates", SQL_HYB + " SELECT query_id, rank, chunk_id, origin, score, source, text, pos FROM cand")
def q_dedupe(spark, sf):
    return H.dedupe_candidates(H.hybrid_concat(_lists(spark, sf)))


@register("rerank_scores", SQL_HYB + """ SELECT r.query_id, c.rank, r.chunk_id, r.origin, r.source, r.text, r.pos, r.score
  FROM rsc r JOIN cand c ON c.query_id = r.query_id AND c.pos = r.pos""")
def q_rerank_scores(spark, sf):
    idx = search_index(spark, sf)
    cands = H.dedupe_candidates(H.hybrid_concat(_lists(spark, sf)))
    return H.rerank_scores(cands, bench_queries(spark, sf), idx.idf)


@register("rerank_topk", SQL_HYB + " SELECT query_id, rank, chunk_id, origin, source, score, text FROM htop")
def q_rerank_topk(spark, sf):
    return H.hybrid_search(bench_queries(spark, sf), search_index(spark, sf), with_summary=False)


@register("answer_context", SQL_HYB + " SELECT query_id, text AS context FROM hctx")
def q_answer_context(spark, sf):
    top = H.hybrid_search(bench_queries(spark, sf), search_index(spark, sf), with_summary=False)
    return H.answer_context(top)


@register("answer_summary", SQL_HYB + """ SELECT query_id, 0 AS rank, CAST(NULL AS BIGINT) AS chunk_id, 'summary' AS origin,
  CAST(NULL AS VARCHAR) AS source, CAST(NULL AS DOUBLE) AS score, summary AS text FROM hs_out""")
def q_answer_summary(spark, sf):
    top = H.hybrid_search(bench_queries(spark, sf), search_index(spark, sf), with_summary=False)
    return H.answer_summary(H.answer_context(top)).withColumn("rank", F.col("rank").cast("int"))


@register("hybrid_search", SQL_HYB + O.HYBRID_SELECT)
def q_hybrid_search(spark, sf):
    return H.hybrid_search(bench_queries(spark, sf), search_index(spark, sf))


@register("hybrid_search_ivf", SQL_HYB + O.HYBRID_SELECT)
def q_hybrid_search_ivf(spark, sf):
    return H.hybrid_search(bench_queries(spark, sf), ivf_index(spark, sf), semantic_method="ivf", nprobe=INDEX_LISTS)


@register("query_rewrite", f"SELECT CAST(item_id AS BIGINT) AS query_id, array_to_string({O.tokens('text')}, ' ') AS text FROM benchmark")
def q_query_rewrite(spark, sf):
    return M.default_rewrite(bench_queries(spark, sf))


# ======================================================= S: streaming
from docsift.streaming import jobs as S  # noqa: E402


@register("stream_ingest", _w(O.CHUNKS) + " SELECT * FROM ch")
def q_stream_ingest(spark, sf):
    out = S.stream_ingest(spark, sf)
    return spark.read.parquet(out).select("doc_id", "pos", "n_tokens", "text")


@register("stream_dedupe", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_stream_dedupe(spark, sf):
    # every document file is delivered twice, in batches of their own
    twice = S.document_stream(spark, sf).unionByName(S.document_stream(spark, sf))
    out = S.stream_dedupe(twice)
    return spark.read.parquet(out).select("doc_id", "lang", "source", "n_chars")


SQL_STREAM_Q = _w(*IDX, "qs2 AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')",
                  O.query_terms("qs2", name="sq"), """sbs AS (SELECT query_id, chunk_id, sum(qn * w) AS score FROM sq
  JOIN bidx USING (term) GROUP BY 1, 2)""") + """ SELECT query_id, rank, chunk_id, score FROM (SELECT query_id, chunk_id,
  round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER)
  AS rank FROM sbs) WHERE rank <= 3"""


@register("stream_queries", SQL_STREAM_Q)
def q_stream_queries(spark, sf):
    idx = search_index(spark, sf)

    def answer(batch: DataFrame) -> DataFrame:
        return L.top_k(L.bm25_scores(batch, idx.bm25, term_buckets=idx.term_buckets, best=3), 3).select("query_id", "rank", "chunk_id", "score")

    out = S.stream_queries(spark, sf, answer)
    return spark.read.parquet(out).select("query_id", "rank", "chunk_id", "score")
