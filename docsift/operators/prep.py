"""Document preparation.

A document is one row, so splitting it into pages, windows and chunks is a
projection with higher-order functions followed by an explode: no shuffle.
Only the dense chunk ids (C10, C13) need information from other documents,
and they get it from a per-document count table (ops in ``ids``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.arrays import explode_rows, posexplode_rows
from docsift.functions import text as tx
from docsift.operators.ids import dense_ids, running_offsets

# --------------------------------------------------------------------- C1-C4
def page_ranges(manifest: DataFrame, per_split: int = tx.PAGES_PER_SPLIT) -> DataFrame:
    """(document_name, split_no, first_page, last_page) for every run of
    ``per_split`` pages; ``manifest`` needs document_name and n_pages."""
    firsts = F.when(F.col("n_pages") >= 1,
                    F.sequence(F.lit(1), F.col("n_pages"), F.lit(per_split)))
    return (manifest.select("document_name", "n_pages", F.posexplode(firsts).alias("i", "first_page"))
            .select("document_name",
                    (F.col("i") + 1).alias("split_no"),
                    F.col("first_page"),
                    F.least(F.col("first_page") + (per_split - 1), F.col("n_pages")).alias("last_page")))


def split_name(document_name, first, last, folder: str = "/splits/"):
    """C2: '<folder><basename>_split_<first>_<last>.pdf'."""
    return F.concat(F.lit(folder), F.substring_index(document_name, "/", -1),
                    F.lit("_split_"), first.cast("string"), F.lit("_"),
                    last.cast("string"), F.lit(".pdf"))


def split_names(manifest: DataFrame) -> DataFrame:
    r = page_ranges(manifest)
    return r.withColumn("split_name", split_name(r["document_name"], r["first_page"], r["last_page"]))


def build_manifest(manifest: DataFrame, per_split: int = tx.PAGES_PER_SPLIT) -> DataFrame:
    """One row per document, split names joined by ', ', not chunked.
    Built from the document row itself (no group-by, no shuffle)."""
    firsts = F.when(F.col("n_pages") >= 1,
                    F.sequence(F.lit(1), F.col("n_pages"), F.lit(per_split))
                    ).otherwise(F.array().cast("array<int>"))
    names = F.transform(firsts, lambda f: split_name(
        F.col("document_name"), f, F.least(f + (per_split - 1), F.col("n_pages"))))
    return manifest.select(
        "document_name",
        F.array_join(names, ", ").alias("document_splits"),
        F.size(names).alias("n_splits"),
        F.lit(False).alias("chunked"))


def parse_split_list(packed: DataFrame) -> DataFrame:
    """C4: packed split string -> one left-trimmed path per row (always
    split on commas)."""
    return (packed.select("document_name",
                          F.posexplode(F.split(F.col("document_splits"), ",")).alias("i", "p"))
            .select("document_name", (F.col("i") + 1).alias("split_no"),
                    F.ltrim(F.col("p")).alias("split_path"))
            .filter(F.col("split_path") != ""))


# ------------------------------------------------------------------- C5, C6, C9
_DROP_BLOCKS = r"(?is)<!--.*?-->|<(head|script|style|nav|footer)\b[^>]*>.*?</\1\s*>"
_HEADING_OPEN = r"(?i)<h[1-6]\b[^>]*>"
_BLOCK_TAG = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|section|body|html|table|tr|td|main|header)\b[^>]*>"
_ANY_TAG = r"<[^>]*>"
SEP, HEAD = "\u0001", "\u0002"

# HTML entities decoded in page text, in replacement order
# ('&amp;' last so that an escaped entity is not decoded twice).
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decode_entities(c):
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def _page_items(html):
    s = F.regexp_replace(html, _DROP_BLOCKS, "")
    s = F.regexp_replace(s, _HEADING_OPEN, SEP + HEAD)
    s = F.regexp_replace(s, _BLOCK_TAG, SEP)
    s = F.regexp_replace(s, _ANY_TAG, "")
    parts = F.transform(F.split(s, SEP), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != F.lit("")) & (x != F.lit(HEAD)))


def convert_pages(pages: DataFrame) -> DataFrame:
    """Page html -> (page_id, item_no, label, text) with label heading or
    paragraph; scripts, styles, navigation, head, footer and comments
    removed, entities decoded. Row-local: no shuffle."""
    items = posexplode_rows(pages, ["page_id"], _page_items(F.col("html")), "i", "raw")
    is_head = F.startswith(F.col("raw"), F.lit(HEAD))
    return items.select(
        "page_id",
        (F.col("i") + 1).alias("item_no"),
        F.when(is_head, F.lit("heading")).otherwise(F.lit("paragraph")).alias("label"),
        decode_entities(F.trim(F.replace(F.col("raw"), F.lit(HEAD), F.lit("")))).alias("text"),
    )


def conversion_failures(pages: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Pages that yield no paragraph are quarantined with a reason; the
    others go on. An anti join keyed by page_id."""
    items = convert_pages(pages) if items is None else items
    good = items.filter(F.col("label") == "paragraph").select("page_id")
    bad = pages.join(good, "page_id", "left_anti")
    return bad.select(
        "page_id", "url",
        F.when(F.col("html").isNull() | (F.trim(F.col("html")) == ""), F.lit("empty input"))
         .otherwise(F.lit("no text")).alias("reason"))


def enrich_chunks(items: DataFrame) -> DataFrame:
    """Each paragraph serialised with the last heading before it on its
    page: 'heading\\ntext' (just text when there is none)."""
    w = (Window.partitionBy("page_id").orderBy("item_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heading = F.last(F.when(F.col("label") == "heading", F.col("text")), ignorenulls=True).over(w)
    return (items.withColumn("heading", heading)
            .filter(F.col("label") == "paragraph")
            .select("page_id", "item_no", "heading", "text",
                    F.concat_ws("\n", F.col("heading"), F.col("text")).alias("enriched")))


# ------------------------------------------------------------------- C7, C8
def _line_words(text):
    lines = F.split(text, "\n")
    return F.filter(F.transform(lines, tx.words), lambda w: F.size(w) > 0)


def pieces_expr(text, max_tokens: int = tx.MAX_TOKENS):
    """C7 as an expression: array<struct<n,text>> of at most ``max_tokens``
    whitespace words, per line, in order; empty lines give none."""
    per_line = F.transform(_line_words(text), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w), F.lit(max_tokens)),
        lambda i: F.struct(
            F.size(F.slice(w, i, max_tokens)).alias("n"),
            F.array_join(F.slice(w, i, max_tokens), " ").alias("text"))))
    return F.flatten(per_line)


def _chunk_starts(sizes, max_tokens: int):
    """Greedy in-order merge: a piece joins the current chunk while the sum
    stays within ``max_tokens``. The fold carries the running sum and the
    1-based start piece of every chunk; the start list grows only when a
    chunk starts, so a piece that joins costs no array copy."""
    init = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"),
                    F.lit(0).alias("i"))

    def step(acc, n):
        i = acc["i"] + 1
        grow = (F.size(acc["starts"]) > 0) & ((acc["n"] + n) <= max_tokens)
        return F.when(grow, F.struct((acc["n"] + n).alias("n"), acc["starts"].alias("starts"), i.alias("i"))) \
                .otherwise(F.struct(n.alias("n"), F.concat(acc["starts"], F.array(i)).alias("starts"), i.alias("i")))
    return F.aggregate(sizes, init, step)["starts"]


def _chunk_from(starts, sizes, texts):
    def chunk(s_, j):
        e = F.coalesce(F.try_element_at(starts, j + 2), F.size(sizes) + 1)
        return F.struct(
            F.aggregate(F.slice(sizes, s_, e - s_), F.lit(0), lambda a, x: a + x).alias("n_tokens"),
            F.array_join(F.slice(texts, s_, e - s_), "\n").alias("text"))
    return F.transform(starts, chunk)


def chunks_frame(df: DataFrame, text_col: str, keep: list[str], max_tokens: int = tx.MAX_TOKENS) -> DataFrame:
    """``keep`` columns + ``chunks`` array<struct<n_tokens,text>>.

    Pieces, their sizes, the fold and the chunk assembly are separate
    projections: an expression referenced inside a per-element lambda is
    evaluated once per element, so staging them keeps the work linear."""
    p = df.select(*keep, pieces_expr(F.col(text_col), max_tokens).alias("_p"))
    p = p.select(*keep, F.transform("_p", lambda x: x["n"].cast("int")).alias("_sizes"),
                 F.transform("_p", lambda x: x["text"]).alias("_texts"))
    p = p.select(*keep, "_sizes", "_texts", _chunk_starts(F.col("_sizes"), max_tokens).alias("_starts"))
    return p.select(*keep, _chunk_from(F.col("_starts"), F.col("_sizes"), F.col("_texts")).alias("chunks"))


def token_windows(docs: DataFrame, max_tokens: int = tx.MAX_TOKENS) -> DataFrame:
    """(doc_id, line_no, piece_no, n_tokens, text)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("l", "line"))
    w = tx.words(F.col("line"))
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(max_tokens)))
    return (lines.select("doc_id", (F.col("l") + 1).alias("line_no"), w.alias("w"),
                         F.posexplode(starts).alias("p", "start"))
            .select("doc_id", "line_no", (F.col("p") + 1).alias("piece_no"),
                    F.size(F.slice("w", F.col("start"), F.lit(max_tokens))).alias("n_tokens"),
                    F.array_join(F.slice("w", F.col("start"), F.lit(max_tokens)), " ").alias("text")))


def chunk_arrays(docs: DataFrame, max_tokens: int = tx.MAX_TOKENS) -> DataFrame:
    """(doc_id, chunks array) per document; the unit later steps explode."""
    return chunks_frame(docs, "text", ["doc_id"], max_tokens)


def chunk_documents(docs: DataFrame, max_tokens: int = tx.MAX_TOKENS) -> DataFrame:
    """(doc_id, pos, n_tokens, text), pos 1-based in document order."""
    return (chunk_arrays(docs, max_tokens)
            .transform(lambda d: posexplode_rows(d, ["doc_id"], F.col("chunks"), "i", "c"))
            .select("doc_id", (F.col("i") + 1).alias("pos"),
                    F.col("c.n_tokens").alias("n_tokens"), F.col("c.text").alias("text")))


# ------------------------------------------------------------------- C10-C14
def assign_chunk_ids(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dense global 1-based chunk ids in (``key``, pos) order, from a
    per-document running sum (no global single-task window). The key may be of any
    type that sorts: numbers, names, hashes."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    off = running_offsets(counts, key, "n")
    return (chunks.join(off.select(key, "offset"), key)
            .withColumn("chunk_id", (F.col("offset") + F.col("pos")).cast("bigint"))
            .drop("offset"))


def chunk_groups(chunk_arr: DataFrame, size: int = tx.CHUNKS_PER_SUMMARY) -> DataFrame:
    """C11: per document, each complete group of ``size`` chunks concatenated
    without separator; (doc_id, grp (0-based), text). Row-local."""
    # the size is asked inside the generator: a filter would be pushed below the
    # stages of chunk_arrays, which it would inline into one expression that
    # splits the whole text again for every chunk
    groups = F.when(F.size("chunks") >= size, F.transform(
        F.sequence(F.lit(0), F.floor(F.size("chunks") / size).cast("int") - 1),
        lambda g: F.struct(g.alias("g"), F.array_join(
            F.transform(F.slice("chunks", g * size + 1, size), lambda c: c["text"]), "").alias("text"))))
    return (explode_rows(chunk_arr, ["doc_id"], groups, "x")
            .select("doc_id", F.col("x.g").alias("grp"), F.col("x.text").alias("text")))


def interleaved_local_ids(pos, size: int = tx.CHUNKS_PER_SUMMARY):
    """Local id of chunk ``pos`` once a summary follows every complete
    group: pos + floor((pos-1)/size)."""
    return pos + F.floor((pos - 1) / size).cast("int")


def summary_local_id(grp, size: int = tx.CHUNKS_PER_SUMMARY):
    return (grp + 1) * (size + 1)


def document_table(docs: DataFrame) -> DataFrame:
    """C14: one (id, filename, doctype, text) row per document. The id is the
    document's own key; filename is the chunk file written for it."""
    from docsift.sources.fixtures import document_name
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/chunks/"), F.substring_index(document_name(docs), "/", -1),
                 F.lit(".json")).alias("filename"),
        F.lit("pdf").alias("doctype"),
        F.lit("").alias("text"))


def document_ids(docs: DataFrame) -> DataFrame:
    """C14 with ids of its own: (id, document_id, filename), ids 1, 2, ... in the
    order of the files' paths; documents of one path follow by document id."""
    files = document_table(docs).select(F.col("id").alias("document_id"), "filename")
    return (dense_ids(files, ["filename"], "id", tie_cols=["document_id"])
            .select(F.col("id").cast("bigint").alias("id"), F.col("document_id").cast("bigint").alias("document_id"), "filename"))
