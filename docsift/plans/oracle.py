"""Oracle SQL (DuckDB dialect) for the correctness gate.

Each public query has a SQL twin built from the CTE fragments below; the
fragments state the same semantics as the Spark operators in plain SQL over
the given tables (documents, pages, benchmark, embeddings, conversations).
"""

from __future__ import annotations

from docsift.functions import text as tx

NL = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS_SQL = "[" + ", ".join(_q(w) for w in tx.STOP_WORDS) + "]"
PUNCT_SQL = _q(tx.PUNCTUATION)


def raw_tokens(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(lower({x}), '\\s+'), "
            f"lambda t: trim(t, {PUNCT_SQL})), lambda t: t <> '')")


def tokens(x: str) -> str:
    return f"list_filter({raw_tokens(x)}, lambda t: NOT list_contains({STOPS_SQL}, t))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def doc_name(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return f"('/data/' || {p}source || '/doc_' || CAST({p}doc_id AS VARCHAR) || '.pdf')"


def pieces(text: str, m: int = tx.MAX_TOKENS) -> str:
    lw = (f"list_filter(list_transform(string_split({text}, {NL}), lambda l: {words('l')}), "
          f"lambda w: len(w) > 0)")
    return (f"flatten(list_transform({lw}, lambda w: list_transform(range(1, len(w) + 1, {m}), "
            f"lambda i: {{'n': len(w[i:i + {m - 1}]), 't': array_to_string(w[i:i + {m - 1}], ' ')}})))")


def bounds(pcs: str, m: int = tx.MAX_TOKENS) -> str:
    return (f"list_reduce(list_transform({pcs}, lambda p: p.n), lambda acc, n: CASE "
            f"WHEN len(acc) > 0 AND acc[-1].n + n <= {m} THEN "
            f"list_concat(acc[1:len(acc) - 1], [{{'s': acc[-1].s, 'c': acc[-1].c + 1, 'n': acc[-1].n + n}}]) "
            f"ELSE list_concat(acc, [{{'s': CASE WHEN len(acc) = 0 THEN 1 ELSE acc[-1].s + acc[-1].c END, "
            f"'c': 1, 'n': n}}]) END, []::STRUCT(s BIGINT, c BIGINT, n BIGINT)[])")


# (doc_id, chunks) -- chunks: list of {n_tokens, text}
CHUNK_ARRAYS = f"""
ca_p AS (SELECT doc_id, {pieces('text')} AS pcs FROM documents),
ca_b AS (SELECT doc_id, pcs, {bounds('pcs')} AS b FROM ca_p),
ca AS MATERIALIZED (SELECT doc_id, list_transform(b, lambda x: {{'n_tokens': x.n, 'text': array_to_string(
          list_transform(pcs[x.s:x.s + x.c - 1], lambda p: p.t), {NL})}}) AS chunks FROM ca_b)
"""

# (doc_id, pos, n_tokens, text)
CHUNKS = CHUNK_ARRAYS + """,
ch AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(c.n_tokens AS INTEGER) AS n_tokens, c.text AS text
       FROM (SELECT doc_id, generate_subscripts(chunks, 1) AS i, unnest(chunks) AS c FROM ca))
"""


def summary_ctes(prefix: str, groups: str, keys: list[str], n_sent: int = tx.SUMMARY_SENTENCES) -> str:
    """CTEs ending in ``{prefix}_out(keys..., summary)`` for every row of
    ``groups(keys..., text)``."""
    k = ", ".join(keys)
    kj = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ka = ", ".join(f"a.{c}" for c in keys)
    return f"""
{prefix}_s0 AS (SELECT {k}, generate_subscripts(parts, 1) AS sn, unnest(parts) AS s
               FROM (SELECT {k}, regexp_split_to_array(text, '[.!?]') AS parts FROM {groups})),
{prefix}_s AS (SELECT {k}, sn, trim(s) AS s FROM {prefix}_s0 WHERE trim(s) <> ''),
{prefix}_t AS (SELECT {k}, sn, unnest({tokens('s')}) AS t FROM {prefix}_s),
{prefix}_tf AS (SELECT {k}, sn, count(*) OVER (PARTITION BY {k}, t) AS tf FROM {prefix}_t),
{prefix}_sc AS (SELECT {k}, sn, avg(tf) AS score FROM {prefix}_tf GROUP BY {k}, sn),
{prefix}_r AS (SELECT {ka}, a.sn, a.s, row_number() OVER (PARTITION BY {ka}
                ORDER BY round(b.score, 6) DESC, a.sn) AS rk
               FROM {prefix}_s a JOIN {prefix}_sc b ON {kj} AND a.sn = b.sn),
{prefix}_j AS (SELECT {k}, string_agg(s, '. ' ORDER BY sn) || '.' AS summary
               FROM {prefix}_r WHERE rk <= {n_sent} GROUP BY {k}),
{prefix}_out AS (SELECT {ka}, coalesce(b.summary, '') AS summary
                 FROM {groups} a LEFT JOIN {prefix}_j b ON {kj})
"""


G = tx.CHUNKS_PER_SUMMARY

# chunk table: (chunk_id, document_id, pos, kind, text)
CHUNK_TABLE = CHUNK_ARRAYS + f""",
ct_off AS (SELECT doc_id, chunks, coalesce(sum(len(chunks) + len(chunks) // {G}) OVER (
             ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ca),
ct_c AS (SELECT doc_id, off, i, c FROM (SELECT doc_id, off, generate_subscripts(chunks, 1) AS i,
           unnest(chunks) AS c FROM ct_off)),
ct_g AS (SELECT doc_id, off, g AS grp, array_to_string(list_transform(chunks[g * {G} + 1:g * {G} + {G}],
           lambda c: c.text), '') AS text
         FROM (SELECT doc_id, off, chunks, unnest(range(0, len(chunks) // {G})) AS g FROM ct_off)),
{summary_ctes('cs', 'ct_g', ['doc_id', 'grp', 'off'])},
ct AS MATERIALIZED (
  SELECT CAST(off + i + (i - 1) // {G} AS BIGINT) AS chunk_id, CAST(doc_id AS BIGINT) AS document_id,
         CAST(i + (i - 1) // {G} AS INTEGER) AS pos, 'chunk' AS kind, c.text AS text FROM ct_c
  UNION ALL
  SELECT CAST(off + (grp + 1) * {G + 1} AS BIGINT), CAST(doc_id AS BIGINT),
         CAST((grp + 1) * {G + 1} AS INTEGER), 'summary', summary FROM cs_out)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


# ------------------------------------------------------------------ BM25
BM25 = """
psg AS (SELECT chunk_id, trim(text) AS text FROM ct),
ptok AS MATERIALIZED (SELECT chunk_id, {tok} AS toks FROM psg),
post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM ptok) GROUP BY chunk_id, term),
stats AS MATERIALIZED (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM ptok),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
rawidf AS MATERIALIZED (SELECT term, df, ln((SELECT n FROM stats) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
meanidf AS MATERIALIZED (SELECT avg(raw) AS m FROM rawidf),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT m FROM meanidf) ELSE raw END AS idf FROM rawidf),
bidx AS MATERIALIZED (SELECT p.term, p.chunk_id, p.tf, i.df,
                i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)) AS w
         FROM post p JOIN idf i USING (term), stats s)
""".format(tok=tokens("text"))


def query_terms(src: str, text: str = "text", name: str = "qt") -> str:
    return (f"{name} AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, "
            f"unnest({tokens(text)}) AS term FROM {src}) GROUP BY query_id, term)")


QUERIES = "qs AS (SELECT CAST(item_id AS BIGINT) AS query_id, text FROM benchmark)"

BM25_SEARCH = f"""
{query_terms('qs')},
bsc AS (SELECT query_id, chunk_id, sum(qn * w) AS score FROM qt JOIN bidx USING (term) GROUP BY 1, 2),
btop AS (SELECT query_id, chunk_id, round(score, 6) AS score,
                CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER) AS rank
         FROM bsc)
"""

SOURCES = f"src AS (SELECT CAST(doc_id AS BIGINT) AS document_id, {doc_name()} AS source FROM documents)"


def bucket_sql(t: str, dim: int) -> str:
    return f"CAST(('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim} AS INTEGER)"


def sign_sql(t: str) -> str:
    return f"(CASE WHEN ('0x' || substr(md5({t}), 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END)"


def sparse_vectors(name: str, weights: str, key: str, dim: int) -> str:
    """``{name}(key, b, v)`` from ``weights(key, term, w)``; values are float
    rounded, as stored."""
    return f"""
{name}_r AS (SELECT {key}, {bucket_sql('term', dim)} AS b, sum({sign_sql('term')} * w) AS v
             FROM {weights} GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS nm FROM {name}_r GROUP BY 1),
{name} AS (SELECT {key}, b, CAST(CAST(CASE WHEN nm > 0 THEN v / nm ELSE 0 END AS FLOAT) AS DOUBLE) AS v
           FROM {name}_r JOIN {name}_n USING ({key}))
"""


EMBED_DIM = 256

CORPUS_VECTORS = (
    "cw AS (SELECT chunk_id, term, tf * ln(1 + n / df) AS w FROM bidx, stats),"
    + sparse_vectors("cv", "cw", "chunk_id", EMBED_DIM))

SEMANTIC = f"""
rq AS (SELECT query_id, array_to_string({tokens('text')}, ' ') AS text FROM qs),
{query_terms('rq', name='rqt')},
qw AS (SELECT query_id, term, qn * ln(1 + n / df) AS w FROM rqt JOIN dfs USING (term), stats),
{sparse_vectors('qv', 'qw', 'query_id', EMBED_DIM)},
qn2 AS (SELECT query_id, sum(v * v) AS n2 FROM qv GROUP BY 1),
cn2 AS (SELECT chunk_id, sum(v * v) AS n2 FROM cv GROUP BY 1),
dots AS (SELECT q.query_id, c.chunk_id, sum(q.v * c.v) AS dot FROM qv q JOIN cv c ON q.b = c.b GROUP BY 1, 2),
sd AS (SELECT a.query_id, c.chunk_id,
              greatest(coalesce(qn2.n2, 0) + coalesce(cn2.n2, 0) - 2 * coalesce(dots.dot, 0), 0) + 0.0 AS dist
       FROM qs a CROSS JOIN ct c
       LEFT JOIN qn2 ON qn2.query_id = a.query_id
       LEFT JOIN cn2 ON cn2.chunk_id = c.chunk_id
       LEFT JOIN dots ON dots.query_id = a.query_id AND dots.chunk_id = c.chunk_id),
stop AS (SELECT query_id, chunk_id, round(dist, 6) AS score,
                CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), chunk_id) AS INTEGER) AS rank
         FROM sd)
"""

HYBRID = f"""
cand0 AS (SELECT query_id, rank, chunk_id, 'semantic' AS origin, score, rank AS pos FROM stop WHERE rank <= 10
          UNION ALL
          SELECT query_id, rank, chunk_id, 'lexical', score, 10 + rank FROM btop WHERE rank <= 3),
cand1 AS (SELECT c.*, ct.text, src.source FROM cand0 c JOIN ct USING (chunk_id)
          LEFT JOIN src ON src.document_id = ct.document_id),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY pos DESC) AS rn
                        FROM cand1) WHERE rn = 1),
qd AS (SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM qs),
den AS (SELECT query_id, sum(idf) AS den FROM qd JOIN idf USING (term) GROUP BY 1),
num AS (SELECT c.query_id, c.pos, sum(i.idf) AS num FROM cand c JOIN qd ON qd.query_id = c.query_id
        AND list_contains({tokens('c.text')}, qd.term) JOIN idf i ON i.term = qd.term GROUP BY 1, 2),
rsc AS (SELECT c.query_id, c.chunk_id, c.origin, c.source, c.text, c.pos,
               round(CASE WHEN coalesce(den.den, 0) > 0 THEN coalesce(num.num, 0) / den.den ELSE 0.0 END, 6) AS score
        FROM cand c LEFT JOIN num ON num.query_id = c.query_id AND num.pos = c.pos
        LEFT JOIN den ON den.query_id = c.query_id),
htop AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank
                        FROM rsc) WHERE rank <= 6),
hctx AS (SELECT query_id, string_agg(text, '' ORDER BY rank) AS text FROM htop GROUP BY 1),
{summary_ctes('hs', 'hctx', ['query_id'])}
"""

HYBRID_SELECT = """
SELECT query_id, rank, chunk_id, origin, source, score, text FROM htop
UNION ALL
SELECT query_id, 0, CAST(NULL AS BIGINT), 'summary', CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), summary FROM hs_out
"""
