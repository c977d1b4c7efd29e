"""Pluggable model contracts.

The defaults used by the pipeline are deterministic DataFrame expressions
(no Python on the hot path). A real model is plugged in through the
wrappers below: each turns a batched Python callable into an Arrow-batched
iterator pandas UDF, so the model is loaded once per Python worker and
called on whole batches, never per row.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions import text as tx


# ------------------------------------------------------------- U4 rewrite
def default_rewrite(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """U4 default: the query's stop-word-free tokens as one string (what the
    vector side searches with; the lexical side keeps the original)."""
    return queries.withColumn(text_col, F.array_join(tx.bm25_tokens(F.col(text_col)), " "))


def clean_model_output(c: Column, lead_in: str | None = None) -> Column:
    """E3 + E4 on generated text: the first quoted span if any, and a known
    lead-in removed."""
    out = tx.first_quoted(c)
    return tx.strip_boilerplate(out, lead_in) if lead_in else out


# --------------------------------------------------------- model wrappers
def _with_retries(fn, retries: int, wait_s: float):
    """``fn`` called again after a failure, waiting twice as long each time;
    the last failure is raised."""
    def call(*args):
        for n in range(retries + 1):
            try:
                return fn(*args)
            except Exception:
                if n == retries:
                    raise
                time.sleep(wait_s * 2 ** n)
    return call


def text_model_udf(make_fn: Callable[[], Callable[[list[str]], list[str]]],
                   batch_size: int = 64, retries: int = 2, wait_s: float = 1.0):
    """``make_fn()`` builds the model once per worker and returns a
    callable list[str] -> list[str]. A failed call is repeated ``retries``
    times before it fails the task."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = _with_retries(make_fn(), retries, wait_s)
        for s in batches:
            out = []
            vals = s.tolist()
            for i in range(0, len(vals), batch_size):
                out.extend(fn(["" if v is None else v for v in vals[i:i + batch_size]]))
            yield pd.Series(out)
    return run


def embed_model_udf(make_fn: Callable[[], Callable[[list[str]], np.ndarray]],
                    batch_size: int = 64):
    """``make_fn()`` returns a callable list[str] -> (n, dim) array."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_fn()
        for s in batches:
            vals = ["" if v is None else v for v in s.tolist()]
            rows = []
            for i in range(0, len(vals), batch_size):
                rows.extend(np.asarray(fn(vals[i:i + batch_size]), dtype=np.float32).tolist())
            yield pd.Series(rows)
    return run


def rerank_model_udf(make_fn: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
                     batch_size: int = 32, max_words: int | None = None):
    """``make_fn()`` returns a callable (queries, texts) -> scores.
    ``max_words`` cuts texts to the model's length."""
    def cut(text: str) -> str:
        return text if max_words is None else " ".join(text.split()[:max_words])

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = make_fn()
        for q, t in batches:
            qs, ts = q.fillna("").tolist(), [cut(x) for x in t.fillna("")]
            out = []
            for i in range(0, len(qs), batch_size):
                out.extend(np.asarray(fn(qs[i:i + batch_size], ts[i:i + batch_size]), dtype=float).tolist())
            yield pd.Series(out)
    return run


def model_rewriter(udf, lead_in: str | None = None):
    """Adapts a U4 UDF to the rewriter contract (queries) -> queries with
    ``text`` rewritten, its output cleaned with E3/E4."""
    def rewrite(queries: DataFrame) -> DataFrame:
        return queries.withColumn("text", clean_model_output(udf(F.col("text")), lead_in))
    return rewrite


def model_summarizer(udf, lead_in: str):
    """Adapts a U3 UDF to the summariser contract (df, keys, text_col) ->
    (keys..., summary), cleaning its output with E3/E4."""
    def summarize(df: DataFrame, keys: list, text_col: str) -> DataFrame:
        return df.select(*keys, clean_model_output(udf(F.col(text_col)), lead_in).alias("summary"))
    return summarize
