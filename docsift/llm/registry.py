"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["alignment", "ann", "decontaminate", "language", "mixing", "ngram_join", "pack", "quality", "quotes", "ranking",
           "token_counts", "url_filter", "warc"]


def _loaded():
    return [importlib.import_module(f"docsift.llm.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline
    out = {"pipeline": corpus_pipeline.run}
    for m in _loaded():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    import corpus_pipeline
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for m in _loaded():
        out.update(m.SQL)
    return out
