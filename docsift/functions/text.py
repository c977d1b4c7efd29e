"""Scalar text functions (E1-E7) as Column builders.

All of them are built-in Spark expressions, so they run inside whole-stage
codegen on the executors; none needs Python.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match):
# the punctuation stripped from both ends of a token (Python's
# string.punctuation), and the English stop-word list (Spark ML's
# StopWordsRemover English list, 181 words, in its natural order).
# ---------------------------------------------------------------------------
PUNCTUATION = string.punctuation

STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now i'll you'll "
    "he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're "
    "he's she's it's we're they're i've we've you've they've isn't aren't "
    "wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()

# Chunking and grouping parameters of the workload.
MAX_TOKENS = 256
PAGES_PER_SPLIT = 10
CHUNKS_PER_SUMMARY = 5
SUMMARY_SENTENCES = 8


def raw_tokens(text: Column) -> Column:
    """E1 without stop words: lower, split on whitespace, strip ASCII
    punctuation at both ends, drop empties. array<string>, order kept."""
    parts = F.split(F.lower(text), r"\s+")
    stripped = F.transform(parts, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return F.filter(stripped, lambda t: t != F.lit(""))


def bm25_tokens(text: Column) -> Column:
    """E1+E2: the lexical tokens of a text, stop words removed, with
    repetition and in order."""
    # IN over literals becomes a hash-set lookup (InSet), not a list scan
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def words(line: Column) -> Column:
    """Whitespace words of a line (case and punctuation kept); what the
    256-token cap counts."""
    return F.filter(F.split(line, r"\s+"), lambda t: t != F.lit(""))


def first_quoted(text: Column) -> Column:
    """The first double-quoted span (lazy, may cross lines); else the
    whole trimmed text. Empty quotes give ''."""
    pattern = r'(?s)"(.*?)"'
    t = F.trim(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)


def strip_boilerplate(text: Column, lead_in: str) -> Column:
    """Remove a fixed lead-in sentence wherever it occurs."""
    return F.replace(text, F.lit(lead_in), F.lit(""))


def flatten_newlines(text: Column) -> Column:
    """E5: newline to space for display."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def source_basename(path: Column) -> Column:
    """Basename of a path with '.json' removed."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(".json"), F.lit(""))


def trim_passage(text: Column) -> Column:
    """A passage as BM25 sees it."""
    return F.trim(text)

