"""Text columns: tokens, n-gram overlap, longest common subsequence, section checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"(?U)\b\w+\b"

# Required sections (name, pattern) and disposition words.
REQUIRED_SECTIONS = [
    ("Transaction Summary", r"(?i)##\s*transaction\s*summary"),
    ("Risk Indicators", r"(?i)##\s*risk\s*indicators"),
    ("Customer Context & Graph", r"(?i)##\s*customer\s*context"),
    ("Recommended Action", r"(?i)##\s*recommended\s*action"),
]
DISPOSITIONS = ["APPROVE", "HOLD_FOR_REVIEW", "ESCALATE_URGENT"]
MISSING_DISPOSITION = "Standard Disposition Tag (APPROVE/HOLD/ESCALATE)"


def tokenize(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def trim_all(text: Column) -> Column:
    """Strips every kind of white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ngram_set(tokens: Column, n: int) -> Column:
    """Distinct n-grams; tokens hold no separator, so a joined string is unambiguous."""
    if n == 1:
        return F.array_distinct(tokens)
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(grams)).otherwise(
        F.array().cast("array<string>"))


def f1_of_overlap(overlap: Column, n_cand: Column, n_ref: Column) -> Column:
    """F1 of precision overlap/n_cand and recall overlap/n_ref, 0 without overlap."""
    precision = overlap.cast("double") / n_cand.cast("double")
    recall = overlap.cast("double") / n_ref.cast("double")
    return F.when(overlap > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(
        F.lit(0.0))


def sar_missing(text: Column) -> Column:
    """Names of the required sections (and the disposition) a report lacks."""
    checks = [F.when(~text.rlike(pattern), F.lit(name)) for name, pattern in REQUIRED_SECTIONS]
    has_disposition = F.lit(False)
    for word in DISPOSITIONS:
        has_disposition = has_disposition | text.contains(word)
    checks.append(F.when(~has_disposition, F.lit(MISSING_DISPOSITION)))
    return F.array_compact(F.array(*checks))


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, one big-integer step per token of b.

    Bit i of ``rows`` is cleared once a longer match ends at position i of a.
    """
    n = len(a)
    if n == 0 or len(b) == 0:
        return 0
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << n) - 1
    rows = full
    for token in b:
        hit = rows & where.get(token, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return n - rows.bit_count()


@F.pandas_udf(T.LongType())
def lcs_tokens(cand: pd.Series, ref: pd.Series) -> pd.Series:
    """LCS length of two token arrays; the one text measure with no built-in form."""
    return pd.Series([lcs_length(a, b) for a, b in zip(cand, ref)], dtype="int64")
