"""Fuzzy ratio on whole strings, as integer percent.

``ratio`` is the indel measure 2*LCS/(len a + len b). Catalyst has no LCS, so
it runs as an Arrow-batched UDF; ``levenshtein_pct`` is the JVM-only variant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS_PER_BLOCK = 4096


def _codes(texts: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Texts as one row of code points each, padded with ``fill``."""
    grid = np.full((len(texts), width), fill, dtype=np.int32)
    for i, text in enumerate(texts):
        grid[i, : len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return grid


def _lcs_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCS lengths of aligned texts: one table row per character of ``a``, all pairs at once."""
    wide_a, wide_b = max(map(len, a)), max(map(len, b))
    left, right = _codes(a, wide_a, -1), _codes(b, wide_b, -2)
    row = np.zeros((len(a), wide_b + 1), dtype=np.int32)
    for j in range(wide_a):
        taken = row[:, :-1] + (right == left[:, j : j + 1])
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], taken), axis=1)
    return row[:, -1]


def ratio_percent(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Percent per pair: equal texts 100, an empty or missing side 0, ties to even."""
    a, b = a.fillna("").to_numpy(dtype=object), b.fillna("").to_numpy(dtype=object)
    out = np.zeros(len(a), dtype=np.int32)
    size_a = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    size_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    same = a == b
    out[same] = 100
    todo = np.flatnonzero(~same & (size_a > 0) & (size_b > 0))
    todo = todo[np.lexsort((size_b[todo], size_a[todo]))]  # alike lengths share a block, so padding stays small
    start = 0
    while start < len(todo):
        longest = int(size_b[todo[start : start + PAIRS_PER_BLOCK]].max())
        stop = start + max(1, min(PAIRS_PER_BLOCK, 4_000_000 // (longest + 1)))
        pick = todo[start:stop]
        lcs = _lcs_block(a[pick], b[pick])
        out[pick] = np.rint(100.0 * (2.0 * lcs / (size_a[pick] + size_b[pick])))
        start = stop
    return out


@F.pandas_udf(T.IntegerType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratio_percent(a, b))


def token_sort_key(c: Column) -> Column:
    """Lower-case ASCII words in alphabetical order, joined by one blank."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")), "[^a-z0-9_]+", " ")
    return F.array_join(F.array_sort(F.split(F.trim(plain), " ")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(token_sort_key(a), token_sort_key(b))


def email_domain(c: Column) -> Column:
    """Text between the first and second ``@``; null without one."""
    return F.when(F.instr(c, "@") > 0, F.split_part(c, F.lit("@"), F.lit(2)))


def email_similarity(a: Column, b: Column) -> Column:
    """Ratio, plus 20 points for the same domain, at most 100."""
    bonus = F.when(email_domain(a) == email_domain(b), 20).otherwise(0)
    return F.least(F.lit(100), ratio(a, b) + bonus)


def levenshtein_pct(a: Column, b: Column) -> Column:
    """JVM-side edit similarity 1 - distance/longer length, in percent."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100)).otherwise(
        F.round(100 - F.levenshtein(a, b) * 100.0 / longer).cast("int")
    )


def register_sql_functions(spark) -> None:
    """Fuzzy measures for SQL users; the levenshtein one is a SQL body, so it inlines."""
    spark.udf.register("fuzzy_ratio", ratio)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION edit_similarity(a STRING, b STRING) RETURNS INT RETURN "
        "CASE WHEN greatest(length(a), length(b)) = 0 THEN 100 "
        "ELSE CAST(round(100 - levenshtein(a, b) * 100.0D / greatest(length(a), length(b))) AS INT) END"
    )
