"""Sequence functions: native where Spark has the means, Arrow for string similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..kernels.text import ratio

# Complement of bases, both cases; codes of bases.
BASES, COMPLEMENT = "ACGTacgt", "TGCATGCA"
CODES = {"A": 1, "C": 2, "G": 3, "T": 4}
OTHER_CODE = 5


def reverse_complement(seq: Column) -> Column:
    """ACGT of either case complemented in upper case, anything else N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), BASES, COMPLEMENT))


def normalise_bases(seq: Column) -> Column:
    """Upper case, anything but ACGT becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def base_codes(seq: Column) -> Column:
    """array<int>: A, C, G, T are 1 to 4, others 5."""
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(OTHER_CODE)))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings, null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")
