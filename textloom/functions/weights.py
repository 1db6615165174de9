"""Term weights as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of BM25.
K1, B = 1.2, 0.75
# End of fixed values.


def idf(n_docs: Column | float, df: Column | str = "df") -> Column:
    """Natural logarithm of the number of documents over the document frequency, not smoothed."""
    df = F.col(df) if isinstance(df, str) else df
    return F.log((n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))) / df)


def tfidf(tf: Column, idf: Column) -> Column:
    """One, plus the logarithm of the frequency times idf."""
    return F.lit(1.0) + F.log(tf) * idf


def bm25(tf: Column, idf: Column, doclen: Column, avg_len: Column | float, k1: float = K1, b: float = B) -> Column:
    """tf over tf plus the length norm, times idf; without the factor k1 + 1."""
    avg = avg_len if isinstance(avg_len, Column) else F.lit(float(avg_len))
    return tf / (F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doclen / avg) + tf) * idf
