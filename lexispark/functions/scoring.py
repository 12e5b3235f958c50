"""The BM25 formula as columns and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def fieldnorm(length: Column) -> Column:
    """A length as one byte would keep it: exact under 32, then four significant bits above 24."""
    rest = length - 24
    shift = F.length(F.bin(rest)) - 4
    kept = F.call_function("shiftleft", F.call_function("shiftright", rest.cast("long"), shift), shift)
    return F.when(length < 32, length.cast("long")).otherwise(kept + 24)


def fieldnorm_of(length: int) -> int:
    if length < 32:
        return length
    shift = (length - 24).bit_length() - 4
    return 24 + ((length - 24) >> shift << shift)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(tf: Column, norm: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """What one term adds to a document's score; without an average length, lengths don't count."""
    k1_, b_ = F.lit(float(k1)), F.lit(float(b))
    flat = tf + k1_
    scaled = tf + k1_ * (F.lit(1.0) - b_ + b_ * norm / avgdl)
    return weight * (tf * (k1_ + F.lit(1.0))) / F.when(avgdl > 0, scaled).otherwise(flat)


def upper_bound(max_tf: Column, min_norm: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """The most that a term can add to any document: its highest frequency in its shortest document."""
    return term_score(max_tf, min_norm, avgdl, weight, k1, b)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions bm25_fieldnorm, bm25_idf and bm25_term_score for spark.sql users."""
    for body in (
        """bm25_fieldnorm(len BIGINT) RETURNS BIGINT RETURN CASE WHEN len < 32 THEN len
           ELSE 24 + shiftleft(shiftright(len - 24, length(bin(len - 24)) - 4), length(bin(len - 24)) - 4) END""",
        "bm25_idf(n DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN ln(1D + (n - df + 0.5D) / (df + 0.5D))",
        """bm25_term_score(tf DOUBLE, norm DOUBLE, avgdl DOUBLE, idf DOUBLE, k1 DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN
           idf * (tf * (k1 + 1D)) / CASE WHEN avgdl > 0D THEN tf + k1 * (1D - b + b * norm / avgdl) ELSE tf + k1 END""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
