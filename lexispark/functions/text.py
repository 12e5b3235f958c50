"""Text configurations: how a text becomes lexemes.

Configurations made of Spark expressions stay inside code generation; stemming ones add one
Arrow step over the words. A lexeme of more than LONGEST bytes is ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 2047
#: Words of each configuration that is a plain split.
_SPLITS = {"ascii_simple": r"[^a-z0-9]+", "simple": r"[^\p{L}\p{N}]+", "english": r"[^\p{L}\p{N}]+"}
CONFIGS = tuple(_SPLITS)


def check_config(config: str | None) -> str:
    """The configuration's plain name; a schema before it is allowed."""
    if not config:
        raise ValueError("text_config parameter is required for bm25 indexes")
    name = config.rpartition(".")[2]
    if name not in _SPLITS:
        raise ValueError(f'text search configuration "{config}" does not exist')
    return name


@F.pandas_udf(T.ArrayType(T.StringType()))
def _english(words: pd.Series) -> pd.Series:
    from lexispark.functions.english import STOP_WORDS, stem

    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws if w not in STOP_WORDS])


def tokens(text: Column, config: str) -> Column:
    """The lexemes of a text in order, repeats included; null for null."""
    name = check_config(config)
    words = F.filter(F.split(F.lower(text), _SPLITS[name]), lambda w: (w != "") & (F.octet_length(w) <= LONGEST))
    return _english(words) if name == "english" else words


def flatten_array(values: Column) -> Column:
    """A text array as one text: elements that are neither null nor empty, with single spaces."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " ")


def analyze(spark: SparkSession, text: str, config: str) -> list[str]:
    """The lexemes of a query text, by the same expressions, without a cluster job for plain configurations."""
    name = check_config(config)
    if name == "ascii_simple" and text.isascii():
        return [w for w in re.split(_SPLITS[name], text.lower()) if w and len(w) <= LONGEST]
    one = spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": text})
    plain = "simple" if name == "english" else name
    words = one.select(tokens(F.col("q"), plain).alias("w")).first().w
    if name == "english":
        from lexispark.functions.english import STOP_WORDS, stem

        words = [stem(w) for w in words if w not in STOP_WORDS]
    return words
