"""What an index is made of: names, the text, the configuration and the BM25 parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions.scoring import B, K1
from lexispark.functions.text import check_config, flatten_array, tokens


@dataclass(frozen=True)
class IndexSpec:
    """A BM25 index over one text of a table.

    column: a text or text-array column, or a SQL expression that gives one (`expression`).
    where: a SQL condition; rows that don't meet it are not documents. partition_by: columns
    whose values keep statistics of their own.
    """

    name: str
    key: str
    column: str
    text_config: str
    k1: float = K1
    b: float = B
    where: str | None = None
    partition_by: tuple[str, ...] = field(default=())
    table: str | None = None
    expression: bool = False

    def __post_init__(self) -> None:
        check_config(self.text_config)
        if not 0.1 <= self.k1 <= 10:
            raise ValueError(f'value {self.k1} out of bounds for option "k1"')
        if not 0 <= self.b <= 1:
            raise ValueError(f'value {self.b} out of bounds for option "b"')

    def text(self, df: DataFrame) -> Column:
        """The text to index; arrays are flattened, other types refused."""
        value = F.expr(self.column) if self.expression else F.col(self.column)
        kind = df.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return flatten_array(value)
        if not isinstance(kind, T.StringType):
            raise TypeError(f'data type {kind.simpleString()} has no default operator class for access method "bm25"')
        return value

    def partition(self) -> Column:
        """The partition a row belongs to, as one string; '' without partitions."""
        if not self.partition_by:
            return F.lit("")
        return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in self.partition_by))

    def documents(self, df: DataFrame) -> DataFrame:
        """(doc_key, part, tokens) of the rows that are documents: those with at least one lexeme."""
        rows = df.where(self.where) if self.where else df
        rows = rows.select(F.col(self.key).alias("doc_key"), self.partition().alias("part"), tokens(self.text(rows), self.text_config).alias("tokens"))
        return rows.where(F.size("tokens") > 0)
