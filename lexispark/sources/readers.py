"""Document readers for the usual files; all are lazy scans with pushed filters where the format has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_documents(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """kind: parquet, orc, json, csv or tsv. Text formats want a schema, so that nothing is read twice to guess one."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("parquet", "orc"):
        return reader.format(kind).options(**options).load(path)
    if kind in ("json", "csv", "tsv"):
        if not schema:
            raise ValueError(f"{kind} files need a schema")
        fixed = {"sep": "\t", "quote": "", "escape": ""} if kind == "tsv" else {}
        return reader.format("csv" if kind == "tsv" else kind).options(**fixed | options).load(path)
    raise ValueError(f"unknown file kind {kind!r}")
