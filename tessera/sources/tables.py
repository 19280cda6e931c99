"""Parquet sources as lazy relations, and the declared type names of the SQL front end."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TYPES = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampType(), "BLOB": T.BinaryType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "DATE": T.DateType(),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run text; each table it names is read from sf_dir. Missing files raise."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def declared(name: str, size: int | None = None) -> T.DataType:
    """Spark type of a declared SQL type; unknown names are text, decimals keep their scale."""
    base = name.upper()
    if base in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(38, 6)
    return TYPES.get(base, T.StringType())
