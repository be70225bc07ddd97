"""Stable presentation of results: rounded doubles, times as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Select ``cols`` (all by default) with doubles rounded and times in ISO text."""
    names = cols or df.columns
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    out = []
    for c in names:
        if types[c] in ("double", "float"):
            out.append((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c))
        elif types[c] in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        elif types[c] == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        elif types[c] == "boolean":
            out.append(F.col(c).cast("int").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
