"""Tables as text: one "header: value" line per filled cell. Native for DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_lines(columns: list[str]) -> Column:
    """The lines of one row; null and empty cells are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("head"), F.col(c).cast("string").alias("cell")) for c in columns])
    filled = F.filter(cells, lambda c: F.coalesce(c.cell != "", F.lit(False)))
    return F.array_join(F.transform(filled, lambda c: F.concat(c.head, F.lit(": "), c.cell, F.lit("\n"))), "")


def flatten_table(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, text: all rows of a key as lines, by `order`."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), row_lines(columns).alias("lines"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["lines"]), "").alias("text"))


def headers_only(columns: list[str]) -> str:
    """The text of a table without rows: "index: name" lines."""
    return "".join(f"{i}: {c}\n" for i, c in enumerate(columns) if c)
