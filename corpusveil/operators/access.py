"""Request gates as joins and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorised(requests: DataFrame, keys: DataFrame | None, column: str = "api_key") -> DataFrame:
    """requests plus status_code: 200, or 401 for a missing or unknown key. Without configured
    keys every request passes."""
    if keys is None:
        return requests.withColumn("status_code", F.lit(200))
    known = keys.select(F.col(column), F.lit(200).alias("status_code")).distinct()
    return requests.join(known, column, "left").withColumn("status_code", F.coalesce("status_code", F.lit(401)))


def configured_keys(value: Column) -> Column:
    """Keys of a comma-separated setting, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, ","), lambda k: F.btrim(k)), lambda k: k != "")


def error_response(error_kind: Column, message: Column, batch: bool = False) -> Column:
    """struct<status_code, detail>: unreadable files are 422, anything else 500. A batch entry
    shows the message of an unreadable file; single files and other errors get a fixed text."""
    unreadable = error_kind == "ValueError"
    own = message if batch else F.lit("File is corrupted or unreadable")
    return F.struct(F.when(unreadable, 422).otherwise(500).alias("status_code"), F.when(unreadable, own).otherwise("Internal processing error").alias("detail"))
