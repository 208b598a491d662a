"""Where a row was read from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_path() -> Column:
    """Path of the row's file as file listings give it; the metadata column has
    it percent-encoded."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded).alias("file_path")


def file_name() -> Column:
    return F.regexp_extract(file_path(), "([^/]*)$", 1).alias("file_name")
