"""JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_documents(rows: DataFrame, path: str, body: str | None = None) -> None:
    """A JSON document a line: the column ``body`` if given, else all columns as one object."""
    text = F.col(body) if body else F.to_json(F.struct("*"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
