"""Police accident files: one row for each party, and note lines at the end of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "__corrupt"


def read_police_csv(spark: SparkSession, paths: str | list[str], columns: list[tuple[str, str]], numeric: str, party: str | None = None, city: tuple[str, str] | None = None) -> DataFrame:
    """Accidents of the files at ``paths``.

    ``columns`` are (name, SQL type) in file order. Note lines don't have the columns' shape, so they
    come back corrupt or without ``numeric``, a column that every real row has; both are dropped,
    wherever Spark splits the file. With ``party``, only rows of the first party are kept, which
    leaves one row for each accident; ``city`` is (column, value). Filters reach the scan.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t), True) for n, t in columns] + [T.StructField(CORRUPT, T.StringType(), True)])
    rows = spark.read.csv(paths, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    rows = rows.where(F.col(CORRUPT).isNull() & F.col(numeric).isNotNull())
    if party:
        rows = rows.where(F.col(party) == 1)
    if city:
        rows = rows.where(F.col(city[0]) == city[1])
    return rows.drop(CORRUPT)
