"""The analysis' index: tables in one folder, loaded once a session."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import AnalysisError

REQUIRED = ("accidents", "crossings", "nodes", "edges")


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Stores the tables; accidents are clustered by grid cell, so that circles touch few row groups."""
    for name, df in tables.items():
        if name == "accidents":
            df = df.repartitionByRange("x", "y").sortWithinPartitions("x", "y")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


class Index:
    """Tables of ``write_index``. A missing baseline stops the load; missing places only stop searches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name in REQUIRED:
            setattr(self, name, self._read(name))
        try:
            self.baseline = self._read("baseline")
        except AnalysisException as e:
            raise RuntimeError("the baseline is missing; build it first") from e
        try:
            self._places = self._read("places")
        except AnalysisException:
            self._places = None

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def places(self) -> DataFrame:
        if self._places is None:
            raise AnalysisError("DATA_UNAVAILABLE", "the place index is missing; build it first", 503)
        return self._places
