"""The result table: one row of indicators per location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

RESULT_SCHEMA = (
    "location_id long, latitude double, longitude double, name string, radius int, "
    "sparsity double, resilience double, multi_nodality double, permeability double, "
    "emergence double, overlap double"
)


def read_results(spark: SparkSession, *paths: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """CSV result table; the first path that exists wins."""
    for path in paths:
        try:
            return spark.read.csv(path, header=True, schema=schema)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"none of {paths} exists")


def write_results(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
