"""CSV and Parquet files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.errors import NotFoundError


#: Rows of a CSV source from which types are inferred unless said otherwise.
INFER_ROWS = 1000


def read_csv(spark: SparkSession, path: str | Path, schema: T.StructType | str | None = None, infer_rows: int | None = INFER_ROWS) -> DataFrame:
    """Comma-separated text with a header.

    Without a schema types are inferred from the first ``infer_rows`` rows, or
    from all rows (None), which reads everything once more. A later row that
    does not fit the types is an error where its columns are read, never a
    silent NULL.
    """
    if schema is None:
        inferring = spark.read.option("header", True).option("inferSchema", True).option("preferDate", False)
        if infer_rows is None:
            return _found(lambda: inferring.csv(str(path)), path)
        first = [r.value for r in _found(lambda: spark.read.text(str(path)), path).limit(infer_rows + 1).collect()]
        header, rows = first[:1], [line for line in first[1:] if line != first[0]]  # each file of a folder repeats the header
        schema = inferring.csv(spark.sparkContext.parallelize(header + rows, 1)).schema
    return _found(lambda: spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(str(path)), path)


#: Schemas of single local files by path, time of change and size; reading a footer is a Spark job, often longer than a small query.
_schemas: dict[tuple[str, int, int], T.StructType] = {}


def read_parquet(spark: SparkSession, path: str | Path) -> DataFrame:
    """Parquet; columns and, by filters that NaN can't pass, row groups are pruned by the scan. The schema of a file that has not changed is not read again."""
    known = None
    if os.path.isfile(path):
        state = os.stat(path)
        known = (os.path.abspath(path), state.st_mtime_ns, state.st_size)
        if known in _schemas:
            return spark.read.schema(_schemas[known]).parquet(str(path))
    found = _found(lambda: spark.read.parquet(str(path)), path)
    if known:
        _schemas[known] = found.schema
    return found


def _found(read, path) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise NotFoundError(f"no file at {path}") from error
        raise
