"""The manifest: a delimited table of files to ingest with their metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.schemas import MANIFEST_TYPES, REQUIRED_MANIFEST_COLUMNS


def read_manifest(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """All columns as text but the declared counts; rows that do not fit the header are an error."""
    try:
        raw = spark.read.csv(path, sep=delimiter, header=True, mode="FAILFAST")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ValueError(f"the manifest {path} does not exist") from error
        raise ValueError(f"the manifest {path} cannot be read as a table") from error
    if not raw.columns:
        raise ValueError(f"the manifest {path} is empty")
    return raw.select(*[F.col(f"`{c}`").cast(MANIFEST_TYPES.get(c, "string")).alias(c) for c in raw.columns])


def require_columns(manifest: DataFrame) -> DataFrame:
    """The manifest itself, or an error naming the required columns it lacks."""
    missing = [c for c in REQUIRED_MANIFEST_COLUMNS if c not in manifest.columns]
    if missing:
        raise ValueError(f"the manifest lacks the columns {', '.join(missing)}")
    return manifest
