"""Reading summary-statistics files and the stored table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from statloom.schemas import BUCKET, GROUP_COLUMNS, INPUT_TYPES, input_columns
from statloom.sources import store
from statloom.sources.files import gzip_headers, parquet_layouts
from statloom.sources.sinks import PEAKS, SKETCHES


def cast_sumstats(df: DataFrame, with_pvalue: bool = True, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """The required columns in their declared types; MLOG10P only when p-values are ingested.

    `place` is the type of POS: bigint for positions that an int does not hold, which it refuses.
    """
    missing = [c for c in input_columns(with_pvalue) if c not in df.columns]
    if missing:
        raise ValueError(f"the input lacks the columns {', '.join(missing)}")
    extra = [c for c in ("TRAITID", "file_path") if c in df.columns]
    types = INPUT_TYPES | {"POS": place}
    return df.select(*extra, *[F.col(c).cast(types[c]).alias(c) for c in input_columns(with_pvalue)])


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def read_sumstats_tsv(spark: SparkSession, paths: Sequence[str], with_pvalue: bool = True, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """gzip TSV files; columns may come in any order, differ between files and hold extras.

    Files are read together per distinct header, so a thousand files of one layout are one scan.
    """
    parts = []
    for header, files in gzip_headers(spark, list(paths)).items():
        names = header.split("\t")
        _require(names, files, with_pvalue)
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.csv(files, sep="\t", header=True, schema=schema, nullValue="NA")
        parts.append(cast_sumstats(_with_path(raw), with_pvalue, place))
    if not parts:
        raise ValueError("there is no tsv.gz file to read")
    return reduce(DataFrame.unionByName, parts)


def _require(names: Sequence[str], files: Sequence[str], with_pvalue: bool) -> None:
    missing = [c for c in input_columns(with_pvalue) if c not in names]
    if missing:
        raise ValueError(f"the columns {', '.join(missing)} are absent from {len(files)} files, such as {files[0]}")


def read_sumstats_parquet(spark: SparkSession, paths: Sequence[str], with_pvalue: bool = True, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """Parquet files; only the required columns are read.

    Every footer is looked at, on the executors: a file that lacks a required column is an error, and
    files are read together per distinct layout.
    """
    parts = []
    for layout, files in parquet_layouts(spark, list(paths)).items():
        _require([name for name, _ in json.loads(layout)], files, with_pvalue)
        parts.append(cast_sumstats(_with_path(spark.read.parquet(*files)), with_pvalue, place))
    if not parts:
        raise ValueError("there is no Parquet file to read")
    return reduce(DataFrame.unionByName, parts)


def read_sumstats_files(spark: SparkSession, paths: Sequence[str], with_pvalue: bool = True, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """Parquet and gzip TSV files by suffix; any other suffix is an error. `place` is the type of POS, see `cast_sumstats`."""
    by_kind: dict[str, list[str]] = {"parquet": [], "gz": []}
    for path in paths:
        kind = path.lower().rsplit(".", 1)[-1]
        if kind not in by_kind:
            raise ValueError(f"cannot read {path}: a file of summary statistics ends in .parquet or .tsv.gz")
        by_kind[kind].append(path)
    parts = []
    if by_kind["parquet"]:
        parts.append(read_sumstats_parquet(spark, by_kind["parquet"], with_pvalue, place))
    if by_kind["gz"]:
        parts.append(read_sumstats_tsv(spark, by_kind["gz"], with_pvalue, place))
    if not parts:
        raise ValueError("no file is listed")
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, partitioned by project, study and bucket of traits (`trait_bucket`, which `in_traits` uses and drops).

    Only batches that the table's log names are read, as of now; its columns come from the log, so no footer is read to plan a
    query. A folder of files without a log is read as it is, with the columns of one footer.
    """
    version = store.latest(spark, path)
    if version.number:
        return store.read_parts(spark, path, version)
    return spark.read.option("mergeSchema", "false").parquet(path)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """The peaks of the stored table (see `operators.peaks`), from the same batches."""
    version = store.latest(spark, path)
    if not version.number:
        raise ValueError(f"{path} is not a stored table: it has no log")
    columns = StructType.fromJson(json.loads(version.schema))
    groups = [c for c in GROUP_COLUMNS if c in columns.names]
    top = columns["MLOG10P"].dataType.simpleString() if "MLOG10P" in columns.names else "double"
    place = columns["POS"].dataType.simpleString()
    wanted = f"TRAITID string, {BUCKET} int, CHR int, bin int, n long, first {place}, last {place}, top {top}, top_at {place}" + "".join(f", {c} string" for c in groups)
    return store.read_parts(spark, f"{path.rstrip('/')}{PEAKS}", version, columns=T._parse_datatype_string(wanted))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of spreads of the stored table (see `operators.summaries.spread_sketches`), from the same batches."""
    version = store.latest(spark, path)
    if not version.number:
        raise ValueError(f"{path} is not a stored table: it has no log")
    columns = StructType.fromJson(json.loads(version.schema))
    if not {"SE", "EAF"} <= set(columns.names):
        raise ValueError(f"{path} has no sketches: it is stored without SE or EAF")
    groups = [c for c in GROUP_COLUMNS if c in columns.names]
    wanted = f"TRAITID string, {BUCKET} int, maf_class int, n long, sketch binary" + "".join(f", {c} string" for c in groups)
    return store.read_parts(spark, f"{path.rstrip('/')}{SKETCHES}", version, columns=T._parse_datatype_string(wanted))
