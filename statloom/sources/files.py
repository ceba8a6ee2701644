"""Existence, headers and content ids of listed files, worked out on the executors.

Only the listing itself (paths and distinct headers, never file contents)
reaches the driver, as it must for any Spark read of listed files.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 * 1024 * 1024
#: Session setting: the most tasks that probe listed files, and its default.
TASKS_SETTING, MAX_TASKS = "spark.statloom.probeTasks", 20_000
#: Schemes under which Spark reads an object store, and the names that the Python file systems know.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "abfs": "abfs", "hdfs": "hdfs"}


def absolute_column(path: Column) -> Column:
    """Relative paths are meant from the driver's working directory."""
    rooted = path.rlike("^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)")
    return F.when(rooted, path).otherwise(F.concat(F.lit(os.getcwd().rstrip("/") + "/"), path))


def location(path: str) -> str:
    """A listed path as Spark names it in its file metadata: absolute, without a file: prefix."""
    local = re.sub("^file:/+", "/", path)
    if re.match("^[a-zA-Z][a-zA-Z0-9+.-]*:", local):
        return local
    return os.path.normpath(os.path.abspath(local))


def location_column(path: Column) -> Column:
    """The same name from a `_metadata.file_path` column, percent escapes undone."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")


def _open(path: str):
    from pyarrow import fs

    place = location(path)
    if place.startswith("/"):
        system, inner = fs.LocalFileSystem(), place
    else:
        scheme, rest = place.split(":", 1)
        system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme)}:{rest}")
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    return system.open_input_stream(inner, compression=None)


def _content_digest(path: str) -> str | None:
    stream = _open(path)
    if stream is None:
        return None
    digest = hashlib.sha256()
    with stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _gzip_header(path: str) -> str | None:
    stream = _open(path)
    if stream is None:
        return None
    inflate, text = zlib.decompressobj(wbits=31), b""
    with stream:
        while b"\n" not in text and (chunk := stream.read(65_536)):
            text += inflate.decompress(chunk)
    return text.split(b"\n", 1)[0].decode().strip()


def _probe(batches: Iterator[pd.DataFrame], probe) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"file_path": batch["file_path"], "found": [probe(p) for p in batch["file_path"]]})


def _per_file(paths: DataFrame, probe) -> DataFrame:
    """One task per listed file (up to the session's limit), however short the listing itself is."""
    listed = paths.select("file_path").distinct()
    most = int(paths.sparkSession.conf.get(TASKS_SETTING, str(MAX_TASKS)))
    spread = listed.repartition(max(1, min(listed.count(), most)))
    return spread.mapInPandas(lambda batches: _probe(batches, probe), "file_path string, found string")


def content_ids(paths: DataFrame, length: int | None = 10) -> DataFrame:
    """file_path, data_id: the hash of (hash of the file name, hash of its bytes), cut to `length`.

    Bytes are streamed in chunks, so a file of any size takes little memory.
    A missing file has a null id.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    bound = F.sha2(F.concat(F.sha2(name, 256), F.col("found")), 256)
    cut = bound if length is None else F.substring(bound, 1, length)
    return _per_file(paths, _content_digest).select("file_path", cut.alias("data_id"))


def _parquet_columns(path: str) -> str | None:
    """Column names and types in a Parquet file's footer, as JSON; of a folder, those of its first file."""
    import json

    from pyarrow import dataset, fs

    place = location(path)
    if place.startswith("/"):
        system, inner = fs.LocalFileSystem(), place
    else:
        scheme, rest = place.split(":", 1)
        system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme)}:{rest}")
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    schema = dataset.dataset(inner, filesystem=system, format="parquet").schema
    return json.dumps([[f.name, str(f.type)] for f in schema])


def _grouped(spark: SparkSession, paths: list[str], probe) -> dict[str, list[str]]:
    """What a probe finds to the files it finds it in; an absent file is an error that names it."""
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    grouped: dict[str, list[str]] = {}
    absent = []
    for row in _per_file(listed, probe).collect():
        if row["found"] is None:
            absent.append(row["file_path"])
        else:
            grouped.setdefault(row["found"], []).append(row["file_path"])
    if absent:
        raise ValueError(f"{len(absent)} listed files do not exist: {', '.join(sorted(absent))}")
    return {found: sorted(files) for found, files in sorted(grouped.items())}


def gzip_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Distinct header line to the files that have it; only the first block of a file is read."""
    return _grouped(spark, paths, _gzip_header)


def parquet_layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Distinct columns (JSON list of name and type) to the Parquet files that have them; only footers are read."""
    return _grouped(spark, paths, _parquet_columns)
