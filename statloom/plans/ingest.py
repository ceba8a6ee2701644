"""Ingest: manifest to catalog records and rows of the stored table."""

from __future__ import annotations

import logging

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.text import slug
from statloom.operators.catalog import catalog_delete, catalog_modify, catalog_upsert, to_catalog_row, validate_catalog
from statloom.operators.joins import broadcast_if_small
from statloom.operators.slices import validate_sumstats
from statloom.schemas import CATALOG_KEY, CATALOG_SCHEMA, GROUP_COLUMNS, INPUT_TYPES, POS_DOMAIN
from statloom.session import cut_lineage, free_scratch, scratch_freed, scratch_path, scratch_paths
from statloom.sources import store
from statloom.sources.files import absolute_column, content_ids, location, location_column
from statloom.sources.manifest import require_columns
from statloom.sources.sinks import TRAITS, replace_records, store_sumstats
from statloom.sources.sumstats import read_sumstats_files, read_table

log = logging.getLogger(__name__)


def known_files(manifest: DataFrame) -> DataFrame:
    """Manifest rows with `data_id`; files that do not exist are logged and left out.

    Every file is hashed once: the ids are written to the shared folder before they are used.
    """
    named = require_columns(manifest).withColumn("file_path", absolute_column(F.col("file_path")))
    ids = cut_lineage(content_ids(named), "ids")
    report(ids.where(F.col("data_id").isNull()).select("file_path"), "files that do not exist and are skipped")
    return named.join(broadcast_if_small(ids.where(F.col("data_id").isNotNull())), "file_path")


def report(df: DataFrame, what: str) -> int:
    """Log how many rows there are, each of them below it, and where the whole list is kept; nothing for none."""
    path = scratch_path(df.sparkSession, "report")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    count = kept.count()
    if count:
        log.warning("%d %s; the list is in %s", count, what, path)
        for row in kept.toLocalIterator():
            log.warning("  %s", ", ".join(str(v) for v in row))
    else:
        free_scratch(df.sparkSession, path)
    return count


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalog, as its log has it now; an empty one where nothing is stored yet."""
    return store.read_parts(spark, path, store.latest(spark, path), columns=CATALOG_SCHEMA)


def ingest_metadata(files: DataFrame, catalog_path: str) -> None:
    """Upsert the records of `known_files` rows; partitions without news are not touched."""
    spark = files.sparkSession
    records = validate_catalog(to_catalog_row(files))
    wrong = report(records.where("not valid").select("project", "study", "data_id"), "records with a wrong category, build or key")
    if wrong:
        raise ValueError(f"{wrong} records have a wrong category, build or key; see the log for the list")
    fresh = cut_lineage(records.drop("valid"), "records")  # the same dates if it is stored at a second attempt
    touched = broadcast_if_small(fresh.select(*GROUP_COLUMNS).distinct())

    def make(stored: DataFrame):
        own = stored.join(touched, list(GROUP_COLUMNS), "left_semi")
        return catalog_upsert(own, fresh), None

    replace_records(spark, catalog_path, make)


def modify_records(spark: SparkSession, catalog_path: str, patch: DataFrame) -> int:
    """Store changes to named fields of existing records (see `catalog_modify`); returns how many records changed.

    Only the partitions of the patch are read and written again; they are replaced at once.
    """
    changed = 0
    with scratch_freed(spark):
        patch = cut_lineage(patch, "patch")  # it may come from the stored catalog itself
        touched = patch.select(*GROUP_COLUMNS).distinct()

        def make(stored: DataFrame):
            nonlocal changed
            own = stored.join(broadcast_if_small(touched), list(GROUP_COLUMNS), "left_semi")
            done = cut_lineage(catalog_modify(own, patch), "modified")
            changed = done.where("updated").count()
            return (done.drop("updated"), None) if changed else None

        replace_records(spark, catalog_path, make)
    return changed


def delete_records(spark: SparkSession, catalog_path: str, keys: DataFrame) -> int:
    """Take the records with the given keys from the stored catalog; returns how many there were.

    A reader sees all of them or none; a partition whose records all go is no longer part of the catalog.
    """
    gone = 0
    with scratch_freed(spark):
        keys = cut_lineage(keys.select(*CATALOG_KEY), "keys")  # they may come from the stored catalog itself
        touched = keys.select(*GROUP_COLUMNS).distinct()

        def make(stored: DataFrame):
            nonlocal gone
            own = stored.join(broadcast_if_small(touched), list(GROUP_COLUMNS), "left_semi")
            left = cut_lineage(catalog_delete(own, keys), "left")
            gone = own.count() - left.count()
            return (left, touched) if gone else None

        replace_records(spark, catalog_path, make)
    return gone


def stored_traits(spark: SparkSession, table_path: str) -> DataFrame:
    """project, study, TRAITID of every trait the table holds, from the ledger that each batch brings with its rows.

    Of a folder of files without a log, the rows are read.
    """
    key = [*GROUP_COLUMNS, "TRAITID"]
    columns = T.StructType([T.StructField(c, T.StringType()) for c in key])
    version = store.latest(spark, table_path)
    if version.number:
        return store.read_parts(spark, f"{table_path.rstrip('/')}{TRAITS}", version, columns=columns).distinct()
    try:
        return read_table(spark, table_path).select(*key).distinct()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], columns)


def _same_layout(spark: SparkSession, table_path: str, with_pvalue: bool, place: str) -> None:
    """A table is stored with or without p-values, not both; wide places do not go to one that holds narrow ones."""
    version = store.latest(spark, table_path)
    if not version.number:
        return
    types = dict(read_table(spark, table_path).dtypes)
    if ("MLOG10P" in types) != with_pvalue:
        raise ValueError(f"the table {table_path} is stored with{'out' if with_pvalue else ''} p-values")
    if types["POS"] == INPUT_TYPES["POS"] != place:
        raise ValueError(f"the table {table_path} holds places as {types['POS']}, not {place}")


def _has_odd(seen: Observation, checked: DataFrame) -> bool:
    """Whether invalid rows passed; where nothing valid was left to write, Spark may end without having told, and they are looked for."""
    try:
        return seen.get["odd"] > 0
    except Py4JJavaError:
        return not checked.where("not valid").isEmpty()


def ingest_sumstats(
    files: DataFrame, table_path: str, with_pvalue: bool = True, dedup: bool = False, files_per_job: int = 10_000, batch: str | None = None,
    place: str = INPUT_TYPES["POS"],
) -> DataFrame | None:
    """Append the rows of `known_files` to the table; returns quarantined rows if there are any.

    Ingesting a file again duplicates its rows, unless `dedup` leaves out traits that the table's
    ledger names. Files are taken `files_per_job` at a time, so that many paths reach the driver at once at most.
    Each job is one batch of the table: its rows and its part of the ledger count together, once it is done. With `batch`, a name
    for this ingest, jobs that were done before a failure are left out when it is run again. Invalid rows are counted as
    they pass; only if there are some are their files read again, and the rows written to the shared folder. `place` is the type
    of POS: bigint for positions that an int does not hold, which then have no last one.
    """
    spark = files.sparkSession
    _same_layout(spark, table_path, with_pvalue, place)
    last = POS_DOMAIN[1] if place == INPUT_TYPES["POS"] else None
    key = [*GROUP_COLUMNS, "TRAITID"]
    listed = files.select(
        *[slug(F.col(c)).alias(c) for c in GROUP_COLUMNS], F.col("data_id").alias("TRAITID"), "file_path"
    )
    if dedup:
        listed = listed.join(broadcast_if_small(stored_traits(spark, table_path)), key, "left_anti")
    jobs = max(1, -(-files.select("file_path").distinct().count() // files_per_job))
    listed = cut_lineage(listed.withColumn("job", F.pmod(F.xxhash64("file_path"), F.lit(jobs))), "listed")
    odd = []
    for job in range(jobs):
        part = listed.where(F.col("job") == job).drop("job")
        names = sorted(r["file_path"] for r in part.select("file_path").distinct().collect())
        if not names:
            continue
        named = spark.createDataFrame([(p, location(p)) for p in names], "file_path string, location string")
        owners = part.join(broadcast_if_small(named), "file_path").drop("file_path")
        rows = read_sumstats_files(spark, names, with_pvalue, place)
        rows = rows.withColumn("location", location_column(F.col("file_path"))).drop("file_path")
        checked = validate_sumstats(rows.join(broadcast_if_small(owners), "location").drop("location"), last)
        seen = Observation()
        passing = checked.observe(seen, F.count_if(~F.col("valid")).alias("odd")).where("valid").drop("valid")
        stored = store_sumstats(passing, table_path, None if batch is None else f"{batch}/{job}", part)
        if stored and _has_odd(seen, checked):
            odd.append(checked.where("not valid").drop("valid"))
    return reduce(DataFrame.unionByName, odd) if odd else None


def ingest(
    manifest: DataFrame,
    table_path: str,
    catalog_path: str,
    what: str = "both",
    with_pvalue: bool = True,
    dedup: bool = False,
    batch: str | None = None,
    place: str = INPUT_TYPES["POS"],
) -> DataFrame | None:
    """Ingest metadata, data or both, after one existence check for either.

    `batch` names the ingest: run again under the same name, it adds what is missing and nothing twice; `place` is the type of POS
    (see `ingest_sumstats` for both).
    Scratch folders go when the ingest ends, but for quarantined rows and the lists that the log names.
    """
    if what not in ("metadata", "data", "both"):
        raise ValueError("what must be 'metadata', 'data' or 'both'")
    spark, quarantine = manifest.sparkSession, None
    with scratch_freed(spark) as kept:
        files = known_files(manifest)
        if what in ("metadata", "both"):
            ingest_metadata(files, catalog_path)
        if what in ("data", "both"):
            quarantine = ingest_sumstats(files, table_path, with_pvalue, dedup, batch=batch, place=place)
        if quarantine is not None:
            path = scratch_path(spark, "quarantine")
            quarantine.write.parquet(path)
            kept.add(path)
            quarantine = spark.read.schema(quarantine.schema).parquet(path)
            log.warning("%d rows lie outside the domains and were not stored; they are in %s", quarantine.count(), path)
        kept.update(p for p in scratch_paths(spark) if "/report-" in p)
    return quarantine
