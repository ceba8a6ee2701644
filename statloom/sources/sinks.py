"""Writing the stored tables and results."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from statloom.functions.text import trait_bucket
from statloom.operators.peaks import peak_table
from statloom.operators.summaries import spread_sketches
from statloom.schemas import BUCKET, CATALOG_SCHEMA, DIMENSIONS, GROUP_COLUMNS
from statloom.session import setting
from statloom.sources import store

log = logging.getLogger(__name__)

#: What a table's path ends in for the folders of its peaks, its sketches and of the traits it holds.
PEAKS, SKETCHES, TRAITS = "_peaks", "_sketches", "_traits"
#: Spark's setting that makes more, smaller tasks than sizes ask for, to occupy all cores.
BY_SIZE = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: Spark's setting of the bytes that a task reads of files, and the rows of a stored batch that one reads at most to describe it.
SPLIT_BYTES, DESCRIBED_ROWS = "spark.sql.files.maxPartitionBytes", 1_000_000

FORMATS = ("parquet", "csv.gz", "csv")


def append_sumstats(df: DataFrame, path: str) -> None:
    """Append files: partitioned by project, study and bucket of traits, sorted by CHR, TRAITID, POS.

    Rows are dealt by partition and chromosome with the rebalance hint, which needs no sampling pass: the
    input is read once, and Spark splits large parts and joins small ones by their measured size (and by that alone, not to
    occupy all cores: a small batch makes few files). So files have bounded sizes, whatever study, trait or chromosome
    holds most rows.
    """
    keyed = df.withColumn(BUCKET, trait_bucket(F.col("TRAITID")))
    groups = [*[c for c in GROUP_COLUMNS if c in df.columns], BUCKET]
    ordered = keyed.hint("rebalance", *groups, "CHR").sortWithinPartitions(*groups, *DIMENSIONS)
    with setting(df.sparkSession, BY_SIZE, "false"):
        ordered.write.partitionBy(*groups).option("compression", "zstd").mode("append").parquet(path)


def stored_columns(df: DataFrame) -> StructType:
    """Columns of the files of `append_sumstats`, the partition columns last."""
    groups = [c for c in GROUP_COLUMNS if c in df.columns]
    own = [f for f in df.schema.fields if f.name not in (*groups, BUCKET)]
    parts = [T.StructField(c, T.StringType()) for c in groups] + [T.StructField(BUCKET, T.IntegerType())]
    return StructType([T.StructField(f.name, f.dataType) for f in own] + parts)


def store_sumstats(df: DataFrame, table: str, name: str | None = None, traits: DataFrame | None = None) -> bool:
    """Add a batch to the stored table: its rows, their peaks, and the traits it brought (`traits`, or those of the rows).

    All three count from the moment that the table's log names the batch, and not before: a batch that fails on the way
    leaves nothing that a reader sees. A batch whose `name` the log has already is left out (False).
    """
    spark, table = df.sparkSession, table.rstrip("/")
    before = store.latest(spark, table)
    if name is not None and name in before.done:
        return False
    if not before.number and _has_parquet(spark, table):
        raise ValueError(f"{table} holds files that no log names; store its rows anew")
    batch, columns = store.new_batch(), stored_columns(df)
    append_sumstats(df, f"{table}/{batch}")
    _describe(spark, table, batch, columns, traits)

    def step(now: store.Version) -> store.Version | None:
        if name is not None and name in now.done:
            return None
        done = now.done if name is None else (*now.done, name)
        return replace(now, parts=(*now.parts, batch), done=done, schema=now.schema or columns.json())

    return batch in store.change(spark, table, step).parts


def _split_bytes(spark: SparkSession, path: str, rows: int) -> str:
    """The session's bytes a task, or less where these hold more than DESCRIBED_ROWS rows.

    Sorted rows of few values take a few bytes each; tasks sized by bytes alone would get so many that what they gather spills.
    """
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return str(max(1, min(most, store.size_of(spark, path) * DESCRIBED_ROWS // max(1, rows))))


def _describe(spark: SparkSession, table: str, batch: str, columns: StructType, traits: DataFrame | None = None) -> None:
    """Write what goes beside the rows of a batch: their peaks, sketches of their spreads, and the traits.

    Results are dealt by project and study, whose folders else had a file from each task; a table without these is
    written as it was grouped, without another shuffle.
    """
    written = store.read_parts(spark, table, store.Version(), [batch], columns)
    groups = [c for c in GROUP_COLUMNS if c in columns.names]
    dealt = lambda df, *by: df.hint("rebalance", *by) if groups else df
    with setting(spark, BY_SIZE, "false"), setting(spark, SPLIT_BYTES, _split_bytes(spark, f"{table}/{batch}", written.count())):
        if {"MLOG10P", "BETA"} & set(columns.names):
            peaks = dealt(peak_table(written), *groups, "CHR").sortWithinPartitions(*groups, "CHR", "TRAITID", "bin")
            peaks.write.partitionBy(*groups).option("compression", "zstd").parquet(f"{table}{PEAKS}/{batch}")
        if {"SE", "EAF"} <= set(columns.names):
            sketches = dealt(spread_sketches(written), *groups).sortWithinPartitions(*groups, "TRAITID", "maf_class")
            sketches.write.partitionBy(*groups).parquet(f"{table}{SKETCHES}/{batch}")
    key = [*groups, "TRAITID"]
    brought = written.select(*key) if traits is None else traits.select(*key)
    brought.distinct().write.parquet(f"{table}{TRAITS}/{batch}")


def compact_sumstats(spark: SparkSession, table: str, batches: Sequence[str] | None = None, file_bytes: int = 512 * 1024 * 1024) -> bool:
    """Merge batches (all, or the listed ones) into one whose files follow each other in the table's natural order.

    Within a partition no two files overlap in (CHR, TRAITID, POS), so a trait or a stretch of a chromosome lies in few of
    them. Rows are dealt by range, into as many tasks as the files that are merged ask for. The new files replace the old
    ones at once, when the log names them; False if the batches were changed meanwhile (then nothing is). Old files stay until
    `store.vacuum`.
    """
    table = table.rstrip("/")
    now = store.latest(spark, table)
    old = tuple(now.parts if batches is None else batches)
    if len(old) < 2 or not set(old) <= set(now.parts):
        return False
    rows, columns = store.read_parts(spark, table, now, old), StructType.fromJson(json.loads(now.schema))
    groups = [*[c for c in GROUP_COLUMNS if c in columns.names], BUCKET]
    tasks = max(1, -(-sum(store.size_of(spark, f"{table}/{p}") for p in old) // file_bytes))
    batch, order = store.new_batch(), [*groups, *DIMENSIONS]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.write.partitionBy(*groups).option("compression", "zstd").parquet(f"{table}/{batch}")
    traits = store.read_parts(spark, f"{table}{TRAITS}", now, old, StructType([f for f in columns.fields if f.name in (*GROUP_COLUMNS, "TRAITID")]))
    _describe(spark, table, batch, columns, traits)

    def step(found: store.Version) -> store.Version | None:
        if not set(old) <= set(found.parts):
            return None
        return replace(found, parts=(*[p for p in found.parts if p not in old], batch))

    return batch in store.change(spark, table, step).parts


def _has_parquet(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return False
    visible = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return any(f"/{store.BATCH}=" not in f for f in visible.inputFiles())


def save_catalog(df: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """Store records in place of those of the partitions (project, study) present and of those `touched`.

    The new records are written beside the old ones and replace them at once, when the catalog's log names them: a reader sees the
    records before or after, and a write that fails leaves the old ones. Partitions that are not named stay as they are.
    """
    replace_records(df.sparkSession, path, lambda _: (df, touched))


def replace_records(spark: SparkSession, path: str, make: Callable[[DataFrame], tuple[DataFrame, DataFrame | None] | None]) -> None:
    """Store what `make` makes of the stored records, as `save_catalog` does; made anew if another writer was faster.

    `make` gets the records and returns the new ones and the partitions they stand for (or None to leave all as it is).
    """
    path, depth = path.rstrip("/"), len(GROUP_COLUMNS)

    def step(now: store.Version) -> store.Version | None:
        made = make(store.read_parts(spark, path, now, columns=CATALOG_SCHEMA))
        if made is None:
            return None
        records, touched = made
        batch = store.new_batch()
        records.write.partitionBy(*GROUP_COLUMNS).parquet(f"{path}/{batch}")
        fresh = store.partitions_of(spark, path, batch, depth)
        gone = {p.removeprefix(f"{batch}/") for p in fresh}
        if touched is not None:
            escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            for row in touched.select(*GROUP_COLUMNS).distinct().toLocalIterator():
                gone.add("/".join(f"{c}={escape(row[c]) if row[c] else '__HIVE_DEFAULT_PARTITION__'}" for c in GROUP_COLUMNS))
        kept = [p for p in now.parts if p.split("/", 1)[1] not in gone]
        return replace(now, parts=(*kept, *fresh))

    store.change(spark, path, step)


def _write(df: DataFrame, target: str, file_format: str, partition_by: tuple[str, ...]) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if file_format == "parquet":
        writer.option("compression", "snappy").parquet(target)
    elif file_format == "csv.gz":
        writer.option("header", True).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").csv(target)
    else:
        writer.option("header", True).csv(target)


def _has_files(df: DataFrame, target: str) -> bool:
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    return bool(files.inputFiles())


def write_result(df: DataFrame, path: str, file_format: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a result directory `<path>.<format>`; csv carries a header, csv.gz uses fast gzip.

    A frame without rows still leaves a file with its header or schema.
    """
    if file_format not in FORMATS:
        raise ValueError(f"unknown file format {file_format!r}; choose from {', '.join(FORMATS)}")
    target = f"{path}.{file_format}"
    _write(df, target, file_format, partition_by)
    if partition_by and not _has_files(df, target):
        log.warning("Nothing to write to %s", target)
        _write(df.sparkSession.createDataFrame([], df.schema).coalesce(1), target, file_format, ())
    return target


def write_partitioned_by_trait(df: DataFrame, names: DataFrame, path: str, file_format: str = "parquet") -> str:
    """One job for all traits: a directory per output name below `<path>.<format>`.

    `names` maps the trait keys to `output_prefix`. Rows are dealt by name with the rebalance hint, so the
    analysis runs once, and a trait is written by as many tasks as its size needs.
    """
    from statloom.operators.joins import broadcast_if_small

    groups = [c for c in GROUP_COLUMNS if c in df.columns and c in names.columns]
    keyed = names.withColumnRenamed("data_id", "TRAITID").select(*groups, "TRAITID", "output_prefix")
    named = df.join(broadcast_if_small(keyed), [*groups, "TRAITID"])
    place = [c for c in ("CHR", "POS", "SOURCEID_SNP") if c in df.columns]
    dealt = named.hint("rebalance", "output_prefix").sortWithinPartitions("output_prefix", *place)
    return write_result(dealt, path, file_format, ("output_prefix",))


def write_metadata_sidecar(meta: DataFrame, prefix: str) -> str:
    """`<prefix>_meta.csv` with the matched records; list columns as text."""
    flat = meta.select(
        *[F.to_json(c).alias(c) if t.startswith(("array", "map")) else F.col(c) for c, t in meta.dtypes]
    )
    return write_result(flat, f"{prefix}_meta", "csv")
