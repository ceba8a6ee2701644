"""Summary statistics, a catalog and side lists derived from the driver's tables.

Every view covers its whole source tables; nothing is sampled or cut. The
summary-statistics views are kept as stored tables, so that queries meet them as they
meet an ingested table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.functions.text import short_hash, slug
from statloom.session import scratch_path
from statloom.schemas import BUCKET
from statloom.sources.sinks import store_sumstats
from statloom.sources.sumstats import read_peaks, read_sketches, read_table

_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; its schema is read from the files once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


_stored: dict[tuple[str, str, str], str] = {}
_opened: dict[tuple[str, str, str], DataFrame] = {}


def _store(df: Callable[[], DataFrame], spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a stored table in its native order, written and opened once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        store_sumstats(df(), path)
        _stored[key] = path
        _opened[key] = read_table(spark, path)
    return _opened[key]


def _id(column: Column) -> Column:
    return short_hash(column.cast("string"))


def _letter(letters: str, key: str) -> Column:
    return F.substring(F.lit(letters), (F.lit(1) + F.col(key) % 4).cast("int"), F.lit(1))


#: The largest place that an int holds with room for flanks around it.
INT_PLACES = 2**31 - 1 - 10_000_000


def place_type(df: DataFrame, place: Column) -> str:
    """int, as the SQL has places, where the largest one allows; else bigint, so that no place is lost."""
    top = df.agg(F.max(place)).first()[0]
    return "int" if top is None or top <= INT_PLACES else "bigint"


def _place(key: str, per_step: int) -> Column:
    return F.lit(1) + F.floor(F.col(key) / per_step) * 50_000


def _line_place(spark: SparkSession, sf_dir: str, per_step: int) -> Column:
    place = _place("l_partkey", per_step)
    return place.cast(place_type(table(spark, sf_dir, "lineitem"), place)).alias("POS")


def _grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey")
        .agg(
            F.max("l_discount").alias("discount"),
            F.max("l_tax").alias("tax"),
            F.max("l_quantity").alias("quantity"),
            F.max("l_extendedprice").alias("price"),
        )
    )


def stored_sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (part, supplier): the supplier is the trait, the part the variant. As a stored table, with its bucket of traits."""
    return _store(lambda: _sumstats(spark, sf_dir), spark, sf_dir, "sumstats")


def sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `stored_sumstats`."""
    return stored_sumstats(spark, sf_dir).drop(BUCKET)


def sumstats_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks stored with `stored_sumstats`."""
    stored_sumstats(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "sumstats")
    if (*key[:2], "peaks") not in _opened:
        _opened[(*key[:2], "peaks")] = read_peaks(spark, _stored[key]).drop(BUCKET)
    return _opened[(*key[:2], "peaks")]


def sumstats_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches stored with `stored_sumstats`."""
    stored_sumstats(spark, sf_dir)
    return read_sketches(spark, _stored[(spark.sparkContext.applicationId, sf_dir, "sumstats")]).drop(BUCKET)


def sumstats_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `sumstats`, with several variants at a position, indels and many tied p-values."""
    return _store(lambda: _sumstats_dense(spark, sf_dir), spark, sf_dir, "dense").drop(BUCKET)


def stored_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sumstats` with the project and study of each trait, as a table that is partitioned by them and by buckets of traits."""
    return _store(lambda: _sumstats_by_study(spark, sf_dir), spark, sf_dir, "by_study")


def sumstats_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `stored_by_study`."""
    return stored_by_study(spark, sf_dir).drop(BUCKET)


def _sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped_lines(spark, sf_dir).select(
        (F.lit(1) + F.col("l_partkey") % 22).cast("int").alias("CHR"),
        _id(F.col("l_suppkey")).alias("TRAITID"),
        _line_place(spark, sf_dir, 22),
        _letter("ACGT", "l_partkey").alias("EA"),
        _letter("CGTA", "l_partkey").alias("NEA"),
        (F.col("discount") - 0.05).alias("BETA"),
        (F.lit(0.01) + F.col("tax") / 2).alias("SE"),
        (F.col("quantity") / 51).alias("EAF"),
        (F.col("price") / 10_000).alias("MLOG10P"),
    )


def _sumstats_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    indel = F.when(F.col("l_partkey") % 10 == 0, F.lit("TT")).otherwise(F.lit(""))
    return _grouped_lines(spark, sf_dir).select(
        (F.lit(1) + F.col("l_partkey") % 22).cast("int").alias("CHR"),
        _id(F.col("l_suppkey")).alias("TRAITID"),
        _line_place(spark, sf_dir, 44),
        F.concat(_letter("ACGT", "l_partkey"), indel).alias("EA"),
        _letter("CGTA", "l_partkey").alias("NEA"),
        (F.col("discount") - 0.05).alias("BETA"),
        (F.lit(0.01) + F.col("tax") / 2).alias("SE"),
        (F.col("quantity") / 51).alias("EAF"),
        F.floor(F.col("price") / 10_000).cast("double").alias("MLOG10P"),
    )


def sumstats_without_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sumstats` as stored when p-values are not ingested."""
    return sumstats(spark, sf_dir).drop("MLOG10P")


def suppliers_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation, region and the part that shares their key."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row per supplier, with the record id already known."""
    category = F.element_at(F.array(F.lit("GWAS"), F.lit("pQTL"), F.lit("eQTL")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return suppliers_placed(spark, sf_dir).select(
        F.initcap(F.col("r_name")).alias("project"),
        F.initcap(F.col("n_name")).alias("study"),
        _id(F.col("s_suppkey")).alias("data_id"),
        category.alias("category"),
        F.when(F.col("s_suppkey") % 2 == 0, "GRCh37").otherwise("GRCh38").alias("build"),
        F.concat_ws(" , ", "n_name", "r_name").alias("population"),
        F.col("s_name").alias("notes_source_id"),
        F.when(F.col("s_acctbal") > 0, F.col("p_brand")).alias("notes_consortium"),
        F.floor(F.col("p_retailprice")).cast("bigint").alias("total_samples"),
        F.col("p_name").alias("trait_desc"),
        F.concat_ws("|", "p_type", "p_brand").alias("trait_protein_ids"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records of `manifest`, stored once and read as `read_catalog` reads them."""
    from statloom.operators.catalog import to_catalog_row
    from statloom.plans.ingest import read_catalog
    from statloom.sources.sinks import save_catalog

    key = (spark.sparkContext.applicationId, sf_dir, "catalog")
    if key not in _stored:
        path = scratch_path(spark, "records")
        save_catalog(to_catalog_row(manifest(spark, sf_dir)), path)
        _stored[key] = path
    return read_catalog(spark, _stored[key])


def _sumstats_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = studies.select(
        slug(F.col("r_name")).alias("project"), slug(F.col("n_name")).alias("study"), _id(F.col("s_suppkey")).alias("TRAITID")
    )
    return _sumstats(spark, sf_dir).join(named, "TRAITID")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region per supplier, 10 to 110 kb wide."""
    start = F.col("s_suppkey") * 45_000
    end = start + F.floor(F.abs(F.col("s_acctbal"))) * 10 + 10_000
    suppliers = table(spark, sf_dir, "supplier")
    place = place_type(suppliers, end)
    return suppliers.select(
        (F.lit(1) + F.col("s_suppkey") % 22).cast("int").alias("CHR"),
        start.cast(place).alias("START"),
        end.cast(place).alias("END"),
    )


def overlapping_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region per part; neighbours overlap heavily."""
    start = F.col("p_partkey") * 3_000
    end = start + F.col("p_size") * 10_000
    parts = table(spark, sf_dir, "part")
    place = place_type(parts, end)
    return parts.select(
        (F.lit(1) + F.col("p_partkey") % 22).cast("int").alias("CHR"),
        start.cast(place).alias("START"),
        end.cast(place).alias("END"),
    )


def snp_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per customer, as regions one base long; only some carry a variant."""
    customers = table(spark, sf_dir, "customer")
    start = F.lit(1) + F.col("c_custkey") * 2_500
    start = start.cast(place_type(customers, start))
    return customers.select(
        (F.lit(1) + F.col("c_custkey") % 22).cast("int").alias("CHR"),
        start.alias("START"),
        (start + 1).alias("END"),
    )


def trait_snps(spark: SparkSession, sf_dir: str, source: str = "sumstats") -> DataFrame:
    """Every variant of every trait as a listed SNP, some moved, swapped or on a bare chromosome."""
    rows = sumstats(spark, sf_dir) if source == "sumstats" else sumstats_dense(spark, sf_dir)
    bare = F.col("EAF") > 0.97
    swapped = F.col("CHR") % 5 == 0
    return rows.select(
        "TRAITID",
        F.col("TRAITID").alias("SOURCE_ID"),
        F.when(bare, 23).otherwise(F.col("CHR")).alias("CHR"),
        F.when(F.col("CHR") % 3 == 0, F.col("POS") + 7).otherwise(F.col("POS")).alias("POS"),
        F.when(swapped, F.col("NEA")).otherwise(F.col("EA")).alias("EA"),
        F.when(swapped, F.col("EA")).otherwise(F.col("NEA")).alias("NEA"),
        F.when(F.col("CHR") % 2 == 0, " Cis ").when(F.col("CHR") % 7 == 0, "other").otherwise("trans").alias("CIS_TRANS"),
    )
