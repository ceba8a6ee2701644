"""Region lists, SNP lists and trait-SNP lists."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.variants import normalise_chr, valid_alleles
from statloom.schemas import INPUT_TYPES

log = logging.getLogger(__name__)

TRAIT_SNP_COLUMNS = ("SOURCE_ID", "CHR", "POS", "EA", "NEA")


def _numeric_chr(df: DataFrame) -> DataFrame:
    return df.withColumn("CHR", normalise_chr(F.col("CHR"))).where(F.col("CHR").isNotNull())


def clean_regions(raw: DataFrame, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """CHR, START, END as text to typed regions (`place`: the type of positions); rows on non-numeric chromosomes drop out."""
    return _numeric_chr(raw).select("CHR", F.col("START").cast(place).alias("START"), F.col("END").cast(place).alias("END"))


def clean_snp_list(raw: DataFrame, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """CHR, POS as text to regions one base long."""
    start = F.col("POS").cast(place)
    return _numeric_chr(raw).select("CHR", start.alias("START"), (start + 1).alias("END"))


def clean_trait_snps(raw: DataFrame, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """Typed trait-SNP rows with `valid`, the allele-order test."""
    extra = ["CIS_TRANS"] if "CIS_TRANS" in raw.columns else []
    return _numeric_chr(raw).select(
        "SOURCE_ID", "CHR", F.col("POS").cast(place).alias("POS"), "EA", "NEA", *extra,
        F.coalesce(valid_alleles(F.col("EA"), F.col("NEA")), F.lit(False)).alias("valid"),
    )


def _warn_dropped(raw: DataFrame, path: str) -> None:
    dropped = raw.where(normalise_chr(F.col("CHR")).isNull()).count()
    if dropped:
        log.warning("%s: %d rows name a chromosome outside 1 to 22, X and Y and were left out", path, dropped)


def read_regions(spark: SparkSession, path: str, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """A headerless tab-separated region file, or a CSV with CHR and POS (read as one-base regions).

    `place` is the type of positions: bigint for those that an int does not hold, which it refuses.
    """
    first = spark.read.text(path).first()
    head = first[0] if first else ""
    cells = head.split("\t")
    if len(cells) >= 3 and cells[1].strip().isdigit() and cells[2].strip().isdigit():
        raw = spark.read.csv(path, sep="\t", header=False)
        raw = raw.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(("CHR", "START", "END"))])
        _warn_dropped(raw, path)
        return clean_regions(raw, place)
    if {"CHR", "POS"} <= {c.strip() for c in head.split(",")}:
        raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        _warn_dropped(raw, path)
        return clean_snp_list(raw.select("CHR", "POS"), place)
    raise ValueError(f"{path} is neither a list of regions (chromosome, start, end) nor of points (CHR,POS)")


def load_trait_snps(spark: SparkSession, path: str, place: str = INPUT_TYPES["POS"]) -> DataFrame:
    """A CSV of SOURCE_ID,CHR,POS,EA,NEA (and optionally CIS_TRANS), with `valid`, the allele-order test. `place` as in `read_regions`."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in TRAIT_SNP_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)} of a list of trait SNPs")
    _warn_dropped(raw, path)
    return clean_trait_snps(raw, place)


def read_trait_snps(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `load_trait_snps`; the whole file is refused when any allele pair is badly ordered."""
    rows = load_trait_snps(spark, path)
    wrong = rows.where("not valid").drop("valid")
    count = wrong.count()
    if count:
        raise ValueError(f"{path}: {count} rows have badly ordered alleles, among them {tuple(wrong.first())}")
    return rows.drop("valid")
