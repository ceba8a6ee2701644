"""Gap-based locus breaking.

Clusters are found without ordering the variants of a chromosome in one task.
Positions are cut into bins of ``hole + 1`` bases: two positions of one bin are
at most ``hole`` apart and can never be separated. Each bin collapses map-side to its
first and last position and best variant, and only these bin rows (at most
250,000,000 / (hole + 1) per chromosome) go through the gap window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.variants import bin_of, locus_name, snpid
from statloom.operators.joins import explode_bins, pair_inside
from statloom.operators.slices import maf_between, over_threshold, with_mlog10p
from statloom.schemas import trait_keys
from statloom.session import cut_lineage

# --- fixed values: default thresholds and distances ---
MAF = 0.01
LIMIT = 3.3
SIGNIFICANT = 5.0
HOLE = 250_000
FLANKS = 100_000
BLOCK = 1_000_000
#: Bases of the blocks that `position_gap` deals rows by: at most 16 on a chromosome.
GAP_BLOCK = 16_000_000


def _best_first(*carried: str) -> Column:
    """A struct whose minimum is the row with the largest MLOG10P, then POS, EA, NEA."""
    return F.struct((-F.col("MLOG10P")).alias("rank"), "POS", "EA", "NEA", *carried)


def position_gap(df: DataFrame, hole: int = HOLE) -> DataFrame:
    """Distinct positions with the distance to the previous one and whether it is a break.

    Rows are dealt by trait and block of bases once, which serves the collapse of positions, the windows (they run
    inside blocks) and the join; the last position of the block before reaches the next one through a window over
    block rows. Blocks are long, so that these are few also where a trait has few variants.
    """
    keys = [*trait_keys(df.columns), "CHR"]
    placed = df.select(*keys, "POS", bin_of(F.col("POS"), GAP_BLOCK).alias("block"))
    # the join drops nulls; dropped here for both of its sides, so that these share one shuffle
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "block")])
    dealt = placed.where(whole).repartition(*keys, "block")
    places = dealt.groupBy(*keys, "block", "POS").agg(F.count(F.lit(1)).alias("n_variants"))
    blocks = dealt.groupBy(*keys, "block").agg(F.max("POS").alias("last_pos"))
    before = F.lag("last_pos").over(Window.partitionBy(*keys).orderBy("block"))
    carried = blocks.select(*keys, "block", before.alias("carried"))
    within = F.lag("POS").over(Window.partitionBy(*keys, "block").orderBy("POS"))
    previous = F.coalesce(F.col("within"), F.col("carried"))
    return (
        places.withColumn("within", within)
        .join(carried, [*keys, "block"])
        .select(*keys, "POS", "n_variants", (F.col("POS") - previous).alias("gap"))
        .withColumn("is_break", F.coalesce(F.col("gap") > hole, F.lit(False)))
    )


def _clustered_bins(df: DataFrame, hole: int, *aggregates: Column) -> DataFrame:
    keys = [*trait_keys(df.columns), "CHR"]
    bins = (
        df.withColumn("gap_bin", bin_of(F.col("POS"), hole + 1))
        .groupBy(*keys, "gap_bin")
        .agg(F.min("POS").alias("lo"), F.max("POS").alias("hi"), *aggregates)
    )
    along = Window.partitionBy(*keys).orderBy("gap_bin")
    far = (F.col("lo") - F.lag("hi").over(along) > hole).cast("int")
    return bins.withColumn("breaks", F.coalesce(far, F.lit(0))).withColumn(
        "cluster", F.sum("breaks").over(along).cast("int")
    )


def gap_cluster_id(df: DataFrame, hole: int = HOLE) -> DataFrame:
    """Every row with the number of breaks before it in its chromosome."""
    keys = [*trait_keys(df.columns), "CHR", "gap_bin"]
    numbered = _clustered_bins(df, hole).select(*keys, "cluster")
    placed = df.withColumn("gap_bin", bin_of(F.col("POS"), hole + 1)).join(numbered, keys)
    return placed.select(*df.columns, "cluster")


def best_in_cluster(df: DataFrame, hole: int = HOLE) -> DataFrame:
    """Per cluster: bounds and the variant with the largest MLOG10P (ties: POS, EA, NEA)."""
    keys = [*trait_keys(df.columns), "CHR"]
    carried = [c for c in ("BETA", "SE", "EAF") if c in df.columns]
    bins = _clustered_bins(df, hole, F.min(_best_first(*carried)).alias("best"))
    return (
        bins.groupBy(*keys, "cluster")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("best").alias("best"))
        .select(
            *keys,
            "cluster",
            "lo",
            "hi",
            F.col("best.POS").alias("POS"),
            F.col("best.EA").alias("EA"),
            F.col("best.NEA").alias("NEA"),
            (-F.col("best.rank")).alias("MLOG10P"),
            *[F.col(f"best.{c}").alias(c) for c in carried],
        )
    )


def locus_candidates(sumstats: DataFrame, maf: float = MAF, limit: float = LIMIT) -> DataFrame:
    """Common variants over the border threshold."""
    return over_threshold(with_mlog10p(maf_between(sumstats, maf)), limit)


def locus_segments(
    candidates: DataFrame,
    significant: float = SIGNIFICANT,
    hole: int = HOLE,
    flanks: int = FLANKS,
    variance: DataFrame | None = None,
) -> DataFrame:
    """One row per cluster whose best variant is over `significant`, with its flanked bounds.

    The start becomes 1 only when it would be negative. S is the trait's phenotypic
    variance where given, 1 otherwise.
    """
    traits = trait_keys(candidates.columns)
    best = best_in_cluster(candidates, hole).where(F.col("MLOG10P") > float(significant))
    low = F.col("lo") - F.lit(flanks)
    bounded = best.withColumn("locus_start", F.when(low < 0, F.lit(1)).otherwise(low)).withColumn(
        "locus_end", F.col("hi") + F.lit(flanks)
    )
    if variance is None:
        bounded = bounded.withColumn("S", F.lit(1.0))
    else:
        bounded = bounded.join(variance.withColumnRenamed("pheno_variance", "S"), traits, "left")
    return bounded.select(
        *traits,
        "CHR",
        locus_name(F.col("CHR"), F.col("locus_start"), F.col("locus_end")).alias("locus"),
        "locus_start",
        "locus_end",
        F.col("MLOG10P").alias("snp_MLOG10P"),
        snpid(F.col("CHR"), F.col("POS"), F.col("EA"), F.col("NEA")).alias("SNPID"),
        "POS",
        "EA",
        "NEA",
        *[c for c in ("BETA", "SE", "EAF") if c in bounded.columns],
        "MLOG10P",
        "S",
    )


def locus_intervals(
    candidates: DataFrame, segments: DataFrame, hole: int = HOLE, flanks: int = FLANKS
) -> DataFrame:
    """Every candidate inside a locus, tagged with it; a variant may fall in several loci."""
    traits = trait_keys(candidates.columns)
    width = max(hole + 1 + 2 * flanks, BLOCK // 10)
    loci = explode_bins(
        segments.select(*traits, "CHR", "locus", "locus_start", "locus_end"), "locus_start", "locus_end", width
    )
    inside = pair_inside(candidates, loci, [*traits, "CHR"], "locus_start", "locus_end", width)
    key = snpid(F.col("CHR"), F.col("POS"), F.col("EA"), F.col("NEA"))
    rest = [c for c in candidates.columns if c not in traits]
    return inside.select("locus", *traits, key.alias("SNPID"), *rest)


def locus_breaker(
    sumstats: DataFrame,
    maf: float = MAF,
    limit: float = LIMIT,
    significant: float = SIGNIFICANT,
    hole: int = HOLE,
    flanks: int = FLANKS,
    variance: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segments, intervals) for all traits of the table in one plan each.

    The candidates, a small part of the table, are written once; both results start from them.
    """
    candidates = cut_lineage(locus_candidates(sumstats, maf, limit), "candidates")
    segments = locus_segments(candidates, significant, hole, flanks, variance)
    return segments, locus_intervals(candidates, segments, hole, flanks)
