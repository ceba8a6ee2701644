"""Peaks: what is known of each bin of a chromosome, trait by trait, without reading its variants.

A peak row tells of the variants of one trait in one bin how many there are, where the first and the last one lies, the largest
MLOG10P, and where that is. Rows are partial: a bin may have several (one for each batch that was ingested), each true of
its own variants. Whether a range holds a variant over a threshold follows from them alone unless the range ends
inside a bin whose peak lies beyond that end; only such bins need to be read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.variants import bin_of
from statloom.operators.joins import explode_bins, hint_small, pair_inside, profile_ranges
from statloom.operators.slices import with_mlog10p
from statloom.schemas import BUCKET, trait_keys
from statloom.session import cut_lineage

#: Bases of a bin. Stored peaks have this width.
PEAK_BIN = 100_000


def peak_table(sumstats: DataFrame, width: int = PEAK_BIN) -> DataFrame:
    """trait, CHR, bin, n, first, last, top, top_at: one row for each bin of a trait that has variants.

    One pass; bins collapse before the shuffle, as rows come in the table's order.
    """
    kept = [*trait_keys(sumstats.columns), *([BUCKET] if BUCKET in sumstats.columns else [])]
    scored = with_mlog10p(sumstats).withColumn("bin", bin_of(F.col("POS"), width))
    return scored.groupBy(*kept, "CHR", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("POS").alias("first"),
        F.max("POS").alias("last"),
        F.max("MLOG10P").alias("top"),
        F.max_by("POS", "MLOG10P").alias("top_at"),
    )


def _over(peaks: DataFrame, threshold: float) -> DataFrame:
    return peaks.where(F.col("top") > float(threshold)) if threshold > 0 else peaks


def _shown(threshold: float, start: str, end: str) -> Column:
    """The peak row itself shows a variant over the threshold between start and end."""
    inside = lambda c: F.col(c).between(F.col(start), F.col(end))
    whole = inside("first") & inside("last")
    return (whole | inside("first") | inside("last")) if threshold <= 0 else (whole | F.coalesce(inside("top_at"), F.lit(False)))


def ranges_hit(
    sumstats: DataFrame, peaks: DataFrame, listed: DataFrame, threshold: float, width: int = PEAK_BIN, keys: Sequence[str] = ()
) -> DataFrame:
    """(trait, CHR, START, END) of listed ranges that hold a variant over the threshold (any variant for zero or less), once each.

    `width` is that of the peaks; `listed` has CHR, START, END, and `keys` where ranges belong to traits. Bins that a range covers, or whose peak lies in it,
    answer by themselves; the variants of the few others are read, with the ranges cut to those bins.
    """
    traits = trait_keys(peaks.columns)
    seen = profile_ranges(listed.select("CHR", "START", "END"), "START", "END", width)
    binned = hint_small(explode_bins(listed.select(*keys, "CHR", "START", "END").distinct(), "START", "END", width), seen.binned_bytes)
    met = _over(peaks, threshold).where(seen.nearby_bins(width)).join(binned, [*keys, "CHR", "bin"])
    touching = (F.col("first") <= F.col("END")) & (F.col("last") >= F.col("START"))
    place = [*traits, "CHR", "START", "END"]
    met = met.where(touching).select(*place, "bin", _shown(threshold, "START", "END").alias("sure"))
    met = cut_lineage(met.groupBy(*place).agg(F.bool_or("sure").alias("sure"), F.collect_set(F.when(~F.col("sure"), F.col("bin"))).alias("bins")), "met")
    sure = met.where("sure").select(*place)
    # ranges that no peak settles, cut to the bins in question
    open_ = met.where("NOT sure").withColumn("bin", F.explode("bins"))
    edge = F.col("bin").cast("bigint") * width
    open_ = open_.withColumn("low", F.greatest("START", edge)).withColumn("high", F.least("END", edge + (width - 1)))
    open_ = open_.select(*place, "low", "high")
    asked = profile_ranges(open_.select("CHR", "low", "high"), "low", "high", width)
    if not asked.spans:
        return sure
    scored = with_mlog10p(sumstats).where(asked.nearby())
    scored = scored.where(F.col("MLOG10P") > float(threshold)) if threshold > 0 else scored
    points = scored.select(*traits, "CHR", "POS")
    read = pair_inside(points, hint_small(explode_bins(open_, "low", "high", width), asked.binned_bytes * 2), [*traits, "CHR"], "low", "high", width)
    return sure.unionByName(read.select(*place).distinct())
