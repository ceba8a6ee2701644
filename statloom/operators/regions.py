"""Region and SNP-list extraction, region flags, and the chromosome envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.variants import clip_low
from statloom.operators.joins import (
    broadcast_if_small,
    data_bytes,
    disjoint_pieces,
    hint_small,
    keep_inside,
    profile_ranges,
)
from statloom.operators.peaks import PEAK_BIN, peak_table, ranges_hit
from statloom.operators.slices import over_threshold, with_mlog10p
from statloom.schemas import CHR_DOMAIN, trait_keys
from statloom.session import cut_lineage

#: Bases of a bin of the range joins (and of peaks).
REGION_BIN = PEAK_BIN
#: Regions of a word (the bits of a long) and of a block that a trait meets at once, as powers of two; rows of flags that a task makes.
WORD_BITS, BLOCK_BITS, FLAG_ROWS = 6, 12, 4_000_000


def chromosome_envelope(regions: DataFrame) -> DataFrame:
    """Smallest START (at least 1) and largest END per chromosome: at most 24 rows."""
    inside = regions.where(F.col("CHR").between(*CHR_DOMAIN))
    return inside.groupBy("CHR").agg(
        clip_low(F.min("START")).alias("min_start"), F.max("END").alias("max_end")
    )


def is_snp_list(regions: DataFrame) -> bool:
    """SNP mode: every region is one base long (END = START + 1)."""
    return regions.where(~F.coalesce(F.col("END") == F.col("START") + 1, F.lit(False))).isEmpty()


def snp_semi_join(sumstats: DataFrame, regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Variants at the listed positions (CHR, START), all alleles; optional threshold."""
    seen = profile_ranges(regions, "START", "END", REGION_BIN)
    points = regions.select("CHR", F.col("START").alias("POS")).distinct()
    rows = over_threshold(with_mlog10p(sumstats.where(seen.nearby())), threshold)
    return rows.join(hint_small(points, seen.list_bytes), ["CHR", "POS"], "left_semi").select(*rows.columns)


def region_semi_join(sumstats: DataFrame, regions: DataFrame, width: int = REGION_BIN) -> DataFrame:
    """Variants inside at least one region, each once."""
    seen = profile_ranges(regions, "START", "END", width)
    pieces = hint_small(disjoint_pieces(regions, ["CHR"], "START", "END", width), seen.binned_bytes)
    return keep_inside(sumstats.where(seen.nearby()), pieces, ["CHR"], width)


def significant_regions(
    sumstats: DataFrame, regions: DataFrame, threshold: float, width: int = REGION_BIN, peaks: DataFrame | None = None
) -> DataFrame:
    """(trait, CHR, START, END) of regions with at least one variant over the threshold.

    Answered from the peaks, stored ones or those of the table; variants are read only in bins that a region cuts.
    """
    peaks = peak_table(sumstats, width) if peaks is None else peaks
    return ranges_hit(sumstats, peaks, regions, threshold, width)


def traits_present(sumstats: DataFrame, regions: DataFrame, peaks: DataFrame, width: int = REGION_BIN) -> DataFrame:
    """(trait, CHR) of traits with a variant inside the chromosome's envelope.

    A first or last variant of a bin inside the envelope shows it; an envelope that lies between the two of one bin is
    looked up among the variants.
    """
    traits = trait_keys(peaks.columns)
    envelope = F.broadcast(chromosome_envelope(regions))  # at most 24 rows
    met = peaks.join(envelope, "CHR").where((F.col("first") <= F.col("max_end")) & (F.col("last") >= F.col("min_start")))
    inside = lambda c: F.col(c).between(F.col("min_start"), F.col("max_end"))
    known = met.groupBy(*traits, "CHR", "min_start", "max_end").agg(F.bool_or(inside("first") | inside("last")).alias("sure"))
    known = cut_lineage(known, "present")
    sure = known.where("sure").select(*traits, "CHR")
    open_ = known.where("NOT sure").withColumnRenamed("min_start", "START").withColumnRenamed("max_end", "END")
    if open_.isEmpty():
        return sure
    few = peaks.join(broadcast_if_small(open_.select(*traits, "CHR").distinct()), [*traits, "CHR"], "left_semi")
    read = ranges_hit(sumstats, few, open_, 0.0, width, traits)
    return sure.unionByName(read.select(*traits, "CHR").distinct())


def region_pvalue_filter(
    sumstats: DataFrame,
    regions: DataFrame,
    threshold: float,
    width: int = REGION_BIN,
    significant: DataFrame | None = None,
    peaks: DataFrame | None = None,
) -> DataFrame:
    """All variants of every region that has one over the threshold, trait by trait.

    Which regions qualify follows from the peaks (see `significant_regions`); that list is written once. One pruned pass over
    the table then needs no shuffle as long as the list can be broadcast.
    """
    if threshold <= 0:
        return region_semi_join(sumstats, regions, width)
    traits = trait_keys(sumstats.columns)
    scored = with_mlog10p(sumstats)
    kept = significant
    if kept is None:
        kept = cut_lineage(significant_regions(sumstats, regions, threshold, width, peaks), "regions")
    seen = profile_ranges(kept, "START", "END", width)
    pieces = hint_small(disjoint_pieces(kept, [*traits, "CHR"], "START", "END", width), seen.binned_bytes)
    return keep_inside(scored.where(seen.nearby()), pieces, [*traits, "CHR"], width)


def region_flags(
    sumstats: DataFrame,
    regions: DataFrame,
    threshold: float,
    width: int = REGION_BIN,
    peaks: DataFrame | None = None,
    significant: DataFrame | None = None,
) -> DataFrame:
    """One row per trait and listed region: does any variant exceed the threshold?

    A trait has rows for a chromosome only if it has a variant inside the chromosome's envelope. Both are answered from the
    peaks, stored ones or those of the table. Regions are numbered, so that what a trait hits is a few bits: only these are dealt and joined, one row
    for each trait, chromosome and block of regions. Rows are unfolded from them last, in tasks of about FLAG_ROWS, and need no shuffle as long as
    the list can be broadcast.
    """
    peaks = cut_lineage(peak_table(sumstats, width), "peaks") if peaks is None else peaks
    traits = trait_keys(peaks.columns)
    asked = regions.select("CHR", "START", "END")
    hits = significant_regions(sumstats, asked, threshold, width, peaks) if significant is None else significant
    # rows of one chromosome follow each other, so that its words are full; a word may hold regions of several
    ordered = asked.where(F.col("CHR").isNotNull()).sortWithinPartitions("CHR", "START", "END").withColumn("id", F.monotonically_increasing_id())
    listed = cut_lineage(ordered, "listed")
    listed_bytes = data_bytes(listed)
    word, block = F.shiftright("id", WORD_BITS).alias("word"), F.shiftright("id", BLOCK_BITS).alias("block")
    bit = F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("bit")

    known = listed.select("CHR", "START", "END", block, word, bit)
    struck = hits.select(*traits, "CHR", "START", "END").join(hint_small(known, listed_bytes), ["CHR", "START", "END"])
    masks = struck.groupBy(*traits, "CHR", "block", "word").agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), bit)")).alias("mask"))
    masks = masks.groupBy(*traits, "CHR", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"))
    blocks = listed.groupBy("CHR", block).agg(F.collect_set(word).alias("words"), F.count(F.lit(1)).alias("rows"))
    met = traits_present(sumstats, asked, peaks, width).join(broadcast_if_small(blocks), "CHR")
    met = cut_lineage(met.join(masks, [*traits, "CHR", "block"], "left"), "asked")

    tasks = -(-(met.agg(F.sum("rows")).first()[0] or 1) // FLAG_ROWS)
    dealt = met.repartition(tasks, "CHR", "block", *traits).sortWithinPartitions("CHR", "block", *traits)
    words = dealt.select(*traits, "CHR", "masks", F.explode(F.sort_array("words")).alias("word"))
    words = words.select(*traits, "CHR", "word", F.try_element_at("masks", F.col("word")).alias("mask"))
    flagged = words.join(hint_small(listed.select("CHR", word, "START", "END", bit), listed_bytes), ["CHR", "word"])
    hit = F.expr("shiftright(mask, bit)").bitwiseAND(1) == 1
    return flagged.select(*traits, "CHR", "START", "END", F.coalesce(hit, F.lit(False)).alias("PVALUE_FILT_FLAG"))


def extract_regions(
    sumstats: DataFrame, regions: DataFrame, threshold: float = 0.0, peaks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(variants, flags): SNP mode or region mode by the shape of the list.

    Flags exist in region mode with a threshold only. In SNP mode START is the position. `peaks` are the stored peaks of the same
    traits, if there are any.
    """
    if is_snp_list(regions):
        return snp_semi_join(sumstats, regions, threshold), None
    if threshold <= 0:
        return region_semi_join(sumstats, regions), None
    peaks = cut_lineage(peak_table(sumstats), "peaks") if peaks is None else peaks
    kept = cut_lineage(significant_regions(sumstats, regions, threshold, peaks=peaks), "regions")
    found = region_pvalue_filter(sumstats, regions, threshold, significant=kept)
    return found, region_flags(sumstats, regions, threshold, peaks=peaks, significant=kept)
