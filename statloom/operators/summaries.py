"""Per-trait phenotypic variance, plot-ready tables and identifier resolution."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.variants import bin_of, harmonised_snpid
from statloom.operators.joins import broadcast_if_small, data_bytes, hint_small
from statloom.operators.slices import maf_between
from statloom.schemas import BUCKET, CHR_DOMAIN, GROUP_COLUMNS, trait_keys
from statloom.session import cut_lineage

log = logging.getLogger(__name__)

# --- fixed values: genome-wide and suggestive lines, smallest plot ---
GENOME_WIDE = 7.30103
SUGGESTIVE = 5.0
MIN_POINTS = 40

_ACCURACY = 10_000
_MARGIN = 10 / _ACCURACY


#: Smallest minor-allele frequencies of the classes that stored sketches tell apart; a filter at one of them is answered from whole classes.
MAF_STEPS = (0.0, 0.001, 0.005, 0.01, 0.05, 0.1)
#: Size of a stored sketch, and the part of a trait's variants that its bracket spans on either side: four times its rank error.
SKETCH_SIZE = 2_000
_RANKS = 500
_SKETCH_MARGIN = 4 * 2.296 / SKETCH_SIZE**0.9021


def _spread() -> Column:
    """SE^2 * 2 * EAF * (1 - EAF): the variance that a variant speaks for, for each sample."""
    se, eaf = F.col("SE").cast("double"), F.col("EAF").cast("double")
    return se * se * 2 * eaf * (1 - eaf)


def spread_sketches(sumstats: DataFrame) -> DataFrame:
    """trait, maf_class, n, sketch: one mergeable quantile sketch of a trait's spreads for each class of allele frequency.

    Class k holds the variants that a filter at MAF_STEPS[k] keeps and one at the next step drops. One pass that reads
    SE and EAF; a sketch is some tens of kilobytes at most, however many variants there are.
    """
    kept = [*trait_keys(sumstats.columns), *([BUCKET] if BUCKET in sumstats.columns else [])]
    eaf = F.col("EAF")
    passed = [eaf.between(F.lit(m), F.lit(1.0 - m)).cast("int") for m in MAF_STEPS]
    found = sumstats.select(*kept, sum(passed[1:], passed[0]).alias("steps"), _spread().alias("u"))
    told = found.where("u IS NOT NULL AND steps > 0").groupBy(*kept, (F.col("steps") - 1).alias("maf_class"))
    return told.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("u", F.lit(SKETCH_SIZE)).alias("sketch"))


def _stored_bracket(sketches: DataFrame, traits: list[str], maf: float) -> DataFrame:
    """trait, low, high around the median of a trait's spreads at a frequency filter, from stored sketches; a null end is open.

    A filter between two steps cuts a class; of its c variants any number may count. Among the n variants of the classes that count as
    a whole the median then lies between the ranks (n - c) / 2 and (n + c) / 2.
    """
    whole = F.col("maf_class") >= len([m for m in MAF_STEPS if m < maf])
    cut = F.lit(False) if maf in MAF_STEPS else F.col("maf_class") == len([m for m in MAF_STEPS if m < maf]) - 1
    merged = sketches.groupBy(*traits).agg(
        F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(cut, F.col("n"))), F.lit(0)).alias("c"),
        F.kll_merge_agg_double(F.when(whole, F.col("sketch"))).alias("sketch"),
    )
    n = F.greatest(F.lit(1), F.col("n"))
    slack = F.col("c") / (2 * n) + F.lit(_SKETCH_MARGIN)
    # of few variants the sketch holds all, and the middle two lie within a rank of the half
    slack = slack + 1 / n
    # ranks that a sketch is asked for are fixed ones: the next outside the bracket
    steps = F.array(*[F.lit(i / _RANKS) for i in range(1, _RANKS)])
    asked = merged.withColumn("below", F.floor((0.5 - slack) * _RANKS).cast("int")).withColumn("above", F.ceil((0.5 + slack) * _RANKS).cast("int"))
    known = asked.withColumn("at", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", steps)))

    def end(step: str) -> Column:
        return F.when(F.col(step).between(1, _RANKS - 1), F.element_at("at", F.col(step)))

    return known.select(*traits, end("below").alias("low"), end("above").alias("high"))


def pheno_variance(sumstats: DataFrame, samples: DataFrame, sketches: DataFrame | None = None, maf: float | None = None) -> DataFrame:
    """Exact median over variants of SE^2 * N * 2 * EAF * (1 - EAF), per trait.

    `samples` has the trait keys and N; `maf` leaves out rarer variants. A mergeable quantile sketch brackets the
    median with several times its own error: a stored one (`sketches`, see `spread_sketches` and `read_sketches`) without a
    pass over the table, else one made on the way. Only the distinct values inside the bracket are ranked; those beside it are just
    counted, map-side. Should the bracket ever miss, the query fails rather than mislead.
    """
    traits = trait_keys(sumstats.columns)
    sizes = samples.where("N IS NOT NULL").groupBy(*traits).agg(F.max("N").alias("N"))
    size = data_bytes(sizes)
    rows = sumstats if maf is None else maf_between(sumstats, maf)
    values = rows.select(*traits, _spread().alias("u")).where(F.col("u").isNotNull())
    if sketches is None:
        ends = F.percentile_approx("u", [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY)
        own = values.join(hint_small(sizes.select(*traits), size), traits, "left_semi")
        bracket = own.groupBy(*traits).agg(ends.alias("ends")).select(*traits, F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
    else:
        wanted = sketches.join(hint_small(sizes.select(*traits), size), traits, "left_semi")
        bracket = _stored_bracket(wanted, traits, 0.0 if maf is None else float(maf))
    placed = values.join(hint_small(sizes.join(bracket, traits, "left"), 2 * size), traits)
    u = F.col("u")
    side = F.when(u < F.col("low"), -1).when(u > F.col("high"), 1).otherwise(0)
    sided = placed.withColumn("side", side).withColumn("u", F.when(F.col("side") == 0, u))
    counted = sided.groupBy(*traits, "N", "side", "u").agg(F.count(F.lit(1)).alias("k"))
    by_trait = Window.partitionBy(*traits)
    ranked = counted.withColumn("upto", F.sum("k").over(by_trait.orderBy("side", "u"))).withColumn("total", F.sum("k").over(by_trait))
    first, second = F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")
    from_rank = F.col("upto") - F.col("k") + 1

    def at(rank):
        return F.max(F.when(from_rank.__le__(rank) & (rank <= F.col("upto")), F.col("u") * F.col("N")))

    middle = ranked.groupBy(*traits).agg(at(first).alias("a"), at(second).alias("b"))
    missed = F.raise_error(F.lit("the median lies outside its bracket")).cast("double")
    median = F.coalesce((F.col("a") + F.col("b")) / 2, missed)
    return middle.select(*traits, median.alias("pheno_variance"))


def plottable(df: DataFrame) -> DataFrame:
    """The rows of traits that can be plotted: those with at least forty variants.

    CHR, POS and MLOG10P must be there; no trait of forty variants is an error, some without are logged.
    """
    missing = {"CHR", "POS", "MLOG10P"} - set(df.columns)
    if missing:
        raise ValueError(f"a Manhattan table needs the columns {sorted(missing)}")
    traits = [c for c in (*GROUP_COLUMNS, "TRAITID") if c in df.columns]
    counted = cut_lineage(df.groupBy(*traits).agg(F.count(F.lit(1)).alias("n")), "variants-per-trait")
    small = counted.where(F.col("n") < MIN_POINTS).count()
    enough = counted.where(F.col("n") >= MIN_POINTS)
    if enough.isEmpty():
        raise ValueError(f"no trait has the {MIN_POINTS} variants that a Manhattan table needs")
    if small:
        log.warning("%d traits have fewer than %d variants and are not plotted", small, MIN_POINTS)
    return df.join(broadcast_if_small(enough.drop("n")), traits, "left_semi").select(*df.columns) if small and traits else df


def manhattan_table(
    df: DataFrame, threshold: float = GENOME_WIDE, suggestive: float = SUGGESTIVE
) -> DataFrame:
    """Variants with their position along the whole genome and the two threshold flags.

    A chromosome begins where the largest position of the one before it ends.
    The offsets are one row per chromosome, at most 24.
    """
    inside = plottable(df).where(F.col("CHR").between(*CHR_DOMAIN))
    lengths = inside.groupBy("CHR").agg(F.max("POS").alias("length"))
    before = Window.orderBy("CHR").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(
        "CHR", F.coalesce(F.sum(F.col("length").cast("bigint")).over(before), F.lit(0)).alias("offset")
    )
    traits = [c for c in trait_keys(df.columns) if c in df.columns]
    return inside.join(F.broadcast(offsets), "CHR").select(
        *traits,
        "CHR",
        "POS",
        "MLOG10P",
        F.concat_ws(":", "CHR", "POS").alias("SNP"),
        (F.col("offset") + F.col("POS")).alias("genome_pos"),
        (F.col("MLOG10P") > float(threshold)).alias("above_threshold"),
        (F.col("MLOG10P") > float(suggestive)).alias("above_suggestive"),
    )


def manhattan_bins(df: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Largest MLOG10P and number of variants per bin of a chromosome."""
    binned = df.withColumn("bin", bin_of(F.col("POS"), width))
    return binned.groupBy("CHR", "bin").agg(
        F.max("MLOG10P").alias("max_mlog10p"), F.count(F.lit(1)).alias("n_variants")
    )


def rsid_resolve(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed rsIDs with alleles A1, A2 to CHR, POS and alphabetically ordered alleles."""
    found = known.select("rsID", "CHR", "POS").join(broadcast_if_small(listed.select("rsID", "A1", "A2")), "rsID")
    first, second = F.least("A1", "A2"), F.greatest("A1", "A2")
    return found.select(
        "rsID",
        "CHR",
        "POS",
        first.alias("EA"),
        second.alias("NEA"),
        harmonised_snpid(F.col("CHR"), F.col("POS"), F.col("A1"), F.col("A2")).alias("SNPID"),
    )
