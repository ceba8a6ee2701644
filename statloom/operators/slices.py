"""Column selection, trait and position slices, thresholds and the common result shape."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.normal import mlog10p_from_z, z_score
from statloom.functions.text import trait_bucket
from statloom.functions.variants import snpid
from statloom.operators.joins import broadcast_if_small, hint_small, profile_ranges
from statloom.schemas import ATTRIBUTES, BUCKET, CHR_DOMAIN, DIMENSIONS, GROUP_COLUMNS, POS_DOMAIN


def parse_attributes(attributes: str | Iterable[str]) -> list[str]:
    """A comma-separated text or a list of names; an unknown name is an error."""
    names = attributes.split(",") if isinstance(attributes, str) else list(attributes)
    names = [n.strip() for n in names]
    for name in names:
        if name not in ATTRIBUTES:
            raise ValueError(f"unknown attribute {name!r}; choose from {', '.join(ATTRIBUTES)}")
    return names


def select_attributes(df: DataFrame, attributes: str | Iterable[str]) -> DataFrame:
    """The requested attributes; CHR, TRAITID and POS (and project, study) always come along.

    MLOG10P is left out of the request when the table was stored without it.
    """
    names = [n for n in parse_attributes(attributes) if n != "MLOG10P" or n in df.columns]
    groups = [c for c in GROUP_COLUMNS if c in df.columns]
    return df.select(*groups, *DIMENSIONS, *dict.fromkeys(names))


def with_mlog10p(df: DataFrame) -> DataFrame:
    """Add MLOG10P from BETA and SE where the table was stored without it."""
    if "MLOG10P" in df.columns:
        return df
    scored = df.withColumn("_z", z_score(F.col("BETA"), F.col("SE")))
    return scored.withColumn("MLOG10P", mlog10p_from_z(F.col("_z"))).drop("_z")


def in_trait(df: DataFrame, trait: str) -> DataFrame:
    """All rows of one trait; of a stored table only its bucket is read."""
    own = F.col("TRAITID") == trait
    return df.where(own & (F.col(BUCKET) == trait_bucket(F.lit(trait)))) if BUCKET in df.columns else df.where(own)


def _held_by(columns: Sequence[str], wanted: DataFrame, groups: Sequence[str]) -> Column:
    """Literal predicate on the partitions (project, study, bucket) and on TRAITID that keeps every row of the wanted traits.

    What reaches the driver is bounded by the partitions of the table, not by the traits: the partition values, and for each
    bucket the smallest and the largest trait. The first part prunes partitions, the second row groups and pages.
    """
    kept = [*groups, *([BUCKET] if BUCKET in columns else [])]
    named = wanted.withColumn(BUCKET, trait_bucket(F.col("TRAITID"))).dropna(subset=[*groups, "TRAITID"])
    spans = named.groupBy(*groups, BUCKET).agg(F.min("TRAITID").alias("low"), F.max("TRAITID").alias("high")).collect()
    ranges: dict[int, tuple[str, str]] = {}
    for row in spans:
        low, high = ranges.get(row[BUCKET], (row["low"], row["high"]))
        ranges[row[BUCKET]] = min(low, row["low"]), max(high, row["high"])
    inside = [F.col("TRAITID").between(low, high) for low, high in ranges.values()]
    if BUCKET in columns:
        inside = [(F.col(BUCKET) == bucket) & one for bucket, one in zip(ranges, inside)]
    test = reduce(lambda a, b: a | b, inside, F.lit(False))
    for c in kept:
        test &= F.col(c).isin(sorted({row[c] for row in spans}))
    if len(kept) > 1:
        held = sorted({"\n".join(str(row[c]) for c in kept) for row in spans})
        test &= F.concat_ws("\n", *[F.col(c).cast("string") for c in kept]).isin(held)
    return test


def in_traits(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of the catalog's traits, within their project and study where the table has them.

    Only the partitions (project, study, bucket of traits) that hold a selected trait are read, whatever the size of the
    selection, and of these the row groups between its smallest and largest trait; a semi join is the exact test. The bucket is
    not part of the result. A record with a null in its key selects nothing.
    """
    groups = [c for c in GROUP_COLUMNS if c in df.columns and c in catalog.columns]
    wanted = catalog.select(*groups, F.col("data_id").alias("TRAITID")).distinct()
    rows = df.where(_held_by(df.columns, wanted, groups))
    return rows.join(broadcast_if_small(wanted), [*groups, "TRAITID"], "left_semi").select(*[c for c in df.columns if c != BUCKET])


def in_group(df: DataFrame, project: str, study: str) -> DataFrame:
    """Rows of one (project, study) partition."""
    return df.where((F.col("project") == project) & (F.col("study") == study))


def at_positions(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at any of the listed (CHR, POS) points."""
    points = positions.select("CHR", "POS")
    seen = profile_ranges(points, "POS", "POS", POS_DOMAIN[1])
    listed = hint_small(points.distinct(), seen.list_bytes)
    return df.where(seen.nearby()).join(listed, ["CHR", "POS"], "left_semi").select(*df.columns)


def in_range(df: DataFrame, chrom: int, start: int, end: int) -> DataFrame:
    """Rows of a chromosome in an inclusive position range that begins at 1 or later."""
    return df.where((F.col("CHR") == chrom) & F.col("POS").between(max(start, 1), end))


def over_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """MLOG10P strictly over the threshold; zero or less switches the filter off."""
    return df.where(F.col("MLOG10P") > float(threshold)) if threshold > 0 else df


def maf_between(df: DataFrame, maf: float) -> DataFrame:
    """Effect-allele frequency within [maf, 1 - maf]."""
    return df.where(F.col("EAF").between(F.lit(float(maf)), F.lit(1.0 - float(maf))))


def with_snpid(df: DataFrame) -> DataFrame:
    """Add SNPID and move it first."""
    missing = sorted({"CHR", "POS", "EA", "NEA"} - set(df.columns))
    if missing:
        raise KeyError(f"a SNPID needs the columns {', '.join(missing)}")
    others = [c for c in df.columns if c != "SNPID"]
    key = snpid(F.col("CHR"), F.col("POS"), F.col("EA"), F.col("NEA"))
    return df.select(key.alias("SNPID"), *others)


def as_result(df: DataFrame, keep_trait: bool = True) -> DataFrame:
    """The common result shape: MLOG10P present, SNPID first, TRAITID on request."""
    shaped = with_snpid(with_mlog10p(df))
    return shaped if keep_trait else shaped.drop("TRAITID")


def full_stats(
    sumstats: DataFrame,
    catalog: DataFrame | None = None,
    threshold: float = 0.0,
    attributes: str | Sequence[str] = ATTRIBUTES,
) -> DataFrame:
    """All (or all significant) rows of the selected traits.

    Columns needed on the way are read even when not requested, and dropped at the end.
    """
    requested = parse_attributes(attributes)
    rows = sumstats if catalog is None else in_traits(sumstats, catalog)
    shaped = as_result(over_threshold(with_mlog10p(rows), threshold))
    groups = [c for c in GROUP_COLUMNS if c in shaped.columns]
    return shaped.select("SNPID", *groups, *DIMENSIONS, *dict.fromkeys(requested))


def validate_sumstats(df: DataFrame, last: int | None = POS_DOMAIN[1]) -> DataFrame:
    """Add `valid`: CHR and POS inside their domains and no null attribute. `last` is the last position, None for no such bound."""
    place = F.col("POS").between(POS_DOMAIN[0], last) if last is not None else F.col("POS") >= POS_DOMAIN[0]
    ok = F.col("CHR").between(*CHR_DOMAIN) & place
    present: list[Column] = [F.col(c).isNotNull() for c in ("TRAITID", *ATTRIBUTES) if c in df.columns]
    return df.withColumn("valid", F.coalesce(reduce(lambda a, b: a & b, present, ok), F.lit(False)))
