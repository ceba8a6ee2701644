"""Expressions on chromosomes, positions and alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_chr(text: Column) -> Column:
    """Drop a leading 'chr', map X and Y to 23 and 24; anything else non-numeric is null."""
    bare = F.upper(F.regexp_replace(F.trim(text), "^(?i)chr", ""))
    number = F.when(bare == "X", "23").when(bare == "Y", "24").when(bare.rlike("^[0-9]+$"), bare)
    return number.try_cast("int")


def snpid(chrom: Column, pos: Column, ea: Column, nea: Column) -> Column:
    """CHR:POS:EA:NEA; null when any part is null."""
    return F.concat(chrom.cast("string"), F.lit(":"), pos.cast("string"), F.lit(":"), ea, F.lit(":"), nea)


def harmonised_snpid(chrom: Column, pos: Column, a1: Column, a2: Column) -> Column:
    """CHR:POS:A1:A2 with the two alleles in alphabetical order."""
    both = a1.isNotNull() & a2.isNotNull()
    return F.when(both, snpid(chrom, pos, F.least(a1, a2), F.greatest(a1, a2)))


def is_multiallelic(ea: Column, nea: Column) -> Column:
    """True when either allele is longer than one character."""
    return (F.length(ea) > 1) | (F.length(nea) > 1)


def is_multiallelic_id(identifier: Column) -> Column:
    """The same test on a CHR:POS:EA:NEA text; an id with another number of parts is an error."""
    parts = F.split(identifier, ":")
    wrong = F.raise_error(F.concat(F.lit("not a CHR:POS:EA:NEA id: "), identifier)).cast("boolean")
    return F.when(identifier.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.when(F.size(parts) == 4, is_multiallelic(parts[2], parts[3])).otherwise(wrong)
    )


def valid_alleles(ea: Column, nea: Column) -> Column:
    """Alphabetical order for equal lengths, otherwise the effect allele is the longer one."""
    return F.when(F.length(ea) == F.length(nea), ea <= nea).otherwise(F.length(ea) > F.length(nea))


def locus_name(chrom: Column, start: Column, end: Column) -> Column:
    """CHR:start:end."""
    return F.concat_ws(":", chrom.cast("string"), start.cast("string"), end.cast("string"))


def clip_low(position: Column) -> Column:
    """Positions start at 1."""
    return F.greatest(position, F.lit(1))


def bin_of(position: Column, width: int | Column) -> Column:
    """Number of the bin of this width a position falls in."""
    return F.floor(position / (width if isinstance(width, Column) else F.lit(int(width)))).cast("int")
