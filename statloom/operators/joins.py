"""Size-checked broadcasts and binned range joins.

A position range never joins on an inequality alone. Ranges are cut into
fixed-width bins, so the join is an equality on (keys, bin) with the range as
a residual test. Spark may then broadcast, hash or sort-merge it, and
its adaptive skew handling can split a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.variants import bin_of, clip_low
from statloom.schemas import CHR_DOMAIN, POS_DOMAIN

#: Settings of the session, read at each use, and their defaults.
BROADCAST_SETTING, BROADCAST_BYTES = "spark.statloom.broadcastBytes", 64 * 1024 * 1024
SPANS_SETTING, MAX_SPANS = "spark.statloom.pruningSpans", 64
#: Width of the cells by which long range lists are summed up: at most 6,024 cells on 24 chromosomes, the last of each open-ended.
SPAN_CELL = 1_000_000
LAST_CELL = POS_DOMAIN[1] // SPAN_CELL


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + F.lit(32)
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """Size of a row, texts measured."""
    return sum((_width(f) for f in df.schema.fields), F.lit(16)).cast("bigint")


def data_bytes(df: DataFrame) -> int:
    """Measured size of a side list; one aggregation over it, nothing else reaches the driver."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def is_small(df: DataFrame, size: int) -> bool:
    """`size`, an upper bound, is within the session's limit of broadcasts."""
    return size <= _setting(df, BROADCAST_SETTING, BROADCAST_BYTES)


def hint_small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast hint when `size`, an upper bound, is within the session's limit; beyond it the frame as it is.

    The join is then Spark's to plan: an equality join with adaptive skew handling, before whose shuffle
    a runtime Bloom filter of this side cuts the large one.
    """
    return F.broadcast(df) if is_small(df, size) else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`hint_small` with the measured size of the frame itself."""
    return hint_small(df, data_bytes(df))


Span = tuple[int, int, int]


def _in_spans(spans: Sequence[Span], column: str = "POS", step: int = 1) -> Column:
    """One SQL text: a predicate of many parts put together column by column costs the driver a call for each."""
    by_chr: dict[int, list[str]] = {}
    for chrom, low, high in spans:
        by_chr.setdefault(chrom, []).append(f"{column} BETWEEN {low // step} AND {high // step}")
    return F.expr(" OR ".join(f"(CHR = {c} AND ({' OR '.join(inside)}))" for c, inside in by_chr.items()) or "false")


@dataclass(frozen=True)
class RangeProfile:
    """What a small job tells about a list of ranges: spans for pruning, and its sizes."""

    envelope: tuple[Span, ...]
    spans: tuple[Span, ...]
    list_bytes: int
    binned_bytes: int

    def nearby(self) -> Column:
        """Literal predicate on CHR and POS that keeps every row inside a range.

        It reaches the Parquet scan and skips row groups and pages. The join that
        follows is the exact test.
        """
        return _in_spans(self.spans)

    def nearby_bins(self, width: int) -> Column:
        """The same on CHR and bin, for tables by bins of this width."""
        return _in_spans(self.spans, "bin", width)

    def in_envelope(self) -> Column:
        """Literal predicate: between the smallest start (at least 1) and largest end of the chromosome."""
        return _in_spans(self.envelope)


def merge_spans(spans: Sequence[Span], limit: int) -> list[Span]:
    """Spans joined where they touch, then across the smallest gaps until at most `limit` are left.

    A chromosome keeps at least one span.
    """
    merged: list[list[int]] = []
    for chrom, low, high in sorted(spans):
        if merged and merged[-1][0] == chrom and low <= merged[-1][2] + 1:
            merged[-1][2] = max(merged[-1][2], high)
        else:
            merged.append([chrom, low, high])
    gaps = sorted((b[1] - a[2], i) for i, (a, b) in enumerate(zip(merged, merged[1:])) if a[0] == b[0])
    closed = {i for _, i in gaps[: max(0, len(merged) - limit)]}
    out: list[list[int]] = []
    for i, span in enumerate(merged):
        if i - 1 in closed:
            out[-1][2] = span[2]
        else:
            out.append(span)
    return [tuple(s) for s in out]


def profile_ranges(ranges: DataFrame, start: str, end: str, width: int) -> RangeProfile:
    """Envelope per chromosome, spans for pruning, size of the list, and its size once cut into bins.

    One small job, with a row for each cell of SPAN_CELL bases that a range touches. Spans follow the ranges of a list of any
    length; the longer it is, the more of its gaps are closed.
    """
    low, high = F.col(start), F.col(end)
    cell_of = lambda c: F.least(bin_of(c, SPAN_CELL), F.lit(LAST_CELL))
    # a range that holds no position counts in a cell of its own (null)
    cells = F.when((low <= high) & (high >= 1), F.sequence(cell_of(clip_low(low)), cell_of(high)))
    bins = F.when(low <= high, (row_bytes(ranges) + 8) * (bin_of(high, width) - bin_of(low, width) + 1)).otherwise(0)
    inside = ranges.where(F.col("CHR").between(*CHR_DOMAIN)).select(
        "CHR", low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"), row_bytes(ranges).alias("bytes"), bins.alias("bins"), F.coalesce(cells, F.array(F.lit(None).cast("int"))).alias("cells")
    )
    edge = F.col("cell").cast("bigint") * F.lit(SPAN_CELL)
    opens = F.col("cell").isNull() | (F.col("cell") == F.get("cells", F.lit(0)))
    rows = (
        inside.withColumn("cell", F.explode("cells"))
        .groupBy("CHR", "cell")
        .agg(
            clip_low(F.min("lo")).alias("least"),
            F.max("hi").alias("most"),
            F.min(F.greatest(clip_low(F.col("lo")), edge)).alias("lo"),
            F.max(F.when(F.col("cell") == LAST_CELL, F.col("hi")).otherwise(F.least("hi", edge + F.lit(SPAN_CELL - 1)))).alias("hi"),
            F.sum(F.when(opens, F.col("bytes"))).alias("list_bytes"),
            F.sum(F.when(opens, F.col("bins"))).alias("binned_bytes"),
        )
        .collect()
    )
    spans = merge_spans([(r["CHR"], r["lo"], r["hi"]) for r in rows if r["cell"] is not None], _setting(ranges, SPANS_SETTING, MAX_SPANS))
    envelope: dict[int, tuple[int, int]] = {}
    for r in rows:
        low_, high_ = envelope.get(r["CHR"], (r["least"], r["most"]))
        envelope[r["CHR"]] = min(low_, r["least"]), max(high_, r["most"])
    return RangeProfile(
        tuple((c, *envelope[c]) for c in sorted(envelope)),
        tuple(spans),
        sum(r["list_bytes"] or 0 for r in rows),
        sum(r["binned_bytes"] or 0 for r in rows),
    )


def explode_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per bin a range touches."""
    touched = F.sequence(bin_of(F.col(start), width), bin_of(F.col(end), width))
    return df.where(F.col(start) <= F.col(end)).withColumn("bin", F.explode(touched))


def disjoint_pieces(
    ranges: DataFrame, keys: Sequence[str], start: str, end: str, width: int
) -> DataFrame:
    """Ranges clipped to bins and merged inside each bin: keys, bin, lo, hi.

    Pieces of one bin do not overlap, so a point meets at most one of them.
    Merging is per (keys, bin). Ranges that share a clipped start collapse
    map-side first, so a window never holds more than `width` rows, however
    many ranges pile up at one place.
    """
    edge = F.col("bin").cast("bigint") * F.lit(int(width))
    clipped = (
        explode_bins(ranges, start, end, width)
        .select(
            *keys,
            "bin",
            F.greatest(F.col(start).cast("bigint"), edge).alias("lo"),
            F.least(F.col(end).cast("bigint"), edge + F.lit(width - 1)).alias("hi"),
        )
        .groupBy(*keys, "bin", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    ordered = Window.partitionBy(*keys, "bin").orderBy("lo")
    reached = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("lo") > reached + 1).cast("int"), F.lit(1))
    return (
        clipped.withColumn("opens", opens)
        .withColumn("piece", F.sum("opens").over(ordered))
        .groupBy(*keys, "bin", "piece")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("piece")
    )


def keep_inside(
    points: DataFrame, pieces: DataFrame, keys: Sequence[str], width: int, position: str = "POS"
) -> DataFrame:
    """Points that lie in at least one piece; every point appears once."""
    p = points.withColumn("bin", bin_of(F.col(position), width)).alias("p")
    r = pieces.alias("r")
    match = F.col(f"p.{position}").between(F.col("r.lo"), F.col("r.hi"))
    for key in [*keys, "bin"]:
        match &= F.col(f"p.{key}") == F.col(f"r.{key}")
    return p.join(r, match, "left_semi").drop("bin")


def pair_inside(
    points: DataFrame,
    binned: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    width: int,
    position: str = "POS",
) -> DataFrame:
    """Inner range join with ranges from `explode_bins`.

    A pair meets only in the point's own bin, so it appears once.
    """
    p = points.withColumn("bin", bin_of(F.col(position), width))
    return p.join(binned, [*keys, "bin"]).where(F.col(position).between(F.col(start), F.col(end))).drop("bin")
