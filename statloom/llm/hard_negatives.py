"""Hard negatives of anchors, found by segment summaries that bound inner products.

Each vector is cut into segments, in levels: one segment, four, sixteen. A summary keeps the mean and the deviation (the
length of what the mean leaves) of every segment. By segments, an inner product is the sum of the products of means
times the segment's length, plus or minus at most the sum of the products of deviations. A pair is scored exactly only if
the bounds of no level, from coarse to fine, rule it out: against the best scores found so far, or the wanted range of scores.

Anchors are a stated set of queries and meet all rows in blocks: rows are packed into blocks with their summaries once, blocks
of rows and blocks of anchors are laid out as a grid whose cells are dealt to tasks, and a cell keeps
no more than the wanted number of rows of each anchor. So no task holds more than a cell, whatever label most rows have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import tidy
from statloom.session import cut_lineage

#: Segments by level; bytes of a block of rows; anchors of a block and blocks of rows of a cell, both expected.
LEVELS = (1, 4, 16)
BLOCK_BYTES, BLOCK_ROWS, ANCHORS, CELL = 1 << 20, 1024, 512, 8
#: Share of pairs from which on all pairs of a tile are taken together; relative error allowed for in bounds.
DENSE, SLACK = 0.1, 1e-5
#: Rows whose squared length reaches this have scores that need not fit in 64 bits.
TOO_LONG = 2.0**62

BLOCK = "dim int, part bigint, ids binary, labels binary, keys binary, width int, data binary, means binary, deviations binary"


class Rows(NamedTuple):
    """Rows of one length with their summaries; means are times the root of the segment's length."""

    ids: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    means: np.ndarray
    deviations: np.ndarray


def segments(dimension: int) -> list[tuple[int, np.ndarray]]:
    """For each level the column of its first segment and the segments' ends; finer ones lie within coarser ones."""
    out, column = [], 0
    for level in LEVELS:
        count = min(level, dimension)
        if count:
            out.append((column, np.arange(count + 1) * dimension // count))
            column += count
    return out


def summaries(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the root of the length) and deviations of all segments of all levels."""
    x, means, deviations = values.astype(np.float64), [], []
    for _, ends in segments(values.shape[1]):
        size = np.diff(ends)
        mean = np.add.reduceat(x, ends[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        means.append(mean * np.sqrt(size))
        deviations.append(np.sqrt(np.add.reduceat(rest * rest, ends[:-1], axis=1)))
    if not means:
        return (np.zeros((len(values), 0), np.float32),) * 2
    return np.concatenate(means, axis=1).astype(np.float32), np.concatenate(deviations, axis=1).astype(np.float32)


def _whole_numbers(column: pa.Array, scale: float) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def _packed(scale: float):
    """Rows as blocks of one length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == dimension)))
                values = _whole_numbers(own.column("embedding"), scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    sound = (values * values).sum(axis=1) < TOO_LONG
                ids, labels, keys = (own.column(c).to_numpy()[sound] for c in ("vec_id", "label", "key"))
                values = values[sound].astype(np.int64)
                step = int(max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dimension, 1)))))
                for i in range(0, len(values), step):
                    s = slice(i, i + step)
                    means, deviations = summaries(values[s])
                    most = int(np.abs(values[s]).max(initial=0))
                    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                    kept = (ids[s].astype("<i8"), labels[s].astype("<i8"), keys[s].astype("<i8"), values[s].astype(f"<i{width}"), means, deviations)
                    i_bytes, l_bytes, k_bytes, v_bytes, m_bytes, d_bytes = (pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dimension], pa.int32()), pa.array([int(keys[i]) ^ number], pa.int64()), i_bytes, l_bytes, k_bytes, pa.array([width], pa.int32()), v_bytes, m_bytes, d_bytes],
                        ["dim", "part", "ids", "labels", "keys", "width", "data", "means", "deviations"],
                    )
                    number += 1

    return run


def _unpacked(table: pa.Table) -> Iterator[Rows]:
    for block in table.to_batches(max_chunksize=1):
        row = {name: block.column(name)[0].as_py() for name in ("dim", "ids", "labels", "keys", "width", "data", "means", "deviations")}
        ids = np.frombuffer(row["ids"], "<i8")
        columns = sum(min(level, row["dim"]) for level in LEVELS)
        parts = [np.frombuffer(row[c], np.float32).reshape(len(ids), columns) for c in ("means", "deviations")]
        yield Rows(ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["data"], f"<i{row['width']}").reshape(len(ids), row["dim"]), *parts)


def _asking(table: pa.Table) -> Rows:
    """The anchors of a cell, in the order of the table."""
    values = np.array(table.column("values").to_pylist(), np.int64).reshape(table.num_rows, -1)
    ids, labels, keys = (table.column(c).to_numpy() for c in ("vec_id", "label", "key"))
    return Rows(ids, labels, keys, values, *summaries(values))


def _exact(anchors: Rows, rows: Rows, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Inner products as whole numbers, of all pairs or of the listed ones; in double precision where that is exact."""
    longest = lambda r: float((r.values.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
    kind = np.float64 if longest(anchors) * longest(rows) < 2.0**104 else np.int64
    a, b = anchors.values.astype(kind), rows.values.astype(kind)
    if i is None:
        return (a @ b.T).astype(np.int64)
    return np.einsum("nd,nd->n", a[i], b[j]).astype(np.int64)


def undecided(anchors: Rows, rows: Rows, alive: np.ndarray, least: np.ndarray, most: np.ndarray, k: int = 0) -> np.ndarray:
    """The pairs of `alive` whose score may lie in [least, most] of their anchor, by the bounds of one level after the other.

    With `k`, a score below the k-th largest lower bound of an anchor is not wanted either.
    """
    length_a, length_b = (np.sqrt((r.values.astype(np.float64) ** 2).sum(axis=1)) for r in (anchors, rows))
    for column, ends in segments(anchors.values.shape[1]):
        s = slice(column, column + len(ends) - 1)
        if alive.mean() > DENSE:
            centre = (anchors.means[:, s] @ rows.means[:, s].T).astype(np.float64)
            radius = anchors.deviations[:, s] @ rows.deviations[:, s].T + SLACK * np.outer(length_a, length_b)
            low, high = centre - radius, centre + radius
            if k and alive.shape[1] > k:
                sure = np.partition(np.where(alive, low, -np.inf), alive.shape[1] - k, axis=1)[:, alive.shape[1] - k]
                least = np.maximum(least, sure)
            alive = alive & (high >= least[:, None]) & (low <= most[:, None])
        else:
            i, j = np.nonzero(alive)
            centre = np.einsum("ns,ns->n", anchors.means[i, s], rows.means[j, s]).astype(np.float64)
            radius = np.einsum("ns,ns->n", anchors.deviations[i, s], rows.deviations[j, s]) + SLACK * length_a[i] * length_b[j]
            out = (centre + radius < least[i]) | (centre - radius > most[i])
            alive = alive.copy()
            alive[i[out], j[out]] = False
    return alive


def scored(anchors: Rows, rows: Rows, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the pairs left."""
    i, j = np.nonzero(alive)
    if len(i) > DENSE * alive.size:
        return i, j, _exact(anchors, rows)[i, j]
    return i, j, _exact(anchors, rows, i, j)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of every group: by larger score, then smaller id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    opens = np.ones(len(order), bool)
    opens[1:] = sorted_group[1:] != sorted_group[:-1]
    begin = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def _best_positives(positives: int):
    """The best rows of a cell with an anchor's label."""

    def cell(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if asked.num_rows and blocks.num_rows:
            anchors = _asking(asked)
            floor = np.full(len(anchors.ids), -np.inf)
            for rows in _unpacked(blocks):
                same = anchors.labels[:, None] == rows.labels[None, :]
                same &= (anchors.keys[:, None] != rows.keys[None, :]) | (anchors.ids[:, None] != rows.ids[None, :])
                alive = undecided(anchors, rows, same, floor, np.full(len(floor), np.inf), positives)
                i, j, score = scored(anchors, rows, alive)
                group, ids, score = (np.concatenate(c) for c in zip(found[0], (i, rows.ids[j], score)))
                kept = first_of_each(group, score, ids, positives)
                group, ids, score = group[kept], ids[kept], score[kept]
                found = [(group, ids, score)]
                last = np.flatnonzero(np.bincount(group, minlength=len(floor)) == positives)
                floor = np.full(len(floor), -np.inf)
                if len(last):
                    worst = np.full(len(floor), np.iinfo(np.int64).max)
                    np.minimum.at(worst, group, score)
                    floor[last] = worst[last]
        group, ids, score = found[0]
        keys, names = (asked.column(c).to_numpy()[group] if asked.num_rows else np.zeros(0, np.int64) for c in ("key", "vec_id"))
        return pa.table({"anchor_id": names, "key": keys, "positive_id": ids, "positive_score": score})

    return cell


def _best_negatives(negatives: int, low: int, high: int):
    """The best rows of a cell with another label whose score lies in the range that a positive sets."""

    def cell(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        best = (empty, empty, empty)
        if asked.num_rows and blocks.num_rows:
            anchors = _asking(asked)
            scores = asked.column("scores").to_pylist()
            of = np.repeat(np.arange(len(scores)), [len(s) for s in scores])
            place = np.concatenate([np.arange(len(s)) for s in scores])
            # Python's whole numbers: no product overflows
            least = np.array([-(-s * low // 100) for own in scores for s in own], np.int64)
            most = np.array([s * high // 100 for own in scores for s in own], np.int64)
            floor = least.astype(np.float64)
            for rows in _unpacked(blocks):
                wanted_low, wanted_high = np.full(len(scores), np.inf), np.full(len(scores), -np.inf)
                open_ = least <= most
                np.minimum.at(wanted_low, of[open_], floor[open_])
                np.maximum.at(wanted_high, of[open_], most[open_].astype(np.float64))
                other = anchors.labels[:, None] != rows.labels[None, :]
                alive = undecided(anchors, rows, other, wanted_low, wanted_high)
                i, j, score = scored(anchors, rows, alive)
                # every pair meets the ranges of its anchor
                order = np.argsort(i, kind="stable")
                i, j, score = i[order], j[order], score[order]
                begin, end = np.searchsorted(i, of), np.searchsorted(i, of, side="right")
                size = end - begin
                window = np.repeat(np.arange(len(of)), size)
                pair = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                inside = (score[pair] >= least[window]) & (score[pair] <= most[window])
                window, pair = window[inside], pair[inside]
                group, ids, score = (np.concatenate(c) for c in zip(best, (window, rows.ids[j[pair]], score[pair])))
                kept = first_of_each(group, score, ids, negatives)
                best = (group[kept], ids[kept], score[kept])
                full = np.bincount(best[0], minlength=len(of)) == negatives
                worst = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(worst, best[0], best[2])
                floor = np.where(full, np.maximum(least, worst), least).astype(np.float64)
            group, ids, score = best
            keys, names = asked.column("key").to_numpy()[of[group]], asked.column("vec_id").to_numpy()[of[group]]
            at = place[group]
        else:
            keys, names, at, ids, score = (empty,) * 5
        return pa.table({"anchor_id": names, "key": keys, "place": at, "negative_id": ids, "negative_score": score})

    return cell


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 1.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding; `is_anchor` is a condition on vec_id. Components count as floor(scale * x), and a
    score is the inner product of these whole numbers; higher scores come first, then smaller ids. An anchor's
    positives are its first other rows of the same label; for each of them, the first rows of another label whose score is
    from `low` to `high` percent of the positive's are returned, ranked from 1. An anchor without positives, or
    without such rows, has no row in the result.

    Rows without vec_id, label or vector, with a null or non-finite component, or so long that a score need not fit in 64
    bits (squared length 2^62) take no part. Vectors meet those of their own length only; one without components scores 0. Rows
    that agree in vec_id, label and vector count once; rows that share a vec_id otherwise are rows of their own, as
    anchors too. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd))
    rows = rows.dropDuplicates(["vec_id", "label", "embedding"]).withColumn("key", F.xxhash64("vec_id", "label", "embedding"))
    rows = cut_lineage(rows, "vectors")
    blocks = cut_lineage(rows.mapInArrow(tidy(_packed(float(scale))), BLOCK), "blocks")
    whole = F.transform("embedding", lambda v: F.floor(v * F.lit(float(scale))))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * F.lit(float(scale))).cast("double"), 2.0))
    fitting = F.forall("embedding", lambda v: F.abs(v * F.lit(float(scale))) < F.lit(2.0**31))
    asked = rows.where(is_anchor & fitting & (length < TOO_LONG)).select("vec_id", "label", "key", whole.alias("values"), F.size("embedding").alias("dim"))

    across = max(1, -(-asked.count() // ANCHORS))
    down = max(1, -(-blocks.count() // CELL))
    row_no = F.pmod(F.xxhash64("part", "dim"), F.lit(down)).cast("int")
    laid_rows = blocks.withColumn("down", row_no).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    column_no = F.pmod(F.xxhash64("key", "dim"), F.lit(across)).cast("int")
    asked = asked.withColumn("across", column_no)
    spread = lambda df: df.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cell = ("across", "down", "dim")

    near = spread(asked).groupBy(*cell).cogroup(laid_rows.groupBy(*cell)).applyInArrow(
        _best_positives(positives), "anchor_id bigint, key bigint, positive_id bigint, positive_score bigint")
    by_score = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(by_score) - 1).where(F.col("place") < positives)
    near = cut_lineage(near.select("anchor_id", "key", "place", "positive_id", "positive_score"), "positives")

    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"])
    scores = near.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(listed.alias("scores"))
    windows = asked.join(scores, ["vec_id", "key"])
    far = spread(windows).groupBy(*cell).cogroup(laid_rows.groupBy(*cell)).applyInArrow(
        _best_negatives(negatives, low, high), "anchor_id bigint, key bigint, place bigint, negative_id bigint, negative_score bigint")
    by_score = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    found = far.join(near, ["anchor_id", "key", "place"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
