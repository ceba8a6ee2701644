"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, long enough, that no neighbouring word extends keeping
period q. The dictionary names, level by level, the stretches of 2^k words (basic factors): two of them have the same name
if they are equal, and a factor's name follows from the names of its halves. A factor that occurs once can be part
of no repeat, so only factors that occur again go to the next level, and plain prose is done after a few levels.

Where a factor of length 2^k and its next occurrence, d words on, lie in a stretch of twice that length (d <= 2^k), the words
from the one to the end of the other have period d, and none smaller. Within a run of period d, with 2^(k-1) < d <= 2^k, the
places with this property and distance follow each other without a gap, as the terms of their arithmetic progressions
interleave; each such group proposes one run. Proposals are extended both ways by the names of the smaller levels and
then deduplicated. A run of at least three periods holds a factor of that length and its successor, so none is missed.

Every document is worked on by itself, in batches of many short ones; nothing is shuffled. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import WORD, small_batches, text_buffer, texts, tidy, word_hashes, word_spans

#: Least length of a run in words, and in periods (three at least: shorter repeats are not proposed).
LEAST, PERIODS = 24, 3

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name for every place whose key occurs again (-1 for others), and places with the distance to their successor."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, places = keys[order], at[order]
    again = sorted_keys[1:] == sorted_keys[:-1]
    part = np.zeros(len(keys), bool)
    part[1:] |= again
    part[:-1] |= again
    number = np.cumsum(np.concatenate([[0], ~again])) if len(keys) else np.zeros(0, np.int64)
    names = np.full(n, -1, np.int32)
    names[places[part]] = number[part]
    return names, places[:-1][again], (places[1:] - places[:-1])[again]


def _proposals(places: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the stretches that successors at distances in (2^(k-1), 2^k] stand for."""
    length = 1 << k
    near = (apart <= length) & (2 * apart > length)
    order = np.argsort(places[near], kind="stable")
    at, d = places[near][order], apart[near][order]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])
    begin = np.flatnonzero(opens)
    last = np.append(begin[1:], len(at))[: len(begin)] - 1
    return at[begin], at[last] + d[begin] + length, d[begin]


def _extended(start: np.ndarray, end: np.ndarray, period: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches made longer, to either side, as far as words that are one period apart agree (less than a factor's length)."""
    n = len(levels[0])
    start, end = start.copy(), end.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, length = levels[k], 1 << k
        fits = np.flatnonzero(end + length <= n)
        there = names[end[fits]]
        same = fits[(there >= 0) & (there == names[end[fits] - period[fits]])]
        end[same] += length
        fits = np.flatnonzero(start >= length)
        there = names[start[fits] - length]
        same = fits[(there >= 0) & (there == names[start[fits] - length + period[fits]])]
        start[same] -= length
    return start, end


def find_runs(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period; words are numbers, negative ones equal nothing."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not found")
    n = len(words)
    at = np.flatnonzero(words >= 0)
    names, places, apart = _named(words[at], at, n)
    levels, found, k = [names], [], 0
    while len(places):
        start, end, period = _proposals(places, apart, k)
        start, end = _extended(start, end, period, levels)
        keep = end - start >= np.maximum(least, periods * period)
        found.append(np.stack([start, end - start, period])[:, keep])
        half = 1 << k
        at = np.flatnonzero((names[:-half] >= 0) & (names[half:] >= 0)) if half < n else np.zeros(0, np.int64)
        keys = names[at].astype(np.int64) * (np.int64(names.max()) + 1) + names[at + half]
        names, places, apart = _named(keys, at, n)
        levels.append(names)
        k += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.unique(np.concatenate(found, axis=1)[[0, 2, 1]], axis=1)[[0, 2, 1]]
    return start, length, period


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch as numbers with a negative one between rows, and the place of each word."""
    hashes = word_hashes(data, starts, ends)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = np.full(len(hashes) + len(first) - 1, -1, np.int64)
    words[place] = np.unique(hashes, return_inverse=True)[1]
    return words, place


def _runs_of_batches(least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            words, place = _numbered(data, starts, ends, first)
            start, length, period = find_runs(words, least, periods)
            row = np.searchsorted(first[1:] + np.arange(1, len(first)), start, side="right")

            # words to drop: those of a run after its first period
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change[:-1])[place] == 0
            # the bytes of kept words, each with the byte after it (white space or the row's end) as a blank
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[kept]] = 1
            edge[ends[kept]] -= 1
            taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
            size = np.add.reduceat(np.append(np.where(kept, ends - starts + 1, 0), 0), np.append(first[:-1], len(kept)))[:-1] if len(first) > 1 else np.zeros(0, np.int64)
            size[np.diff(first) == 0] = 0
            bounds = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
            out = np.full(int(bounds[-1]), 0x20, np.uint8)
            width = (ends - starts)[kept]
            rows_of = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
            before = np.cumsum(width + 1) - (width + 1)
            shift = np.cumsum(size) - size
            target = bounds[rows_of] + before - shift[rows_of]
            into = np.repeat(target - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            out[into] = data[taken]
            collapsed = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))

            own = start - first[row] - row
            listed = pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], ["start", "length", "period"])
            cuts = np.searchsorted(row, np.arange(len(first)))
            runs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), listed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), runs, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed, one row per input row.

    Words are runs of other bytes than blanks, numbered from 0; `collapsed` has the words that no run holds after its first
    period, joined by one blank. A null text counts as an empty one; a text without words has no run and collapses to an empty
    text. Rows with the same doc_id, or without one, are worked on each by itself; other columns are not read.
    Words are compared by 64-bit hashes.
    """
    schema = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
    return texts(docs).mapInArrow(tidy(_runs_of_batches(least, periods)), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; of equals the first. Null where there is none."""
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(longer(best, r), r).otherwise(best)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose words partly repeat, by rule: a check of the search on any table.

    With h the CRC-32 of the decimal doc_id, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, word i from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)). Others stay as they are.
    """
    plain = texts(docs)
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = plain.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    marked = marked.withColumn("_words", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n = F.size("_words").cast("long")
    marked = marked.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    marked = marked.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("long"))
    source = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", source(i).cast("int")))
    return marked.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run of each document in columns of its own, and SHA-256 digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    told = found.withColumn("_top", strongest(F.col("runs")))
    top = [F.col("_top")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.expr("(1000 * _top.length) div _top.period")).cast("long").alias("exponent_milli")
    return told.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), *top, milli, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
