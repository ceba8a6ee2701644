"""Document fingerprints by a randomised edit embedding: edit distance becomes Hamming distance.

A text is walked character by character with shared random bits: at time t the walk writes the character it is at
and goes on to the next one if the bit of (t, character) is 1. Two texts that differ by few edits fall back into step soon
after each, so what they wrote differs in few places. The fingerprint samples what was written at fixed times: all
of the first 64, then 64 times from each further doubling, four bits each. Its length grows with the logarithm
of the text's; texts of any length are walked whole.

Near texts are found by bands of sampled symbols: texts that share a band share a bucket, whose fingerprints are
compared as a whole in tiles (chunk against chunk), and links make classes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import mix64, small_batches, sorted_groups, spanning_links, texts, tidy
from statloom.llm.graph import components
from statloom.session import cut_lineage

#: Times sampled from each doubling; period of the random bits, as a power of two; groups of characters.
SAMPLES, PERIOD_BITS, GROUPS = 64, 13, 256
SEED = 20_260
#: Characters walked at once, and documents of a neighbourhood in the order of documents.
AT_ONCE, NEIGHBOURS = 10_000_000, 500
#: Symbols of a band, the likeness that links two texts, and documents of a chunk of a bucket.
BAND, LIKENESS, CHUNK = 8, 0.8, 256

_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_NONE = ord("-")


def _waits() -> np.ndarray:
    """For each character group and time, how many more times the walk stays: until the next bit that is 1."""
    period = 1 << PERIOD_BITS
    bits = np.random.default_rng(SEED).integers(0, 2, (GROUPS, period), dtype=np.uint8)
    bits[:, ::64] = 1  # no group stays for long
    waits = np.zeros((GROUPS, 2 * period), np.uint8)
    for t in range(2 * period - 2, -1, -1):
        waits[:, t] = np.where(bits[:, t % period] == 1, 0, waits[:, t + 1] + 1)
    return np.ascontiguousarray(waits[:, :period]).ravel()


def _times() -> list[np.ndarray]:
    """The sampled times of each doubling: 0 to 63, then 64 of 64 to 127, of 128 to 255, ..."""
    random = np.random.default_rng(SEED + 1)
    out = [np.arange(SAMPLES)]
    width = SAMPLES
    while width < 2**40:
        out.append(np.sort(random.choice(width, SAMPLES, replace=False) if width < 2**20 else random.integers(0, width, SAMPLES)) + width)
        width *= 2
    return out


_WAITS: np.ndarray = np.zeros(0, np.uint8)
_TIMES = _times()
_WIDTHS = np.repeat([1.0, *(2.0**i for i in range(len(_TIMES) - 1))], SAMPLES)


def walk(groups: np.ndarray, begins: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The time at which each character of each text is reached, and the time at which each text ends.

    All texts walk side by side, the longest first, so that those still under way are always a prefix.
    """
    global _WAITS
    if not len(_WAITS):
        _WAITS = _waits()
    order = np.argsort(-lengths, kind="stable")
    at, now = begins[order].copy(), start[order].astype(np.int64)
    reached = np.zeros(len(groups), np.int32)
    longest = int(lengths.max()) if len(lengths) else 0
    under_way = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    mask = (1 << PERIOD_BITS) - 1
    for k in under_way.tolist():
        p, t = at[:k], now[:k]
        reached[p] = t
        t += _WAITS[(groups[p] << PERIOD_BITS) | (t & mask)]
        t += 1
        p += 1
    end = np.empty_like(now)
    end[order] = now
    return reached, end


def _group_of(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64)


def fingerprint(points: np.ndarray, reached: np.ndarray, end: int) -> bytes:
    """The sampled symbols of a text, from its characters and the times at which they were reached."""
    if not len(points):
        return b""
    levels = 1
    while SAMPLES << (levels - 1) < end:
        levels += 1
    times = np.concatenate(_TIMES[:levels])
    there = int(np.searchsorted(times, end))
    symbols = points[np.searchsorted(reached, times[:there], side="right") - 1].astype(np.uint64)
    out = np.full(len(times), _NONE, np.uint8)
    out[:there] = _DIGITS[(mix64(symbols * np.uint64(0x9E3779B97F4A7C15) + times[:there].astype(np.uint64)) & np.uint64(15)).astype(np.int64)]
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal symbols of two fingerprints, each weighed by the times it stands for, less equality by chance: 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(f.ljust(n, b"-"), np.uint8) for f in (a, b))
    weight = _WIDTHS[:n] * ((x != _NONE) | (y != _NONE))
    equal = float(weight[x == y].sum() / weight.sum())
    return max(0.0, (equal - 1 / 16) / (15 / 16))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _walk_texts(points: list[np.ndarray], start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    lengths = np.array([len(p) for p in points], np.int64)
    begins = np.cumsum(lengths) - lengths
    groups = _group_of(np.concatenate(points)) if len(points) else np.zeros(0, np.int64)
    reached, end = walk(groups, begins, lengths, start)
    return [reached[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist())], end


def _bucket_of(ids: np.ndarray, known: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Buckets in descending order of ids; the last is also that of rows without an id."""
    out = len(splits) - np.searchsorted(splits, ids, side="left")
    out[~known] = len(splits)
    return out.astype(np.int32)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False)


def _bucket_heads(splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = _ids(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(ids, known, splits)), batch.column("doc_id")], ["bucket", "doc_id"])

    return run


_PLACED = "bucket int, visitor boolean, doc_id long, tie long, packed binary"


def _place(splits: np.ndarray, visits: dict[int | None, list[int]]):
    """Each row in its bucket; a bucket's first rows also visit the bucket before, as what follows its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches):
            ids, known = _ids(batch.column("doc_id"))
            rows = []
            for bucket, doc_id, text in zip(_bucket_of(ids, known, splits).tolist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py().encode()
                row = (doc_id, zlib.crc32(raw), squeeze.compress(raw))
                rows.append((bucket, False, *row))
                rows += [(other, True, *row) for other in visits.get(doc_id, ())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))],
                ["bucket", "visitor", "doc_id", "tie", "packed"],
            )

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str, bool]], follows: list[int]) -> pa.RecordBatch:
    """Results for each row that has a follower (an index, or -1); rows are walked once, edited ends go on from there."""
    points = [_points(text) for _, text, _ in rows]
    reached, end = _walk_texts(points, np.zeros(len(rows), np.int64))
    prints = [fingerprint(p, r, int(e)) for p, r, e in zip(points, reached, end)]
    own = [i for i, f in enumerate(follows) if f >= 0]
    heads, tails, starts = [], [], []
    for i in own:
        n = len(points[i])
        cut = n - n // 3
        heads.append(cut)
        tails.append(points[follows[i]][: n // 3])
        starts.append(int(reached[i][cut]) if cut < n else int(end[i]))
    later, stop = _walk_texts(tails, np.array(starts, np.int64))
    out: list[tuple] = []
    for i, cut, tail, times, last in zip(own, heads, tails, later, stop.tolist()):
        edited = fingerprint(np.concatenate([points[i][:cut], tail]), np.concatenate([reached[i][:cut], times]), last)
        text = rows[i][1][:cut] + rows[follows[i]][1][: len(tail)]
        out.append(
            (
                rows[i][0],
                len(points[i]),
                hashlib.sha256(text.encode()).hexdigest(),
                prints[i].decode(),
                edited.decode(),
                likeness(prints[i], edited),
                likeness(prints[i], prints[follows[i]]),
            )
        )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [part.split()[0] for part in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, own rows before visitors; the row after a row is its follower."""
    expand = zstandard.ZstdDecompressor()
    rows, follows, size, current, visited = [], [], 0, None, False
    for batch in batches:
        for bucket, visitor, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "visitor", "doc_id", "packed"))):
            if bucket == current and visitor and visited:
                continue  # only the first visitor follows
            text = expand.decompress(packed).decode()
            if bucket == current and rows:
                follows[-1] = len(rows)
            current, visited = bucket, visitor
            rows.append((doc_id, text, visitor))
            follows.append(-1)
            size += len(text)
            if size >= AT_ONCE:
                yield _compare(rows, follows)
                # the last row waits for its follower
                rows, follows, size = rows[-1:], [-1], len(text)
    if rows:
        yield _compare(rows, follows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last third of the characters (rounded down) replaced by the first as many of the next
    document's, in descending doc_id and from the last back to the first. Rows without doc_id come last; rows of
    one doc_id follow each other by the checksum of their texts. A null text is empty; empty texts have an empty
    fingerprint and are like each other alone. A single row is its own next one. Texts are shuffled once, to
    neighbourhoods of documents; each bucket boundary costs one document more.
    """
    rows = texts(docs, id_col, text_col)
    total = rows.count()
    wanted = int(min(max(total // NEIGHBOURS, 1), 100_000))
    parts = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], max(10_000, 4 * wanted)).alias("s")).first()
    splits = np.unique(np.array(parts["s"] or [], np.int64))
    # one row for each bucket, of which there are `wanted` at most
    of_ids = rows.select("doc_id").mapInArrow(tidy(_bucket_heads(splits)), "bucket int, doc_id long")
    heads = sorted((r["bucket"], r["head"]) for r in of_ids.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    visits: dict[int | None, list[int]] = {}
    for (bucket, _), (_, head) in zip(heads, [*heads[1:], *heads[:1]]):
        visits.setdefault(head, []).append(bucket)
    placed = rows.mapInArrow(tidy(_place(splits, visits)), _PLACED)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = placed.repartition(max(1, min(spread, 2 * len(heads))), "bucket")
    ordered = near.sortWithinPartitions("bucket", "visitor", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return ordered.mapInArrow(tidy(_in_order), _RESULT)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, limit=AT_ONCE):
        points = [_points(t.as_py()) for t in batch.column("text")]
        reached, end = _walk_texts(points, np.zeros(len(points), np.int64))
        prints = [fingerprint(p, r, int(e)) for p, r, e in zip(points, reached, end)]
        bands = [
            [int(zlib.crc32(f[i : i + BAND])) << 24 | i for i in range(0, len(f) - BAND + 1, BAND) if _NONE not in f[i : i + BAND]] or [zlib.crc32(f)] for f in prints
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "print", "bands"])


def likeness_table(prints: list[bytes]) -> np.ndarray:
    """`likeness` of every pair."""
    n = max(map(len, prints))
    if not n:
        return np.ones((len(prints), len(prints)))
    x = np.frombuffer(b"".join(f.ljust(n, b"-") for f in prints), np.uint8).reshape(len(prints), n)
    weight, none = _WIDTHS[:n], x == _NONE
    neither = (none * weight) @ none.T
    equal = np.stack([(x == row) @ weight for row in x]) - neither
    there = weight.sum() - neither
    share = np.divide(equal, there, out=np.ones_like(equal), where=there > 0)
    return np.maximum(0.0, (share - 1 / 16) / (15 / 16))


def _near(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ends in sorted_groups(batches, ("band", "a", "b"), 2 * CHUNK):
            names, prints, begin, found = part.column("doc_id").to_numpy(), part.column("print").to_pylist(), 0, []
            for end in ends:
                if end - begin > 1:
                    close = likeness_table(prints[begin:end]) >= least
                    np.fill_diagonal(close, False)
                    found.append(spanning_links(close, names[begin:end]))
                begin = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    return run


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id reached by links) of every row with a doc_id.

    Two texts link if they share a band and their whole fingerprints are alike enough. Equal fingerprints are one
    class without comparison; empty texts are one class. Rows that share a doc_id share a class.
    """
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    marked = cut_lineage(rows.mapInArrow(tidy(_prints), "doc_id long, print binary, bands array<long>"), "prints")
    same = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "same")
    links = marked.join(same.select("print", "rep"), "print").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    spread = same.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut_lineage(buckets.select("band", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "buckets")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    tiled = spread.join(buckets, "band").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("band", "doc_id", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    full = tiled.join(same.select(F.col("rep").alias("doc_id"), "print"), "doc_id").repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    found = cut_lineage(full.select("band", "a", "b", "doc_id", "print").mapInArrow(tidy(_near(least)), "a long, b long"), "links")
    labels = components(links.unionByName(found)).select(F.col("node").alias("doc_id"), F.col("root").alias("_root"))
    return rows.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("_root", "doc_id").alias("class_id"))
