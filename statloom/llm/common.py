"""What several operators share: table reading, word rules and vectorised text hashing.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; a null text becomes an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_count(text: Column) -> Column:
    """Number of words, computed by Spark; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (fixed public constants)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows (one more than rows)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more than rows)."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    rows = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[rows] = inside[rows]
    ends[rows[rows > 0] - 1] = inside[rows[rows > 0] - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes by prefix sums, then scrambled with its length."""
    if not len(starts):
        return np.zeros(0, _U)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(_BASE, len(data)), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(_BASE_INVERSE, len(data))[starts]
    return mix64(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system: Python workers, and the driver, live on with what their largest step left."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same step for `mapInArrow`, which gives memory back when its task ends."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int = 4096) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that come sorted by integer keys, as tables of whole groups with the groups' ends; a table has `most` rows or one group."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        values = np.stack([part.column(k).to_numpy().astype(np.int64) for k in keys])
        ends = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        begin = 0
        while begin < (ends[-1] if len(ends) else 0):
            fitting = ends[(ends > begin) & (ends <= begin + most)]
            own = fitting if len(fitting) else ends[ends > begin][:1]
            yield part.slice(begin, int(own[-1]) - begin).combine_chunks(), (own - begin).tolist()
            begin = int(own[-1])
        rest = part.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), [rest.num_rows]


def spanning_links(close: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row with a link in a symmetric table of links: its name, and the smallest name that it reaches."""
    has, label = close.any(axis=1), names.copy()
    while True:
        best = np.minimum(label, np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (best == label).all():
            return names[has], label[has]
        label = best
