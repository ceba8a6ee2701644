"""Removal of repeated passages by seed and extend on winnowed anchors.

Seeds. Of the 15 six-word runs in every window of 20 words the one of smallest hash is the window's anchor; windows of
the same words have the same anchor at the same place. Neighbouring windows mostly share it, so a document
has one anchor for about 8 words. Documents are joined on the anchors that occur more than once.

Extension. Around an anchor lie the windows it stands for: its span. Where whole spans agree, the match extends
over the whole span both ways, and all but the first occurrence are repeats. One occurrence of each
different span goes on: where spans of one anchor differ, the match ends inside them, and their windows are compared
one by one. Adjoining repeats make up the maximal repeat, which is removed.

Nothing is enumerated in pairs: every comparison is a grouping by hash with a minimum, which combines before
the shuffle, so the copies of a passage cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import mix64, powers, small_batches, text_buffer, texts, tidy, word_hashes, word_spans
from statloom.session import cut_lineage

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MUL2 = _U(0xC2B2AE3D27D4EB4F)
_MUL2_INVERSE = _U(pow(int(_MUL2), -1, 2**64))


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; row ends are not minded."""
    n = max(len(words) - k + 1, 0)
    total = np.zeros(n, _U)
    for j in range(k):
        total = total * _MUL + words[j : j + n]
    return mix64(total)


def anchors(words: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """For each maximal run of windows with the same anchor: row, anchor place, first and last window, hash of anchor and span.

    Places count from the batch's first word.
    """
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.view(_U), empty.view(_U)
    hashes = _runs(words, k)
    best, place = hashes[window - k : window - k + n].copy(), np.full(n, window - k, np.int64)
    for j in range(window - k - 1, -1, -1):
        smaller = hashes[j : j + n] < best  # of equals the rightmost
        best[smaller] = hashes[j : j + n][smaller]
        place[smaller] = j
    place += np.arange(n)
    inside = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    if not len(inside):
        return anchors(words[:0], first[:1], window, k)
    at = place[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    begin = np.flatnonzero(new)
    lo, hi = inside[begin], inside[np.append(begin[1:], len(inside)) - 1]
    at = at[begin]
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * powers(_MUL2, len(words)), out=total[1:])
    span = (total[hi + window] - total[lo]) * powers(_MUL2_INVERSE, len(words))[lo]
    span = mix64(span + (at - lo).astype(_U) * _MUL + (hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93))
    return row[lo], at, lo, hi, hashes[at], span


def _seeds(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            row, _, lo, hi, anchor, span = anchors(word_hashes(data, starts, ends), first, window, k)
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[row]), pa.array(keys[row]), pa.array((lo - first[row]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int16))],
                ["anchor", "span", "doc_id", "key", "lo", "n"],
            )

    return run


def _window_rows(window: int):
    """The windows of the listed spans: two hashes, document and place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, packed, spans in zip(*(batch.column(c) for c in ("doc_id", "key", "packed", "spans"))):
                words = _words_of(packed.as_py())[0]
                lo = np.array([s["lo"] for s in spans.as_py()], np.int64)
                n = np.array([s["n"] for s in spans.as_py()], np.int64)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                a, b = np.zeros(len(at), _U), np.zeros(len(at), _U)
                for j in range(window):
                    a, b = a * _MUL + words[at + j], b * _MUL2 + words[at + j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(a).view(np.int64)), pa.array(mix64(b).view(np.int64)), *(pa.array(np.full(len(at), x.as_py(), np.int64)) for x in (doc_id, key)), pa.array(at.astype(np.int32))],
                    ["w1", "w2", "doc_id", "key", "lo"],
                )

    return run


def _words_of(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, bytes, word starts and ends of a compressed text."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends), data, starts, ends


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        packed = [squeeze.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(packed, pa.binary())], ["doc_id", "key", "packed"])


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and key, a hash that tells different texts of one doc_id apart."""
    return texts(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, key, lo, n: the n windows from word lo on are repeats of earlier ones (smaller doc_id, or earlier in the document).

    Rows without doc_id have no place in that order and are left out. Rows of one doc_id and text count as one place; different
    texts of one doc_id are documents of their own, in the order of `key`, a hash of the text. Documents of fewer words
    than a window have none.
    """
    placed = _keyed(docs, id_col, text_col).where("doc_id IS NOT NULL")
    schema = "anchor long, span long, doc_id long, key long, lo int, n short"
    seeds = placed.mapInArrow(tidy(_seeds(window, anchor)), schema)
    common = cut_lineage(seeds.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    hits = cut_lineage(seeds.join(common, "anchor", "left_semi"), "hits")

    place = F.struct("doc_id", "key", "lo")
    spans = hits.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "key", "lo", "n")).alias("f"), F.count("*").alias("c"))
    spans = cut_lineage(spans.select("anchor", "span", "c", "f.doc_id", "f.key", "f.lo", "f.n"), "spans")
    first = spans.where("c > 1").select("anchor", "span", F.struct("doc_id", "key", "lo").alias("first"))
    whole = hits.join(first, ["anchor", "span"]).where(place > F.col("first")).select("doc_id", "key", "lo", F.col("n").cast("int").alias("n"))

    branching = cut_lineage(spans.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "branching")
    leading = spans.join(branching, "anchor", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    packed = placed.mapInArrow(tidy(_compress), "doc_id long, key long, packed binary")
    windows = packed.join(leading, ["doc_id", "key"]).mapInArrow(tidy(_window_rows(window)), "w1 long, w2 long, doc_id long, key long, lo int")
    windows = cut_lineage(windows, "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    earliest = cut_lineage(earliest.select("w1", "w2", "first"), "earliest")
    single = windows.join(earliest, ["w1", "w2"]).where(place > F.col("first")).select("doc_id", "key", "lo", F.lit(1).alias("n"))
    return whole.unionByName(single)


def _removed(spans: list | None, n_words: int, window: int) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    if spans:
        lo = np.array([s["lo"] for s in spans])
        end = lo + np.array([s["n"] for s in spans]) - 1 + window
        np.add.at(gone, np.minimum(lo, n_words), 1)
        np.add.at(gone, np.minimum(end, n_words), -1)
    return np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one blank) of every row.

    A null or empty text has no words and an empty kept text. Every word that a repeated window covers goes; windows
    are judged on the input. Rows without doc_id lose nothing; different texts of one doc_id are documents of their own.
    """
    return _cleaned(docs, id_col, text_col, window, anchor).drop("key")


def _cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`remove_repeats` with key, which tells different texts of one doc_id apart."""
    found = repeats(docs, id_col, text_col, window, anchor)
    marked = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    packed = _keyed(docs, id_col, text_col).mapInArrow(tidy(_compress), "doc_id long, key long, packed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches([batch], "packed", 1_000_000):
                total, lost, kept = [], [], []
                for packed_, spans in zip(part.column("packed"), part.column("spans")):
                    text = zstandard.ZstdDecompressor().decompress(packed_.as_py())
                    data = np.frombuffer(text, np.uint8)
                    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                    gone = _removed(spans.as_py(), len(starts), window)
                    stay = ~gone
                    kept.append(b" ".join([text[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
                    total.append(len(starts))
                    lost.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "key", "n_words", "n_removed", "kept"],
                )

    return packed.join(marked, ["doc_id", "key"], "left").mapInArrow(tidy(run), "doc_id long, key long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages removed: text and n_chars change where words went, nothing else does.

    A document of which nothing is left goes; others keep all columns.
    """
    names = docs.columns
    cleaned = _cleaned(docs).where("n_removed > 0 AND doc_id IS NOT NULL")
    cleaned = cleaned.select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept")).dropDuplicates(["_doc_id", "_key"])
    own = (F.col("doc_id").cast("long") == F.col("_doc_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_key"))
    joined = docs.join(cleaned, own, "left").where("_kept IS NULL OR _kept <> ''")
    joined = joined.withColumn("text", F.coalesce("_kept", "text"))
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*names)
