"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

Every element (a word shingle) of weight w owns a region of width w in which hashed darts arrive over time like a
Poisson stream: the same darts in every document that has the region. Each dart belongs to one coordinate, and a
document keeps, for each coordinate, the earliest dart in its regions. Two documents agree at a coordinate with
the probability of their (weighted) Jaccard similarity. Only the darts before a time that fills about all
coordinates are thrown; documents with gaps left throw for twice as long.

Documents that share a band share a bucket, and the documents of a bucket are compared exactly, in tiles: a bucket of any
size is cut into chunks, and each pair of chunks is a tile, which reports one link for each document that
has any. The bands are taken in three rounds; a bucket whose documents are all of one class by then is not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import mix64, powers, small_batches, sorted_groups, spanning_links, text_buffer, texts, tidy, word_hashes, word_spans
from statloom.llm.graph import components
from statloom.session import cut_lineage

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 6 coordinates: a pair at similarity 0.8 is missed with a probability of 6e-5, one at 0.85 with 4e-8.
BANDS, ROWS = 32, 6
#: Bands after which a round ends; documents of a chunk; bytes of text unpacked, and shingles compared, at once.
ROUNDS, CHUNK, AT_ONCE, COLUMNS = (4, 12), 256, 1_000_000, 20_000
#: Shingles of a chunk: long documents make smaller chunks.
CHUNK_SHINGLES = 400_000

#: Ids are larger than its negative; texts without a doc_id of their own go by numbers below it.
NAMELESS = 1 << 62

_U = np.uint64
_STEP = _U(0xA24BAED4963EE407)


def shingles(words: np.ndarray, first: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the row of each; a row of fewer words has one run of all its words."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    left = first[1:][row] - np.arange(n)  # words from here to the row's end
    total = np.zeros(n, _U)
    for j in range(k):
        there = left > j
        total[there] = total[there] * _U(0x9E3779B97F4A7C15) + words[np.flatnonzero(there) + j]
    begins = (left >= k) | ((counts[row] < k) & (np.arange(n) == first[:-1][row]))
    return mix64(total[begins] + np.minimum(counts[row], k)[begins].astype(_U)), row[begins]


def regions(elements: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For weights that are counts: the n-th occurrence of an element in a row owns a unit region of its own."""
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(len(e)) - np.repeat(begins, np.diff(np.append(begins, len(e))))
    out = np.empty_like(e)
    out[order] = mix64(e + nth.astype(_U) * _STEP)
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, row: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate (its rank and name in 64 bits) for each row; rows without elements get all ones."""
    out = np.full((rows, coordinates), ~_U(0), _U)
    sizes = np.bincount(row, minlength=rows)
    todo = sizes > 0
    throw = coordinates * (np.log(coordinates) + 2.0)
    while todo.any():
        end = np.where(todo, throw / np.maximum(sizes, 1), 0.0)
        mine = todo[row]
        e, r = elements[mine], row[mine]
        seed = mix64(e ^ _STEP)
        time = -np.log(_unit(seed))
        flat = out.reshape(-1)
        while len(e):
            alive = time <= end[r]
            e, r, seed, time = e[alive], r[alive], seed[alive], time[alive]
            if not len(e):
                break
            name = mix64(seed + _U(0x632BE59BD9B4E019))
            place = r * coordinates + ((name >> _U(32)) % _U(coordinates)).astype(np.int64)
            dart = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (name & _U(0xFFFFFFFF))
            np.minimum.at(flat, place, dart)
            seed = mix64(seed + _STEP)
            time = time - np.log(_unit(seed))
        todo &= (out == ~_U(0)).any(axis=1)
        throw *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    names = (signature & _U(0xFFFFFFFF)).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=_U) * _STEP, names.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key + names[:, :, i] + _U(1))
    return key


def _sign(k: int, bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=2_500_000):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            words = word_hashes(data, starts, ends)
            n, row = batch.num_rows, np.repeat(np.arange(batch.num_rows), np.diff(first))
            place = (np.arange(len(words)) - first[:-1][row]).astype(np.int64)
            longest = int(place.max()) + 1 if len(place) else 0
            same = []
            for base in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
                h = np.diff(first).astype(_U)
                if longest:
                    np.add.at(h, row, words * powers(_U(base), longest)[place])
                same.append(mix64(h).view(np.int64))
            e, owner = shingles(words, first, k)
            if weighted:
                e = regions(e, owner)
            keys = band_keys(signatures(e, owner, n, bands * rows), bands, rows)
            size = np.bincount(owner, minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(same[0]), pa.array(same[1]), pa.array(size.astype(np.int32)), lists],
                ["doc_id", "text_key", "h1", "h2", "n", "keys"],
            )

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        packed = [squeeze.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())], ["doc_id", "text_key", "packed"])


def _sets(packed: list[bytes], k: int, weighted: bool) -> list[np.ndarray]:
    """The distinct shingles of each compressed text."""
    expand, out, begin = zstandard.ZstdDecompressor(), [], 0
    while begin < len(packed):
        raw, size = [], 0
        while begin + len(raw) < len(packed) and (not raw or size < AT_ONCE):
            raw.append(expand.decompress(packed[begin + len(raw)]))
            size += len(raw[-1])
        offsets = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, first = word_spans(data, offsets)
        e, row = shingles(word_hashes(data, starts, ends), first, k)
        if weighted:
            e = regions(e, row)
        cuts = np.searchsorted(row, np.arange(len(raw) + 1))
        out += [np.unique(e[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        begin += len(raw)
    return out


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity: a symmetric table without its diagonal.

    Shared elements are counted by a product of membership tables, some columns at a time.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    shared = count[place] > 1
    row, place = row[shared], np.unique(place[shared], return_inverse=True)[1]
    both = np.zeros((n, n))
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        table = np.zeros((n, COLUMNS), np.float32)
        table[row[a:b], place[a:b] - low] = 1
        both += table @ table.T
    out = (both > 0) & (both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
    np.fill_diagonal(out, False)
    return out


def _compare(k: int, similarity: float, weighted: bool):
    """Rows come sorted by tile; a document links to the smallest one that it reaches within the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ends in sorted_groups(batches, ("key", "a", "b"), 2 * CHUNK):
            names, roots = part.column("node").to_numpy(), part.column("root").to_numpy()
            packed, begin, found = part.column("packed"), 0, []
            for end in ends:
                own = slice(begin, end)
                if end - begin > 1 and (roots[own] != roots[begin]).any():
                    found.append(spanning_links(similar(_sets(packed.slice(begin, end - begin).to_pylist(), k, weighted), similarity), names[own]))
                begin = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    return run


def _links_of(members: DataFrame, packed: DataFrame, links: DataFrame, k: int, similarity: float, weighted: bool) -> DataFrame:
    """`links` and those that join all texts of a bucket (band, key) which are similar enough."""
    bounds = [*ROUNDS, 1 << 30]
    for low, high in zip([0, *ROUNDS], bounds):
        active = members.where(F.col("band").between(low, high - 1))
        known = components(links).select("node", F.col("root").alias("_root"))
        active = cut_lineage(active.join(known, "node", "left").select("key", "node", "n", F.coalesce("_root", "node").alias("root")), "active")
        chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
        buckets = active.groupBy("key").agg(chunks.alias("chunks"), F.min("root").alias("least"), F.max("root").alias("most"))
        buckets = cut_lineage(buckets.where("least < most").select("key", "chunks"), "buckets")
        chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
        chunked = active.join(buckets, "key").withColumn("chunk", chunk)
        tiled = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        tiled = tiled.select("key", "node", "root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
        full = tiled.join(packed, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        found = full.select("key", "a", "b", "node", "root", "packed").mapInArrow(tidy(_compare(k, similarity, weighted)), "a long, b long")
        links = links.unionByName(cut_lineage(found.where("a <> b"), "links"))
    return links


def _classes(source: DataFrame, words: int, similarity: float, weighted: bool, bands: int, rows: int, by_id: bool) -> DataFrame:
    """doc_id, text_key, class_id, class_key for each different (doc_id, text): the smallest such pair of its class.

    A node is a different word sequence (by 128 bits). It goes by the smallest doc_id that has it and no other text; a sequence that
    only doc_ids with several texts have gets a number of its own. So all texts are compared, and the common case
    handles one number for each document. With `by_id` the texts of a doc_id are one class in the end.
    """
    schema = "doc_id long, text_key long, h1 long, h2 long, n int, keys array<long>"
    signed = cut_lineage(source.mapInArrow(tidy(_sign(words, bands, rows, weighted)), schema), "signed")
    several = signed.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b")
    several = cut_lineage(several.select("doc_id", F.lit(True).alias("_several")), "several")
    told = signed.select("doc_id", "text_key", "h1", "h2").join(several, "doc_id", "left")
    same = told.groupBy("h1", "h2").agg(
        F.min(F.when(F.col("_several").isNull(), F.col("doc_id"))).alias("rep"),
        F.min(F.struct("doc_id", "text_key")).alias("first"),
    )
    number = F.lit(-NAMELESS) - F.monotonically_increasing_id() - 1
    same = cut_lineage(same.select("h1", "h2", "first.*", F.coalesce("rep", number).alias("node")), "same")
    # one row for each node, whose keys are those of all its rows
    unnamed = same.where(F.col("node") < -NAMELESS)
    plain = same.where(F.col("node") >= -NAMELESS).select("h1", "h2", F.col("node").alias("doc_id"), "node")
    leaders = signed.where("n > 0").join(plain, ["h1", "h2", "doc_id"]).select("node", "n", "keys")
    leaders = leaders.unionByName(signed.where("n > 0").join(unnamed, ["h1", "h2", "doc_id", "text_key"]).select("node", "n", "keys"))
    spread = leaders.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = cut_lineage(spread.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1").select("key"), "shared")
    members = cut_lineage(spread.join(shared, "key", "left_semi").dropDuplicates(["key", "node"]), "members")
    needed = cut_lineage(members.select("node").distinct(), "needed")
    texts_of = source.mapInArrow(tidy(_compress), "doc_id long, text_key long, packed binary")
    packed = texts_of.join(needed.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "packed")
    few = unnamed.join(needed, "node", "left_semi").select("doc_id", "text_key", "node")
    # repeated rows of one text are equal, so any of them will do
    packed = packed.unionByName(texts_of.join(few, ["doc_id", "text_key"]).select("node", "packed"))
    packed = cut_lineage(packed.dropDuplicates(["node"]), "packed")
    links = same.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if by_id:
        own = told.where("_several").select("doc_id", "h1", "h2").distinct().join(same.select("h1", "h2", "node"), ["h1", "h2"])
        first_node = own.groupBy("doc_id").agg(F.min("node").alias("b"))
        links = cut_lineage(own.join(first_node, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"), "same-id")
    links = _links_of(members, packed, links, words, similarity, weighted)
    named = same.join(components(links), "node", "left").select("h1", "h2", "doc_id", "text_key", F.coalesce("root", "node").alias("root"))
    named = cut_lineage(named, "named")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    first = first.select("root", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"))
    classes = named.join(first, "root").select("h1", "h2", "class_id", "class_key")
    return signed.select("doc_id", "text_key", "h1", "h2").distinct().join(classes, ["h1", "h2"]).drop("h1", "h2")


def _source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    weighted: bool = False,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (doc_id = class_id), one row per input row.

    Two documents link if the Jaccard similarity of their sets of word runs (with `weighted`, of their
    counted runs) is at least `similarity`; classes are what links reach. Documents of the same word
    sequence are one class without comparison, texts without words included. A document of fewer words than a
    run has one run of all its words. Rows that share a doc_id share a class, with the links of all their texts; a row
    without doc_id is a class of its own (class_id null) and kept.
    """
    source = _source(docs, id_col, text_col)
    classes = _classes(source.where("doc_id IS NOT NULL"), words, similarity, weighted, bands, rows, True)
    out = source.select("doc_id", "text_key").join(classes, ["doc_id", "text_key"], "left")
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each class of near duplicates; columns as they are.

    The first is that of the smallest doc_id, then of the smallest hash of the text. Rows that repeat a kept doc_id and text go as
    well; different texts of one doc_id are documents of their own here, so none goes because of its doc_id. Rows
    without doc_id stay.
    """
    source = _source(docs).where("doc_id IS NOT NULL")
    classes = _classes(source, WORDS, SIMILARITY, False, BANDS, ROWS, False)
    first = classes.where("doc_id = class_id AND text_key = class_key").select("doc_id", "text_key")
    rows_of = source.groupBy("doc_id").agg(F.count("*").alias("_rows"))
    ids = cut_lineage(first.join(rows_of, "doc_id"), "kept")
    # an id of one row is found by the id alone
    once = docs.join(ids.where("_rows = 1").select("doc_id"), "doc_id", "left_semi")
    often = ids.where("_rows > 1").select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"))
    own = (F.col("doc_id").cast("long") == F.col("_doc_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_text_key"))
    again = docs.join(often, own).dropDuplicates(["_doc_id", "_text_key"]).select(*docs.columns)
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
