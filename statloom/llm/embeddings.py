"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the vectors.

Learned on a bounded sample: a rotation of the centred vectors along their main directions for which the signs lose
least (iterative quantisation), several times from different starts. The signs of a vector under all rotations are
its code, cut into substrings; every substring is an index of its own (a Hamming table). With m tables, any two codes that
differ in fewer than m bits share a substring, and most pairs that differ in more do. The angle of a link at the codes
depends on the data (the centre is taken off, links are judged without that), so m is measured: from vectors of the
sample, pairs right at the threshold are made, and tables are added until the wanted share of them shares a bucket.
Substrings are as long as makes that cheapest; where tables would cost more than comparing all with all, all are.

Vectors of one bucket are compared in tiles: a bucket of any size is cut into chunks, and each pair of chunks is a
tile. A pair met in several tables counts in the first of them only. Tiles report, for each
vector, how many vectors it links to, and one link to its part of the tile: no list of pairs leaves them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import sorted_groups, spanning_links, tidy
from statloom.llm.graph import components
from statloom.session import cut_lineage

COSINE = 0.95
#: Vectors the rotations are learned on at most; probability to miss a pair right at the threshold; vectors of a chunk.
SAMPLE, MISS, CHUNK = 10_000, 0.002, 256
#: Vectors that share a bucket by chance, which sets the length of substrings (within these limits).
COMPANY, SHORTEST, LONGEST = 8, 8, 24
ROUNDS, SEED = 40, 11
#: Comparisons that a row of a table costs as much as; pairs that recall is measured on; rotations that costs are foreseen by.
ROW, PAIRS, TRIAL = 44, 5_000, 4
#: Ids are smaller; classes without any id go by names from here on.
NAMELESS = 1 << 62


def rotations(sample: np.ndarray, wanted: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, projection) of `wanted` quantisers: main directions, rotated so that signs fit the values best."""
    return list(islice(all_rotations(sample, seed), wanted))


def all_rotations(sample: np.ndarray, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same without an end."""
    centre = sample.mean(axis=0)
    data = sample - centre
    _, vectors = np.linalg.eigh(data.T @ data)
    main = vectors[:, ::-1][:, :64]
    reduced, random = data @ main, np.random.default_rng(seed)
    while True:
        turn = np.linalg.qr(random.standard_normal((main.shape[1], main.shape[1])))[0]
        for _ in range(ROUNDS):
            signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ reduced)
            turn = (left @ right).T
        yield centre, main @ turn


def plan_tables(vectors: int, dimension: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a substring, number of tables, and number of rotations that give so many substrings."""
    bits = min(max(SHORTEST, math.ceil(math.log2(max(vectors, 2) / COMPANY))), LONGEST, max(1, min(dimension, 64)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - same)))
    return bits, tables, math.ceil(tables / (min(dimension, 64) // bits))


def threshold_pairs(sample: np.ndarray, cosine: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, and each of them turned towards another one until their cosine is the threshold."""
    random = np.random.default_rng(seed)
    a, b = sample[random.integers(0, len(sample), (2, PAIRS))]
    away = b - a * (a * b).sum(axis=1, keepdims=True)
    length = np.linalg.norm(away, axis=1)
    # equal and opposite vectors name no direction: any will do
    lost = length < 1e-6
    drawn = random.standard_normal(a.shape)
    drawn -= a * (a * drawn).sum(axis=1, keepdims=True)
    away[lost] = drawn[lost]
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * away


def fit_tables(sample: np.ndarray, vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
    """Bits of a substring, number of tables and their rotations, by recall measured on pairs at the threshold.

    0 bits, 1 table and one rotation say that all are to be compared with all: where tables would cost more than that (and more than
    twice the plan of centred vectors, so that small tables are not judged by it).
    """
    longest, usual, _ = plan_tables(vectors, sample.shape[1], cosine, miss)
    limit = max(vectors, 2 * usual * (ROW + vectors / 2**longest))
    a, b = threshold_pairs(sample, cosine)
    source, turns, agree = all_rotations(sample), [], []

    def turn(i: int) -> np.ndarray:
        """Which bits of the pairs agree under rotation i."""
        while len(turns) <= i:
            centre, projection = next(source)
            turns.append((centre, projection))
            agree.append(((a - centre) @ projection >= 0) == ((b - centre) @ projection >= 0))
        return agree[i]

    def foreseen(bits: int) -> float:
        """The cost by the share of agreeing bits of each pair."""
        apart = np.log1p(-np.minimum(same**bits, 1 - 1e-12))
        low, high = 0.0, 1.0
        while np.exp(high * apart).mean() > miss and high < limit:
            high *= 2
        for _ in range(20):
            tables = (low + high) / 2
            low, high = (tables, high) if np.exp(tables * apart).mean() > miss else (low, tables)
        return high * (ROW + vectors / 2**bits)

    same = np.mean([turn(i).mean(axis=1) for i in range(TRIAL)], axis=0)
    # the plan of centred vectors stands where the data are so
    costs = {bits: foreseen(bits) for bits in range(longest, 0, -1)}
    bits = min(costs, key=costs.get)
    bits = longest if costs[longest] <= 1.5 * costs[bits] else bits
    # never fewer than random signs of uncentred vectors would need
    least = math.ceil(math.log(miss) / math.log(1 - (1 - math.acos(cosine) / math.pi) ** bits))
    met, tables = np.zeros(len(a), bool), 0
    while tables < least or (~met).mean() > miss:
        if costs[bits] > limit or (tables + 1) * (ROW + vectors / 2**bits) > limit:
            return 0, 1, turns[:1]
        i, piece = divmod(tables, turns[0][1].shape[1] // bits)
        met |= turn(i)[:, piece * bits : (piece + 1) * bits].all(axis=1)
        if piece == turns[0][1].shape[1] // bits - 1:
            agree[i] = agree[i][:, :0]
        tables += 1
    return bits, tables, turns[: math.ceil(tables / (turns[0][1].shape[1] // bits))]


def substrings(vectors: np.ndarray, turns: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> np.ndarray:
    """The substrings of every code: one unsigned number for each table."""
    if not bits:
        return np.zeros((len(vectors), 1), "<u4")
    out = []
    for centre, projection in turns:
        signs = (vectors - centre) @ projection >= 0
        for i in range(signs.shape[1] // bits):
            out.append(signs[:, i * bits : (i + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64)))
    return np.stack(out[:tables], axis=1).astype("<u4")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors, scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled by the largest value first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(plans: dict[int, tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]):
    """Codes by the plan of each vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == dimension)))
                bits, tables, turns = plans.get(int(dimension), (0, 1, []))
                code = substrings(_matrix(own.column("embedding")), turns, bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [own.column("rep"), own.column("copies"), own.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary())],
                    ["rep", "copies", "embedding", "code"],
                )

    return run


def _tile(x: np.ndarray, codes: np.ndarray, copies: np.ndarray, reps: np.ndarray, chunks: np.ndarray, key: tuple[int, int, int], cosine: float):
    """Per vector with links in this tile: its links counted with copies, and the smallest vector it reaches here."""
    table, a, b = key
    close = x @ x.T >= cosine
    if a == b:
        np.fill_diagonal(close, False)
    else:
        close &= chunks[:, None] != chunks[None, :]
    for earlier in range(table):
        if not close.any():
            return None
        close &= codes[:, None, earlier] != codes[None, :, earlier]
    has = close.any(axis=1)
    if not has.any():
        return None
    name, label = spanning_links(close, reps)
    return name, (close @ copies)[has], label


def _compare(cosine: float):
    """Rows come sorted by tile; a tile is compared when its last row is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ends in sorted_groups(batches, ("d", "t", "key", "a", "b")):
            vectors, codes = part.column("embedding").chunk(0), part.column("code")
            copies, reps, chunks, table, a, b = (part.column(c).to_numpy() for c in ("copies", "rep", "chunk", "t", "a", "b"))
            found, begin = [], 0
            for end in ends:
                s = slice(begin, end)
                if end - begin > 1:
                    code = np.frombuffer(b"".join(codes[s].to_pylist()), "<u4").reshape(end - begin, -1)
                    out = _tile(_matrix(vectors[s]), code, copies[s], reps[s], chunks[s], (int(table[begin]), int(a[begin]), int(b[begin])), cosine)
                    if out is not None:
                        found.append(out)
                begin = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["rep", "links", "label"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Two vectors link if their cosine, in double precision, is at least `cosine`. n_links counts the other rows linked
    directly; component_id is the smallest vec_id reachable by links, the row's own included; kept says that these are
    equal. Vectors that are null, empty, zero, or hold nulls or non-finite values link with nothing; others may link with
    vectors of their length (each length has rotations and tables of its own). Rows of equal vectors are compared once and counted as often as they are there. A row without
    vec_id links like others but names no component (component_id is null where no row of it has one, and
    such a row is kept). Ids are below 2^62.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False))
    good = rows.where(sound)
    # a class of equal vectors goes by its smallest id, or by a hash where no row has one
    name = F.coalesce(F.min("vec_id"), F.shiftrightunsigned(F.xxhash64("embedding"), 2) + F.lit(NAMELESS))
    classes = cut_lineage(good.groupBy("embedding").agg(name.alias("rep"), F.count("*").alias("copies")), "vectors")

    plans = {}
    draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(SEED)), 11) / F.lit(2.0**53)
    # one number for each length that occurs; a length of few vectors is compared all with all
    for length in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).where(F.col("c") > CHUNK).collect():
        alike = classes.where(F.size("embedding") == length["d"])
        sample = alike.where(draw < SAMPLE / length["c"]).select("embedding").limit(2 * SAMPLE).toArrow()
        sample = sample if sample.num_rows else alike.select("embedding").limit(1).toArrow()
        plans[length["d"]] = fit_tables(_matrix(sample.column("embedding").combine_chunks()), length["c"], cosine)

    schema = "rep long, copies long, embedding array<double>, code binary"
    coded = cut_lineage(classes.select("rep", "copies", "embedding").mapInArrow(tidy(_codes(plans)), schema), "codes")
    table = F.explode(F.sequence(F.lit(0), (F.octet_length("code") / 4).cast("int") - 1)).alias("t")
    # the four bytes as they lie: a reverse of binary goes by the characters of a string
    piece = F.substring("code", F.col("t") * 4 + 1, F.lit(4))
    light = coded.select("rep", "code", F.size("embedding").alias("d"), table).select("d", "t", F.conv(F.hex(piece), 16, 10).cast("long").alias("key"), "rep")
    sizes = light.groupBy("d", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut_lineage(sizes.select("d", "t", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "buckets")
    chunk = F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("int")
    chunked = light.join(sizes, ["d", "t", "key"]).withColumn("chunk", chunk)
    tiled = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("d", "t", "key", "rep", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    tile = ("d", "t", "key", "a", "b")
    full = tiled.join(coded, "rep").repartition(*tile).sortWithinPartitions(*tile)
    found = cut_lineage(full.select(*tile, "chunk", "rep", "copies", "embedding", "code").mapInArrow(tidy(_compare(cosine)), "rep long, links long, label long"), "links")

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "rep")
    told = classes.join(linked, "rep", "left").join(labels, "rep", "left")
    told = told.select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    told = told.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id")))
    out = good.join(told, "embedding").select("vec_id", "n_links", "component_id")
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))
    return out.unionByName(_alone(rows.where(~sound)))


def _alone(rows: DataFrame) -> DataFrame:
    """Rows that link with nothing."""
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
