"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with Spark expressions only.

1. Targets: the mix holds `share` times all words, shared among the sources by weight; no source gives more than
   `repeat` times its words, and what it cannot give goes to the others (water filling on sorted sources).
2. Quotas: a block is a fixed share of the mix; each source owes its target in whole blocks.
3. Splitting tree: the output shards are halved again and again. Each half draws its number of blocks from the
   node's blocks without replacement, source by source: a multivariate hypergeometric draw. The leaves
   hold exact quotas of every source, and every shard the same number of blocks, up to one.
4. Drawing: a source's documents stand in hashed order, a second and third time round if repeated. Its blocks are
   equal stretches of that order, hence disjoint and permuted; each shard gets its quota of them.
5. Local shuffle: every copy has a place in its shard, by another hash; the mix is laid out in the order of places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import word_count
from statloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, REPEAT = 1.5, 2
#: Output shards, and blocks of the mix for each of them.
SHARDS, BLOCKS = 16, 256
SEED = 1
#: Parts of a shard's order, each for one task to lay out.
SLICES = 64
#: Documents of a hash stretch if all were of one source; a stretch is summed up before the cumulative sum.
STRETCH_ROWS = 100


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, weight and target of every source, from one row (source, source_size) each.

    Sources stand in code point order, a null source last, and take the weights in turn. Sources of no words get none.
    """
    # one row per source stands in these windows, however many documents there are
    in_order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = weighed.withColumn("_level", level).withColumn("_full", F.col("cap") / F.col("weight") <= F.col("_level"))
    water = F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("weight"), "_level"))).over(everything)["_level"]
    target = F.when(F.col("_full"), F.col("cap")).otherwise(F.col("weight") * water)
    return levels.withColumn("target", target.cast("double")).select("source", "source_size", "weight", "target")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_factorial(n: Column) -> Column:
    """ln n!: by Stirling's series from 10 on, right to eleven digits."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(10)]), (n + 1).cast("int"))
    series = 1 / (12 * n) - 1 / (360 * F.pow(n, F.lit(3))) + 1 / (1260 * F.pow(n, F.lit(5)))
    return F.when(n < 10, small).otherwise((n + 0.5) * F.log(n) - n + F.lit(0.5 * math.log(2 * math.pi)) + series)


def hypergeometric(total: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many of `drawn` blocks out of `total` are among the `marked`, for a chance in [0, 1): by inversion."""
    log = log_factorial
    choices = lambda n, k: log(n) - log(k) - log(n - k)
    limits = F.struct(
        F.greatest(F.lit(0).cast("long"), drawn - (total - marked)).alias("least"), F.least(drawn, marked).alias("most"), choices(total, drawn).alias("all")
    )

    def draw(b: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), b["most"].alias("out"), F.lit(False).alias("done"))

        def step(s: Column, k: Column) -> Column:
            p = F.exp(choices(marked, k) + choices(total - marked, drawn - k) - b["all"])
            reached = lambda sum_: F.struct(sum_.alias("sum"), F.when(sum_ > chance, k).otherwise(b["most"]).alias("out"), (sum_ > chance).alias("done"))
            return F.when(s["done"], s).otherwise(_bound(s["sum"] + p, reached))

        return F.when(b["most"] <= b["least"], b["least"]).otherwise(F.aggregate(F.sequence(b["least"], b["most"]), start, step)["out"])

    return _bound(limits, draw)


def _chance(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(2.0**53)


def _place(seed: int, doc_id: Column, turn: Column) -> Column:
    """Place of a copy in its shard."""
    return F.xxhash64(F.lit(seed), F.lit("place"), doc_id, turn)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, source, quota: each source's whole quota dealt to the shards, from rows (source, quota).

    A node is one row with the quotas of all its sources; sources are few beside documents.
    """
    sources = F.sort_array(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(sources.alias("q"), F.sum("quota").cast("long").alias("blocks"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "blocks", "q")
    # shard s holds floor((s + 1) blocks / shards) - floor(s blocks / shards) blocks
    nodes = nodes.withColumn("all", F.col("blocks"))
    for _ in range(max(1, math.ceil(math.log2(shards))) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        bound = lambda s: F.floor(s * F.col("all") / shards).cast("long")
        halved = nodes.withColumn("mid", mid).withColumn("drawn", bound(F.col("mid")) - bound(F.col("lo")))
        kind = "struct<left:array<bigint>,rest:bigint,drawn:bigint>"
        start = F.struct(F.array().cast("array<bigint>").alias("left"), F.col("blocks").alias("rest"), F.col("drawn").alias("drawn")).cast(kind)

        def step(s: Column, x: Column) -> Column:
            chance = _chance(F.lit(seed), F.col("lo"), F.col("hi"), F.size(s["left"]))
            k = hypergeometric(s["rest"], x["quota"], s["drawn"], chance).cast("long")
            onward = lambda k: F.struct(F.concat(s["left"], F.array(k)).alias("left"), (s["rest"] - x["quota"]).alias("rest"), (s["drawn"] - k).alias("drawn"))
            return _bound(k, onward).cast(kind)

        taken = halved.withColumn("left", F.aggregate("q", start, step)["left"])
        left = F.zip_with("q", "left", lambda x, k: F.struct(x["source"].alias("source"), k.alias("quota")))
        right = F.zip_with("q", "left", lambda x, k: F.struct(x["source"].alias("source"), (x["quota"] - k).alias("quota")))
        child = lambda lo, hi, blocks, q: F.struct(lo.alias("lo"), hi.alias("hi"), blocks.alias("blocks"), q.alias("q"))
        both = F.when(
            F.col("hi") - F.col("lo") > 1,
            F.array(child(F.col("lo"), F.col("mid"), F.col("drawn"), left), child(F.col("mid"), F.col("hi"), F.col("blocks") - F.col("drawn"), right)),
        ).otherwise(F.array(child(F.col("lo"), F.col("hi"), F.col("blocks"), F.col("q"))))
        nodes = cut_lineage(taken.select(F.explode(both).alias("x"), "all").select("x.*", "all"), "tree")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.quota")


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, shards and places (one for each copy taken) of every row.

    A null text and a text without words have size 0 and are taken 0 times. A document is taken whole or not, each time
    round; its middle word decides which block it belongs to, so a source's words come within a document of its
    target. Copies stand in their shard by ascending place. Rows with a null doc_id or source, and repeated rows, are rows like others; runs agree.
    """
    if repeat < 1 or not 0 < share <= repeat:
        raise ValueError("a mix takes between nothing and `repeat` times its sources")
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_h"))
    sized = cut_lineage(sized, "sized")
    bits = min(max(4, (sized.count() // STRETCH_ROWS).bit_length()), 24)
    sized = sized.withColumn("_stretch", F.shiftright("_h", 64 - bits))
    summed = cut_lineage(sized.groupBy("source", "_stretch").agg(F.sum("size").alias("words")), "stretches")
    shares = targets(summed.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeat)
    wanted = cut_lineage(shares, "targets")
    block = F.sum("target").over(Window.partitionBy(F.lit(0))) / F.lit(shards * blocks)
    # every source that gives anything owes a block at least, even if there are more sources than blocks
    quotas = wanted.withColumn("quota", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / block))).otherwise(0).cast("long"))
    quotas = cut_lineage(quotas, "quotas")
    dealt = splitting_tree(quotas.select("source", "quota"), shards, seed)
    # the blocks of a source go to the shards in turn: ends[s] of them belong to shards 0 to s
    up_to = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    ends = dealt.withColumn("end", up_to).groupBy("source").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    plan = quotas.join(ends, quotas["source"].eqNullSafe(ends["source"]), "left").drop(ends["source"])

    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = summed.select("source", "_stretch", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_begin"))
    of_stretch = begins.join(plan, begins["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = sized.join(of_stretch, sized["source"].eqNullSafe(of_stretch["source"]) & (sized["_stretch"] == of_stretch["_stretch"]))
    rows = rows.drop(of_stretch["source"]).drop(of_stretch["_stretch"])
    inside = Window.partitionBy("source", "_stretch").orderBy("_h", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    placed = rows.withColumn("_middle", middle)

    def of_round(i: int) -> Column:
        at = F.floor((F.col("_middle") + i * F.col("source_size")) * F.col("quota") / F.col("target")).cast("long")
        return F.when((F.col("size") > 0) & (F.col("target") > 0) & (at < F.col("quota")), at)

    numbers = F.filter(F.array(*[of_round(i) for i in range(repeat)]), lambda b: b.isNotNull())
    shard_of = lambda b: F.size(F.filter("ends", lambda end: end <= b))
    place = lambda _, i: _place(seed, F.col("doc_id"), i)
    placed = placed.withColumn("blocks", numbers).withColumn("shards", F.transform("blocks", shard_of)).withColumn("places", F.transform("blocks", place))
    copies = F.size("blocks")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "shards", "places"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, laid out by shard and place; documents not taken go, columns as they are.

    A document without words is clean but gives the mix nothing; it stays once. Which copies a document
    has depends on its doc_id, size and source, so rows that share all three are taken as often as all of them are.
    A task lays out slices of shards: whole texts move once more, and files hold the copies in their shuffled order.
    """
    names = docs.columns
    copies = mix(docs).select(F.col("doc_id").alias("id"), "size", F.posexplode_outer(F.arrays_zip("shards", "places")).alias("round", "at"))
    # of one doc_id, at most one shard for each shard and round is kept, however many rows share it
    picks = copies.groupBy("id").agg(
        F.count("at").alias("copies"),
        F.count_if(F.coalesce("round", F.lit(0)) == 0).alias("rows"),
        F.max("size").alias("size"),
        F.sort_array(F.collect_set(F.struct("round", F.col("at.shards").alias("shard")))).alias("spots"),
    )
    whole = docs.select(F.col("doc_id").alias("own_id"), F.struct(*names).alias("doc"))
    kept = whole.join(picks.where("copies > 0 OR size = 0"), F.col("own_id").eqNullSafe(F.col("id")))
    times = F.greatest(F.lit(1), F.ceil(F.col("copies") / F.col("rows"))).cast("int")
    taken = kept.withColumn("round", F.explode(F.sequence(F.lit(0), times - 1)))
    turn = F.col("round") + F.when(F.col("rows") > 1, F.xxhash64("doc.text")).otherwise(F.lit(0))
    spot = F.element_at("spots", (F.pmod(turn, F.size("spots")) + 1).cast("int"))
    laid = taken.withColumn("shard", F.coalesce(spot["shard"], F.lit(0))).withColumn("place", _place(SEED, F.col("id"), F.col("round")))
    laid = laid.withColumn("slice", F.pmod("place", F.lit(SLICES))).hint("rebalance", "shard", "slice")
    return laid.sortWithinPartitions("shard", "slice", "place").select("doc.*")
