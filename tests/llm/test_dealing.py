"""Sharding and mixing: against their laws."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statloom.llm.mixing import log_factorial, mix, mixed_documents, splitting_tree, targets
from statloom.llm.sharding import jump_shard, shard_documents, shard_rows
from tests.llm.conftest import SF_DIR, frame, odd_rows, plain_words


def test_sharded_documents(odd):
    rows = shard_documents(odd).collect()
    assert len(rows) == len(odd_rows())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in odd_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_empty_tables(nothing):
    assert shard_documents(nothing).collect() == [] and mix(nothing).collect() == [] and mixed_documents(nothing).collect() == []


@pytest.mark.parametrize("shards", [1, 2, 7, 300])
def test_jump_moves_only_into_the_new_shard(spark, shards):
    rows = spark.range(20_000).select(jump_shard(F.col("id"), shards).alias("s"), jump_shard(F.col("id"), shards + 1).alias("g")).collect()
    counts = Counter(r.s for r in rows)
    assert all(r.g in (r.s, shards) for r in rows) and set(counts) <= set(range(shards))
    moved = sum(r.g == shards for r in rows)
    assert abs(moved - 20_000 / (shards + 1)) < 6 * math.sqrt(20_000 / (shards + 1)) + 1
    assert max(counts.values()) < 20_000 / shards * 1.6 + 30


def test_many_jumps_end(spark, monkeypatch):
    usual = [r[0] for r in spark.range(3000).select(jump_shard(F.col("id"), 1000)).collect()]
    monkeypatch.setattr("statloom.llm.sharding.USUAL_JUMPS", 1)
    assert [r[0] for r in spark.range(3000).select(jump_shard(F.col("id"), 1000)).collect()] == usual


def test_one_key_for_all(spark, monkeypatch):
    monkeypatch.setattr("statloom.llm.sharding.BLOCK_BITS", 3)
    rows = shard_rows(spark.range(500).select(F.lit(7).alias("doc_id")), 5).collect()
    assert sorted(r.slot for r in rows) == list(range(500)) and len({r.shard for r in rows}) == 1


def filled(sizes: dict, weights=(3, 1, 2), share=1.5, repeat=2) -> dict:
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(repeat * sizes[s] for s in full)
        open_ = sum(w[s] for s in sizes if s not in full)
        out = {s: repeat * sizes[s] if s in full else rest * w[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and out[s] >= repeat * sizes[s]}
        if not over:
            return out
        full |= over


def check_mix(rows, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(plain_words(t))) for i, t in docs)
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1


def test_mix(spark, odd):
    check_mix(mix(odd).collect(), odd_rows())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mix(docs).collect()
    check_mix(rows, [(r.doc_id, r.text) for r in docs.collect()])
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert all(len(r.places) == r.copies for r in rows)
    by_shard = defaultdict(list)
    for r in rows:
        for shard, place in zip(r.shards, r.places):
            by_shard[shard].append((place, r.doc_id, r.source))
    assert sorted(by_shard) == list(range(16))
    for held in by_shard.values():
        assert len({place for place, *_ in held}) == len(held)
        order = [i for _, i, _ in sorted(held)]
        assert len(held) < 8 or (order != sorted(order) and order != sorted(order, reverse=True))


def test_log_factorial(spark):
    counts = [*range(0, 40), 100, 4096, 10**6, 10**9]
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", log_factorial(F.col("n")).alias("x")).collect()
    assert all(r.x == pytest.approx(math.lgamma(r.n + 1), rel=1e-11, abs=1e-12) for r in got)


def test_laid_out_by_shard(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clashing = docs.withColumn("shard", F.lit("x")).withColumn("id", F.lit(7)).withColumn("round", F.lit(None).cast("string"))
    taken = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies or not r.size}
    out = mixed_documents(clashing)
    assert out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == {i: max(n, 1) for i, n in taken.items()}
    again = mixed_documents(clashing.repartition(7))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("share, repeat", [(1.0, 1), (2.0, 2), (0.3, 2), (3.0, 4)])
def test_other_shares(spark, share, repeat):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mix(docs, (5, 1), share, repeat).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = filled(dict(sizes), (5, 1), share, repeat)
    assert all(r.target == pytest.approx(want[r.source]) and r.copies <= repeat for r in rows)


def test_random_targets(spark):
    r = random.Random(4)
    for _ in range(5):
        sizes = {f"s{i}": r.choice([0, 1, 10, 500, 10**6, r.randint(1, 10**5)]) for i in range(r.randint(1, 12))}
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = filled(sizes)
        assert {x.source: pytest.approx(x.target) for x in rows} == want


def test_splitting_tree(spark):
    quotas = {"a": 100, "b": 7, "c": 0, None: 53}
    rows = splitting_tree(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 6, 1).collect()
    by_source, by_shard = Counter(), Counter()
    for x in rows:
        assert x.quota >= 0
        by_source[x.source] += x.quota
        by_shard[x.shard] += x.quota
    assert dict(by_source) == quotas and set(by_shard.values()) <= {26, 27} and set(by_shard) == set(range(6))


def test_tree_draws_like_a_hypergeometric(spark):
    means = []
    for seed in range(40):
        rows = splitting_tree(spark.createDataFrame([("a", 30), ("b", 70)], "source string, quota long"), 2, seed).collect()
        means.append(next(x.quota for x in rows if x.shard == 0 and x.source == "a"))
    # mean 15, variance 50 * 0.3 * 0.7 * 50 / 99
    assert abs(sum(means) / 40 - 15) < 1.5 and 1 < len(set(means)) and max(means) <= 30


def test_mixed_documents(odd):
    rows = mixed_documents(odd).collect()
    assert mixed_documents(odd).columns == odd.columns
    count = Counter((r.doc_id, r.text) for r in rows)
    inputs = Counter(odd_rows())
    assert all(n <= 2 * inputs[k] for k, n in count.items()) and set(count) <= set(inputs)
    assert all(count[k] >= 1 for k in inputs if not plain_words(k[1]) and k[0] is not None)
    assert frame(odd.sparkSession, [(1, None)]).transform(mixed_documents).count() == 1
