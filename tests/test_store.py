"""Stored tables: pruning by trait, batches that count together or not at all, catalog versions, peaks, compaction."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from statloom.functions.text import trait_bucket
from statloom.operators import peaks as peaking
from statloom.operators import regions, slices, summaries
from statloom.plans import ingest as ingesting
from statloom.schemas import BUCKET, CATALOG_SCHEMA
from statloom.sources import sinks, store
from statloom.sources.sumstats import read_peaks, read_sketches, read_table
from tests.test_files import some_rows, write_gz

SCHEMA = "project string, study string, TRAITID string, CHR int, POS int, EA string, NEA string, BETA double, SE double, EAF double, MLOG10P double"


def rows_of(traits, n=30, seed=1, project="p", study="s"):
    r = random.Random(seed)
    return [(project, study, t, r.choice([1, 2]), r.randint(1, 900_000), r.choice("AC"), "G", r.uniform(-1, 1), 0.1, 0.3, round(r.random() * 12, 2)) for t in traits for _ in range(n)]


def scanned(df, action):
    """Files and rows that the scans of a frame read, by Spark's own metrics."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        result = action(df)
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = []
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if "Scan parquet" in leaf.nodeName() and "MLOG10P" in leaf.toString():
                metrics = leaf.metrics()
                found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        return result, found
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def hundred(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hundred") / "table")
    names = [f"trait{i:03d}" for i in range(100)]
    rows = [r for i, t in enumerate(names) for r in rows_of([t], 40, i, f"p{i % 2}", f"s{i % 5}")]
    assert sinks.store_sumstats(spark.createDataFrame(rows, SCHEMA), path)
    return path, rows


@pytest.mark.parametrize("chosen", [["trait000"], ["trait003", "trait017", "trait042"], [f"trait{i:03d}" for i in range(0, 100, 2)], [f"trait{i:03d}" for i in range(100)]])
def test_only_buckets_of_chosen_traits_are_read(spark, hundred, chosen):
    path, rows = hundred
    table = read_table(spark, path)
    own = {t: (p, s) for p, s, t, *_ in rows}
    catalog = spark.createDataFrame([(*own[t], t) for t in chosen] + [(None, "s0", "trait001"), ("p0", "s0", None)], "project string, study string, data_id string")
    result, found = scanned(slices.in_traits(table, catalog), lambda df: df.collect())
    assert sorted(tuple(r[c] for c in ("TRAITID", "CHR", "POS", "EA")) for r in result) == sorted((t, c, at, ea) for _, _, t, c, at, ea, *_ in rows if t in chosen)
    assert BUCKET not in slices.in_traits(table, catalog).columns
    parts = {(*own[t], spark.range(1).select(trait_bucket(F.lit(t))).first()[0]) for t in chosen}
    held = {tuple(r) for r in table.select("project", "study", BUCKET).distinct().collect()}
    in_parts = table.groupBy("project", "study", BUCKET).count().collect()
    most = sum(r["count"] for r in in_parts if (r["project"], r["study"], r[BUCKET]) in parts)
    assert parts <= held and len(found) == 1 and found[0][0] == len(parts) and found[0][1] <= most
    if len(chosen) < 10:
        assert found[0][1] < len(rows) / 8


def test_one_trait_and_one_group(spark, hundred):
    path, rows = hundred
    table = read_table(spark, path)
    result, found = scanned(slices.in_trait(table, "trait008"), lambda df: df.count())
    assert result == 40
    _, found = scanned(slices.in_trait(table, "trait008"), lambda df: df.collect())
    assert found[0][0] <= 10
    result, found = scanned(slices.in_group(table, "p1", "s3"), lambda df: df.collect())
    assert len(result) == sum(r[:2] == ("p1", "s3") for r in rows) == found[0][1]


def test_an_export_reads_the_buckets_only(spark, hundred):
    from statloom.plans.export import export

    path, rows = hundred
    names = CATALOG_SCHEMA.names
    records = [dict.fromkeys(names) | {"project": p, "study": s, "data_id": t, "category": "GWAS"} for p, s, t in {r[:3] for r in rows}]
    catalog = spark.createDataFrame([tuple(r[n] for n in names) for r in records], CATALOG_SCHEMA)
    results = export(read_table(spark, path), catalog, {"data_ids": ["trait000", "trait031", "trait077"]})
    result, found = scanned(results["result"], lambda df: df.collect())
    assert len(result) == 120 and found[0][0] == 3 and found[0][1] < len(rows) / 8


def listed(spark, folder, names, seed=0):
    files = [write_gz(folder / f"{n}.tsv.gz", some_rows(seed + i)) for i, n in enumerate(names)]
    return spark.createDataFrame([("p", "s", "GWAS", f) for f in files], "project string, study string, category string, file_path string")


@pytest.mark.parametrize("where", ["_describe", "store.publish"])
def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch, where):
    """Rows written, the log not: readers see nothing of it, and the same batch again adds its rows once."""
    paths = (f"{tmp_path}/table", f"{tmp_path}/catalog")
    one, two = listed(spark, tmp_path, ["a"]), listed(spark, tmp_path, ["b", "c"], 5)
    ingesting.ingest(one, *paths, batch="stream#0", dedup=True)
    before = read_table(spark, paths[0]).count()

    def failing(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if where == "_describe":
            patch.setattr(sinks, "_describe", failing)
        else:
            patch.setattr(store, "publish", failing)
        with pytest.raises(RuntimeError, match="lost"):
            ingesting.ingest(two, *paths, what="data", batch="stream#1", dedup=True)
    assert read_table(spark, paths[0]).count() == before == 80
    assert ingesting.stored_traits(spark, paths[0]).count() == 1
    for dedup in (True, False, False):  # under its name it is there once, also without a look at the traits
        ingesting.ingest(two, *paths, what="data", batch="stream#1", dedup=dedup)
        assert read_table(spark, paths[0]).count() == 240 and ingesting.stored_traits(spark, paths[0]).count() == 3
    assert read_peaks(spark, paths[0]).agg(F.sum("n")).first()[0] == 240
    assert len(store.vacuum(spark, paths[0])) == 1 and read_table(spark, paths[0]).count() == 240


def test_jobs_done_before_a_failure_are_left_out(spark, tmp_path, monkeypatch):
    files = ingesting.known_files(listed(spark, tmp_path, "abcdef"))
    path, done = f"{tmp_path}/table", []
    real = ingesting.store_sumstats

    def second_fails(*args):
        if len(done) == 1:
            raise RuntimeError("lost")
        done.append(args[2])
        return real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(ingesting, "store_sumstats", second_fails)
        with pytest.raises(RuntimeError):
            ingesting.ingest_sumstats(files, path, files_per_job=2, batch="night")
    assert 0 < read_table(spark, path).count() < 480
    ingesting.ingest_sumstats(files, path, files_per_job=2, batch="night")
    assert read_table(spark, path).count() == 480


def test_files_without_rows_and_with_odd_rows_only(spark, tmp_path):
    import gzip

    empty = tmp_path / "empty.tsv.gz"
    with gzip.open(empty, "wt") as out:
        out.write("CHR\tPOS\tEA\tNEA\tEAF\tBETA\tSE\tMLOG10P\n")
    odd = write_gz(tmp_path / "odd.tsv.gz", [r | {"POS": -1} for r in some_rows(3, 5)])
    files = [spark.createDataFrame([("p", "s", "GWAS", str(f))], "project string, study string, category string, file_path string") for f in (empty, odd)]
    assert ingesting.ingest(files[0], f"{tmp_path}/t", f"{tmp_path}/c") is None
    assert read_table(spark, f"{tmp_path}/t").count() == 0 and ingesting.stored_traits(spark, f"{tmp_path}/t").count() == 1
    assert ingesting.ingest(files[1], f"{tmp_path}/t", f"{tmp_path}/c").count() == 5
    assert read_table(spark, f"{tmp_path}/t").count() == 0


def test_an_ingest_leaves_no_scratch(spark, tmp_path):
    from statloom.session import scratch_paths

    before = scratch_paths(spark)
    ingesting.ingest(listed(spark, tmp_path, "ab"), f"{tmp_path}/t", f"{tmp_path}/c")
    assert scratch_paths(spark) == before


def record(project, study, i, **more):
    return tuple((dict.fromkeys(CATALOG_SCHEMA.names) | {"project": project, "study": study, "data_id": f"d{i}", "build": "GRCh37"} | more).values())


def test_catalog_readers_see_before_or_after(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/catalog"
    sinks.save_catalog(spark.createDataFrame([record(p, "x", i) for p in "ab" for i in range(5)], CATALOG_SCHEMA), path)
    seen = []
    real = store.publish

    def looked_at(*args):
        seen.append(ingesting.read_catalog(spark, path).count())
        return real(*args)

    opened = ingesting.read_catalog(spark, path)
    with monkeypatch.context() as patch:
        patch.setattr(store, "publish", looked_at)
        assert ingesting.delete_records(spark, path, opened.where("project = 'a' OR data_id = 'd1'")) == 6
    assert seen == [10] and ingesting.read_catalog(spark, path).count() == 4
    assert opened.count() == 10  # a reader that opened the version before still has it

    def failing(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "publish", failing)
        with pytest.raises(RuntimeError):
            ingesting.modify_records(spark, path, spark.createDataFrame([("b", "x", "d2", "GRCh38")], "project string, study string, data_id string, build string"))
    assert ingesting.read_catalog(spark, path).where("build = 'GRCh38'").isEmpty()
    store.vacuum(spark, path)
    assert ingesting.read_catalog(spark, path).count() == 4


def test_two_writers(spark, tmp_path, monkeypatch):
    """A change that another writer overtakes is worked out again on what that one left."""
    path = f"{tmp_path}/catalog"
    sinks.save_catalog(spark.createDataFrame([record("a", "x", i) for i in range(4)], CATALOG_SCHEMA), path)
    real, overtaken = store.publish, []

    def slow(spark_, table, version):
        if not overtaken:
            overtaken.append(version.number)
            with monkeypatch.context() as inner:
                inner.setattr(store, "publish", real)
                ingesting.delete_records(spark, path, spark.createDataFrame([("a", "x", "d0")], "project string, study string, data_id string"))
        return real(spark_, table, version)

    patch = spark.createDataFrame([("a", "x", "d0", "GRCh38"), ("a", "x", "d3", "GRCh38")], "project string, study string, data_id string, build string")
    with monkeypatch.context() as outer:
        outer.setattr(store, "publish", slow)
        assert ingesting.modify_records(spark, path, patch) == 1
    assert sorted((r.data_id, r.build) for r in ingesting.read_catalog(spark, path).collect()) == [("d1", "GRCh37"), ("d2", "GRCh37"), ("d3", "GRCh38")]
    with pytest.raises(store.ChangedMeanwhile):
        store.publish(spark, path, store.Version(1))


def brute_flags(rows, listed, threshold):
    out = set()
    for key in {r[:3] for r in rows}:
        for c in {c for c, _, _ in listed}:
            low, high = min(max(1, a) for d, a, _ in listed if d == c), max(b for d, _, b in listed if d == c)
            own = [r for r in rows if r[:3] == key and r[3] == c]
            if any(low <= r[4] <= high for r in own):
                out |= {(*key, c, a, b, any(a <= r[4] <= b and (threshold <= 0 or (r[10] is not None and r[10] > threshold)) for r in own)) for d, a, b in listed if d == c}
    return out


@pytest.mark.parametrize("threshold", [0.0, 6.0, 11.5])
def test_regions_from_stored_peaks(spark, tmp_path, threshold):
    """Regions that end anywhere in bins, some between the variants of one bin; peaks in several parts."""
    r = random.Random(int(threshold))
    rows = rows_of([f"t{i}" for i in range(9)], 60, 7)
    rows = [(*row[:10], None if r.random() < 0.1 else row[10]) for row in rows]
    for i in range(3):
        sinks.store_sumstats(spark.createDataFrame(rows[i::3], SCHEMA), f"{tmp_path}/t")
    table, known = read_table(spark, f"{tmp_path}/t").drop(BUCKET), read_peaks(spark, f"{tmp_path}/t").drop(BUCKET)
    for asked in ([(1, a, a + r.randint(0, 250_000)) for a in (r.randint(-50_000, 900_000) for _ in range(40))] + [(2, 5_000, 4_000), (3, 1, 9)], [(1, 333_000, 339_000), (2, 100, 90_000)]):
        frame = spark.createDataFrame(asked, "CHR int, START int, END int")
        want = brute_flags(rows, [x for x in set(asked)], threshold)
        for peaks in (known, None):
            got = regions.region_flags(table, frame, threshold, peaks=peaks)
            names = ("project", "study", "TRAITID", "CHR", "START", "END", "PVALUE_FILT_FLAG")
            assert {tuple(x[n] for n in names) for x in got.collect()} == want
        if threshold:
            kept = regions.region_pvalue_filter(table, frame, threshold, peaks=known)
            hit = {w[:6] for w in want if w[6]}
            inside = sorted(str(x) for x in rows if any(x[:4] == h[:4] and h[4] <= x[4] <= h[5] for h in hit))
            assert sorted(str(tuple(x[n] for n in kept.columns)) for x in kept.collect()) == sorted(str(tuple(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], eval(s)))[n] for n in kept.columns)) for s in inside)


def test_few_variants_are_read_for_regions(spark, tmp_path, monkeypatch):
    rows = rows_of([f"t{i}" for i in range(6)], 400, 11)
    sinks.store_sumstats(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/t")
    known, met = read_peaks(spark, f"{tmp_path}/t").drop(BUCKET), []
    real = peaking.pair_inside
    monkeypatch.setattr(peaking, "pair_inside", lambda points, *a: (met.append(points.count()), real(points, *a))[1])
    whole = spark.createDataFrame([(1, 100_000, 399_999), (2, 1, 899_999)], "CHR int, START int, END int")
    assert regions.significant_regions(read_table(spark, f"{tmp_path}/t"), whole, 3.0, peaks=known).count() == 12 and met == []
    cut = spark.createDataFrame([(1, 150_000, 151_000)], "CHR int, START int, END int")
    regions.significant_regions(read_table(spark, f"{tmp_path}/t"), cut, 3.0, peaks=known).collect()
    assert all(n < 400 for n in met)


def test_compaction(spark, tmp_path):
    """After ten appends the files of a partition follow each other, and nothing else has changed."""
    path = f"{tmp_path}/t"
    rows = rows_of([f"t{i}" for i in range(12)], 200, 3)
    for i in range(10):
        sinks.store_sumstats(spark.createDataFrame(rows[i::10], SCHEMA), path)
    before = sorted(map(str, read_table(spark, path).collect()))
    assert sinks.compact_sumstats(spark, path, file_bytes=5_000)
    table = read_table(spark, path)
    assert sorted(map(str, table.collect())) == before
    files: dict[str, list] = {}
    for r in table.select("CHR", "TRAITID", "POS", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect():
        files.setdefault(r.f, []).append((r.CHR, r.TRAITID, r.POS))
    assert len(files) > 20 and all(keys == sorted(keys) for keys in files.values())
    folders: dict[str, list] = {}
    for f, keys in files.items():
        folders.setdefault(f.rsplit("/", 1)[0], []).append((keys[0], keys[-1]))
    assert any(len(spans) > 1 for spans in folders.values())
    for spans in folders.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert read_peaks(spark, path).agg(F.sum("n")).first()[0] == len(rows) and ingesting.stored_traits(spark, path).count() == 12
    assert not sinks.compact_sumstats(spark, path)
    assert len(store.vacuum(spark, path)) == 10 and read_table(spark, path).count() == len(rows)


def test_files_without_a_log(spark, tmp_path):
    df = spark.createDataFrame(rows_of(["t"]), SCHEMA)
    sinks.append_sumstats(df, f"{tmp_path}/plain")
    assert read_table(spark, f"{tmp_path}/plain").count() == 30
    with pytest.raises(ValueError, match="no log"):
        sinks.store_sumstats(df, f"{tmp_path}/plain")
    with pytest.raises(ValueError, match="no log"):
        read_peaks(spark, f"{tmp_path}/plain")


def test_aligned_effects(spark):
    from statloom.operators import meta

    rows = [("t1", 1, 5, "A", "C", 0.1, 0.2), ("t3", 1, 5, "A", "C", 0.3, 0.4), ("t3", 1, 5, "A", "C", 0.2, 0.5), ("t2", 1, 9, "A", "C", None, 0.1), ("t9", 1, 9, "A", "C", 1.0, 1.0)]
    table = spark.createDataFrame(rows, "TRAITID string, CHR int, POS int, EA string, NEA string, BETA double, SE double")
    named = meta.trait_dictionary(spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t3",)], "data_id string"))
    got = {r.SNP: (r.ordinals, r.betas, r.ses) for r in meta.aligned_effects(table, named).collect()}
    assert got == {"1:5:A:C": ([0, 2], [0.1, 0.3], [0.2, 0.5]), "1:9:A:C": ([1], [None], [0.1])}


def test_variance_from_stored_sketches(spark, tmp_path):
    """Two batches of sketches bracket the median, at every filter and for traits of one variant to many; equal to a plain median."""
    path, r = str(tmp_path / "table"), random.Random(8)
    rows = [("p", "s", t, 1, i + 1, "A", "G", 0.1, r.choice([0.1, r.uniform(0.01, 0.3)]), round(r.choice([r.random(), r.random() * 0.02]), 4), 1.0)
            for t, n in (("one", 1), ("two", 2), ("some", 401), ("many", 30_000)) for i in range(n)]
    for half in (0, 1):
        assert sinks.store_sumstats(spark.createDataFrame(rows[half::2], SCHEMA), path)
    sizes = {"one": 10, "two": 20, "some": 300, "many": 4_000, "other": 5}
    samples = spark.createDataFrame([("p", "s", t, n) for t, n in sizes.items()] + [("p", "s", "none", None)], "project string, study string, TRAITID string, N long")
    table, sketches = read_table(spark, path).drop(BUCKET), read_sketches(spark, path).drop(BUCKET)
    assert sketches.groupBy("TRAITID").agg(F.sum("n").alias("n")).where("n > 1000").collect()[0]["n"] == 30_000
    for maf in (None, 0.01, 0.003, 0.3):
        want = {}
        for _, _, t, *_, se, eaf, _ in rows:
            if maf is None or maf <= eaf <= 1.0 - maf:
                want.setdefault(t, []).append(se * se * 2 * eaf * (1 - eaf) * sizes[t])
        found = summaries.pheno_variance(table, samples, sketches, maf)
        got = {x["TRAITID"]: x["pheno_variance"] for x in found.collect()}
        assert got == {t: pytest.approx(statistics.median(v), rel=1e-12) for t, v in want.items()}


@pytest.mark.parametrize("grouped", [True, False])
def test_describing_a_batch_moves_its_groups_once(spark, tmp_path, monkeypatch, grouped):
    """Tasks read no more rows than DESCRIBED_ROWS where files can be cut so; without folders to fill, peaks and sketches are not dealt a second time."""
    rows = spark.createDataFrame(rows_of([f"t{i}" for i in range(12)], 200, 5), SCHEMA)
    rows = rows if grouped else rows.drop("project", "study")
    path, dealt, splits, real = f"{tmp_path}/t", [], [], type(rows).hint
    monkeypatch.setattr(sinks, "DESCRIBED_ROWS", 300)
    monkeypatch.setattr(type(rows), "hint", lambda df, name, *by: (dealt.append(by), real(df, name, *by))[1])
    told = sinks.peak_table
    monkeypatch.setattr(sinks, "peak_table", lambda df: (splits.append((int(spark.conf.get(sinks.SPLIT_BYTES)), df.rdd.getNumPartitions())), told(df))[1])
    sinks.store_sumstats(rows, path)
    assert len(dealt) == (3 if grouped else 1)
    (split, tasks), = splits
    assert split <= store.size_of(spark, path) // 8 and tasks >= 8
    assert spark.conf.get(sinks.SPLIT_BYTES) == "134217728b"
    # of equal peaks either place may be told
    got, want = read_peaks(spark, path).drop(BUCKET, "top_at"), told(rows).drop("top_at")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert read_sketches(spark, path).agg(F.sum("n")).first()[0] == rows.where("EAF BETWEEN 0 AND 1 AND SE IS NOT NULL").count()
