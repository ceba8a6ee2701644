"""Readers, ingest, export and writers on small files."""

import gzip
import hashlib
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statloom.operators import loci
from statloom.plans.export import export, write_export
from statloom.plans.ingest import ingest, known_files, read_catalog
from statloom.sources import sinks
from statloom.sources.files import content_ids
from statloom.sources.manifest import read_manifest, require_columns
from statloom.sources.regions import read_regions, read_trait_snps
from statloom.sources.sumstats import read_sumstats_files, read_table

COLUMNS = ["CHR", "POS", "EA", "NEA", "EAF", "BETA", "SE", "MLOG10P"]


def write_gz(path, rows, columns=COLUMNS, extra=()):
    names = [*columns, *extra]
    lines = ["\t".join(names)] + ["\t".join(str(r.get(n, "x")) for n in names) for r in rows]
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")
    return str(path)


def some_rows(seed, n=80):
    rng = random.Random(seed)
    return [
        {"CHR": rng.choice([1, 2]), "POS": 1_000 + 10_000 * i, "EA": rng.choice("AC"), "NEA": rng.choice("GT"), "EAF": round(rng.random(), 3),
         "BETA": round(rng.uniform(-1, 1), 3), "SE": round(rng.uniform(0.01, 0.3), 3), "MLOG10P": round(rng.random() * 12, 3)}
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    files = [
        write_gz(folder / "a.tsv.gz", some_rows(1)),
        write_gz(folder / "b.tsv.gz", some_rows(2), [*reversed(COLUMNS)], ["rsID", "N"]),
        write_gz(folder / "c.tsv.gz", some_rows(3)),
    ]
    parquet = str(folder / "d.parquet")
    import pandas as pd

    pd.DataFrame(some_rows(4)).assign(N=5).to_parquet(parquet)
    manifest = folder / "manifest.tsv"
    head = "project\tstudy\tcategory\tfile_path\tbuild\tpopulation\ttotal_samples\ttrait_desc\tnotes_source_id"
    lines = [head]
    for i, (path, study) in enumerate(zip([*files, parquet], ["Study One", "Study One", "other", "other"])):
        lines.append(f"My Project\t{study}\tGWAS\t{path}\tGRCh37\tEuropean, East Asian\t{100 + i}\ttrait {'AB'[i % 2]} P{i}\t{'src' + str(i) if i else ''}")
    lines.append(f"My Project\tother\tGWAS\t{folder}/absent.tsv.gz\tGRCh37\tEuropean\t7\tgone\tsrcx")
    manifest.write_text("\n".join(lines) + "\n")
    rows = read_manifest(spark, str(manifest))
    bad = ingest(rows, f"{folder}/table", f"{folder}/catalog")
    assert bad is None
    return folder, rows, files, parquet


def file_id(path):
    name = path.rsplit("/", 1)[-1]
    body = hashlib.sha256(open(path, "rb").read()).hexdigest()
    return hashlib.sha256((hashlib.sha256(name.encode()).hexdigest() + body).encode()).hexdigest()[:10]


def test_content_ids(spark, store):
    folder, rows, files, parquet = store
    got = {r["file_path"]: r["data_id"] for r in content_ids(rows).collect()}
    assert got == {**{f: file_id(f) for f in [*files, parquet]}, f"{folder}/absent.tsv.gz": None}


def test_ingested_table_and_catalog(spark, store):
    folder, rows, files, parquet = store
    table = read_table(spark, f"{folder}/table")
    counts = {(r["project"], r["study"], r["TRAITID"]): r["count"] for r in table.groupBy("project", "study", "TRAITID").count().collect()}
    assert counts == {("my_project", s, file_id(f)): 80 for f, s in zip([*files, parquet], ["study_one", "study_one", "other", "other"])}
    types = dict(table.dtypes)
    assert (types["CHR"], types["POS"], types["BETA"], types["EA"]) == ("int", "int", "float", "string")
    assert "N" not in types and "rsID" not in types
    first = some_rows(2)[0]
    back = table.where((F.col("TRAITID") == file_id(files[1])) & (F.col("POS") == first["POS"])).first()
    assert back["EAF"] == pytest.approx(first["EAF"]) and back["MLOG10P"] == pytest.approx(first["MLOG10P"])

    records = read_catalog(spark, f"{folder}/catalog")
    assert records.count() == 4
    one = records.where(F.col("data_id") == file_id(files[0])).first()
    assert one["population"] == ["European", "East Asian"] and one["total"] == {"samples": "100"} and one["notes"] == {"source_id": None}


def test_metadata_again_is_idempotent_and_data_can_be(spark, store, tmp_path):
    folder, rows, files, parquet = store
    ingest(rows, f"{tmp_path}/t", f"{tmp_path}/c")
    ingest(rows, f"{tmp_path}/t", f"{tmp_path}/c", dedup=True)
    assert read_table(spark, f"{tmp_path}/t").count() == 320
    assert read_catalog(spark, f"{tmp_path}/c").count() == 4
    ingest(rows, f"{tmp_path}/t", f"{tmp_path}/c", what="data")
    assert read_table(spark, f"{tmp_path}/t").count() == 640
    with pytest.raises(ValueError):
        ingest(rows, "x", "y", what="nothing")


def test_catalog_upsert_leaves_other_partitions(spark, store, tmp_path):
    folder, rows, files, parquet = store
    known = known_files(rows).cache()
    from statloom.plans.ingest import ingest_metadata

    ingest_metadata(known, f"{tmp_path}/c")

    def other():
        return {f for f in read_catalog(spark, f"{tmp_path}/c").inputFiles() if "/project=my_project/study=other/" in f}

    before = other()
    ingest_metadata(known.where("study = 'Study One'").withColumn("trait_desc", F.lit("changed")), f"{tmp_path}/c")
    assert before and other() == before
    got = {r["trait"]["desc"] for r in read_catalog(spark, f"{tmp_path}/c").where("study = 'study_one'").collect()}
    assert got == {"changed"} and read_catalog(spark, f"{tmp_path}/c").count() == 4


def test_ingest_without_pvalues(spark, tmp_path):
    path = write_gz(tmp_path / "n.tsv.gz", some_rows(5), [c for c in COLUMNS if c != "MLOG10P"])
    rows = spark.createDataFrame([("p", "s", "GWAS", path)], "project string, study string, category string, file_path string")
    with pytest.raises(ValueError, match="MLOG10P"):
        ingest(rows, f"{tmp_path}/t", f"{tmp_path}/c")
    ingest(rows, f"{tmp_path}/t", f"{tmp_path}/c", with_pvalue=False)
    table = read_table(spark, f"{tmp_path}/t")
    assert "MLOG10P" not in table.columns
    out = export(table, read_catalog(spark, f"{tmp_path}/c"), None, pvalue_thr=1.0)["result"]
    assert 0 < out.count() < 80 and out.where("MLOG10P <= 1").isEmpty()


def test_rows_outside_the_domain_are_returned(spark, tmp_path):
    rows = some_rows(6)
    rows[0]["CHR"], rows[1]["POS"] = 25, 0
    path = write_gz(tmp_path / "n.tsv.gz", rows)
    listed = spark.createDataFrame([("p", "s", "GWAS", path)], "project string, study string, category string, file_path string")
    bad = ingest(listed, f"{tmp_path}/t", f"{tmp_path}/c")
    assert bad.count() == 2 and read_table(spark, f"{tmp_path}/t").count() == 78


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot read"):
        read_sumstats_files(spark, ["x.txt"])
    path = write_gz(tmp_path / "m.tsv.gz", some_rows(7), COLUMNS[:5])
    with pytest.raises(ValueError, match="lacks the columns|absent from"):
        read_sumstats_files(spark, [path])
    with pytest.raises(ValueError, match="does not exist"):
        read_manifest(spark, f"{tmp_path}/none.tsv")
    (tmp_path / "empty.tsv").write_text("")
    with pytest.raises(ValueError, match="is empty"):
        read_manifest(spark, f"{tmp_path}/empty.tsv")
    (tmp_path / "short.csv").write_text("project,study\na,b\n")
    short = read_manifest(spark, f"{tmp_path}/short.csv", ",")
    with pytest.raises(ValueError, match="file_path, category"):
        require_columns(short)


def test_region_files(spark, tmp_path):
    bed = tmp_path / "r.bed"
    bed.write_text("chr1\t100\t200\textra\nX\t5\t9\tq\nY\t1\t2\tq\nchrM\t1\t2\tq\n")
    assert sorted(tuple(r) for r in read_regions(spark, str(bed)).collect()) == [(1, 100, 200), (23, 5, 9), (24, 1, 2)]
    snps = tmp_path / "s.csv"
    snps.write_text("CHR,POS\nchrX,500\n3,7\nchrUn,1\n")
    assert sorted(tuple(r) for r in read_regions(spark, str(snps)).collect()) == [(3, 7, 8), (23, 500, 501)]
    wrong = tmp_path / "w.txt"
    wrong.write_text("what,ever\n1,2\n")
    with pytest.raises(ValueError, match="neither"):
        read_regions(spark, str(wrong))


def test_trait_snp_files(spark, tmp_path):
    good = tmp_path / "g.csv"
    good.write_text("POS,SOURCE_ID,CHR,EA,NEA,CIS_TRANS,more\n5,s,chr1,AT,A,cis,q\n6,s,X,A,C,trans,q\n7,s,weird,A,C,cis,q\n")
    got = read_trait_snps(spark, str(good))
    assert sorted((r["SOURCE_ID"], r["CHR"], r["POS"], r["CIS_TRANS"]) for r in got.collect()) == [("s", 1, 5, "cis"), ("s", 23, 6, "trans")]
    bad = tmp_path / "b.csv"
    bad.write_text("SOURCE_ID,CHR,POS,EA,NEA\ns,1,5,T,A\n")
    with pytest.raises(ValueError, match="badly ordered"):
        read_trait_snps(spark, str(bad))
    bad.write_text("SOURCE_ID,CHR,POS\ns,1,5\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_trait_snps(spark, str(bad))


@pytest.mark.parametrize("file_format", ["parquet", "csv", "csv.gz"])
def test_formats(spark, tmp_path, file_format):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    target = sinks.write_result(df, f"{tmp_path}/o", file_format)
    assert target.endswith(f"o.{file_format}")
    back = spark.read.parquet(target) if file_format == "parquet" else spark.read.csv(target, header=True, inferSchema=True)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]
    empty = sinks.write_result(df.where("x > 5"), f"{tmp_path}/e", file_format)
    back = spark.read.parquet(empty) if file_format == "parquet" else spark.read.csv(empty, header=True)
    assert back.columns == ["x", "y"] and back.isEmpty()
    with pytest.raises(ValueError, match="unknown file format"):
        sinks.write_result(df, f"{tmp_path}/o", "xlsx")


TEMPLATE = {"project": "My Project", "output": ["trait_desc", "total_samples"]}


@pytest.fixture(scope="module")
def tables(spark, store):
    folder = store[0]
    return read_table(spark, f"{folder}/table"), read_catalog(spark, f"{folder}/catalog")


def test_export_full(spark, store, tables, tmp_path):
    folder, rows, files, parquet = store
    results = export(*tables, {**TEMPLATE, "study": "Study One"}, attributes="BETA,SE,EA,NEA", pvalue_thr=6.0)
    assert set(results) == {"metadata", "result"}
    got = results["result"]
    want = sum(r["MLOG10P"] > 6 for s in (1, 2) for r in some_rows(s))
    assert got.count() == want
    assert got.columns == ["SNPID", "project", "study", "CHR", "TRAITID", "POS", "BETA", "SE", "EA", "NEA", "meta_project", "meta_study",
                           "meta_category", "meta_notes_source_id", "meta_trait_desc", "meta_total_samples"]
    written = write_export(results, f"{tmp_path}/out", "csv.gz")
    names = {p.name for p in (tmp_path / "out.csv.gz").iterdir() if p.is_dir()}
    assert names == {f"output_prefix=out_my_project_study_one_{file_id(files[0])}", "output_prefix=out_my_project_study_one_src1"}
    back = spark.read.csv(written["result"], header=True)
    assert back.count() == want
    meta = spark.read.csv(written["metadata"], header=True)
    assert meta.count() == 2 and "output_prefix" in meta.columns


def test_export_without_metadata_columns(tables):
    got = export(*tables, TEMPLATE, skip_meta=True)["result"]
    assert not [c for c in got.columns if c.startswith("meta_")] and got.count() == 320


def test_export_loci(spark, tables, tmp_path):
    results = export(*tables, TEMPLATE, locusbreaker=True, phenovar=True, hole_size=30_000, locus_flanks=5_000, meta_analysis=True)
    assert set(results) == {"metadata", "segments", "intervals"}
    direct, _ = loci.locus_breaker(tables[0], hole=30_000, flanks=5_000)
    assert results["segments"].count() == direct.count() > 0
    assert results["segments"].where("S is null or S = 1").isEmpty()
    written = write_export(results, f"{tmp_path}/loc", "parquet")
    assert set(written) == {"metadata", "segments", "intervals"}
    assert spark.read.parquet(written["intervals"]).count() == results["intervals"].count()


def test_export_regions(spark, tables, tmp_path):
    listed = spark.createDataFrame([(1, 1, 300_000), (2, 200_000, 500_000), (9, 1, 5)], "CHR int, START int, END int")
    results = export(*tables, TEMPLATE, region_list=listed, pvalue_filt=10.0)
    assert set(results) == {"metadata", "result", "pvalue_filt"}
    assert results["pvalue_filt"].count() == 8
    written = write_export(results, f"{tmp_path}/reg", "csv")
    assert spark.read.csv(written["pvalue_filt"], header=True).count() == 8
    nothing = export(*tables, TEMPLATE, region_list=listed.where("CHR = 9"), pvalue_filt=10.0)
    assert set(write_export(nothing, f"{tmp_path}/none", "csv")) == {"metadata", "result"}


def test_export_leads(spark, tables, tmp_path):
    snps = spark.createDataFrame([("P1", 1, 101_000, "A", "G"), ("p2", 2, 5, "C", "T"), ("zz", 1, 5, "A", "C")],
                                 "SOURCE_ID string, CHR int, POS int, EA string, NEA string")
    template = {"trait": [{"desc": "P1"}, {"desc": "p2"}, {"desc": "zz"}]}
    results = export(*tables, template, trait_snps=snps)
    got = results["result"].collect()
    assert sorted(r["SOURCEID_SNP"] for r in got) == ["P1:1:101000:A:G", "p2:2:5:C:T"]
    assert sorted(r["meta_link_id"] for r in got) == ["P1", "p2"]
    bare = export(*tables, template, trait_snps=snps, skip_meta=True)["result"]
    assert bare.count() == 2 and "meta_link_id" not in bare.columns
    written = write_export(results, f"{tmp_path}/lead", "parquet")
    assert spark.read.parquet(written["result"]).count() == 2


def test_export_meta_analysis(spark, tables, tmp_path):
    results = export(*tables, TEMPLATE, meta_analysis=True)
    variants = {s: {(r["CHR"], r["POS"], r["EA"], r["NEA"]) for i in seeds for r in some_rows(i)} for s, seeds in {"study_one": (1, 2), "other": (3, 4)}.items()}
    got = {r["study"]: r["count"] for r in results["meta_analysis"].groupBy("study").count().collect()}
    assert got == {s: len(v) for s, v in variants.items()}
    written = write_export(results, f"{tmp_path}/ma", "parquet")
    assert spark.read.parquet(written["meta_analysis"]).count() == sum(got.values())


def test_export_plot_table(tables):
    assert export(*tables, TEMPLATE, plot_out=True)["manhattan"].count() == 320


def test_nothing_matches(tables, tmp_path):
    results = export(*tables, {"project": "none"})
    assert results["metadata"].isEmpty() and results["result"].isEmpty()


def test_odd_and_relative_paths(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    write_gz(tmp_path / "in" / "a b+c%41.tsv.gz", some_rows(8))
    write_gz(tmp_path / "plain.tsv.gz", some_rows(9))
    listed = spark.createDataFrame([("p", "s", "GWAS", f"{tmp_path}/in/a b+c%41.tsv.gz"), ("p", "s", "GWAS", "./in/../plain.tsv.gz")],
                                   "project string, study string, category string, file_path string")
    assert ingest(listed, f"{tmp_path}/t", f"{tmp_path}/c") is None
    counts = [r["count"] for r in read_table(spark, f"{tmp_path}/t").groupBy("TRAITID").count().collect()]
    assert counts == [80, 80]


def test_stored_files_are_sorted_and_split(spark, tmp_path):
    """Rows of a written file follow project, study, CHR, TRAITID, POS, also when one position holds a third of them."""
    rng = random.Random(10)
    rows = [("p", rng.choice(["s", "s2"]), rng.choice([1, 2, 3]), rng.choice(["t", "u"]), rng.randint(1, 10_000), float(i)) for i in range(4_000)]
    rows += [("p", "s", 1, "t", 77, float(i)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "project string, study string, CHR int, TRAITID string, POS int, BETA double").repartition(4)
    with_small_parts = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    for name, value in with_small_parts.items():
        spark.conf.set(name, value)
    try:
        sinks.append_sumstats(df, f"{tmp_path}/t")
    finally:
        for name in with_small_parts:
            spark.conf.unset(name)
    files = list((tmp_path / "t").rglob("*.parquet"))
    stored, hot = [], 0
    for path in files:
        part = spark.read.parquet(str(path)).collect()
        key = [(r["CHR"], r["TRAITID"], r["POS"]) for r in part]
        assert key == sorted(key)
        hot += any(k == (1, "t", 77) for k in key)
        stored += part
    assert len(stored) == 6_000 and hot > 1


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_an_empty_partitioned_result_keeps_its_columns(spark, tmp_path, file_format):
    df = spark.createDataFrame([(1, "a")], "x int, y string").where("x > 5")
    target = sinks.write_result(df, f"{tmp_path}/o", file_format, ("y",))
    back = spark.read.parquet(target) if file_format == "parquet" else spark.read.csv(target, header=True)
    assert back.columns == ["x", "y"] and back.isEmpty()


def _rows(spark, n=3):
    return spark.createDataFrame([(1, 10 + i, "A", "C", 0.3, 0.1, 0.5, 2.0) for i in range(n)], "CHR int, POS int, EA string, NEA string, EAF float, SE float, BETA float, MLOG10P float")


def test_absent_and_odd_files_are_named(spark, tmp_path):
    from statloom.sources.sumstats import read_sumstats_files

    _rows(spark).coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    _rows(spark).drop("MLOG10P").coalesce(1).write.parquet(f"{tmp_path}/b.parquet")
    _rows(spark).select("BETA", "MLOG10P", "SE", "EAF", "NEA", "EA", "POS", "CHR").withColumn("N", F.lit(1)).write.parquet(f"{tmp_path}/c.parquet")
    for order in (["a", "b"], ["b", "a"]):
        with pytest.raises(ValueError, match="MLOG10P.*b.parquet"):
            read_sumstats_files(spark, [f"{tmp_path}/{x}.parquet" for x in order])
    with pytest.raises(ValueError, match="nowhere.parquet"):
        read_sumstats_files(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/nowhere.parquet"])
    with pytest.raises(ValueError, match="gone.tsv.gz"):
        read_sumstats_files(spark, [f"{tmp_path}/gone.tsv.gz"])
    both = read_sumstats_files(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/c.parquet"])
    assert both.count() == 6 and both.where("MLOG10P IS NULL").count() == 0


def _manifest(spark, tmp_path, rows_by_name, project="P", study="S"):
    listed = []
    for name, rows in rows_by_name.items():
        rows.coalesce(1).write.csv(f"{tmp_path}/{name}", sep="\t", header=True, compression="gzip")
        listed += [(project, study, "GWAS", str(f)) for f in (tmp_path / name).glob("*.gz")]
    return spark.createDataFrame(listed, "project string, study string, category string, file_path string")


def test_quarantine_counts_each_row_once(spark, tmp_path, caplog):
    from statloom.plans.ingest import ingest, stored_traits
    from statloom.sources.sumstats import read_table

    odd = _rows(spark, 7).withColumn("POS", F.lit(-1))
    files = _manifest(spark, tmp_path, {"one": _rows(spark, 20).unionByName(odd), "two": _rows(spark, 5)})
    files = files.unionByName(spark.createDataFrame([("P", "S", "GWAS", f"{tmp_path}/lost{i}.gz") for i in range(30)], files.schema))
    with caplog.at_level("WARNING"):
        left = ingest(files, f"{tmp_path}/table", f"{tmp_path}/catalog")
    said = caplog.text
    assert left.count() == 7 and "7 rows lie outside" in said
    assert "30 files that do not exist" in said and all(f"lost{i}.gz" in said for i in range(30))
    table = read_table(spark, f"{tmp_path}/table")
    assert table.count() == 25 and stored_traits(spark, f"{tmp_path}/table").count() == 2
    assert ingest(files, f"{tmp_path}/table", f"{tmp_path}/catalog", dedup=True) is None
    assert read_table(spark, f"{tmp_path}/table").count() == 25
    with pytest.raises(ValueError, match="with p-values"):
        ingest(files, f"{tmp_path}/table", f"{tmp_path}/catalog", what="data", with_pvalue=False)


def test_files_in_several_jobs(spark, tmp_path):
    from statloom.plans.ingest import ingest_sumstats, known_files
    from statloom.sources.sumstats import read_table

    files = known_files(_manifest(spark, tmp_path, {f"f{i}": _rows(spark, 4 + i) for i in range(5)}))
    assert ingest_sumstats(files, f"{tmp_path}/table", files_per_job=2) is None
    assert read_table(spark, f"{tmp_path}/table").count() == 30


def test_stored_changes(spark, tmp_path):
    from statloom.plans.ingest import delete_records, modify_records, read_catalog
    from statloom.schemas import CATALOG_SCHEMA

    names = CATALOG_SCHEMA.names
    rows = [dict.fromkeys(names) | {"project": p, "study": s, "data_id": f"d{i}", "build": "GRCh37"} for p, s in (("a", "x"), ("a", "y=1 z"), ("b", "x")) for i in range(10)]
    path = f"{tmp_path}/catalog"
    sinks.save_catalog(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CATALOG_SCHEMA), path)
    patch = spark.createDataFrame([("a", "x", "d3", "GRCh38"), ("a", "x", "none", "GRCh38"), ("b", "x", "d1", None)], "project string, study string, data_id string, build string")
    assert modify_records(spark, path, patch) == 1
    assert [(r.project, r.data_id) for r in read_catalog(spark, path).where("build = 'GRCh38'").collect()] == [("a", "d3")]
    stored = read_catalog(spark, path)
    assert delete_records(spark, path, stored.where("study = 'y=1 z' OR (project = 'b' AND data_id < 'd5')")) == 15
    left = read_catalog(spark, path)
    assert left.count() == 15 and left.where("study = 'y=1 z'").isEmpty()
    assert delete_records(spark, path, left) == 15


def test_shared_folder_is_needed_off_local(spark, monkeypatch):
    from statloom import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere())


def test_scratch_goes_on_request(spark, monkeypatch):
    from statloom import session

    monkeypatch.setattr(session, "_handed_out", {})
    df = session.cut_lineage(spark.range(5), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(path) and session.drop_scratch(spark) == 1 and not os.path.isdir(path)


def test_object_store_schemes():
    from statloom.sources.files import SCHEMES, location

    assert location("s3a://bucket/key") == "s3a://bucket/key" and SCHEMES["s3a"] == "s3"


def test_listed_trait_snps_are_written_packed_in_bounded_files(spark, tmp_path, monkeypatch):
    from statloom.plans import queries, views

    rows = spark.range(50).repartition(2).selectExpr("concat('t', id % 3) TRAITID", "cast(1 + id % 22 as int) CHR", "cast(id as int) POS", "'A' EA", "if(id % 2 = 0, 'C', null) NEA")
    path = f"{tmp_path}/listed"
    monkeypatch.setattr(views, "sumstats_dense", lambda spark, sf: rows)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: path)
    monkeypatch.setattr(queries, "LISTED_ROWS", 10)
    got = queries.read_trait_snps(spark, "none")
    assert sorted((r.SOURCE_ID, r.CHR, r.POS, r.EA, r.NEA) if r.NEA else (r.SOURCE_ID, r.CHR, r.POS, r.EA, "") for r in got.collect()) == sorted(
        (r.TRAITID, r.CHR, r.POS, r.EA, r.NEA or "") for r in rows.collect())
    files = [f.name for f in Path(path).glob("part-*")]
    assert len(files) >= 5 and all(f.endswith(".csv.gz") for f in files)
