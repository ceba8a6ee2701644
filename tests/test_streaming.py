from statloom.plans.ingest import read_catalog
from statloom.sources.sumstats import read_table
from statloom.streaming.manifests import follow_manifests
from tests.test_files import some_rows, write_gz

HEAD = ["project", "study", "category", "file_path", "trait_desc"]


def drop_manifest(folder, name, path, desc):
    (folder / name).write_text("\t".join(HEAD) + "\n" + "\t".join(["p", "s", "GWAS", path, desc]) + "\n")


def test_only_new_manifests_are_ingested(spark, tmp_path):
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    paths = [write_gz(tmp_path / f"{n}.tsv.gz", some_rows(n)) for n in (1, 2)]
    args = (spark, str(arriving), HEAD, f"{tmp_path}/table", f"{tmp_path}/catalog", f"{tmp_path}/progress")
    drop_manifest(arriving, "one.tsv", paths[0], "first")
    follow_manifests(*args).awaitTermination()
    assert read_table(spark, args[3]).count() == 80
    drop_manifest(arriving, "two.tsv", paths[1], "second")
    drop_manifest(arriving, "again.tsv", paths[0], "renamed")
    follow_manifests(*args).awaitTermination()
    follow_manifests(*args).awaitTermination()
    assert read_table(spark, args[3]).count() == 160
    assert sorted(r["trait"]["desc"] for r in read_catalog(spark, args[4]).collect()) == ["renamed", "second"]
