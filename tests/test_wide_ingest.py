"""Files whose positions exceed 32-bit numbers, through the manifest into the table and back."""

import pytest

from statloom.operators import slices
from statloom.plans import ingest as ingesting
from statloom.sources.sumstats import read_table
from tests.oracle_check import differences
from tests.test_wide_places import QUERIES, SQL, tables  # noqa: F401


def test_ingest_sumstats_of_wide_places(spark, tables):  # noqa: F811
    sf_dir, con = tables
    sql = SQL["ingest_sumstats"].replace("AS INTEGER)", "AS BIGINT)")
    assert con.execute(f"SELECT count(*) FROM ({sql}) WHERE POS > 2147483647").fetchone()[0] > 0
    assert differences(QUERIES["ingest_sumstats"](spark, sf_dir), sql, con) is None


def listed(spark, tmp_path, name, places):
    rows = spark.createDataFrame([(1, p, "A", "C", 0.5, 0.1, 0.2, 3.0) for p in places], "CHR int, POS bigint, EA string, NEA string, EAF double, SE double, BETA double, MLOG10P double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    file = next((tmp_path / name).glob("*.parquet"))
    return spark.createDataFrame([("p", name, "GWAS", str(file))], "project string, study string, category string, file_path string")


def test_places_of_an_ingest(spark, tmp_path):
    wide, narrow = [0, 5, 250_000_001, 3_000_000_000], [0, 5, 250_000_001]
    bad = ingesting.ingest(listed(spark, tmp_path, "w", wide), f"{tmp_path}/t", f"{tmp_path}/c", place="bigint")
    assert [r.POS for r in bad.collect()] == [0]
    assert sorted(r.POS for r in read_table(spark, f"{tmp_path}/t").collect()) == wide[1:]
    bad = ingesting.ingest(listed(spark, tmp_path, "n", narrow), f"{tmp_path}/t2", f"{tmp_path}/c2")
    assert sorted(r.POS for r in bad.collect()) == [0, 250_000_001]
    assert [(r.POS, str(read_table(spark, f"{tmp_path}/t2").schema["POS"].dataType)) for r in read_table(spark, f"{tmp_path}/t2").collect()] == [(5, "IntegerType()")]
    with pytest.raises(ValueError, match="holds places as int"):
        ingesting.ingest(listed(spark, tmp_path, "v", wide), f"{tmp_path}/t2", f"{tmp_path}/c2", place="bigint")
    assert sorted(r.POS for r in read_table(spark, f"{tmp_path}/t2").collect()) == [5]


def test_validate_sumstats_without_a_last_place(spark):
    rows = spark.createDataFrame([("t", 1, p) for p in (None, 0, 1, 250_000_001)], "TRAITID string, CHR int, POS bigint")
    assert [r.valid for r in slices.validate_sumstats(rows).collect()] == [False, False, True, False]
    assert [r.valid for r in slices.validate_sumstats(rows, None).collect()] == [False, False, True, True]
