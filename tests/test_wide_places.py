"""Queries on keys so large that places, which follow from them, exceed 32-bit numbers; the SQL with 64-bit numbers says what is right."""

import pytest

import __spark_entry__ as entry
from statloom.operators import joins, regions, slices
from statloom.plans import views
from statloom.sources.sinks import store_sumstats
from statloom.sources.sumstats import cast_sumstats, read_peaks, read_table
from tests.oracle_check import differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()
WIDE = """aligned_effects cast_sumstats chromosome_envelope cis_trans_flanks clip_low exact_snp_lookup full_stats gap_cluster_id group_slice
grouped_meta heterogeneity_i2 ivw_meta lead_snp_search locus_breaker locus_breaker_by_study locus_intervals locus_name locus_segments maf_filter
manhattan_bins manhattan_table meta_export meta_full_outer meta_full_outer_all position_gap position_points read_regions_bed read_sumstats_parquet
read_sumstats_tsv read_trait_snps region_flags region_pvalue_filter region_semi_join region_semi_join_overlapping snp_semi_join top1_per_window
trait_link_join write_partitioned_by_trait write_result""".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Six suppliers, two of them far beyond the others, and 600 lines on parts from 0 to 3,432,000."""
    import duckdb

    at, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    # parts that lie in the regions of suppliers, and one in that of the last part
    near = [((start // 50_000) + 1) * 22 + k % 22 for k, start in [*((k, k * 45_000) for k in (3, 4, 5, 47721, 60001, 60003)), (2599999, 2599999 * 3_000)]]
    made = {
        "region": "SELECT i::INTEGER AS r_regionkey, ['ASIA', 'EUROPE'][i + 1] AS r_name FROM range(2) t(i)",
        "nation": "SELECT i::INTEGER AS n_nationkey, 'NATION_' || (16 + i) AS n_name, (1 - i % 2)::INTEGER AS n_regionkey FROM range(3) t(i)",
        "supplier": """SELECT k::BIGINT AS s_suppkey, 'Supplier ' || k AS s_name, (k % 3)::INTEGER AS s_nationkey, 5000.5 + k % 7 AS s_acctbal
            FROM (SELECT unnest([3, 4, 5, 47721, 60001, 60003]) AS k)""",
        "part": """SELECT k::BIGINT AS p_partkey, ['blue gear', 'red bolt'][(k % 2 + 1)::INTEGER] AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type,
            (1 + k % 5)::INTEGER AS p_size, 900.0 + k % 10 AS p_retailprice
            FROM (SELECT unnest([3, 4, 5, 47721, 60001, 60003, 715820, 900000, 1200000, 2599999]) AS k)""",
        "customer": "SELECT (i * 22000)::BIGINT AS c_custkey, 'c' || i AS c_name, 1::INTEGER AS c_nationkey, 1.0 AS c_acctbal, 'x' AS c_mktsegment FROM range(60) t(i)",
        "lineitem": f"""SELECT i::BIGINT AS l_orderkey, CASE WHEN i % 3 = 0 THEN i * 4400 WHEN i % 3 = 1 THEN 2599999 - i % 90 WHEN i % 2 = 0 THEN {near}[(i // 6 % 7 + 1)::INTEGER]
                ELSE (i % 60 * 1000000 + 1) % 2600000 END::BIGINT AS l_partkey,
            [3, 4, 5, 47721, 60001, 60003][(i // 3 % 6 + 1)::INTEGER]::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, (i * 7 % 51)::DOUBLE AS l_quantity,
            (30000 + i * 7919 % 65000)::DOUBLE AS l_extendedprice, (i % 11) / 100.0 AS l_discount, (i % 9) / 100.0 AS l_tax FROM range(600) t(i)""",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
    return str(at), con


@pytest.mark.parametrize("name", WIDE)
def test_wide_places(spark, tables, name):
    sf_dir, con = tables
    sql = SQL[name].replace("AS INTEGER)", "AS BIGINT)")
    assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0
    assert differences(QUERIES[name](spark, sf_dir), sql, con) is None


def test_place_type(spark):
    assert views.place_type(spark.createDataFrame([(5,), (None,)], "k bigint"), views.F.col("k")) == "int"
    assert views.place_type(spark.createDataFrame([], "k bigint"), views.F.col("k")) == "int"
    assert views.place_type(spark.createDataFrame([(5,), (2**31,)], "k bigint"), views.F.col("k")) == "bigint"


def test_cast_sumstats_refuses_or_holds_wide_places(spark):
    text = spark.createDataFrame([("1", str(2**31), "A", "C", "0.5", "0.1", "0.2", "3")], "CHR string, POS string, EA string, NEA string, EAF string, SE string, BETA string, MLOG10P string")
    with pytest.raises(Exception, match="int|INT"):
        cast_sumstats(text).collect()
    wide = cast_sumstats(text, place="bigint")
    assert dict(wide.dtypes)["POS"] == "bigint" and wide.first().POS == 2**31


def test_ranges_beyond_the_domain_are_not_pruned(spark):
    places = [10, 249_999_999, 250_500_000, 251_000_000, 900_000_000, 3_000_000_000]
    rows = spark.createDataFrame([("t", 1, p) for p in places], "TRAITID string, CHR int, POS bigint")
    listed = spark.createDataFrame([(1, 249_999_990, 250_999_999), (1, 899_999_999, 900_000_001), (1, 2_999_999_999, 3_000_000_000)], "CHR int, START bigint, END bigint")
    seen = joins.profile_ranges(listed, "START", "END", 100_000)
    assert sorted(r.POS for r in rows.where(seen.nearby()).collect()) == [249_999_999, 250_500_000, 251_000_000, 900_000_000, 3_000_000_000]
    assert sorted(r.POS for r in regions.region_semi_join(rows, listed).collect()) == [249_999_999, 250_500_000, 900_000_000, 3_000_000_000]
    assert slices.at_positions(rows, rows.select("CHR", "POS")).count() == len(places)


def test_peaks_of_wide_places(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, p, "A", "C", 0.1, 0.1, 0.5, 9.0) for p in (5, 3_000_000_000)],
                                 "TRAITID string, CHR int, POS bigint, EA string, NEA string, BETA double, SE double, EAF double, MLOG10P double")
    store_sumstats(rows, f"{tmp_path}/t")
    assert sorted(r.top_at for r in read_peaks(spark, f"{tmp_path}/t").collect()) == [5, 3_000_000_000]
    assert read_table(spark, f"{tmp_path}/t").count() == 2
