"""Registered queries: one per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import normal, text, variants
from statloom.operators import catalog as cat
from statloom.operators import leads, loci, meta, regions, slices, summaries
from statloom.plans import export as exporting
from statloom.plans import ingest as ingesting
from statloom.plans import views
from statloom.schemas import BUCKET
from statloom.session import scratch_path
from statloom.sources import manifest as manifests
from statloom.sources import sinks
from statloom.sources import sumstats as sumstats_files
from statloom.sources.files import location_column

Query = Callable[[SparkSession, str], DataFrame]

REGION_THRESHOLD = 8.0
#: Rows that a file of a written list has at most.
LISTED_ROWS = 2_000_000
TEMPLATE = {
    "category": "gwas",
    "build": "grch37",
    "trait": [{"desc": "RED"}, {"desc": "bolt"}],
    "output": ["build", "population", "notes_consortium", "total_samples", "trait_desc"],
}
LINKS = {"trait": [{"protein_ids": v} for v in ("ECONOMY", "SMALL", "Brand#1", "Brand#2")]}


def _place_of(df: DataFrame, name: str = "POS") -> str:
    return dict(df.dtypes)[name]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- scans and checks


def cast_sumstats(spark, sf):
    from statloom.sources.sumstats import cast_sumstats as cast

    raw = views.sumstats(spark, sf)
    as_text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    done = cast(as_text, place=_place_of(raw))
    floats = ("BETA", "SE", "EAF", "MLOG10P")
    return done.select(
        "TRAITID", *[F.round(F.col(c).cast("double"), 4).alias(c) if c in floats else F.col(c) for c in done.columns if c != "TRAITID"]
    )


def content_id(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", text.short_hash(F.col("doc_id").cast("string")).alias("id"),
                       text.file_hash(F.col("source"), F.col("text")).alias("file_id"))


def read_regions_bed(spark, sf):
    from statloom.sources.regions import read_regions

    named = F.concat(F.element_at(F.array(F.lit("chr"), F.lit("CHR"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int")),
                     F.element_at(F.array(F.lit("X"), F.lit("y"), F.lit("M"), F.lit("7"), F.lit("12"), F.lit("_alt")),
                                  (F.col("s_suppkey") % 6 + 1).cast("int")))
    suppliers, end = views.table(spark, sf, "supplier"), F.col("s_suppkey") * 45000 + 10
    raw = suppliers.select(named.alias("CHR"), (F.col("s_suppkey") * 45000).cast("string").alias("START"), end.cast("string").alias("END"))
    path = scratch_path(spark, "regions")
    raw.write.csv(path, sep="\t")
    return read_regions(spark, path, views.place_type(suppliers, end))


def read_snp_list(spark, sf):
    from statloom.sources.regions import read_regions

    raw = views.table(spark, sf, "customer").select(
        F.concat(F.lit("chr"), (F.col("c_custkey") % 30).cast("string")).alias("CHR"), F.col("c_custkey").cast("string").alias("POS")
    )
    path = scratch_path(spark, "points")
    raw.write.csv(path, header=True)
    return read_regions(spark, path)


def read_trait_snps(spark, sf):
    from statloom.sources.regions import load_trait_snps

    dense = views.sumstats_dense(spark, sf)
    raw = dense.select(F.col("TRAITID").alias("SOURCE_ID"), F.concat(F.lit("chr"), F.col("CHR").cast("string")).alias("CHR"),
                       "POS", "EA", "NEA")
    path = scratch_path(spark, "trait-snps")
    # a gzip file is read by one task, so files are bounded
    raw.write.option("maxRecordsPerFile", LISTED_ROWS).csv(path, header=True, compression="gzip")
    return load_trait_snps(spark, path, _place_of(raw))


def validate_sumstats(spark, sf):
    moved = views.sumstats(spark, sf).withColumn("CHR", F.col("CHR") + 4).withColumn("POS", F.col("POS") - 1)
    return slices.validate_sumstats(moved).groupBy("CHR", "valid").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- stored and read back


def _file_list(spark, path):
    return [unquote(f) for f in spark.read.format("binaryFile").load(path).inputFiles()]


def _shown(df):
    """Stored 32-bit numbers as rounded doubles."""
    floats = [c for c, t in df.dtypes if t == "float"]
    return df.select(*[F.round(F.col(c).cast("double"), 4).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    views.manifest(spark, sf).write.csv(path, sep="\t", header=True)
    return manifests.read_manifest(spark, path)


def read_sumstats_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    rows = views.sumstats(spark, sf).withColumn("N", F.lit(5))
    rows.select("N", "SE", "BETA", "POS", "CHR", "NEA", "EA", "EAF", "MLOG10P").write.csv(path, sep="\t", header=True, compression="gzip")
    files = [f for f in _file_list(spark, path) if f.endswith(".gz")]
    return _shown(sumstats_files.read_sumstats_files(spark, files, place=_place_of(rows)).drop("file_path"))


def read_sumstats_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    rows = views.sumstats(spark, sf)
    rows.write.parquet(path)
    files = [f for f in _file_list(spark, path) if f.endswith(".parquet")]
    return _shown(sumstats_files.read_sumstats_files(spark, files, place=_place_of(rows)).drop("file_path"))


def ingest_sumstats(spark, sf):
    """One gzip file per study (a made-up trait each), through the manifest into the table and back.

    A trait's id is a hash of file bytes, which no SQL can see; it is compared by what it
    must be: one id for each study, as the ledger and the catalog have it.
    """
    path = scratch_path(spark, "ingest")
    rows = views.sumstats_by_study(spark, sf).repartition("project", "study")
    place = _place_of(rows)
    rows.drop("TRAITID").write.partitionBy("project", "study").csv(f"{path}/in", sep="\t", header=True, compression="gzip")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/in").select(
        location_column(F.col("_metadata.file_path")).alias("file_path"))
    rows = listed.select(
        F.regexp_extract("file_path", "project=([^/]+)", 1).alias("project"), F.regexp_extract("file_path", "study=([^/]+)", 1).alias("study"),
        F.lit("GWAS").alias("category"), "file_path")
    ingesting.ingest(rows, f"{path}/table", f"{path}/catalog", place=place)
    stored = _shown(sumstats_files.read_table(spark, f"{path}/table")).drop(BUCKET)
    ledger = ingesting.stored_traits(spark, f"{path}/table")
    records = ingesting.read_catalog(spark, f"{path}/catalog").select("project", "study", F.col("data_id").alias("TRAITID"))
    once = ledger.intersect(records).groupBy("project", "study").agg(F.count(F.lit(1)).alias("n"), F.max("TRAITID").alias("own"))
    known = stored.join(once, ["project", "study"]).withColumn("trait_known", (F.col("n") == 1) & (F.col("TRAITID") == F.col("own")))
    return known.drop("TRAITID", "n", "own")


def ingest_metadata(spark, sf):
    path = scratch_path(spark, "catalog")
    rows = views.manifest(spark, sf)
    ingesting.ingest_metadata(rows, path)
    ingesting.ingest_metadata(rows.where(F.col("category") == "pQTL").withColumn("trait_desc", F.upper("trait_desc")), path)
    return cat.project_catalog(ingesting.read_catalog(spark, path), ["project", "study", "data_id", "category", "trait_desc", "total_samples"])


def natural_order(spark, sf):
    """Rows of every stored file that do not follow the one before in CHR, TRAITID, POS order."""
    path = scratch_path(spark, "ordered")
    sinks.append_sumstats(views.sumstats_by_study(spark, sf), path)
    key = F.struct("CHR", "TRAITID", "POS")
    along = Window.partitionBy("file").orderBy("row")
    stored = sumstats_files.read_table(spark, path).select(
        "project", "study", key.alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    checked = stored.withColumn("early", F.col("key") < F.lag("key").over(along))
    return checked.groupBy("project", "study").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("early").alias("n_early"))


def natural_order_compacted(spark, sf):
    """The rows stored in three batches, then merged: rows per partition, and files that overlap the one before in natural order."""
    path = scratch_path(spark, "batches")
    rows = views.sumstats_by_study(spark, sf)
    for i in range(3):
        sinks.store_sumstats(rows.where(F.pmod(F.xxhash64("CHR", "POS"), F.lit(3)) == i), path)
    sinks.compact_sumstats(spark, path, file_bytes=1_000_000)
    key = F.struct("CHR", "TRAITID", "POS")
    files = sumstats_files.read_table(spark, path).groupBy("project", "study", BUCKET, F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    along = Window.partitionBy("project", "study", BUCKET).orderBy("low", "high")
    checked = files.withColumn("early", F.col("low") < F.lag("high").over(along))
    return checked.groupBy("project", "study").agg(F.sum("n").alias("n_rows"), F.count_if("early").alias("n_early"))


def write_result(spark, sf):
    target = sinks.write_result(views.sumstats(spark, sf), scratch_path(spark, "result"), "csv.gz")
    return spark.read.csv(target, header=True, schema=views.sumstats(spark, sf).schema)


def multi_trait_export(spark, sf):
    template = {"category": "pQTL", "trait": [{"desc": "red"}]}
    results = exporting.export(views.stored_by_study(spark, sf), views.catalog(spark, sf), template, pvalue_thr=6.0, attributes="BETA,MLOG10P")
    written = exporting.write_export(results, scratch_path(spark, "export") + "/out", "parquet")
    return spark.read.parquet(written["result"]).select("SNPID", "TRAITID", "BETA", "MLOG10P", "meta_category", "output_prefix")


def write_partitioned_by_trait(spark, sf):
    segments, _ = loci.locus_breaker(views.sumstats_by_study(spark, sf), maf=0.1)
    names = cat.output_prefix(views.catalog(spark, sf).select("project", "study", "data_id"), "out")
    target = sinks.write_partitioned_by_trait(segments, names, scratch_path(spark, "segments"), "parquet")
    return spark.read.parquet(target).groupBy("output_prefix").agg(F.count(F.lit(1)).alias("n_loci"))


def write_metadata_sidecar(spark, sf):
    found = cat.meta_query(views.catalog(spark, sf), {"category": "GWAS", "output": ["build", "trait_desc", "total_samples"]})
    target = sinks.write_metadata_sidecar(found, scratch_path(spark, "sidecar"))
    return spark.read.csv(target, header=True, schema=found.schema)


# ---------------------------------------------------------------- slices


def select_attributes(spark, sf):
    return slices.select_attributes(views.sumstats(spark, sf), "BETA,SE")


def mlog10p_fallback(spark, sf):
    stored = slices.select_attributes(views.sumstats_without_p(spark, sf), "BETA,SE,EA,NEA,MLOG10P")
    return _rounded(slices.with_mlog10p(stored), "MLOG10P")


def trait_slice(spark, sf):
    chosen = cat.search_catalog(views.catalog(spark, sf), {"category": "pqtl"})
    return slices.in_traits(views.stored_sumstats(spark, sf), chosen)


def position_points(spark, sf):
    points = views.snp_list(spark, sf).select("CHR", F.col("START").alias("POS"))
    return slices.at_positions(views.sumstats(spark, sf), points)


def position_range(spark, sf):
    return slices.in_range(views.sumstats(spark, sf), 7, 0, 2_000_000)


def pvalue_threshold(spark, sf):
    return slices.over_threshold(views.sumstats(spark, sf), 7.3)


def maf_filter(spark, sf):
    return slices.maf_between(views.sumstats(spark, sf), 0.1)


def process_result(spark, sf):
    return _rounded(slices.as_result(views.sumstats_without_p(spark, sf), keep_trait=False), "MLOG10P")


def full_stats(spark, sf):
    found = cat.search_catalog(views.catalog(spark, sf), {"category": "GWAS", "trait": [{"desc": "red"}, {"desc": "bolt"}]})
    rows = slices.full_stats(views.stored_by_study(spark, sf), found, 5.0, "BETA,SE,MLOG10P")
    fields = cat.project_catalog(found, ["project", "study", "category", "data_id", "notes_source_id", "trait_desc"])
    return cat.metadata_broadcast(rows, fields)


def group_slice(spark, sf):
    return slices.in_group(views.sumstats_by_study(spark, sf), "asia", "nation_17")


# ---------------------------------------------------------------- regions


def snp_semi_join(spark, sf):
    return regions.snp_semi_join(views.sumstats(spark, sf), views.snp_list(spark, sf), 3.0)


def region_semi_join(spark, sf):
    return regions.region_semi_join(views.sumstats(spark, sf), views.regions(spark, sf))


def region_semi_join_overlapping(spark, sf):
    return regions.region_semi_join(views.sumstats(spark, sf), views.overlapping_regions(spark, sf))


def region_pvalue_filter(spark, sf):
    return regions.region_pvalue_filter(views.sumstats(spark, sf), views.regions(spark, sf), REGION_THRESHOLD, peaks=views.sumstats_peaks(spark, sf))


def region_flags(spark, sf):
    return regions.region_flags(views.sumstats(spark, sf), views.regions(spark, sf), REGION_THRESHOLD, peaks=views.sumstats_peaks(spark, sf))


def chromosome_envelope(spark, sf):
    return regions.chromosome_envelope(views.regions(spark, sf))


# ---------------------------------------------------------------- lead SNPs


def lead_snp_search(spark, sf):
    found = leads.lead_snp_search(views.sumstats(spark, sf), views.trait_snps(spark, sf), 120_000, 400_000)
    return found


def lead_tiebreak(spark, sf):
    listed = views.trait_snps(spark, sf, "sumstats_dense")
    return leads.lead_snp_search(views.sumstats_dense(spark, sf), listed, 120_000, 400_000).select(
        "TRAITID", "SOURCEID_SNP", "SNPID_LEAD", "MLOG10P_LEAD"
    )


def exact_snp_lookup(spark, sf):
    found = leads.exact_snp_lookup(views.sumstats(spark, sf), views.trait_snps(spark, sf))
    return found.select("TRAITID", "CHR", "POS", "EA", "NEA", (-F.col("exact.rank")).alias("MLOG10P"), F.col("exact.BETA").alias("BETA"))


def cis_trans_flanks(spark, sf):
    listed = leads.with_window(views.trait_snps(spark, sf), 500_000, 750_000)
    return listed.select("TRAITID", "CHR", "POS", "EA", "NEA", "START", "END")


def trait_link_join(spark, sf):
    linked = _linked(spark, sf).select("project", "study", "data_id", F.col("link_id"))
    sources = views.regions(spark, sf).select(
        F.element_at(F.array(*[F.lit(v) for v in ("ECONOMY", "SMALL", "Brand#1", "Brand#2", "absent")]), (F.col("CHR") % 5 + 1)).alias("SOURCE_ID"),
        "CHR", F.col("START").alias("POS"), F.lit("A").alias("EA"), F.lit("C").alias("NEA"))
    return leads.link_traits(sources, linked)


def top1_per_window(spark, sf):
    windows = leads.with_window(views.trait_snps(spark, sf, "sumstats_dense"), 250_000, 250_000)
    best = leads.best_in_windows(views.sumstats_dense(spark, sf), windows, 50_000)
    return best.select("TRAITID", "CHR", "START", "END", F.col("lead.POS").alias("POS"), F.col("lead.EA").alias("EA"), (-F.col("lead.rank")).alias("MLOG10P"))


# ---------------------------------------------------------------- loci


def position_gap(spark, sf):
    return loci.position_gap(views.sumstats_dense(spark, sf), 250_000)


def gap_cluster_id(spark, sf):
    rows = slices.over_threshold(views.sumstats(spark, sf), 3.3)
    return loci.gap_cluster_id(rows, 250_000).select("TRAITID", "CHR", "POS", "EA", "NEA", "cluster")


def best_in_cluster(spark, sf):
    rows = slices.over_threshold(views.sumstats_dense(spark, sf), 3.3)
    return loci.best_in_cluster(rows, 200_000).select("TRAITID", "CHR", "cluster", "POS", "EA", "NEA", "MLOG10P")


def _candidates(spark, sf):
    return loci.locus_candidates(views.sumstats(spark, sf), maf=0.1)


def locus_segments(spark, sf):
    return loci.locus_segments(_candidates(spark, sf)).drop("S")


def locus_intervals(spark, sf):
    kept = _candidates(spark, sf)
    segments = loci.locus_segments(kept, flanks=300_000)
    found = loci.locus_intervals(kept, segments, flanks=300_000)
    return found.select("locus", "TRAITID", "SNPID", "CHR", "POS", "MLOG10P")


def locus_breaker(spark, sf):
    segments, intervals = loci.locus_breaker(views.sumstats(spark, sf), maf=0.1)
    sizes = intervals.groupBy("TRAITID", "locus").agg(F.count(F.lit(1)).alias("n_snps"))
    return segments.join(sizes, ["TRAITID", "locus"]).select(
        "TRAITID", "CHR", "locus", "locus_start", "locus_end", "SNPID", "snp_MLOG10P", "n_snps"
    )


def locus_breaker_by_study(spark, sf):
    segments, _ = loci.locus_breaker(views.sumstats_by_study(spark, sf), maf=0.1, hole=100_000)
    return segments.groupBy("project", "study").agg(
        F.count(F.lit(1)).alias("n_loci"), F.max("snp_MLOG10P").alias("top"), F.max("locus_end").alias("last_end")
    )


# ---------------------------------------------------------------- meta-analysis


def ivw_meta(spark, sf):
    pooled = meta.ivw_meta(views.sumstats(spark, sf), unique=True)
    return _rounded(pooled, "BETA", "SE").select("SNP", "BETA", "SE", "n_traits")


def heterogeneity_i2(spark, sf):
    pooled = meta.ivw_meta(views.sumstats(spark, sf), unique=True)
    return pooled.select("SNP", F.round("I_SQUARED", 6).alias("I_SQUARED"))


def meta_z_p(spark, sf):
    done = meta.meta_analysis(views.sumstats_by_study(spark, sf), views.catalog(spark, sf), unique=True)
    return _rounded(done, "BETA", "SE", "P", "Z_SCORE").withColumn("I_SQUARED", F.round("I_SQUARED", 6))


def grouped_meta(spark, sf):
    done = meta.meta_analysis(views.sumstats_by_study(spark, sf), views.catalog(spark, sf), unique=True, labels=False)
    return done.groupBy("project", "study").agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(F.col("P") < 0.05).alias("n_nominal"), F.round(F.max("BETA"), 6).alias("max_beta")
    )


def meta_export(spark, sf):
    """The meta-analysis as `export` runs it, copies looked for, labels kept once per study."""
    results = exporting.export(views.stored_by_study(spark, sf), views.catalog(spark, sf), {"category": "GWAS"}, meta_analysis=True)
    done = results["meta_analysis"].join(results["meta_labels"].select("project", "study", F.length("TRAITID").alias("label_length")), ["project", "study"])
    return _rounded(done, "BETA", "SE").select("project", "study", "SNP", "BETA", "SE", "n_copies", "label_length")


def meta_full_outer_all(spark, sf):
    """Every trait of the table side by side; summed up again over the lists."""
    named = meta.trait_dictionary(views.catalog(spark, sf).select("data_id"))
    wide = meta.aligned_effects(views.sumstats(spark, sf), named)
    total = F.aggregate("betas", F.lit(0.0), lambda s, b: s + F.coalesce(b, F.lit(0.0)))
    return wide.select("SNP", F.size("ordinals").alias("n_traits"), F.round(total, 6).alias("sum_beta"))


def aligned_effects(spark, sf):
    """Which trait has which effect, unfolded again from the lists."""
    named = meta.trait_dictionary(views.catalog(spark, sf))
    wide = meta.aligned_effects(views.sumstats_by_study(spark, sf), named)
    cells = F.explode(F.arrays_zip("ordinals", "betas", "ses")).alias("c")
    return wide.select("project", "study", "SNP", cells).select("project", "study", "SNP", F.col("c.ordinals").alias("ordinal"), F.col("c.betas").alias("BETA"), F.col("c.ses").alias("SE"))


def meta_with_copies(spark, sf):
    once = views.sumstats(spark, sf)
    pooled = meta.ivw_meta(once.unionByName(once).unionByName(once))
    return _rounded(pooled, "BETA", "SE").select("SNP", "BETA", "SE", "n_traits")


def pooling_report(spark, sf):
    dense = views.sumstats(spark, sf)
    odd = dense.withColumn("SE", F.when(F.col("EAF") > 0.9, F.lit(0.0)).otherwise(F.col("SE")))
    return meta.pooling_report(odd.unionByName(odd))


def meta_full_outer(spark, sf):
    chosen = views.catalog(spark, sf).agg(F.min("data_id").alias("a"), F.max("data_id").alias("b")).first()
    return meta.wide_effects(views.sumstats(spark, sf), [chosen["a"], chosen["b"]])


# ---------------------------------------------------------------- catalog


def _linked(spark, sf):
    found = cat.search_catalog(views.catalog(spark, sf), LINKS)
    fields = cat.project_catalog(found, ["project", "study", "data_id", "notes_source_id", "trait_protein_ids"])
    column, values = cat.link_column(LINKS)
    return cat.link_expand(fields, column, values)


def to_catalog_row(spark, sf):
    rows = views.catalog(spark, sf)
    return rows.select(
        "project", "study", "data_id", "category", "build",
        F.array_join("population", "|").alias("population"), text.json_text(F.col("trait")).alias("trait"),
        text.json_text(F.col("total")).alias("total"), text.json_text(F.col("notes")).alias("notes"),
    )


def validate_catalog(spark, sf):
    rows = views.catalog(spark, sf)
    odd = rows.withColumn("category", F.when(F.col("category") == "eQTL", "mQTL").otherwise(F.col("category"))).withColumn(
        "study", F.when(F.col("build") == "GRCh38", F.repeat(F.col("study"), 50)).otherwise(F.col("study")))
    return cat.validate_catalog(odd).select("data_id", "valid")


def _incoming(spark, sf):
    rows = views.catalog(spark, sf)
    later = F.lit("2030-01-01").cast("timestamp")
    changed = rows.where(F.col("category") == "pQTL").withColumn("build", F.lit("GRCh38")).withColumn("modification_date", later)
    moved = rows.where(F.col("category") == "eQTL").withColumn("project", F.lit("added")).withColumn("modification_date", later)
    older = changed.withColumn("build", F.lit("GRCh37")).withColumn("modification_date", F.lit("2029-01-01").cast("timestamp"))
    return changed.unionByName(moved).unionByName(older)


def catalog_upsert(spark, sf):
    done = cat.catalog_upsert(views.catalog(spark, sf), _incoming(spark, sf))
    return done.select("project", "study", "data_id", "category", "build", F.col("trait")["desc"].alias("trait_desc"))


def catalog_lookup(spark, sf):
    rows = views.catalog(spark, sf)
    keys = rows.select("project", "study", "data_id").unionByName(
        rows.select(F.lit("absent").alias("project"), "study", "data_id"))
    return cat.catalog_existing(rows, keys)


def catalog_modify(spark, sf):
    rows = views.catalog(spark, sf)
    patch = rows.select("project", "study", "data_id",
                        F.when(F.col("category") == "GWAS", "GRCh38").alias("build")).unionByName(
        rows.select(F.lit("absent").alias("project"), "study", "data_id", F.lit("GRCh37").alias("build")))
    return cat.catalog_modify(rows, patch).select("project", "study", "data_id", "build", "updated")


def stored_modify(spark, sf):
    """Changes stored in the catalog and read back."""
    path = scratch_path(spark, "catalog")
    sinks.save_catalog(views.catalog(spark, sf), path)
    rows = ingesting.read_catalog(spark, path)
    patch = rows.where(F.col("category") == "GWAS").select("project", "study", "data_id", F.lit("GRCh38").alias("build"))
    ingesting.modify_records(spark, path, patch)
    return ingesting.read_catalog(spark, path).select("project", "study", "data_id", "build")


def stored_delete(spark, sf):
    """One record in three and all of one project deleted from the stored catalog, partitions and all."""
    path = scratch_path(spark, "catalog")
    sinks.save_catalog(views.catalog(spark, sf), path)
    rows = ingesting.read_catalog(spark, path)
    ingesting.delete_records(spark, path, rows.where((F.col("category") == "eQTL") | (F.col("project") == "asia")))
    return ingesting.read_catalog(spark, path).select("project", "study", "data_id", "category")


def catalog_delete(spark, sf):
    rows = views.catalog(spark, sf)
    gone = cat.search_catalog(rows, {"category": "eqtl"})
    return cat.catalog_delete(rows, gone).select("project", "study", "data_id", "category")


def search_catalog(spark, sf):
    criteria, fields = cat.search_template(TEMPLATE)
    return _as_text(cat.project_catalog(cat.search_catalog(views.catalog(spark, sf), criteria), fields))


def _as_text(df):
    return df.withColumn("population", F.array_join("population", "|")) if "population" in df.columns else df


def search_template(spark, sf):
    template = {"project": "Asia", "study": "Nation_17", "output": ["trait.desc"]}
    return cat.meta_query(views.catalog(spark, sf), template)


def meta_query(spark, sf):
    template = {"notes": [{"consortium": "brand#1"}], "total": [{"samples": 9}], "output": ["notes_consortium", "total_samples"]}
    return cat.meta_query(views.catalog(spark, sf), template)


def scalar_match(spark, sf):
    return cat.search_catalog(views.catalog(spark, sf), {"population": "asia", "build": "grch37"}).select("data_id", "project", "study")


def data_ids_match(spark, sf):
    rows = views.catalog(spark, sf)
    ends = rows.agg(F.min("data_id").alias("a"), F.max("data_id").alias("b")).first()
    return cat.search_catalog(rows, {"data_ids": [ends["a"].upper(), ends["b"], "absent"]}).select("data_id", "project", "study")


def json_match(spark, sf):
    rows = views.catalog(spark, sf)
    criteria = {"trait": [{"desc": "Red Widget"}, {"desc": " blue bolt", "protein_ids": "economy|brand#4"}]}
    exact = cat.search_catalog(rows, criteria, exact_match=True).select("data_id", F.lit("exact").alias("mode"))
    part = cat.search_catalog(rows, {"trait": [{"desc": "re", "protein_ids": "SMALL"}, {"desc": "gear"}]}, case_sensitive=True)
    return exact.unionByName(part.select("data_id", F.lit("part").alias("mode")))


def any_of(spark, sf):
    return cat.search_catalog(views.catalog(spark, sf), {"trait": [{"desc": "red"}, {"desc": "blue"}]}).select("data_id", F.col("trait")["desc"].alias("trait_desc"))


def all_of(spark, sf):
    criteria = {"category": "GWAS", "trait": [{"desc": "red"}], "notes": [{"source_id": "supplier"}]}
    return cat.search_catalog(views.catalog(spark, sf), criteria).select("data_id", F.col("trait")["desc"].alias("trait_desc"))


def distinct_by_id(spark, sf):
    criteria = {"trait": [{"desc": "e"}, {"desc": "r"}, {"protein_ids": "brand"}]}
    found = cat.search_catalog(views.catalog(spark, sf), criteria)
    return found.groupBy("project").agg(F.count("data_id").alias("n"), F.count_distinct("data_id").alias("n_distinct"))


def project_catalog(spark, sf):
    return cat.project_catalog(views.catalog(spark, sf), ["data_id", "trait.desc", "total_samples", "notes_source_id", "trait_unit"])


def link_expand(spark, sf):
    return _linked(spark, sf)


def link_id_concat(spark, sf):
    return cat.link_id_concat(_linked(spark, sf))


def output_prefix(spark, sf):
    linked = cat.output_prefix(_linked(spark, sf), "out").withColumn("kind", F.lit("linked"))
    plain = cat.project_catalog(views.catalog(spark, sf), ["project", "study", "data_id", "notes_consortium"]).withColumnRenamed(
        "notes_consortium", "notes_source_id")
    return cat.output_prefix(plain, "out").withColumn("kind", F.lit("plain")).unionByName(linked)


def metadata_broadcast(spark, sf):
    rows = views.sumstats(spark, sf).select("TRAITID", "CHR", "POS", "MLOG10P")
    return cat.metadata_broadcast(rows, _linked(spark, sf).drop("project", "study"))


def catalog_tree(spark, sf):
    return cat.catalog_tree(views.catalog(spark, sf), ["gwas", "pQTL"]).select(
        "category", "project", F.array_join("studies", ", ").alias("studies"))


# ---------------------------------------------------------------- scalar functions


def _scored(spark, sf):
    return views.sumstats(spark, sf).select("TRAITID", "CHR", "POS", "EA", "NEA", normal.z_score(F.col("BETA"), F.col("SE")).alias("z"))


def z_score(spark, sf):
    return _rounded(_scored(spark, sf), "z")


def norm_p_two_sided(spark, sf):
    return _scored(spark, sf).select("TRAITID", "CHR", "POS", "EA", "NEA", F.round(normal.norm_p_two_sided(F.col("z")), 6).alias("p"))


def mlog10p_from_z(spark, sf):
    tall = _scored(spark, sf).withColumn("z", F.col("z") * 4)
    return tall.select("TRAITID", "CHR", "POS", "EA", "NEA", F.round(normal.mlog10p_from_z(F.col("z")), 6).alias("mlog10p"))


def build_snpid(spark, sf):
    return slices.with_snpid(views.sumstats_dense(spark, sf)).select("TRAITID", "SNPID")


def normalise_chr(spark, sf):
    return views.table(spark, sf, "part").select(
        "p_partkey", variants.normalise_chr(F.concat(F.lit("chr"), F.col("p_size").cast("string"))).alias("chr"),
        variants.normalise_chr(F.col("p_name")).alias("none"), variants.normalise_chr(F.concat(F.lit("Chr"), F.substring(F.col("p_type"), 1, 1))).alias("letter"))


def is_multiallelic(spark, sf):
    rows = slices.with_snpid(views.sumstats_dense(spark, sf))
    return rows.select("TRAITID", "SNPID", variants.is_multiallelic(F.col("EA"), F.col("NEA")).alias("by_allele"),
                       variants.is_multiallelic_id(F.col("SNPID")).alias("by_id"))


def valid_alleles(spark, sf):
    rows = slices.with_snpid(views.sumstats_dense(spark, sf))
    return rows.select("TRAITID", "SNPID", variants.valid_alleles(F.col("EA"), F.col("NEA")).alias("valid"))


def harmonise_alleles(spark, sf):
    rows = views.sumstats_dense(spark, sf)
    return rows.select("TRAITID", variants.harmonised_snpid(F.col("CHR"), F.col("POS"), F.col("EA"), F.col("NEA")).alias("SNPID"))


def slug(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


def split_list(spark, sf):
    joined = F.concat_ws(" , ", "p_name", "p_type", "p_brand")
    return views.table(spark, sf, "part").select("p_partkey", F.array_join(text.split_list(joined), "|").alias("items"))


def json_fold(spark, sf):
    folded = text.json_fold({"key": F.col("c_custkey"), "segment": F.col("c_mktsegment"), "none": F.when(F.col("c_acctbal") > 0, F.col("c_name"))})
    return views.table(spark, sf, "customer").select("c_custkey", text.json_text(folded).alias("json"))


def json_field(spark, sf):
    return views.table(spark, sf, "events").select("event_id", text.json_field(F.col("props"), "k").alias("k"))


def nested_key_find(spark, sf):
    """Keys at the top, in the middle and six levels down; of two places the outer or the earlier one counts."""
    six = F.concat(F.lit('{"z": 1, "l1": {"a": {"b": "x"}, "l2": {"l3": {"l4": {"l5": {"deep": "'), F.col("event_id").cast("string"),
                   F.lit('", "props": '), F.col("props"), F.lit('}}}}}, "k2": "t", "tail": {"b": "late", "z": "inner"}}'))
    rows = views.table(spark, sf, "events").select("event_id", six.alias("doc"))
    found = text.with_nested_keys(rows, "doc", {"k": "k", "b": "b", "deep": "deep", "z": "z", "absent": "absent"})
    return found.drop("doc")


def locus_name(spark, sf):
    return views.regions(spark, sf).select(variants.locus_name(F.col("CHR"), F.col("START"), F.col("END")).alias("locus"))


def clip_low(spark, sf):
    return views.regions(spark, sf).select("CHR", variants.clip_low(F.col("START") - 500_000).alias("START"))


def short_hash(spark, sf):
    return views.table(spark, sf, "customer").select("c_custkey", text.short_hash(F.col("c_name")).alias("id"))


def ancestry_code(spark, sf):
    names = views.table(spark, sf, "customer").join(
        views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    told = F.when(F.col("r_name") == "EUROPE", "european").when(F.col("r_name") == "ASIA", " EAS ").when(
        F.col("r_name") == "AMERICA", "Hispanic or Latin American").otherwise(F.col("r_name"))
    return names.select("c_custkey", text.ancestry_code(told).alias("code"), text.ancestry_name(text.ancestry_code(told)).alias("name"))


# ---------------------------------------------------------------- summaries


def pheno_variance(spark, sf):
    samples = cat.project_catalog(views.catalog(spark, sf), ["data_id", "total_samples"]).select(
        F.col("data_id").alias("TRAITID"), F.col("total_samples").alias("N"))
    return _rounded(summaries.pheno_variance(views.sumstats(spark, sf), samples, views.sumstats_sketches(spark, sf)), "pheno_variance")


def manhattan_table(spark, sf):
    return summaries.manhattan_table(views.sumstats(spark, sf)).drop("SNP")


def manhattan_bins(spark, sf):
    return summaries.manhattan_bins(views.sumstats(spark, sf))


def rsid_resolve(spark, sf):
    known = views.table(spark, sf, "part").select(
        F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("rsID"),
        (F.lit(1) + F.col("p_partkey") % 22).cast("int").alias("CHR"), (F.lit(1) + F.col("p_partkey") * 10).cast("int").alias("POS"))
    listed = views.table(spark, sf, "customer").select(
        F.concat(F.lit("rs"), F.col("c_custkey").cast("string")).alias("rsID"),
        F.substring(F.lit("ACGT"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1)).alias("A1"),
        F.substring(F.lit("GTAC"), (F.col("c_custkey") % 3 + 1).cast("int"), F.lit(1)).alias("A2"))
    return summaries.rsid_resolve(listed, known)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_manifest, read_sumstats_tsv, read_sumstats_parquet, ingest_sumstats, ingest_metadata, natural_order, natural_order_compacted, write_result,
        multi_trait_export, write_partitioned_by_trait, write_metadata_sidecar, cast_sumstats, content_id, read_regions_bed, read_snp_list, read_trait_snps, validate_sumstats,
        select_attributes, mlog10p_fallback, trait_slice, position_points, position_range, pvalue_threshold,
        maf_filter, process_result, full_stats, group_slice, snp_semi_join, region_semi_join,
        region_semi_join_overlapping, region_pvalue_filter, region_flags, chromosome_envelope, lead_snp_search,
        lead_tiebreak, exact_snp_lookup, cis_trans_flanks, trait_link_join, top1_per_window, position_gap,
        gap_cluster_id, best_in_cluster, locus_segments, locus_intervals, locus_breaker, locus_breaker_by_study,
        ivw_meta, heterogeneity_i2, meta_z_p, grouped_meta, meta_with_copies, pooling_report, meta_full_outer, meta_full_outer_all, aligned_effects, meta_export,
        to_catalog_row, validate_catalog, catalog_upsert, catalog_lookup, catalog_modify, catalog_delete, stored_modify, stored_delete,
        search_catalog, search_template, meta_query, scalar_match, data_ids_match, json_match, any_of, all_of,
        distinct_by_id, project_catalog, link_expand, link_id_concat, output_prefix, metadata_broadcast,
        catalog_tree, z_score, norm_p_two_sided, mlog10p_from_z, build_snpid, normalise_chr, is_multiallelic,
        valid_alleles, harmonise_alleles, slug, split_list, json_fold, json_field, nested_key_find, locus_name,
        clip_low, short_hash, ancestry_code, pheno_variance, manhattan_table, manhattan_bins, rsid_resolve,
    )
}
