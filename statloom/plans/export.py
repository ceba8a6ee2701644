"""Export: search the catalog, run one analysis over all matched traits, write."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from statloom.operators import catalog as cat
from statloom.operators import leads, loci, meta, regions, slices, summaries
from statloom.schemas import ATTRIBUTES, GROUP_COLUMNS
from statloom.session import cut_lineage
from statloom.sources import sinks

log = logging.getLogger(__name__)


def selected_metadata(
    catalog: DataFrame,
    template: Mapping | None,
    *,
    linked: bool = False,
    case_sensitive: bool = False,
    exact_match: bool = False,
) -> DataFrame:
    """Matched records with the template's fields; `linked` expands them by the searched ids."""
    criteria, fields = cat.search_template(template)
    found = cat.search_catalog(catalog, criteria, case_sensitive, exact_match)
    fields = list(fields or cat.DEFAULT_OUTPUT)
    if not linked:
        return cat.project_catalog(found, fields)
    column, values = cat.link_column(criteria or {})
    projected = cat.project_catalog(found, [*fields, column])
    return cat.link_expand(projected, column, values, exact_match, case_sensitive)


def export(
    sumstats: DataFrame,
    catalog: DataFrame,
    template: Mapping | None = None,
    *,
    attributes: str | Sequence[str] = ATTRIBUTES,
    locusbreaker: bool = False,
    region_list: DataFrame | None = None,
    trait_snps: DataFrame | None = None,
    meta_analysis: bool = False,
    pvalue_thr: float = 0.0,
    pvalue_filt: float = 0.0,
    pvalue_sig: float = loci.SIGNIFICANT,
    pvalue_limit: float = loci.LIMIT,
    hole_size: int = loci.HOLE,
    maf: float = loci.MAF,
    locus_flanks: int = loci.FLANKS,
    phenovar: bool = False,
    cis_flanks: int = leads.CIS_FLANKS,
    trans_flanks: int = leads.TRANS_FLANKS,
    skip_meta: bool = False,
    plot_out: bool = False,
    suggestive: float = summaries.SUGGESTIVE,
    unique: bool = False,
    labels: bool = False,
    case_sensitive: bool = False,
    exact_match: bool = False,
    peaks: DataFrame | None = None,
    sketches: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Result frames by name; `metadata` is always among them. The catalog is searched once.

    The analysis is the first one asked for, in the order: loci, regions or
    SNPs, lead SNPs, meta-analysis, full statistics. A meta-analysis names its traits once per study, in `meta_labels`,
    or with `labels` on every row; `unique` states that no trait has copies of a variant. `peaks` (see `read_peaks`) lets
    regions with a threshold be found without reading the table for them, and `sketches` (see `read_sketches`) the
    phenotypic variance without a pass of its own for the bracket of its median.
    """
    leads_asked = trait_snps is not None and not locusbreaker and region_list is None
    metadata = cut_lineage(
        selected_metadata(
            catalog, template, linked=trait_snps is not None, case_sensitive=case_sensitive, exact_match=exact_match
        ),
        "metadata",
    )
    rows = slices.in_traits(sumstats, metadata)
    described = (lambda df: df) if skip_meta else (lambda df: cat.metadata_broadcast(df, metadata))
    results = {"metadata": metadata}

    if locusbreaker:
        variance = None
        if phenovar:
            found = catalog.join(metadata.select(*GROUP_COLUMNS, "data_id").distinct(), [*GROUP_COLUMNS, "data_id"], "left_semi")
            samples = cat.project_catalog(found, [*GROUP_COLUMNS, "data_id", "total_samples"])
            samples = samples.withColumnRenamed("data_id", "TRAITID").withColumnRenamed("total_samples", "N")
            variance = summaries.pheno_variance(rows, samples, None if sketches is None else slices.in_traits(sketches, metadata), maf)
        results["segments"], results["intervals"] = loci.locus_breaker(
            rows, maf, pvalue_limit, pvalue_sig, hole_size, locus_flanks, variance
        )
    elif region_list is not None:
        known = None if peaks is None else slices.in_traits(peaks, metadata)
        found, flags = regions.extract_regions(rows, region_list, pvalue_filt, known)
        results["result"] = described(_requested(found, attributes))
        if flags is not None:
            results["pvalue_filt"] = flags
    elif leads_asked:
        asked = leads.link_traits(trait_snps, metadata)
        results["result"] = described(leads.lead_snp_search(rows, asked, cis_flanks, trans_flanks))
    elif meta_analysis:
        results["meta_analysis"] = meta.meta_analysis(rows, metadata, unique, labels)
        if not labels:
            results["meta_labels"] = meta.trait_labels(metadata)
    else:
        found = slices.full_stats(rows, threshold=pvalue_thr, attributes=attributes)
        results["result"] = described(found)
    if plot_out and "result" in results and not leads_asked:
        results["manhattan"] = summaries.manhattan_table(slices.with_mlog10p(results["result"]), suggestive=suggestive)
    return results


def _requested(rows: DataFrame, attributes: str | Sequence[str]) -> DataFrame:
    shaped = slices.as_result(rows)
    names = dict.fromkeys(slices.parse_attributes(attributes))
    groups = [c for c in GROUP_COLUMNS if c in shaped.columns]
    return shaped.select("SNPID", *groups, *slices.DIMENSIONS, *names)


def write_export(results: Mapping[str, DataFrame], prefix: str, file_format: str = "csv.gz") -> dict[str, str]:
    """Write every result and the metadata sidecar; one job per result for all traits together.

    Per-trait results go to `<prefix>[_<suffix>].<format>/output_prefix=<name>/`.
    """
    metadata = results["metadata"]
    name = prefix.rstrip("/").rsplit("/", 1)[-1]
    names = cat.output_prefix(metadata, name)
    with_names = metadata.drop("link_id").dropDuplicates([*GROUP_COLUMNS, "data_id"]).join(names, [*GROUP_COLUMNS, "data_id"])
    log.info("%d results found", with_names.count())
    written = {"metadata": sinks.write_metadata_sidecar(with_names, prefix)}
    for kind, df in results.items():
        if kind == "metadata":
            continue
        target = prefix if kind == "result" else f"{prefix}_{kind}"
        if kind in ("meta_analysis", "meta_labels"):
            written[kind] = sinks.write_result(df, target, file_format, GROUP_COLUMNS)
        elif kind != "pvalue_filt" or not df.isEmpty():
            written[kind] = sinks.write_partitioned_by_trait(df, names, target, file_format)
    return written
