"""SQL that gives the result of each registered query, for an independent engine."""

from __future__ import annotations

_LINES = """lines AS (
  SELECT l_partkey, l_suppkey, max(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q, max(l_extendedprice) AS p
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

_SUMSTATS = _LINES + """, sumstats AS (
  SELECT CAST(1 + l_partkey % 22 AS INTEGER) AS CHR,
         substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 10) AS TRAITID,
         CAST(1 + floor(l_partkey / 22) * 50000 AS INTEGER) AS POS,
         substr('ACGT', CAST(1 + l_partkey % 4 AS INTEGER), 1) AS EA,
         substr('CGTA', CAST(1 + l_partkey % 4 AS INTEGER), 1) AS NEA,
         d - 0.05 AS BETA, 0.01 + t / 2 AS SE, q / 51 AS EAF, p / 10000 AS MLOG10P
  FROM lines)"""

_DENSE = _LINES + """, dense AS (
  SELECT CAST(1 + l_partkey % 22 AS INTEGER) AS CHR,
         substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 10) AS TRAITID,
         CAST(1 + floor(l_partkey / 44) * 50000 AS INTEGER) AS POS,
         substr('ACGT', CAST(1 + l_partkey % 4 AS INTEGER), 1) || CASE WHEN l_partkey % 10 = 0 THEN 'TT' ELSE '' END AS EA,
         substr('CGTA', CAST(1 + l_partkey % 4 AS INTEGER), 1) AS NEA,
         d - 0.05 AS BETA, 0.01 + t / 2 AS SE, q / 51 AS EAF, CAST(floor(p / 10000) AS DOUBLE) AS MLOG10P
  FROM lines)"""

_CATALOG = """placed AS (
  SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                JOIN part ON p_partkey = s_suppkey),
catalog AS (
  SELECT lower(replace(r_name, ' ', '_')) AS project, lower(replace(n_name, ' ', '_')) AS study,
         substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 10) AS data_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'GWAS' WHEN 1 THEN 'pQTL' ELSE 'eQTL' END AS category,
         CASE WHEN s_suppkey % 2 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS build,
         n_name AS pop1, r_name AS pop2,
         s_name AS notes_source_id, CASE WHEN s_acctbal > 0 THEN p_brand END AS notes_consortium,
         CAST(floor(p_retailprice) AS BIGINT) AS total_samples, p_name AS trait_desc,
         p_type || '|' || p_brand AS trait_protein_ids
  FROM placed)"""

_STUDIES = """studies AS (
  SELECT lower(replace(r_name, ' ', '_')) AS project, lower(replace(n_name, ' ', '_')) AS study,
         substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 10) AS TRAITID
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
by_study AS (SELECT studies.project, studies.study, sumstats.* FROM sumstats JOIN studies USING (TRAITID))"""

_REGIONS = """regions AS (
  SELECT CAST(1 + s_suppkey % 22 AS INTEGER) AS CHR, CAST(s_suppkey * 45000 AS INTEGER) AS "START",
         CAST(s_suppkey * 45000 + floor(abs(s_acctbal)) * 10 + 10000 AS INTEGER) AS "END"
  FROM supplier)"""

_SNPS = """snp_list AS (
  SELECT CAST(1 + c_custkey % 22 AS INTEGER) AS CHR, CAST(1 + c_custkey * 2500 AS INTEGER) AS POS FROM customer)"""


def _listed(source: str) -> str:
    return f"""listed AS (
  SELECT TRAITID, TRAITID AS SOURCE_ID, CASE WHEN EAF > 0.97 THEN 23 ELSE CHR END AS CHR,
         CASE WHEN CHR % 3 = 0 THEN POS + 7 ELSE POS END AS POS,
         CASE WHEN CHR % 5 = 0 THEN NEA ELSE EA END AS EA, CASE WHEN CHR % 5 = 0 THEN EA ELSE NEA END AS NEA,
         CASE WHEN CHR % 2 = 0 THEN ' Cis ' WHEN CHR % 7 = 0 THEN 'other' ELSE 'trans' END AS CIS_TRANS
  FROM {source})"""


def _windows(cis: int, trans: int, default: int = 1_000_000) -> str:
    return f"""windows AS (
  SELECT *, greatest(POS - flank, 1) AS "START", POS + flank AS "END" FROM (
    SELECT *, CASE lower(trim(CIS_TRANS)) WHEN 'cis' THEN {cis} WHEN 'trans' THEN {trans} ELSE {default} END AS flank
    FROM listed))"""


def _snpid(prefix: str = "") -> str:
    return " || ':' || ".join(f"CAST({prefix}{c} AS VARCHAR)" for c in ("CHR", "POS", "EA", "NEA"))


def _tail_ratio(z: str) -> str:
    top = ("0.0352624965998911", "0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871",
           "221.213596169931", "220.206867912376")
    low = ("0.0883883476483184", "1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674",
           "637.333633378831", "793.826512519948", "440.413735824752")

    def poly(cs):
        return " + ".join(f"CAST({c} AS DOUBLE) * pow({z}, {len(cs) - 1 - i})" for i, c in enumerate(cs))

    tail = f"1 / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) * 2.506628274631)"
    return f"(CASE WHEN {z} < 7.07106781186547 THEN ({poly(top)}) / ({poly(low)}) ELSE {tail} END)"


def _p(z: str) -> str:
    return f"(2 * exp(-({z}) * ({z}) / 2) * {_tail_ratio(z)})"


def _mlog10p(z: str) -> str:
    return f"greatest(({z}) * ({z}) / 2 * 0.4342944819032518 - log10(2 * {_tail_ratio(z)}), 0)"


_SCORED = _SUMSTATS + """, scored AS (SELECT *, abs(BETA / SE) AS a, BETA / SE AS z FROM sumstats)"""

_LEAD_ORDER = "s.MLOG10P DESC, (length(s.EA) > 1 OR length(s.NEA) > 1), s.POS, s.EA, s.NEA"


def _leads(source: str) -> str:
    return f"""found AS (
  SELECT w.TRAITID, w.CHR, w."START", w."END", s.POS, s.EA, s.NEA, s.MLOG10P, s.BETA, s.SE,
         row_number() OVER (PARTITION BY w.TRAITID, w.CHR, w."START", w."END" ORDER BY {_LEAD_ORDER}) AS rn
  FROM (SELECT DISTINCT TRAITID, CHR, "START", "END" FROM windows) w
  JOIN {source} s ON s.TRAITID = w.TRAITID AND s.CHR = w.CHR AND s.POS BETWEEN w."START" AND w."END"),
leads AS (SELECT * FROM found WHERE rn = 1)"""


def _clusters(source: str, hole: int) -> str:
    return f"""stepped AS (
  SELECT *, CASE WHEN POS - lag(POS) OVER (PARTITION BY TRAITID, CHR ORDER BY POS, EA, NEA) > {hole} THEN 1 ELSE 0 END AS step
  FROM {source}),
clustered AS (
  SELECT *, CAST(sum(step) OVER (PARTITION BY TRAITID, CHR ORDER BY POS, EA, NEA ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster
  FROM stepped)"""


def _loci(flanks: int = 100_000, significant: float = 5.0) -> str:
    return f"""bounds AS (
  SELECT TRAITID, CHR, cluster, CASE WHEN min(POS) - {flanks} < 0 THEN 1 ELSE min(POS) - {flanks} END AS locus_start,
         max(POS) + {flanks} AS locus_end, max(MLOG10P) AS top
  FROM clustered GROUP BY TRAITID, CHR, cluster HAVING max(MLOG10P) > {significant}),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY TRAITID, CHR, cluster ORDER BY MLOG10P DESC, POS, EA, NEA) AS rn
                 FROM clustered) WHERE rn = 1),
loci AS (
  SELECT b.TRAITID, b.CHR, CAST(b.CHR AS VARCHAR) || ':' || CAST(b.locus_start AS VARCHAR) || ':' || CAST(b.locus_end AS VARCHAR) AS locus,
         CAST(b.locus_start AS INTEGER) AS locus_start, CAST(b.locus_end AS INTEGER) AS locus_end, b.top AS snp_MLOG10P,
         {_snpid("x.")} AS SNPID, x.POS, x.EA, x.NEA, x.BETA, x.SE, x.EAF, x.MLOG10P
  FROM bounds b JOIN best x ON b.TRAITID = x.TRAITID AND b.CHR = x.CHR AND b.cluster = x.cluster)"""


_KEPT = _SUMSTATS + """, kept AS (SELECT * FROM sumstats WHERE EAF BETWEEN 0.1 AND 0.9 AND MLOG10P > 3.3)"""


def _pooled(source: str = "sumstats", keys: str = "CHR, POS, EA, NEA") -> str:
    on = " AND ".join(f"r.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""means AS (
  SELECT {keys}, sum(BETA / (SE * SE)) / sum(1 / (SE * SE)) AS b, sqrt(1 / sum(1 / (SE * SE))) AS se, count(*) AS n
  FROM {source} GROUP BY {keys}),
pooled AS (
  SELECT {named}, any_value(m.b) AS b, any_value(m.se) AS se, any_value(m.n) AS n,
         sum((r.BETA - m.b) * (r.BETA - m.b) / (r.SE * r.SE)) AS q
  FROM {source} r JOIN means m ON {on} GROUP BY {named}),
i2 AS (SELECT *, CASE WHEN n > 1 AND q > 1e-9 THEN greatest((q - (n - 1)) / q * 100, 0) ELSE 0 END AS i_sq FROM pooled)"""


_LINKED = _CATALOG + """, linked AS (
  SELECT project, study, data_id, notes_source_id, trait_protein_ids, v AS link_id
  FROM catalog, (VALUES ('ECONOMY'), ('SMALL'), ('Brand#1'), ('Brand#2')) AS searched(v)
  WHERE contains(lower(trait_protein_ids), lower(v)))"""

_INCOMING = _CATALOG + """, changed AS (
  SELECT project, study, data_id, category, CASE category WHEN 'pQTL' THEN 'GRCh38' ELSE build END AS build, trait_desc FROM catalog)"""


_STORED = """CHR, POS, EA, NEA, round(CAST(CAST(EAF AS FLOAT) AS DOUBLE), 4) AS EAF, round(CAST(CAST(SE AS FLOAT) AS DOUBLE), 4) AS SE,
               round(CAST(CAST(BETA AS FLOAT) AS DOUBLE), 4) AS BETA, round(CAST(CAST(MLOG10P AS FLOAT) AS DOUBLE), 4) AS MLOG10P"""

ORACLES: dict[str, str] = {
    "read_manifest": """SELECT CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) END AS project,
        upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS study,
        substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 10) AS data_id, CASE s_suppkey % 3 WHEN 0 THEN 'GWAS' WHEN 1 THEN 'pQTL' ELSE 'eQTL' END AS category,
        CASE WHEN s_suppkey % 2 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS build, n_name || ' , ' || r_name AS population, s_name AS notes_source_id,
        CASE WHEN s_acctbal > 0 THEN p_brand END AS notes_consortium, CAST(floor(p_retailprice) AS BIGINT) AS total_samples, p_name AS trait_desc,
        p_type || '|' || p_brand AS trait_protein_ids
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = s_suppkey""",
    "read_sumstats_tsv": f"WITH {_SUMSTATS} SELECT {_STORED} FROM sumstats",
    "read_sumstats_parquet": f"WITH {_SUMSTATS} SELECT TRAITID, {_STORED} FROM sumstats",
    "ingest_sumstats": f"WITH {_SUMSTATS}, {_STUDIES} SELECT project, study, {_STORED}, true AS trait_known FROM by_study",
    "ingest_metadata": f"""WITH {_CATALOG} SELECT project, study, data_id, category,
        CASE category WHEN 'pQTL' THEN upper(trait_desc) ELSE trait_desc END AS trait_desc, total_samples FROM catalog""",
    "natural_order": f"""WITH {_SUMSTATS}, {_STUDIES} SELECT project, study, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_early
        FROM by_study GROUP BY project, study""",
    "natural_order_compacted": f"""WITH {_SUMSTATS}, {_STUDIES} SELECT project, study, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_early
        FROM by_study GROUP BY project, study""",
    "write_result": f"WITH {_SUMSTATS} SELECT * FROM sumstats",
    "multi_trait_export": f"""WITH {_SUMSTATS}, {_CATALOG} SELECT {_snpid("s.")} AS SNPID, s.TRAITID, s.BETA, s.MLOG10P, c.category AS meta_category,
        c.out_name AS output_prefix
        FROM sumstats s JOIN (SELECT *, 'out_' || project || '_' || study || '_' || notes_source_id AS out_name FROM catalog) c ON s.TRAITID = c.data_id
        WHERE s.MLOG10P > 6 AND c.category = 'pQTL' AND c.trait_desc ILIKE '%red%'""",
    "write_partitioned_by_trait": f"""WITH {_KEPT}, {_CATALOG}, {_clusters('kept', 250_000)}, {_loci()}
        SELECT 'out_' || c.project || '_' || c.study || '_' || c.data_id AS output_prefix, count(*) AS n_loci
        FROM loci l JOIN catalog c ON l.TRAITID = c.data_id GROUP BY ALL""",
    "write_metadata_sidecar": f"""WITH {_CATALOG} SELECT project, study, category, data_id, notes_source_id, build, trait_desc, total_samples
        FROM catalog WHERE category = 'GWAS'""",
    "cast_sumstats": f"""WITH {_SUMSTATS}
        SELECT CHR, TRAITID, POS, EA, NEA, round(CAST(CAST(EAF AS FLOAT) AS DOUBLE), 4) AS EAF, round(CAST(CAST(SE AS FLOAT) AS DOUBLE), 4) AS SE,
               round(CAST(CAST(BETA AS FLOAT) AS DOUBLE), 4) AS BETA, round(CAST(CAST(MLOG10P AS FLOAT) AS DOUBLE), 4) AS MLOG10P FROM sumstats""",
    "content_id": """SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 10) AS id,
        substr(sha256(sha256(source) || sha256(text)), 1, 10) AS file_id FROM documents""",
    "read_regions_bed": """WITH raw AS (
        SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 23 WHEN 1 THEN 24 WHEN 3 THEN 7 WHEN 4 THEN 12 END AS CHR FROM supplier)
        SELECT CAST(CHR AS INTEGER) AS CHR, CAST(s_suppkey * 45000 AS INTEGER) AS "START", CAST(s_suppkey * 45000 + 10 AS INTEGER) AS "END"
        FROM raw WHERE CHR IS NOT NULL""",
    "read_snp_list": """SELECT CAST(c_custkey % 30 AS INTEGER) AS CHR, CAST(c_custkey AS INTEGER) AS "START",
        CAST(c_custkey + 1 AS INTEGER) AS "END" FROM customer""",
    "read_trait_snps": f"""WITH {_DENSE} SELECT TRAITID AS SOURCE_ID, CHR, POS, EA, NEA,
        CASE WHEN length(EA) = length(NEA) THEN EA <= NEA ELSE length(EA) > length(NEA) END AS valid FROM dense""",
    "validate_sumstats": f"""WITH {_SUMSTATS}, moved AS (SELECT CAST(CHR + 4 AS INTEGER) AS CHR, POS - 1 AS POS FROM sumstats)
        SELECT CHR, (CHR BETWEEN 1 AND 24 AND POS BETWEEN 1 AND 250000000) AS valid, count(*) AS n FROM moved GROUP BY ALL""",
    "select_attributes": f"WITH {_SUMSTATS} SELECT CHR, TRAITID, POS, BETA, SE FROM sumstats",
    "mlog10p_fallback": f"""WITH {_SCORED} SELECT CHR, TRAITID, POS, BETA, SE, EA, NEA, round({_mlog10p("a")}, 6) AS MLOG10P FROM scored""",
    "trait_slice": f"""WITH {_SUMSTATS}, {_CATALOG}
        SELECT * FROM sumstats WHERE TRAITID IN (SELECT data_id FROM catalog WHERE category = 'pQTL')""",
    "position_points": f"""WITH {_SUMSTATS}, {_SNPS}
        SELECT * FROM sumstats WHERE (CHR, POS) IN (SELECT (CHR, POS) FROM snp_list)""",
    "position_range": f"WITH {_SUMSTATS} SELECT * FROM sumstats WHERE CHR = 7 AND POS BETWEEN 1 AND 2000000",
    "pvalue_threshold": f"WITH {_SUMSTATS} SELECT * FROM sumstats WHERE MLOG10P > 7.3",
    "maf_filter": f"WITH {_SUMSTATS} SELECT * FROM sumstats WHERE EAF >= 0.1 AND EAF <= 0.9",
    "process_result": f"""WITH {_SCORED} SELECT {_snpid()} AS SNPID, CHR, POS, EA, NEA, BETA, SE, EAF,
        round({_mlog10p("a")}, 6) AS MLOG10P FROM scored""",
    "full_stats": f"""WITH {_SUMSTATS}, {_STUDIES}, {_CATALOG}
        SELECT {_snpid("b.")} AS SNPID, b.project, b.study, b.CHR, b.TRAITID, b.POS, b.BETA, b.SE, b.MLOG10P,
               c.project AS meta_project, c.study AS meta_study, c.category AS meta_category,
               c.notes_source_id AS meta_notes_source_id, c.trait_desc AS meta_trait_desc
        FROM by_study b JOIN catalog c ON b.TRAITID = c.data_id AND b.project = c.project AND b.study = c.study
        WHERE b.MLOG10P > 5 AND c.category = 'GWAS' AND (c.trait_desc ILIKE '%red%' OR c.trait_desc ILIKE '%bolt%')""",
    "group_slice": f"""WITH {_SUMSTATS}, {_STUDIES} SELECT * FROM by_study WHERE project = 'asia' AND study = 'nation_17'""",
    "snp_semi_join": f"""WITH {_SUMSTATS}, {_SNPS} SELECT * FROM sumstats s WHERE MLOG10P > 3
        AND EXISTS (SELECT 1 FROM snp_list r WHERE r.CHR = s.CHR AND r.POS = s.POS)""",
    "region_semi_join": f"""WITH {_SUMSTATS}, {_REGIONS} SELECT * FROM sumstats s
        WHERE EXISTS (SELECT 1 FROM regions r WHERE r.CHR = s.CHR AND s.POS BETWEEN r."START" AND r."END")""",
    "region_semi_join_overlapping": f"""WITH {_SUMSTATS}, regions AS (
        SELECT CAST(1 + p_partkey % 22 AS INTEGER) AS CHR, p_partkey * 3000 AS "START", p_partkey * 3000 + p_size * 10000 AS "END" FROM part)
        SELECT * FROM sumstats s
        WHERE EXISTS (SELECT 1 FROM regions r WHERE r.CHR = s.CHR AND s.POS BETWEEN r."START" AND r."END")""",
    "region_pvalue_filter": f"""WITH {_SUMSTATS}, {_REGIONS}, hit AS (
        SELECT s.TRAITID, r.CHR, r."START", r."END" FROM sumstats s JOIN regions r
          ON r.CHR = s.CHR AND s.POS BETWEEN r."START" AND r."END"
        GROUP BY ALL HAVING max(s.MLOG10P) > 8)
        SELECT * FROM sumstats s WHERE EXISTS (SELECT 1 FROM hit h
          WHERE h.TRAITID = s.TRAITID AND h.CHR = s.CHR AND s.POS BETWEEN h."START" AND h."END")""",
    "region_flags": f"""WITH {_SUMSTATS}, {_REGIONS}, env AS (
          SELECT CHR, greatest(min("START"), 1) AS lo, max("END") AS hi FROM regions GROUP BY CHR),
        seen AS (SELECT DISTINCT s.TRAITID, s.CHR FROM sumstats s JOIN env e ON e.CHR = s.CHR AND s.POS BETWEEN e.lo AND e.hi)
        SELECT n.TRAITID, r.CHR, r."START", r."END",
               coalesce(bool_or(s.MLOG10P > 8), false) AS PVALUE_FILT_FLAG
        FROM seen n JOIN regions r ON r.CHR = n.CHR
        LEFT JOIN sumstats s ON s.TRAITID = n.TRAITID AND s.CHR = r.CHR AND s.POS BETWEEN r."START" AND r."END"
        GROUP BY n.TRAITID, r.CHR, r."START", r."END\"""",
    "chromosome_envelope": f"""WITH {_REGIONS} SELECT CHR, greatest(min("START"), 1) AS min_start, max("END") AS max_end FROM regions GROUP BY CHR""",
    "lead_snp_search": f"""WITH {_SUMSTATS}, {_listed("sumstats")}, {_windows(120_000, 400_000)}, {_leads("sumstats")}
        SELECT w.TRAITID, w.SOURCE_ID || ':' || {_snpid("w.")} AS SOURCEID_SNP, {_snpid("l.")} AS SNPID_LEAD,
               l.MLOG10P AS MLOG10P_LEAD, l.BETA AS BETA_LEAD, l.SE AS SE_LEAD, {_snpid("x.")} AS SNPID_EXACT,
               x.MLOG10P AS MLOG10P_EXACT, x.BETA AS BETA_EXACT, x.SE AS SE_EXACT
        FROM windows w
        LEFT JOIN leads l ON l.TRAITID = w.TRAITID AND l.CHR = w.CHR AND l."START" = w."START" AND l."END" = w."END"
        LEFT JOIN sumstats x ON x.TRAITID = w.TRAITID AND x.CHR = w.CHR AND x.POS = w.POS AND x.EA = w.EA AND x.NEA = w.NEA""",
    "lead_tiebreak": f"""WITH {_DENSE}, {_listed("dense")}, {_windows(120_000, 400_000)}, {_leads("dense")}
        SELECT w.TRAITID, w.SOURCE_ID || ':' || {_snpid("w.")} AS SOURCEID_SNP, {_snpid("l.")} AS SNPID_LEAD, l.MLOG10P AS MLOG10P_LEAD
        FROM windows w
        LEFT JOIN leads l ON l.TRAITID = w.TRAITID AND l.CHR = w.CHR AND l."START" = w."START" AND l."END" = w."END\"""",
    "exact_snp_lookup": f"""WITH {_SUMSTATS}, {_listed("sumstats")}
        SELECT TRAITID, CHR, POS, EA, NEA, MLOG10P, BETA FROM sumstats
        WHERE (TRAITID, CHR, POS, EA, NEA) IN (SELECT (TRAITID, CHR, POS, EA, NEA) FROM listed)""",
    "cis_trans_flanks": f"""WITH {_SUMSTATS}, {_listed("sumstats")}, {_windows(500_000, 750_000)}
        SELECT TRAITID, CAST(CHR AS INTEGER) AS CHR, CAST(POS AS INTEGER) AS POS, EA, NEA, CAST("START" AS INTEGER) AS "START", CAST("END" AS INTEGER) AS "END" FROM windows""",
    "trait_link_join": f"""WITH {_LINKED}, {_REGIONS}
        SELECT l.link_id AS SOURCE_ID, r.CHR, r."START" AS POS, 'A' AS EA, 'C' AS NEA, l.project, l.study, l.data_id AS TRAITID
        FROM regions r JOIN linked l ON l.link_id = CASE r.CHR % 5 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'Brand#1' WHEN 3 THEN 'Brand#2' ELSE 'absent' END""",
    "top1_per_window": f"""WITH {_DENSE}, {_listed("dense")}, {_windows(250_000, 250_000)}, {_leads("dense")}
        SELECT TRAITID, CAST(CHR AS INTEGER) AS CHR, CAST("START" AS INTEGER) AS "START", CAST("END" AS INTEGER) AS "END", POS, EA, MLOG10P FROM leads""",
    "position_gap": f"""WITH {_DENSE}, places AS (SELECT TRAITID, CHR, POS, count(*) AS n_variants FROM dense GROUP BY ALL),
        gaps AS (SELECT *, POS - lag(POS) OVER (PARTITION BY TRAITID, CHR ORDER BY POS) AS gap FROM places)
        SELECT *, coalesce(gap > 250000, false) AS is_break FROM gaps""",
    "gap_cluster_id": f"""WITH {_SUMSTATS}, kept AS (SELECT * FROM sumstats WHERE MLOG10P > 3.3), {_clusters("kept", 250_000)}
        SELECT TRAITID, CHR, POS, EA, NEA, cluster FROM clustered""",
    "best_in_cluster": f"""WITH {_DENSE}, kept AS (SELECT * FROM dense WHERE MLOG10P > 3.3), {_clusters("kept", 200_000)}
        SELECT TRAITID, CHR, cluster, POS, EA, NEA, MLOG10P FROM (
          SELECT *, row_number() OVER (PARTITION BY TRAITID, CHR, cluster ORDER BY MLOG10P DESC, POS, EA, NEA) AS rn FROM clustered) WHERE rn = 1""",
    "locus_segments": f"WITH {_KEPT}, {_clusters('kept', 250_000)}, {_loci()} SELECT * FROM loci",
    "locus_intervals": f"""WITH {_KEPT}, {_clusters('kept', 250_000)}, {_loci(300_000)}
        SELECT l.locus, k.TRAITID, {_snpid("k.")} AS SNPID, k.CHR, k.POS, k.MLOG10P
        FROM kept k JOIN loci l ON l.TRAITID = k.TRAITID AND l.CHR = k.CHR AND k.POS BETWEEN l.locus_start AND l.locus_end""",
    "locus_breaker": f"""WITH {_KEPT}, {_clusters('kept', 250_000)}, {_loci()}
        SELECT l.TRAITID, l.CHR, l.locus, l.locus_start, l.locus_end, l.SNPID, l.snp_MLOG10P, count(*) AS n_snps
        FROM kept k JOIN loci l ON l.TRAITID = k.TRAITID AND l.CHR = k.CHR AND k.POS BETWEEN l.locus_start AND l.locus_end GROUP BY ALL""",
    "locus_breaker_by_study": f"""WITH {_KEPT}, {_STUDIES}, {_clusters('kept', 100_000)}, {_loci()}
        SELECT s.project, s.study, count(*) AS n_loci, max(l.snp_MLOG10P) AS top, CAST(max(l.locus_end) AS INTEGER) AS last_end
        FROM loci l JOIN studies s USING (TRAITID) GROUP BY s.project, s.study""",
    "ivw_meta": f"""WITH {_SUMSTATS}, {_pooled()} SELECT {_snpid()} AS SNP, round(b, 6) AS BETA, round(se, 6) AS SE, n AS n_traits FROM i2""",
    "heterogeneity_i2": f"WITH {_SUMSTATS}, {_pooled()} SELECT {_snpid()} AS SNP, round(CAST(i_sq AS DOUBLE), 6) AS I_SQUARED FROM i2",
    "meta_z_p": f"""WITH {_SUMSTATS}, {_STUDIES}, {_CATALOG}, {_pooled("by_study", "project, study, CHR, POS, EA, NEA")},
        names AS (SELECT project, study, string_agg(data_id, '_' ORDER BY data_id) AS TRAITID FROM catalog GROUP BY ALL),
        z AS (SELECT *, b / se AS z, abs(b / se) AS a FROM i2)
        SELECT z.project, z.study, {_snpid("z.")} AS SNP, n2.TRAITID, round(b, 6) AS BETA, round(se, 6) AS SE, round({_p("a")}, 6) AS P,
               round(CAST(i_sq AS DOUBLE), 6) AS I_SQUARED, round(z, 6) AS Z_SCORE
        FROM z LEFT JOIN names n2 ON n2.project = z.project AND n2.study = z.study""",
    "grouped_meta": f"""WITH {_SUMSTATS}, {_STUDIES}, {_pooled("by_study", "project, study, CHR, POS, EA, NEA")},
        z AS (SELECT *, abs(b / se) AS a FROM i2)
        SELECT project, study, count(*) AS n_variants, count(*) FILTER (WHERE {_p("a")} < 0.05) AS n_nominal, round(max(b), 6) AS max_beta
        FROM z GROUP BY project, study""",
    "meta_with_copies": f"""WITH {_SUMSTATS}, {_pooled()} SELECT {_snpid()} AS SNP, round(b, 6) AS BETA, round(se, 6) AS SE, n AS n_traits FROM i2""",
    "pooling_report": f"""WITH {_SUMSTATS} SELECT TRAITID, CAST(2 * count(*) AS BIGINT) AS n_rows,
        CAST(2 * count(*) FILTER (WHERE EAF > 0.9) AS BIGINT) AS n_unpoolable, count(*) AS n_copies FROM sumstats GROUP BY TRAITID""",
    "meta_full_outer": f"""WITH {_SUMSTATS}, {_CATALOG},
        a AS (SELECT {_snpid()} AS SNP, BETA, SE FROM sumstats WHERE TRAITID = (SELECT min(data_id) FROM catalog)),
        b AS (SELECT {_snpid()} AS SNP, BETA, SE FROM sumstats WHERE TRAITID = (SELECT max(data_id) FROM catalog))
        SELECT SNP, a.BETA, a.SE, b.BETA AS BETA_1, b.SE AS SE_1 FROM a FULL OUTER JOIN b USING (SNP)""",
    "meta_full_outer_all": f"""WITH {_SUMSTATS} SELECT {_snpid()} AS SNP, CAST(count(*) AS INTEGER) AS n_traits, round(sum(BETA), 6) AS sum_beta
        FROM sumstats GROUP BY 1""",
    "aligned_effects": f"""WITH {_SUMSTATS}, {_STUDIES}, {_CATALOG},
        named AS (SELECT project, study, data_id, CAST(row_number() OVER (PARTITION BY project, study ORDER BY data_id) - 1 AS INTEGER) AS ordinal FROM catalog)
        SELECT b.project, b.study, {_snpid("b.")} AS SNP, n.ordinal, b.BETA, b.SE
        FROM by_study b JOIN named n ON b.project = n.project AND b.study = n.study AND b.TRAITID = n.data_id""",
    "meta_export": f"""WITH {_SUMSTATS}, {_STUDIES}, {_CATALOG},
        gwas AS (SELECT b.* FROM by_study b JOIN catalog c ON b.project = c.project AND b.study = c.study AND b.TRAITID = c.data_id
                 WHERE c.category = 'GWAS'),
        {_pooled("gwas", "project, study, CHR, POS, EA, NEA")},
        names AS (SELECT project, study, length(string_agg(data_id, '_' ORDER BY data_id)) AS label_length FROM catalog WHERE category = 'GWAS' GROUP BY ALL)
        SELECT z.project, z.study, {_snpid("z.")} AS SNP, round(b, 6) AS BETA, round(se, 6) AS SE, CAST(0 AS BIGINT) AS n_copies,
               CAST(label_length AS INTEGER) AS label_length
        FROM i2 z JOIN names n2 ON n2.project = z.project AND n2.study = z.study""",
    "stored_modify": f"""WITH {_CATALOG} SELECT project, study, data_id, CASE category WHEN 'GWAS' THEN 'GRCh38' ELSE build END AS build FROM catalog""",
    "stored_delete": f"WITH {_CATALOG} SELECT project, study, data_id, category FROM catalog WHERE category <> 'eQTL' AND project <> 'asia'",
    "to_catalog_row": f"""WITH {_CATALOG} SELECT project, study, data_id, category, build, pop1 || '|' || pop2 AS population,
        '{{"desc":"' || trait_desc || '","protein_ids":"' || trait_protein_ids || '"}}' AS trait,
        '{{"samples":"' || CAST(total_samples AS VARCHAR) || '"}}' AS total,
        '{{"source_id":"' || notes_source_id || '","consortium":' || coalesce('"' || notes_consortium || '"', 'null') || '}}' AS notes
        FROM catalog""",
    "validate_catalog": f"""WITH {_CATALOG} SELECT data_id,
        category <> 'eQTL' AND (build = 'GRCh37' OR length(study) * 50 <= 250) AS valid FROM catalog""",
    "catalog_upsert": f"""WITH {_INCOMING}
        SELECT project, study, data_id, category, build, trait_desc FROM changed
        UNION ALL SELECT 'added', study, data_id, category, build, trait_desc FROM changed WHERE category = 'eQTL'""",
    "catalog_lookup": f"WITH {_CATALOG} SELECT project, study, data_id FROM catalog",
    "catalog_modify": f"""WITH {_CATALOG} SELECT project, study, data_id, CASE category WHEN 'GWAS' THEN 'GRCh38' ELSE build END AS build,
        category = 'GWAS' AS updated FROM catalog""",
    "catalog_delete": f"WITH {_CATALOG} SELECT project, study, data_id, category FROM catalog WHERE category <> 'eQTL'",
    "search_catalog": f"""WITH {_CATALOG} SELECT project, study, category, data_id, notes_source_id, build, pop1 || '|' || pop2 AS population,
        notes_consortium, total_samples, trait_desc FROM catalog
        WHERE category = 'GWAS' AND build = 'GRCh37' AND (lower(trait_desc) LIKE '%red%' OR lower(trait_desc) LIKE '%bolt%')""",
    "search_template": f"""WITH {_CATALOG} SELECT project, study, category, data_id, notes_source_id, trait_desc FROM catalog
        WHERE project = 'asia' AND study = 'nation_17'""",
    "meta_query": f"""WITH {_CATALOG} SELECT project, study, category, data_id, notes_source_id, notes_consortium, total_samples FROM catalog
        WHERE lower(notes_consortium) LIKE '%brand#1%' AND CAST(total_samples AS VARCHAR) LIKE '%9%'""",
    "scalar_match": f"""WITH {_CATALOG} SELECT data_id, project, study FROM catalog
        WHERE (lower(pop1) = 'asia' OR lower(pop2) = 'asia') AND build = 'GRCh37'""",
    "data_ids_match": f"""WITH {_CATALOG} SELECT data_id, project, study FROM catalog
        WHERE data_id = (SELECT min(data_id) FROM catalog) OR data_id = (SELECT max(data_id) FROM catalog)""",
    "json_match": f"""WITH {_CATALOG}
        SELECT data_id, 'exact' AS mode FROM catalog WHERE lower(trait_desc) = 'red widget'
           OR (lower(trait_desc) = 'blue bolt' AND lower(trait_protein_ids) = 'economy|brand#4')
        UNION ALL SELECT data_id, 'part' FROM catalog
        WHERE (contains(trait_desc, 're') AND contains(trait_protein_ids, 'SMALL')) OR contains(trait_desc, 'gear')""",
    "any_of": f"WITH {_CATALOG} SELECT data_id, trait_desc FROM catalog WHERE trait_desc ILIKE '%red%' OR trait_desc ILIKE '%blue%'",
    "all_of": f"""WITH {_CATALOG} SELECT data_id, trait_desc FROM catalog WHERE category = 'GWAS'
        INTERSECT SELECT data_id, trait_desc FROM catalog WHERE trait_desc ILIKE '%red%'
        INTERSECT SELECT data_id, trait_desc FROM catalog WHERE notes_source_id ILIKE '%supplier%'""",
    "distinct_by_id": f"""WITH {_CATALOG}, matched AS (
        SELECT project, data_id FROM catalog WHERE trait_desc ILIKE '%e%' UNION SELECT project, data_id FROM catalog WHERE trait_desc ILIKE '%r%'
        UNION SELECT project, data_id FROM catalog WHERE trait_protein_ids ILIKE '%brand%')
        SELECT project, count(*) AS n, count(DISTINCT data_id) AS n_distinct FROM matched GROUP BY project""",
    "project_catalog": f"WITH {_CATALOG} SELECT data_id, trait_desc, total_samples, notes_source_id, CAST(NULL AS VARCHAR) AS trait_unit FROM catalog",
    "link_expand": f"WITH {_LINKED} SELECT * FROM linked",
    "link_id_concat": f"WITH {_LINKED} SELECT data_id, string_agg(DISTINCT link_id, '_' ORDER BY link_id) AS link_ids FROM linked GROUP BY data_id",
    "output_prefix": f"""WITH {_LINKED}
        SELECT project, study, data_id, 'out_' || project || '_' || study || '_' || coalesce(notes_consortium, data_id) AS output_prefix, 'plain' AS kind FROM catalog
        UNION ALL
        SELECT project, study, data_id, 'out_' || project || '_' || study || '_' || string_agg(DISTINCT link_id, '_' ORDER BY link_id) || '_' || min(notes_source_id), 'linked'
        FROM linked GROUP BY project, study, data_id""",
    "metadata_broadcast": f"""WITH {_SUMSTATS}, {_LINKED}, rec AS (
        SELECT data_id, min(notes_source_id) AS s, min(trait_protein_ids) AS t, string_agg(DISTINCT link_id, '_' ORDER BY link_id) AS l FROM linked GROUP BY data_id)
        SELECT TRAITID, CHR, POS, MLOG10P, s AS meta_notes_source_id, t AS meta_trait_protein_ids, l AS meta_link_id
        FROM sumstats JOIN rec ON TRAITID = data_id""",
    "catalog_tree": f"""WITH {_CATALOG} SELECT category, project, string_agg(DISTINCT study, ', ' ORDER BY study) AS studies
        FROM catalog WHERE category IN ('GWAS', 'pQTL') GROUP BY category, project""",
    "z_score": f"WITH {_SCORED} SELECT TRAITID, CHR, POS, EA, NEA, round(z, 6) AS z FROM scored",
    "norm_p_two_sided": f"WITH {_SCORED} SELECT TRAITID, CHR, POS, EA, NEA, round({_p('a')}, 6) AS p FROM scored",
    "mlog10p_from_z": f"""WITH {_SCORED}, tall AS (SELECT *, a * 4 AS a4 FROM scored)
        SELECT TRAITID, CHR, POS, EA, NEA, round({_mlog10p("a4")}, 6) AS mlog10p FROM tall""",
    "build_snpid": f"WITH {_DENSE} SELECT TRAITID, {_snpid()} AS SNPID FROM dense",
    "normalise_chr": """SELECT p_partkey, CAST(p_size AS INTEGER) AS chr, CAST(NULL AS INTEGER) AS "none", CAST(NULL AS INTEGER) AS letter FROM part""",
    "is_multiallelic": f"""WITH {_DENSE} SELECT TRAITID, {_snpid()} AS SNPID, greatest(length(EA), length(NEA)) > 1 AS by_allele,
        greatest(length(EA), length(NEA)) > 1 AS by_id FROM dense""",
    "valid_alleles": f"""WITH {_DENSE} SELECT TRAITID, {_snpid()} AS SNPID,
        CASE WHEN length(EA) = length(NEA) THEN EA <= NEA ELSE length(EA) > length(NEA) END AS valid FROM dense""",
    "harmonise_alleles": f"""WITH {_DENSE} SELECT TRAITID, CAST(CHR AS VARCHAR) || ':' || CAST(POS AS VARCHAR) || ':' ||
        CASE WHEN EA < NEA THEN EA || ':' || NEA ELSE NEA || ':' || EA END AS SNPID FROM dense""",
    "slug": "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part",
    "split_list": "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS items FROM part",
    "json_fold": """SELECT c_custkey, '{"key":"' || CAST(c_custkey AS VARCHAR) || '","segment":"' || c_mktsegment || '","none":' ||
        CASE WHEN c_acctbal > 0 THEN '"' || c_name || '"' ELSE 'null' END || '}' AS json FROM customer""",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "nested_key_find": """SELECT event_id, json_extract_string(props, '$.k') AS k, 'x' AS b, CAST(event_id AS VARCHAR) AS deep, '1' AS z,
        CAST(NULL AS VARCHAR) AS absent FROM events""",
    "locus_name": f"""WITH {_REGIONS} SELECT CAST(CHR AS VARCHAR) || ':' || CAST("START" AS VARCHAR) || ':' || CAST("END" AS VARCHAR) AS locus FROM regions""",
    "clip_low": f"""WITH {_REGIONS} SELECT CHR, CASE WHEN "START" - 500000 < 1 THEN 1 ELSE "START" - 500000 END AS "START" FROM regions""",
    "short_hash": "SELECT c_custkey, substr(sha256(c_name), 1, 10) AS id FROM customer",
    "ancestry_code": """SELECT c_custkey, CASE r_name WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'EAS' WHEN 'AMERICA' THEN 'AMR' END AS code,
        CASE r_name WHEN 'EUROPE' THEN 'European' WHEN 'ASIA' THEN 'East Asian' WHEN 'AMERICA' THEN 'Hispanic or Latin American' END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pheno_variance": f"""WITH {_SUMSTATS}, {_CATALOG}
        SELECT TRAITID, round(median(SE * SE * total_samples * 2 * EAF * (1 - EAF)), 6) AS pheno_variance
        FROM sumstats JOIN catalog ON TRAITID = data_id GROUP BY TRAITID""",
    "manhattan_table": f"""WITH {_SUMSTATS}, ends AS (SELECT CHR, max(POS) AS len FROM sumstats GROUP BY CHR)
        SELECT s.TRAITID, s.CHR, s.POS, s.MLOG10P, CAST(s.POS + coalesce((SELECT sum(len) FROM ends e WHERE e.CHR < s.CHR), 0) AS BIGINT) AS genome_pos,
               s.MLOG10P > 7.30103 AS above_threshold, s.MLOG10P > 5 AS above_suggestive FROM sumstats s""",
    "manhattan_bins": f"""WITH {_SUMSTATS} SELECT CHR, CAST(floor(POS / 1000000) AS INTEGER) AS bin, max(MLOG10P) AS max_mlog10p, count(*) AS n_variants
        FROM sumstats GROUP BY ALL""",
    "rsid_resolve": """WITH listed AS (SELECT c_custkey AS k, substr('ACGT', CAST(c_custkey % 4 + 1 AS INTEGER), 1) AS a,
          substr('GTAC', CAST(c_custkey % 3 + 1 AS INTEGER), 1) AS b FROM customer),
        placed AS (SELECT 'rs' || CAST(k AS VARCHAR) AS rsID, CAST(1 + p_partkey % 22 AS INTEGER) AS CHR, CAST(1 + p_partkey * 10 AS INTEGER) AS POS,
          CASE WHEN a < b THEN a ELSE b END AS EA, CASE WHEN a < b THEN b ELSE a END AS NEA FROM listed JOIN part ON p_partkey = k)
        SELECT *, CAST(CHR AS VARCHAR) || ':' || CAST(POS AS VARCHAR) || ':' || EA || ':' || NEA AS SNPID FROM placed""",
}
