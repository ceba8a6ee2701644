"""Column names, types, domains and allowed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names, types and domains of the summary-statistics table ---
DIMENSIONS = ("CHR", "TRAITID", "POS")
ATTRIBUTES = ("BETA", "SE", "EAF", "EA", "NEA", "MLOG10P")
CHR_DOMAIN = (1, 24)
POS_DOMAIN = (1, 250_000_000)
INPUT_TYPES = {
    "CHR": "int",
    "POS": "int",
    "EA": "string",
    "NEA": "string",
    "EAF": "float",
    "SE": "float",
    "BETA": "float",
    "MLOG10P": "float",
}

# --- fixed values: catalog columns and the manifest's typed columns ---
JSON_COLUMNS = ("trait", "total", "notes")
LIST_COLUMNS = ("tags", "population", "references")
REQUIRED_MANIFEST_COLUMNS = ("project", "study", "file_path", "category")
MANIFEST_TYPES = {
    "total_samples": "bigint",
    "total_cases": "bigint",
    "total_controls": "bigint",
}
GROUP_COLUMNS = ("project", "study")
#: The stored table's last partition column: a hash of TRAITID, so that a choice of traits reads their buckets only.
BUCKET, BUCKETS = "trait_bucket", 16
CATALOG_KEY = ("project", "study", "data_id")
SOURCE_ID = "notes_source_id"
DEFAULT_OUTPUT = ("project", "study", "category", "data_id", SOURCE_ID)
MAX_TEXT = 250
MAX_TAG = 50

# --- fixed values: allowed categories and genome builds ---
CATEGORIES = ("GWAS", "pQTL", "eQTL", "Single-cell", "scientific_article")
BUILDS = ("GRCh37", "GRCh38")

# --- fixed values: ancestry short codes and full names ---
ANCESTRIES = {
    "AUS": "Aboriginal Australian",
    "AFA": "African American or Afro-Caribbean",
    "AFR": "African unspecified",
    "ASN": "Asian unspecified",
    "CAS": "Central Asian",
    "EAS": "East Asian",
    "EUR": "European",
    "MDE": "Greater Middle Eastern (Middle Eastern, North African, or Persian)",
    "AMR": "Hispanic or Latin American",
    "ISL": "Icelandic",
    "NR": "NR",
    "NAM": "Native American",
    "OCE": "Oceanian",
    "OTH": "Other",
    "ADM": "Other admixed ancestry",
    "SAS": "South Asian",
    "SEA": "South East Asian",
    "SAF": "Sub-Saharan African",
}

_text_map = T.MapType(T.StringType(), T.StringType())

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("study", T.StringType()),
        T.StructField("data_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("build", T.StringType()),
        T.StructField("trait", _text_map),
        T.StructField("total", _text_map),
        T.StructField("notes", _text_map),
        T.StructField("population", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("modification_date", T.TimestampType()),
    ]
)

def input_columns(with_pvalue: bool = True) -> list[str]:
    """Columns a summary-statistics file must hold; MLOG10P only when p-values are ingested."""
    return [c for c in INPUT_TYPES if with_pvalue or c != "MLOG10P"]


def trait_keys(columns) -> list[str]:
    """The columns that name one trait: project and study where present, then TRAITID."""
    return [c for c in GROUP_COLUMNS if c in columns] + ["TRAITID"]
