"""Expressions on names, ids, lists and the JSON columns of the catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.schemas import ANCESTRIES, BUCKETS

HASH_LENGTH = 10


def slug(text: Column) -> Column:
    """Lower case, blanks to underscores."""
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def split_list(text: Column) -> Column:
    """Comma-separated text to a list of trimmed items; null stays null."""
    return F.transform(F.split(text, ","), lambda item: F.trim(item))


def short_hash(text: Column, length: int | None = HASH_LENGTH) -> Column:
    """SHA-256 in hex, cut to `length` digits."""
    digest = F.sha2(text, 256)
    return digest if length is None else F.substring(digest, 1, length)


def trait_bucket(trait: Column) -> Column:
    """Bucket of the stored table that holds a trait: a partition column, so the rule must never change for stored tables."""
    return F.pmod(F.xxhash64(trait.cast("string")), F.lit(BUCKETS)).cast("int")


def file_hash(name: Column, content: Column, length: int | None = HASH_LENGTH) -> Column:
    """Id of a file: the hash of the hash of its name followed by the hash of its bytes."""
    return short_hash(F.concat(F.sha2(name, 256), F.sha2(content, 256)), length)


def json_fold(fields: dict[str, Column]) -> Column:
    """Named columns to one text map; a null stays in the map as a null value."""
    if not fields:
        return F.create_map().cast("map<string,string>")
    pairs = [c for name, value in fields.items() for c in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def json_text(mapping: Column) -> Column:
    """A text map as JSON text, nulls kept."""
    return F.to_json(mapping, {"ignoreNullFields": "false"})


def json_field(json: Column, name: str) -> Column:
    """One top-level field of a JSON object held as text."""
    return F.from_json(json, "map<string,string>")[name]


def json_depth(json: Column) -> Column:
    """How deep objects and lists are nested in a JSON text; 0 for a plain value or null."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^{}\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        change = F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct((state["now"] + change).alias("now"), F.greatest(state["most"], state["now"] + change).alias("most"))

    return F.coalesce(F.aggregate(marks, start, step)["most"], F.lit(0))


def nested_key(json: Column, name: str, depth: int) -> Column:
    """First value found under `name`, searching an object before the objects inside it.

    `depth` levels are opened, at least as many as the data has (see `with_nested_keys`, which measures it);
    deeper objects are an error, never passed over. Every object is parsed once: it is
    bound as the single element of an array.
    """
    opened = F.array(F.from_json(json, "map<string,string>"))

    def search(fields: Column) -> Column:
        objects = F.filter(F.map_values(fields), lambda v: F.ltrim(v).startswith("{"))
        if depth <= 1:
            too_deep = F.raise_error(F.lit(f"objects are nested deeper than the levels searched for {name}")).cast("string")
            return F.when(F.map_contains_key(fields, name), fields[name]).when(F.size(objects) > 0, too_deep)
        found = F.filter(F.transform(objects, lambda v: nested_key(v, name, depth - 1)), lambda v: v.isNotNull())
        return F.when(F.map_contains_key(fields, name), fields[name]).otherwise(F.try_element_at(found, F.lit(1)))

    return F.transform(opened, search)[0]


def with_nested_keys(df: DataFrame, json: str, names: Mapping[str, str]) -> DataFrame:
    """Add a column per (new column: key) with the first value under the key, at whatever depth it lies.

    One small aggregation measures how deep the texts are nested.
    """
    depth = df.agg(F.max(json_depth(F.col(json)))).first()[0] or 1
    return df.withColumns({column: nested_key(F.col(json), key, max(depth, 1)) for column, key in names.items()})


def ancestry_code(text: Column) -> Column:
    """Full ancestry name or short code to the short code; unknown text gives null."""
    lookup = {name.lower(): code for code, name in ANCESTRIES.items()}
    lookup |= {code.lower(): code for code in ANCESTRIES}
    table = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(text)))


def ancestry_name(code: Column) -> Column:
    """Short code to the full ancestry name."""
    table = F.create_map(*[F.lit(x) for pair in ANCESTRIES.items() for x in pair])
    return F.try_element_at(table, F.upper(F.trim(code)))
