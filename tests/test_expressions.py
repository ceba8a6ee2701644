import hashlib
import math

import pytest
from pyspark.sql import functions as F

from statloom.functions import normal, text, variants


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_mlog10p_table(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-3.0,)], "z double")
    got = [r[0] for r in rows.select(normal.mlog10p_from_z(F.col("z"))).collect()]
    assert got == pytest.approx([0.0, 0.498516, 1.341986, 2.568669], abs=1e-6)


def test_p_value_follows_erfc(spark):
    zs = [0.0, 0.1, 0.5, 1.0, 1.96, 3.0, 5.0, 6.9, 7.0710678, 7.1, 8.5, 12.0, 20.0, 36.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p, m in rows.select("z", normal.norm_p_two_sided(F.col("z")), normal.mlog10p_from_z(-F.col("z"))).collect():
        exact = math.erfc(z / math.sqrt(2))
        assert p == pytest.approx(exact, rel=1e-8)
        assert m == pytest.approx(-math.log10(exact) if exact < 1 else 0.0, abs=1e-8)


def test_mlog10p_stays_finite(spark):
    value = one(spark, normal.mlog10p_from_z(F.lit(100.0)))
    assert value == pytest.approx(2173.8, abs=0.5)


def test_z_score_guards_zero_and_null(spark):
    rows = spark.createDataFrame([(0.1, 0.05), (0.1, 0.0), (None, 0.1)], "b double, s double")
    assert [r[0] for r in rows.select(normal.z_score(F.col("b"), F.col("s"))).collect()] == [2.0, None, None]


@pytest.mark.parametrize(
    "text_in, number",
    [("chr1", 1), ("X", 23), ("Y", 24), ("chrX", 23), ("CHRy", 24), ("chrM", None), ("22", 22), ("1_alt", None), ("", None),
     ("99999999999", None)],
)
def test_normalise_chr(spark, text_in, number):
    assert one(spark, variants.normalise_chr(F.lit(text_in))) == number


def test_snpid(spark):
    assert one(spark, variants.snpid(F.lit(1), F.lit(1000), F.lit("A"), F.lit("C"))) == "1:1000:A:C"
    assert one(spark, variants.snpid(F.lit(1), F.lit(1000), F.lit(None).cast("string"), F.lit("C"))) is None
    assert one(spark, variants.harmonised_snpid(F.lit(1), F.lit(5), F.lit("T"), F.lit("C"))) == "1:5:C:T"


def test_multiallelic(spark):
    assert one(spark, variants.is_multiallelic(F.lit("AT"), F.lit("A"))) is True
    assert one(spark, variants.is_multiallelic_id(F.lit("1:5:A:C"))) is False
    assert one(spark, variants.is_multiallelic_id(F.lit("1:5:A:CT"))) is True
    with pytest.raises(Exception, match="not a CHR:POS:EA:NEA id"):
        one(spark, variants.is_multiallelic_id(F.lit("1:5:A")))


@pytest.mark.parametrize("ea, nea, ok", [("A", "C", True), ("C", "A", False), ("A", "A", True), ("AT", "A", True), ("A", "AT", False)])
def test_valid_alleles(spark, ea, nea, ok):
    assert one(spark, variants.valid_alleles(F.lit(ea), F.lit(nea))) is ok


def test_text_helpers(spark):
    assert one(spark, text.slug(F.lit("My Big Study"))) == "my_big_study"
    assert one(spark, text.split_list(F.lit(" a, b ,c"))) == ["a", "b", "c"]
    assert one(spark, text.short_hash(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()[:10]
    assert one(spark, text.short_hash(F.lit("abc"), None)) == hashlib.sha256(b"abc").hexdigest()
    folded = text.json_fold({"a": F.lit(1), "b": F.lit(None)})
    assert one(spark, folded) == {"a": "1", "b": None}
    assert one(spark, text.json_text(folded)) == '{"a":"1","b":null}'
    assert one(spark, text.json_field(F.lit('{"desc": "x"}'), "desc")) == "x"


@pytest.mark.parametrize(
    "doc, key, value",
    [
        ('{"a": 1, "b": {"a": 2}}', "a", "1"),
        ('{"x": {"y": {"k": "deep"}}, "z": {"k": "later"}}', "k", "deep"),
        ('{"x": {"q": null}, "z": {"q": "found"}}', "q", "found"),
        ('{"x": [1, 2], "y": "text"}', "none", None),
        ('{"a": {"b": {"c": {"d": {"k": "five"}}}}}', "k", "five"),
        ('{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"k": "eight"}}}}}}}, "z": {"k": "late"}}', "k", "eight"),
        ('{"a{": "}}{{", "b": {"k": "quoted \\" brace {"}}', "k", 'quoted " brace {'),
    ],
)
def test_nested_key(spark, doc, key, value):
    df = spark.createDataFrame([(doc,), (None,), ("{}",)], "doc string")
    found = {r.doc: r.found for r in text.with_nested_keys(df, "doc", {"found": key}).collect()}
    assert found == {doc: value, None: None, "{}": None}


def test_nested_key_never_passes_over_a_level(spark):
    deep = F.lit('{"a": {"b": {"k": 1}}}')
    assert one(spark, text.json_depth(deep)) == 3 and one(spark, text.nested_key(deep, "k", 3)) == "1"
    with pytest.raises(Exception, match="deeper"):
        one(spark, text.nested_key(deep, "k", 2))


def test_ancestry(spark):
    for given, code in (("European", "EUR"), ("eur", "EUR"), (" NR ", "NR"), ("Martian", None), ("sub-saharan african", "SAF")):
        assert one(spark, text.ancestry_code(F.lit(given))) == code
    assert one(spark, text.ancestry_name(F.lit("isl"))) == "Icelandic"
