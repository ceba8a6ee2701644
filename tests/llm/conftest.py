"""Small documents with everything that can be odd about them."""

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASHING = ("key", "size", "bucket", "block", "root", "rep", "words", "shard", "ids", "packed", "_h", "_at", "target", "score", "h1", "a", "b", "kept", "slot")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, n: int) -> str:
    """Distinct-looking prose: few words repeat."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 55)
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, "   \n\t "),
        (7, prose(3, 40) + "\n" + passage + "\n" + prose(4, 30)),
        (8, prose(5, 10) + " " + passage + " " + prose(6, 9)),
        (9, passage + " " + passage),
        (10, "one two three"),
        (11, "one two three"),
        (12, "naïve café 日本語 😀😀 <|endoftext|> </s> <unk> it's we'll  two  blanks\r\n\ttab\x0b\x0c end "),
        (13, prose(7, 30_000)),
        (14, "x" * 50_000),
        (15, "same " * 500),
        (15, "same " * 500),
        (17, base),
        (None, prose(8, 50)),
        (None, None),
        (-5, prose(9, 25)),
        (2**40, "ﬁne ² ½ Ⅷ ٣ ∑ é é ​﻿"),
        (21, "You are a stupid idiot and a pathetic loser."),
        (22, "Released under the MIT License.\n" + prose(10, 20)),
    ]


def frame(spark, rows):
    sources = ("a", "b", None, "a", "z")
    full = [(i, t, None if k % 7 == 3 else "en", sources[k % 5], None if t is None else len(t), *(f"{c}{k}" for c in CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark) -> list[tuple[int, str]]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
