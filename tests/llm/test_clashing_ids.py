"""Rows that share a doc_id but not the text, and vectors of several lengths: nothing is lost, nothing fails."""

import numpy as np

from statloom.llm.bpe import decoded_documents
from statloom.llm.dart_minhash import keep_one_of_each, near_duplicates
from statloom.llm.edit_embedding import fingerprints
from statloom.llm.embeddings import near_vectors
from statloom.llm.mixing import mix
from statloom.llm.substrings import remove_repeats, without_repeats
from tests.llm.conftest import frame, plain_words, prose


def clashing():
    base, passage = prose(21, 150), prose(22, 40)
    near = base.split()
    near[70] = "changed"
    return [(5, base), (9, " ".join(near)), (9, prose(23, 60)), (9, passage + " tail"), (11, prose(24, 40) + " " + passage), (9, prose(23, 60)), (12, "few words")]


def test_near_duplicates(spark):
    df = frame(spark, clashing()).repartition(3)
    classes = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert classes == {5: 5, 9: 5, 11: 11, 12: 12}
    kept = sorted((r.doc_id, r.text) for r in keep_one_of_each(df).collect())
    rows = clashing()
    assert kept == sorted([rows[0], rows[2], rows[3], rows[4], rows[6]])


def test_repeats(spark):
    rows = clashing()
    df = frame(spark, rows).repartition(3)
    found = {(r.doc_id, r.n_words): r for r in remove_repeats(df).collect()}
    assert len(remove_repeats(df).collect()) == len(rows)
    first = plain_words(rows[0][1])
    assert found[5, 150].n_removed == 0 and found[9, 150].kept == "changed" and found[9, 60].n_removed == 0
    assert found[9, 41].n_removed == 0 and found[11, 80].kept == prose(24, 40) and len(first) == 150
    texts = sorted(r.text for r in without_repeats(df).collect())
    assert texts == sorted([rows[0][1], "changed", rows[2][1], rows[2][1], rows[3][1], prose(24, 40), rows[6][1]])


def test_other_operators_keep_every_row(spark):
    from public_tokenizers import path

    rows = clashing()
    df = frame(spark, rows).repartition(3)
    ids = sorted(i for i, _ in rows)
    assert sorted(r.doc_id for r in mix(df).collect()) == ids
    assert sorted(r.doc_id for r in fingerprints(df).collect()) == ids
    assert sorted(r.doc_id for r in decoded_documents(df, path("byte_bpe_50k.json")).collect()) == ids


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(4)
    long = [(i, r.standard_normal(16).tolist()) for i in range(300)]
    long += [(1000 + i, [x * 2 for x in v]) for i, v in long[:50]]
    short = [(2000 + i, [1.0, 2.0, 3.0 + 0.01 * i]) for i in range(3)] + [(3000, [1.0, -2.0])]
    df = spark.createDataFrame(long + short, "vec_id long, embedding array<double>").repartition(3)
    found = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(df).collect()}
    assert all(found[1000 + i] == (1, i) == found[i] for i in range(50)) and all(found[i] == (0, i) for i in range(50, 300))
    assert [found[2000 + i] for i in range(3)] == [(2, 2000)] * 3 and found[3000] == (0, 3000)
