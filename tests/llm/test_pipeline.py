"""The five stages: each by itself, and all of them."""

from collections import Counter

import corpus_pipeline
from statloom.llm.dart_minhash import near_duplicates
from statloom.llm.substrings import remove_repeats
from statloom.llm.toxicity import toxicity
from tests.llm.conftest import SF_DIR, plain_words
from tests.llm.test_encoding import expected
from tests.llm.test_repeats import brute_classes, brute_repeats


def test_stages(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = kept[name][1]
        assert name == "bpe" or docs.columns == columns
    ids = {name: {r.doc_id for r in b.select("doc_id").collect()} if name != "bpe" else None for name, (_, b) in kept.items()}

    before, _ = kept["toxicity"]
    rejected = {r.doc_id for r in toxicity(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert ids["toxicity"] == {r.doc_id for r in before.select("doc_id").collect()} - rejected

    before, _ = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids["near_duplicates"] == set(brute_classes(rows).values())
    assert near_duplicates(before).where("kept").count() == len(ids["near_duplicates"])

    before, after = kept["repeated_passages"]
    want = brute_repeats([(r.doc_id, r.text) for r in before.collect()])
    texts = {r.doc_id: r for r in after.collect()}
    originals = {r.doc_id: r.text for r in before.collect()}
    for doc_id, (_, gone, left) in want.items():
        if gone and not left:
            assert doc_id not in texts
        else:
            assert texts[doc_id].text == (left if gone else originals[doc_id]) and texts[doc_id].n_chars == len(texts[doc_id].text)
    assert remove_repeats(before).count() == before.count()

    before, after = kept["mixing"]
    sizes = {r.doc_id: len(plain_words(r.text)) for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert set(times) <= set(sizes) and all(n <= 2 for n in times.values())
    assert all(times[d] >= 1 for d, n in sizes.items() if n == 0)
    taken = sum(sizes[d] * n for d, n in times.items())
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())

    before, after = kept["bpe"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(map(tuple, after.collect()), key=str) == expected(Tokenizer.from_file(path("byte_bpe_50k.json")), rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
