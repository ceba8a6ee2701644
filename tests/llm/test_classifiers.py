"""Toxicity and licences: held-out accuracy, and the rules around the models."""

import random
import zlib

import numpy as np
import pytest

from statloom.llm.licences import TEMPLATES, Scanner, scan
from statloom.llm.toxicity import Model, fit, label_model, score_documents, toxicity, without_toxic
from tests.llm.conftest import frame, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def made(spark):
    """900 documents in three made-up languages, a third of them with insults of their language."""
    r, rows, labels = random.Random(5), [], []
    bad = [["idiot", "scum", "moron"], [f"grotz{e}" for e in ("en", "er", "ung", "lich")], [f"vlim{e}" for e in ("a", "o", "ente")]]
    for i in range(900):
        words = prose(1000 + i, r.randint(20, 200)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(bad[i // 3 % 3]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic), "clashing"))
    return frame(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS), {i: t for i, _, t, _ in labels}


def test_held_out_accuracy(made):
    docs, labels, truth = made
    rows = toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    clean = without_toxic(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_held_out_labels_teach_nothing(made, spark):
    docs, labels, truth = made
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, "") for i, t in truth.items()]
    other = spark.createDataFrame(flipped, LABELS)
    a, b = fit(docs, labels), fit(docs, other)
    assert a.terms == b.terms and a.intercept == b.intercept


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "")], [(1, None, None, ""), (None, 1, 1, "")], [(21, 1, 1, ""), (1, 1, 1, "")]])
def test_few_labels_leave_the_lexicon(odd, spark, labels):
    rows = toxicity(odd, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(odd_rows())
    scores = {r.doc_id: r.score for r in rows}
    assert scores[21] > 0.5 and all(s < 0.5 for i, s in scores.items() if i != 21)
    assert not any(r.held_out for r in rows if r.doc_id is None)


def test_no_documents(nothing, made):
    assert toxicity(nothing, made[1]).collect() == [] and score_documents(nothing, Model()).collect() == []


def test_label_model_finds_accuracies():
    """Five voters of known accuracy, one of them copied twice: the copies share their weight."""
    r = np.random.default_rng(3)
    truth = r.random(6000) < 0.3
    accuracy = (0.9, 0.8, 0.75, 0.7, 0.6)
    votes = np.stack([np.where(r.random(6000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    votes = np.hstack([votes, votes[:, 4:], votes[:, 4:]]).astype(float)
    start = np.where(votes[:, :5].sum(axis=1) > 0, 0.8, 0.2)
    posterior, chances, share = label_model(votes, start)
    assert ((posterior > 0.5) == truth).mean() > 0.9
    assert abs(chances[1, 0, 2] - 0.9) < 0.06 and abs(chances[0, 1, 0] - 0.8) < 0.06
    assert share[4] < 0.5 < share[0]


@pytest.fixture(scope="module")
def licensed(spark):
    rows = [(i, prose(3000 + i, 60) + ".\n" + prose(4000 + i, 30)) for i in range(80)]
    for k, (family, texts) in enumerate(sorted(TEMPLATES.items())):
        rows.append((1000 + k, prose(5000 + k, 40) + "\n" + texts[0] + "\n" + prose(6000 + k, 10)))
    rows += [
        (2001, "The old driver must carry a valid licence for the truck at all times."),
        (2002, "Please see the warranty of your new kitchen for details."),
        (2003, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."),
        (2004, "This project was released under the MIT License by its author."),
        (2005, ""),
        (2006, None),
        (2003, "Licensed under CC BY-NC 4.0."),
        (None, "Released under the MIT License."),
        (2007, "Copyright copyright COPYRIGHT licence licence permission"),
        (2008, prose(7000, 3000) + ". Released under the MIT License. " + prose(7001, 3000)),
    ]
    return frame(spark, rows).repartition(3), rows


def test_families(licensed):
    docs, rows = licensed
    found = scan(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].families == "" and by_id[i].family is None and by_id[i].probability == 0 for i in (*range(80), 2001, 2002, 2005, 2006, 2007))
    families = [by_id[1000 + k].families for k in range(len(TEMPLATES))]
    assert families == sorted(TEMPLATES)
    assert by_id[2003].families == "apache,cc-by-nc,mit" and by_id[2003].n_licences == 3
    assert by_id[2004].families == by_id[None].families == by_id[2008].families == "mit"
    assert all(r.probability > 0.5 for r in found if r.family)


def test_notices_without_cue_words(licensed, spark):
    notices = [
        ("cc-by-sa", "Text is available under CC BY-SA 4.0."),
        ("cc-by", "Available under CC BY 4.0."),
        ("mit", "in the Software without restriction, including without limitation the rights"),
        ("mit", "to use, copy, modify, merge, publish, distribute,"),
        ("", "He kept a copy of the old map in a drawer."),
        ("", "This is the end of the story, said the author."),
    ]
    rows = [(i, prose(8000 + i, 30) + "\n" + t + "\n" + prose(8100 + i, 20)) for i, (_, t) in enumerate(notices)]
    found = {r.doc_id: r for r in scan(licensed[0].unionByName(frame(spark, [(3000 + i, t) for i, t in rows]))).collect()}
    assert [found[3000 + i].families for i in range(len(notices))] == [f for f, _ in notices]
    assert all(found[3000 + i].n_licences == found[3000 + i].n_paragraphs == 1 for i, (f, _) in enumerate(notices) if f)


def test_odd_documents(odd, nothing):
    rows = scan(odd).collect()
    assert len(rows) == len(odd_rows()) and {r.doc_id for r in rows if r.families} == {22}
    assert scan(nothing).collect() == []


def test_calibration(licensed, spark):
    scanner = Scanner(spark, licensed[0].select("doc_id", "text"))
    assert 0.2 < scanner.temperature < 40 and 0.5 <= scanner.least <= 0.95
