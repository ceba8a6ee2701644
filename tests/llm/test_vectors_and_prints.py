"""Embeddings and edit fingerprints: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from statloom.llm.edit_embedding import fingerprints, likeness, likeness_table, near_texts, walk
from statloom.llm.embeddings import fit_tables, near_vectors, plan_tables, rotations, substrings
from tests.llm.conftest import documents, frame, odd_rows
from tests.llm.test_repeats import Classes


def brute_links(rows, cosine=0.95):
    usual = Counter(len(v) for _, v in rows if v and any(v) and all(x is not None and np.isfinite(x) for x in v)).most_common(1)[0][0]
    sound = [(i, np.array(v, float)) for i, v in rows if v and len(v) == usual and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    classes, links = Classes(), Counter()
    for k, (i, x) in enumerate(sound):
        classes.find(i)
        for j, y in sound[:k]:
            if x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
                links[i] += 1
                links[j] += 1
                classes.join(i, j)
    return {i: (links[i], classes.find(i)) for i, _ in rows}


def crowd(seed=1, dimension=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, dimension))
    rows = [(i, (centres[i % 20] + 0.05 * r.standard_normal(dimension)).tolist()) for i in range(300)]
    rows += [(1000 + i, r.standard_normal(dimension).tolist()) for i in range(200)]
    hot = centres[0] * 3
    return rows + [(2000 + i, hot.tolist()) for i in range(40)] + [(3000 + i, (hot + 0.02 * r.standard_normal(dimension)).tolist()) for i in range(400)]


def found_links(spark, rows):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, rep string, code string")
    out = near_vectors(df.repartition(3)).collect()
    assert len(out) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_links(spark):
    rows = crowd()
    found, want = found_links(spark, rows), brute_links(rows)
    recall = sum(n for n, _ in found.values()) / sum(n for n, _ in want.values())
    assert all(found[i][0] <= want[i][0] for i in want) and recall > 0.99
    assert {i: c for i, (_, c) in found.items()} == {i: c for i, (_, c) in want.items()}


def test_small_chunks_change_nothing(spark, monkeypatch):
    rows = crowd(2)
    whole = found_links(spark, rows)
    monkeypatch.setattr("statloom.llm.embeddings.CHUNK", 20)
    assert found_links(spark, rows) == whole


@pytest.mark.parametrize("bits", [16, 24])
def test_equal_codes_of_any_bytes_meet(spark, monkeypatch, bits):
    monkeypatch.setattr("statloom.llm.embeddings.SHORTEST", bits)
    monkeypatch.setattr("statloom.llm.embeddings.MISS", 0.5)
    x = np.random.default_rng(7).standard_normal((3000, 32))
    found = found_links(spark, [(2 * i + k, (v * [1, 1 + 1e-9][k] + k * 1e-13).tolist()) for i, v in enumerate(x) for k in (0, 1)])
    assert sum(found[i] != (1, i - i % 2) for i in found) <= 2


def test_odd_vectors(spark):
    v = [0.1, 0.2, -0.3, 0.4]
    rows = [(1, v), (2, v), (3, [10 * x for x in v]), (4, [0.0] * 4), (5, None), (6, []), (7, [0.1, None, 0.2, 0.1]), (8, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(9, [float("inf"), 1.0, 1.0, 1.0]), (10, [1.0, 1.0]), (11, [-x for x in v]), (12, [1e-300 * x for x in v]), (13, [1e300 * x for x in v])]
    found = found_links(spark, rows)
    assert {i for i, (n, _) in found.items() if n} == {1, 2, 3, 12, 13} and all(found[i] == (4, 1) for i in (1, 2, 3, 12, 13))
    assert all(found[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11))


def test_no_id_and_no_rows(spark):
    kind = "vec_id long, embedding array<double>"
    rows = near_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [3.0, -1.0])], kind)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in rows) == [("4", 1, "4", True), ("None", 0, "None", True), ("None", 1, "4", True)]
    assert near_vectors(spark.createDataFrame([], kind)).collect() == []
    assert near_vectors(spark.createDataFrame([(1, [0.0])], kind).union(spark.createDataFrame([(2, None)], kind)).limit(5)).count() == 2


def off_centre(share, vectors, pairs, seed=3, dimension=64):
    """Vectors whose mean cosine is `share`, then pairs of such at cosine 0.952, one after the other."""
    r = np.random.default_rng(seed)

    def flat(n, apart=None):
        x = r.standard_normal((n, dimension))
        x[:, 0] = 0
        x -= 0 if apart is None else apart * (x * apart).sum(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    lone, a = flat(vectors), flat(pairs)
    k = (0.952 - share) / (1 - share)
    both = np.stack([a, k * a + np.sqrt(1 - k * k) * flat(pairs, a)], axis=1).reshape(-1, dimension)
    return np.sqrt(1 - share) * np.concatenate([lone, both]) + np.sqrt(share) * np.eye(dimension)[0]


@pytest.mark.parametrize("share", [0.6, 0.8, 0.9])
def test_off_centre_links(spark, share):
    x = off_centre(share, 2000, 400)
    found = found_links(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(found[i][0] <= n for i, n in enumerate(links)) and sum(n for n, _ in found.values()) >= 0.99 * links.sum() >= 0.99 * 800


@pytest.mark.parametrize("share, dimension", [(0.0, 64), (0.6, 64), (0.8, 256)])
def test_recall_is_measured(share, dimension):
    x = off_centre(share, 20_000, 1500, dimension=dimension)
    bits, tables, turns = fit_tables(x[np.random.default_rng(1).permutation(len(x))[:10_000]], len(x))
    codes = substrings(x[20_000:], turns, bits, tables)
    assert bits > 0 and (codes[::2] == codes[1::2]).any(axis=1).mean() > 0.995


def test_rotations_are_rotations():
    sample = np.random.default_rng(1).standard_normal((500, 32)) @ np.diag(np.linspace(0.1, 3, 32))
    for _, p in rotations(sample, 2):
        assert np.allclose(p.T @ p, np.eye(32), atol=1e-8)
        signs = ((sample - sample.mean(0)) @ p >= 0).mean(axis=0)
        assert ((signs > 0.3) & (signs < 0.7)).all()


@pytest.mark.parametrize("n", [1, 100, 10**5, 10**9])
def test_plan(n):
    bits, tables, turns = plan_tables(n, 64)
    assert 8 <= bits <= 24 and turns * (64 // bits) >= tables


def check_prints(rows, found):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(found) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        mine = [r for r in found if r.doc_id == doc_id and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert mine and mine[0].n_chars == len(text)
        r = mine[0]
        assert r.near_edited == likeness(r.fingerprint.encode(), r.edited_fingerprint.encode())
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    by_text = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    return by_text


def test_prints_of_table(spark, monkeypatch):
    rows = documents(spark)
    found = fingerprints(frame(spark, rows).repartition(3)).collect()
    check_prints(rows, found)
    texts, prints = dict(rows), {}
    for r in found:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in found if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.6 and min(r.near_edited for r in long) > 0.5 and np.mean([r.near_next for r in long]) < 0.2
    monkeypatch.setattr("statloom.llm.edit_embedding.NEIGHBOURS", 7)
    monkeypatch.setattr("statloom.llm.edit_embedding.AT_ONCE", 3000)
    again = fingerprints(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_prints_of_odd_documents(odd):
    rows = [(i, t) for i, t in odd_rows() if i not in (15, None)]
    check_prints(rows, fingerprints(odd.where("doc_id IS NOT NULL AND doc_id <> 15")).collect())
    assert fingerprints(odd).count() == len(odd_rows())


@pytest.mark.parametrize("rows", [[(1, "abcdef")], [(1, None)], [(1, "")], [(None, "abc"), (None, "xyz")]])
def test_few_rows(spark, rows):
    found = fingerprints(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.near_next in (0.0, 1.0) or 0 <= r.near_next <= 1 for r in found)


def test_no_rows(nothing):
    assert fingerprints(nothing).collect() == []


def test_likeness_follows_edits(spark):
    r = random.Random(8)
    base = "".join(r.choice("abcdefghij klmnop") for _ in range(3000))
    rows = [(1000, base)]
    for k, edits in enumerate((3, 30, 150, 600)):
        text = list(base)
        for _ in range(edits):
            i = r.randrange(len(text))
            text[i : i + r.randint(0, 1)] = r.choice("abcdefghij") * r.randint(0, 2)
        rows.append((k, "".join(text)))
    prints = {x.doc_id: x.fingerprint.encode() for x in fingerprints(frame(spark, rows)).collect()}
    near = [likeness(prints[1000], prints[k]) for k in range(4)]
    assert near[0] > 0.9 > near[1] > near[2] > near[3] and near[1] > 0.6


def test_walk_goes_on_from_any_time():
    groups = np.random.default_rng(2).integers(0, 256, 400)
    whole, end = walk(groups, np.array([0]), np.array([400]), np.array([0]))
    later, stop = walk(groups[250:], np.array([0]), np.array([150]), whole[250:251].astype(np.int64))
    assert (whole[250:] == later).all() and end[0] == stop[0]


def test_near_texts(spark, odd, nothing):
    r, rows = random.Random(12), []
    for family in range(12):
        base = "".join(r.choice("abcdefghij klmnop") for _ in range(r.randint(200, 3000)))
        for k in range(6):
            text = list(base)
            for _ in range(len(text) // 500 * (k > 0)):
                i = r.randrange(len(text))
                text[i : i + r.randint(0, 1)] = r.choice("abcdefghij") * r.randint(0, 2)
            rows.append((family * 10 + k, "".join(text)))
        rows.append((1000 + family, "".join(r.choice("abcdefghij klmnop") for _ in range(1500))))
    found = {x.doc_id: x.class_id for x in near_texts(frame(spark, rows).repartition(3)).collect()}
    assert all(found[1000 + f] == 1000 + f for f in range(12))
    apart = sum(found[f * 10 + k] != f * 10 for f in range(12) for k in range(6))
    assert len(found) == len(rows) and apart <= 4
    classes = {x.doc_id: x.class_id for x in near_texts(odd).collect()}
    assert classes[17] == classes[2] == 1 and classes[3] == 1 and classes[5] == classes[4] and classes[11] == 10 and classes[13] == 13
    assert near_texts(nothing).collect() == []


def test_likeness_table():
    prints = [b"", b"0123", b"0123456789abcdef" * 8, b"0123456789abcdef" * 4 + b"-" * 64, b"f" * 64 + b"0" * 128]
    table = likeness_table(prints)
    assert all(table[i, j] == pytest.approx(likeness(a, b)) for i, a in enumerate(prints) for j, b in enumerate(prints))
