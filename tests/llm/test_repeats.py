"""Near duplicates, repeated passages and components: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from statloom.llm.dart_minhash import keep_one_of_each, near_duplicates, regions, shingles, signatures
from statloom.llm.graph import components
from statloom.llm.substrings import anchors, remove_repeats, repeats, without_repeats
from tests.llm.conftest import documents, frame, odd_rows, plain_words, prose


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_classes(rows, similarity=0.8):
    """Smallest doc_id of what links of similar shingle sets reach."""
    classes, sets = Classes(), []
    for doc_id, text in rows:
        if doc_id is None:
            continue
        w = tuple(plain_words(text))
        sets.append((doc_id, w, {w[i : i + 5] for i in range(len(w) - 4)} or {w}))
        classes.find(doc_id)
    for i, (a, w, s) in enumerate(sets):
        for b, v, t in sets[:i]:
            if w == v or (w and v and len(s & t) >= similarity * len(s | t) - 1e-9):
                classes.join(a, b)
    return {d: classes.find(d) for d, _, _ in sets}


def found_classes(df):
    rows = near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in rows)
    return rows, {r.doc_id: r.class_id for r in rows if r.doc_id is not None}


def test_odd_documents(odd):
    rows, classes = found_classes(odd)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd_rows())
    assert classes == brute_classes(odd_rows())
    assert classes[3] == classes[17] == 1 and all(r.class_id is None for r in rows if r.doc_id is None)


def test_table(spark):
    rows = documents(spark)
    assert found_classes(frame(spark, rows))[1] == brute_classes(rows)


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"edit{seed}x{i}"
    return out


def test_many_near_copies_around_one(spark):
    """Copies are near the middle one, but mostly not near each other; and a second crowd that nothing links."""
    base = prose(50, 150).split()
    rows = [(1000, " ".join(base))] + [(i, " ".join(edited(base, 2, i))) for i in range(150)]
    rows += [(5000 + i, " ".join(edited(prose(51, 100).split(), 6, i))) for i in range(60)]
    random.Random(1).shuffle(rows)
    found = found_classes(frame(spark, rows).repartition(4))[1]
    want = brute_classes(rows)
    assert found == want and len({want[i] for i in range(150)}) == 1


def test_same_id_joins_classes(spark):
    rows = [(7, prose(60, 30)), (7, prose(61, 30)), (9, prose(61, 30)), (3, prose(62, 30))]
    assert found_classes(frame(spark, rows))[1] == {7: 7, 9: 7, 3: 3}


def test_keep_one(odd):
    kept = keep_one_of_each(odd)
    ids = [r.doc_id for r in kept.collect()]
    want = brute_classes(odd_rows())
    assert kept.columns == odd.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values()})


def test_empty_tables(nothing):
    assert near_duplicates(nothing).collect() == [] and keep_one_of_each(nothing).collect() == []
    assert remove_repeats(nothing).collect() == [] and without_repeats(nothing).collect() == []


def test_signatures_agree_like_the_weighted_jaccard():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], r.integers(0, 2**63, 60).astype(np.uint64), a[:100]])  # 100 elements weigh 2
    for weighted, similarity in ((False, 240 / 360), (True, 240 / (300 + 400 - 240))):
        x, y = (regions(e, np.zeros(len(e), np.int64)) if weighted else e for e in (a, b))
        both = signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, 4096)
        assert abs((both[0] == both[1]).mean() - similarity) < 0.04
    assert (signatures(a[:1], np.zeros(1, np.int64), 2, 64)[0] != ~np.uint64(0)).all()


def test_shingles_of_short_rows():
    words = np.arange(1, 12, dtype=np.uint64)
    hashes, row = shingles(words, np.array([0, 3, 3, 11]))
    assert row.tolist() == [0, 2, 2, 2, 2] and len(set(hashes.tolist())) == 5


def test_components(spark):
    r, classes = random.Random(2), Classes()
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000 + i, 9000) for i in range(300)] + [(3, 3)]
    for a, b in links:
        classes.join(a, b)
    found = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: classes.find(n) for n in classes.up if classes.find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, window=20):
    """By row: words kept after every window that starts earlier elsewhere is removed."""
    seen, out = {}, {}
    for doc_id, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        w = plain_words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[i : i + window]), (doc_id, i))
            if first != (doc_id, i):
                gone[i : i + window] = [True] * window
        out[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    for doc_id, text in rows:
        if doc_id is None:
            out.setdefault(None, []).append((len(plain_words(text)), 0, " ".join(plain_words(text))))
    return out


def check_repeats(df, rows):
    want = brute_repeats(rows)
    found = [tuple(r) for r in remove_repeats(df).collect()]
    assert len(found) == len(rows)
    for doc_id, *rest in found:
        assert tuple(rest) in want[None] if doc_id is None else tuple(rest) == want[doc_id]


def test_repeats_of_odd_documents(odd):
    check_repeats(odd, odd_rows())


def test_repeats_of_table(spark):
    rows = documents(spark)
    check_repeats(frame(spark, rows), rows)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_cuts(spark, seed):
    """Documents made of shared pieces, whose edges fall anywhere, over few words."""
    r = random.Random(seed)
    pieces = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pieces)
            a = r.randint(0, len(p) - 1)
            words += p[a : r.randint(a, len(p))] + [f"w{r.randint(0, 30)}"] * r.randint(0, 2)
        rows.append((r.randint(-500, 500) * 100 + i, r.choice((" ", "\n", "  ")).join(words)))
    check_repeats(frame(spark, rows).repartition(3), rows)


def test_one_passage_everywhere(spark):
    passage = prose(70, 60)
    rows = [(i, prose(100 + i, 15) + " " + passage + " " + prose(900 + i, 15)) for i in range(120)]
    check_repeats(frame(spark, rows), rows)
    spans = Counter(r.doc_id for r in repeats(frame(spark, rows)).collect())
    assert 0 not in spans and len(spans) == 119


def test_other_windows(spark):
    rows = [(1, "a b c d e f g h"), (2, "x c d e f y"), (3, "b c d")]
    found = {r.doc_id: r.kept for r in remove_repeats(frame(spark, rows), window=3, anchor=2).collect()}
    assert found == {1: "a b c d e f g h", 2: "x y", 3: ""}


def test_cleaned_documents(odd):
    out = without_repeats(odd)
    rows = {(r.doc_id, r.text) for r in out.collect()}
    want = brute_repeats(odd_rows())
    assert out.columns == odd.columns
    expected = set()
    for doc_id, text in odd_rows():
        if doc_id is None or not want[doc_id][1]:
            expected.add((doc_id, text))
        elif want[doc_id][2]:
            expected.add((doc_id, want[doc_id][2]))
    assert rows == expected


def test_anchors_cover_all_windows():
    words = np.random.default_rng(3).integers(0, 4, 500).astype(np.uint64)
    row, at, lo, hi, _, _ = anchors(words, np.array([0, 30, 45, 500]), 20, 6)
    covered = sorted(w for a, b in zip(lo, hi) for w in range(a, b + 1))
    assert covered == [*range(0, 11), *range(45, 481)] and set(row.tolist()) == {0, 2}
    assert ((at >= hi) & (at <= lo + 14)).all()


def test_digest(spark):
    from statloom.llm.queries import op7_substrings
    from tests.llm.conftest import SF_DIR

    want = brute_repeats(documents(spark))
    for r in op7_substrings(spark, SF_DIR).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
