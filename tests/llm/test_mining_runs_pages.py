"""Hard negatives, periodic runs and main texts: against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import hard_negatives as mining
from statloom.llm.main_text import extract_main_text, fit, main_text, minimum_cut
from statloom.llm.page_model import blocks_of
from statloom.llm.periodic import find_runs, periodic_runs, run_digests, with_planted_runs
from statloom.llm.queries import op11_hard_negatives, op12_periodic_runs, op13_main_text
from tests.llm.conftest import SF_DIR, documents, frame, odd_rows, plain_words, prose

# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, every, scale=256, positives=5, negatives=3, low=50, high=95):
    """Rows of (id, label, vector); each a row of its own unless all three are equal."""
    sound = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * float(np.float64(x))) for x in v]
        if sum(x * x for x in whole) < 2**62:
            sound[i, label, tuple(v)] = whole
    out = []
    for key, anchor in sound.items():
        if key[0] % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(anchor, v)), k[0], k[1]) for k, v in sound.items() if k != key and len(k[2]) == len(key[2]))
        same = [s for s in scored if s[2] == key[1]][:positives]
        for s, i, _ in same:
            fitting = [(t, j) for t, j, label in scored if label != key[1] and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(key[0], i, rank + 1, j, -s, -t) for rank, (t, j) in enumerate(fitting)]
    return sorted(out)


def mined(spark, rows, every, **options):
    kind = "vec_id long, label long, embedding array<double>, key string, place string, values string, dim string, part string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], kind).repartition(3)
    found = mining.hard_negatives(df, F.col("vec_id") % every == 0, 256, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def crowd(seed, n=400, dimension=20):
    """A label with a third of the rows, close groups, many ties."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, dimension)) / 4
    label = np.where(r.random(n) < 0.33, 0, r.integers(0, 6, n))
    return [(i, int(label[i]), (centres[i % 8] + r.choice([0.0, 0.05, 0.2]) * r.standard_normal(dimension)).round(2).tolist()) for i in range(n)]


def test_negatives_of_crowds(spark, monkeypatch):
    for name, value in (("ANCHORS", 5), ("CELL", 1)):
        monkeypatch.setattr(mining, name, value)
    rows = crowd(1)
    want = brute_negatives(rows, 4)
    assert mined(spark, rows, 4) == want and len(want) > 300
    assert mined(spark, rows, 9, positives=2, negatives=7, low=10, high=99) == brute_negatives(rows, 9, positives=2, negatives=7, low=10, high=99)


def test_negatives_of_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(0, 1, v), (0, 1, v), (0, 2, v), (2, 1, v), (3, 1, [0.4, -0.2, 0.1]), (4, 2, [0.3, -0.2, 0.1]), (5, 2, [0.3, -0.2, 0.1]), (None, 1, v), (6, None, v), (8, 1, None)]
    rows += [(10, 1, [0.1, None, 0.2]), (12, 2, [float("nan"), 0.1, 0.2]), (14, 2, [float("inf"), 0.1, 0.2]), (16, 1, []), (18, 2, []), (20, 1, []), (-22, 3, [0.01, 0.4, 0.4])]
    rows += [(24, 1, [1e300, 0.0, 0.0]), (26, 1, [3e5, 1e5, -2e5]), (28, 1, [2e5, 1e5, -2e5]), (30, 4, [2e5, -1e5, -1e5]), (32, 4, [0.5, 0.5]), (33, 4, [0.5, 0.4]), (34, 5, [0.4, 0.4])]
    want = brute_negatives(rows, 2)
    assert mined(spark, rows, 2) == want and {w[0] for w in want} > {0, 2, 26, 32}
    assert mined(spark, [], 2) == [] and mined(spark, [(1, 1, v)], 1) == []


def test_bounds_hold_and_rule_out():
    r = np.random.default_rng(3)
    x = np.floor(256 * np.cumsum(r.standard_normal((60, 37)), axis=1) / 6).astype(np.int64)  # smooth: segments tell much
    rows = mining.Rows(np.arange(60), np.zeros(60), np.arange(60), x, *mining.summaries(x))
    score = x @ x.T
    least, most = np.quantile(score, 0.9, axis=1), np.full(60, np.inf)
    left = mining.undecided(rows, rows, np.ones((60, 60), bool), least, most)
    assert left[score >= least[:, None]].all() and left.mean() < 0.5
    # far fewer pairs are left by finer levels, taken one by one, too
    sparse = np.zeros((60, 60), bool)
    sparse[::9, ::3] = True
    left = mining.undecided(rows, rows, sparse, least, most)
    assert left[sparse & (score >= least[:, None])].all() and not left[~sparse].any()


def test_negatives_of_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, SF_DIR).collect()) == brute_negatives(moved, 50)


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=24, periods=3):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, periods * q):
                own = words[i : i + size]
                if not any(own[:-p] == own[p:] for p in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_digest(doc_id, text):
    words = planted(doc_id, plain_words(text))
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def check_digests(df, rows):
    found = run_digests(periodic_runs(with_planted_runs(df))).select(*COLUMNS).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str(brute_digest(*r)) for r in rows)


@pytest.mark.parametrize("least", [3, 7, 24])
def test_runs_of_random_words(least):
    r = random.Random(least)
    for _ in range(400):
        words = [r.randrange(r.choice([1, 2, 2, 3])) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            if len(words) > 6:
                s, p = r.randrange(len(words)), r.randint(1, 12)
                for i in range(s, min(len(words), s + r.randint(p, 60))):
                    words[i] = words[s + (i - s) % p]
        assert [tuple(map(int, x)) for x in zip(*find_runs(np.array(words, np.int64), least))] == brute_runs(words, least)


def test_runs_of_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    t = [0]
    while len(t) < 1024:
        t += [1 - x for x in t]
    for words, least in ((b[:1500], 3), (t, 3), ([0] * 700 + [1] + [0] * 700, 24), (t[:64] * 9, 24)):
        assert [tuple(map(int, x)) for x in zip(*find_runs(np.array(words, np.int64), least))] == brute_runs(words, least)
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int64), periods=2)


def test_runs_of_odd_documents(odd, nothing, spark):
    check_digests(odd, odd_rows())
    assert run_digests(periodic_runs(with_planted_runs(nothing))).collect() == []
    rows = [(i, " ".join(prose(i, 3 + i % 7).split() * (i % 40)) + "\n" + prose(i + 1, i % 9)) for i in range(120)] + [(5, "other " * 30), (5, "one more text " * 20)]
    check_digests(frame(spark, rows).repartition(3), rows)


def test_runs_keep_texts(spark):
    text = "  a\tb  " + "x y z " * 20 + "\n end  日本  "
    row = periodic_runs(frame(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    assert row[0].collapsed == "a b x y z end 日本" and [tuple(r) for r in row[0].runs] == [(2, 60, 3)] and row[0].n_words == 64
    assert row[1].collapsed == "" and row[1].runs == []


def test_a_very_long_text(spark):
    rows = [(1, "same words again " * 100_000 + prose(5, 2_000))]
    one = periodic_runs(frame(spark, rows)).first()
    assert [tuple(r) for r in one.runs] == [(0, 300_000, 3)] and one.collapsed == "same words again " + rows[0][1][1_700_000:].strip()


def test_runs_of_table(spark):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, SF_DIR).collect()}
    rows = [(i, t) for i, t in documents(spark) if len(plain_words(t)) < 2_500]
    assert len(rows) > 150 and all(found[i] == brute_digest(i, t) for i, t in rows)


# ---------------------------------------------------------------- main text


def cut_cost(costs, edges, side):
    return sum(abs(c) for c, s in zip(costs, side) if (c > 0) != s and c) + sum(w for (a, b), w in edges.items() if side[a] != side[b])


def test_minimum_cut_is_the_least_of_all():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        costs = [r.choice([r.uniform(-3, 3), r.uniform(-0.5, 0.5), 0.0]) for _ in range(n)]
        edges = {(a, b): r.uniform(0, 1.5) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        best = min(cut_cost(costs, edges, side) for side in itertools.product((False, True), repeat=n))
        assert cut_cost(costs, edges, minimum_cut(costs, edges)) == pytest.approx(best)


def test_a_long_chain_is_cut():
    n = 20_000
    costs = [0.3 if i % 3 else -0.4 for i in range(n // 2)] + [-0.5 if i % 2 else 0.4 for i in range(n // 2)]
    side = minimum_cut(costs, {(i, i + 1): 1.0 for i in range(n - 1)})
    assert all(side[: n // 2 - 5]) and not any(side[n // 2 + 5 :])


def article(html):
    """The blocks of the article element of the made pages, whose markup is plain."""
    inner = html.split("<article>")[1].split("</article>")[0]
    import html as references

    blocks = (" ".join(references.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_of_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = op13_main_text(spark, SF_DIR).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        want = article(pages[r.page_id].html)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


HELD_OUT = {
    "divs": (
        '<html><body class="has-sidebar"><div class="site-header"><a href="/">Home</a><a href="/b">Blog</a></div><div id="main-content"><h1>A walk</h1><p>We left early, before the sun was up, and took the old road.</p>'
        "<p>Short.</p><ul><li>Bread, cheese and a flask of tea.</li></ul><p>By noon we had reached the pass.</p></div><div class='sidebar'><h3>Popular</h3><p>The ten best walks in the country, as chosen by our readers.</p></div>"
        '<div class="footer">Contact us | Imprint</div></body></html>',
        ["A walk", "We left early, before the sun was up, and took the old road.", "Short.", "Bread, cheese and a flask of tea.", "By noon we had reached the pass."],
    ),
    "comments": (
        "<body><header><h2>The Paper</h2></header><main><article><header><h1>Rain &amp; wind</h1></header><p>It rained   for a week,\n and then it rained again.</p><figure><img src=x><figcaption>The harbour, on Monday.</figcaption></figure>"
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I was there, and it did not rain at all that week.</p></div></section></article></main><aside><p>Subscribe to our letter, it comes each Friday.</p></aside>'
        "<form><p>Your name, please.</p><input><button>Send</button></form><footer>All rights reserved</footer></body>",
        ["Rain & wind", "It rained for a week, and then it rained again.", "The harbour, on Monday."],
    ),
    "broken": (
        "<nav><ul><li><a href=/>One</a><li><a href=/2>Two</a></ul></nav><article><h1>No end tags<p>The first paragraph, which nobody closed.<p>The <b>second<br>one, &lt;escaped&gt;.<div role=alert>We use cookies.</div><p>Third &copy &#8212; caf&eacute;.",
        ["No end tags", "The first paragraph, which nobody closed.", "The second one, <escaped>.", "Third © — café."],
    ),
    "scripts": (
        "<article><script>if (a < b) { document.write('<p>no</p>') }</script><style>p { color: red }</style><p>Only this line, and nothing else.</p><!-- <p>not this</p> --><noscript>Turn it on.</noscript><p hidden>Nor this one.</p></article>",
        ["Only this line, and nothing else."],
    ),
}


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


@pytest.mark.parametrize("name", HELD_OUT)
def test_held_out_pages(model, name):
    html, want = HELD_OUT[name]
    assert main_text(html, *model).split("\n") == want


def test_the_seeds_alone_do(spark):
    weights = fit(spark.createDataFrame([], "page_id long, url string, html string"))
    assert [main_text(html, *weights).split("\n") == want for html, want in HELD_OUT.values()].count(True) >= 3


def test_odd_pages(spark):
    kind = "page_id long, url string, html string, text string, n_chars string, label string, row string"
    pages = [(1, "u", None), (2, None, ""), (None, "u", "plain words, without any markup at all, but for this long sentence."), (3, "u", "<<<>>> < p &&&; <p"), (3, "u", "<<<>>> < p &&&; <p")]
    pages += [(4, "u", "<article>" + "<p>A paragraph of some length, number one of many.</p>" * 20_000 + "</article>"), (5, "u", "<div>" * 3_000 + "deep"), (6, "u", "<p>  \n</p>")]
    found = extract_main_text(spark.createDataFrame([(*p, "x", "y", "z", "w") for p in pages], kind).repartition(2)).collect()
    assert found[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(found) == len(pages)
    texts = {r.page_id: r for r in found}
    assert texts[1].text == texts[2].text == texts[6].text == "" and texts[1].n_chars == 0
    assert texts[4].text.count("\n") == 19_999 and texts[4].n_chars == len(texts[4].text)
    assert texts[None].text.startswith("plain words")
    assert extract_main_text(spark.createDataFrame([], kind)).collect() == []


def test_blocks():
    found = blocks_of("<div>one <a href=x>two</a><p>three<table><tr><td>four<td>five</table>six</div>")
    assert [b.text for b in found] == ["one two", "three", "four", "five", "six"] and found[0].links == 1 and found[0].linked == 3
