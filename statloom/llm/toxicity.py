"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. A bounded, hashed sample of the labelled rows that are not held out is read (SAMPLE rows).
2. Voters: a fixed lexicon of insults; one voter for each term (a word or a word's beginning) that stands out in the toxic
   rows of the sample; patterns of writing; the absence of any term; the annotator who labelled the row.
3. The label model is a latent class for each row with the voters' votes given the class. Expectation maximisation
   estimates every voter's chances; voters that agree more than the class explains share their weight.
4. A logistic regression on the terms of a text is trained on the model's posterior labels.
5. It scores every text whole, in one pass over the documents without a shuffle.

The score uses the text alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import give_back, small_batches, texts, tidy
from statloom.session import cut_lineage

#: Labelled rows read for fitting at most (expected value of a hashed choice), and terms kept.
SAMPLE, TERMS, VOTERS = 20_000, 2_000, 40
FOLDS, SEED = 5, 17
#: Lengths of the word beginnings that can become terms.
BEGINNINGS = (4, 5, 6)
#: Share of a text's different words that makes a beginning dense; share of toxic rows that a term needs unless a test for all terms
#: together (at this level) shows it.
DENSE, BACKING, LEVEL = 0.005, 0.015, 0.01

#: Common English insults, the lexicon that needs no labels.
INSULTS = frozenset(
    """idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass jerk bastard bitch asshole
    shithead retard cretin vermin filth fatso slut whore wanker twat dickhead bullshit fuck fucking fucker shit scumbag
    lowlife nitwit halfwit dimwit simpleton buffoon weirdo""".split()
)

_LETTERS = re.compile(r"[^\W\d_]+")
_SHOUT, _MARKS = re.compile(r"\b[^\W\d_a-z]{4,}\b"), re.compile(r"[!?]{2,}|[*$%&#]{3,}")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def terms_of(words: set[str], total: int) -> set[str]:
    """The words, marked as whole, their beginnings, and the beginnings that several, or a fair share, of the words have."""
    counts: dict[str, int] = {}
    for word in words:
        for n in BEGINNINGS:
            if len(word) >= n:
                counts[word[:n]] = counts.get(word[:n], 0) + 1
    out = {word + "$" for word in words}
    for start, n in counts.items():
        out.add(start)
        if n >= 2:
            out.add(start + "+2")
        if n >= 3:
            out.add(start + "+3")
        if n >= DENSE * total:
            out.add(start + "+%")
    return out


@dataclass
class Model:
    """Weights of terms and of any insult of the lexicon; a score is the logistic of their sum over the terms of a text."""

    intercept: float = -3.0
    lexicon: float = 6.0
    terms: dict[str, float] = field(default_factory=dict)
    #: By voter: the chance of no toxic vote on clean rows, and of a toxic vote on toxic rows.
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._starts = {stem(t) for t in self.terms}

    def score(self, text: str) -> float:
        words, starts = words_of(text), self._starts
        near = {w for w in words if w[:4] in starts}  # most words begin like no term
        found = sorted(t for t in terms_of(near, len(words)) if t in self.terms) if near else ()
        total = self.intercept + sum(self.terms[t] for t in found) + (0.0 if words.isdisjoint(INSULTS) else self.lexicon)
        return 1.0 / (1.0 + math.exp(-min(max(total, -30.0), 30.0)))


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, text, toxic of about `size` labelled rows that are not held out, each text once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, size / max(known.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) / F.lit(2.0**53)
    chosen = known.where(draw < share)
    # its size is bounded by the parameter
    joined = texts(docs).join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each term, and toxic rows with it, summed up within a batch."""
    for batch in small_batches(batches, limit=4_000_000):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = words_of(text)
            for term in terms_of(words, len(words)):
                both = counts.setdefault(term, [0, 0])
                both[0] += 1
                both[1] += toxic
        n, toxic = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], ["term", "n", "toxic"])


def _pick_terms(sample: DataFrame, rows: int, toxic: int) -> list[str]:
    """The terms that stand out most in toxic rows, by the strength and the certainty of it."""
    counted = sample.mapInArrow(tidy(_count_terms), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counted = cut_lineage(counted, "terms")
    base = min(max(toxic / rows, 1e-9), 1 - 1e-9)
    expected = F.col("n") * base
    # a bound on the chance of so many toxic rows, for a rare term; times the number of terms it stays below the level
    p = F.col("toxic") / F.col("n")
    apart = p * F.log(F.greatest(p, F.lit(1e-12)) / base) + (1 - p) * F.log(F.greatest(1 - p, F.lit(1e-12)) / (1 - base))
    sure = (F.col("toxic") >= 3) & (F.col("n") * apart > math.log(max(counted.count(), 1) / LEVEL))
    counted = counted.where(((F.col("toxic") >= max(3.0, BACKING * toxic)) | sure) & (F.col("toxic") - expected > 2 * F.sqrt(expected)) & (F.col("toxic") > F.col("n") * max(0.5, min(0.95, 1.2 * base))))
    strength = (F.col("toxic") - expected) / F.sqrt(expected + 0.5) * F.col("toxic") / F.col("n")
    best = counted.withColumn("strength", strength).orderBy(F.desc("strength"), F.length("term"), "term").limit(2 * TERMS)
    return _without_echoes([(r["term"], r["n"], r["toxic"]) for r in best.collect()])[:TERMS]


def stem(term: str) -> str:
    """What a term begins with: the voter it belongs to."""
    return re.sub(r"[$+].*", "", term)[:4]


def _without_echoes(terms: list[tuple[str, int, int]]) -> list[str]:
    """Of terms with one stem and equal counts (a word and its own beginnings), the first."""
    met, out = set(), []
    for term, n, toxic in terms:
        if (stem(term), n, toxic) not in met:
            met.add((stem(term), n, toxic))
            out.append(term)
    return out


def _hits(terms: list[str]):
    at = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, extra = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(sorted(at[t] for t in terms_of(words, len(words)) if t in at))
                extra.append([int(bool(words & INSULTS)), int(bool(_SHOUT.search(text))), int(bool(_MARKS.search(text)))])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(extra, pa.list_(pa.int32())), batch.column("toxic")], ["hits", "extra", "toxic"])

    return run


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, each voter's chances P(vote | class) and each voter's share of weight.

    votes holds 1 (toxic), -1 (clean) and 0 (no vote). Chances and the class's frequency are estimated by
    expectation maximisation from the posterior `start` on. Correlations are those of votes given the class: a voter
    that repeats others counts with a share of its log odds.
    """
    rows, voters = votes.shape
    kinds = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = start.astype(float)
    share = np.ones(voters)
    for _ in range(rounds):
        chances = []
        for weight in (1 - posterior, posterior):
            counted = np.einsum("i,ijk->jk", weight, kinds) + 0.5
            chances.append(counted / counted.sum(axis=1, keepdims=True))
        centred = votes - sum(w[:, None] * (c[:, 2] - c[:, 0])[None, :] for w, c in zip((1 - posterior, posterior), chances))
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
        correlation = (centred.T @ centred) / rows / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0.0)
        share = 1.0 / (1.0 + np.clip(correlation, 0.0, 1.0).sum(axis=1))
        odds = np.einsum("ijk,jk,j->i", kinds, np.log(chances[1]) - np.log(chances[0]), share)
        base = np.clip(posterior.mean(), 1e-3, 0.5)
        updated = 1.0 / (1.0 + np.exp(-np.clip(odds + np.log(base / (1 - base)), -30, 30)))
        if np.abs(updated - posterior).max() < 1e-4:
            posterior = updated
            break
        posterior = updated
    return posterior, np.stack(chances), share


def _logistic(x: np.ndarray, y: np.ndarray, amount: np.ndarray, prior: np.ndarray, penalty: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Weights of a logistic regression on soft labels by accelerated gradient steps; the last is the intercept.

    Row i stands for amount[i] rows. Weights are drawn to `prior` with strength `penalty`. Weights of terms stay at zero or above: terms were chosen as signs of toxicity.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = amount / amount.sum()
    step = 1.0 / (0.25 * float(share @ (x**2).sum(axis=1)) + penalty.max() / amount.sum())
    w = np.zeros(x.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (share * (p - y))
        slope[:-1] += penalty / amount.sum() * (ahead[:-1] - prior)
        new = ahead - step * slope
        new[:-1] = np.maximum(new[:-1], 0.0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> Model:
    """The model learned from labelled rows (doc_id, toxic); without rows of both classes, the fixed lexicon alone."""
    sample = cut_lineage(_sample(docs, labels, sample_size), "labelled")
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        return Model()
    terms = _pick_terms(sample, n, toxic)
    # as many rows as the sample has at most, each a few numbers
    rows = sample.mapInArrow(tidy(_hits(terms)), "hits array<int>, extra array<int>, toxic int").collect()
    model = _train(terms, [tuple(r["hits"]) for r in rows], np.array([r["extra"] for r in rows]), np.array([r["toxic"] for r in rows]))
    del rows
    give_back()
    return model


def _train(terms: list[str], hits: list[tuple[int, ...]], extra: np.ndarray, toxic: np.ndarray) -> Model:
    n = len(hits)
    # the stems that most toxic rows have are voters of their own, the rest vote together
    backing: dict[str, int] = {}
    for found, bad in zip(hits, toxic.tolist()):
        for s in {stem(terms[h]) for h in found}:
            backing[s] = backing.get(s, 0) + bad
    stems = sorted(backing, key=lambda s: (-backing[s], s))
    voter = {s: min(i, VOTERS - 1) for i, s in enumerate(stems)}
    single = np.zeros((n, min(len(stems), VOTERS)), np.int8)
    several = np.array([len(found) for found in hits])
    for i, found in enumerate(hits):
        single[i, [voter[stem(terms[h])] for h in found]] = 1
    silent = np.where((several == 0) & (extra[:, 0] == 0), -1, 0)
    votes = np.column_stack([extra, np.where(several >= 2, 1, 0), silent, np.where(toxic > 0, 1, -1), single]).astype(float)
    posterior, chances, _ = label_model(votes, np.where(toxic > 0, 0.95, 0.02))
    names = ["lexicon", "shouting", "marks", "several terms", "no term", "annotator", *(f"stem {s}" for s in stems[:VOTERS])]
    accuracies = {name: (float(chances[0, j, :2].sum()), float(chances[1, j, 2])) for j, name in enumerate(names)}
    # rows of the same terms are one row of the regression
    kinds: dict[tuple, list[float]] = {}
    for found, insult, p in zip(hits, extra[:, 0].tolist(), posterior.tolist()):
        both = kinds.setdefault((found, insult), [0.0, 0.0])
        both[0] += 1
        both[1] += p
    x = np.zeros((len(kinds), len(terms) + 1), np.float32)
    for i, (found, insult) in enumerate(kinds):
        x[i, list(found)] = 1
        x[i, -1] = insult
    amount, mass = np.array(list(kinds.values())).T
    prior, penalty = np.zeros(len(terms) + 1), np.full(len(terms) + 1, 0.05)
    prior[-1], penalty[-1] = Model.lexicon, 0.5  # what is known without labels
    weights = _logistic(x, mass / amount, amount, prior, penalty)
    kept = {t: float(w) for t, w in zip(terms, weights[:-2]) if w > 1e-6}
    return Model(float(weights[-1]), float(weights[-2]), kept, accuracies)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    A null or empty text has no terms and the model's lowest score; repeated rows score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; columns as they are."""
    model = fit(docs, labels)
    score = F.pandas_udf(lambda column: pd.Series([model.score(t) for t in column], dtype=float), "double")
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learned from the labels."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
