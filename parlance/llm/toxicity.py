"""Toxicity by a factorization machine over hashed terms.

A term is a word or one of its first-letters stems; each is hashed to a bucket. The machine adds to
the linear weights of a text's buckets a learned interaction of every two of them, so that a term
can weigh more beside another. It is fitted on a bounded sample of labelled documents, from terms
that tell the classes apart alone and from pairs of terms that do so only together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parlance.llm.common import held_out

#: at most so many labelled documents of each class are learned from
PER_CLASS = 3000
BUCKETS, STEMS, CACHE = 1 << 20, (3, 4, 5, 6, 7, 8), 300_000
#: terms kept for themselves; pairs looked for among so many of the most frequent terms of the sample, and kept
FEATURES, PAIRED, PAIRS, LEAST_DOCS, LEAST_CHI2, PAIR_CHI2, FACTORS = 1024, 2048, 128, 3, 12.0, 40.0, 8
LETTERS = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> tuple[int, ...]:
    terms = [word, *(f"{word[:n]}\x00{n}" for n in STEMS if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms)


def text_buckets(text: str | None) -> set[int]:
    """Buckets of all terms of the whole text; none for null."""
    return {b for w in set(LETTERS.findall((text or "").lower())) for b in word_buckets(w)}


def chi_square(hits: np.ndarray, seen: np.ndarray, n: int, pos: int) -> np.ndarray:
    """How far the ``hits`` of class 1 among rows ``seen`` with a feature are from its share ``pos`` of all ``n`` rows."""
    expected = seen * (pos / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, (hits - expected) ** 2 / (expected * (1 - pos / n) * np.maximum(1 - seen / n, 1e-9)), 0.0)


def best_cut(margins: np.ndarray, y: np.ndarray, weight: float) -> float:
    """The margin that tells class 1 from class 0, whose rows weigh ``weight``, with the best F1; of a range the middle."""
    order = np.argsort(-margins, kind="stable")
    caught, wrong = np.cumsum(y[order]), np.cumsum(1 - y[order]) * weight
    ends = np.r_[np.diff(margins[order]) != 0, True]  # equal margins go together
    f1 = np.where(ends, 2 * caught / (caught + wrong + y.sum()), -1.0)
    at = int(np.argmax(f1))
    after = margins[order][at + 1] if at + 1 < len(order) else margins[order][at] - 1.0
    return float(margins[order][at] + after) / 2


def telling_pairs(x: np.ndarray, y: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Pairs of columns of ``x`` (rows by terms) that stand together in one class far more than ``alone``, the terms' own chi-squares, says; the best PAIRS of them."""
    n, pos, found = len(y), int(y.sum()), []
    one = x[y == 1]
    for lo in range(0, x.shape[1], 256):
        both, hits = x[:, lo : lo + 256].T @ x, one[:, lo : lo + 256].T @ one
        gain = chi_square(hits, both, n, pos) - np.maximum(alone[lo : lo + 256, None], alone[None, :])
        a, b = np.nonzero((gain > PAIR_CHI2) & (np.arange(lo, lo + len(gain))[:, None] < np.arange(x.shape[1])[None, :]))
        found.append(np.stack([gain[a, b], a + lo, b], 1))
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))][:PAIRS, 1:].astype(np.int64)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w + sum over pairs of the inner product of their factors), for the buckets that were kept."""

    index: dict[int, int] = field(default_factory=dict)
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s**2).sum(1) - x @ (self.v**2).sum(1)), s

    @staticmethod
    def _columns(rows: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
        """Rows by ``buckets``: which each row has."""
        column = np.full(BUCKETS, -1, np.int32)
        column[buckets] = np.arange(len(buckets))
        x = np.zeros((len(rows), len(buckets)), bool)
        for i, r in enumerate(rows):
            at = column[r]
            x[i, at[at >= 0]] = True
        return x

    def fit(self, rows: list[np.ndarray], y: np.ndarray, prior: float, seed: int = 5) -> FactorizationMachine:
        """Learn from ``rows`` (buckets of each) of classes ``y`` (1 or 0).

        Each half of the rows is scored by a machine learned from the other; the bias is moved so that
        a score of 0.5 is where these scores tell the classes apart best, at class shares of ``prior``.
        """
        n, pos = len(rows), int(y.sum())
        if not n or pos in (0, n):
            self.bias = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
            return self
        half = np.random.default_rng(seed).permutation(n) % 2
        margins = np.zeros(n)
        for side in (0, 1):
            here, there = np.flatnonzero(half != side), np.flatnonzero(half == side)
            if 0 < y[here].sum() < len(here):
                part = FactorizationMachine()._learn([rows[i] for i in here], y[here], seed)
                margins[there] = part.margins(self._columns([rows[i] for i in there], np.array(sorted(part.index, key=part.index.get), np.int64)).astype(float))[0]
        self._learn(rows, y, seed)
        self.bias -= best_cut(margins, y, (1 - prior) / max(prior, 1e-9) * pos / (n - pos))
        return self

    def _learn(self, rows: list[np.ndarray], y: np.ndarray, seed: int, epochs: int = 40) -> FactorizationMachine:
        """Keep the buckets that chi-square finds to tell the classes apart, alone or in pairs, then Adam on the log loss with decay."""
        n, pos = len(rows), int(y.sum())
        seen = np.zeros(BUCKETS)
        hits = np.zeros(BUCKETS)
        for r, label in zip(rows, y):
            seen[r] += 1
            hits[r] += label
        chi2 = chi_square(hits, seen, n, pos)
        good = np.flatnonzero((seen >= LEAST_DOCS) & (chi2 >= LEAST_CHI2))
        good = good[np.lexsort((good, -chi2[good]))][:FEATURES]
        often = np.flatnonzero(seen >= PAIR_CHI2 / 2)
        often = np.sort(often[np.lexsort((often, -seen[often]))][:PAIRED])
        pairs = telling_pairs(self._columns(rows, often).astype(np.float32), y, chi2[often])
        good = np.concatenate([good, np.setdiff1d(often[pairs], good)])
        self.index = {int(b): i for i, b in enumerate(good)}
        x = self._columns(rows, good)
        rng = np.random.default_rng(seed)
        self.w, self.v = np.zeros(len(good)), rng.normal(0, 0.1, (len(good), FACTORS))
        params = [np.zeros(1), self.w, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, 256):
                xb, yb = x[order[i : i + 256]].astype(float), y[order[i : i + 256]]
                self.bias = float(params[0][0])
                m, s = self.margins(xb)
                g = (1 / (1 + np.exp(-np.clip(m, -40, 40))) - yb) / len(yb)
                grads = [np.array([g.sum()]), xb.T @ g + 1e-4 * self.w, xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * self.v + 1e-3 * self.v]
                t += 1
                for p, gr, a, b in zip(params, grads, first, second):
                    a += 0.1 * (gr - a)
                    b += 0.001 * (gr**2 - b)
                    p -= 0.02 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        self.bias = float(params[0][0])
        return self

    def scorer(self):
        """A function from texts to scores. Words are looked up once each and remembered up to a bound."""
        known: dict[str, tuple[int, ...]] = {}

        def kept(word: str) -> tuple[int, ...]:
            got = known.get(word)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[word] = tuple(self.index[b] for b in word_buckets(word) if b in self.index)
            return got

        def score(texts) -> np.ndarray:
            out = np.zeros(len(texts))
            for i, t in enumerate(texts):
                on = sorted({j for w in set(LETTERS.findall((t or "").lower())) for j in kept(w)})
                s = self.v[on].sum(0)
                m = self.bias + self.w[on].sum() + 0.5 * ((s**2).sum() - (self.v[on] ** 2).sum())
                out[i] = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
            return out

        return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fit on at most ``per_class`` documents of each class, those with the least hash of their id.

    ``labels`` is (doc_id, toxic). Rows that are held out, and null labels and ids, are left out; of
    repeated labels the greatest counts, of documents with the same id one is used. The classes'
    shares in all labels that may be learned from give the prior. Without labels every score is near 0.
    """
    fair = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in fair.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    pick = None
    for label in (0, 1):
        few = fair.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        pick = few if pick is None else pick.union(few)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([np.array(sorted(text_buckets(t)), np.int32).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "toxic", "on"])

    # at most 2 * per_class ids are broadcast, and as many arrays of buckets come back
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(chosen.dropDuplicates(["doc_id"]).mapInArrow(features, f"doc_id {kind}, toxic int, on binary").collect(), key=lambda r: r["doc_id"])
    return FactorizationMachine().fit([np.frombuffer(r["on"], np.int32) for r in rows], np.array([r["toxic"] for r in rows], float), prior)


def toxicity_score(text: Column, model: FactorizationMachine) -> Column:
    """The score (0 to 1, never null) of each whole text; null and empty texts get that of no terms."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for b in batches:
            yield pd.Series(score(b))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(text)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of each row of ``docs`` (doc_id, text).

    Repeated rows and null ids are scored like others; an empty table gives an empty result.
    """
    model = train(docs, labels, per_class)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
