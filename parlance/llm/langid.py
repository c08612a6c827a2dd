"""Language identification in two steps: the family first, then linear support vector machines,
one against one, between the languages of that family.

Features are hashed letter n-grams of the whole text. The machines are fitted on a bounded sample
of documents whose language is given.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from parlance.llm.common import held_out

#: at most so many documents of each language are learned from
PER_LANGUAGE = 400
SHARES = 200
BITS, ORDERS, PIECE = 12, (1, 2, 3), 1 << 18
DIMS = 1 << BITS
UNKNOWN = "und"
#: a language in no family is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk"),
}
GUESS = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Per code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram shares of the whole text, of length 1; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]  # one space between words
    counts = np.zeros(DIMS)
    for n in ORDERS:
        total = np.zeros(DIMS)
        for lo in range(0, max(len(codes) - n + 1, 0), PIECE):
            part = codes[lo : lo + PIECE + n - 1]
            h = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ part[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIMS)
        if total.any():
            counts += total / total.sum()
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, passes: int = 12, seed: int = 3) -> np.ndarray:
    """Weights, the bias last, of the hinge-loss machine, by dual coordinate descent; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cap = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm, alpha, w = np.einsum("ij,ij->i", x, x), np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), cap[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class OneVersusOne:
    names: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> OneVersusOne:
        names = sorted(set(labels))
        at = np.array([names.index(v) for v in labels])
        machines = {}
        for a, b in combinations(range(len(names)), 2):
            rows = (at == a) | (at == b)
            machines[a, b] = linear_svm(x[rows], np.where(at[rows] == a, 1.0, -1.0))
        return cls(names, machines)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Most votes win, then the greater sum of margins; the score comes from the winner's weakest duel."""
        votes, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        worst = np.full(len(self.names), np.inf)
        for (a, b), w in self.weights.items():
            m = float(w[:-1] @ x + w[-1])
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        best = max(range(len(self.names)), key=lambda i: (votes[i], total[i], -i))
        return self.names[best], 1.0 if np.isinf(worst[best]) else float(1 / (1 + np.exp(-2 * np.clip(worst[best], -20, 20))))


@dataclass
class FamilyTree:
    families: OneVersusOne = field(default_factory=OneVersusOne)
    within: dict[str, OneVersusOne] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]) -> FamilyTree:
        of = {lang: name for name, members in families.items() for lang in members}
        fam = np.array([of.get(v, v) for v in langs], object)
        langs = np.array(langs, object)
        return cls(OneVersusOne.fit(x, list(fam)), {f: OneVersusOne.fit(x[fam == f], list(langs[fam == f])) for f in sorted(set(fam))})

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.within:
            return UNKNOWN, 0.0
        family, sure = self.families.predict(x)
        lang, score = self.within[family].predict(x)
        return lang, min(sure, score)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> FamilyTree:
    """Fit on at most ``per_language`` documents (rounded up to SHARES) of each language: from each of its shares by a hash of the id, those with the least other hash.

    Held-out rows, null ids, languages and texts, and texts without letters teach nothing; of
    documents with the same id one is used.
    """
    fair = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    # each of the shares of a language gives its part of the sample, so a frequent language is no single task
    share = fair.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)).alias("share")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang", "share").orderBy(F.xxhash64("doc_id"), "doc_id"))
    pick = share.withColumn("r", rank).where(F.col("r") <= -(-per_language // SHARES)).groupBy("doc_id").agg(F.min("lang").alias("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([None if x is None else x.astype(np.float32).tobytes() for x in xs], pa.binary())], names=["doc_id", "lang", "x"])

    # per_language ids of each language are broadcast, and as many vectors of 16 kB come back
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = fair.select("doc_id", "lang", "text").join(F.broadcast(pick), ["doc_id", "lang"]).dropDuplicates(["doc_id"])
    rows = sorted(chosen.mapInArrow(vectors, f"doc_id {kind}, lang string, x binary").where("x is not null").collect(), key=lambda r: r["doc_id"])
    if not rows:
        return FamilyTree()
    return FamilyTree.fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows], families)


def guess(text: Column, model: FamilyTree) -> Column:
    """struct(lang, score) of each whole text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, GUESS)(text)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Null texts and texts without letters are ``und`` with score 0, as is everything if no row can be
    learned from. Repeated rows and null ids are judged like others; an empty table gives an empty result.
    """
    model = train(docs, per_language)
    told = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), guess(F.col("text"), model).alias("g"))
    return told.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))
