"""MinHash fingerprints of documents: the least values of many universal hash functions over word shingles.

Likeness of two fingerprints, the share of equal values, estimates the Jaccard similarity of the
shingle sets. ``near_duplicate_links`` joins bands of the signatures in Spark and verifies Jaccard.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from parlance.llm.common import stored
from parlance.llm.components import connected_components

PERMUTATIONS, WORDS, KEPT_BITS = 128, 5, 16
BLOCK, CACHE = 512, 400_000
BUCKET_BYTES = 64_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=4)
def permutations(k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``k`` multiply-add hash functions modulo 2 to the 64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, np.uint64)


class Hasher:
    """Shingles and signatures; words are hashed once each and remembered up to a bound."""

    def __init__(self, k: int = PERMUTATIONS, width: int = WORDS) -> None:
        self.k, self.width, self.known = k, width, {}
        self.a, self.b = permutations(k)
        self.room = np.empty((BLOCK, k), np.uint64)

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words of the whole text."""
        return self._words(text.encode("utf-8", "surrogatepass").lower().split())

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the distinct shingles of the whole text; of all words if they are fewer; none without words."""
        return self.grams(self.words(text), self.width)

    def grams(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the distinct shingles of ``width`` hashed ``words``; of all words if they are fewer; none without words."""
        if not len(words):
            return words
        width = min(width, len(words))
        n = len(words) - width + 1
        h = np.full(n, width, np.uint64)
        for i in range(width):
            h = (h ^ words[i : i + n]) * MIX
            h ^= h >> np.uint64(31)
        return np.unique(h)

    @staticmethod
    def set_hash(shingles: np.ndarray) -> int:
        """A signed hash of a set of shingles (sorted); 0 for none."""
        return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes()) | 1).view(np.int64)) if len(shingles) else 0

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), BLOCK):
            part = shingles[i : i + BLOCK]
            room = self.room[: len(part)]
            np.multiply.outer(part, self.a, out=room)
            room += self.b
            np.minimum(least, room.min(axis=0), out=least)
        # the minimum of n values is about 2^64 / n, so its own high bits say little; those of a mix of all its bits do
        mixed = (least ^ (least >> np.uint64(32))) * MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
        return (mixed >> np.uint64(64 - KEPT_BITS)).astype(np.uint16)

    def fingerprint(self, text: str) -> np.ndarray:
        return self.signature(self.shingles(text))


def as_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def bucket_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 ids that cut the documents into like shares."""
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    return sorted({int(c) for c in cuts or []})


def beside_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(bucket, halo, doc_id, h, text), a partition for each bucket, sorted: in each bucket documents descend, and the last row, a halo, is a copy of the first of the next bucket.

    Buckets are ranges of ids, numbered from the greatest ids, then for null ids ranges of a hash of the
    text; after the last comes the first. There are as many as the texts fill with about ``bucket_bytes``
    each, and at least as many as the session has shuffle partitions. The driver sees one id for each
    bucket. Equal ids are ordered by the hash.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // bucket_bytes))
    lone = -(-size["nulls"] * parts // max(1, size["n"]))  # buckets of null ids
    bounds = np.array(bucket_bounds(docs, parts), np.float64)

    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.float64, na_value=-np.inf), "right"), dtype="int64")

    of.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    h = F.xxhash64("text")
    share = (h / F.lit(2.0**64) + 0.5) * lone
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.least(F.floor(share), F.lit(max(0, lone - 1)))).otherwise(F.pandas_udf(of, LongType())(F.col("doc_id").cast("double")))
    rows = docs.select(bucket.alias("bucket"), "doc_id", h.alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "h"))  # ~x falls as x rises, and has no overflow
    heads = sorted(docs.select(bucket.alias("bucket"), "doc_id", h.alias("h")).groupBy("bucket").agg(first.alias("x")).collect())
    goes = [(heads[i - 1]["bucket"], r["bucket"], None if r["x"]["none"] else ~r["x"]["down"], r["x"]["h"]) for i, r in enumerate(heads)]
    halo = docs.sparkSession.createDataFrame(goes, "to_bucket long, bucket long, _id long, _h long")
    match = (rows["bucket"] == halo["bucket"]) & rows["doc_id"].eqNullSafe(halo["_id"]) & (rows["h"] == halo["_h"])
    # one row for each bucket is broadcast
    copies = rows.join(F.broadcast(halo), match).select(F.col("to_bucket").alias("bucket"), "doc_id", "h", "text").dropDuplicates(["bucket"])
    both = rows.withColumn("halo", F.lit(False)).unionByName(copies.withColumn("halo", F.lit(True)))
    dealt = both.repartitionById(len(bounds) + 1 + lone, F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "h")


def fingerprint_documents(docs: DataFrame, k: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs`` (doc_id, text).

    ``doc_id`` is a whole number; ids of other types that don't read as one are an error. The next
    document is the one with the next smaller id; after the last comes the first, and a
    single document is followed by itself. Null texts count as empty. Texts without words have one
    common fingerprint. Rows with equal ids follow each other in an order given by a hash of their
    texts; null ids come last. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = Hasher(k), None  # the row before: bucket, id, text, fingerprint
        for b in batches:
            out = []
            for bucket, halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text"))):
                mark = hasher.fingerprint(text)
                if last is not None and last[0] == bucket:
                    _, before, was, own = last
                    new = edited(was, text)
                    changed = hasher.fingerprint(new)
                    out.append((before, len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own), as_hex(changed), likeness(own, changed), likeness(own, mark)))
                last = None if halo else (bucket, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    dealt = beside_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return dealt.select("bucket", "halo", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicate_links(docs: DataFrame, threshold: float = 0.8, bands: int = 32, k: int = PERMUTATIONS) -> DataFrame:
    """(a, b, jaccard): links between documents (doc_id, text) whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Equal texts are one, under their least id, so copies never meet each other. Texts that share a
    band stand in one bucket, ordered by a hash; each is paired with the 8 before it, so a bucket
    of n texts gives 8n pairs. What these links leave in different classes is compared exactly (see
    ``links_between``), so the links join up just the classes of all pairs at ``threshold``; not each
    pair of a large class is returned. Texts without words and null ids have no links.
    """
    texts = docs.where("doc_id is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))

    def shingle(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(k)
        for b in batches:
            yield pd.Series([hasher.shingles(t or "").view(np.int64) for t in b])

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(k)
        for b in batches:
            yield pd.Series([np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in np.split(hasher.signature(np.asarray(s, np.int64).view(np.uint64)), bands)], np.uint64).view(np.int64) for s in b])

    for f in (shingle, sign):
        f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    longs = ArrayType(LongType())
    sets = stored(texts.select("doc_id", F.pandas_udf(shingle, longs)("text").alias("s")).where(F.size("s") > 0), "shingles")
    banded = sets.select("doc_id", F.posexplode(F.pandas_udf(sign, longs)("s")).alias("band", "key"))
    order = Window.partitionBy("band", "key").orderBy(F.xxhash64("doc_id", "band"), "doc_id")
    before = banded.select("doc_id", F.array(*[F.lag("doc_id", i).over(order) for i in range(1, 9)]).alias("others"))
    pairs = before.select("doc_id", F.explode("others").alias("other")).where("other is not null")
    pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    links = stored(verified(pairs, sets, threshold), "near-links")
    roots = stored(connected_components(links.select("a", "b")), "near-roots")
    return links.unionByName(links_between(sets, roots, threshold))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the ``pairs`` (a, b) of ``sets`` (doc_id, s) at ``threshold`` or more."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def links_between(sets: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): all pairs of ``sets`` at ``threshold`` or more in different classes of ``roots`` (node, root).

    Prefix filter: with the shingles of each text ordered from the rarest, two such texts share one
    of their first n - ceil(threshold n) + 1. Shingles whose texts are of one class give no pairs; one
    that stands in this prefix of m texts of many classes gives up to m squared.
    """
    rooted = sets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"), F.size("s").alias("n"), F.explode("s").alias("shingle"))
    often = rooted.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("often", "shingle"))
    # the small number keeps rounding from making a prefix too short
    prefix = rooted.join(often.where("often > 1"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("rank", rank)
    prefix = prefix.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1).select("doc_id", "root", "n", "shingle")
    prefix = stored(prefix, "near-prefixes")
    open_ = prefix.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    left = prefix.join(open_, "shingle")
    right = prefix.select("shingle", F.col("doc_id").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"))
    fits = (F.col("root") < F.col("other_root")) & (F.col("n") >= F.col("m") * threshold - 1e-6) & (F.col("m") >= F.col("n") * threshold - 1e-6)
    pairs = left.join(right, "shingle").where(fits).select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    return verified(pairs, sets, threshold)
