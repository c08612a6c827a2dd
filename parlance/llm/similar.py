"""Near duplicates by verified similarity: SimHash finds candidates, Jaccard of the shingle sets decides.

Texts are known by the set of their five-word shingles; texts with one set are one, whatever their
case or spacing. Candidates are texts whose two-word fingerprints are within DISTANCE bits in one of TABLES
independent tables, found in the Gray-ordered index, and whose longer five-word fingerprints do not rule
the similarity out. The index gives a forest of candidate pairs, of which EDGES of each text are
verified on the sets, so that most copies of a text are one class. What candidates join in different classes is
compared block by block: tasks get the sets of two blocks of such a component and verify all candidate pairs
between classes, so no pair is a row, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from parlance.llm.common import apart, small, stored
from parlance.llm.components import connected_components
from parlance.llm.minhash import WORDS, Hasher, verified
from parlance.llm.simhash import BITS, LEAF, deal, gray_rank, join_labels, leaf_pairs, majority

#: words of a candidate's shingles, tables of fingerprints and their greatest distance, lanes of the longer fingerprint
PAIR_WORDS, TABLES, DISTANCE, LANES = 2, 4, 7, 2
#: candidate pairs of a text that are verified first, and texts of a block
EDGES, BLOCK = 4, 512


def fine_limit(similarity: float, bits: int = LANES * BITS, deviations: float = 3.0) -> int:
    """Bits in which fingerprints of sets with that Jaccard similarity differ at most: the mean and some standard deviations.

    Sets of one size with Jaccard similarity s have a cosine of 2s / (1 + s), and a bit differs with the
    probability of the angle over pi.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


CODES = StructType().add("code", LongType()).add("fps", ArrayType(LongType())).add("fine", ArrayType(LongType()))


@F.pandas_udf(CODES)
def codes_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``code``, a hash of the set of five-word shingles, TABLES fingerprints of the two-word and LANES of the five-word shingles of each text; 0 without words."""
    hasher = Hasher()
    for texts in batches:
        rows = []
        for t in texts:
            words = hasher.words(t or "")
            grams = hasher.grams(words, WORDS)
            rows.append((hasher.set_hash(grams), majority(hasher.grams(words, PAIR_WORDS), TABLES), majority(grams, LANES)))
        yield pd.DataFrame(rows, columns=["code", "fps", "fine"])


@F.pandas_udf(ArrayType(LongType()))
def shingles_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hasher = Hasher()
    for texts in batches:
        yield pd.Series([hasher.shingles(t or "").view(np.int64) for t in texts])


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Places of pairs (i, j), the least in ``rank`` first, that join the classes of ``label`` as all pairs would; ``label`` is joined by them."""
    chosen = []
    e = np.argsort(rank, kind="stable")
    while True:
        a, b = label[i[e]], label[j[e]]
        e, a, b = e[a != b], a[a != b], b[a != b]
        if not len(e):
            return chosen
        first = np.full(len(label), len(e))
        np.minimum.at(first, a, np.arange(len(e)))
        np.minimum.at(first, b, np.arange(len(e)))
        pick = e[np.unique(first[first < len(e)])]
        chosen.append(pick)
        join_labels(label, i[pick], j[pick])


def node_pairs(codes: np.ndarray, fine: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of ``codes`` (in Gray order) within DISTANCE bits, and within ``most`` bits of ``fine``, that join the codes as all such pairs would; the nearest in ``fine`` come first."""
    n = len(codes)
    label = np.arange(n)
    padded = np.concatenate([codes, np.zeros(-n % LEAF, np.uint64)]).reshape(-1, LEAF)
    starts = np.arange(0, n, LEAF)
    for part in leaf_pairs(codes, DISTANCE):
        least, last = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        a, b = part[:, 0], part[:, 1]
        part = part[(least[a] != last[a]) | (least[b] != last[b]) | (least[a] != least[b])]  # leaves of one class need no look
        at, x, y = np.nonzero(np.bitwise_count(padded[part[:, 0]][:, :, None] ^ padded[part[:, 1]][:, None, :]) <= DISTANCE)
        i, j = part[at, 0] * LEAF + x, part[at, 1] * LEAF + y
        open_ = (i < j) & (j < n)
        i, j = i[open_], j[open_]
        i, j = i[label[i] != label[j]], j[label[i] != label[j]]
        apart_ = np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64)
        i, j, apart_ = i[apart_ <= most], j[apart_ <= most], apart_[apart_ <= most]
        if len(i):
            pick = np.concatenate(forest(label, i, j, apart_))
            yield i[pick], j[pick]


def candidates(codes: DataFrame, most: int) -> DataFrame:
    """(a, b), a > b: pairs of ``codes`` (code, fps, fine) that join just what candidate pairs join, see ``node_pairs``; repeated in as many nodes as they meet in."""
    dealt = deal(codes.select(F.posexplode("fps").alias("tab", "fp"), "code", "fine"), codes.count(), DISTANCE, ["code", "fine"], ["tab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in groups(batches, "node", ["fp", "code", "fine"]):
            fp, code, fine = node["fp"].view(np.uint64), node["code"], node["fine"].view(np.uint64)
            order = np.argsort(gray_rank(fp))
            fp, code, fine = fp[order], code[order], fine[order]
            for i, j in node_pairs(fp, fine, most) if len(fp) > 1 else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(code[i], code[j])), pa.array(np.minimum(code[i], code[j]))], names=["a", "b"])

    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], sets: str | None = None) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each ``key`` (long) of sorted batches: arrays of ``columns``, ``fine`` as a matrix, and of ``sets`` a list of arrays."""

    def read(b: pa.RecordBatch) -> dict:
        out = {c: b.column(c).flatten().to_numpy().reshape(b.num_rows, LANES) if c == "fine" else b.column(c).to_numpy() for c in [key, *columns]}
        if sets:
            lists = b.column(sets)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            out[sets] = np.split(flat, ends[:-1]) if len(ends) else []
        return out

    def cut(rows: dict, lo: int, hi: int) -> dict:
        return {c: v[lo:hi] for c, v in rows.items()}

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = read(b)
        if rest is not None:
            rows = {c: rest[c] + v if isinstance(v, list) else np.concatenate([rest[c], v]) for c, v in rows.items()}
        starts = np.flatnonzero(np.r_[True, rows[key][1:] != rows[key][:-1]])
        for lo, hi in zip(starts, starts[1:]):
            yield cut(rows, lo, hi)
        rest = cut(rows, starts[-1], len(rows[key]))  # the last group may go on in the next batch
    if rest is not None:
        yield rest


def few_each(pairs: DataFrame) -> DataFrame:
    """Of the distinct ``pairs`` the EDGES of each ``a`` that come first by a hash."""
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).where(F.col("n") <= EDGES).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, s): the shingle set of each of ``codes``, under its name, from one of its texts in ``docs``; ``rows`` is (doc_id, text_hash, code)."""
    one = rows.join(codes.select("code"), "code", "left_semi").groupBy("code").agg(F.min(F.struct("text_hash", "doc_id"))["text_hash"].alias("text_hash"))
    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    # copies are one before their sets are made; equal hashes of different texts give one of the sets
    texts = hashed.join(small(one), "text_hash").groupBy("code").agg(F.min("text").alias("text"))
    return texts.select(F.col("code").alias("doc_id"), shingles_udf("text").alias("s"))


def block_links(block: dict, most: int, similarity: float) -> list[tuple[int, int, float]]:
    """(a, b, jaccard) of verified pairs that join the classes of a block's texts as all candidate pairs at ``similarity`` or more would.

    ``block`` has ``code``, ``root`` (the class), ``side``, ``fine`` and ``s``. Texts of side 0 and 1 are compared with each other, those
    of side 2 among themselves. Near fingerprints come first; classes that have met need no more pairs.
    """
    code, side, fine, sets = block["code"], block["side"], block["fine"].view(np.uint64), [x.view(np.uint64) for x in block["s"]]
    _, first, inverse = np.unique(block["root"], return_index=True, return_inverse=True)
    label, size = first[inverse], np.array([len(x) for x in sets])
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(code), 256):
        far = np.bitwise_count(fine[lo : lo + 256, None] ^ fine[None, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(far <= most)
        d, i = far[i, j], i + lo
        keep = (i < j) & ((side[i] != side[j]) | (side[i] == 2)) & (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
        found.append((d[keep], i[keep], j[keep]))
    d, i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(d, kind="stable")
    i, j, links = i[order], j[order], []
    for lo in range(0, len(i), 4096):
        a, b = i[lo : lo + 4096], j[lo : lo + 4096]
        for x, y in zip(a[label[a] != label[b]].tolist(), b[label[a] != label[b]].tolist()):
            if label[x] != label[y]:
                s, t = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
                shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if shared >= similarity * (len(s) + len(t) - shared):
                    links.append((int(code[x]), int(code[y]), shared / (len(s) + len(t) - shared)))
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
    return links


def links_in_blocks(members: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame:
    """(a, b, jaccard) of verified pairs that join the classes in each component of ``members`` (comp, code, root, fine) as all its candidate pairs would.

    Blocks are of about BLOCK texts of one class, if it has so many, else of whole smaller classes; a
    text goes to as many tasks as its component has blocks, but blocks of one class do not meet.
    """
    mixed = members.groupBy("comp").agg(F.count_distinct("root").alias("roots")).where("roots > 1").select("comp")
    size = members.join(mixed, "comp", "left_semi").groupBy("comp", "root").agg(F.count("*").alias("n"))
    small_ones = size.groupBy("comp").agg(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("rest"))
    at = members.join(size, ["comp", "root"]).join(small_ones, "comp")
    large = F.col("n") >= BLOCK
    share = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.ceil(n / BLOCK))
    blk = F.when(large, F.xxhash64("root", share("code", F.col("n")))).otherwise(F.xxhash64(F.lit("small"), share("root", F.col("rest"))))
    placed = stored(at.select("comp", "code", "root", "fine", blk.alias("blk"), F.when(large, F.col("root")).alias("pure")), "block-members")
    blocks = placed.select("comp", "blk", "pure").distinct()
    other = blocks.select("comp", F.col("blk").alias("blk2"), F.col("pure").alias("pure2"))
    meet = blocks.join(other, "comp").where((F.col("blk") <= F.col("blk2")) & ~F.coalesce(F.col("pure") == F.col("pure2"), F.lit(False)))
    task = F.xxhash64("comp", "blk", "blk2")
    both = F.when(F.col("blk") == F.col("blk2"), F.array(F.struct(F.col("blk").alias("own"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("blk").alias("own"), F.lit(0).alias("side")), F.struct(F.col("blk2").alias("own"), F.lit(1).alias("side"))))
    goes = meet.select("comp", task.alias("task"), F.inline(both)).select("comp", "task", F.col("own").alias("blk"), "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, "task", ["code", "root", "side", "fine"], "s"):
            if links := block_links(block, most, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links)], names=["a", "b", "jaccard"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(sets.withColumnRenamed("doc_id", "code"), "code").join(goes, ["comp", "blk"]).select("task", "code", "root", "side", "fine", "s")
    return dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, jaccard double")


def verified_links(docs: DataFrame, rows: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of verified pairs of ``codes`` (code, fps, fine) that join just the classes of all candidates at ``similarity`` or more."""
    most = fine_limit(similarity)
    found = stored(candidates(codes, most).distinct(), "candidates")
    comps = stored(connected_components(found), "candidate-components")
    met = stored(codes.join(comps.select(F.col("node").alias("code"), F.col("root").alias("comp")), "code").select("comp", "code", "fine"), "candidate-codes")
    sets = stored(sets_of(docs, rows, met), "candidate-sets")
    links = stored(verified(few_each(found), sets, similarity), "first-links")
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "code")
    members = stored(met.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code")), "candidate-classes")
    return links.unionByName(stored(links_in_blocks(members, sets, most, similarity), "block-links"))


def similar_documents(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, code, root, component_id) of each row of ``docs`` (doc_id, text): near duplicates have one ``root``.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles, verified on
    the sets, is ``similarity`` or more; classes are what links join. Pairs at that similarity that the fingerprints miss are
    not linked: with words changed here and there one in 200 at 0.8, with one passage changed one in three,
    and far fewer above. ``component_id`` is the least doc_id of the class, null if it has none. Null and
    blank texts have one empty set and are one class; texts of fewer than five words are one shingle;
    null ids are kept, repeated rows give repeated rows, no documents no rows.
    """
    coded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), codes_udf("text").alias("c")).select("doc_id", "text_hash", "c.*")
    rows = stored(coded, "similar-rows")
    codes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("first_id"), F.first("fps").alias("fps"), F.first("fine").alias("fine")), "similar-codes")
    links = verified_links(docs, rows, codes.where(F.col("code") != 0).drop("first_id"), similarity)
    roots = stored(connected_components(links.select("a", "b")), "similar-roots")
    rooted = codes.select("code", "first_id").join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("code", "root", "component_id"), "similar-classes")
    return rows.select("doc_id", "text_hash", "code").join(classes, "code").select("doc_id", "text_hash", "code", "root", "component_id")


def drop_similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of ``similar_documents``, with all its columns.

    It is the row with the least doc_id; if several have it, one with the least code. A class
    without any id keeps a row with its root's code.
    """
    first = F.when(F.col("component_id").isNull(), F.col("code") == F.col("root")).otherwise(F.col("doc_id") == F.col("component_id"))
    keep = stored(similar_documents(docs, similarity).where(first).groupBy("root", F.col("doc_id").alias("_id")).agg(F.min(F.struct("code", "text_hash"))["text_hash"].alias("_hash"), F.count("*").alias("n")), "similar-keep")
    who, text_hash = apart("_id", docs), apart("_hash", docs)
    same = F.col("doc_id").eqNullSafe(F.col(who)) & (F.xxhash64("text") == F.col(text_hash))
    kept = docs.join(keep.select(F.col("_id").alias(who), F.col("_hash").alias(text_hash)), same, "left_semi")
    return kept if keep.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
