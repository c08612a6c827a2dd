"""SimHash near-duplicates: an exact Hamming join through a Gray-ordered hierarchical index.

Two fingerprints that differ in at most ``k`` of 64 bits agree on one of ``k + 1`` blocks of bits, and
on two of ``k + 2``. Leading bits of these blocks, as many as leave about NODE codes together, are the
uppermost nodes of the index; Spark deals the distinct fingerprints to them. Inside a node they are
sorted by Gray rank, so that neighbours share long bit patterns; runs of them form lower nodes whose
shared bits are factored out, and a pair of nodes whose shared bits already differ in more than ``k``
places is pruned as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations, repeat
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from parlance.llm.common import stored
from parlance.llm.components import connected_components
from parlance.llm.minhash import MIX

BITS, WORDS, SEED = 64, 3, 42
LEAF, FAN, NODE = 8, 8, 2048


def simhash(text: str | None, width: int = WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(g) for g in zip(*(words[i:] for i in range(width)))]
    ones, n = np.zeros(BITS, np.int64), len(grams)
    for i in range(0, n, 1 << 15):
        part = grams[i : i + (1 << 15)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def majority(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """``lanes`` signed integers of 64 bits, each set where over half of ``hashes`` have it, mixed anew for each; 0 without hashes."""
    ones = np.zeros(BITS * lanes, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        mixed = np.stack([(part ^ (MIX << np.uint64(lane))) * MIX for lane in range(lanes)], axis=1)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8").tolist()


def block_masks(k: int, n: int) -> list[int]:
    """Masks, as signed integers, of which two codes within ``k`` bits agree on one; each leaves about NODE, or twice that, of ``n`` codes together, if it has that many bits.

    Codes within ``k`` bits agree on ``r`` of ``k + r`` blocks: the masks are leading bits of all
    choices of ``r`` blocks, for the least ``r`` up to 3 that has enough bits.
    """
    want = max(0, ceil(log2(max(n, 1) / NODE)))
    if not want:
        return [0]
    r = next((r for r in (1, 2) if r * BITS // (k + r) >= want - 1), 3)
    edges = [i * BITS // (k + r) for i in range(k + r + 1)]
    leading = [(1 << top) - (1 << max(low, top - -(-want // r))) for low, top in zip(edges, edges[1:])]
    masks = [reduce(int.__or__, chosen) for chosen in combinations(leading, r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of ``i`` and ``j`` in ``label``, where each points at a member of its class that is not above it."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def leaf_pairs(codes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Pairs (a <= b) of leaves, runs of LEAF ``codes`` (in Gray order), that the index cannot prune, some thousand at a time.

    Levels, from the leaves up: bits shared by all codes of a node, and where they are shared. From
    the root down, depth first, the pairs of children of a pair of nodes are pruned whose shared bits
    differ too much.
    """
    low, high = codes, codes  # and-ed, or-ed
    levels = []
    for width in chain([LEAF], repeat(FAN)):
        starts = np.arange(0, len(low), width)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        levels.append((low, ~(low ^ high)))
        if len(starts) == 1:
            break
    open_ = [(len(levels) - 1, np.zeros((1, 2), np.int64))]
    while open_:
        level, pairs = open_.pop()
        if not level:
            yield pairs
            continue
        low, shared = levels[level - 1]
        a = (pairs[:, 0, None] * FAN + np.arange(FAN))[:, :, None]
        b = (pairs[:, 1, None] * FAN + np.arange(FAN))[:, None, :]
        a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
        fits = (a <= b) & (b < len(low))
        a, b = a[fits], b[fits]
        near = np.bitwise_count((low[a] ^ low[b]) & shared[a] & shared[b]) <= k
        kept = np.stack([a[near], b[near]], 1)
        open_ += [(level - 1, part) for part in np.array_split(kept, -(-len(kept) // 4096))] if len(kept) else []


def near_leaves(codes: np.ndarray, k: int) -> np.ndarray:
    """All ``leaf_pairs`` in one array."""
    return np.concatenate([np.zeros((0, 2), np.int64), *leaf_pairs(codes, k)])


def link_node(codes: np.ndarray, k: int) -> np.ndarray:
    """Class labels (least index) of ``codes`` (in Gray order) under links of at most ``k`` bits."""
    n = len(codes)
    label = np.arange(n)
    padded = np.concatenate([codes, np.zeros(-n % LEAF, np.uint64)]).reshape(-1, LEAF)
    starts = np.arange(0, n, LEAF)
    for part in leaf_pairs(codes, k):
        least, last = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        a, b = part[:, 0], part[:, 1]
        part = part[(least[a] != last[a]) | (least[b] != last[b]) | (least[a] != least[b])]  # leaves of one class need no look
        at, x, y = np.nonzero(np.bitwise_count(padded[part[:, 0]][:, :, None] ^ padded[part[:, 1]][:, None, :]) <= k)
        i, j = part[at, 0] * LEAF + x, part[at, 1] * LEAF + y
        real = (i < j) & (j < n)
        join_labels(label, i[real], j[real])
    return label


def _link_groups(node: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``node`` keys: links (place of a code, place of its class's first member) inside each node."""
    order = np.lexsort((gray_rank(codes), node))
    node, codes = node[order], codes[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    label = np.arange(len(node))
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        label[s : s + n] = s + link_node(codes[s : s + n], k)
    size = np.repeat(sizes, sizes)
    d, small = 1, np.flatnonzero((size <= LEAF) & (size > 1))
    while len(small):
        small = small[small + d < len(node)]
        small = small[node[small] == node[small + d]]
        near = small[np.bitwise_count(codes[small] ^ codes[small + d]) <= k]
        join_labels(label, near, near + d)
        d += 1
    own = label != np.arange(len(label))
    return order[own], order[label[own]]


def deal(codes: DataFrame, total: int, k: int, keep: list[str], apart_by: list[str], hot: int = 20_000) -> DataFrame:
    """(fp, ``keep``..., node) of ``codes`` (fp long, ...), of ``total`` rows: each row in as many nodes as it needs to meet, in one of them, each row that is within ``k`` bits.

    Rows that differ in ``apart_by`` do not meet. Nodes of over ``hot`` codes, and over four times the mean, are split
    once more: what their mask leaves out is cut into ``k + 1`` parts of which a pair within ``k`` bits
    shares one, so no pair is lost.
    """
    masks = block_masks(k, total)
    bits = masks[0].bit_count() if masks[0] >= 0 else (masks[0] + (1 << BITS)).bit_count()
    hot = max(hot, 4 * total >> bits if bits else 0)
    key, columns = [*apart_by, "m", "key"], ["fp", *keep]
    keyed = codes.select(*columns, *apart_by, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("n")).select(*columns, *apart_by, "n.m", "n.key")
    heavy = keyed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key, F.lit(True).alias("heavy"))
    if heavy.isEmpty():
        return keyed.select(*columns, F.xxhash64(*key).alias("node"))
    subs = []
    for m in masks:
        free = [b for b in range(BITS) if not (m >> b) & 1]
        cut = [reduce(lambda x, b: x | 1 << b, free[i :: k + 1], 0) for i in range(k + 1)]
        subs.append(F.array(*[F.lit(c - (1 << BITS) if c >> (BITS - 1) else c) for c in cut]))
    part = F.transform(F.element_at(F.array(*subs), F.col("m") + 1), lambda c, i: F.xxhash64(*key, i, F.col("fp").bitwiseAND(c)))
    return keyed.join(heavy, key, "left").select(*columns, F.explode(F.when(F.col("heavy"), part).otherwise(F.array(F.xxhash64(*key)))).alias("node"))


def link_fingerprints(codes: DataFrame, k: int = 3, hot: int = 20_000) -> DataFrame:
    """From distinct (fp long): links (a, b) that join exactly the classes of "differ in at most ``k`` bits".

    Not every such pair is returned, but a chain of links between any two. Nodes of over ``hot`` codes are split, see ``deal``.
    """
    dealt = deal(codes, codes.count(), k, [], [], hot)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # node, fp

        def out(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _link_groups(node, fp.view(np.uint64), k)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        for batch in batches:
            got = [batch.column(c).to_numpy() for c in ("node", "fp")]
            got = got if rest is None else [np.concatenate(x) for x in zip(rest, got)]
            cut = np.searchsorted(got[0], got[0][-1]) if len(got[0]) else 0  # the last node may go on in the next batch
            if cut:
                yield out(*(x[:cut] for x in got))
            rest = [x[cut:] for x in got]
        if rest is not None and len(rest[0]):
            yield out(*rest)

    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long, root long, component_id) of each row of ``docs`` (doc_id, text).

    ``root`` names the class, ``component_id`` is its least doc_id. Null and blank texts have
    fingerprint 0 and are linked like others. Null ids don't count for the least id (null if a class
    has no other); repeated rows give repeated rows. No documents, no rows.
    """
    rows = stored(docs.select("doc_id", simhash_udf("text").alias("fp")), "simhash")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-codes")
    roots = stored(connected_components(link_fingerprints(codes.select("fp"), k)), "simhash-roots")
    rooted = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "root", "component_id")
