"""Utterance operators: merging, turns, order of mentions and overlap of vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import sentence, token_overlap
from parlance.operators.events import neighbours, running
from parlance.operators.guards import checked
from parlance.sources.scratch import scratch


def drop_empty(utts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return utts.where(F.size(tokens) > 0)


def filter_role(utts: DataFrame, role: str, value: str) -> DataFrame:
    return utts.where(F.col(role) == value)


def order_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, in that order; the others keep theirs."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def transform_utts(utts: DataFrame, change: Callable[[Column], Column], tokens: str = "tokens") -> DataFrame:
    """Tokens changed by a function; utterances left without any are dropped."""
    return drop_empty(utts.withColumn(tokens, change(F.col(tokens))), tokens)


def _joined(start: str, tokens: str) -> list[Column]:
    in_order = F.array_sort(F.collect_list(F.struct(start, "end", tokens)))
    return [F.min(start).alias(start), F.max("end").alias("end"), F.flatten(F.transform(in_order, lambda x: x[tokens])).alias(tokens)]


def merge_speaker_utts(utts: DataFrame, keys: Sequence[str] = ("dyad", "round", "speaker"), role: str | None = None, start: str = "start", tokens: str = "tokens") -> DataFrame:
    """One utterance for each speaker and round: least start, greatest end, tokens in order of time. With ``role`` an error if a speaker has two in a round."""
    more = [checked(F.min(role), F.count_distinct(role) <= 1, "a speaker has several roles in a round").alias(role)] if role else []
    return utts.groupBy(*keys).agg(*_joined(start, tokens), *more)


def speaker_turns(utts: DataFrame, part: Sequence[str] = ("dyad",), same: Sequence[str] = ("speaker",), start: str = "start") -> DataFrame:
    """``turn_no``: runs of consecutive utterances that are equal in ``same``, numbered from 1."""
    near = neighbours(utts, part, [start, "end"], {"_same": F.struct(*same)})
    fresh = F.col("_same").isNull()
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.col("_same")[c])
    return running(near.withColumn("_new", fresh.cast("int")), part, [start, "end"], {"turn_no": ("sum", F.col("_new"))}).drop("_new", "_same")


def merge_consecutive_utts(utts: DataFrame, part: Sequence[str] = ("dyad", "round"), same: Sequence[str] = ("speaker",), start: str = "start", tokens: str = "tokens", keep_first_empty: bool = False) -> DataFrame:
    """Runs of consecutive utterances of one speaker in a round, merged. Empty ones are dropped first; with ``keep_first_empty`` not the first of a round."""
    if keep_first_empty:
        first = F.row_number().over(Window.partitionBy(*part).orderBy(start, "end")) == 1
        utts = utts.withColumn("_first", first).where((F.size(tokens) > 0) | F.col("_first")).drop("_first")
    else:
        utts = drop_empty(utts, tokens)
    return speaker_turns(utts, part, same, start).groupBy(*part, *same, "turn_no").agg(*_joined(start, tokens))


def dialogue_text(utts: DataFrame, dyad: str = "dyad", speaker: str = "speaker", start: str = "start", tokens: str = "tokens") -> DataFrame:
    """(dyad, text): a line ``**speaker:** "Sentence. Sentence."`` for each turn."""
    turns = speaker_turns(drop_empty(utts, tokens), (dyad,), (speaker,), start)
    said = turns.groupBy(dyad, speaker, "turn_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, "end", sentence(F.col(tokens)).alias("s")))), lambda x: x["s"]), " ").alias("said"))
    line = F.concat(F.lit("**"), speaker, F.lit(':** "'), "said", F.lit('"'))
    return said.groupBy(dyad).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def coref_order(utts: DataFrame, keys: Sequence[str], by: Sequence[str] = ("round", "start", "end")) -> DataFrame:
    """``ordinal``: which mention of its chain an utterance is, from 1."""
    return utts.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def within_speaker_overlap(utts: DataFrame, keys: Sequence[str] = ("dyad", "speaker"), by: Sequence[str] = ("round", "start", "end"), tokens: str = "tokens") -> DataFrame:
    """``ordinal``, ``previous_start`` and ``overlap`` with the speaker's previous mention of the chain; 0 for the first."""
    counted = neighbours(utts, keys, by, {"previous_start": F.col("start"), "_before": F.col(tokens)}, folds={"ordinal": ("sum", F.lit(1))})
    overlap = F.when(F.col("ordinal") == 1, F.lit(0.0)).otherwise(token_overlap(F.col(tokens), F.col("_before")))
    return counted.select(*utts.columns, F.col("ordinal").cast("int").alias("ordinal"), "previous_start", overlap.alias("overlap"))


def between_speaker_overlap(utts: DataFrame, keys: Sequence[str] = ("dyad",), speaker: str = "speaker", by: Sequence[str] = ("round", "start", "end"), tokens: str = "tokens", mode: str = "alternating") -> DataFrame:
    """Overlap with the mention before in a chain. ``alternating``: the last of each run of one speaker's mentions; ``as_run``: every mention, by start."""
    if mode not in ("alternating", "as_run"):
        raise ValueError(mode)
    if mode == "as_run":
        return within_speaker_overlap(utts, keys, ("start", "end"), tokens)
    last = neighbours(utts, keys, by, ahead={"_next": F.col(speaker)}).where(F.col("_next").isNull() | (F.col("_next") != F.col(speaker))).drop("_next")
    return within_speaker_overlap(last, keys, by, tokens)


def overlap_summary(rows: DataFrame, ordinal: str = "ordinal", overlap: str = "overlap", least: int = 2) -> DataFrame:
    """Mean, sample deviation and standard error of the overlap for each ordinal from ``least`` on; deviation and error are null for one value."""
    return rows.where(F.col(ordinal) >= least).groupBy(ordinal).agg(F.count(overlap).alias("n"), F.avg(overlap).alias("mean"), F.stddev_samp(overlap).alias("std"), (F.stddev_samp(overlap) / F.sqrt(F.count(overlap))).alias("sem"))


#: bucket of an ordinal whose sets are compared whole
WHOLE = -2
#: tokens that more than this share of a block's pairs have in common are columns of a product, the others are joined posting by posting
OFTEN = 0.003
#: so many pairs at least are compared whole in the time of one in the index
CHEAPER = 5


def _all_overlaps(later: pd.DataFrame, before: pd.DataFrame, side: int = 1000, wide: int = 2048, most: int = 1 << 22) -> pd.DataFrame:
    """(shared, total, n) of all pairs of a row of each block, ``total`` the sum of their sizes; rows are (t: tokens, n).

    Frequent tokens are counted by products of ``side`` rows and as many, ``wide`` tokens at a time; the others by
    joining the postings of both sides, at most ``most`` meetings at a time and a row's tokens of ``side``.
    """
    (size_a, ta), (size_b, tb) = ((df["t"].map(len).to_numpy(np.int64), np.concatenate(df["t"].to_list()).astype(np.int64)) for df in (later, before))
    na, nb = (df["n"].to_numpy(np.int64) for df in (later, before))
    names, codes = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    ca, cb = codes[: len(ta)], codes[len(ta) :]
    met = np.bincount(ca, minlength=len(names)) * np.bincount(cb, minlength=len(names))
    often = met > OFTEN * len(later) * len(before)
    # the first two columns of a product are for the sizes
    column, rare = np.where(often, np.cumsum(often) + 1, -1), (met > 0) & ~often
    columns, width = int(often.sum()) + 2, int(size_a.max() + size_b.max()) + 1
    cells = (int(min(size_a.max(), size_b.max())) + 1) * width
    exact = np.float32 if cells <= most else np.float64  # keys are below ``cells``
    table, loose = np.zeros(cells if cells <= most else 0, np.int64), []

    def posted(code: np.ndarray, size: np.ndarray, start: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, from 0, and codes of one kind of the ``side`` rows from ``start``."""
        end = np.concatenate([[0], np.cumsum(size)])
        part, rows = code[end[start] : end[min(start + side, len(size))]], np.repeat(np.arange(len(size[start : start + side]), dtype=np.int32), size[start : start + side])
        kept = which[part]
        return rows[kept], part[kept]

    def product_side(row: np.ndarray, code: np.ndarray, rows: int, start: int, value: int) -> np.ndarray:
        at = column[code] - start
        hit = (at >= 0) & (at < wide)
        out = np.zeros((rows, min(wide, columns - start)), exact)
        out[row[hit], at[hit]] = value
        return out

    blocks_x = [(size_a[x : x + side], na[x : x + side], *posted(ca, size_a, x, often), *posted(ca, size_a, x, rare)) for x in range(0, len(later), side)]
    for y in range(0, len(before), side):
        size_y, n_y = size_b[y : y + side], nb[y : y + side]
        often_y, (row_y, code_y) = posted(cb, size_b, y, often), posted(cb, size_b, y, rare)
        by_code = row_y[np.argsort(code_y, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(code_y, minlength=len(names)))]).astype(np.int32)
        for size_x, n_x, often_row, often_code, row, code in blocks_x:
            lo, times = first[code], first[code + 1] - first[code]
            lo, times, row = lo[times > 0], times[times > 0], row[times > 0] * np.int32(len(size_y))
            ends = np.cumsum(times, dtype=np.int64)
            cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), [len(ends)]]))
            key = np.zeros(len(size_x) * len(size_y), np.int64)
            for i, j in zip(cuts[:-1], cuts[1:]):
                start = ends[i] - times[i]
                at = np.repeat((lo[i:j] - (ends[i:j] - times[i:j] - start)).astype(np.int32), times[i:j])
                at += np.arange(len(at), dtype=np.int32)
                at = by_code[at]
                at += np.repeat(row[i:j], times[i:j])
                met_here = np.bincount(at, minlength=len(key))
                key = met_here if i == 0 else key + met_here
            # shared * width + total
            key *= width
            for start in range(0, columns, wide):
                left, right = product_side(often_row, often_code, len(size_x), start, width), product_side(*often_y, len(size_y), start, 1)
                if start == 0:
                    left[:, 0], right[:, 0], left[:, 1], right[:, 1] = size_x, 1, 1, size_y
                np.add(key, (left @ right.T).ravel(), out=key, casting="unsafe")
            n = None if n_x.max() == n_y.max() == 1 else np.outer(n_x, n_y).ravel()
            if len(table) == 0:
                key, place, times = np.unique(key, return_inverse=True, return_counts=True)
                found = times if n is None else np.zeros(len(key), np.int64)
                if n is not None:
                    np.add.at(found, place.ravel(), n)
                loose.append(pd.Series(found, key))
                if sum(map(len, loose)) > most:
                    loose = [pd.concat(loose).groupby(level=0).sum()]
            elif n is None:
                table += np.bincount(key, minlength=cells)
            else:
                np.add.at(table, key, n)
    counts = pd.concat(loose).groupby(level=0).sum() if loose else pd.Series(table[table > 0], np.flatnonzero(table))
    key = counts.index.to_numpy(np.int64)
    return pd.DataFrame({"shared": key // width, "total": key % width, "n": counts.to_numpy(np.int64)})


def _block_overlaps(later: pd.DataFrame, before: pd.DataFrame, bucket: int) -> pd.DataFrame:
    """(shared, total, n) of the pairs of a row of each block whose first common bucket is ``bucket``, ``total`` the sum of their sizes, and the same pairs with n below zero where their marked tokens alone (bucket -1) put them.

    Rows are (t: tokens, g: the bucket of each, size, n).
    """

    def flat(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(df)), [len(t) for t in df["t"]]), np.concatenate(df["t"].to_list()).astype(np.int64), np.concatenate(df["g"].to_list()).astype(np.int64)

    (ra, ta, ga), (rb, tb, _) = flat(later), flat(before)
    tokens, at = np.unique(ta, return_index=True)
    here = np.isin(tokens, tb)
    tokens, buckets = tokens[here], ga[at[here]]

    def common(which: np.ndarray) -> np.ndarray:
        """How many of these tokens each pair has in common; some columns at a time."""
        total = np.zeros((len(later), len(before)), np.float32)
        wanted = tokens[which]
        for start in range(0, len(wanted), 4096):
            part, sides = wanted[start : start + 4096], []
            for rows, own, n in ((ra, ta, len(later)), (rb, tb, len(before))):
                col = np.minimum(np.searchsorted(part, own), len(part) - 1)
                hit = part[col] == own
                side = np.zeros((n, len(part)), np.float32)
                side[rows[hit], col[hit]] = 1
                sides.append(side)
            total += sides[0] @ sides[1].T
        return total

    own, earlier = common(buckets == bucket), common((buckets >= 0) & (buckets < bucket))
    i, j = np.nonzero((own > 0) & (earlier == 0))
    marked = common(buckets < 0)[i, j].astype(np.int64)
    shared = marked + (own + common(buckets > bucket))[i, j].astype(np.int64)
    size_a, size_b = later["size"].to_numpy(np.int64), before["size"].to_numpy(np.int64)
    wide = int(size_a.max() + size_b.max()) + 1
    total, n = size_a[i] + size_b[j], later["n"].to_numpy(np.int64)[i] * before["n"].to_numpy(np.int64)[j]
    changes = [pd.Series(v, copy=False).groupby(at * wide + total, sort=False).sum() for at, v in ((shared, n), (marked, -n))]
    key = np.concatenate([c.index.to_numpy(np.int64) for c in changes])
    return pd.DataFrame({"shared": key // wide, "total": key % wide, "n": np.concatenate([c.to_numpy(np.int64) for c in changes])})


def previous_order_pairs(utts: DataFrame, tokens: str = "tokens", ordinal: str = "ordinal", block: int = 1000, marks: int = 6) -> DataFrame:
    """(ordinal, overlap, n): overlaps of all mentions with all of the ordinal before, over all dyads, with how many pairs have them.

    Equal token sets of an ordinal are one row with a count. An ordinal whose pairs nearly all share
    tokens is compared whole, in blocks of 20 * ``block`` sets (fewer if they are long) by as many, so its work is its pairs, see ``_all_overlaps``.
    In the others, of the tokens that more than ``block``
    sets of an ordinal hold, the ``marks`` most frequent are bits of a mask: pairs of masks and sizes,
    whose number does not grow with the rows, count every pair by its marked tokens, zeros included.
    The other tokens are an inverted index: rare ones share buckets of about ``block`` postings, each
    other token has its own, in parts of ``block`` sets. A pair is moved to its whole overlap in the
    first bucket that it shares, by a product of two blocks, so no pair is a row, and a set goes only
    where it has tokens in common with the other side. There the work grows with the pairs that share
    a token which is not marked. Empty sets overlap by NaN; null ordinals and arrays are left out.
    """

    def table(df: DataFrame, what: str) -> DataFrame:
        path = scratch(utts.sparkSession, what)
        df.write.parquet(path)
        return utts.sparkSession.read.schema(df.schema).parquet(path)

    words = F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))
    sets = utts.where(F.col(ordinal).isNotNull() & F.col(tokens).isNotNull()).groupBy(F.col(ordinal).cast("long").alias("o"), F.array_sort(words).alias("s")).agg(F.count("*").alias("n"))
    sets = table(sets, "token-sets")
    sides = F.explode(F.array(F.struct("o", F.lit(True).alias("later")), F.struct((F.col("o") + 1).alias("o"), F.lit(False).alias("later"))))

    def both(df: DataFrame, *columns) -> DataFrame:
        """Rows as those of the later side, and as those of the side before of the next ordinal."""
        return df.select(sides.alias("p"), *columns).select("p.*", *[c for c in df.columns if c != "o"])

    counted = both(sets.select("o", F.explode("s").alias("t")).groupBy("o", "t").agg(F.count("*").alias("c")), "t", "c")
    held = counted.groupBy("o", "t").agg(*[F.coalesce(F.sum(F.when(side, F.col("c"))), F.lit(0)).alias(c) for c, side in (("a", F.col("later")), ("b", ~F.col("later")))]).where((F.col("a") > 0) & (F.col("b") > 0))
    many = (F.col("a") > block) | (F.col("b") > block)
    rank = F.row_number().over(Window.partitionBy("o").orderBy(F.desc(F.col("a") * F.col("b")), "t"))  # at most a thousandth of the postings are tokens of this kind
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    ranked = held.where(many).withColumn("r", rank.cast("long")).unionByName(held.where(~many).withColumn("r", F.lit(None).cast("long")))
    unmarked, own = F.col("r").isNull() | (F.col("r") > marks), F.col("r").isNotNull()
    # products of blocks for each ordinal: over the index, and over all its sets
    index = ranked.where(unmarked).groupBy("o").agg(F.sum(F.when(own, parts("a", block) * parts("b", block)).otherwise(0)).alias("products"), F.ceil(F.sum(F.when(own, 0).otherwise(F.col("a") + F.col("b"))) / (2 * block)).alias("bins"))
    whole = both(sets.groupBy("o").agg(F.count("*").alias("sets"), F.sum(F.size("s")).alias("held")), "sets", "held").groupBy("o").agg(
        *[F.sum(F.when(side, F.col(x))).alias(f"{x}_{n}") for n, side in (("a", F.col("later")), ("b", ~F.col("later"))) for x in ("sets", "held")]
    ).where("sets_a > 0 and sets_b > 0")
    dense = parts("sets_a", block) * parts("sets_b", block) <= CHEAPER * (F.col("products") + F.col("bins"))
    # a block of 20 * block sets has 200 tokens a set at most
    large = lambda x: F.greatest(parts(f"sets_{x}", 20 * block), parts(f"held_{x}", 4000 * block))
    kinds = whole.join(index, "o", "left").select("o", "bins", F.coalesce(dense, F.lit(False)).alias("dense"), large("a").alias("pa"), large("b").alias("pb"))

    rows = both(sets.withColumns({"h1": F.xxhash64("s", F.lit(1)), "h2": F.xxhash64("s", F.lit(2)), "size": F.size("s").cast("long")}), "h1", "h2", "size", "n", "s").join(kinds, "o")
    plain = rows.where("dense").select("o", "later", "h1", "h2", "size", "n", F.lit(None).cast("long").alias("mask"), F.col("s").alias("t"), F.lit(None).cast("array<long>").alias("g"), F.array(F.struct(F.lit(WHOLE).cast("long").alias("g"), "pa", "pb")).alias("places"))
    coding = ranked.join(kinds.where(~F.col("dense")).select("o", "bins"), "o").select(
        "o", "t", F.when(~unmarked, F.expr("shiftleft(1L, cast(r - 1 as int))")).alias("bit"),
        F.when(~unmarked, -1).when(own, F.col("r") + (1 << 40)).otherwise(F.pmod(F.xxhash64("t", F.lit(3)), F.col("bins"))).cast("long").alias("g"),
        *[F.when(own, parts(n, block)).otherwise(1).alias(p) for p, n in (("pa", "a"), ("pb", "b"))],
    )
    postings = rows.where(~F.col("dense")).select("o", "later", "h1", "h2", "size", "n", F.explode_outer("s").alias("t"))
    coded = postings.join(coding, ["o", "t"], "left").groupBy("o", "later", "h1", "h2", "size", "n").agg(
        F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("mask"), F.collect_list(F.when(F.col("g").isNotNull(), F.struct("t", "g"))).alias("held"), F.collect_set(F.when(F.col("g") >= 0, F.struct("g", "pa", "pb"))).alias("places"),
    ).select("o", "later", "h1", "h2", "size", "n", "mask", F.col("held.t").alias("t"), F.col("held.g").alias("g"), "places")
    coded = table(coded.unionByName(plain), "overlaps")

    masks = coded.where("mask is not null").groupBy("o", "later", "size", "mask").agg(F.sum("n").alias("n"))
    # first the masks of the other side to each of this side's rows, then the other side's sizes to their masks
    others = masks.where(~F.col("later")).select("o", F.col("mask").alias("other")).distinct()
    a = masks.where("later").join(others, "o").groupBy("o", "other", F.bit_count(F.col("mask").bitwiseAND(F.col("other"))).cast("long").alias("shared"), F.col("size").alias("size_a")).agg(F.sum("n").alias("na"))
    b = masks.where(~F.col("later")).select("o", F.col("size").alias("size_b"), F.col("mask").alias("other"), F.col("n").alias("nb"))
    marked = a.join(b, ["o", "other"]).groupBy("o", "shared", (F.col("size_a") + F.col("size_b")).alias("total")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))

    placed = coded.select("o", "later", "size", "n", "t", "g", F.xxhash64("h1", "h2").alias("h"), F.explode("places").alias("p"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    later = placed.where("later").select("o", F.col("p.g").alias("bucket"), F.pmod("h", "p.pa").alias("i"), to_all("p.pb").alias("j"), "t", "g", "size", "n")
    before = placed.where(~F.col("later")).select("o", F.col("p.g").alias("bucket"), to_all("p.pa").alias("i"), F.pmod("h", "p.pb").alias("j"), F.col("t").alias("t_"), F.col("g").alias("g_"), F.col("size").alias("size_"), F.col("n").alias("n_"))

    def counts(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.rename(columns=lambda c: c.rstrip("_"))
        if not len(x) or not len(y):
            out = pd.DataFrame({"shared": [], "total": [], "n": []}, dtype="int64")
        else:
            out = _all_overlaps(x, y) if key[1] == WHOLE else _block_overlaps(x, y, int(key[1]))
        out.insert(0, "o", key[0])
        return out

    keys = ["o", "bucket", "i", "j"]
    moved = later.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(counts, "o long, shared long, total long, n long")
    overlap = F.try_divide("shared", F.col("total") - F.col("shared"))
    kind = utts.schema[ordinal].dataType
    return marked.unionByName(moved).groupBy(F.col("o").cast(kind).alias(ordinal), F.coalesce(overlap, F.lit(float("nan"))).alias("overlap")).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def pair_overlap_summary(pairs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """As ``overlap_summary``, over counted overlaps."""
    x, n = F.col("overlap"), F.col("n")
    one = pairs.groupBy(ordinal).agg(F.sum("n").alias("pairs"), F.sum(x * n).alias("s"), F.sum(x * x * n).alias("ss"))
    var = F.when(F.col("pairs") > 1, F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("pairs")) / F.greatest(F.col("pairs") - 1, F.lit(1))))
    return one.select(ordinal, F.col("pairs").alias("n"), (F.col("s") / F.col("pairs")).alias("mean"), F.sqrt(var).alias("std"), (F.sqrt(var) / F.sqrt("pairs")).alias("sem"))


def filter_order(df: DataFrame, lo: int, hi: int, size: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``size`` from ``lo`` to ``hi``; one row of how many were below and above)."""
    removed = df.agg(F.sum((F.col(size) < lo).cast("int")).alias("removed_low"), F.sum((F.col(size) > hi).cast("int")).alias("removed_high"))
    return df.where(F.col(size).between(lo, hi)), removed


def session_stats(utts: DataFrame, dyad: str = "dyad", tokens: str = "tokens") -> DataFrame:
    """Duration, rounds, utterances, tokens and utterance durations of each session; a session without utterances has no row."""
    n, d = F.size(tokens), F.col("end") - F.col("start")
    return utts.groupBy(dyad).agg(
        (F.max("end") - F.min("start")).alias("duration"), F.count_distinct("round").alias("rounds"), F.count("*").alias("utts"), F.sum(n).alias("tokens"),
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("mean_tokens"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.avg(d).alias("mean_duration"),
    )


def stats_rollup(stats: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows MIN, MAX, MEAN and SUM of ``values`` over all sessions."""
    one = stats.agg(*[f(v).cast("double").alias(f"{name}_{v}") for v in values for name, f in (("MIN", F.min), ("MAX", F.max), ("MEAN", F.avg), ("SUM", F.sum))])
    rows = F.array(*[F.struct(F.lit(name).alias("stat"), *[F.col(f"{name}_{v}").alias(v) for v in values]) for name in ("MIN", "MAX", "MEAN", "SUM")])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def game_summary(utts: DataFrame, rounds: DataFrame, game: str = "game") -> DataFrame:
    """Completed rounds, utterances and duration to the last event of each game. ``rounds`` is (game, round, time)."""
    e = rounds.groupBy(game).agg(F.max("round").alias("rounds"), (F.max("time") - F.min("time")).alias("duration"))
    return e.join(utts.groupBy(game).agg(F.count("*").alias("utts")), game, "left").withColumn("utts", F.coalesce("utts", F.lit(0)))


def dialogue_edges(df: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """The first and last ``value`` of each dialogue."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*by)).alias("first"), F.max_by(value, F.struct(*by)).alias("last"))


def last_round_timing(rounds: DataFrame, game: str = "game", round_: str = "round", time: str = "time") -> DataFrame:
    """(game, round, last_time, previous_time, offset, difference) from (game, round, time) events: the round's and the previous round's last event, from the game's start and apart."""
    last = rounds.groupBy(game, round_).agg(F.max(time).alias("last_time"))
    timed = neighbours(last, [game], [round_], {"previous_time": F.col("last_time")}, folds={"_start": ("min", F.col("last_time"))})  # times rise with rounds, so the least up to here is the game's first
    return timed.select(game, round_, "last_time", "previous_time", (F.col("previous_time") - F.col("_start")).alias("offset"), (F.col("last_time") - F.col("previous_time")).alias("difference"))


def attrition(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(step_no, step, rows, columns) after each cleaning step."""
    out = None
    for i, (name, df) in enumerate(steps):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def canonical_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value for each key; an error if a key has several."""
    return df.groupBy(key).agg(checked(F.min(value), F.count_distinct(value) <= 1, "a key has several values").alias(value))


def join_transformed(utts: DataFrame, transformed: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of the transformed utterance with the same key, empty if there is none; an error if a key has several."""
    return utts.join(canonical_map(transformed.select(key, value), key, value), key, "left").withColumn(value, F.coalesce(value, F.lit("")))
