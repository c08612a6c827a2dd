"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to sources. How many rows each source sends to each shard is drawn from the
multivariate hypergeometric law, which is the law of those counts under a uniform permutation
of all rows. Each source then permutes its rows and cuts them by its counts (the exchange), and
each shard permutes what it got. Only counts, bounded by ``fan`` squared times the shards, are
seen by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored


def uniform(*parts: Column) -> Column:
    """A double in (0, 1) from a hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(pop: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` of ``pop``, by inverting the distribution at ``u``.

    Sums run over the mode plus or minus 9 standard deviations and 20; what lies outside is below
    the resolution of a double.
    """
    pop, good, drawn = (c.cast("double") for c in (pop, good, drawn))
    low, high = F.greatest(F.lit(0.0), drawn - (pop - good)), F.least(drawn, good)
    mode = F.floor((drawn + 1) * (good + 1) / (pop + 2)).cast("double")
    spread = F.sqrt(drawn * (good / F.greatest(pop, F.lit(1.0))) * F.greatest(F.lit(0.0), 1 - good / F.greatest(pop, F.lit(1.0))) * (pop - drawn) / F.greatest(pop - 1, F.lit(1.0)))
    width = F.ceil(spread * 9).cast("double") + 20
    a, b = F.greatest(low, mode - width), F.least(high, mode + width)
    ks = F.sequence(a.cast("long"), F.greatest(a, b).cast("long"))

    def ratio(k: Column) -> Column:
        return (good - k) * (drawn - k) / ((k + 1) * F.greatest(pop - good - drawn + k + 1, F.lit(1.0)))

    first = F.lit(1e-200)
    total = F.aggregate(ks, F.struct(first.alias("w"), F.lit(0.0).alias("sum")), lambda s, k: F.struct((s["w"] * ratio(k.cast("double"))).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    return F.aggregate(
        ks,
        F.struct(first.alias("w"), F.lit(0.0).alias("sum"), a.cast("long").alias("x"), (total * u).alias("goal")),
        lambda s, k: F.struct((s["w"] * ratio(k.cast("double"))).alias("w"), (s["sum"] + s["w"]).alias("sum"), (s["x"] + (s["sum"] + s["w"] < s["goal"]).cast("long")).alias("x"), s["goal"].alias("goal")),
        lambda s: F.least(s["x"], b.cast("long")),
    )


def _rows_of(row: DataFrame, counts: str, room: str, key: str, seed: int) -> DataFrame:
    """For each row: from ``counts`` (array of source sizes) and ``room`` (array of shard sizes), one array of counts per source, as ``drawn``."""
    total = F.aggregate(F.col(room), F.lit(0).cast("long"), lambda s, x: s + x)
    step = row.withColumn("_i", F.sequence(F.lit(0), F.size(counts) - 1))

    def source(state: Column, i: Column) -> Column:
        n = F.col(counts)[i]

        def shard(inner: Column, j: Column) -> Column:
            good = state["room"][j]
            x = hypergeometric(inner["pop"], good, inner["left"], uniform(F.lit(seed), F.col(key), i, j))
            # each draw is used three times, so it is bound to a name: an array of one element, transformed
            return F.transform(F.array(x), lambda d: F.struct((inner["left"] - d).alias("left"), (inner["pop"] - good).alias("pop"), F.concat(inner["out"], F.array(d)).alias("out")))[0]

        got = F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), F.struct(n.cast("long").alias("left"), state["pop"].alias("pop"), F.array().cast("array<bigint>").alias("out")), shard, lambda s: s["out"])
        return F.transform(F.array(got), lambda o: F.struct((state["pop"] - n).cast("long").alias("pop"), F.zip_with(state["room"], o, lambda r, d: r - d).alias("room"), F.concat(state["rows"], F.array(o)).alias("rows")))[0]

    zero = F.struct(total.alias("pop"), F.col(room).cast("array<bigint>").alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return step.withColumn("drawn", F.aggregate("_i", zero, source, lambda s: s["rows"])).drop("_i")


def communication_matrix(sizes: DataFrame, n_shards: int, fan: int, seed: int) -> DataFrame:
    """From (source int, n long), sources 0 to fan*fan - 1: (source, counts array<long> of rows for each shard).

    Drawn in two levels, groups of ``fan`` sources first, then the sources of each group side by side.
    """
    full = sizes.sparkSession.range(fan * fan).select(F.col("id").cast("int").alias("source")).join(sizes, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    groups = full.groupBy((F.col("source") / fan).cast("int").alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: x["n"]).alias("members"), F.sum("n").alias("n"))
    whole = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "n"))), lambda x: x["n"]).alias("counts"), F.sum("n").alias("total"))
    shard_size = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: (F.floor(F.col("total") / n_shards) + (s < F.col("total") % n_shards).cast("long")).cast("long"))
    top = _rows_of(whole.withColumn("room", shard_size).withColumn("key", F.lit("groups")), "counts", "room", "key", seed)
    parts = top.select(F.posexplode("drawn").alias("grp", "room"))
    below = _rows_of(groups.join(F.broadcast(parts), "grp").withColumn("key", F.concat(F.lit("group"), F.col("grp"))), "members", "room", "key", seed)
    return below.select("grp", F.posexplode("drawn").alias("i", "counts")).select((F.col("grp") * fan + F.col("i")).cast("int").alias("source"), "counts")


def shuffle_to_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, rows_per_source: int = 1_000_000, rows_per_bucket: int = 250_000) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) in a uniformly random shard of an exact size, at a uniformly random slot.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ``rows``, shard, slot
    (0 to the shard's size - 1, without gaps) and grown_shard (null). Shard sizes differ by one at most.
    Null and empty texts have size 8 and checksum 0. Repeated rows and null ids are rows of their own.
    An empty table gives an empty result. Other columns of ``docs`` are not carried. Equal texts are
    not kept together: a uniform shuffle treats rows alike. The same files read the same way and the
    same seed give the same result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_uid")), "shard-rows")
    n = rows.count()
    fan = min(64, max(8, math.ceil(math.sqrt(n / rows_per_source))))
    buckets = min(4096, max(16, math.ceil(n / n_shards / rows_per_bucket)))
    deal = rows.withColumn("source", F.pmod(F.xxhash64(F.lit(seed), "_uid"), F.lit(fan * fan)).cast("int"))
    matrix = communication_matrix(deal.groupBy("source").agg(F.count("*").alias("n")), n_shards, fan, seed)
    # the matrix has at most 4096 rows of n_shards numbers
    cuts = matrix.select("source", F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("long"), lambda a, x: a + x)).alias("_cuts"))
    local = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "_uid"), "_uid")
    sent = (
        deal.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "source")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))))
        .withColumn("_key", F.xxhash64(F.lit(seed + 2), "_uid"))
        .withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(buckets)).cast("int"))
        .select("doc_id", "size", "text_crc32", "_uid", "shard", "_key", "_bucket")
    )
    # at most 4096 buckets a shard
    offsets = sent.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    again = Window.partitionBy("shard", "_bucket").orderBy("_key", "_uid")
    return (
        sent.withColumn("_at", F.row_number().over(again) - 1)
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
