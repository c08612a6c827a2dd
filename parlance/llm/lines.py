"""Line deduplication against levelled sorted runs of line hashes.

The lines seen so far stand in sorted runs, Parquet tables bucketed and sorted by the hash of a line, so
that joins of runs are merges without an exchange. Each new batch of documents is merge-anti-joined
with all runs, which tells the lines that are seen for the first time, and adds a run of its own; when a
level has ``fan`` runs they are compacted into one of the next level. Batches go from the greatest ids
down, so the first document seen with a line is the one that keeps it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import ascii_lower, attach, shared_dir, stored

#: white space that is stripped from both ends of a line
BLANKS = " \t\n\x0b\x0c\r"
#: batches that a table is cut into, and runs of a level that are compacted
BATCHES, FAN = 6, 3
KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    """What lines are compared by: without white space at the ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of line hashes: (h, g, n) with the number of documents that hold a line.

    Runs are tables in the shared folder; each holds a line once. Lost executors cost nothing, as a run
    is written whole before it is used.
    """

    def __init__(self, spark: SparkSession, fan: int = FAN) -> None:
        self.spark, self.fan, self.levels = spark, fan, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.format("parquet").option("path", f"{shared_dir(self.spark)}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """(h, g, holder) of the lines of ``batch`` (h, g, doc_id) that no run holds, with the greatest id that holds each; then the batch is a run itself.

        A document must come in one batch only. Null ids are one document, below all others.
        """
        own = batch.distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        run = self._write(own)
        first = stored(reduce(lambda left, seen: left.join(seen.select(*KEY), KEY, "left_anti"), self.runs(), run).select(*KEY, "holder"), "first-lines")
        self._push(run.drop("holder"), 0)
        return first

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            merged = self._write(_tally(self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    def totals(self) -> DataFrame:
        """(h, g, n) over all runs."""
        return _tally(self.runs())


def _tally(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy(*KEY).agg(F.sum("n").alias("n"))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, t, pos, h, g): place and hashes of each line of ``docs`` (doc_id, text) whose key has ``least_chars`` code points or more; ``t`` is a hash of the text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.where(F.octet_length("line") >= least_chars).select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc_id", "t", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"))


def batch_bounds(docs: DataFrame, batches: int) -> list[float]:
    """At most ``batches`` - 1 ids that cut the documents into like shares, from the greatest down."""
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 1 / (4 * batches)) if batches > 1 else []
    return sorted(set(cuts or []), reverse=True)


def repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, t, gone): sorted places, from 0, of the lines that ``docs`` (doc_id number, text) lose; see ``drop_repeated_lines``."""
    bounds = batch_bounds(docs, batches)
    cut = reduce(lambda c, i: c.when(F.col("doc_id") >= bounds[i], i), range(len(bounds)), F.when(F.lit(False), 0)).otherwise(len(bounds))
    lines = stored(long_lines(docs, least_chars).withColumn("batch", cut), "lines")
    runs = LineRuns(docs.sparkSession, fan)
    firsts = reduce(DataFrame.union, [runs.add(lines.where(F.col("batch") == i).select(*KEY, "doc_id")) for i in range(len(bounds) + 1)])
    frequent = stored(firsts.join(runs.totals().where(F.col("n") >= least_docs), KEY).select(*KEY, "holder"), "frequent-lines")
    gone = attach(lines, frequent, KEY, ["doc_id", "pos"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row of ``docs`` (doc_id a number, text), without lines that many documents share.

    Lines end at \\n. A line whose key (see ``line_key``) has ``least_chars`` code points or more and is in
    ``least_docs`` documents or more stays only in the document with the greatest id that holds it, there
    as often as it stands. A document is an id: rows of one id are one document, and so are all rows
    without an id, which come below all others. Null texts count as empty, an empty text is one empty
    line; repeated rows give repeated rows; an empty table gives no rows. Other columns are ignored.

    Only hashes of lines (128 bits) and places are counted and joined; each text is shuffled once, to
    meet the places of its own lines that go.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = repeated_lines(texts, least_chars, least_docs, batches, fan).withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    both = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    ends = F.concat("gone", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s)))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    cut = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    return cut.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
