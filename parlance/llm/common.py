"""What the training-data operators share: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only on a local master, where one machine does everything (tests), is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            named = own.get()
        elif spark.sparkContext.master.startswith("local"):
            named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut, and lost executors cost nothing.

    The table stays in that folder, as the result is read lazily; whoever owns the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == remainder, F.lit(False))


def apart(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores more as set it apart from the columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that to ASCII texts; only others take the slower translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


SMALL, SMALL_BYTES = 200_000, 64_000_000


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most SMALL rows of at most SMALL_BYTES together (as JSON), by a count of no more than that."""
    n, size = df.limit(SMALL + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= SMALL and size <= SMALL_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if ``is_small`` finds it so."""
    return F.broadcast(df) if is_small(df) else df


def attach(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """``left`` joined with ``right`` (one row a key), by broadcast if that is small, else so that a frequent key of ``left`` is dealt to ``salts`` tasks by a hash of ``spread``."""
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    salt = apart("_salt", left)
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).join(salted, [*keys, salt], how).drop(salt)
