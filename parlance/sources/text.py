"""Text sources: session descriptors, word lists, look-up tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.guards import checked


def parent(path: str | None = None):
    """The directory part of a path column (default: of the file being read)."""
    return F.regexp_replace(F.col(path or "_metadata.file_path"), r"/[^/]*$", "")


def lines(spark: SparkSession, paths: Sequence[str] | str, glob: str = "*") -> DataFrame:
    """(path, line_no, value) of text files below ``paths``. Files are read whole, so lines keep their numbers; use it for descriptors and small logs."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "value"))


def discover_sessions(spark: SparkSession, paths: Sequence[str] | str, glob: str = "*.properties") -> DataFrame:
    """(session_dir, desc_path) of every descriptor below ``paths``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths if isinstance(paths, str) else list(paths))
    return found.select(F.regexp_replace("path", r"/[^/]*$", "").alias("session_dir"), F.col("path").alias("desc_path"))


def sessions_in(lines_: DataFrame) -> DataFrame:
    """(session_dir, desc_path) of the descriptors that lines (path, line_no, value) belong to."""
    return lines_.select("path").distinct().select(parent("path").alias("session_dir"), F.col("path").alias("desc_path"))


def complete_sessions(files: DataFrame, needed: Sequence[str], path: str = "path") -> DataFrame:
    """Directories that hold all ``needed`` file names."""
    at = files.select(parent(path).alias("session_dir"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"))
    return at.groupBy("session_dir").agg(F.collect_set(F.when(F.col("name").isin(*needed), F.col("name"))).alias("have")).where(F.size("have") == len(set(needed))).select("session_dir")


def parse_properties(lines_: DataFrame) -> DataFrame:
    """(path, key, value): split at the first ``=`` or ``:`` that has no backslash before it; ``#`` and ``!`` start comments; the last of repeated keys counts."""
    text = F.ltrim("value")
    at = r"^((?:[^=:\\]|\\.)*?)\s*[=:]\s*(.*)$"
    unescape = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    kept = lines_.where((text != "") & ~text.rlike("^[#!]")).select("path", "line_no", unescape(F.regexp_extract(text, at, 1)).alias("key"), unescape(F.rtrim(F.regexp_extract(text, at, 2))).alias("value"))
    return kept.where("key <> ''").groupBy("path", "key").agg(F.max_by("value", "line_no").alias("value"))


def read_properties(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(session, key, value) of all descriptors; dots in keys part levels: ``split(key, '[.]')``."""
    props = parse_properties(lines(spark, paths, "*.properties"))
    return props.select(F.regexp_replace("path", r"/[^/]*$", "").alias("session"), "key", "value")


def player_sources(props: DataFrame) -> DataFrame:
    """(session, player_id, source_id, event_log) from ``player.<tuple>.{id,source,eventLog}``; an error for an unknown field or an incomplete tuple."""
    at = r"^player\.([^.]+)\.([^.]+)$"
    p = props.where(F.col("key").rlike(r"^player\.")).select("session", F.regexp_extract("key", at, 1).alias("tuple"), F.regexp_extract("key", at, 2).alias("field"), "value")
    p = p.withColumn("field", checked(F.col("field"), F.col("field").isin("id", "source", "eventLog"), "unknown player field"))
    one = p.groupBy("session", "tuple").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("id", "source", "eventLog")])
    full = F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("eventLog").isNotNull()
    return one.select("session", checked(F.col("id"), full, "incomplete player").alias("player_id"), F.col("source").alias("source_id"), F.col("eventLog").alias("event_log"))


def words_in(lines_: DataFrame, comment: str) -> DataFrame:
    """Distinct words of lists with one (maybe several tokens long) on a line; ``comment`` starts a remark."""
    import re

    word = F.trim(F.regexp_replace(F.regexp_replace("value", re.escape(comment) + ".*$", ""), r"[\t\r]", " "))
    return lines_.select(word.alias("word")).where("word <> ''").distinct()


def read_word_list(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return words_in(spark.read.text(path), comment)


def read_edge_counts(spark: SparkSession, path: str) -> DataFrame:
    """(shape, edges) from a properties file."""
    return parse_properties(lines(spark, path)).select(F.col("key").alias("shape"), F.col("value").cast("int").alias("edges"))


def player_event_logs(files: DataFrame, expected: int, path: str = "path") -> DataFrame:
    """(dir, player, path) of files ``events-<player>.txt``; an error if a directory has fewer than ``expected``."""
    p = F.regexp_extract(path, r"/events-([^/]+)\.txt$", 1)
    found = files.select(parent(path).alias("dir"), p.alias("player"), F.col(path).alias("path")).where("player <> ''")
    n = F.count("*").over(Window.partitionBy("dir"))
    return found.withColumn("player", checked(F.col("player"), n >= expected, "too few event logs"))


def read_screenshots(files: DataFrame, path: str = "path") -> DataFrame:
    """(kind, id, time_of_day ms, participant, path) from names ``<kind>-<id>-<HHmmssSSS>-<participant>.png``; other files are left out."""
    from parlance.functions.values import parse_tod

    name, at = F.regexp_extract(path, r"([^/]*)$", 1), r"^(selection|turn|game-over)-(.*)-([0-9]{9})-(.*)\.png$"
    part = lambda i: F.regexp_extract(name, at, i)
    return files.where(name.rlike(at)).select(part(1).alias("kind"), part(2).alias("id"), parse_tod(part(3)).alias("time_of_day"), part(4).alias("participant"), F.col(path).alias("path"))


#: name endings of file types
TYPES = {"xml": ("xml", "hat"), "wav": ("wav",)}


def of_type(files: DataFrame, mime: str, path: str = "path") -> DataFrame:
    """The ``files`` of a type (xml, wav) by their names, whatever their case."""
    return files.where(F.lower(F.regexp_extract(path, r"[.]([^./]*)$", 1)).isin(*TYPES[mime]))


def list_files(spark: SparkSession, paths: Sequence[str] | str, mime: str) -> DataFrame:
    """Paths of files of a type (xml, wav) by their names; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    return of_type(found.select("path"), mime)
