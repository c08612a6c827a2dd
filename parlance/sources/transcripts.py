"""Transcriptions in XML: tracks with their sources, and segments with tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import escape_xml, flatten_segment, natural_key
from parlance.operators.guards import assert_unique

# the reader keeps the markup inside an element that is read as text, so segments may nest to any depth and tokens stay in order
SEGMENT = "_id string, _start float, _end float, _source string, _track string, transcription string"
TRACK = "_id string, sources struct<source:array<struct<_id:string,_href:string,_channel:string,_offset:string>>>"


def read_segments(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file, id, start, end, source, track, tokens) of top segments; tokens of nested segments, whatever their depth, stand where they stand in the document.

    A segment without transcription has no tokens. A token that holds the text of a token's own end tag, escaped, is cut there.
    """
    raw = spark.read.format("xml").option("rowTag", "segment").schema(SEGMENT).load(paths if isinstance(paths, str) else ",".join(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("id"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_source").alias("source"), F.col("_track").alias("track"), flatten_segment(F.col("transcription")).alias("tokens"))


def token_markup(tokens: Column) -> Column:
    """Tokens as elements of a transcription."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("<t>"), escape_xml(t), F.lit("</t>"))), "")


def segment_markup(segment_id: Column, markup: Column) -> Column:
    """A segment to stand in another's transcription, with the ``markup`` of tokens and segments inside."""
    return F.concat(F.lit('<segment id="'), escape_xml(segment_id), F.lit('"><transcription>'), markup, F.lit("</transcription></segment>"))


def write_markup(segments: DataFrame, path: str) -> None:
    """Segments (id, start, end, source, track, ``markup`` of the transcription or null for none) as XML, a document for each shuffle partition, dealt and sorted by id."""
    attributes = [F.concat(F.lit(f' {a}="'), escape_xml(F.col(a).cast("string")), F.lit('"')) for a in ("id", "start", "end", "source", "track")]
    inner = F.coalesce(F.concat(F.lit("<transcription>"), "markup", F.lit("</transcription>")), F.lit(""))
    spark = segments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), F.concat(F.lit("<segment"), F.concat_ws("", *attributes), F.lit(">"), inner, F.lit("</segment>")).alias("value"))
    root = F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("id"), F.lit("<segments>").alias("value")), F.struct(F.lit(2).alias("place"), F.lit("").alias("id"), F.lit("</segments>").alias("value")))
    ends = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.inline(root))  # two rows for each document
    dealt = rows.unionByName(ends).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "place", natural_key(F.col("id")))
    dealt.select("value").write.text(path)


def read_sources(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file, track, source, href, channel, offset) of every track."""
    raw = spark.read.format("xml").option("rowTag", "track").schema(TRACK).load(paths if isinstance(paths, str) else ",".join(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("track"), F.explode("sources.source").alias("s")).select("file", "track", F.col("s._id").alias("source"), F.col("s._href").alias("href"), F.col("s._channel").alias("channel"), F.col("s._offset").alias("offset"))


def write_annotation(segments: DataFrame, path: str) -> None:
    """Segments as XML, sorted by natural id order within and over files."""
    out = segments.orderBy(natural_key(F.col("id"))).select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("source").alias("_source"), F.col("track").alias("_track"), F.struct(F.col("tokens").alias("t")).alias("transcription"))
    out.write.format("xml").option("rootTag", "segments").option("rowTag", "segment").save(path)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks (track, sources array of source, href, channel, offset) as XML, sorted by natural id order within and over files."""
    source = F.transform("sources", lambda s: F.struct(s["source"].alias("_id"), s["href"].alias("_href"), s["channel"].alias("_channel"), s["offset"].alias("_offset")))
    out = tracks.orderBy(natural_key(F.col("track"))).select(F.col("track").alias("_id"), F.struct(source.alias("source")).alias("sources"))
    out.write.format("xml").option("rootTag", "tracks").option("rowTag", "track").save(path)


def segment_strings(segments: DataFrame) -> DataFrame:
    """One line of text for each segment that has tokens."""
    return segments.where(F.size("tokens") > 0).select("id", F.array_join("tokens", " ").alias("text"))


def merge_annotations(a: DataFrame, b: DataFrame, prefix: str) -> DataFrame:
    """Segments of ``a`` and, with prefixed ids, of ``b``; an error if two get the same id."""
    both = a.unionByName(b.withColumn("id", F.concat(F.lit(prefix), "id")))
    return assert_unique(both, ["id"], "two segments have the same id")


def map_speakers(segments: DataFrame, players: DataFrame) -> DataFrame:
    """``speaker`` of each segment, from its source; ``players`` is (session, source_id, player_id), a few rows for each session. Null if unknown."""
    return segments.join(players.select("session", F.col("source_id").alias("source"), F.col("player_id").alias("speaker")), ["session", "source"], "left")


def distinct_sources(sources: DataFrame) -> DataFrame:
    """Audio paths, relative to the annotation's directory, once each."""
    base = F.regexp_replace("file", r"/[^/]*$", "")
    return sources.select(F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat_ws("/", base, "href")).alias("path")).distinct()


def source_durations(sources: DataFrame, wavs: DataFrame) -> DataFrame:
    """(path, duration) of annotated audio files; ``wavs`` is (path, duration)."""
    return distinct_sources(sources).join(wavs, "path")
