"""Tab-separated tables of a corpus."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from parlance.functions.text import is_relevant, keep_tokens, split_words, token_types
from parlance.operators.guards import checked
from parlance.sources.text import lines

NULL = "?"
EVENTS = "EVENT int, ROUND int, SCORE int, TIME decimal(20,6), NAME string, SUBMITTER string, ENTITY int, REFERENT boolean, SELECTED boolean, SHAPE string, EDGE_COUNT int, SIZE double, RED int, GREEN int, BLUE int, ALPHA int, HUE float, SATURATION float, BRIGHTNESS float, POSITION_X double, POSITION_Y double"
#: the same of many games
GAME_EVENTS = f"GAME string, {EVENTS}"
UTTS = "ROUND int, SPEAKER string, DIALOGUE_ROLE string, START_TIME float, END_TIME float, TOKENS string"


def read_tsv(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """Tables with a header and ``?`` for null, each row with its ``session`` directory; a header that differs from the schema stops the job."""
    raw = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("enforceSchema", "false").option("nullValue", NULL).option("quote", "").option("recursiveFileLookup", "true").csv(paths if isinstance(paths, str) else list(paths))
    return raw.withColumn("session", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", ""))


def read_events(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return read_tsv(spark, paths, EVENTS)


def read_utterances(spark: SparkSession, paths: Sequence[str] | str, keep=is_relevant, schema: str = UTTS) -> DataFrame:
    """``TOKENS`` split and filtered by a token predicate."""
    return read_tsv(spark, paths, schema).withColumn("TOKENS", keep_tokens(split_words(F.col("TOKENS")), keep))


def cat_utts(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Several utterance tables as one; differing headers stop the job."""
    return read_tsv(spark, paths, UTTS)


def read_event_utts(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """A reference-utterance table; ``TOKEN_TYPES`` is the set of its tokens."""
    return read_tsv(spark, paths, schema).withColumn("TOKEN_TYPES", token_types(F.col("TOKENS")))


def read_session_metadata(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(session, key, value); an error if a session has a key twice."""
    raw = spark.read.schema("key string, value string").option("sep", "\t").option("recursiveFileLookup", "true").csv(paths if isinstance(paths, str) else list(paths))
    return _unique_metadata(raw.withColumn("session", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")))


def session_metadata(lines_: DataFrame) -> DataFrame:
    """As ``read_session_metadata``, of lines (path, line_no, value)."""
    cells = F.from_csv("value", "key string, value string", {"sep": "\t"})
    return _unique_metadata(lines_.where("value <> ''").select(F.regexp_replace("path", r"/[^/]*$", "").alias("session"), cells.alias("r")).select("session", "r.*"))


def _unique_metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session", "key").agg(checked(F.min("value"), F.count("*") == 1, "a metadata key comes twice").alias("value"))


def metadata_map(long: DataFrame) -> DataFrame:
    """(session, metadata map)."""
    return long.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def read_participant_metadata(spark: SparkSession, paths: Sequence[str] | str, glob: str = "*") -> DataFrame:
    """(session, metadatum, participant, value) of tables with a column for each participant; short rows are filled with empty values."""
    return participant_metadata(lines(spark, paths, glob))


def participant_metadata(lines_: DataFrame) -> DataFrame:
    """As ``read_participant_metadata``, of lines (path, line_no, value)."""
    cells = lines_.where("value <> ''").select("path", "line_no", F.split("value", "\t").alias("c"))
    head = cells.where("line_no = 0").select("path", F.col("c").alias("h"))
    body = cells.where("line_no > 0").join(head, "path").select(F.regexp_replace("path", r"/[^/]*$", "").alias("session"), F.get("c", F.lit(0)).alias("metadatum"), "c", F.posexplode("h").alias("i", "participant"))
    return body.where("i > 0").select("session", "metadatum", "participant", F.coalesce(F.get("c", F.col("i")), F.lit("")).alias("value"))


def write_tsv(df: DataFrame, path: str, partition: Sequence[str] = (), header: bool = True, compression: str = "none") -> None:
    """A table with ``?`` for null, in directories by ``partition``; arrays are joined by spaces. With many sessions, let the session be a column, and the files few."""
    flat: list[Column] = [F.array_join(c, " ").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.partitionBy(*partition).option("sep", "\t").option("header", str(header).lower()).option("nullValue", NULL).option("emptyValue", "").option("quote", "").option("compression", compression).csv(path)


#: what a backslash and a letter stand for in a cell, so that a row is one line whatever its texts hold
ESCAPES = {"\\": "\\", "\t": "t", "\n": "n", "\r": "r", "\0": "0", "\x01": "1"}
#: bytes of text that are parsed at once, and rows of a file, which is read whole
CHUNK, FILE_ROWS = 4 << 20, 2_000_000


def cells(cols: Mapping[str, Column], schema: str) -> Column:
    """``cols`` as cells of one line: ``?`` for null, and in texts a backslash before what would end a cell or a line, and before a text that is ``?``."""
    kinds = dict(c.split(" ") for c in schema.split(", "))

    def cell(name: str, c: Column) -> Column:
        if kinds[name] != "string":
            return F.coalesce(c.cast("string"), F.lit(NULL))
        text = c
        for x, letter in ESCAPES.items():
            text = F.replace(text, F.lit(x), F.lit("\\" + letter))
        return F.when(c.isNull(), NULL).when(c == NULL, "\\" + NULL).when(c.rlike(r"[\\\t\n\r\x00\x01]"), text).otherwise(c)

    return F.concat_ws("\t", *[cell(*x) for x in cols.items()])


def write_lines(lines_: DataFrame, path: str, schema: str) -> None:
    """Lines of ``cells`` as compressed tables with a header, of at most FILE_ROWS rows. Where no text needs a backslash, they are those of ``write_tsv``.

    The fastest compression: the next takes more time than all the rest, for a sixth less space.
    """
    names = "\t".join(c.split(" ")[0] for c in schema.split(", "))
    whole = lines_.select(F.col("line").alias(names)).write.option("sep", "\x01").option("header", "true").option("quote", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    whole.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_ROWS).csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tables that ``write_lines`` wrote, a file whole in a task; a header that differs from the schema, and a row that does not fit it, stop the job."""
    kind = StructType.fromDDL(schema)
    names = kind.names

    def chunks(path_: str, content) -> Iterator[bytes]:
        """Whole lines, about CHUNK bytes at a time."""
        import pyarrow as pa

        source, rest = pa.input_stream(content, compression="gzip" if path_.endswith(".gz") else None), []
        while piece := source.read(CHUNK):
            cut = piece.rfind(b"\n") + 1
            if cut:
                yield b"".join([*rest, piece[:cut]])
                rest = []
            rest.append(piece[cut:])
        if any(rest):
            yield b"".join(rest)

    def plain(column):
        """A column of texts without backslashes."""
        import re

        import pyarrow as pa
        import pyarrow.compute as pc

        if not pc.any(pc.match_substring(column, "\\")).as_py():
            return column
        letters = {letter: x for x, letter in ESCAPES.items()}
        return pa.array([x and re.sub(r"\\(.)", lambda m: letters.get(m[1], m[1]), x) for x in column.to_pylist()], pa.string())

    def parse(batches):
        import pyarrow as pa
        import pyarrow.csv as pc

        known = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        types = {f.name: pa.decimal128(f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, DecimalType) else known[f.dataType.simpleString()] for f in kind}
        convert = pc.ConvertOptions(column_types=types, null_values=[NULL], strings_can_be_null=True, true_values=["true"], false_values=["false"])
        how = pc.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=False)
        for batch in batches:
            for path_, content in zip(batch.column("path"), batch.column("content")):
                for i, chunk in enumerate(chunks(path_.as_py(), content.as_buffer())):
                    if not i:
                        head, _, chunk = chunk.partition(b"\n")
                        if head.decode().split("\t") != names:
                            raise ValueError(f"the header of {path_} is not that of the schema")
                    if chunk:
                        found = pc.read_csv(pa.BufferReader(chunk), pc.ReadOptions(use_threads=False, block_size=len(chunk), column_names=names), how, convert).combine_chunks()
                        for n, x in types.items():
                            if x == pa.string():
                                found = found.set_column(names.index(n), n, plain(found[n]))
                        yield from found.to_batches()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, kind)
