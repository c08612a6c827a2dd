"""Many small files in few: a corpus of session folders as one table of lines.

A folder for each session costs a file, a listing and a task's open writer for each, so folders are
kept as rows (path, line_no, value) of Parquet files, whose number follows from the size of the
corpus. Readers of lines take these rows as they take those of ``text.lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, line_no long, value string"
#: the folder of rows without a session
NONE = "__HIVE_DEFAULT_PARTITION__"


def file_path(key: str, name: str, session: str | None = None) -> Column:
    """The path of file ``name`` in the folder ``<key>=<session>``."""
    return F.concat(F.lit(f"/{key}="), F.coalesce(F.col(session or key).cast("string"), F.lit(NONE)), F.lit(f"/{name}"))


def session_of(path: str, key: str) -> Column:
    """The session of a path, or of its folder; null for rows without one."""
    return F.nullif(F.regexp_extract(path, f"{key}=([^/]*)", 1), F.lit(NONE))


def files_of(rows: DataFrame, path: Column, *lines: Column) -> DataFrame:
    """(path, line_no, value): a file for each row with these lines."""
    return rows.select(path.alias("path"), F.posexplode(F.array(*lines)).alias("line_no", "value"))


def pack(lines: DataFrame, path: str) -> None:
    """Add lines to a packed corpus, in the tasks that have them."""
    lines.select("path", F.col("line_no").cast("long").alias("line_no"), "value").write.mode("append").parquet(path)


def unpack(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, line_no, value) of the files whose name fits ``glob`` (``*`` and ``?``)."""
    import re

    name = "/" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    return spark.read.schema(LINES).parquet(path).where(F.col("path").rlike(name))
