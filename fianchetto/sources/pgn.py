"""PGN archive scans (S1, S2 fast path).

``scan_pgn_lines`` keeps every line with its file and order, for exact framing
(either mode).  ``scan_pgn_games`` frames while scanning: the text source splits
records at ``"\\n[Event "`` itself, which is the clean framing rule, works across
input splits of plain text and needs no shuffle.  Compressed dumps (``.zst``,
``.gz``) are decompressed by the reader but are not splittable: one task per
file, so repartition after the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAME_SEP = "\n[Event "


def _relative(path: str):
    """The file's path below ``path`` (its name, if ``path`` names the file or holds a
    pattern), so that moving an archive changes no record's identity."""
    full = F.col("_metadata.file_path")
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    below = F.regexp_extract(full, "^[^:]*:(?://[^/]*)?" + "/*" + re.escape(root.lstrip("/")) + "/(.+)$", 1)
    return F.when(below != "", below).otherwise(F.element_at(F.split(full, "/"), -1))


def _numbered(raw: DataFrame, path: str, out: str, index: str) -> DataFrame:
    """``raw`` text rows as (file, ``index``, ``out``), ``index`` being the row's number
    in its file however the file was split.

    Row numbers inside an input split come with the scan; the splits' counts (one
    small row each) give the number of rows before it in the file."""
    rows = raw.select(_relative(path).alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_id"), F.col("value").alias(out))
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.join(blocks, ["file", "_block"])
            .select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias(index), out))


# The characters besides "\n", "\r" and "\r\n" at which Python's str.splitlines ends a line.
LINE_SEPARATORS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def scan_pgn_lines(spark: SparkSession, path: str, python_lines: bool = False) -> DataFrame:
    """lines(file STRING, ln LONG, line STRING): the file's path below ``path``, the
    line's number in it from 0, and the line.

    ``python_lines`` also ends lines where Python's ``splitlines`` does; then ``ln`` still
    numbers the reader's lines and ``part LONG`` the parts of one, both in order:
    ``with_line_order`` makes one number of them."""
    lines = _numbered(spark.read.option("recursiveFileLookup", True).text(path), path, "line", "ln")
    return python_lines_of(lines) if python_lines else lines


def python_lines_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line cut at ``LINE_SEPARATORS``, with ``part`` from 0; a line without any stays as it is.  After a separator
    at its end comes an empty line (of a file's last line too, which Python leaves out).  Bytes that are no UTF-8 are
    not cut: the record is rejected as a whole."""
    cut = F.when(F.is_valid_utf8(line) & F.col(line).rlike(LINE_SEPARATORS), F.split(line, LINE_SEPARATORS)).otherwise(F.array(line))
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.posexplode(cut).alias("part", line)).withColumn("part", F.col("part").cast("long"))


#: Room for the parts of one line in the numbers of ``with_line_order``.
PARTS = 1 << 24


def with_line_order(lines: DataFrame) -> DataFrame:
    """``ln`` and ``part`` as one increasing ``ln`` (``ln`` * ``PARTS`` + ``part``) for ``frame_games``, whose
    ``chunk_lines`` is then ``PARTS`` times as large."""
    return lines.withColumn("ln", F.col("ln") * PARTS + F.col("part")).drop("part")


def scan_pgn_games(spark: SparkSession, path: str, stream: bool = False,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """games(file, first_ln, game_text), one row per ``[Event`` record.

    ``file`` is the path below ``path`` and ``first_ln`` the record's number in the
    file; both stay the same however the files are split and wherever the folder
    lies.  A file's text before its first ``[Event`` line (a preamble) is dropped.
    A stream has no ``first_ln``, and ``file`` is the full path."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("text").option("lineSep", GAME_SEP).option("recursiveFileLookup", True)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path)
    v = F.col("game_text")
    text = (F.when(v.startswith("[Event "), v)
            # every later record lost the separator's "[Event " prefix
            .when(v.rlike(r'^\s*"'), F.concat(F.lit("[Event "), v)))
    if stream:
        out = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("game_text"))
    else:
        out = _numbered(raw, path, "game_text", "first_ln")
    return out.withColumn("game_text", text).where(F.col("game_text").isNotNull())
