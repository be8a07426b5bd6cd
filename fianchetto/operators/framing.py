"""Record framing (S2): PGN lines -> one row per game text.

Two modes:
* ``clean``: a game starts at every line beginning with ``[Event ``.
* ``reference``: the original blank-line rule.  Lines accumulate; at a blank line
  the record closes only if one of its lines carries the ``1. `` move marker, so a
  move-less game is glued to the next one, and an unterminated last record is lost.

Both are running counts over the line order of each file, in two phases (chunks of
lines, then their offsets) so a single huge file does not become a single task.
Lines are put together inside their chunk; from there on, pieces of records travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.functions.pgn import has_moves, is_blank
from fianchetto.operators.ordered import materialize_df

# lines per chunk of the two-phase running count: a hot file at 100 TB gives
# ~1e7 narrow chunk rows to the offsets window, and each chunk window sorts
# at most this many lines
CHUNK_LINES = 65536


def _chunk(col: str, size: int):
    return F.floor(F.col(col) / F.lit(size))


def frame_games(lines: DataFrame, mode: str = "clean", file_col: str = "file",
                ln_col: str = "ln", line_col: str = "line",
                chunk_lines: int = CHUNK_LINES, materialize: bool = False) -> DataFrame:
    """lines(file, ln, line) -> games(file, first_ln, n_lines, game_text).

    ``materialize`` checkpoints the flagged lines first so a decompressing scan
    runs once (the running count reads its input twice)."""
    if mode == "clean":
        return _frame_clean(lines, file_col, ln_col, line_col, chunk_lines, materialize)
    if mode == "reference":
        return _frame_reference(lines, file_col, ln_col, line_col, chunk_lines, materialize)
    raise ValueError(f"unknown framing mode {mode!r}")


def _pieces(flagged, file_col, ln_col, line_col, chunk_lines, mark, inclusive, flags, materialize):
    """pieces(file, _count, first_ln, n_lines, text, *flags): the lines of a chunk that share a running count of ``mark``,
    put together inside the chunk.  ``_count`` runs over the whole file; a run of lines that crosses the edge of a
    chunk has a piece in each.  A line is sorted and shuffled once, on its way to its chunk."""
    tmp = flagged.withColumn("_chunk", _chunk(ln_col, chunk_lines))
    if materialize:
        tmp = materialize_df(tmp)
    before = Window.partitionBy(file_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tmp.groupBy(file_col, "_chunk").agg(F.sum(mark).alias("_c"))
               .select(file_col, "_chunk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(file_col, "_chunk").orderBy(ln_col).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    pieces = (tmp.withColumn("_own", F.coalesce(F.sum(mark).over(inside), F.lit(0)))
              .groupBy(file_col, "_chunk", "_own")
              .agg(F.min(ln_col).alias("first_ln"), F.count(F.lit(1)).alias("n_lines"), *[F.max(f).alias(f) for f in flags],
                   _joined(ln_col, line_col).alias("text")))
    return pieces.join(offsets, [file_col, "_chunk"]).withColumn("_count", F.col("_off") + F.col("_own")).drop("_chunk", "_own", "_off")


def _joined(order: str, text: str):
    """An aggregate: the texts in order, a line end between them; NULL if there is none."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("k"), F.col(text).alias("v")))))
    return F.when(F.count(text) > 0, F.array_join(parts["v"], "\n"))


def _whole(pieces, file_col, key):
    """games(file, first_ln, n_lines, game_text) of the pieces that share ``key``."""
    return (pieces.groupBy(file_col, key)
            .agg(F.coalesce(_joined("first_ln", "text"), F.lit("")).alias("game_text"), F.min("first_ln").alias("_first"),
                 F.sum("n_lines").cast("int").alias("n_lines"))
            .select(file_col, F.col("_first").alias("first_ln"), "n_lines", "game_text"))


def _frame_clean(lines, file_col, ln_col, line_col, chunk_lines, materialize=False):
    flagged = lines.select(file_col, ln_col, line_col,
                           F.col(line_col).startswith("[Event ").cast("long").alias("_start"))
    pieces = _pieces(flagged, file_col, ln_col, line_col, chunk_lines, "_start", True, (), materialize)
    return _whole(pieces.where(F.col("_count") > 0), file_col, "_count")


def _frame_reference(lines, file_col, ln_col, line_col, chunk_lines, materialize=False):
    flagged = lines.select(file_col, ln_col, line_col,
                           is_blank(line_col).cast("long").alias("_blank"),
                           has_moves(line_col).cast("long").alias("_mv"))
    # block = lines after the k-th blank line up to and including the (k+1)-th
    pieces = _pieces(flagged, file_col, ln_col, line_col, chunk_lines, "_blank", False, ("_mv", "_blank"), materialize)
    if materialize:
        # read twice below (block flags, then the text per record)
        pieces = materialize_df(pieces)
    # narrow block rows: does the block close a record (a move line and a closing blank)?
    blocks = (pieces.groupBy(file_col, "_count")
              .agg(F.min("first_ln").alias("_first"), (F.max("_mv") * F.max("_blank")).alias("_end")))
    # record = blocks up to and including the first closed block with a move line: a running count of such ends, over
    # chunks of blocks, then inside them
    blocks = blocks.withColumn("_chunk", _chunk("_first", chunk_lines))
    chunks = Window.partitionBy(file_col)
    before = chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = (blocks.groupBy(file_col, "_chunk").agg(F.sum("_end").alias("_c"))
            .select(file_col, "_chunk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(chunks).alias("_all")))
    inside = Window.partitionBy(file_col, "_chunk").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.join(ends, [file_col, "_chunk"]).withColumn("_rec", F.col("_off") + F.coalesce(F.sum("_end").over(inside), F.lit(0)))
    # a record that never closes (the rest of a file, or a whole file without a move
    # marker) goes here, on block rows, before any text is gathered: the file has no more ends
    kept = numbered.where("_rec < _all").select(file_col, "_count", "_rec")
    # the pieces' text is gathered once, per record
    return _whole(pieces.join(kept, [file_col, "_count"]), file_col, "_rec")
