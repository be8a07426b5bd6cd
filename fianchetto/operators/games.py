"""Game parsing (P1-P3, F1-F4, L1): game text -> typed game rows with a status.

The original drops bad games silently; here every record keeps a
``parse_status`` so rejects can be counted, and ``valid_games`` filters.
Header checks run before move replay, as in the original, because a Python job
is a barrier Catalyst cannot push filters through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.constants import ELO_VALID_HIGH, ELO_VALID_LOW, MIN_POSITIONS
from fianchetto.functions.elo import parse_elo
from fianchetto.functions.pgn import bound, header_tags, movetext, movetext_tokens, tags_to_map
from fianchetto.operators.ordered import materialize_df

STATUSES = ["ok", "bad_utf8", "missing_header", "bad_elo", "elo_out_of_range", "too_short"]


PARSED = ("headers", "moves", "white_elo_raw", "black_elo_raw", "result", "white_elo", "black_elo")


def _nonempty(c):
    return c.isNotNull() & (F.length(c) > 0)


def parse_games(records: DataFrame, text_col: str = "game_text",
                id_col: str | None = None, id_header: str | None = None) -> DataFrame:
    """Add headers, ratings, result, SAN tokens and ``parse_status``.

    ``id_col`` names an existing id, ``id_header`` a header that identifies a game;
    otherwise ``game_id`` is a 128-bit hash of (file, first_ln), the record's
    position in the archive.
    """
    df = records
    if id_header is not None:
        pass
    elif id_col is None:
        df = df.withColumn("game_id", F.md5(F.concat_ws(":", "file", "first_ln").cast("binary")))
    elif id_col != "game_id":
        df = df.withColumn("game_id", F.col(id_col))
    # The expensive extractions (header map, SAN tokens, ratings) are emitted by a
    # one-row generator: filters on their values stop above the Generate, so
    # each record is parsed once instead of once per consumer.
    keep = [c for c in df.columns if c not in PARSED]
    parsed = F.struct(tags_to_map(header_tags(text_col)).alias("headers"), movetext_tokens(movetext(text_col)).alias("moves"))

    def with_ratings(x):
        return bound(F.struct(x["headers"]["WhiteElo"].alias("w"), x["headers"]["BlackElo"].alias("b")), lambda raw: F.struct(
            x["headers"].alias("headers"), x["moves"].alias("moves"), raw["w"].alias("white_elo_raw"), raw["b"].alias("black_elo_raw"),
            # the PGN reader fills an absent Result with "*"
            F.coalesce(x["headers"]["Result"], F.lit("*")).alias("result"),
            parse_elo(raw["w"]).alias("white_elo"), parse_elo(raw["b"]).alias("black_elo")))

    df = df.select(*keep, F.inline(F.transform(F.array(parsed), with_ratings)))
    if id_header is not None:
        df = df.withColumn("game_id", F.col("headers").getItem(id_header))
    we, be = F.col("white_elo"), F.col("black_elo")
    # bytes that are no UTF-8 come through the text reader as they are: judged before anything read from them
    status = (F.when(~F.is_valid_utf8(text_col), "bad_utf8").when(~(_nonempty(F.col("white_elo_raw")) & _nonempty(F.col("black_elo_raw"))
                       & _nonempty(F.col("result"))), "missing_header")
              .when(we.isNull() | be.isNull(), "bad_elo")
              .when(~(we.between(ELO_VALID_LOW, ELO_VALID_HIGH) & be.between(ELO_VALID_LOW, ELO_VALID_HIGH)),
                    "elo_out_of_range")
              # start position + one per half-move; replay refines this (illegal moves)
              .when(F.size("moves") + 1 < MIN_POSITIONS, "too_short")
              .otherwise("ok"))
    return df.withColumn("parse_status", status)


def valid_games(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_status") == "ok")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Number of records per parse status (a partial aggregate: tiny shuffle)."""
    return parsed.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n_games"))


def max_games(games: DataFrame, n: int | None, file: str = "file", order: str = "first_ln",
              chunk_records: int = 65536) -> DataFrame:
    """First ``n`` games in archive order (file, then position); 0/None = all.

    The games' places, two narrow columns, are written once.  They give the file and
    the position of the n-th game: files, then blocks of positions, are counted, and
    only the block that holds it is sorted.  What is returned is a filter on file and
    position, which are known before parsing: of the costly columns only those of the
    first games are ever made.  Apply it before costly steps."""
    if not n:
        return games
    places = materialize_df(games.select(F.col(file).alias("f"), F.col(order).alias("o")))
    cut_file, missing = _nth_group(places.select("f"), n)
    if cut_file is None:  # there are fewer
        return games
    inside = places.where(F.col("f") == cut_file).select("o", F.floor(F.col("o") / chunk_records).alias("c"))
    chunk, missing = _nth_group(inside.select("c"), missing)
    last = inside.where(F.col("c") == chunk).orderBy("o").limit(missing).agg(F.max("o").alias("o")).first().o
    return games.where((F.col(file) < F.lit(cut_file)) | ((F.col(file) == F.lit(cut_file)) & (F.col(order) <= F.lit(last))))


def _nth_group(keys: DataFrame, n: int):
    """(key, m) such that the n-th row in key order is the m-th of that key's; (None, None) if there are fewer rows.
    The window is over one row a key."""
    key = keys.columns[0]
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    groups = keys.groupBy(key).agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    hit = groups.where((F.col("before") < n) & (F.col("before") + F.col("k") >= n)).first()
    return (hit[key], n - hit.before) if hit else (None, None)
