"""Move replay (P4) and the final game filter.

SAN replay is a sequential fold per game, which Spark SQL cannot express, so it
runs in ``mapInArrow``: each task replays the games of its own partition in
Arrow batches (no shuffle; state is bounded by one game).  Header filters run
before this step, because a Python stage is a barrier to filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fianchetto.constants import MIN_POSITIONS
from fianchetto.session import small_batches


def _replay_batches(moves_col: str):
    def fn(batches):
        import pyarrow as pa

        from fianchetto.operators.chessboard import replay

        for batch in batches:
            moves = batch.column(batch.schema.get_field_index(moves_col)).to_pylist()
            fens, status = [], []
            for mv in moves:
                f, ok = replay(mv)
                fens.append(f)
                status.append("ok" if ok else "illegal_move")
            cols = list(batch.columns) + [pa.array(fens, type=pa.list_(pa.string())),
                                          pa.array(status, type=pa.string())]
            names = list(batch.schema.names) + ["fens", "replay_status"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return fn


def replay_games(games: DataFrame, moves_col: str = "moves") -> DataFrame:
    """Add ``fens ARRAY<STRING>`` (start position + one per legal half-move) and
    ``replay_status`` ('ok' or 'illegal_move': replay stopped at that token)."""
    small_batches(games.sparkSession)
    schema = T.StructType(games.schema.fields + [
        T.StructField("fens", T.ArrayType(T.StringType())),
        T.StructField("replay_status", T.StringType())])
    return games.mapInArrow(_replay_batches(moves_col), schema)


def finalize_games(replayed: DataFrame) -> DataFrame:
    """Apply the minimum-length rule on replayed positions and produce the game
    table ``(game_id, fens, white_elo, black_elo, result, ...)``."""
    return replayed.where(F.size("fens") >= MIN_POSITIONS)


def positions_table(games: DataFrame) -> DataFrame:
    """games(game_id, fens) -> positions(game_id, ply, fen); ply 0 = start."""
    return games.select("game_id", F.posexplode("fens").alias("ply", "fen")) \
        .withColumn("ply", F.col("ply").cast("int"))
