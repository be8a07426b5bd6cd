"""Rating scalars: parsing, scaling, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fianchetto.constants import ELO_MAX, ELO_MIN

# Python's int() accepts surrounding whitespace, a sign and single underscores
# between digits; "1600.5" and "?" are rejected.  A bare try_cast disagrees on
# "1_600" and "1600.5", so guard with the grammar first.
_INT_GRAMMAR = r"^\s*[+-]?\d+(_\d+)*\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_elo(c) -> Column:
    """Header text -> INT rating, NULL when it is not an integer literal."""
    c = _col(c)
    cleaned = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "_", "")
    return F.when(c.rlike(_INT_GRAMMAR), cleaned.try_cast("int"))


def normalize_elo(c, min_elo: int = ELO_MIN, max_elo: int = ELO_MAX) -> Column:
    """Clamp to [min, max] then scale to [0, 1] as DOUBLE."""
    c = _col(c)
    clamped = F.greatest(F.lit(min_elo), F.least(F.lit(max_elo), c))
    return (clamped - F.lit(min_elo)).cast("double") / F.lit(float(max_elo - min_elo))


def denormalize_elo(c, min_elo: int = ELO_MIN, max_elo: int = ELO_MAX) -> Column:
    """[0, 1] -> rating, truncated toward zero like Python's int(); no clamp."""
    c = _col(c)
    return (c.cast("double") * F.lit(float(max_elo - min_elo)) + F.lit(float(min_elo))).cast("int")


def to_float32(c) -> Column:
    """Round-trip through FLOAT, as a float32 tensor target does."""
    return _col(c).cast("float").cast("double")


def target_elo(white, black, use_white_elo: bool = True, normalize: bool = True,
               min_elo: int = ELO_MIN, max_elo: int = ELO_MAX) -> Column:
    """The regression target: one side's rating, optionally scaled."""
    e = _col(white) if use_white_elo else _col(black)
    return normalize_elo(e, min_elo, max_elo) if normalize else e.cast("double")


def clip_prediction(c) -> Column:
    """Predictions are confined to [0, 1]."""
    return F.least(F.greatest(_col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
