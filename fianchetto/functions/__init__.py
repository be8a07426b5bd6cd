"""Column -> Column functions (all JVM-side, codegen-friendly)."""

from fianchetto.functions.elo import (clip_prediction, denormalize_elo, normalize_elo,
                                      parse_elo, target_elo, to_float32)
from fianchetto.functions.fen import (board_codes, board_field, board_onehot_indices,
                                      board_valid, fen_features, onehot_dense, side_to_move)
from fianchetto.functions.pgn import (has_moves, header_block, header_map, header_value,
                                      is_blank, movetext, movetext_tokens)

__all__ = [
    "clip_prediction", "denormalize_elo", "normalize_elo", "parse_elo", "target_elo",
    "to_float32", "board_codes", "board_field", "board_onehot_indices", "board_valid",
    "fen_features", "onehot_dense", "side_to_move", "has_moves", "header_block",
    "header_map", "header_value", "is_blank", "movetext", "movetext_tokens",
]
