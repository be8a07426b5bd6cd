"""Fixed values that results depend on.

These must equal the original program's values for results to match; they are
listed here plainly, in their natural order.
"""

# --- fixed values: piece codes (board matrix / one-hot channel) -------------
# empty or unknown square = 0; black p n b r q k = 1..6; white P N B R Q K = 7..12
PIECE_CODES = {".": 0, "p": 1, "n": 2, "b": 3, "r": 4, "q": 5, "k": 6,
               "P": 7, "N": 8, "B": 9, "R": 10, "Q": 11, "K": 12}
# String whose (1-based position - 1) is the piece code of a character.
PIECE_ORDER = ".pnbrqkPNBRQK"
BOARD_CHANNELS = 13
MAX_SEQUENCE_LENGTH = 200

# --- fixed values: rating scale and validity ---------------------------------
ELO_MIN = 800            # normalisation floor
ELO_MAX = 2800           # normalisation ceiling
ELO_VALID_LOW = 100      # a header rating outside [100, 5000] rejects the game
ELO_VALID_HIGH = 5000
MIN_POSITIONS = 3        # start position + at least two half-moves

# --- fixed values: dataset split ---------------------------------------------
SPLIT_TRAIN = 0.8
SPLIT_VAL = 0.1
SPLIT_SEED = 42

# --- fixed values: evaluation bands (label, min, max), half-open [min, max) --
DEFAULT_ELO_BANDS = [("Beginner", 800, 1200), ("Intermediate", 1200, 1600),
                     ("Advanced", 1600, 2000), ("Master", 2000, 2800)]

# --- fixed values: difficulty segments ---------------------------------------
DIFFICULTY_LABELS = ["Easy", "Normal", "Hard", "Impossible"]
DIFFICULTY_COLORS = ["green", "yellow", "orange", "red"]
DIFFICULTY_EXTRA_COLOR = "blue"      # label for extra segments is "Level_{i+1}"

# --- fixed values: training defaults -----------------------------------------
EARLY_STOP_PATIENCE = 5
EARLY_STOP_MIN_DELTA = 0.0
LR_FACTOR = 0.5
LR_PATIENCE = 3
LR_THRESHOLD = 1e-4      # relative improvement threshold of the plateau rule
LR_EPS = 1e-8
BATCH_SIZE = 32

# --- fixed values: training log line ------------------------------------------
LOG_FORMAT = "Epoch %3d | Train MAE: %.6f | Val MAE: %.6f"
LOG_ELO_SUFFIX = " | Train MAE (Elo): %.2f | Val MAE (Elo): %.2f"
