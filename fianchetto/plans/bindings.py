"""Chess-shaped tables derived from the driver's generic tables.

There is no chess archive among the test tables, so each binding derives one by
arithmetic on a real table (all rows, nothing sampled) that the SQL oracle can
repeat exactly.  The literal movetexts and FENs below are this project's own
fixtures: legal games covering castling on both sides, en passant, promotion,
disambiguation, checks, mates, comments, NAGs and variations, plus one game with
an illegal move, and FENs including malformed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.functions.elo import clip_prediction, normalize_elo

# --- fixed values: result by key % 3 ----------------------------------------
RESULTS = ["1-0", "0-1", "1/2-1/2"]

# --- fixed values: movetext pool (key % 8) ----------------------------------
MOVETEXTS = [
    "1. e4 e5 2. Nf3 d6 3. d4 Bg4 4. dxe5 Bxf3 5. Qxf3 dxe5 6. Bc4 Nf6 7. Qb3 Qe7 "
    "8. Nc3 c6 9. Bg5 b5 10. Nxb5 cxb5 11. Bxb5+ Nbd7 12. O-O-O Rd8 13. Rxd7 Rxd7 "
    "14. Rd1 Qe6 15. Bxd7+ Nxd7 16. Qb8+ Nxb8 17. Rd8#",
    "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 6. Re1 b5 7. Bb3 d6 8. c3 O-O "
    "9. h3 Nb8 10. d4 Nbd7 11. Nbd2 Bb7 12. Bc2 Re8 13. Nf1 Bf8 14. Ng3 g6 15. a4 c5 "
    "16. d5 c4 17. Bg5 h6 18. Be3 Nc5 19. Qd2 h5 20. Bg5 Be7",
    "1. e4 Nf6 2. e5 d5 3. exd6 cxd6 4. d4 g6 5. Nf3 Bg7 6. Be2 O-O 7. O-O Nc6 8. c3 Bg4",
    "1. e4 d5 2. exd5 c6 3. dxc6 Nf6 4. cxb7 Nbd7 5. bxa8=Q Qb6 6. Qxa7 e5 7. Nf3 Bc5 "
    "8. Be2 O-O 9. O-O e4",
    "1. e4 {best by test} e5 2. Nf3 $1 Nc6?! (2... d6 3. d4 exd4) 3. Bb5 a6 4. Ba4 Nf6 "
    "5. O-O Be7 6. Re1 b5 7. Bb3 O-O",
    "1. e4 e5 2. Bc4 Nc6 3. Qh5 Nf6 4. Qxf7#",
    "1. f3 e5 2. g4 Qh4#",
    "1. d4 d5 2. c4 e6 3. Nc3 Nf6 4. Bg5 Be7 5. e3 O-O 6. Nf3 Nbd7 7. Rc1 c6 8. Qe2 Kxa1",
]

# --- fixed values: FEN pool ((key*7 + ply*13) % 16) -------------------------
FEN_POOL = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1",
    "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2",
    "4k3/8/8/²6/8/8/8/4K3 w - - 0 1",
    "rnbqkbnr/pp1ppppp/8/2p5/4P3/8/PPPP1PPP/RNBQKBNR w KQkq c6 0 2",
    "8/8/4k3/8/2K5/8/8/8 w - - 0 60",
    "r1bq1rk1/pp2bppp/2n1pn2/3p4/2PP4/2N2N2/PP2BPPP/R2QKB1R w KQ - 2 9",
    "4k3/P7/8/8/8/8/8/4K3 w - - 0 50",
    "8/8/8/8 w",
    "9/k7/8/8/8/8/8/8 w - - 0 1",
    "9k/8/8/8/8/8/8/8 w - - 0 1",
    "kx6/3.4/8/8/8/8/8/K7 b - - 0 1",
    "ppppppppp/8/8/8/8/8/8/4K2k w - - 0 1",
    "k07/8/8/8/8/8/8/K7 w - - 0 1",
    "8/8/8/8/8/8/8/8/k7 w - - 0 1",
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",
]

# (run, step, order, part, supplier) is not unique in every table; rows equal on
# all of these and on the logged values are interchangeable
BATCH_ORDER = ["step", "l_orderkey", "l_partkey", "l_suppkey", "loss", "n"]

LINES_PER_GAME = 16     # line-number stride per game in the derived archive
N_FILES = 64            # games are spread over this many "files" by key


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None, spread: bool = False) -> DataFrame:
    """Read a driver table, dealt out by ``key`` if given: a binding makes up to 250
    rows from one, so its few narrow input rows are shuffled rather than its output.
    AQE sees only their few bytes and merges them to about a partition a core, one core's work
    more or less; with ``spread`` they stay in at least four a core."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if key is None:
        return df
    if not spread:
        return df.repartition(key)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def _pick(arr: list[str], idx):
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (idx + 1).cast("int"))


def games_b1(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """games(game_id, white_elo, black_elo, result, n_ply) from every order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey", spread).select(
        k.alias("game_id"),
        (F.lit(600) + (k * 37) % 2400).cast("int").alias("white_elo"),
        (F.lit(600) + (k * 53 + 11) % 2400).cast("int").alias("black_elo"),
        _pick(RESULTS, k % 3).alias("result"),
        (F.lit(2) + k % 250).cast("int").alias("n_ply"))


def positions_b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions(game_id, ply, fen): n_ply + 1 positions for every game."""
    g = games_b1(spark, sf_dir)
    p = g.select("game_id", F.explode(F.sequence(F.lit(0), F.col("n_ply"))).alias("ply"))
    return p.select("game_id", F.col("ply").cast("int").alias("ply"),
                    _pick(FEN_POOL, (F.col("game_id") * 7 + F.col("ply") * 13) % 16).alias("fen"))


def fens_b2(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """games(game_id, fens ARRAY<STRING>, white_elo, black_elo, result) -- the
    array form of B2, built per row (no shuffle)."""
    return with_fens(games_b1(spark, sf_dir, spread))


def with_fens(games: DataFrame) -> DataFrame:
    """The games of B1, or some of them, with the FENs of ``fens_b2`` for ``n_ply``."""
    # the FENs come round every 16 plies: whole rounds cut to n_ply + 1, without a lambda if 16 rounds are enough
    rounds = F.array(*[F.array(*[F.lit(FEN_POOL[(k + p * 13) % 16]) for p in range(16)]) for k in range(16)])
    own = F.element_at(rounds, ((F.col("game_id") * 7) % 16 + 1).cast("int"))
    longer = F.flatten(F.transform(F.sequence(F.lit(0), (F.col("n_ply") / 16).cast("int")), lambda _: own))
    fens = F.slice(F.when(F.col("n_ply") < 256, F.concat(*[own] * 16)).otherwise(longer), F.lit(1), F.col("n_ply") + 1)
    return games.select("game_id", fens.alias("fens"), *[c for c in games.columns if c not in ("game_id", "fens", "n_ply")])


def scored_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored(game_id, white_elo, target, pred): a deterministic noisy prediction."""
    g = games_b1(spark, sf_dir)
    t = normalize_elo("white_elo")
    noise = ((F.col("game_id") * 31) % 401 - 200).cast("double") / F.lit(2000.0)
    return g.select("game_id", "white_elo", "n_ply", t.alias("target"),
                    clip_prediction(t + noise).alias("pred"))


def pgn_lines_b4(spark: SparkSession, sf_dir: str, bad_bytes: bool = False, joined: bool = False) -> DataFrame:
    """pgn_lines(file, ln, line): one PGN game per order, with rejects mixed in:
    key%11 no WhiteElo, %13 WhiteElo "?", %17 WhiteElo 50, %19 no movetext,
    %23 a single move.  ``bad_bytes``: key%29 has a byte that is no UTF-8 in its White
    tag; ``joined``: key%7 has its tags in one line, parted by U+2028 (key%2 = 0) or by
    a vertical tab."""
    g, lines = _pgn_b4(table(spark, sf_dir, "orders", "o_orderkey"), bad_bytes, joined)
    ex = g.select("k", F.posexplode(lines).alias("i", "line")).where(F.col("line").isNotNull())
    return ex.select(_file_b4("k").alias("file"), (F.col("k") * LINES_PER_GAME + F.col("i")).alias("ln"), "line")


def pgn_archive_b4(spark: SparkSession, sf_dir: str, n_files: int | None = None, bad_bytes: bool = False,
                   joined: bool = False) -> DataFrame:
    """archive(file, value): the lines of ``pgn_lines_b4`` as a text file has them, a game a row, its lines parted by line
    ends.  The orders are dealt out by file (over ``n_files`` partitions) and sorted by key before any text is made,
    which is the order of ``file`` and ``ln``: written as text, they are the same files as the sorted lines."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("file", _file_b4("o_orderkey"))
    dealt = o.repartition(n_files, "file") if n_files else o.repartition("file")
    g, lines = _pgn_b4(dealt.sortWithinPartitions("file", "o_orderkey"), bad_bytes, joined, "file")
    return g.select("file", F.array_join(lines, "\n").alias("value"))


def _file_b4(key: str):
    return (F.col(key) % N_FILES).cast("int")


def _pgn_b4(o: DataFrame, bad_bytes: bool, joined: bool, *keep: str):
    """(orders as games, the array of a game's lines, NULL for one that it has not)."""
    k = F.col("o_orderkey")
    g = o.select(*keep, k.alias("k"), "o_custkey", "o_orderpriority",
                 (F.lit(600) + (k * 37) % 2400).cast("int").alias("we"),
                 (F.lit(600) + (k * 53 + 11) % 2400).cast("int").alias("be"),
                 _pick(RESULTS, k % 3).alias("res"))
    kk = F.col("k")

    def tag(name, val):
        return F.concat(F.lit(f'[{name} "'), val, F.lit('"]'))

    white = (F.when(kk % 11 == 0, F.lit(None).cast("string"))
             .when(kk % 13 == 0, tag("WhiteElo", F.lit("?")))
             .when(kk % 17 == 0, tag("WhiteElo", F.lit("50")))
             .otherwise(tag("WhiteElo", F.col("we").cast("string"))))
    moves = (F.when(kk % 19 == 0, F.lit(None).cast("string"))
             .when(kk % 23 == 0, F.concat(F.lit("1. e4 "), F.col("res")))
             .otherwise(F.concat(_pick(MOVETEXTS, kk % 8), F.lit(" "), F.col("res"))))
    lines = F.array(
        tag("Event", F.concat(F.lit("Rated game "), (kk % 5).cast("string"))),
        tag("Site", F.concat(F.lit("orders/"), kk.cast("string"))),
        tag("White", F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))),
        tag("Black", F.col("o_orderpriority")),
        tag("Result", F.col("res")),
        white,
        tag("BlackElo", F.col("be").cast("string")),
        F.lit(""), moves, F.lit(""))
    if bad_bytes:
        broken = F.concat(lines[2].cast("binary"), F.lit(b"\xff")).cast("string")
        lines = F.transform(lines, lambda x, i: F.when((i == 2) & (kk % 29 == 0), broken).otherwise(x))
    if joined:
        sep = F.when(kk % 2 == 0, F.lit("\u2028")).otherwise(F.lit("\x0b"))
        tags = F.concat_ws("\n", F.slice(lines, 1, 7))
        lines = F.when(kk % 7 == 0, F.concat(F.array(F.replace(tags, F.lit("\n"), sep)), F.slice(lines, 8, 3))).otherwise(lines)
    return g, lines


def history_b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history(run, epoch, train_loss, val_loss, train_mae, val_mae) from events:
    run = user, epoch = day of month - 1.  Values are ratios of exact integer
    sums, so every engine computes the same doubles."""
    e = table(spark, sf_dir, "events", "event_id")
    c = F.round(F.col("value") * 100).cast("long")
    n = F.count(F.lit(1))
    return (e.groupBy(F.col("user_id").alias("run"),
                      (F.dayofmonth("ts") - 1).cast("int").alias("epoch"))
            .agg((F.max(c) / F.lit(100000.0)).alias("train_loss"),
                 (F.sum(c) / (n * F.lit(10000.0))).alias("val_loss"),
                 (F.min(c) / F.lit(10000.0)).alias("train_mae"),
                 (F.sum(F.abs(c - 5000)) / (n * F.lit(100000.0))).alias("val_mae")))


def history_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 with a NaN validation loss wherever (run * 7 + epoch) % 5 = 0, some first
    epochs among them."""
    h = history_b5(spark, sf_dir)
    return h.withColumn("val_loss", F.when((F.col("run") * 7 + F.col("epoch")) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("val_loss")))


# --- fixed values: movetexts that are hard to parse, with their main lines ---
EDGE_MOVETEXTS = [
    ("1. e4 (1. d4 d5 (1... Nf6 2. c4 (2. Nf3 g6 (2... e6 3. g3 (3. e3)) 3. c4) 2... e6)) e5 2. Nf3", "e4 e5 Nf3"),
    ("1. e4 {a comment\n\nover a blank line (with a bracket} e5 2. Nf3 Nc6", "e4 e5 Nf3 Nc6"),
    ("1. e4 e5 ; a comment to the end (of the line\n2. Nf3 $3 Nc6!?", "e4 e5 Nf3 Nc6"),
    ("1. e4 e5 (2. d4) 2. Nf3 ) Nc6 3. Bb5 (3. Bc4 (3. d4 never closed", "e4 e5 Nf3 Nc6 Bb5"),
    ("1. e4\n% an escape line in the moves\n1... c5 2. Nf3", "e4 c5 Nf3"),
]


def edge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records(game_id, game_text): one game per order with a movetext of the pool
    (key % 5); every third begins with an escape line."""
    k = F.col("o_orderkey")
    head = F.when(k % 3 == 0, "% exported\n").otherwise("")
    text = F.concat(head, F.lit('[Event "e"]\n[White "w"]\n[WhiteElo "1500"]\n[BlackElo "1600"]\n[Result "1-0"]\n\n'),
                    _pick([m for m, _ in EDGE_MOVETEXTS], k % len(EDGE_MOVETEXTS)), F.lit(" 1-0\n"))
    return table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("game_id"), text.alias("game_text"))


def attention_b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attention(game_id, weights ARRAY<FLOAT>) = |embedding| (64 per row)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("game_id"),
                    F.transform("embedding", lambda x: F.abs(x)).alias("weights"))


def batch_log_b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_log(run, epoch, step, l_orderkey, l_partkey, l_suppkey, loss, mae, n)
    from lineitem: run = return flag, step = line number, epoch = step - 1,
    loss/mae in hundredths (integral doubles), n = quantity."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey")
    return li.select(F.col("l_returnflag").alias("run"),
                     (F.col("l_linenumber") - 1).cast("int").alias("epoch"),
                     F.col("l_linenumber").cast("int").alias("step"),
                     "l_orderkey", "l_partkey", "l_suppkey",
                     F.round(F.col("l_discount") * 100).alias("loss"),
                     F.round(F.col("l_tax") * 100).alias("mae"),
                     F.col("l_quantity").alias("n"))
