"""Parser cases of the original test-suite, restated on DataFrames, plus framing."""

from pyspark.sql import functions as F

from fianchetto.operators import framing, games, replay

VALID = """[Event "Rated Blitz game"]
[Site "https://example.org/abc"]
[Date "2013.01.01"]
[White "PlayerA"]
[Black "PlayerB"]
[Result "1-0"]
[WhiteElo "1600"]
[BlackElo "1400"]

1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 6. Re1 b5 7. Bb3 d6 8. c3 O-O 9. h3 Nb8 10. d4 Nbd7 1-0
"""


def _parse(spark, texts):
    df = spark.createDataFrame([(i, 0, i * 100, t) for i, t in enumerate(texts)],
                               "game_id long, file int, first_ln long, game_text string")
    p = games.parse_games(df, id_col="game_id")
    return p


def test_valid_game(spark):
    p = _parse(spark, [VALID])
    r = p.collect()[0]
    assert r.parse_status == "ok"
    assert (r.white_elo, r.black_elo, r.result) == (1600, 1400, "1-0")
    g = replay.replay_games(p.select("game_id", "moves")).collect()[0]
    assert g.replay_status == "ok" and len(g.fens) == 21 and all(g.fens)


def test_rejects(spark):
    missing = '[Event "Test"]\n[Result "1-0"]\n\n1. e4 e5 2. Nf3\n'
    invalid = '[WhiteElo "invalid"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n1. e4 e5\n'
    low = '[WhiteElo "50"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n1. e4 e5\n'
    short = '[WhiteElo "1600"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n1. e4\n'
    st = [r.parse_status for r in _parse(spark, [missing, invalid, low, short]).orderBy("game_id").collect()]
    assert st == ["missing_header", "bad_elo", "elo_out_of_range", "too_short"]


def test_int_grammar_and_default_result(spark):
    t = '[WhiteElo " 1_600 "]\n[BlackElo "+1400"]\n\n1. e4 e5\n'
    bad = '[WhiteElo "1600.5"]\n[BlackElo "1400"]\n\n1. e4 e5\n'
    rows = _parse(spark, [t, bad]).orderBy("game_id").collect()
    assert (rows[0].white_elo, rows[0].black_elo, rows[0].result, rows[0].parse_status) == (1600, 1400, "*", "ok")
    assert rows[1].parse_status == "bad_elo"


def test_duplicate_tag_last_wins(spark):
    t = '[WhiteElo "1500"]\n[WhiteElo "1700"]\n[BlackElo "1400"]\n\n1. e4 e5\n'
    assert _parse(spark, [t]).collect()[0].white_elo == 1700


def test_movetext_tokens(spark):
    t = ('[WhiteElo "1500"]\n[BlackElo "1400"]\n\n1. e4 {a comment} 1... e5 (1... c5 2. Nf3 (2. c3 d5)) '
         '2. Nf3 $1 Nc6?! 3. O-O 1-0\n')
    assert _parse(spark, [t]).collect()[0].moves == ["e4", "e5", "Nf3", "Nc6", "O-O"]


def _lines(spark, text, file=0):
    rows = [(file, i, l) for i, l in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file int, ln long, line string")


GAMES = ("[Event \"a\"]\n[WhiteElo \"1500\"]\n\n1. e4 e5 1-0\n\n"
         "[Event \"b\"]\n[WhiteElo \"1500\"]\n\n\n"                       # no moves
         "[Event \"c\"]\n[WhiteElo \"1500\"]\n\n1. d4 d5 0-1\n\n"
         "[Event \"d\"]\n[WhiteElo \"1500\"]\n\n1. c4 c5 1-0")              # no closing blank


def test_framing_reference_glues_and_drops(spark):
    out = framing.frame_games(_lines(spark, GAMES), mode="reference").orderBy("first_ln").collect()
    assert len(out) == 2
    assert out[0].game_text.startswith('[Event "a"]')
    assert '[Event "b"]' in out[1].game_text and '[Event "c"]' in out[1].game_text


def test_framing_clean_recovers(spark):
    out = framing.frame_games(_lines(spark, GAMES), mode="clean", chunk_lines=3).orderBy("first_ln").collect()
    assert [r.game_text.split("\n")[0] for r in out] == ['[Event "a"]', '[Event "b"]', '[Event "c"]', '[Event "d"]']
    p = games.parse_games(spark.createDataFrame(out).withColumn("game_id", F.col("first_ln")), id_col="game_id")
    st = [r.parse_status for r in p.orderBy("first_ln").collect()]
    assert st[1] == "missing_header" or st[1] == "too_short"


def test_framing_chunking_is_exact(spark):
    text = "\n".join([GAMES] * 7)
    a = framing.frame_games(_lines(spark, text), mode="reference", chunk_lines=2).orderBy("first_ln").collect()
    b = framing.frame_games(_lines(spark, text), mode="reference", chunk_lines=10_000).orderBy("first_ln").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_a_record_is_scanned_once(spark):
    """Each costly pattern stands once in the plan of the parse, however often its result is read."""
    from fianchetto.functions.pgn import MOVETEXT_LINES, NOISE
    from fianchetto.operators import games

    records = spark.createDataFrame([(1, "[Event \"e\"]\n\n1. e4 e5 1-0")], "game_id long, game_text string")
    plan = games.valid_games(games.parse_games(records, id_col="game_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(NOISE) == 1 and plan.count(MOVETEXT_LINES) == 1


def test_records_across_chunks_and_null_lines(spark):
    """Pieces of a record in several chunks are put together; a NULL line counts and has no text."""
    from fianchetto.operators.framing import frame_games

    text = ['[Event "a"]', "x", None, "y", '[Event "b"]', None, '[Event "c"]', "z", "w"]
    lines = spark.createDataFrame([("f", i * 3, t) for i, t in enumerate(text)], "file string, ln long, line string")
    for chunk in (1, 4, 7, 1000):
        got = sorted(tuple(r) for r in frame_games(lines, chunk_lines=chunk).collect())
        assert got == [("f", 0, 4, '[Event "a"]\nx\ny'), ("f", 12, 2, '[Event "b"]'), ("f", 18, 3, '[Event "c"]\nz\nw')]


def test_line_tests_equal_their_patterns(spark):
    """Blank lines and lines with moves, told without scanning every line by a pattern, are those of the patterns."""
    import itertools

    from fianchetto.functions.pgn import has_moves, is_blank

    parts = ["", " ", "\t", "\x0b", "\x0c", "\r", "\n", "\x85", "\u2028", "\u2029", "\xa0", "1. ", "1.", "x", " 1. ", "11. "]
    lines = sorted({"".join(p) for p in itertools.product(parts, repeat=3)})
    d = spark.createDataFrame([(x,) for x in [*lines, None]], "line string")
    differ = d.where(~(is_blank("line").eqNullSafe(F.col("line").rlike(r"^\s*$"))
                       & has_moves("line").eqNullSafe(F.col("line").rlike(r"^\s*1\. .*\S| 1\. "))))
    assert differ.collect() == []
    plan = d.where(is_blank("line"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_tokens_and_tags_without_lambdas_equal_those_with(spark):
    """Tokens are cut at any white space; results, blanks and annotations go; a repeated tag keeps its last value and place."""
    from fianchetto.functions.pgn import header_map, movetext_tokens

    texts = {"e4  e5\tNf3\x0bNc6\x0cd4\r\nd5 1-0": ["e4", "e5", "Nf3", "Nc6", "d4", "d5"], "": [], " ": [], "1-0": [], "1-0! ?! e4!? * e5??": ["1-0", "e4", "e5"],
             "1. e4 (1. d4 1-0) e5? 1/2-1/2": ["e4", "e5"], "e4\xa0e5 \x1c": ["e4\xa0e5", "\x1c"]}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.m for r in d.select("t", movetext_tokens("t").alias("m")).collect()} == texts
    plan = d.select(movetext_tokens("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan
    h = spark.createDataFrame([('[A "x"]\n[B "y"]\n[A "z"]\n',), ('[A "x"]\n[B "y"]\n',), ("",)], "t string")
    assert [dict(r.m) for r in h.select(header_map("t").alias("m")).collect()] == [{"B": "y", "A": "z"}, {"A": "x", "B": "y"}, {}]
