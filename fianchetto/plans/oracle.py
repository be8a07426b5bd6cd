"""DuckDB oracle SQL for every registered query (same output column names).

Written independently of the Spark operators, straight from the semantics:
global windows and sorts are fine here because the oracle only runs on the
small correctness tables.
"""

from __future__ import annotations

from fianchetto.plans import bindings as B

R = 9


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


RESULTS = _list(B.RESULTS)
MOVES = _list(B.MOVETEXTS)
FENS = _list(B.FEN_POOL)

G = f"""g AS (
  SELECT o_orderkey AS game_id,
         CAST(600 + (o_orderkey * 37) % 2400 AS INTEGER) AS white_elo,
         CAST(600 + (o_orderkey * 53 + 11) % 2400 AS INTEGER) AS black_elo,
         {RESULTS}[CAST(o_orderkey % 3 AS INTEGER) + 1] AS result,
         CAST(2 + o_orderkey % 250 AS INTEGER) AS n_ply
  FROM orders)"""

P = f"""p AS (
  SELECT game_id, CAST(ply AS INTEGER) AS ply,
         {FENS}[CAST((game_id * 7 + ply * 13) % 16 AS INTEGER) + 1] AS fen
  FROM (SELECT game_id, unnest(range(0, n_ply + 1)) AS ply FROM g))"""

NORM = "(CAST(greatest(800, least(2800, {e})) - 800 AS DOUBLE) / 2000.0::DOUBLE)"
DENORM = "CAST(trunc({x} * 2000.0::DOUBLE + 800.0::DOUBLE) AS INTEGER)"

SC = f"""sc AS (
  SELECT game_id, white_elo, t AS target,
         least(greatest(t + CAST((game_id * 31) % 401 - 200 AS DOUBLE) / 2000.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS pred
  FROM (SELECT game_id, white_elo, {NORM.format(e='white_elo')} AS t FROM g)),
se AS (
  SELECT *, {DENORM.format(x='target')} AS target_elo, {DENORM.format(x='pred')} AS pred_elo FROM sc)"""

LINES = f"""src AS (
  SELECT o_orderkey AS k, o_custkey, o_orderpriority,
         CAST(600 + (o_orderkey * 37) % 2400 AS INTEGER) AS we,
         CAST(600 + (o_orderkey * 53 + 11) % 2400 AS INTEGER) AS be,
         {RESULTS}[CAST(o_orderkey % 3 AS INTEGER) + 1] AS res
  FROM orders),
arr AS (
  SELECT k, [
    '[Event "Rated game ' || CAST(k % 5 AS VARCHAR) || '"]',
    '[Site "orders/' || CAST(k AS VARCHAR) || '"]',
    '[White "cust' || CAST(o_custkey AS VARCHAR) || '"]',
    '[Black "' || o_orderpriority || '"]',
    '[Result "' || res || '"]',
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '[WhiteElo "?"]'
         WHEN k % 17 = 0 THEN '[WhiteElo "50"]' ELSE '[WhiteElo "' || CAST(we AS VARCHAR) || '"]' END,
    '[BlackElo "' || CAST(be AS VARCHAR) || '"]',
    '',
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '1. e4 ' || res
         ELSE {MOVES}[CAST(k % 8 AS INTEGER) + 1] || ' ' || res END,
    ''] AS ls
  FROM src),
lines AS (
  SELECT CAST(k % 64 AS INTEGER) AS file, k * 16 + i - 1 AS ln, ls[i] AS line
  FROM (SELECT k, ls, unnest(range(1, 11)) AS i FROM arr)
  WHERE ls[i] IS NOT NULL)"""

FRAME_CLEAN = """fl AS (
  SELECT file, ln, line,
         SUM(CASE WHEN starts_with(line, '[Event ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY file ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gq
  FROM lines),
rec AS (
  SELECT file, min(ln) AS first_ln, CAST(count(*) AS INTEGER) AS n_lines,
         string_agg(line, chr(10) ORDER BY ln) AS game_text
  FROM fl WHERE gq > 0 GROUP BY file, gq)"""

FRAME_REF = r"""fl AS (
  SELECT file, ln, line,
         CASE WHEN regexp_matches(line, '^\s*$') THEN 1 ELSE 0 END AS blank,
         CASE WHEN regexp_matches(line, '^\s*1\. .*\S| 1\. ') THEN 1 ELSE 0 END AS mv
  FROM lines),
bl AS (
  SELECT *, COALESCE(SUM(blank) OVER (PARTITION BY file ORDER BY ln
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk
  FROM fl),
blocks AS (
  SELECT file, blk, min(ln) AS bfirst, max(mv) * max(blank) AS e FROM bl GROUP BY file, blk),
rb AS (
  SELECT *, COALESCE(SUM(e) OVER (PARTITION BY file ORDER BY bfirst
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rq
  FROM blocks),
okr AS (SELECT file, rq FROM rb GROUP BY file, rq HAVING max(e) = 1),
rec AS (
  SELECT bl.file, min(bl.ln) AS first_ln, CAST(count(*) AS INTEGER) AS n_lines,
         string_agg(bl.line, chr(10) ORDER BY bl.ln) AS game_text
  FROM bl JOIN rb USING (file, blk) JOIN okr USING (file, rq)
  GROUP BY bl.file, rb.rq)"""

TAG = r"""CASE WHEN regexp_matches(hb, '(?m)^\[{name}\s+".*"\]\s*$')
            THEN regexp_extract(hb, '(?m)^\[{name}\s+"(.*)"\]\s*$', 1) END"""
INTG = r"""CASE WHEN regexp_matches({x}, '^\s*[+-]?\d+(_\d+)*\s*$')
            THEN TRY_CAST(replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '_', '') AS INTEGER) END"""

PARSED = r"""h1 AS (
  SELECT file, first_ln, game_text, first_ln // 16 AS game_id,
         regexp_extract(game_text, '^\s*((?:\[[^\n]*(?:\n|$))*)', 1) AS hb,
         regexp_extract(regexp_replace(game_text, '^\s*(?:\[[^\n]*(?:\n|$))*\s*', ''),
                        '^((?:[^\[\n][^\n]*(?:\n|$))*)', 1) AS mt
  FROM rec),
h2 AS (
  SELECT *, """ + TAG.format(name="WhiteElo") + """ AS white_elo_raw,
         """ + TAG.format(name="BlackElo") + """ AS black_elo_raw,
         COALESCE(""" + TAG.format(name="Result") + """, '*') AS result,
         """ + TAG.format(name="Event") + r""" AS event,
         len(regexp_extract_all(hb, '(?m)^\[[A-Za-z0-9][A-Za-z0-9_+#=:-]*\s+".*"\]\s*$')) AS n_tags,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(mt, '\{[^}]*\}', ' ', 'g'), ';[^\n]*', ' ', 'g'),
           '\([^()]*\)', ' ', 'g'), '\([^()]*\)', ' ', 'g'), '\([^()]*\)', ' ', 'g'),
           '\$\d+', ' ', 'g'), '\d+\.+', ' ', 'g') AS mclean
  FROM h1),
h3 AS (
  SELECT *, """ + INTG.format(x="white_elo_raw") + """ AS white_elo,
         """ + INTG.format(x="black_elo_raw") + r""" AS black_elo,
         list_filter(list_transform(
           list_filter(string_split_regex(mclean, '\s+'),
                       lambda t: t <> '' AND t NOT IN ('1-0', '0-1', '1/2-1/2', '*')),
           lambda t: regexp_replace(t, '[?!]+$', '')), lambda t: t <> '') AS moves
  FROM h2),
parsed AS (
  SELECT *, CASE
      WHEN NOT (COALESCE(white_elo_raw, '') <> '' AND COALESCE(black_elo_raw, '') <> ''
                AND COALESCE(result, '') <> '') THEN 'missing_header'
      WHEN white_elo IS NULL OR black_elo IS NULL THEN 'bad_elo'
      WHEN NOT (white_elo BETWEEN 100 AND 5000 AND black_elo BETWEEN 100 AND 5000) THEN 'elo_out_of_range'
      WHEN len(moves) + 1 < 3 THEN 'too_short'
      ELSE 'ok' END AS parse_status
  FROM h3)"""


def _expand(x: str) -> str:
    for d in "0123456789":
        x = f"replace({x}, '{d}', '{' ' * int(d)}')"
    return x


NON_INT = r"[\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"

BOARD = f"""pb AS (
  SELECT *, split_part(fen, ' ', 1) AS board FROM p),
pr AS (
  SELECT *, list_transform(string_split(board, '/'), lambda r: {_expand('r')}) AS ranks FROM pb),
pv AS (
  SELECT *,
    NOT (list_bool_or(list_transform(ranks, lambda r, i: length(rtrim(r)) > 8 OR (i > 8 AND length(rtrim(r)) > 0)))
         OR regexp_matches(board, '{NON_INT}')) AS valid,
    {' || '.join(f"rpad(COALESCE(ranks[{i}], ''), 8, ' ')" for i in range(1, 9))} AS flat
  FROM pr),
pf AS (
  SELECT *,
    CASE WHEN valid THEN translate(regexp_replace(flat, '[^pnbrqkPNBRQK]', '0', 'g'), 'pnbrqkPNBRQK', '123456789abc') END AS board_codes,
    CASE WHEN valid THEN list_sort(list_filter(list_transform(range(0, 64), lambda s:
        CASE WHEN substr(flat, s + 1, 1) = ' ' THEN -1
             ELSE greatest(instr('.pnbrqkPNBRQK', substr(flat, s + 1, 1)) - 1, 0) * 64 + s END),
        lambda x: x >= 0)) END AS onehot_idx
  FROM pv)"""


# md5 of the 200 slots' indices, empty slots to the end
DIGEST = """md5(string_agg(CASE WHEN pf.valid THEN array_to_string(pf.onehot_idx, ',') ELSE '' END, ';' ORDER BY pf.ply)
             || repeat(';', CAST(200 - least(g.n_ply + 1, 200) AS BIGINT)))"""
SEQ = f"""sq AS (
  SELECT g.game_id, {DIGEST} AS seq_md5 FROM g JOIN pf ON pf.game_id = g.game_id AND pf.ply < 200
  GROUP BY g.game_id, g.n_ply)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SPLIT = f"""r0 AS (
  SELECT game_id, row_number() OVER (ORDER BY md5('42:' || CAST(game_id AS VARCHAR)), game_id) - 1 AS rk,
         count(*) OVER () AS n
  FROM g),
sp AS (
  SELECT game_id, rk, CAST(trunc(n * 0.8::DOUBLE) AS BIGINT) AS te,
         CAST(trunc(n * 0.8::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.1::DOUBLE) AS BIGINT) AS ve
  FROM r0),
s AS (
  SELECT game_id, rk,
         CASE WHEN rk < te THEN 'train' WHEN rk < ve THEN 'val' ELSE 'test' END AS split,
         CASE WHEN rk < te THEN rk WHEN rk < ve THEN rk - te ELSE rk - ve END AS split_rk
  FROM sp)"""

H = """h AS (
  SELECT user_id AS run, CAST(day(ts) - 1 AS INTEGER) AS epoch,
         max(c) / 100000.0::DOUBLE AS train_loss,
         sum(c) / (count(*) * 10000.0::DOUBLE) AS val_loss,
         min(c) / 10000.0::DOUBLE AS train_mae,
         sum(abs(c - 5000)) / (count(*) * 100000.0::DOUBLE) AS val_mae
  FROM (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS c FROM events)
  GROUP BY 1, 2)"""

BL = """bl AS (
  SELECT l_returnflag AS run, CAST(l_linenumber - 1 AS INTEGER) AS epoch,
         CAST(l_linenumber AS INTEGER) AS step, l_orderkey, l_partkey, l_suppkey,
         round(l_discount * 100) AS loss, round(l_tax * 100) AS mae, l_quantity AS n
  FROM lineitem)"""


def _early_stop_ctes(patience: int, min_delta: float) -> str:
    better = f"(NOT isnan(f.best) AND o.val_loss < f.best - {float(min_delta)!r}::DOUBLE)"
    return f"""o AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn FROM h),
f(run, rn, epoch, best, cnt, stop) AS (
  SELECT run, rn, epoch, val_loss, 0, CAST(NULL AS INTEGER) FROM o WHERE rn = 1
  UNION ALL
  SELECT o.run, o.rn, o.epoch,
         CASE WHEN {better} THEN o.val_loss ELSE f.best END,
         CASE WHEN {better} THEN 0 ELSE f.cnt + 1 END,
         CASE WHEN NOT {better} AND f.cnt + 1 >= {patience} THEN o.epoch END
  FROM f JOIN o ON o.run = f.run AND o.rn = f.rn + 1
  WHERE f.stop IS NULL),
st AS (
  SELECT run, max(stop) AS stop_epoch, arg_max(best, rn) AS best_loss, CAST(max(rn) AS INTEGER) AS epochs_run
  FROM f GROUP BY run)"""


def _lr_ctes(lr0=1e-3, factor=0.5, patience=3, threshold=1e-4, eps=1e-8, min_lr=0.0) -> str:
    rel = repr(1.0 - threshold)
    cand = f"greatest(f.lr * {factor!r}::DOUBLE, {min_lr!r}::DOUBLE)"
    better = f"(o.val_loss < f.best * {rel}::DOUBLE)"
    bad = f"(CASE WHEN {better} THEN 0 ELSE f.bad + 1 END)"
    newlr = f"(CASE WHEN {bad} > {patience} AND f.lr - {cand} > {eps!r}::DOUBLE THEN {cand} ELSE f.lr END)"
    return f"""o AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn FROM h),
f(run, rn, epoch, best, bad, lr, lr_used) AS (
  SELECT run, rn, epoch, val_loss, 0, {lr0!r}::DOUBLE, {lr0!r}::DOUBLE FROM o WHERE rn = 1
  UNION ALL
  SELECT o.run, o.rn, o.epoch,
         CASE WHEN {better} THEN o.val_loss ELSE f.best END,
         CASE WHEN {bad} > {patience} THEN 0 ELSE {bad} END,
         {newlr},
         f.lr
  FROM f JOIN o ON o.run = f.run AND o.rn = f.rn + 1)"""


def _final(src: str) -> str:
    return f"""SELECT run, max(epoch) AS last_epoch, arg_max(train_loss, epoch) AS train_loss,
       arg_max(val_loss, epoch) AS val_loss, arg_max(train_mae, epoch) AS train_mae,
       arg_max(val_mae, epoch) AS val_mae
FROM {src} GROUP BY run"""


def _best(src: str) -> str:
    return f"""SELECT run, min(epoch) FILTER (WHERE val_loss = mv) AS best_epoch, min(mv) AS best_loss,
       CAST(sum(CASE WHEN bb IS NULL OR val_loss < bb THEN 1 ELSE 0 END) AS INTEGER) AS n_checkpoints
FROM (SELECT *, min(val_loss) OVER (PARTITION BY run) AS mv,
             min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb
      FROM {src})
GROUP BY run"""


SQL: dict[str, str] = {}

SQL["frame_games_clean"] = _with(LINES, FRAME_CLEAN) + "SELECT file, first_ln, n_lines, game_text FROM rec"
SQL["frame_games_reference"] = _with(LINES, FRAME_REF) + "SELECT file, first_ln, n_lines, game_text FROM rec"
SQL["parse_headers"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    "SELECT game_id, event, white_elo_raw, black_elo_raw, result, CAST(n_tags AS INTEGER) AS n_tags FROM parsed"
SQL["valid_games"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    "SELECT game_id, white_elo, black_elo, result, CAST(len(moves) AS INTEGER) AS n_moves FROM parsed WHERE parse_status = 'ok'"
SQL["reject_counts"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    "SELECT parse_status, count(*) AS n_games FROM parsed GROUP BY 1"
SQL["reject_counts_reference"] = _with(LINES, FRAME_REF, PARSED) + \
    "SELECT parse_status, count(*) AS n_games FROM parsed GROUP BY 1"
SQL["movetext_tokens"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    """SELECT game_id, CAST(i AS INTEGER) AS ply, moves[i] AS san
FROM (SELECT game_id, moves, unnest(range(1, len(moves) + 1)) AS i FROM parsed)"""
SQL["max_games"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    """SELECT game_id, file, first_ln, white_elo, black_elo FROM parsed WHERE parse_status = 'ok'
ORDER BY file, first_ln LIMIT 100"""

SQL["even_plies"] = _with(G, P) + \
    "SELECT game_id, CAST(ply // 2 AS INTEGER) AS idx, fen FROM p WHERE ply % 2 = 0"
SQL["odd_plies"] = _with(G, P) + \
    "SELECT game_id, CAST(ply // 2 AS INTEGER) AS idx, fen FROM p WHERE ply % 2 = 1"
SQL["board_matrix"] = _with(G, P, BOARD) + "SELECT game_id, ply, valid, board_codes FROM pf"
SQL["board_onehot"] = _with(G, P, BOARD) + \
    """SELECT game_id, ply, CAST(len(onehot_idx) AS INTEGER) AS n_set,
       CASE WHEN valid THEN array_to_string(onehot_idx, ',') END AS onehot FROM pf"""
SQL["fen_features"] = _with(G, P) + r"""SELECT game_id, ply,
  CAST(length(regexp_replace(split_part(fen, ' ', 1), '[^pnbrqkPNBRQK]', '', 'g')) AS INTEGER) AS piece_count,
  CAST(length(regexp_replace(split_part(fen, ' ', 1), '[^PNBRQK]', '', 'g')) AS INTEGER) AS white_pieces,
  CAST(length(regexp_replace(split_part(fen, ' ', 1), '[^pnbrqk]', '', 'g')) AS INTEGER) AS black_pieces,
  CASE WHEN len(string_split(fen, ' ')) < 2 THEN NULL
       WHEN string_split(fen, ' ')[2] = 'w' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS to_move
FROM p"""
SQL["encode_sequence"] = _with(G, P, BOARD) + """SELECT g.game_id, CAST(least(g.n_ply + 1, 200) AS INTEGER) AS length,
  200 AS slots,
  CAST(count(*) FILTER (WHERE pf.valid AND len(pf.onehot_idx) > 0) AS INTEGER) AS n_nonempty,
  CAST(COALESCE(sum(CASE WHEN pf.valid THEN len(pf.onehot_idx) ELSE 0 END), 0) AS INTEGER) AS n_set,
  """ + DIGEST + """ AS seq_md5
FROM g JOIN pf ON pf.game_id = g.game_id AND pf.ply < 200
GROUP BY g.game_id, g.n_ply"""
SQL["build_samples"] = _with(G, P, BOARD, SEQ) + f"""SELECT g.game_id, CAST(least(n_ply + 1, 200) AS INTEGER) AS length,
  CAST({NORM.format(e='black_elo')} AS FLOAT) AS elo,
  CAST(white_elo AS DOUBLE) AS white_elo, CAST(black_elo AS DOUBLE) AS black_elo, result, seq_md5
FROM g JOIN sq USING (game_id)"""

SQL["normalize_elo"] = _with(G) + \
    f"SELECT game_id, {NORM.format(e='white_elo')} AS white_norm, {NORM.format(e='black_elo')} AS black_norm FROM g"
SQL["denormalize_elo"] = _with(G, SC) + "SELECT game_id, pred_elo, target_elo FROM se"
SQL["elo_roundtrip_f32"] = _with(G) + f"""SELECT game_id, white_elo,
  {DENORM.format(x=NORM.format(e='white_elo'))} AS rt64,
  {DENORM.format(x='CAST(CAST(' + NORM.format(e='white_elo') + ' AS FLOAT) AS DOUBLE)')} AS rt32
FROM g"""
SQL["assign_difficulty"] = _with(G) + """, seg AS (
  SELECT CAST(i AS INTEGER) AS segment,
         COALESCE(['Easy', 'Normal', 'Hard', 'Impossible'][i + 1], 'Level_' || CAST(i + 1 AS VARCHAR)) AS difficulty,
         CAST(trunc(800.0::DOUBLE + CAST(i AS DOUBLE) * 500.0::DOUBLE) AS INTEGER) AS min_elo,
         CAST(trunc(800.0::DOUBLE + CAST(i + 1 AS DOUBLE) * 500.0::DOUBLE) AS INTEGER) AS max_elo,
         COALESCE(['green', 'yellow', 'orange', 'red'][i + 1], 'blue') AS color
  FROM (SELECT unnest(range(0, 4)) AS i))
SELECT segment, difficulty, CAST(min_elo AS VARCHAR) || '-' || CAST(max_elo AS VARCHAR) AS elo_range,
       min_elo, max_elo, color, count(*) AS n_games
FROM g JOIN seg ON g.white_elo >= seg.min_elo AND g.white_elo < seg.max_elo
GROUP BY ALL""".replace("WITH g AS", "WITH g AS", 1)
SQL["assign_difficulty"] = SQL["assign_difficulty"].replace("\n, seg AS", ", seg AS")

SQL["split_exact"] = _with(G, SPLIT) + "SELECT game_id, split, rk, split_rk FROM s"
SQL["split_counts"] = _with(G, SPLIT) + f"""SELECT split, n_games, round(n_games / sum(n_games) OVER (), {R}) AS share
FROM (SELECT split, count(*) AS n_games FROM s GROUP BY split)"""
SQL["head_subset"] = _with(G, SPLIT) + """SELECT game_id, split, split_rk FROM s
WHERE (split = 'train' AND split_rk < 500) OR (split = 'val' AND split_rk < 100) OR (split = 'test' AND split_rk < 100)"""
SQL["sample_exact"] = _with(G, SPLIT) + """SELECT game_id, split, sample_rk FROM (
  SELECT game_id, split,
         row_number() OVER (PARTITION BY split ORDER BY md5('sample:42:' || CAST(game_id AS VARCHAR)), game_id) - 1 AS sample_rk
  FROM s)
WHERE (split = 'train' AND sample_rk < 5000) OR (split = 'val' AND sample_rk < 500) OR (split = 'test' AND sample_rk < 500)"""
SQL["assign_batches"] = _with(G, SPLIT) + """SELECT game_id, split, epoch, CAST(ord // 32 AS BIGINT) AS batch_id,
       CAST(ord % 32 AS INTEGER) AS batch_pos
FROM (
  SELECT game_id, split, epoch,
         CASE WHEN split = 'train'
              THEN row_number() OVER (PARTITION BY split, epoch ORDER BY
                     md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(game_id AS VARCHAR)), game_id) - 1
              ELSE split_rk END AS ord
  FROM s, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS epoch))"""

SQL["regression_metrics"] = _with(G, SC) + f"""SELECT count(*) AS n,
  round(avg((target - pred) * (target - pred)), {R}) AS mse,
  round(avg(abs(target - pred)), {R}) AS mae,
  round(sqrt(avg((target - pred) * (target - pred))), {R}) AS rmse,
  round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS mae_elo,
  round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS rmse_elo
FROM se"""
SQL["evaluate_predictions"] = _with(G, SC) + f"""SELECT count(*) AS n,
  round(avg((target - pred) * (target - pred)), {R}) AS mse,
  round(avg(abs(target - pred)), {R}) AS mae,
  round(sqrt(avg((target - pred) * (target - pred))), {R}) AS rmse,
  round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), {R}) AS r2,
  round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS mae_elo,
  round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS rmse_elo
FROM se"""
SQL["elo_metrics_f32"] = _with(G, SC) + f""", f32 AS (
  SELECT {DENORM.format(x='CAST(CAST(target AS FLOAT) AS DOUBLE)')} AS te,
         {DENORM.format(x='CAST(CAST(pred AS FLOAT) AS DOUBLE)')} AS pe FROM sc)
SELECT count(*) AS n, round(avg(CAST(abs(te - pe) AS DOUBLE)), {R}) AS mae_elo,
       round(sqrt(avg(CAST((te - pe) * (te - pe) AS DOUBLE))), {R}) AS rmse_elo
FROM f32""".replace("\n, f32", ", f32")
SQL["segment_by_elo"] = _with(G, SC) + f""", bands AS (
  SELECT * FROM (VALUES ('Beginner', 800, 1200), ('Intermediate', 1200, 1600),
                        ('Advanced', 1600, 2000), ('Master', 2000, 2800)) t(label, min_elo, max_elo))
SELECT label, CAST(min_elo AS VARCHAR) || '-' || CAST(max_elo AS VARCHAR) AS range,
       CAST(min_elo AS INTEGER) AS min_elo, CAST(max_elo AS INTEGER) AS max_elo, count(*) AS "count",
       round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS mae,
       round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS rmse
FROM se JOIN bands ON se.target_elo >= bands.min_elo AND se.target_elo < bands.max_elo
GROUP BY label, min_elo, max_elo""".replace("\n, bands", ", bands")
SQL["residuals"] = _with(G, SC) + "SELECT game_id, target_elo, pred_elo, target_elo - pred_elo AS residual FROM se"
SQL["residual_histogram"] = _with(G, SC) + f""", rv AS (SELECT CAST(target_elo - pred_elo AS DOUBLE) AS v FROM se),
st0 AS (SELECT min(v) AS lo0, max(v) AS hi0 FROM rv),
st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
c AS (SELECT CAST(least(floor((v - lo) * (50.0::DOUBLE / (hi - lo))), 49) AS INTEGER) AS bin, count(*) AS n
      FROM rv, st GROUP BY 1),
b AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50.0::DOUBLE), {R}) AS bin_lo,
       round(CASE WHEN b.bin = 49 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 50.0::DOUBLE) END, {R}) AS bin_hi,
       COALESCE(c.n, 0) AS n
FROM b CROSS JOIN st LEFT JOIN c ON c.bin = b.bin""".replace("\n, rv", ", rv")
SQL["prediction_scatter"] = _with(G, SC) + """SELECT CAST(floor(target_elo / 100) * 100 AS INTEGER) AS target_bin,
       CAST(floor(pred_elo / 100) * 100 AS INTEGER) AS pred_bin, count(*) AS n,
       min(target_elo) AS target_min, max(target_elo) AS target_max,
       min(pred_elo) AS pred_min, max(pred_elo) AS pred_max
FROM se GROUP BY 1, 2"""
SQL["top_positions"] = """WITH att AS (SELECT vec_id AS game_id, list_transform(embedding, lambda x: abs(x)) AS weights FROM embeddings)
SELECT CAST(pos - 1 AS INTEGER) AS position, round(avg(CAST(w AS DOUBLE)), 9) AS score
FROM (SELECT unnest(weights) AS w, unnest(range(1, len(weights) + 1)) AS pos FROM att)
GROUP BY pos ORDER BY avg(CAST(w AS DOUBLE)) DESC, pos LIMIT 10"""
SQL["weighted_mean"] = _with(BL) + """SELECT run, sum(loss * n) / sum(n) AS mean, sum(loss * n) AS total, sum(n) AS weight,
       arg_max(loss, {'s': step, 'o': l_orderkey, 'p': l_partkey, 'q': l_suppkey, 'l': loss, 'n': n}) AS last_val
FROM bl GROUP BY run"""
SQL["running_weighted_mean"] = _with(BL) + """SELECT run, step, l_orderkey, l_partkey, l_suppkey,
  sum(loss * n) OVER w / sum(n) OVER w AS run_avg, sum(n) OVER w AS run_count
FROM bl
WINDOW w AS (PARTITION BY run ORDER BY step, l_orderkey, l_partkey, l_suppkey, loss, n
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
SQL["train_epoch_metrics"] = _with(BL) + """SELECT run, epoch, sum(loss * n) / sum(n) AS loss, sum(mae * n) / sum(n) AS mae,
       sum(n) AS n_samples, count(*) AS n_batches
FROM bl GROUP BY run, epoch"""

SQL["history"] = _with(H) + "SELECT run, epoch, train_loss, train_mae, val_loss, val_mae FROM h"
SQL["running_best"] = _with(H) + """SELECT run, epoch, val_loss, bb AS best_before, (bb IS NULL OR val_loss < bb) AS improved
FROM (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM h)"""
SQL["best_epoch"] = _with(H) + _best("h")
SQL["early_stop_epoch"] = "WITH RECURSIVE " + H + ",\n" + _early_stop_ctes(5, 0.0) + \
    "\nSELECT run, stop_epoch, best_loss, epochs_run FROM st"
SQL["early_stop_min_delta"] = "WITH RECURSIVE " + H + ",\n" + _early_stop_ctes(3, 0.05) + \
    "\nSELECT run, stop_epoch, best_loss, epochs_run FROM st"
SQL["truncate_history"] = "WITH RECURSIVE " + H + ",\n" + _early_stop_ctes(5, 0.0) + """
SELECT h.* FROM h JOIN st USING (run) WHERE st.stop_epoch IS NULL OR h.epoch <= st.stop_epoch"""
SQL["lr_schedule"] = "WITH RECURSIVE " + H + ",\n" + _lr_ctes() + \
    "\nSELECT run, epoch, lr_used AS lr, lr AS next_lr FROM f"
SQL["final_metrics"] = _with(H) + _final("h")
SQL["compare_runs"] = "WITH RECURSIVE " + H + ",\n" + _early_stop_ctes(5, 0.0) + """,
kept AS (SELECT h.* FROM h JOIN st USING (run) WHERE st.stop_epoch IS NULL OR h.epoch <= st.stop_epoch),
fm AS (""" + _final("kept") + """),
be AS (""" + _best("kept") + """)
SELECT fm.*, be.best_epoch, be.best_loss, be.n_checkpoints, st.stop_epoch
FROM fm JOIN be USING (run) JOIN st USING (run)"""

SQL["fit_rating_model"] = _with(G, SC) + """SELECT round(regr_intercept(target, CAST(n_ply AS DOUBLE)), 6) AS intercept,
       round(regr_slope(target, CAST(n_ply AS DOUBLE)), 6) AS slope
FROM sc JOIN g USING (game_id)"""
SQL["validate_model"] = _with(G, SPLIT) + f""", v AS (
  SELECT s.game_id, {NORM.format(e='white_elo')} AS target,
         least(greatest(0.2::DOUBLE + 0.4::DOUBLE * {NORM.format(e='black_elo')}, 0.0::DOUBLE), 1.0::DOUBLE) AS pred,
         s.split_rk // 32 AS batch_id
  FROM s JOIN g USING (game_id) WHERE s.split = 'val'),
ve AS (SELECT *, {DENORM.format(x='target')} AS target_elo, {DENORM.format(x='pred')} AS pred_elo FROM v),
pb AS (SELECT batch_id, avg((target - pred) * (target - pred)) AS m, count(*) AS c FROM v GROUP BY batch_id)
SELECT count(*) AS n,
  round(avg((target - pred) * (target - pred)), {R}) AS mse,
  round(avg(abs(target - pred)), {R}) AS mae,
  round(sqrt(avg((target - pred) * (target - pred))), {R}) AS rmse,
  round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS mae_elo,
  round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS rmse_elo,
  round((SELECT sum(m * c) / sum(c) FROM pb), {R}) AS loss
FROM ve""".replace("\n, v AS", ", v AS")
SQL["roundtrip_splits"] = _with(G, SPLIT) + "SELECT game_id, split, rk, split_rk FROM s WHERE split = 'val'"
SQL["format_log"] = _with(H) + """SELECT run, epoch,
  printf('Epoch %3d | Train MAE: %.6f | Val MAE: %.6f', epoch, train_mae, train_loss) AS value FROM h"""
SQL["read_training_log"] = _with(H) + "SELECT run, epoch, train_mae, train_loss AS val_mae FROM h"
SQL["report_json"] = _with(G, SC) + f""", bands AS (
  SELECT * FROM (VALUES ('Beginner', 800, 1200), ('Intermediate', 1200, 1600),
                        ('Advanced', 1600, 2000), ('Master', 2000, 2800)) t(label, min_elo, max_elo)),
seg AS (
  SELECT label, CAST(min_elo AS VARCHAR) || '-' || CAST(max_elo AS VARCHAR) AS range, count(*) AS "count",
         round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS band_mae,
         round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS band_rmse
  FROM se JOIN bands ON se.target_elo >= bands.min_elo AND se.target_elo < bands.max_elo
  GROUP BY label, min_elo, max_elo),
ov AS (
  SELECT round(avg((target - pred) * (target - pred)), {R}) AS mse,
         round(avg(abs(target - pred)), {R}) AS mae,
         round(sqrt(avg((target - pred) * (target - pred))), {R}) AS rmse,
         round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), {R}) AS r2,
         round(avg(CAST(abs(target_elo - pred_elo) AS DOUBLE)), {R}) AS mae_elo,
         round(sqrt(avg(CAST((target_elo - pred_elo) * (target_elo - pred_elo) AS DOUBLE))), {R}) AS rmse_elo
  FROM se)
SELECT seg.*, ov.* FROM seg CROSS JOIN ov""".replace("\n, bands AS", ", bands AS")
SQL["run_configs"] = _with(H) + """SELECT run, CASE WHEN run % 2 = 0 THEN 'transformer' ELSE 'lstm' END AS model,
  CAST(32 AS BIGINT) AS batch_size, count(*) AS epochs, 0.001::DOUBLE AS lr, 0.1::DOUBLE AS dropout,
  CAST(128 AS BIGINT) AS embedding_dim, CAST(42 AS BIGINT) AS seed, 'cpu' AS device
FROM h GROUP BY run"""
SQL["stream_games"] = SQL["valid_games"]
SQL["stream_weighted_mean"] = _with(BL) + """SELECT run, sum(loss * n) / sum(n) AS mean, sum(loss * n) AS total, sum(n) AS weight
FROM bl GROUP BY run"""
SQL["stream_early_stop"] = "WITH RECURSIVE " + H + ",\n" + _early_stop_ctes(5, 0.0) + \
    "\nSELECT run, stop_epoch, best_loss FROM st WHERE stop_epoch IS NOT NULL"
SQL["roundtrip_games"] = SQL["valid_games"]
SQL["game_features"] = _with(G, P) + f"""SELECT p.game_id, CAST(count(*) AS DOUBLE) AS n_positions,
  CAST(arg_max(length(regexp_replace(split_part(fen, ' ', 1), '[^PNBRQK]', '', 'g')), ply) AS DOUBLE) AS final_white,
  CAST(arg_max(length(regexp_replace(split_part(fen, ' ', 1), '[^pnbrqk]', '', 'g')), ply) AS DOUBLE) AS final_black,
  round(sum(length(regexp_replace(split_part(fen, ' ', 1), '[^pnbrqkPNBRQK]', '', 'g'))) / CAST(count(*) AS DOUBLE), {R}) AS mean_pieces
FROM p GROUP BY p.game_id"""
SQL["dataset_pipeline"] = _with(G, P, BOARD, SEQ, SPLIT) + f"""SELECT s.game_id, s.split, e.epoch,
  CAST((CASE WHEN s.split = 'train'
        THEN row_number() OVER (PARTITION BY s.split, e.epoch ORDER BY
               md5('42:' || CAST(e.epoch AS VARCHAR) || ':' || CAST(s.game_id AS VARCHAR)), s.game_id) - 1
        ELSE s.split_rk END) // 32 AS BIGINT) AS batch_id,
  CAST(least(g.n_ply + 1, 200) AS INTEGER) AS length,
  CAST({NORM.format(e='g.white_elo')} AS FLOAT) AS elo, sq.seq_md5
FROM s JOIN g USING (game_id) JOIN sq USING (game_id), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS epoch) e"""
SQL["archive_scan"] = SQL["valid_games"]
SQL["preprocess_archive"] = _with(LINES, FRAME_CLEAN, PARSED) + """, n AS (SELECT count(*) AS n FROM parsed WHERE parse_status = 'ok')
SELECT * FROM (VALUES ('train'), ('val'), ('test')) t(split), n""".replace("\n, n AS", ", n AS")
SQL["preprocess_archive"] = _with(LINES, FRAME_CLEAN, PARSED) + """, n AS (SELECT count(*) AS n FROM parsed WHERE parse_status = 'ok'),
c AS (SELECT CAST(trunc(n * 0.8::DOUBLE) AS BIGINT) AS tr, CAST(trunc(n * 0.1::DOUBLE) AS BIGINT) AS va, n FROM n)
SELECT 'train' AS split, tr AS n_games FROM c
UNION ALL SELECT 'val', va FROM c
UNION ALL SELECT 'test', n - tr - va FROM c""".replace("\n, n AS", ", n AS")
SQL["stream_games_reference"] = _with(LINES, FRAME_REF, PARSED) + \
    "SELECT game_id, white_elo, black_elo, result, CAST(len(moves) AS INTEGER) AS n_moves FROM parsed WHERE parse_status = 'ok'"

SQL["archive_scan_gzip"] = _with(LINES, FRAME_CLEAN, PARSED) + \
    "SELECT 'orders/' || game_id AS site, white_elo, black_elo, result, CAST(len(moves) AS INTEGER) AS n_moves FROM parsed WHERE parse_status = 'ok'"
SQL["archive_split"] = _with(LINES, FRAME_CLEAN, PARSED, "g AS (SELECT 'orders/' || game_id AS game_id FROM parsed WHERE parse_status = 'ok')",
                             SPLIT) + "SELECT game_id, split, rk, split_rk FROM s"
SQL["movetext_edge_cases"] = f"""SELECT o_orderkey AS game_id, 5 AS n_tags, 'ok' AS parse_status,
  {_list(m for _, m in B.EDGE_MOVETEXTS)}[CAST(o_orderkey % {len(B.EDGE_MOVETEXTS)} AS INTEGER) + 1] AS main_line FROM orders"""

SE32 = f"""f32 AS (
  SELECT game_id, {DENORM.format(x='CAST(CAST(target AS FLOAT) AS DOUBLE)')} AS target_elo,
         {DENORM.format(x='CAST(CAST(pred AS FLOAT) AS DOUBLE)')} AS pred_elo FROM sc)"""
for _name in ("segment_by_elo", "residuals", "prediction_scatter"):
    SQL[f"{_name}_f32"] = SQL[_name].replace(SC, SC + ",\n" + SE32).replace("FROM se", "FROM f32").replace("se.target_elo", "f32.target_elo")

HN = H + """,
hn AS (SELECT * REPLACE (CASE WHEN (run * 7 + epoch) % 5 = 0 THEN 'NaN'::DOUBLE ELSE val_loss END AS val_loss) FROM h)"""
SQL["early_stop_nan"] = "WITH RECURSIVE " + HN + ",\n" + _early_stop_ctes(5, 0.0).replace("FROM h)", "FROM hn)") + \
    "\nSELECT run, stop_epoch, best_loss, epochs_run FROM st"
SQL["stream_early_stop_nan"] = SQL["early_stop_nan"].replace("best_loss, epochs_run FROM st", "best_loss FROM st WHERE stop_epoch IS NOT NULL")
SQL["running_best_nan"] = _with(HN) + """SELECT run, epoch, bb AS best_before,
  (NOT isnan(val_loss) AND val_loss < coalesce(bb, 'Infinity'::DOUBLE)) AS improved
FROM (SELECT *, min(CASE WHEN isnan(val_loss) THEN NULL ELSE val_loss END) OVER (PARTITION BY run ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM hn)"""
SQL["best_epoch_nan"] = _with(HN) + """SELECT run, min(epoch) FILTER (WHERE val_loss = mv) AS best_epoch, min(mv) AS best_loss,
  CAST(sum(CASE WHEN NOT isnan(val_loss) AND (bb IS NULL OR val_loss < bb) THEN 1 ELSE 0 END) AS INTEGER) AS n_checkpoints
FROM (SELECT *, min(num) OVER (PARTITION BY run) AS mv,
             min(num) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb
      FROM (SELECT *, CASE WHEN isnan(val_loss) THEN NULL ELSE val_loss END AS num FROM hn))
GROUP BY run"""
SQL["compare_runs_configs"] = SQL["compare_runs"].replace(
    "SELECT fm.*,", "SELECT CASE WHEN fm.run % 2 = 0 THEN 'transformer' ELSE 'lstm' END AS model, "
    "(SELECT count(*) FROM h WHERE h.run = fm.run) AS epochs, true AS has_time, fm.*,")

_TRAINED = _with(G, SC, SPLIT) + """, t AS (
  SELECT s.split, sc.target, CAST(g.n_ply AS DOUBLE) AS x FROM s JOIN sc USING (game_id) JOIN g USING (game_id)),
c AS (SELECT regr_slope(target, x) AS b, regr_intercept(target, x) AS a FROM t WHERE split = 'train'),
p AS (SELECT split, target, least(greatest(a + b * x, 0.0::DOUBLE), 1.0::DOUBLE) AS pred FROM t, c WHERE split <> 'train'),
e AS (SELECT split, count(*) AS n, round(avg((target - pred) * (target - pred)), 6) AS mse, round(avg(abs(target - pred)), 6) AS mae,
             round(sqrt(avg((target - pred) * (target - pred))), 6) AS rmse,
             round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), 6) AS r2
      FROM p GROUP BY split)
"""
SQL["train_evaluate"] = _TRAINED + "SELECT * FROM e"
SQL["model_roundtrip"] = _TRAINED + """SELECT CAST(1 AS INTEGER) AS epoch, (SELECT mse FROM e WHERE split = 'val') AS best_val_loss,
  n, mse, mae FROM e WHERE split = 'test'"""

# a position's score in 1/1024, for the validation split's first 200 positions
_SCORED = _with(G, P, BOARD, SPLIT) + f""", ps AS (
  SELECT g.game_id, pf.ply, CAST(CASE WHEN pf.valid THEN coalesce(list_sum(list_transform(pf.onehot_idx, lambda i: (i * 37) % 101 - 50)), 0) ELSE 0 END AS BIGINT) AS q
  FROM s JOIN g USING (game_id) JOIN pf USING (game_id) WHERE s.split = 'val' AND pf.ply < 200),
sg AS (
  SELECT game_id, CAST(count(*) AS INTEGER) AS length, sum(q) / 1024.0::DOUBLE AS total, sum(abs(q)) / 1024.0::DOUBLE AS weight_sum FROM ps GROUP BY game_id)
""".replace("\n, ps AS", ", ps AS")
SQL["score_sequences"] = _SCORED + f"""SELECT sg.game_id, length, round(least(greatest(0.5::DOUBLE + total / length, 0.0::DOUBLE), 1.0::DOUBLE), {R}) AS pred,
  round(CAST(CAST({NORM.format(e='g.white_elo')} AS FLOAT) AS DOUBLE), {R}) AS target, CAST(200 AS INTEGER) AS n_weights, weight_sum
FROM sg JOIN g USING (game_id)"""
SQL["sequence_top_positions"] = _SCORED + f"""SELECT ply AS position, round(sum(abs(q)) / 1024.0::DOUBLE / (SELECT count(*) FROM sg), {R}) AS score
FROM ps GROUP BY ply ORDER BY sum(abs(q)) DESC, ply LIMIT 10"""


def _training_ctes(epochs: int, rounds: int, lr: float) -> str:
    """Rounds of gradient steps, unrolled: weights w0 (bias) to w5 after each, the batches before it, metrics after an epoch."""
    xs = [f"x{j}" for j in range(1, 6)]
    out = [LINES, FRAME_CLEAN, PARSED, f"""g AS (
  SELECT game_id, {NORM.format(e='white_elo')} AS y, len(moves) / 64.0::DOUBLE AS x1,
    len(list_filter(moves, lambda t: contains(t, 'x'))) / 16.0::DOUBLE AS x2,
    (len(list_filter(moves, lambda t: contains(t, '+'))) + len(list_filter(moves, lambda t: contains(t, '#')))) / 8.0::DOUBLE AS x3,
    len(list_filter(moves, lambda t: contains(t, 'O-O'))) / 2.0::DOUBLE AS x4,
    len(list_filter(moves, lambda t: contains(t, '='))) / 2.0::DOUBLE AS x5
  FROM parsed WHERE parse_status = 'ok')""", SPLIT, "t AS MATERIALIZED (SELECT * FROM s JOIN g USING (game_id))",
           "w_0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS w{j}" for j in range(6)) + ")"]
    value = "w0 + " + " + ".join(f"w{j} * x{j}" for j in range(1, 6))
    step = 0
    for e in range(epochs):
        out.append(f"""b_{e} AS MATERIALIZED (
  SELECT *, (row_number() OVER (ORDER BY md5('42:{e}:' || CAST(game_id AS VARCHAR)), game_id) - 1) // 32 AS batch_id FROM t WHERE split = 'train')""")
        for r in range(rounds):
            out.append(f"""e_{step} AS MATERIALIZED (
  SELECT batch_id, {', '.join(xs)}, {value} - y AS err FROM b_{e}, w_{step} WHERE batch_id % {rounds} = {r})""")
            grads = ["sum(err)"] + [f"sum(err * {x})" for x in xs]
            out.append(f"""w_{step + 1} AS MATERIALIZED (SELECT """ + ", ".join(
                f"any_value(w{j}) - {lr!r}::DOUBLE * (2.0::DOUBLE * {g} / count(*)) AS w{j}" for j, g in enumerate(grads)) + f" FROM e_{step}, w_{step})")
            step += 1
        errs = " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS round, batch_id, err FROM e_{step - rounds + r}" for r in range(rounds))
        out.append(f"""l_{e} AS MATERIALIZED (
  SELECT CAST({e} AS INTEGER) AS epoch, round, batch_id AS step, avg(err * err) AS loss, avg(abs(err)) AS mae, count(*) AS n FROM ({errs}) GROUP BY round, batch_id)""")
        out.append(f"""v_{e} AS MATERIALIZED (
  SELECT split, y, least(greatest({value}, 0.0::DOUBLE), 1.0::DOUBLE) AS pred FROM t, w_{step} WHERE split <> 'train')""")
    out.append("hist AS MATERIALIZED (" + " UNION ALL ".join(f"""SELECT CAST({e} AS INTEGER) AS epoch,
  (SELECT sum(loss * n) / sum(n) FROM l_{e}) AS train_loss, (SELECT sum(mae * n) / sum(n) FROM l_{e}) AS train_mae,
  avg((y - pred) * (y - pred)) AS val_loss, avg(abs(y - pred)) AS val_mae, {lr!r}::DOUBLE AS lr FROM v_{e} WHERE split = 'val'""" for e in range(epochs)) + ")")
    out.append("im AS (SELECT *, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Infinity'::DOUBLE) AS improved FROM hist)")
    return _with(*out)


SQL["train_epochs"] = _training_ctes(3, 2, 0.5) + f"""SELECT epoch, round(train_loss, {R}) AS train_loss, round(train_mae, {R}) AS train_mae,
  round(val_loss, {R}) AS val_loss, round(val_mae, {R}) AS val_mae, lr, improved FROM im"""
SQL["train_batch_log"] = _training_ctes(3, 2, 0.5) + " UNION ALL ".join(
    f"SELECT epoch, round, step, round(loss, {R}) AS loss, round(mae, {R}) AS mae, n FROM l_{e}" for e in range(3))
SQL["train_best_checkpoint"] = _training_ctes(3, 2, 0.5) + f"""SELECT b.epoch, count(*) AS n, round(avg((y - pred) * (y - pred)), {R}) AS mse, round(avg(abs(y - pred)), {R}) AS mae
FROM (SELECT max(epoch) AS epoch FROM im WHERE improved) b JOIN ({' UNION ALL '.join(f"SELECT {e} AS epoch, * FROM v_{e}" for e in range(3))}) v USING (epoch)
WHERE split = 'test' GROUP BY b.epoch"""
SQL["token_features"] = _with(LINES, FRAME_CLEAN, PARSED) + """SELECT game_id, parse_status, CAST(len(moves) AS DOUBLE) AS n_moves,
  CAST(len(list_filter(moves, lambda t: contains(t, 'x'))) AS DOUBLE) AS captures,
  CAST(len(list_filter(moves, lambda t: contains(t, '+'))) + len(list_filter(moves, lambda t: contains(t, '#'))) AS DOUBLE) AS checks,
  CAST(len(list_filter(moves, lambda t: contains(t, 'O-O'))) AS DOUBLE) AS castles,
  CAST(len(list_filter(moves, lambda t: contains(t, '='))) AS DOUBLE) AS promotions FROM parsed"""

SQL["reject_counts_utf8"] = _with(LINES, FRAME_CLEAN, PARSED) + """SELECT CASE WHEN game_id % 29 = 0 THEN 'bad_utf8' ELSE parse_status END AS parse_status,
  count(*) AS n_games FROM parsed GROUP BY ALL"""
SQL["archive_python_lines"] = SQL["archive_scan_gzip"]
SQL["append_log_once"] = SQL["read_training_log"]
SQL["run_configs_once"] = SQL["run_configs"]
SQL["stream_early_stop_restart"] = SQL["stream_early_stop"]
SQL["ingest_stats"] = _with(LINES, FRAME_CLEAN, PARSED) + """SELECT parse_status, count(*) AS n_games FROM parsed GROUP BY parse_status
UNION ALL SELECT 'written', count(*) FROM parsed WHERE parse_status = 'ok'"""
