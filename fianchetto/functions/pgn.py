"""PGN text scalars (P1, P3, F5): header map, movetext, SAN tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


# A tag line [Name "value"], matched line by line inside the header block; the value
# runs to the last quote before "]" and whitespace never crosses a line end.
TAG_LINES = r'(?m)^\[([A-Za-z0-9][A-Za-z0-9_+#=:-]*)[^\S\n]+"(.*)"\][^\S\n]*$'
# Removed in one left-to-right pass: {comments}, ;line comments, $NAGs, move numbers.
# Text inside a comment is consumed with it because the leftmost match wins.
NOISE = r"\{[^}]*\}|;[^\n]*|\$\d+|\d+\.+"
# Leading blank space and the consecutive header lines that follow it.
HEADER_PREFIX = r"^\s*((?:\[[^\n]*(?:\n|$))*)"
# Comments, which may run over line ends and blank lines.
COMMENTS = r"\{[^}]*\}|;[^\n]*"
# A line that begins with % is an escape: readers skip it.
ESCAPE_LINES = r"(?m)^%[^\n]*(?:\n|$)"
# Lines up to (not including) the first blank line or the next header line.
MOVETEXT_LINES = r"^((?:[^\[\n][^\n]*(?:\n|$))*)"
# The white space of "\s" besides the blank.
OTHER_SPACE = r"[\t\n\x0b\f\r]"
RESULT_TOKENS = ["1-0", "0-1", "1/2-1/2", "*"]


def is_blank(line) -> Column:
    """What ``^\\s*$`` finds, a last line separator after the blank space included, without a pattern."""
    return F.ltrim(_col(line), F.lit(" \t\n\x0b\f\r")).isin("", "\x85", "\u2028", "\u2029")


def has_moves(line) -> Column:
    """The framing test: stripped line starts with "1. ", or line contains " 1. "."""
    return F.contains(_col(line), F.lit("1. ")) & _col(line).rlike(r"^\s*1\. .*\S| 1\. ")


def without_escapes(text) -> Column:
    t = _col(text)
    return F.when(F.contains(t, F.lit("%")), F.regexp_replace(t, ESCAPE_LINES, "")).otherwise(t)


def header_block(text) -> Column:
    return F.regexp_extract(without_escapes(text), HEADER_PREFIX, 1)


def header_tags(text) -> Column:
    """ARRAY<STRUCT<k,v>> of the tag lines of the first header block, in order."""
    return bound(header_block(text), lambda hb: F.arrays_zip(F.regexp_extract_all(hb, F.lit(TAG_LINES), F.lit(1)).alias("k"),
                                                             F.regexp_extract_all(hb, F.lit(TAG_LINES), F.lit(2)).alias("v")))


def tags_to_map(tags) -> Column:
    """MAP<STRING,STRING> from tag entries; a repeated tag keeps its last value
    (independent of the session's map-key dedup policy)."""
    def last(x):
        keys, t = x["keys"], x["tags"]
        return F.map_from_entries(F.filter(t, lambda e, i: F.array_position(keys, e["k"]) == F.size(t) - i))

    def once(t):
        repeated = bound(F.struct(F.reverse(t["k"]).alias("keys"), t.alias("tags")), last)
        return F.when(F.size(F.array_distinct(t["k"])) == F.size(t), F.map_from_entries(t)).otherwise(repeated)

    return bound(_col(tags), once)


def header_map(text) -> Column:
    """MAP<STRING,STRING> of the first header block; a repeated tag keeps its last value."""
    return tags_to_map(header_tags(text))


def header_value(text_or_map, name: str) -> Column:
    return _col(text_or_map).getItem(name)


def movetext(text) -> Column:
    """Movetext of the first game in the record: after its headers and blank lines,
    without comments, up to the next blank line or header line."""
    body = F.regexp_replace(without_escapes(text), r"^\s*(?:\[[^\n]*(?:\n|$))*\s*", "")
    plain = bound(body, lambda b: F.when(F.contains(b, F.lit("{")) | F.contains(b, F.lit(";")), F.regexp_replace(b, COMMENTS, " ")).otherwise(b))
    return F.regexp_extract(plain, MOVETEXT_LINES, 1)


def movetext_tokens(mt) -> Column:
    """Mainline SAN tokens: comments, variations of any depth, NAGs, move numbers,
    annotation suffixes and the result token removed.  A closing bracket without an
    opening one is ignored; an open variation runs to the end."""
    return bound(F.regexp_replace(_col(mt), NOISE, " "), _mainline)


def _mainline(s: Column) -> Column:
    # parted at single blanks, which takes no pattern: the empty tokens of runs of blanks are dropped with the others
    flat = F.split(F.when(s.rlike(OTHER_SPACE), F.regexp_replace(s, OTHER_SPACE, " ")).otherwise(s), " ")
    # a running bracket depth over the tokens keeps those at depth 0
    marked = F.split(F.regexp_replace(s, r"([()])", " $1 "), r"\s+")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("main"))

    def step(acc, t):
        depth = F.when(t == "(", acc["depth"] + 1).when(t == ")", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        main = F.when((acc["depth"] == 0) & ~t.isin("(", ")"), F.array_append(acc["main"], t)).otherwise(acc["main"])
        return F.struct(depth.alias("depth"), main.alias("main"))

    def plain(t):
        marked = F.contains(t, F.lit("?")) | F.contains(t, F.lit("!"))
        return F.when(marked, F.regexp_replace(t, r"[?!]+$", "")).otherwise(t)

    toks = F.when(F.contains(s, F.lit("(")) | F.contains(s, F.lit(")")), F.aggregate(marked, start, step)["main"]).otherwise(flat)
    for dropped in ("", *RESULT_TOKENS):
        toks = F.array_remove(toks, dropped)
    annotated = F.contains(s, F.lit("?")) | F.contains(s, F.lit("!"))
    return F.when(annotated, F.array_remove(F.transform(toks, plain), "")).otherwise(toks)
