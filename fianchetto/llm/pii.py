"""Personal data by candidate generators and gradient-boosted trees, with built-in DataFrame functions and Spark ML only.

High-recall patterns propose spans, overlapping or not.  Each candidate is described by a few small numbers (its format
and its surroundings), which together are its cell.  Boosted trees learn, from all texts, how likely a candidate of a cell
is personal data; per kind, a threshold calibrated on held-out documents selects further spans.  As there are only so many
cells, the trees learn from counts by cell, and the selection is a bounded list of cells that is applied row by row: no
join and no shuffle of texts.

Labels do not come from whether the strict patterns confirm a candidate, which no further span can be: the examples for
are strict spans masked as the generators would find them (a number without its country code, an address spelt out), those
against are candidates of a false format, inside a strict span of another kind, or after words that tell of something
else.  All other candidates have no label and count for nothing but being selected.
"""

from __future__ import annotations

import dataclasses
from functools import reduce
from itertools import groupby

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import fold, materialize

KINDS = ["email", "ip", "card", "phone"]

# The strict patterns, leftmost and non-overlapping. Possessive, and begun only where a run of their
# characters begins (or the match before ends), they find the same spans in time linear in the text.
STRICT = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: The generators: spelt-out or spaced mail addresses, spaced or bracketed and longer IP addresses, any long row of
#: digits, telephone numbers without a country code.
WIDE = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]at[)\]}])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{2,63}+){1,8}+",
    r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|[(\[]\.[)\]])\x20?[0-9]{1,3}+){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}+(?![0-9])",
    r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])",
]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_KEYWORDS = [r"mail|contact|write|reach", r"\bip\b|host|addr|server", r"card|visa|master|credit|pay|konto|tarjeta|carte",
             r"tel|phone|call|fax|mobil|cell|whatsapp|sms"]
_OTHERWISE = r"version|release|licen[cs]e|isbn|token|key|id\s*[=:#]|\bv$"
#: Characters before a candidate that are looked at.
CONTEXT = 24
#: Numbers that make up a cell, each below its bound.
CELL = {"kind": 4, "strict": 2, "valid": 2, "digits": 21, "separators": 5, "left": 4, "right": 4, "words": 3, "length": 12, "varied": 2}
SPAN = "array<struct<kind:int,start:int,end:int,cell:long,sure:boolean>>"
#: Share of labelled candidates in held-out documents that must be personal data at every score from the threshold up.
PRECISION = 0.95
#: Held-out candidates that the trees' own word on a score counts for, however many there are.
PRIOR = 20


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, r"[^0-9]", ""))


def _luhn(hit: Column) -> Column:
    backwards = F.reverse(F.translate(hit, " -", ""))

    def add(total, i):
        d = F.substr(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def confirmed(kind: int, hit: Column) -> Column:
    """Whether a strict match passes its kind's test."""
    if kind == 1:
        return hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == 2:
        return F.when(F.length(F.translate(hit, " -", "")).between(13, 19), _luhn(hit)).otherwise(False)
    if kind == 3:
        return _digits(hit).between(9, 15)
    return F.lit(True)


def _valid(kind: int, hit: Column) -> Column:
    """Whether a match of a generator has a format that its kind can have."""
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    if kind == 1:
        return hit.contains(":") | confirmed(1, F.regexp_replace(hit, r"[^0-9.]", ""))
    if kind == 2:
        return confirmed(2, digits)
    if kind == 3:
        return (F.replace(digits, F.left(digits, F.lit(1)), F.lit("")) != "") & ~hit.rlike(r"^(?:(?:19|20)[0-9]{2}[\x20./-]?)+$")
    return hit.rlike(r"[A-Za-z]$")


def _masked(kind: int, hit: Column, turn: Column) -> Column:
    """A strict span as a generator would find it, in one of the forms that generators know, by ``turn``; null if none
    would."""
    if kind == 3:
        form = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]?", "")
    else:
        if kind == 0:
            name, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
            forms = [F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ((" (at) ", " (dot) "), ("[at]", "."), (" @ ", " . "))]
        elif kind == 1:
            forms = [F.replace(hit, F.lit("."), F.lit(dot)) for dot in ("[.]", " . ", "(.)")]
        else:
            forms = [F.regexp_replace(F.translate(hit, " -", ""), r"([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in (".", "/", "_")]
        form = F.get(F.array(*forms), F.pmod(turn, F.lit(len(forms))))
    return F.when(form.rlike(f"^(?:{WIDE[kind]})$"), form)


def _side(char: Column) -> Column:
    """Class of a neighbouring character: none or blank, letter, digit, other."""
    return (F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2).otherwise(3))


def _cell(kind: int, strict: bool, valid: Column, hit: Column, before: Column, after: Column) -> Column:
    """The candidate's cell as one number; every part of it is a small integer (see CELL)."""
    words, digits = F.lower(before), F.regexp_replace(hit, r"[^0-9]", "")
    parts = {
        "kind": F.lit(kind), "strict": F.lit(int(strict)), "valid": valid.cast("int"), "digits": F.least(F.length(digits), F.lit(20)),
        "separators": F.least(F.length(F.regexp_replace(hit, r"[^\x20().\[\]{}/_:-]", "")), F.lit(4)),
        "left": _side(F.right(before, F.lit(1))), "right": _side(F.left(after, F.lit(1))),
        "words": F.when(words.rlike(_OTHERWISE), 2).when(words.rlike(_KEYWORDS[kind]), 1).otherwise(0),
        "length": F.least((F.length(hit) / 4).cast("int"), F.lit(11)),
        "varied": F.when(F.replace(digits, F.left(digits, F.lit(1)), F.lit("")) == "", 0).otherwise(1) if kind in (2, 3) else F.lit(1),
    }
    return reduce(lambda code, name: code * CELL[name] + parts[name].cast("long"), CELL, F.lit(0).cast("long"))


def _spans(kind: int, strict: bool, hits: Column, pieces: Column) -> Column:
    """Spans of a pattern from its matches and the pieces of text between them: places are sums of lengths.

    ``sure`` is true for strict spans that pass their tests (their cell is that of their masked form, null if they have
    none), false for candidates of a false format or after words that tell of something else, else null.
    """
    each = F.transform(hits, lambda h, i: F.struct(
        h.alias("hit"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after"),
        (confirmed(kind, h) if strict else _valid(kind, h)).alias("good"),
        *([_masked(kind, h, i + F.length(F.get(pieces, i))).alias("masked")] if strict else [])))

    def put(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["hit"])
        near = F.right(x["before"], F.lit(CONTEXT))
        if strict:
            masked = F.when(x["masked"].isNotNull(), _cell(kind, False, _valid(kind, x["masked"]), x["masked"], near, x["after"]))
            cell, sure = F.when(x["good"], masked).otherwise(_cell(kind, True, F.lit(False), x["hit"], near, x["after"])), x["good"]
        else:
            cell, sure = _cell(kind, False, x["good"], x["hit"], near, x["after"]), F.when(~x["good"] | F.lower(near).rlike(_OTHERWISE), False)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), cell.alias("cell"), sure.alias("sure"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), SPAN).alias("out"))
    return F.aggregate(each, none, put, lambda acc: acc["out"])


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (strict spans that pass their tests, by kind and start) and ``_more`` (all other
    candidates; ``sure`` is false where something tells against them, else null)."""
    none = F.from_json(F.lit("[]"), SPAN)
    patterns = [(k, strict, rx) for strict, all_ in ((True, STRICT), (False, WIDE)) for k, rx in enumerate(all_)]
    body = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in docs.columns]
    out = docs.select("*", *[F.regexp_extract_all(body, F.lit(rx), F.lit(0)).alias(f"_hits{i}") for i, (_, _, rx) in enumerate(patterns)])
    out = out.select(*names, *[f"_hits{i}" for i in range(len(patterns))],
                     *[F.when(F.size(f"_hits{i}") > 0, F.split(body, rx, -1)).alias(f"_pieces{i}") for i, (_, _, rx) in enumerate(patterns)])
    out = out.select(*names, *[F.when(F.size(f"_hits{i}") > 0, _spans(k, strict, F.col(f"_hits{i}"), F.col(f"_pieces{i}"))).otherwise(none).alias(f"_spans{i}")
                               for i, (k, strict, _) in enumerate(patterns)])
    every = F.concat(*[f"_spans{i}" for i in range(4)])
    out = out.select(*names, *[f"_spans{i}" for i in range(4, 8)], F.filter(every, lambda s: s["sure"]).alias("_base"),
                     F.filter(every, lambda s: ~s["sure"]).alias("_failed"))
    wide = F.concat("_failed", *[f"_spans{i}" for i in range(4, 8)])
    own = lambda s: F.exists("_base", lambda b: (b["kind"] == s["kind"]) & _touches(b, s))
    other = lambda s: F.exists("_base", lambda b: (b["kind"] != s["kind"]) & _touches(b, s))
    marked = F.transform(wide, lambda s: s.withField("sure", F.when(own(s), F.lit(None)).when(other(s), False).otherwise(s["sure"])))
    return out.select(*names, "_base", marked.alias("_more"))


def _unpacked(cells: DataFrame) -> DataFrame:
    """The small integers that a cell is made of, as columns."""
    code, columns = F.col("cell"), {}
    for name in reversed(CELL):
        columns[name] = (code % CELL[name]).cast("double")
        code = F.floor(code / CELL[name])
    return cells.withColumns(columns)


@dataclasses.dataclass(frozen=True)
class PiiModel:
    """The cells whose candidates become spans, and each kind's threshold (None: no score reaches the precision)."""

    cells: tuple[int, ...]
    thresholds: dict[str, float | None]


def least_score(scores: list[tuple[float, float, float]], precision: float) -> float | None:
    """The least score from which on every score's candidates reach the precision, of (score, right, wrong) in falling
    order; neighbours whose shares rise as the score falls are taken together. None if the best one does not reach it."""
    blocks: list[list[float]] = []
    for p, right, wrong in scores:
        blocks.append([p, right, right + wrong])
        while len(blocks) > 1 and (blocks[-2][2] == 0 or blocks[-1][1] * blocks[-2][2] >= blocks[-2][1] * blocks[-1][2]):
            p, right, all_ = blocks.pop()
            blocks[-1] = [p, blocks[-1][1] + right, blocks[-1][2] + all_]
    reached = [p for p, right, all_ in blocks if all_ and right >= precision * all_]
    return reached[-1] if reached else None


def fit_pii(candidates: DataFrame, precision: float = PRECISION, trees: int = 20, depth: int = 4) -> PiiModel:
    """Learn from ``doc_id, _base, _more`` of all documents which cells to select.

    Labelled candidates of every document count, summed by cell; documents of fold 0 (crc32(doc_id as text) mod 5) set the
    thresholds, the others train the trees, where each kind weighs the same.  Base spans themselves are in neither, only
    their masked forms.  Small and large inputs go the same way: one example for and one against, spread like a kind's
    labelled candidates (evenly if it has none), join those that were seen, and a score's share rests on the trees' word
    as PRIOR candidates besides the held-out ones.  Only counts by cell, at most as many as there are cells, leave the
    tasks.
    """
    each = candidates.select((fold(F.col("doc_id")) == 0).alias("held"), F.explode(F.concat("_base", "_more")).alias("s")).where("s.cell IS NOT NULL")
    counts = each.groupBy("s.cell").agg(
        *[F.count_if((F.col("held") == h) & (F.col("s.sure") == s)).cast("double").alias(n)
          for n, h, s in (("held_yes", True, True), ("held_no", True, False), ("yes", False, True), ("no", False, False))])
    cells = materialize(_unpacked(counts), "pii-cells")
    of_kind = {r.kind: (r.n, r.weight) for r in cells.groupBy("kind").agg(F.count("cell").alias("n"), F.sum(F.col("yes") + F.col("no")).alias("weight")).collect()}
    if not of_kind:
        return PiiModel((), dict.fromkeys(KINDS))
    assembled = VectorAssembler(inputCols=list(CELL), outputCol="features").transform(cells)
    share, part = (reduce(lambda rest, k: F.when(F.col("kind") == k, of(*of_kind[k])).otherwise(rest), of_kind, F.lit(0.0))  # noqa: B023
                   for of in (lambda n, weight: 1 / (weight + 2), lambda n, weight: (F.col("yes") + F.col("no")) / weight if weight else 1 / n))
    sides = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), ((F.col(c) + part) * share).alias("weight")) for y, c in ((1.0, "yes"), (0.0, "no"))]))
    train = assembled.select("features", sides.alias("x")).select("features", "x.label", "x.weight").where("weight > 0")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, weightCol="weight", seed=42, cacheNodeIds=False).fit(train.coalesce(1))
    scored = model.transform(assembled).select("cell", F.col("kind").cast("int").alias("kind"), "held_yes", "held_no",
                                               vector_to_array("probability")[1].alias("p")).collect()  # one small row a cell
    chosen: list[int] = []
    thresholds: dict[str, float | None] = {}
    for k, name in enumerate(KINDS):
        own = sorted((r for r in scored if r.kind == k), key=lambda r: -r.p)
        scores = [(p, *map(sum, zip(*((r.held_yes, r.held_no) for r in rows)))) for p, rows in groupby(own, key=lambda r: r.p)]
        best = least_score([(p, yes + PRIOR * p, no + PRIOR * (1 - p)) for p, yes, no in scores], precision)
        thresholds[name] = best
        chosen += [r.cell for r in own if best is not None and r.p >= best]
    return PiiModel(tuple(sorted(chosen)), thresholds)


def selected_spans(model: PiiModel) -> Column:
    """Base spans and the further spans that the model selects, by kind and start: of candidates in selected cells, those
    that touch no base span and no chosen candidate before them (the earlier start first, then the longer)."""
    none = F.from_json(F.lit("[]"), SPAN)
    if not model.cells:
        extra = none
    else:
        cells = F.from_json(F.lit(str(list(model.cells))), "array<bigint>")
        free = F.filter("_more", lambda s: F.array_contains(cells, s["cell"]) & ~F.exists("_base", lambda b: _touches(b, s)))
        order = F.array_sort(free, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                             .when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["kind"] - b["kind"]))
        keep = lambda kept, s: F.when(F.exists(kept, lambda b: _touches(b, s)), kept).otherwise(F.concat(kept, F.array(s)))
        extra = F.when(F.size(free) > 0, F.aggregate(order, none, keep)).otherwise(none)
    return F.array_sort(F.concat("_base", extra), lambda a, b: F.when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["start"] - b["start"]))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and further ones) of every text.

    Places are code points, ends exclusive.  Texts are read whole; null counts as empty and, like a text without personal
    data, gives zeros, the SHA-256 of nothing and an empty string.  Repeated rows and null doc_ids stay.  Other columns
    are not read.
    """
    found = materialize(with_candidates(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "_base", "_more"), "pii-candidates")
    model = fit_pii(found)
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(selected_spans(model)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, ``[email]``; n_chars, if there, follows.

    Of overlapping spans of different kinds, the union is replaced, under the kind of the one that starts first.  A null
    text stays null.  Columns and their order stay.
    """
    names = docs.columns
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))  # other columns may bear any name
    model = fit_pii(with_candidates(packed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text")))
    by_start = F.array_sort(selected_spans(model), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                            .when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["kind"] - b["kind"]))
    found = with_candidates(packed).select("row", "text", by_start.alias("spans"))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    body = F.col("text")

    def put(acc, s):
        own = s["start"] >= acc["at"]  # else it overlaps the one before: its rest goes, too
        between = F.when(own, F.substr(body, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        mark = F.when(own, F.get(kinds, s["kind"])).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.concat(between, mark))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<string>").alias("out"))
    whole = F.aggregate("spans", start, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1, F.length(body))))
    done = found.select("row", F.when(F.size("spans") > 0, whole).otherwise(body).alias("text"))
    new = {text: F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])
