"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import let

_DIGITS = "0123456789"
#: A possible start: not inside a run of the class, or right behind the match before. Finds the same leftmost matches
#: as a start at any place would, in linear time.
_EDGE = r"(?:(?<![{0}])|\G)"
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. All quantifiers in pattern are possessive or end in one fixed class: no deep backtracking.

    needs: a string (or a class of characters, in brackets) without which a text has no match. score: of a confirmed
    span; context: words that add BOOST if they stand before it; own: whether the span stays whatever the score. group: the
    group of pattern that is proposed; group 1 lies in a lookahead, so that a proposal may reach over the start of the next.
    """

    name: str
    pattern: str
    needs: str
    score: float
    context: str
    own: bool
    group: int = 0


#: The first four kinds and their patterns and limits are the base of the operator's contract.
KINDS = (
    Kind("email", _EDGE.format(_LOCAL) + f"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write", True),
    Kind("ip", _EDGE.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}", "[0-9]", 0.7, r"\bip\b|address|host|server|from", True),
    Kind("card", "[0-9](?:[ -]?[0-9])++", "[0-9]", 0.8, "card|visa|master|amex|credit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+(?![A-Za-z0-9])|(?: [A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?: [A-Z0-9]{1,3}(?![A-Za-z0-9]))?)))[A-Z]{2}[0-9]{2}", "[0-9]", 0.8, "iban|account|bank|konto|compte|cuenta", False, 1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security", False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+", "[0-9]", 0.3, "token|secret|password|passwd|api.?key|access.?key|credential", False),
)
BOOST, LEAST, CONTEXT_CHARS = 0.4, 0.6, 40
#: What may stand between two items of a list: no letter or digit but one conjunction.
_LIST = r"(?i)^[^\p{L}\p{N}]*+(?:(?:and|or|und|oder|et|ou|y|o|e)[^\p{L}\p{N}]+)?$"
#: So many matches of the kinds that need context words (each of 11 characters at least) cover CONTEXT_CHARS.
_AROUND = 4
_CHUNK = 256


def _running(values: Column, combine) -> Column:
    """The values before each element, combined, from 0; in chunks, so that a long array costs little more than its length."""
    zero = F.lit(0).cast("long")

    def before(part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(zero), lambda s, x: F.concat(s, F.array(combine(F.element_at(s, -1), x)))), F.lit(1), F.size(part))

    def of(chunks: Column) -> Column:
        wholes = F.transform(chunks, lambda part: F.aggregate(part, zero, combine))
        return F.flatten(F.zip_with(F.transform(chunks, before), before(wholes), lambda part, more: F.transform(part, lambda x: combine(x, more))))

    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(cut, of))


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without blanks: the first four characters go last, A-Z count 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5), F.char_length(iban)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _confirmed(kind: Kind, found: Column) -> Column:
    digits = F.char_length(found) - F.char_length(F.translate(found, _DIGITS, ""))
    if kind.name == "ip":  # four parts of at most 255
        return found.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind.name == "card":
        return F.when(digits.between(13, 19), F.call_function("luhn_check", F.translate(found, " -", ""))).otherwise(False)
    if kind.name == "phone":
        return digits.between(9, 15)
    if kind.name == "secret":
        return (digits >= 4) & (digits < F.char_length(found))
    return F.lit(True)


def _not_inside(found: Column) -> Column:
    """The spans that no earlier one covers."""
    reach = let(F.transform(found, lambda s: s["end"]), lambda v: _running(v, lambda a, b: F.greatest(a, b)))
    return F.transform(F.filter(F.arrays_zip(found.alias("s"), reach.alias("r")), lambda x: x["s"]["end"] > x["r"]), lambda x: x["s"])


def _iban_length(found: Column) -> Column:
    """Characters of the longest run of whole groups from the start that is an IBAN; null if none is."""

    def longest(groups: Column) -> Column:
        counts = F.sequence(F.size(groups), F.least(F.size(groups), F.lit(3)), F.lit(-1))
        good = F.filter(counts, lambda n: let(F.array_join(F.slice(groups, F.lit(1), n), ""), lambda x: F.when(F.char_length(x).between(15, 34), _mod97(x) == 1).otherwise(False)))
        return let(good, lambda g: F.char_length(F.array_join(F.slice(groups, F.lit(1), F.get(g, F.lit(0))), " ")))

    return let(F.split(found, " "), longest)


def _near(kind: Kind, gaps: Column, found: Column) -> Column:
    """For each match: whether a context word is in the CONTEXT_CHARS of text before or after it, or before or after
    an earlier match from which only list separators part it and those between."""
    width = F.lit(CONTEXT_CHARS)
    head, tail = lambda i: F.left(F.get(gaps, i), width), lambda i: F.right(F.get(gaps, i), width)
    before = F.transform(found, lambda m, i: F.concat(tail(i), F.right(m, width)))
    after = F.transform(found, lambda m, i: F.concat(F.left(m, width), head(i + 1)))

    def own(b: Column, a: Column) -> Column:
        def one(_, i: Column) -> Column:
            left = F.concat(F.array_join(F.slice(b, F.greatest(i - _AROUND, F.lit(0)) + 1, F.least(i, F.lit(_AROUND))), ""), tail(i))
            right = F.concat(head(i + 1), F.array_join(F.slice(a, i + 2, F.lit(_AROUND)), ""))
            hit = F.lower(F.right(left, width)).rlike(kind.context) | F.lower(F.left(right, width)).rlike(kind.context)
            return F.struct(F.when(hit, i + 1).otherwise(0).cast("long").alias("word"), F.when((i > 0) & F.get(gaps, i).rlike(_LIST), 0).otherwise(i + 1).cast("long").alias("begin"))

        return F.transform(found, one)

    def so_far(marks: Column, name: str) -> Column:
        return let(F.transform(marks, lambda x: x[name]), lambda v: F.zip_with(v, _running(v, lambda a, b: F.greatest(a, b)), lambda x, y: F.greatest(x, y)))

    marks = let(before, lambda b: let(after, lambda a: own(b, a)))
    return let(marks, lambda x: F.zip_with(so_far(x, "word"), so_far(x, "begin"), lambda w, b: w >= b))


def _proposals(kind: Kind, text: Column, around: bool) -> Column:
    """An array of the confirmed spans of a kind: kind, start, end (code points, end exclusive), score, base."""
    around = around and kind.score < LEAST

    def spans(found: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda gaps: let(_near(kind, gaps, found) if around else F.lit(None), lambda near: of(found, gaps, near)))

    def of(found: Column, gaps: Column, near: Column) -> Column:
        def pair(g: Column, m: Column, i: Column) -> Column:
            return F.struct(
                F.char_length(g).cast("long").alias("gap"),
                (F.lit(4) if kind.group else F.char_length(m)).cast("long").alias("len"),
                (_iban_length(m) if kind.group else F.when(_confirmed(kind, m), F.char_length(m))).cast("long").alias("take"),
                (F.get(near, i) if around else F.lower(F.right(g, F.lit(CONTEXT_CHARS))).rlike(kind.context)).alias("near"),
            )

        pairs = F.transform(found, lambda m, i: let(F.get(gaps, i), lambda g: pair(g, m, i)))

        def placed(p: Column) -> Column:
            before = let(F.transform(p, lambda x: x["gap"] + x["len"]), lambda v: _running(v, lambda a, b: a + b))
            score = lambda x: F.round(F.lit(kind.score) + F.when(x["near"], BOOST).otherwise(0.0), 2)
            all_spans = F.zip_with(
                p,
                before,
                lambda x, at: F.struct(
                    F.lit(kind.name).alias("kind"),
                    (at + x["gap"]).alias("start"),
                    (at + x["gap"] + x["take"]).alias("end"),
                    F.least(F.lit(1.0), score(x)).alias("score"),
                    F.lit(kind.own).alias("base"),
                ),
            )
            good = F.filter(all_spans, lambda s: s["end"].isNotNull() & (s["base"] | (s["score"] >= LEAST)))
            return let(good, _not_inside) if kind.group else good

        return let(pairs, placed)

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")
    gate = text.rlike(kind.needs) if kind.needs.startswith("[") else F.contains(text, F.lit(kind.needs))
    matches = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)), lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m)))
    return F.when(gate, matches).otherwise(none)


def spans(text: Column, around: bool = False) -> Column:
    """All spans of a text by kind as listed in KINDS, then start; a null or empty text has none.

    An array of kind, start, end, score, base. The base kinds are found leftmost and without overlap inside their
    kind, and what fails its check is dropped without a second try; spans of different kinds may overlap. The other
    kinds need their checksum (iban, of whose groups in a row the longest good run from the start counts) or a context word (ssn, secret). Without around, that word must stand within CONTEXT_CHARS before them and behind
    the last match of their kind; with around, anywhere in the CONTEXT_CHARS before or after them, and it holds for
    what follows in the same list, however long.
    """
    whole = F.coalesce(text, F.lit(""))
    return let(whole, lambda t: F.concat(*[_proposals(k, t, around) for k in KINDS]))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: bool = False) -> DataFrame:
    """(id, spans) for every row of docs; null ids and repeated rows stay."""
    return docs.select(F.col(id_col).alias("id"), spans(F.col(text_col), around).alias("spans"))


def _redacted(text: Column, found: Column) -> Column:
    """text with each group of overlapping spans replaced by <KIND> of its first one."""

    def spliced(ranked: Column) -> Column:
        ends = F.transform(ranked, lambda x: x["end"])

        def pieces(covered: Column) -> Column:
            """covered: how far the spans before each one reach."""
            each = F.zip_with(
                ranked,
                covered,
                lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""),
            )
            return F.concat(F.array_join(each, ""), F.substring(text, (F.array_max(ends) + 1).cast("int"), F.char_length(text)))

        return let(let(ends, lambda v: _running(v, lambda a, b: F.greatest(a, b))), pieces)

    return let(F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"]))), spliced)


def redact(docs: DataFrame, text_col: str = "text", around: bool = False) -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind, as in <EMAIL>; a null text stays null."""
    text = F.col(text_col)
    clean = let(spans(text, around), lambda s: F.when(F.size(s) == 0, text).otherwise(_redacted(text, s)))
    return docs.withColumn(text_col, clean)
