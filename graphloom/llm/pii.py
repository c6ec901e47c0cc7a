"""Personal data in texts: patterns propose spans, checksums confirm, context scores.

Each kind has a pattern, a validator and a starting score. Words near a span
raise its score; spans of the added kinds (``iban``, ``ssn``) count only from
``THRESHOLD`` on, so a number that merely looks like one is left alone, while
those of the base kinds (``email ip card phone``) always count once valid.

Everything is a column expression: no row leaves the JVM. Positions come from
``split``, which returns what lies between the matches that
``regexp_extract_all`` returns. Long runs can't make a pattern quadratic or
recurse: repeated groups are possessive, and a run is tried from its start only.
Matches are computed once for a text, and their positions are sums over runs of
``RUN`` matches: a fold carries a number and never a list, which every step would
copy, so very many matches take linear time.

Defined results: null and empty texts have no spans (the digest is that of the
empty string); repeated rows give repeated results; positions are code points,
end exclusive; input columns named like an output column are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Least score of a span of an added kind.
THRESHOLD = 0.6
#: Code points looked at on either side of a span.
NEAR = 48
#: Matches of a run.
RUN = 64
#: What proposes a span of each kind.
PATTERNS = {
    # a local part is tried from the start of its run, or where the last match ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that any text with a match passes.
HINTS = {"email": "@", "phone": "+"}
#: Score of a valid span, and what a context word adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5)}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.coalesce(F.call_function("luhn_check", _digits(value)), F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|0000$")
    return F.lit(True)


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _runs(items: Column, size: int = RUN) -> Column:
    """An array cut into arrays of ``size`` items."""
    return _bind(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(x, i + 1, F.lit(size))))


def _before(values: Column, fold) -> Column:
    """For each number, the fold (from 0) of those before it: of whole runs first, then within its run."""

    def run(r: Column, at: Column) -> Column:
        return F.transform(r, lambda _, i: F.aggregate(F.slice(r, F.lit(1), i), at, fold))

    def runs(all_: Column, sums: Column) -> Column:
        return F.flatten(F.transform(all_, lambda r, j: _bind(F.aggregate(F.slice(sums, F.lit(1), j), F.lit(0), fold), lambda at: run(r, at))))

    return _bind(_runs(values), lambda x: _bind(F.transform(x, lambda r: F.aggregate(r, F.lit(0), fold)), lambda sums: runs(x, sums)))


def find_spans(text: Column, kind: str) -> Column:
    """All confirmed spans of a kind, leftmost first, as an array of structs."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    n = F.size(found)
    parts = F.arrays_zip(F.slice(between, 1, n), found, F.slice(between, 2, n)).cast("array<struct<p:string,m:string,q:string>>")

    def placed(all_: Column) -> Column:
        ends = _before(F.transform(all_, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, n: a + n)
        return F.zip_with(all_, ends, lambda x, at: F.struct(
            (at + F.length(x["p"])).alias("start"), x["m"].alias("m"),
            F.right(x["p"], F.lit(NEAR)).alias("a"), F.left(x["q"], F.lit(NEAR)).alias("b"),
        ))

    walked = _bind(parts, placed)
    base, more = SCORES[kind]
    spans = F.transform(F.filter(walked, lambda x: _valid(kind, x["m"])), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"),
        F.when(F.concat(x["a"], F.lit(" "), x["b"]).rlike(CONTEXT[kind]), base + more).otherwise(F.lit(base)).alias("score"), x["m"].alias("value"),
    ))
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    maybe = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(pattern)
    return F.when(maybe, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def detect_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: every confirmed span (kind, start, end, score, value), by kind as in KINDS, then start."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.drop("pii").withColumn("pii", F.concat(*(find_spans(body, k) for k in KINDS)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span with its kind in brackets; overlapping spans become one, named after the first.

    Needs the column ``pii`` and drops it. A null text stays null.
    """
    body = F.col(text)
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def labelled(part: Column, lo: Column, some: Column, sizes: tuple) -> Column:
        """Text and label of each cut; ``part`` begins at ``lo`` and is narrowed to ever smaller runs, as finding a place in a text takes time for all before it."""
        if not sizes:
            return F.array_join(F.transform(some, lambda x: F.concat(F.substr(part, x["lo"] - lo + 1, x["hi"] - x["lo"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), "")

        def narrowed(run: Column) -> Column:
            first = run[0]["lo"]
            return _bind(F.substr(part, first - lo + 1, F.element_at(run, -1)["hi"] - first), lambda p: labelled(p, first, run, sizes[1:]))

        return F.array_join(F.transform(_runs(some, sizes[0]), narrowed), "")

    def cuts(spans: Column) -> Column:
        """(lo, hi, kind) of the text before each span that begins after all earlier ones."""
        ends = _before(F.transform(spans, lambda s: -s["back"]), lambda a, e: F.greatest(a, e))
        zipped = F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("lo"), s["start"].alias("hi"), s["kind"].alias("kind")))
        return F.filter(zipped, lambda x: x["hi"] >= x["lo"])

    last = F.array_max(F.transform("pii", lambda s: s["end"]))
    redacted = F.concat(_bind(ordered, lambda o: _bind(cuts(o), lambda c: labelled(body, F.lit(0), c, (RUN * RUN, RUN)))), F.substr(body, last + 1))
    return docs.withColumn(text, F.when(F.size("pii") > 0, redacted).otherwise(body)).drop("pii")
