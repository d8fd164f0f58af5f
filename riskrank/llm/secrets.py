"""Secret scan: fixed patterns plus sliding-window entropy, in column functions only.

Kinds, in the order that breaks ties: ``assign``, ``access``, ``hex``, ``entropy``.
The first three are patterns. ``entropy`` looks at candidate strings, which are
maximal runs of token characters in what pattern spans and the segments of
allow-listed words leave of the text: a window moves over the run, the symbol counts and the sum of c*log2(c) are kept up to date as
one symbol enters and one leaves, and the window's Shannon entropy is compared
with the limit of the run's character class. Allow-listed runs are let go.

Spans are half-open and count code points. A null text is an empty one and has
no spans. All columns of the input stay; the added ones are named by arguments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths the scan is defined by.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
# Character class, the first that fits: what all symbols of the run must be, the alphabet, least entropy of a window in bits.
# A window of 20 symbols has 4.32 bits at most; English words of that length stay below 3.6.
CLASSES = [
    ("hex", "^[0-9A-Fa-f]+$", "0123456789abcdef", 3.0),
    ("upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6),
    ("mixed", "^(?![a-z0-9]+$)[A-Za-z0-9+/=_-]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.8),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6),
]
# Runs that look random but are not secret: all one case without a digit (words, slugs of words),
# numbers and UUIDs.
ALLOWED = [
    r"^[a-z+/=_-]+$", r"^[A-Z+/=_-]+$", r"^[0-9+/=_-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
]
# A slug of words, the first letter of each in either case: what it is made of, and what may not be in it. No group
# repeats here, since the regex engine recurses once per repeat and long runs would exhaust its stack.
SLUG = r"^[A-Za-z][A-Za-z+/=_-]*[a-z]$"
NO_SLUG = r"[A-Za-z][A-Z]|[A-Z](?![a-z])"
# Placeholders and counting sequences, with the segments between / = _ - that hold them.
EXCUSED = (r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx"
           r"|0123456789|abcdefgh)[A-Za-z0-9+]*")
# Stands for a symbol that is already judged; not a character of any text.
GONE = "\uffff"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join) -> Column:
    """Running totals under ``join`` (from 0) of an array of numbers.

    Growing an array copies it, so the array is cut into about as many parts as each part has
    numbers: what is copied grows with the power 1.5 of its size, not with its square.
    """
    none = F.array().cast("array<int>")
    last = lambda array: F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(0))

    def parts(held: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(held))).cast("int"))
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / w).cast("int")),
                                                 lambda i: F.slice(held, i * w + 1, w)))

    def totals(cut: Column) -> Column:
        return F.transform(cut, lambda part: F.aggregate(
            part, none, lambda out, x: F.concat(out, F.array(join(last(out), x)))))

    def joined(inner: Column) -> Column:
        tops = F.aggregate(F.transform(inner, last), F.array(F.lit(0)),
                           lambda out, x: F.concat(out, F.array(join(last(out), x))))
        return F.flatten(F.zip_with(inner, F.slice(tops, 1, F.size(inner)),
                                    lambda part, top: F.transform(part, lambda x: join(top, x))))

    return _let(values, lambda held: F.when(F.size(held) > 0, _let(totals(parts(held)), joined)).otherwise(none))


def _sum(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def _spans(text: Column, found: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of ``found``, the matches of ``pattern`` in ``text``, from the lengths of what lies between."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda hit, gap: F.length(gap) + F.length(hit))
    spans = F.zip_with(found, _running(steps, _sum), lambda hit, end: F.struct(
        (end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
        (keep(hit) if keep else F.lit(True)).alias("keep")))
    kept = F.transform(F.filter(spans, lambda s: s["keep"]),
                       lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(found) > 0, kept).otherwise(none)


def _rewritten(text: Column, spans: Column, instead) -> Column:
    """``text`` with ``instead(length, begin, first)`` for what each of its sorted spans adds to those before it.

    ``begin`` says whether a gap lies in front of the span, ``first`` whether the text begins with it.
    Finding a place in a text means counting from its front, so the text is cut into stretches first.
    """
    def cut(sorted_: Column, reached: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reached, 1, F.size(sorted_) - 1))
        pieces = F.zip_with(sorted_, before, lambda s, at: F.struct(
            at.alias("at"), F.greatest(at, s["start"]).alias("start"), F.greatest(at, s["end"]).alias("end")))
        width = F.ceil(F.sqrt(F.size(sorted_))).cast("int")
        return _let(pieces, lambda held: _let(width, lambda w: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(held) - 1) / w).cast("int")),
            lambda i: F.slice(held, i * w + 1, w))))

    def stretch(part: Column, front: Column) -> Column:
        inside = F.substring(text, front + 1, F.element_at(part, -1)["end"] - front)
        return _let(inside, lambda own: F.transform(part, lambda p: F.concat(
            F.substring(own, p["at"] - front + 1, p["start"] - p["at"]),
            instead(p["end"] - p["start"], p["start"] > p["at"], p["at"] == 0))))

    def made(sorted_: Column, reached: Column) -> Column:
        tail = F.substring(text, F.element_at(reached, -1) + 1, F.length(text))
        written_ = F.transform(cut(sorted_, reached), lambda part: _let(
            F.element_at(part, 1)["at"], lambda front: stretch(part, front)))
        return F.array_join(F.concat(F.flatten(written_), F.array(tail)), "")

    return F.when(F.size(spans) > 0, _let(spans, lambda sorted_: _let(
        _running(F.transform(sorted_, lambda s: s["end"]), F.greatest),
        lambda reached: made(sorted_, reached)))).otherwise(text)


def _without(text: Column, spans: Column) -> Column:
    """``text`` with every symbol of ``spans``, and one separator next to them, as ``GONE``; no place moves."""
    left = _rewritten(text, F.array_sort(spans), lambda length, begin, first: F.repeat(F.lit(GONE), length))
    near = f"(?<={GONE})[/=_-]|[/=_-](?={GONE})"
    return F.when(F.size(spans) > 0, F.regexp_replace(left, near, GONE)).otherwise(text)


def window_entropy(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of any window of ``run``; null for runs shorter than the window.

    The counts stand in a string with one symbol per letter of the alphabet, so that a
    step rewrites the counts of the entering and the leaving symbol alone.
    """
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    moves = _let(places, lambda held: F.zip_with(
        held, F.slice(F.concat(F.array_repeat(F.lit(0), window), held), 1, F.size(held)),
        lambda enter, leave: F.struct(enter.alias("enter"), leave.alias("leave"))))
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - 48
    put = lambda counts, place, n: F.overlay(counts, F.char(n + 48), place, F.lit(1))

    def slide(state, move):
        enter, leave = move["enter"], move["leave"]

        def entered(left):  # (counts, total) once the leaving symbol has gone
            return _let(count(left["counts"], enter), lambda n: F.struct(
                put(left["counts"], enter, n + 1).alias("counts"),
                (left["total"] + F.get(clogc, n + 1) - F.get(clogc, n)).alias("total")))

        gone = F.when(leave > 0, _let(count(state["counts"], leave), lambda n: F.struct(
            put(state["counts"], leave, n - 1).alias("counts"),
            (state["total"] + F.get(clogc, n - 1) - F.get(clogc, n)).alias("total")))).otherwise(
            F.struct(state["counts"].alias("counts"), state["total"].alias("total")))
        entropy = lambda total: F.when(
            state["seen"] >= window - 1, F.lit(math.log2(window)) - total / window)
        return _let(_let(gone, entered), lambda now: F.struct(
            now["counts"].alias("counts"), now["total"].alias("total"),
            F.greatest(state["top"], entropy(now["total"])).alias("top"), (state["seen"] + 1).alias("seen")))

    state = F.struct(F.lit("0" * len(alphabet)).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(None).cast("double").alias("top"), F.lit(0).alias("seen"))
    return F.aggregate(moves, state, slide, lambda s: s["top"])


def _suspicious(run: Column) -> Column:
    allowed = run.rlike(SLUG) & ~run.rlike(NO_SLUG)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    verdict = F.lit(False)
    for _, shape, alphabet, limit in reversed(CLASSES):
        folded = F.lower(run) if alphabet == CLASSES[0][2] else run
        verdict = F.when(run.rlike(shape), window_entropy(folded, alphabet) >= limit - 1e-9).otherwise(verdict)
    return F.when(allowed, False).otherwise(verdict)


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Add ``out``: the spans of every text as array<struct<start, kind, end>>, kind indexing ``KINDS``.

    Spans come by start, then kind. Pattern spans of different kinds may overlap;
    entropy spans touch no pattern span. Repeated rows and null ids are treated row by row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()],
                      text.alias("_scan_text"))
    inner = inner.withColumns({
        "_scan_assign": F.regexp_extract_all("_scan_text", F.lit(ASSIGN), F.lit(0)),
        "_scan_access": F.regexp_extract_all("_scan_text", F.lit(ACCESS), F.lit(0)),
        "_scan_hex": F.regexp_extract_all("_scan_text", F.lit(HEX), F.lit(0)),
    })
    body = F.col("_scan_text")
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_VALUE
    inner = inner.withColumn("_scan_base", F.concat(
        _spans(body, F.col("_scan_assign"), ASSIGN, 0, long_enough),
        _spans(body, F.col("_scan_access"), ACCESS, 1),
        _spans(body, F.col("_scan_hex"), HEX, 2)))
    inner = inner.withColumn("_scan_left", _without(body, F.col("_scan_base")))
    left = F.col("_scan_left")
    inner = inner.withColumn("_scan_words", F.when(left.rlike(CANDIDATE), F.regexp_extract_all(
        left, F.lit(EXCUSED), F.lit(0))).otherwise(F.array().cast("array<string>")))
    inner = inner.withColumn("_scan_left", _without(left, _spans(left, F.col("_scan_words"), EXCUSED, 3)))
    inner = inner.withColumn("_scan_runs", F.regexp_extract_all("_scan_left", F.lit(CANDIDATE), F.lit(0)))
    inner = inner.withColumn("_scan_more", _spans(left, F.col("_scan_runs"), CANDIDATE, 3, _suspicious))
    spans = F.array_sort(F.concat("_scan_base", "_scan_more"))
    return inner.withColumn(out, spans).drop(
        "_scan_text", "_scan_assign", "_scan_access", "_scan_hex", "_scan_runs", "_scan_base", "_scan_more",
        "_scan_left", "_scan_words")


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span, overlapping ones as one, by ``mark``; texts without spans stay as they are."""
    scanned = scan_secrets(df, text_col, "_redact_spans")
    text, spans = F.col(text_col), F.col("_redact_spans")
    masked = _rewritten(text, spans, lambda length, begin, first: F.when(
        begin | (first & (length > 0)), F.lit(mark)).otherwise(F.lit("")))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).drop("_redact_spans")
