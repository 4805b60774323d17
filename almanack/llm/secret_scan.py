"""Secret scans by patterns and by sliding-window entropy (DataFrame functions only).

Patterns name the plain cases. Beside them, every run of 24 or more characters of the base-64 alphabets is a
candidate. It belongs to a character class (hexadecimal, alphanumeric or base 64) with its own alphabet and bound.
A window of 24 characters slides along the candidate; the counts of its characters are a state that each step
changes by the character that comes and the one that goes, and so does the sum of n * log2(n) over the counts,
which gives Shannon's entropy. From the first to the last window at or above the bound of its class a candidate
is a span, unless it matches an allow-list pattern, lies inside a pattern's span, or is too plain: hexadecimal ones
need a digit and a letter, others a digit, a capital and a small letter, as paths and names of words lack one.

Sums are whole millionths of a bit, so results are the same on every machine. Long candidates are cut into pieces
that overlap by a window less one character, so every window is seen once and work grows in proportion. All of it is
done row by row, without a shuffle: no key, source or text makes a task grow but by its own length.

Places are code points from 0, the end not included. A NULL or empty text has no spans. Every row gives a row, repeated
ones and those without ``doc_id`` too; an empty table gives none. Of two spans the one with the smaller start comes first,
then the kind in the order of ``KINDS``. Columns of the result's names are replaced, other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 24
#: Characters of a candidate that are walked through at a time.
PIECE = 1_000
#: The character that stands for no occurrence in the counts of a window; the next one stands for one.
ZERO = ord("A")

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"

# Words before an assigned secret, and the characters of its value.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = "[A-Za-z0-9+/_.=-]+"


def either_case(word: str) -> str:
    """A pattern for a word in upper, lower or mixed case; only ASCII letters have two cases here."""
    return "".join(f"[{c.upper()}{c}]" if c in LETTERS else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"
#: Kind, pattern, the group whose length counts and its least length.
PATTERNS = [
    ("assign", ASSIGN, 2, 6),
    # A run that is too short can't hold a longer one, so the least length may stand in the pattern.
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = "[A-Za-z0-9+/=_-]{24,}"
#: Class, pattern of its candidates, alphabet, least bits per character in a window; the first that fits counts.
HEXADECIMAL = "^[0-9]*[A-Fa-f][0-9A-Fa-f]*$"
CLASSES = [
    ("entropy_hex", HEXADECIMAL, DIGITS + LETTERS[:6], 3.2),
    ("entropy_alnum", "^[0-9A-Za-z]+$", DIGITS + LETTERS.upper() + LETTERS, 4.05),
    ("entropy_base64", "", DIGITS + LETTERS.upper() + LETTERS + "+/=_-", 4.1),
]
KINDS = [kind for kind, *_ in [*PATTERNS, *CLASSES]]
#: Candidates that are no secrets: identifiers, checksums of packages, alphabets, placeholders.
ALLOWED = [
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^(sha|SHA)(1|256|384|512)-",
    "[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|[Ss][Tt][Uu][Vv][Ww][Xx][Yy][Zz]|0123456789",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6}",
]

SPAN = "struct<start:int,kind:int,stop:int>"


def millionths(n: int) -> int:
    """n * log2(n) in millionths of a bit."""
    return round(1e6 * n * math.log2(n)) if n else 0


def most_millionths(bits: float) -> int:
    """The largest sum over the counts of a window whose entropy is at least ``bits``."""
    return math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits))


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """start, stop and text of the leftmost matches that do not overlap, short ones left out.

    The texts between the matches give their places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), sized.alias("sized"))
    start = lambda s, x: s["at"] + F.char_length(x["gap"])
    stop = lambda s, x: start(s, x) + F.coalesce(F.char_length(x["hit"]), F.lit(0))
    hit = lambda s, x: F.struct(start(s, x).alias("start"), stop(s, x).alias("stop"), x["hit"].alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), none("struct<start:int,stop:int,hit:string>").alias("out"))
    step = lambda s, x: F.struct(
        stop(s, x).alias("at"),
        F.when(F.char_length(x["sized"]) >= least, F.array_append(s["out"], hit(s, x))).otherwise(s["out"]).alias("out"),
    )
    found = F.aggregate(rows, zero, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(none("struct<start:int,stop:int,hit:string>"))


def hot_windows(piece: Column, alphabet: str, bits: float) -> Column:
    """first, last: where the first window of enough entropy starts and where the last one ends, else NULL.

    The window begins full of blanks, which have the first count, so every step lets one character go. The
    counts are a string with a character per count, which takes less to change than an array.
    """
    gain = F.array(*[F.lit(millionths(n + 1) - millionths(n)) for n in range(WINDOW)])
    codes = F.transform(F.split(piece, "(?!^)(?!$)"), lambda c: F.instr(F.lit(alphabet), c) + 1)
    zero = F.struct(
        F.lit(0).alias("at"),
        F.lit(chr(ZERO + WINDOW) + chr(ZERO) * len(alphabet)).alias("counts"),
        F.lit(millionths(WINDOW)).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(s: Column, x: Column) -> Column:
        counts, come, gone = s["counts"], x["come"], x["gone"]
        count = lambda code: F.ascii(F.substring(counts, code, F.lit(1)))
        fewer = F.overlay(counts, F.char(count(gone) - 1), gone, F.lit(1))
        changed = F.overlay(fewer, F.char(count(come) + 1), come, F.lit(1))
        # The character that goes takes its last share along; the one that comes brings the next.
        less, more = F.get(gain, count(gone) - (ZERO + 1)), F.get(gain, count(come) - ZERO)
        total = F.when(come == gone, s["sum"]).otherwise(s["sum"] - less + more)
        hot = (s["at"] >= WINDOW - 1) & (total <= most_millionths(bits))
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(come == gone, counts).otherwise(changed).alias("counts"),
            total.alias("sum"),
            F.coalesce(s["first"], F.when(hot, s["at"] + 1 - WINDOW)).alias("first"),
            F.when(hot, s["at"] + 1).otherwise(s["last"]).alias("last"),
        )

    going = F.concat(F.array_repeat(F.lit(1), WINDOW), codes)
    both = F.zip_with(codes, F.slice(going, F.lit(1), F.size(codes)), lambda a, b: F.struct(a.alias("come"), b.alias("gone")))
    return F.aggregate(both, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hot_part(candidate: Column, alphabet: str, bits: float) -> Column:
    """first, last of a candidate of any length, worked out in pieces that share a window less one character."""
    pattern = f".{{1,{PIECE}}}(?=(.{{0,{WINDOW - 1}}}))"
    pieces = F.zip_with(
        F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(candidate, F.lit(pattern), F.lit(1)),
        lambda own, more: F.concat(own, more),
    )
    found = F.transform(
        pieces,
        lambda piece, k: once(
            hot_windows(piece, alphabet, bits),
            lambda h: F.struct((h["first"] + k * PIECE).alias("first"), (h["last"] + k * PIECE).alias("last")),
        ),
    )
    return once(
        found,
        lambda parts: F.struct(
            F.array_min(F.transform(parts, lambda h: h["first"])).alias("first"),
            F.array_max(F.transform(parts, lambda h: h["last"])).alias("last"),
        ),
    )


def entropy_spans(text: Column, covered: Column, allowed: Sequence[str]) -> Column:
    """Spans of the candidates' parts of high entropy, but for those that a pattern's span covers."""

    def inside(start: Column, stop: Column) -> Column:
        return F.exists(covered, lambda b: (b["start"] <= start) & (b["stop"] >= stop))

    def likely(c: Column) -> Column:
        mixed = c["hit"].rlike("[a-z]") & c["hit"].rlike("[A-Z]")
        keep = c["hit"].rlike("[0-9]") & (mixed | c["hit"].rlike(HEXADECIMAL))
        for pattern in allowed:
            keep = keep & ~c["hit"].rlike(pattern)
        return keep & ~inside(c["start"], c["stop"])

    def judged(c: Column) -> Column:
        kind, part = F.lit(len(KINDS) - 1), None
        for name, shape, alphabet, bits in reversed(CLASSES):
            string = F.lower(c["hit"]) if name == "entropy_hex" else c["hit"]
            hot = hot_part(string, alphabet, bits)
            part = hot if part is None else F.when(c["hit"].rlike(shape), hot).otherwise(part)
            kind = F.when(c["hit"].rlike(shape), F.lit(KINDS.index(name))).otherwise(kind) if shape else kind
        return once(
            part,
            lambda p: F.struct((c["start"] + p["first"]).alias("start"), kind.alias("kind"), (c["start"] + p["last"]).alias("stop")),
        )

    spans = F.transform(F.filter(matches(text, CANDIDATE, 0, WINDOW), likely), judged)
    spans = F.filter(spans, lambda s: s["start"].isNotNull() & ~inside(s["start"], s["stop"]))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(none(SPAN))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, *, allowed: Sequence[str] = tuple(ALLOWED)) -> DataFrame:
    """All columns of ``docs`` with n_assign, n_access, n_hex, base_spans and spans (texts kind:start:end, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def spans(kind: int, pattern: str, group: int, least: int) -> Column:
        span = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop"))
        return F.transform(matches(text, pattern, group, least), span)

    base = F.concat(*[spans(k, *rest) for k, (_, *rest) in enumerate(PATTERNS)])
    rows = docs.withColumn("__base", base).withColumn("__more", entropy_spans(text, F.col("__base"), allowed))

    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")

    results = {
        **{f"n_{kind}": count(k) for k, (kind, *_) in enumerate(PATTERNS)},
        "base_spans": as_text(F.col("__base")),
        "spans": as_text(F.concat("__base", "__more")),
    }
    others = [c for c in docs.columns if c.lower() not in results]
    return rows.select(*[F.col(f"`{c}`") for c in others], *[c.alias(n) for n, c in results.items()])
