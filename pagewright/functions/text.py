"""Text expressions.  Everything is a native column expression except Unicode NFC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright import settings as S

# Fixed value: the characters counted as white space (spelled out because Java's \s is ASCII only).
_NARROW = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}"
_WIDE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_RE2 = _NARROW + _WIDE
SPACE_CHARS = "".join(
    [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680)]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + [chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)
# Java tests the range guard first, so Latin text pays one table lookup per character.
SPACE = _NARROW + r"[\x{1680}-\x{3000}&&[" + _WIDE + "]]"
# Patterns that define results.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Carriage returns are looked for with them; spelled out, as Java then needs one table lookup per character.
_RARE_CONTROL = "[" + "".join(rf"\x{c:02X}" for c in (*range(9), *range(11, 32), 127)) + "]"
NUMBER = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?"
WORD = r"[0-9A-Za-z가-힣]{2,}"
PAGE_NUMBER = rf"^[{SPACE}]*(?:-[{SPACE}]*)?\p{{Nd}}{{1,4}}(?:[{SPACE}]*-)?[{SPACE}]*\z"
CAPTION = rf"(?i)^[{SPACE}]*(그림|표|figure|fig\.?|table)[{SPACE}]*[.{SPACE}]?\p{{Nd}}"
SENTENCE_BREAK = rf"(?<=[.!?])[{SPACE}]+"
POPULATION_BREAK = rf"(?<=[.!?。\n])[{SPACE}]+"


def measurement_pattern(space: str) -> str:
    """Percentages, values with units, ages, durations, ranges and N=..., in this order."""
    return "|".join(
        (
            rf"(?:\p{{Nd}}+(?:\.\p{{Nd}}+)?[{space}]?%)",
            rf"(?:\p{{Nd}}+(?:\.\p{{Nd}}+)?[{space}]?(?:{S.MEASURE_UNITS}))",
            rf"(?:\p{{Nd}}+[{space}]?(?:세|살))",
            rf"(?:\p{{Nd}}+(?:\.\p{{Nd}}+)?[{space}]?(?:년|개월|주|일|시간|분))",
            rf"(?:\p{{Nd}}+[{space}]?[-~][{space}]?\p{{Nd}}+(?:\.\p{{Nd}}+)?)",
            rf"(?:[Nn][{space}]?=[{space}]?\p{{Nd}}+)",
        )
    )


MEASUREMENT = measurement_pattern(SPACE)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """`fn(value)` with the value computed once however often `fn` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def collapse_space(c) -> Column:
    """Every run of white space becomes one blank (single blanks are not touched)."""
    return F.regexp_replace(col(c), rf"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " ")


def remove_space(c) -> Column:
    return F.regexp_replace(col(c), rf"[{SPACE}]+", "")


def is_blank(c) -> Column:
    """Null, empty or white space only; stops at the first other character."""
    return ~F.coalesce(col(c).rlike(rf"[^{SPACE}]"), F.lit(False))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def _not_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def nfc(c) -> Column:
    """Unicode NFC.  Spark has no builtin; text below U+0300 is already composed, so only
    rows with a higher code point are sent (others travel as nulls and keep their value)."""
    c = col(c)
    return F.coalesce(_nfc(F.when(_not_ascii(c) & c.rlike(r"[\x{300}-\x{10FFFF}]"), c)), c)


def normalize_text(c, compose: bool = True) -> Column:
    """Clean text without touching numbers, units or comparison signs.

    Rare cases are guarded by a cheap test, so ordinary text is scanned only a few times.  Once control characters are gone,
    the only white space of ASCII text is the blank and the line break.
    """
    t = nfc(c) if compose else col(c)
    steps = (
        (lambda x: x.rlike(_RARE_CONTROL),
         lambda x: F.regexp_replace(F.regexp_replace(x, CONTROL_CHARS, ""), r"\r\n?", "\n")),
        (lambda x: x.contains("-\n"), lambda x: F.regexp_replace(x, r"([a-z])-\n([a-z])", "$1$2")),
        (lambda x: x.contains("  ") | x.contains("\t") | x.contains("\xa0"),
         lambda x: F.regexp_replace(x, r"[ \t\x{A0}]{2,}|[\t\x{A0}]", " ")),
        # strip every line: white space next to a line break, but never the breaks themselves
        (lambda x: x.contains(" \n") | x.contains("\n ") | (x.contains("\n") & _not_ascii(x) & x.rlike(r"[\x{85}\x{1680}-\x{3000}]")),
         lambda x: F.regexp_replace(x, rf"[{SPACE}&&[^\n]]*+\n[{SPACE}&&[^\n]]*+", "\n")),
        (lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")),
    )

    def where(rare, change):
        return lambda x: F.when(rare(x), change(x)).otherwise(x)

    for rare, change in steps:
        t = let(t, where(rare, change))
    return strip(t)


def is_page_number_line(c) -> Column:
    return col(c).rlike(PAGE_NUMBER)


def nonspace_char_count(c) -> Column:
    return F.length(remove_space(c)).cast("bigint")


def valid_char_ratio(c) -> Column:
    """Printable characters other than U+FFFD over non-space characters; 1.0 when there are none."""
    solid = remove_space(c)
    good = F.length(F.regexp_replace(solid, r"[\p{C}\p{Z}\x{FFFD}]", ""))
    return F.when(F.length(solid) == 0, F.lit(1.0)).otherwise(good / F.length(solid))


def band_fingerprint(c) -> Column:
    """Comparison key for repeated bands: digits do not count, at most 120 characters."""
    flat = F.lower(collapse_space(strip(c)))
    return F.substring(F.regexp_replace(flat, r"\p{Nd}+", "#"), 1, S.BAND_MAX_CHARS)


def looks_like_section_title(c) -> Column:
    t = strip(c)
    ending = F.lit(False)
    for mark in S.TITLE_REJECTED_ENDINGS:
        ending = ending | t.endswith(mark)
    return (t != "") & ~t.contains("\n") & (F.length(t) <= S.TITLE_MAX_CHARS) & ~ending


def split_sentences(c) -> Column:
    return F.filter(F.split(col(c), SENTENCE_BREAK, -1), lambda s: ~is_blank(s))


def _slices(text: Column, limit: int) -> Column:
    """Fixed-width pieces of a text."""
    last = F.ceil(F.length(text) / F.lit(limit)).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.substring(text, i * limit + 1, F.lit(limit)),
    )


def split_long_text(c, limit: int = S.CHUNK_MAX_CHARS) -> Column:
    """Parts of at most `limit` characters, cut at sentence ends where possible.

    The buffer test ignores the joining space, so a packed part can be one character over the
    limit and is then sliced; a text without sentence ends is sliced directly.
    """
    text = col(c)
    sentences = split_sentences(text)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, s):
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(strip(F.concat(acc["open"], F.lit(" "), s))).alias("open"),
        )

    packed = F.aggregate(
        sentences, empty, add,
        lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    sliced = F.flatten(
        F.transform(packed, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(_slices(p, limit)))
    )
    return (
        F.when(F.length(text) <= limit, F.array(text))
        .when(F.size(sentences) <= 1, _slices(text, limit))
        .otherwise(sliced)
    )


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def token_estimate(c) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(col(c)) / F.lit(4.0), 0)).cast("bigint")


def text_preview(c) -> Column:
    return F.substring(col(c), 1, S.PREVIEW_CHARS)


def strip_thinking(c) -> Column:
    closed = F.regexp_replace(col(c), r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(closed, r"(?is)<think>.*", ""))


def extract_numbers(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(NUMBER), 0)


def word_tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), 0))


def padded_lower(c) -> Column:
    """White space collapsed, lower case, one space at both ends (markers may carry spaces)."""
    return F.concat(F.lit(" "), collapse_space(F.lower(col(c))), F.lit(" "))


def bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it; Spark would work it out each time inside array functions and branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def negation_markers(c, markers=S.NEGATION_MARKERS) -> Column:
    return bound(padded_lower(c), lambda hay: F.array_compact(F.array(*[F.when(hay.contains(m), F.lit(m)) for m in markers])))


def has_negation(c, markers=S.NEGATION_MARKERS) -> Column:
    return F.size(negation_markers(c, markers)) > 0


def subject_tokens(c, markers=S.NEGATION_MARKERS) -> Column:
    """Word tokens that carry no negation marker."""
    cores = [m.strip() for m in markers if m.strip()]

    def clean(t):
        hit = F.lit(False)
        for m in cores:
            hit = hit | t.contains(m)
        return ~hit

    return F.filter(word_tokens(c), clean)


def clean_text(c, limit: int) -> Column:
    """Trimmed text, or null when blank or over the limit (never truncated)."""
    t = strip(c)
    return F.when((F.length(t) >= 1) & (F.length(t) <= limit), t)


def measurement_candidates(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(MEASUREMENT), 0), strip)


def population_sentences(c, hints=S.POPULATION_HINTS) -> Column:
    def keep(s):
        hit = F.lit(False)
        for h in hints:
            hit = hit | s.contains(h)
        return (F.length(s) >= 6) & (F.length(s) <= 300) & hit

    return F.filter(F.transform(F.split(col(c), POPULATION_BREAK, -1), strip), keep)


def context_window(text, value, window: int = S.CONTEXT_WINDOW_CHARS) -> Column:
    """Text around the first occurrence of a value; the value itself when absent."""
    text, value = col(text), col(value)
    at = F.position(value, text)
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(text), at - 1 + F.length(value) + window)
    return F.when(at > 0, strip(F.substring(text, start, end - start + 1))).otherwise(value)


def validate_question(c) -> Column:
    """Reject code of a question, null when it is accepted."""
    q = strip(F.coalesce(col(c), F.lit("")))
    return (
        F.when(q == "", F.lit("blank"))
        .when(F.length(q) > S.MAX_QUESTION_CHARS, F.lit("too_long"))
        .when(q.rlike(r"[\x00-\x08\x0B-\x1F]"), F.lit("control_character"))
    )


# --- numbers inside texts ---------------------------------------------------------

def _plain(num: Column) -> Column:
    return F.regexp_replace(num, r"[,%]", "")


def number_pattern(num, mode: str = "claim") -> Column:
    """Pattern that finds one number token inside a text whose commas were removed.

    claim: an optional percent sign, then no digit.  eval: a percent sign must match, and
    "8" is not found in "8.5".
    """
    num = col(num)
    percent = num.endswith("%")
    body = F.concat(F.lit(r"(?<!\p{Nd})"), F.replace(_plain(num), F.lit("."), F.lit("\\.")))
    if mode == "claim":
        tail = F.when(percent, F.lit(r"%?(?!\p{Nd})")).otherwise(F.lit(r"(?!\p{Nd})"))
    else:
        tail = F.when(percent, F.lit("%")).otherwise(F.lit(r"(?!\p{Nd})(?!\.\p{Nd})"))
    return F.concat(body, tail)


def number_in_text(hay, num, mode: str = "claim") -> Column:
    return F.regexp_like(F.regexp_replace(col(hay), ",", ""), number_pattern(num, mode))


def literal_pattern(c) -> Column:
    """Quote a column so that it is matched literally inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(col(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def value_unit_adjacent(text, num, unit) -> Column:
    pattern = F.concat(
        F.lit(r"(?<!\p{Nd})"), F.replace(_plain(col(num)), F.lit("."), F.lit("\\.")),
        F.lit(rf"[{SPACE}]*"), literal_pattern(unit),
    )
    return F.regexp_like(col(text), pattern)


def occurrences(hay, needle) -> Column:
    """Non-overlapping occurrences."""
    hay, needle = col(hay), col(needle)
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("bigint")


def overlapping_occurrences(hay, needle) -> Column:
    """Occurrences that may overlap: a zero-width look-ahead is counted at every position."""
    return F.regexp_count(col(hay), F.concat(F.lit("(?="), literal_pattern(needle), F.lit(")"))).cast("bigint")
