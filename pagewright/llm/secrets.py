"""Secret scans in column expressions: patterns with spans, and windows of high entropy over candidate strings.

Spans count code points, the end exclusive. Spark finds matches as strings; their places follow from the lengths of the
matches and of what lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in their order, and what a match must have to count.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more: shorter runs hold no longer one
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 characters or more, likewise
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates for entropy: strings of one class of characters; the class, its characters, the least length, the window, and
#: bits per character that a window must reach.
CLASSES = (
    ("hex", r"(?<![0-9A-Za-z+])(?:[0-9A-F]{24,})(?![0-9A-Za-z+])", 24, 3.0),
    ("lower hex", r"(?<![0-9A-Za-z+])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{24,}(?![0-9A-Za-z+])", 24, 3.0),
    ("upper", r"(?<![0-9A-Za-z+])(?=[0-9A-F]*[G-Z])(?=[A-Z]*[0-9])[0-9A-Z]{24,}(?![0-9A-Za-z+])", 24, 3.4),
    ("lower", r"(?<![0-9A-Za-z+])(?=[0-9a-f]*[g-z])(?=[a-z]*[0-9])[0-9a-z]{24,}(?![0-9A-Za-z+])", 24, 3.4),
    ("base64", r"(?<![0-9A-Za-z+/_=-])(?=[0-9A-Za-z+/_=-]*[0-9])(?=[0-9A-Za-z+/_=-]*[a-z])(?=[0-9A-Za-z+/_=-]*[A-Z])[0-9A-Za-z+/_=-]{24,}", 24, 4.0),
)
#: Strings that hold one of these are no secrets: examples and placeholders, and names that are made of words.
ALLOWED = r"(?i)example|sample|placeholder|dummy|changeme|xxxx|test_?key|your_|0123456789|abcdefgh|(?:[a-z]{3,}[/_-]){3}"
#: Where a candidate that the allow-list knows is cut, so that a name or a path speaks for itself only: at what assigns, at
#: names made of three words or more, and at path segments of letters with a placeholder. Words are bounded, as Java recurses.
CUTS = (r"=++(?!\z)|(?<![0-9A-Za-z])(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+){1,4}+[/_-]){3,12}"
        r"|(?<![0-9A-Za-z_-])[A-Za-z_-]{0,64}(?i:example|sample|placeholder|dummy|changeme|test_?key|your_)[A-Za-z_-]{0,64}/")


SPANS = "array<struct<start:bigint,kind:int,end:bigint,match:string>>"


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, also where fn uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, match>> of the leftmost matches that do not overlap."""
    none = F.array().cast(SPANS)

    def placed(found: Column) -> Column:
        def of(between: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                match = F.element_at(found, i)
                begin = state["at"] + F.char_length(F.element_at(between, i))
                end = begin + F.char_length(match)
                span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), match.alias("match"))
                return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

            zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(F.lit(1), F.size(found)), zero, step, lambda s: s["out"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def highest_entropy(text: Column, window: int) -> Column:
    """The most bits per character of any window of an ASCII string; a shorter string is one window.

    Entropy is log2(n) - sum(c * log2(c)) / n over the counts c of a window's characters. A step of the window changes two
    counts, and with them the sum: one array of counts is kept, and no window is counted anew.
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def of(chars: Column) -> Column:
        size = F.least(F.size(chars), F.lit(window))

        def step(state: Column, i: Column) -> Column:
            enters = F.element_at(chars, i)
            leaves = F.when(i > size, F.element_at(chars, F.greatest(i - size, F.lit(1)))).otherwise(F.lit(-1))
            come = F.element_at(state["n"], enters + 1)
            go = F.when(leaves >= 0, F.element_at(state["n"], F.greatest(leaves, F.lit(0)) + 1)).otherwise(F.lit(0))
            total = state["sum"] + term(come + 1) - term(come) + F.when(leaves >= 0, term(go - 1) - term(go)).otherwise(F.lit(0.0))
            counts = F.transform(state["n"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
            changed = F.when(enters == leaves, state["sum"]).otherwise(total)
            low = F.when(i >= size, F.least(state["low"], changed)).otherwise(state["low"])
            return F.struct(counts.alias("n"), changed.alias("sum"), low.alias("low"))

        zero = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))
        bits = F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step, lambda s: F.log2(size.cast("double")) - s["low"] / size)
        return F.when(F.size(chars) > 0, bits).otherwise(F.lit(0.0))

    return let(F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda c: (c > 0) & (c < 128)), of)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by start, then kind as listed."""
    assign = F.filter(spans(text, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.array_sort(F.concat(assign, spans(text, ACCESS, "access"), spans(text, HEX, "hex")))


def entropy_spans(text: Column) -> Column:
    """Spans of candidates with a window of high entropy.

    Of a candidate that the allow-list knows, the parts between cuts are candidates, without those that it knows, too; the
    span is the whole, with the names.
    """
    def high(pattern: str, window: int, bits: float):
        def of(s: Column) -> Column:
            parts = F.filter(F.split(s["match"], CUTS, -1), lambda p: p.rlike(pattern) & ~p.rlike(ALLOWED))
            parts = F.when(s["match"].rlike(ALLOWED), parts).otherwise(F.array(s["match"]))
            return F.exists(parts, lambda p: highest_entropy(p, window) >= bits)

        return of

    *narrow, wide = [F.filter(spans(text, pattern, "entropy"), high(pattern, window, bits)) for _, pattern, window, bits in CLASSES]
    # one span for a place: strings of letters of one case and digits can lie in one of the last class
    return let(wide, lambda w: F.array_sort(F.concat(w, F.filter(F.concat(*narrow), lambda s: ~F.exists(w, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]))))))


def _named(spans_of: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, with `secrets_base` and `secrets`: arrays of (start, kind, end, match), by start and kind.

    Null and empty texts have no spans. An entropy span that overlaps a base span is left out, as that place is known.
    Columns of these names are replaced; rows are neither moved nor dropped, and each is scanned whole.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop("secrets_base", "secrets").withColumn("secrets_base", base_spans(content))
    base = F.col("secrets_base")
    more = F.filter(entropy_spans(content), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return docs.withColumn("secrets", F.array_sort(F.concat(base, more)))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """Text in which each stretch that spans cover is replaced by a mark; spans that touch or overlap are one stretch."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        inside = (s["start"] <= state["at"]) & (state["at"] > 0)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark))).alias("out"))

    joined = F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))  # the rest
    return F.when(F.size(found) > 0, joined).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each base kind counted, SHA-256 of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    def is_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("secrets_base", is_kind(k))).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *counts, F.sha2(_named(F.col("secrets_base")), 256).alias("base_sha256"), _named(F.col("secrets")).alias("spans"))
