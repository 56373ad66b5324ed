"""Secret scans by patterns and sliding-window entropy, in built-in functions only.

Places: the pieces of a text between the matches of a pattern and the matches
themselves alternate, so running sums of their lengths are the places of the
matches, in code points.

Entropy: a candidate is a run of at least WINDOW characters of a class (hexadecimal,
base64 or url-safe base64) with a digit and a letter. A window of WINDOW
characters moves along it; when one enters and one leaves, the sum of c log2 c over
the counts c changes by the two counts concerned only. A candidate whose largest
window entropy reaches the threshold of its class is a span of kind ``entropy``,
unless an allow-list pattern fits it. Spans of the base patterns are cut out of a text
first: what is left of a run beside them is a candidate if it is long enough.

Defined cases. A null text is empty. An empty text has no spans; the hash is that of
the empty string. Repeated rows are scanned one by one. Long texts are scanned whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.binding import let

# Kinds in the order in which spans of one start are listed.
ASSIGN, ACCESS, HEX, ENTROPY = "assign", "access", "hex", "entropy"

_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
PATTERNS = {
    ASSIGN: rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    ACCESS: "AKIA[A-Z0-9]+",
    HEX: "[0-9a-f]+",
}
LEAST = {ASSIGN: 6, ACCESS: 20, HEX: 24}
# A cheap pattern that every kept match contains; it spares most texts the search for places.
CONTAINS = {ASSIGN: PATTERNS[ASSIGN], ACCESS: "AKIA[A-Z0-9]{16}", HEX: "[0-9a-f]{24}"}
# Without its short runs, the hexadecimal pattern finds the same runs of the least length.
SEARCHED = PATTERNS | {ACCESS: "AKIA[A-Z0-9]{16,}", HEX: "[0-9a-f]{24,}"}

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"
# Class, the runs that belong to it, the least entropy of a window in bits per character; the first that fits holds.
CLASSES = [
    ("hex", r"[0-9A-Fa-f]+", 3.0),
    ("base64", r"[A-Za-z0-9+/]+", 3.7),
    ("urlsafe", r"[A-Za-z0-9_-]+", 3.7),
    ("mixed", r".+", 3.9),
]
# The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
# Runs that look random and are no secrets: repeated units, UUIDs, numbers. Paths and names of words have no digit, and are no candidates.
ALLOWED = [
    r"(.{1,4})\1{4,}.{0,3}",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[0-9/_-]+",
]

_SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _places(text: Column, pattern: str) -> Column:
    """[(start, match)] of the matches of a pattern, in order."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("match")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["gap"])).cast("int").alias("start"), x["match"].alias("match")))))
            .alias("out"),
        ),
    )
    return walk["out"]


def _span(rank: int, kind: str):
    return lambda x: F.struct(
        x["start"].alias("start"),
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("kind"),
        (x["start"] + F.length(x["match"])).cast("int").alias("stop"),
    )


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one of the base kinds."""
    found = _places(text, SEARCHED[kind])
    part = (lambda x: F.regexp_extract(x["match"], PATTERNS[ASSIGN], 1)) if kind == ASSIGN else (lambda x: x["match"])
    kept = F.filter(found, lambda x: F.length(part(x)) >= LEAST[kind])
    spans = F.transform(kept, _span(list(PATTERNS).index(kind), kind))
    return F.when(text.rlike(CONTAINS[kind]), spans).otherwise(F.array().cast(_SPAN))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of the run; counts change by one step each."""
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def swept(symbols: Column) -> Column:
        """The least sum, from the number in ALPHABET of each character of the run."""

        def moved(s: Column, i: Column) -> Column:
            enters, leaves = F.get(symbols, i), F.when(i >= window, F.get(symbols, i - window)).otherwise(F.lit(-1))
            more, fewer = F.get(s["counts"], enters), F.get(s["counts"], leaves)
            change = F.get(weight, more + 1) - F.get(weight, more)
            change = change + F.when(leaves >= 0, F.get(weight, fewer - 1) - F.get(weight, fewer)).otherwise(F.lit(0.0))
            # The same character enters and leaves: no count changes.
            total = F.when(enters == leaves, s["sum"]).otherwise(s["sum"] + change)
            counts = F.transform(
                s["counts"], lambda n, k: n + F.when(k == enters, F.lit(1)).otherwise(F.lit(0)) - F.when(k == leaves, F.lit(1)).otherwise(F.lit(0))
            )
            least = F.when(i >= window - 1, F.least(s["least"], total)).otherwise(s["least"])
            return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(symbols) - 1), start, moved)["least"]

    # The run is cut into characters once; a place of a text would be looked for from its start.
    symbols = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.lit(math.log2(window)) - let(symbols, swept) / window


def _is_random(run: Column) -> Column:
    threshold = reduce(lambda rest, c: F.when(run.rlike(f"^{c[1]}$"), F.lit(c[2])).otherwise(rest), reversed(CLASSES), F.lit(math.inf))
    allowed = reduce(lambda a, b: a | b, (run.rlike(f"^(?:{p})$") for p in ALLOWED))
    # A case statement, so that only candidates with letters and digits are swept.
    return (
        F.when(~run.rlike("[0-9]") | ~run.rlike("[A-Za-z]") | allowed, F.lit(False)).otherwise(window_entropy(run) >= threshold)
    )


def _without(text: Column, spans: Column) -> Column:
    """The text with a space for each character of the spans, which are in the order of their starts and may overlap."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["stop"] <= s["at"], s).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.concat(
                    s["out"],
                    F.array(
                        F.substring(text, s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"])),
                        F.repeat(F.lit(" "), x["stop"] - F.greatest(s["at"], x["start"])),
                    ),
                ).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(F.array_join(walk["out"], ""), F.substring(text, walk["at"] + 1, F.length(text)))).otherwise(text)


def entropy_spans(text: Column, free: Column) -> Column:
    """The spans the method adds: random candidates of a text whose base spans are blank (free)."""
    found = F.filter(_places(free, CANDIDATE), lambda x: _is_random(x["match"]))
    # Every kept candidate has a digit and a letter: most texts without both side by side in a run are spared.
    return F.when(text.rlike(CANDIDATE), F.transform(found, _span(3, ENTROPY))).otherwise(F.array().cast(_SPAN))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with base and spans: arrays of (start, rank, kind, stop) by start and kind; spans holds base too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = {f"_{kind}": base_spans(whole, kind) for kind in PATTERNS}
    found = documents.withColumns(kinds).withColumn("base", F.array_sort(F.concat(*kinds)))
    found = found.withColumn("_free", _without(whole, F.col("base")))
    found = found.withColumn("_entropy", entropy_spans(whole, F.col("_free")))
    return found.withColumn("spans", F.array_sort(F.concat("base", "_entropy"))).drop(*kinds, "_free", "_entropy")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(documents: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """documents with every span of their text replaced by a mark; overlapping spans by one. Null texts stay null."""
    # Other columns travel in one struct, whatever their names are.
    rows = documents.select(F.col(text).alias("text"), F.struct(*documents.columns).alias("row"))
    whole = F.col("text")
    walk = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.concat(s["out"], F.substring(whole, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"),
            )
        ),
    )
    clean = F.when(F.size("spans") > 0, F.concat(walk["out"], F.substring(whole, walk["at"] + 1, F.length(whole)))).otherwise(whole)
    found = scan(rows).withColumn("clean", clean)
    return found.select(*((F.col("clean") if c == text else F.col("row")[c]).alias(c) for c in documents.columns))
