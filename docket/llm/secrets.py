r"""Secret scans: patterns of known secrets, and sliding-window Shannon entropy per character class.

Only built-in column expressions. Positions are code points, ends exclusive. The positions of all matches of a pattern
come from the pieces between them: the text split at the pattern and its matches alternate.

Kinds, in their order: `assign` (a keyword, a sign, a value of six or more characters; the span is the whole match),
`access`, `hex`, and `entropy`, the method's own: a maximal run of a class's characters in which some window of
the class's width has at least the class's entropy. Window entropies come from counts that are updated by the character
that enters and the one that leaves. A run is suppressed when an allow-list pattern matches it. The span of a run goes
from the start of its first window at the bound to the end of its last.

Work is in proportion to a text's length: a run is cut into characters once, positions and redacted stretches come from
running sums over blocks, and pieces of a text are cut from blocks of its characters.

Defined cases: a null text is empty; texts without candidates cost one pass of each guard; very long texts, runs of a
million characters and texts with 100,000 matches are scanned whole; repeated rows are judged each; an empty table gives
no rows; a column named `spans` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.quality import bound

#: The patterns of known secrets. The last two give the same spans as with `+` and a length test after.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
T_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,found:string>>"
KEYWORDS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class CharClass:
    """Characters of a candidate run (`inside`: for a bracket expression), window width and bits a character."""

    name: str
    inside: str
    alphabet: str
    width: int
    bits: float


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", "0-9a-fA-F", DIGITS + "abcdefABCDEF", 24, 3.2),
    CharClass("base64", "A-Za-z0-9+/_=-", UPPER + LOWER + DIGITS + "+/_=-", 24, 4.1),
)
#: Runs that look random but are no secrets: sample keys, alphabets in order, names of examples.
ALLOWED = (r"(?i)example", r"(?i)abcdefgh", r"01234567", r"(?i)(?:placeholder|changeme|xxxxxxxx)")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of `values`, an array of ints, all values so far combined.

    An array grows by a copy; so values are taken in blocks of about the root of their number, and what the blocks before
    come to is then combined into each.
    """

    def within(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(F.element_at(acc, -1), x)))

        return F.aggregate(block, F.array().cast("array<int>"), step)

    def cut(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), step)
        return F.transform(starts, lambda s: within(F.slice(v, s, step)))

    def with_before(blocks: Column) -> Column:
        ends = within(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(
            bound(
                ends,
                lambda e: F.transform(
                    blocks,
                    lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(e, i - 1), x))),
                ),
            )
        )

    some = bound(values, lambda v: bound(cut(v), with_before))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, order of the kind, kind, end, found) for the leftmost non-overlapping matches of `pattern`."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)

    def spans(both: Column) -> Column:
        sizes = F.transform(both["found"], lambda f, i: F.length(f) + F.length(F.get(both["pieces"], i)))
        return F.zip_with(
            running(sizes, lambda a, x: a + x),
            both["found"],
            lambda end, f: F.struct(
                (end - F.length(f)).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                F.lit(kind).alias("kind"),
                end.alias("end"),
                f.alias("found"),
            ),
        )

    all_of = bound(F.struct(pieces.alias("pieces"), found.alias("found")), spans)
    return F.filter(all_of, lambda s: keep(s["found"])) if keep else all_of


#: Counts of a window are packed: so many bits for each, so many in a number.
COUNT_BITS, PER_NUMBER = 5, 12


def hot_part(run: Column, c: CharClass) -> Column:
    """(first, last): starts of the first and last window of `run` whose entropy reaches the class's bound, or nulls.

    With n characters in a window and counts k, entropy is log2(n) - sum(k log2 k) / n. The sum changes by the two
    counts that change, taken from a table of k log2 k.
    """
    assert c.width < 1 << COUNT_BITS
    terms = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(c.width + 2)))
    most = c.width * (math.log2(c.width) - c.bits) + 1e-9
    none = F.lit(0).cast("long")
    begin = F.struct(
        F.array_repeat(none, len(c.alphabet) // PER_NUMBER + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def bit(place: Column) -> Column:
        return (place % PER_NUMBER * COUNT_BITS).cast("int")

    def number(place: Column) -> Column:
        return F.floor(place / PER_NUMBER).cast("int")

    def held(counts: Column, place: Column) -> Column:
        moved = F.call_function("shiftrightunsigned", F.get(counts, number(place)), bit(place))
        return moved.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def one(place: Column, j: Column) -> Column:
        """What one character at `place` adds to the number at j."""
        added = F.call_function("shiftleft", F.lit(1).cast("long"), bit(place))
        return F.when(number(place) == j, added).otherwise(none)

    def step(acc: Column, x: Column) -> Column:
        comes, goes = x["comes"], x["goes"]

        def moved(k: Column) -> Column:
            up, down = k["up"], k["down"]
            change = F.get(terms, up + 1) - F.get(terms, up)
            change += F.when(goes >= 0, F.get(terms, down - 1) - F.get(terms, down)).otherwise(F.lit(0.0))
            start = x["i"] - (c.width - 1)
            return bound(
                acc["sum"] + F.when(comes == goes, F.lit(0.0)).otherwise(change),
                lambda total: F.struct(
                    F.when(comes == goes, acc["counts"])
                    .otherwise(
                        F.transform(
                            acc["counts"],
                            lambda n, j: n + one(comes, j) - F.when(goes >= 0, one(goes, j)).otherwise(none),
                        )
                    )
                    .alias("counts"),
                    total.alias("sum"),
                    F.coalesce(acc["first"], F.when((start >= 0) & (total <= most), start)).alias("first"),
                    F.when((start >= 0) & (total <= most), start).otherwise(acc["last"]).alias("last"),
                ),
            )

        counts = F.struct(
            held(acc["counts"], comes).alias("up"),
            F.when(goes >= 0, held(acc["counts"], F.greatest(goes, F.lit(0)))).otherwise(F.lit(1)).alias("down"),
        )
        return bound(counts, moved)

    def walk(places: Column) -> Column:
        moves = F.transform(
            places,
            lambda p, i: F.struct(
                p.alias("comes"),
                F.when(i >= c.width, F.get(places, i - c.width)).otherwise(F.lit(-1)).alias("goes"),
                i.alias("i"),
            ),
        )
        return F.aggregate(moves, begin, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    places = F.transform(F.regexp_extract_all(run, F.lit("."), 0), lambda x: F.position(x, F.lit(c.alphabet)))
    return bound(places, walk)


def entropy_spans(text: Column, c: CharClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    pattern = f"(?<![{c.inside}])[{c.inside}]{{{c.width},}}"

    def odd(found: Column) -> Column:
        keep = F.lit(True)
        for p in allowed:
            keep &= ~found.rlike(p)
        return keep

    def cut(s: Column) -> Column:
        return bound(
            hot_part(s["found"], c),
            lambda h: F.struct(
                (s["start"] + h["first"]).alias("start"),
                F.lit(KINDS.index("entropy")).alias("rank"),
                F.lit("entropy").alias("kind"),
                (s["start"] + h["last"] + c.width).alias("end"),
                s["found"].alias("found"),
            ),
        )

    runs = F.filter(F.transform(matches(text, pattern, "entropy", odd), cut), lambda s: s["start"].isNotNull())
    return F.when(text.rlike(pattern), runs).otherwise(F.array().cast(T_SPANS))


def scan(documents: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """`documents` with `spans`: array of (start, rank, kind, end, found), by start, then kind, then end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(T_SPANS)
    lower = F.lower(text)
    named = F.lit(False)
    for k in KEYWORDS:
        named |= F.contains(lower, F.lit(k))

    def long_value(found: Column) -> Column:
        return F.length(F.regexp_extract(found, ASSIGN, 2)) >= 6

    def once(spans: Column) -> Column:
        return F.filter(spans, lambda s, i: (i == 0) | (s != F.get(spans, i - 1)))

    parts = [
        F.when(named, matches(text, ASSIGN, "assign", long_value)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")).otherwise(none),
        F.when(text.rlike(HEX), matches(text, HEX, "hex")).otherwise(none),
        *(entropy_spans(text, c, allowed) for c in CLASSES),
    ]
    return documents.withColumn("spans", bound(F.sort_array(F.concat(*parts)), once))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of these kinds as `kind:start:end`, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Characters of a block that pieces of a text are cut from.
BLOCK = 4096


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """`text` with each stretch that spans cover replaced by `mark`; overlapping spans are one stretch."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        """Characters from start to end: the end of the first block, the blocks between, the beginning of the last."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        after, upto = (start % BLOCK + 1).cast("int"), (end % BLOCK).cast("int")
        head = F.substring(F.get(blocks, first), after, F.lit(BLOCK))
        between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), upto), F.lit(""))
        inside = F.coalesce(F.substring(F.get(blocks, first), after, (end - start).cast("int")), F.lit(""))
        return F.when(first == last, inside).otherwise(F.concat(head, between, tail))

    def cut(x: Column) -> Column:
        def joined_up(far: Column) -> Column:
            def before(i: Column) -> Column:
                return F.when(i == 0, F.lit(0)).otherwise(F.get(far, i - 1))

            kept = F.transform(
                x["spans"],
                lambda s, i: F.when(
                    s["start"] >= before(i), F.concat(piece(x["blocks"], before(i), s["start"]), F.lit(mark))
                ).otherwise(F.lit("")),
            )
            rest = piece(x["blocks"], F.element_at(far, -1), x["size"])
            return F.concat(F.array_join(kept, ""), rest)

        ends = F.transform(x["spans"], lambda s: s["end"])
        return bound(running(ends, lambda a, b: F.greatest(a, b)), joined_up)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("blocks"),
        F.length(text).alias("size"),
        spans.alias("spans"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(bound(parts, cut))
