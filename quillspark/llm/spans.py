"""Positions of regular-expression matches in code points, by built-in functions alone.

Spark returns matches without offsets. The text between two matches is what split() leaves, so a running sum over
pieces and matches gives each match its start and end, in time nearly linear in the matches. Patterns must not match the empty string. Nested repetition is
possessive where that changes nothing, as Java would otherwise recurse once for each repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Rows that are folded into one list. Appending copies a list, so a long fold makes lists of lists.
CHUNK = 128
#: start and end in code points, first and last in bytes (both ends exclusive).
SPAN = "struct<kind:string,start:long,end:long,match:string,first:long,last:long>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def fold(rows: Column, at: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """aggregate() with step over a struct of at and the list out, from at and the empty list none: the last at, and all of out.

    Nearly linear in the rows: chunks of CHUNK rows fill lists of their own.
    """

    def part(acc: Column, c: Column) -> Column:
        done = F.aggregate(F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    chunks = F.sequence(F.lit(0), F.ceil(F.size(rows) / CHUNK).cast("int"))
    return F.aggregate(chunks, F.struct(at.alias("at"), F.array(none).alias("out")), part, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def find(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches, as SPAN in order; match holds the given group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        piece, word = F.coalesce(x["p"], F.lit("")), F.coalesce(x["w"], F.lit(""))
        begin, first = acc["at"]["start"] + F.char_length(piece), acc["at"]["first"] + F.octet_length(piece)
        end, last = begin + F.char_length(word), first + F.octet_length(word)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("match"), first.alias("first"), last.alias("last"))
        more = F.when(x["w"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span.cast(SPAN)))
        return F.struct(F.struct(end.alias("start"), last.alias("first")).alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("first"))
    found = let(F.arrays_zip(whole.alias("w"), part.alias("m"), pieces.alias("p")), lambda rows: fold(rows, zero, no_spans(), step)["out"])
    return F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), found).otherwise(no_spans())


def between(data: Column, first: Column, last: Column) -> Column:
    """The bytes of a binary column from first to last, as text. Unlike substring() of a string it reads no others."""
    return F.substring(data, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).cast("string")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)
