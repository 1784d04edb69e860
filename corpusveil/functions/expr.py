"""Column helpers that Spark has no single function for. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, at: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, part: int = 128) -> Column:
    """Runs step(at, item) -> (next at, array of outputs) over the items in order and gives all
    outputs as one array of `kind`. Long arrays go in two levels, since appending copies what is
    there: n items cost n * part + (n / part) ** 2 copies instead of n ** 2."""
    none = F.array().cast(f"array<{kind}>")

    def plain(some: Column, begin: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, more = step(a.at, x)
            return F.struct(after.alias("at"), F.concat(a.out, more.cast(f"array<{kind}>")).alias("out"))

        return F.aggregate(some, F.struct(begin.alias("at"), none.alias("out")), one)

    def in_parts(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / part).cast("int")), lambda i: F.slice(every, i * part + 1, F.lit(part)))
        start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        one = lambda a, some: let(plain(some, a.at), lambda r: F.struct(r.at.alias("at"), F.concat(a.outs, F.array(r.out)).alias("outs")))
        return F.flatten(F.aggregate(cut, start, one, lambda a: a.outs))

    return let(items, lambda x: F.when(F.size(x) <= part, plain(x, at).out).otherwise(in_parts(x)))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


MARK, STAND_IN = "\x00", "\x01"


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<start, end, text>>, code points, end exclusive.

    Matches are also replaced by a mark that the text is freed of first; the pieces between the
    marks and the matches alternate, so a running sum of their lengths gives the offsets. Both
    regex functions keep their compiled pattern, which split() by a regex does not; the second
    pass is left out where nothing matched. Null text gives null, no match an empty array."""

    def place(free: Column, found: Column) -> Column:
        gaps = F.split(F.regexp_replace(free, F.lit(pattern), F.lit(MARK)), MARK, -1)
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))

        def step(at: Column, p: Column) -> tuple[Column, Column]:
            begin = at + F.length(p.gap)
            end = begin + F.length(p.hit)
            return end, F.array(F.struct(begin.alias("start"), end.alias("end"), p.hit.alias("text")))

        return F.when(F.size(found) == 0, F.array().cast(MATCH)).otherwise(folded(pairs, F.lit(0), step, MATCH[6:-1]))

    free = F.replace(text, F.lit(MARK), F.lit(STAND_IN))
    return F.when(text.isNotNull(), let(free, lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: place(t, found))))


def title_case_caps(text: Column) -> Column:
    """Title case for words of two or more capitals; every other word as it is. Keeps length."""
    def word(w: Column) -> Column:
        return F.when(w.rlike("^[A-ZÁÉÍÓÚÑ]{2,}$"), F.concat(F.left(w, F.lit(1)), F.lower(F.right(w, F.length(w) - 1)))).otherwise(w)

    return F.array_join(F.transform(F.split(text, r"(?U)\b", -1), word), "")


def first_at(text: Column, part: Column) -> Column:
    return F.position(part, text) - 1


def last_at(text: Column, part: Column) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    back = F.position(F.reverse(part), F.reverse(text))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - F.length(part) + 1)


def replace_last(text: Column, part: Column, by: Column) -> Column:
    """The text with the last occurrence of part replaced; unchanged without one or for ''."""

    def at(place: Column) -> Column:
        return F.when((place < 0) | (F.length(part) == 0), text).otherwise(F.concat(F.left(text, place), by, F.substring(text, place + F.length(part) + 1, F.length(text))))

    return let(last_at(text, part), at)


def replace_first(text: Column, part: Column, by: Column) -> Column:
    """The text with the first occurrence of part replaced."""

    def at(place: Column) -> Column:
        return F.when((place < 0) | (F.length(part) == 0), text).otherwise(F.concat(F.left(text, place), by, F.substring(text, place + F.length(part) + 1, F.length(text))))

    return let(first_at(text, part), at)
