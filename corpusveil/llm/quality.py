"""Line-first cleaning rules.

Each line that holds a word is judged alone: navigation (a bar, arrow or bullet between at
least a third of its words), boilerplate (a fixed phrase in a short line), punctuation
(decorated or shouted words, or a long line without any mark). Failing lines are removed;
a document that loses more than `max_loss` of its word characters is rejected. The base
rules (too few words, too much of the text in repeated windows) reject first.

Defined cases: a null or blank text has no words, fails the base rule and is rejected; lines
without a word are kept as they are and never judged; repeated rows are judged alike; an empty
table gives an empty result. Columns other than doc_id and text are not read by `quality`;
`clean` keeps all of them, with the cleaned text in place of the text.

Scale: one narrow pass, no shuffle. Windows are compared as chained 64-bit hashes inside the
row; rows whose windows are all different stop there, the others sort their own windows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, text_of, without_space, words_of

#: Phrases of site furniture, matched in lower case in lines of at most 12 words.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "subscribe to our newsletter",
    "sign up for",
    "skip to content",
    "back to top",
    "share on facebook",
    "follow us on",
    "todos los derechos reservados",
    "política de cookies",
    "política de privacidad",
    "aviso legal",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "conditions d’utilisation",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
)
SYMBOLS = r"[#*$%&|<>]"
BARS = r"[|»›→•]"
SPECIAL = r"[|»›→•#*$%&<>!]"
MARKS = r"[.,;:!?…。！？、،]"


def line_fails(line: Column) -> Column:
    def judged(n: Column) -> Column:
        bars = F.regexp_count(line, F.lit(BARS))
        navigation = (bars >= 3) & (bars * 3 >= n)
        phrase = let(F.lower(line), lambda low: reduce(or_, [low.contains(x) for x in BOILERPLATE]))
        boilerplate = (n <= 12) & phrase
        decorated = F.regexp_count(line, F.lit(SYMBOLS)) > n
        shouted = (n >= 4) & (F.regexp_count(line, F.lit("!!")) * 2 >= n)
        unmarked = (n >= 40) & ~line.rlike(MARKS)
        # One scan clears ordinary lines of the three rules that count special characters.
        return (line.rlike(SPECIAL) & (navigation | decorated | shouted)) | boilerplate | unmarked

    return let(F.regexp_count(line, F.lit(WORD)), judged)


def windows_of(hashes: Column, width: int) -> Column:
    """A chained hash of each window of `width` words, from the words' own hashes."""
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    # get() reads in place; slice() would copy the whole array for every window.
    return F.when(F.size(hashes) >= width, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(ordered: Column, width: int) -> Column:
    """ordered: (hash, position) sorted. Words under windows whose hash a neighbour shares."""
    same = lambda k, j: F.get(ordered, k).h == F.get(ordered, j).h
    shared = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.coalesce((k > 0) & same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    at = F.sort_array(F.transform(shared, lambda k: F.get(ordered, k).i))
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(at, start, lambda a, p: F.struct((a.n + F.least(F.lit(width), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)


def judge(text: Column, min_words: int = 20, max_repeat: int = 30, max_loss: int = 50, width: int = 8) -> Column:
    """The verdict on one text as a struct, every part of it computed once."""

    def repeats(hashes: Column) -> Column:
        def of(windows: Column) -> Column:
            ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, lambda o: _covered(o, width))).otherwise(0)

        return let(windows_of(hashes, width), of)

    counts = let(words_of(text), lambda words: F.struct(F.size(words).alias("n"), let(F.transform(words, lambda w: F.xxhash64(w)), repeats).alias("again")))

    def by_line(lines: Column) -> Column:
        of = lambda rows: F.transform(rows, lambda x: x.line)
        dup = let(of(F.filter(lines, lambda x: x.worded)), lambda worded: F.size(worded) - F.size(F.array_distinct(worded)))
        cleaned = F.array_join(of(F.filter(lines, lambda x: ~x.fails)), "\n")

        def lost(failing: Column) -> Column:
            chars = F.length(without_space(F.array_join(of(failing), "")))
            return F.struct(dup.alias("dup"), F.size(failing).alias("removed"), chars.alias("lost"), F.when(F.size(failing) > 0, cleaned).otherwise(text).alias("cleaned"))

        return let(F.filter(lines, lambda x: x.fails), lost)

    worded = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), x.rlike(WORD).alias("worded")))
    lines = F.transform(worded, lambda x: F.struct(x.line.alias("line"), x.worded.alias("worded"), (x.worded & line_fails(x.line)).alias("fails")))

    def verdict(c: Column, line: Column, chars: Column) -> Column:
        base = (c.n < min_words) | (100 * c.again > max_repeat * c.n)
        return F.struct(
            c.n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            line.dup.cast("long").alias("n_dup_lines"),
            c.again.cast("long").alias("n_repeat_words"),
            line.removed.cast("long").alias("n_removed_lines"),
            line.lost.cast("long").alias("lost_chars"),
            base.alias("base_failed"),
            (~base & (100 * line.lost <= max_loss * chars)).alias("kept"),
            line.cleaned.alias("cleaned"),
        )

    return let(counts, lambda c: let(let(lines, by_line), lambda line: let(F.length(without_space(text)), lambda chars: verdict(c, line, chars))))


def quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **rules: int) -> DataFrame:
    """One row per document: doc_id, the base counts, n_removed_lines and lost_chars (failing lines
    and their word characters), base_failed, kept, cleaned (the text without its failing lines)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(judge(text_of(text_col), **rules))))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(*[c for c in judged.columns if c != "cleaned"], F.sha2("cleaned", 256).alias("cleaned_sha256"))


def clean(docs: DataFrame, text_col: str = "text", **rules: int) -> DataFrame:
    """The documents that pass, in their own columns, their texts without the failing lines."""
    judged = docs.select("*", F.inline(F.array(F.struct(judge(text_of(text_col), **rules).alias("__judged")))))
    return judged.filter("__judged.kept").select(*[F.col("__judged.cleaned").alias(c) if c == text_col else F.col(c) for c in docs.columns])
