"""Text PII detection as column expressions.

Every recognizer maps a text to array<struct<entity, recognizer, start, end, text, score>>.
They run on the title-cased text (of the same length), offsets cut the original. Then, in
order: context boost, score threshold, containment dedup per entity type, person filter.

Nothing here shuffles: the whole chain is one projection, and only the recognizers that the
level needs are part of the plan. Each recognizer has a cheap test ahead of its pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SanitizeConfig
from ..functions import fixed
from ..functions.checksum import iban_valid, nif_valid
from ..functions.expr import any_of, find_all, let, title_case_caps

FINDINGS = "array<struct<entity:string,recognizer:string,start:int,end:int,text:string,score:double>>"


@dataclass(frozen=True)
class Recognizer:
    """A pattern with a score. may: a cheap necessary condition on the text; valid: a check of
    the match, whose passing is certain (score 1) and whose failing drops it."""

    entity: str
    name: str
    pattern: str
    score: float
    may: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None

    def find(self, text: Column) -> Column:
        hits = find_all(text, self.pattern)
        if self.valid:
            hits = F.filter(hits, lambda h: self.valid(h.text))
        score = 1.0 if self.valid else self.score
        made = F.transform(hits, lambda h: F.struct(F.lit(self.entity).alias("entity"), F.lit(self.name).alias("recognizer"), h.start.alias("start"), h.end.alias("end"), h.text.alias("text"), F.lit(score).alias("score")))
        return F.when(self.may(text), made).otherwise(F.array().cast(FINDINGS))


def _digits(n: int) -> Callable[[Column], Column]:
    return lambda t: t.rlike(rf"\d{{{n}}}")


def _iban_like(t: Column) -> Column:
    return t.rlike(r"(?i)ES\s?\d{2}")


#: The e-mail pattern, made linear: the first part is possessive, and a run of its characters is
#: not tried again from its middle (\G lets a match begin where the last one ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + fixed.EMAIL.replace("]+@", "]++@")

RECOGNIZERS = (
    Recognizer("PERSON", "ES_PERSON_INVERTED", fixed.PERSON_INVERTED, 0.7, lambda t: t.contains(",")),
    Recognizer("PERSON", "ES_PERSON_STRUCTURED", fixed.PERSON_STRUCTURED, 0.95, lambda t: t.rlike("(?i)APELLIDO") & t.rlike("(?i)NOMBRE")),
    Recognizer("ES_NIF", "ES_NIF", fixed.NIF, 0.5, _digits(7), nif_valid),
    Recognizer("ES_NIE", "ES_NIE", fixed.NIE, 0.5, _digits(7), nif_valid),
    Recognizer("EMAIL_ADDRESS", "EMAIL", EMAIL, 0.5, lambda t: t.contains("@"), lambda v: F.lit(True)),
    Recognizer("PHONE_NUMBER", "ES_PHONE_INTL", fixed.PHONE_INTL, 0.7, lambda t: t.contains("+34")),
    Recognizer("PHONE_NUMBER", "ES_PHONE_LOCAL", fixed.PHONE_LOCAL, 0.5, _digits(3)),
    Recognizer("IBAN_CODE", "ES_IBAN_FULL", fixed.IBAN_FULL, 0.9, _iban_like),
    Recognizer("IBAN_CODE", "ES_IBAN_LABELED", fixed.IBAN_LABELED, 0.85, _iban_like),
    Recognizer("IBAN_CODE", "ES_IBAN_MASKED", fixed.IBAN_MASKED, 0.7, _iban_like),
    Recognizer("IBAN_CODE", "IBAN", fixed.IBAN_ANY, 0.5, lambda t: t.rlike(r"[A-Z]{2}\d{2}"), iban_valid),
    Recognizer("ES_DATE_OF_BIRTH", "ES_DATE_OF_BIRTH", fixed.DATE, 0.3, lambda t: t.rlike(r"\d[/\-.\s]\d")),
    Recognizer("ES_ADDRESS", "ES_ADDRESS_FULL", fixed.ADDRESS_FULL, 0.5, lambda t: t.rlike(r"\d")),
    Recognizer("ES_ADDRESS", "ES_ADDRESS_POSTAL_CITY", fixed.POSTAL_CITY, 0.4, _digits(5)),
)
BY_NAME = {r.name: r for r in RECOGNIZERS}


def entities_of(level: str) -> tuple[str, ...]:
    return fixed.STRICT if level == "strict" else fixed.STANDARD


def near_context(text: Column, start: Column, words: tuple[str, ...], tokens: int) -> Column:
    """Whether one of the words is part of the last `tokens` tokens before the place."""
    split = lambda low: F.regexp_extract_all(F.lower(F.substring(text, low + 1, start - low)), F.lit(r"(?U)\S+"), F.lit(0))
    low = F.greatest(start - 40 * tokens, F.lit(0))
    # A short piece before the place has enough tokens as a rule; else all that stands before it.
    before = let(split(low), lambda b: F.when((F.size(b) > tokens) | (low == 0), b).otherwise(split(F.lit(0))))
    last = let(before, lambda b: F.array_join(F.slice(b, F.greatest(F.size(b) - tokens + 1, F.lit(1)), F.lit(tokens)), " "))
    return let(last, lambda s: any_of([s.contains(w) for w in words]))


def boosted(found: Column, text: Column, cfg: SanitizeConfig) -> Column:
    """Scores raised where a context word of the entity stands before the match."""

    def one(f: Column) -> Column:
        near = F.lit(False)
        for entity, words in fixed.CONTEXT.items():
            near = F.when(f.entity == entity, near_context(text, f.start, words, cfg.context_tokens)).otherwise(near)
        raised = F.least(F.greatest(f.score + cfg.context_boost, F.lit(cfg.context_floor)), F.lit(1.0))
        return f.withField("score", F.when(near, F.round(raised, 2)).otherwise(f.score))

    return F.transform(found, one)


def without_contained(found: Column) -> Column:
    """Per entity type: by falling score, rising start, falling length, what lies inside a kept
    finding goes. Types may overlap each other."""
    rank = F.transform(found, lambda f: F.struct((-f.score).alias("s"), f.start.alias("a"), (f.start - f.end).alias("n"), f.recognizer.alias("r"), f.alias("f")))

    def step(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda k: (k.entity == x.f.entity) & (k.start <= x.f.start) & (k.end >= x.f.end))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x.f)))

    return F.aggregate(F.sort_array(rank), F.array().cast(FINDINGS), step)


def person_tokens(text: Column) -> Column:
    """Words of a name without the marks around them and without form labels."""
    bare = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(",.|")))
    return F.filter(bare, lambda w: (w != "") & ~F.lower(w).isin(*fixed.PERSON_LABELS))


def plausible_person(text: Column) -> Column:
    """Two to four tokens, none of them jargon or a stop word."""
    refused = F.array(*map(F.lit, dict.fromkeys((*fixed.PERSON_DENIED, *fixed.STOP_WORDS))))
    return let(person_tokens(text), lambda t: F.size(t).between(2, 4) & ~F.arrays_overlap(F.transform(t, F.lower), refused))


def finding_type(entity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in fixed.ENTITY_MAP.items() for x in kv]), entity)


def detect(text: Column, cfg: SanitizeConfig = SanitizeConfig()) -> Column:
    """Findings of one text, by start: array<struct<entity_type, recognizer, start, end,
    original_text, score>>. Null and blank texts have none."""
    wanted = [r for r in RECOGNIZERS if r.entity in entities_of(cfg.level)]

    def run(cased: Column) -> Column:
        raw = F.concat(*[r.find(cased) for r in wanted])
        own = let(raw, lambda x: F.filter(boosted(x, cased, cfg), lambda f: f.score >= cfg.score_threshold))
        return let(own, without_contained)

    def shaped(found: Column) -> Column:
        cut = F.transform(
            found,
            lambda f: F.struct(
                f.start.alias("start"), f.end.alias("end"), finding_type(f.entity).alias("entity_type"), f.recognizer.alias("recognizer"), F.substring(text, f.start + 1, f.end - f.start).alias("original_text"), f.score.alias("score")
            ),
        )
        real = F.filter(cut, lambda f: (f.entity_type != "PERSON_NAME") | plausible_person(f.original_text))
        return F.sort_array(real)

    return F.when(F.btrim(text) == "", F.array().cast("array<struct<start:int,end:int,entity_type:string,recognizer:string,original_text:string,score:double>>")).otherwise(let(let(title_case_caps(text), run), shaped))


def with_findings(df: DataFrame, cfg: SanitizeConfig = SanitizeConfig(), text_col: str = "text") -> DataFrame:
    """df plus a column `findings`, kept nested so that nothing is shuffled."""
    return df.withColumn("findings", detect(F.col(text_col), cfg))


def findings_table(df: DataFrame, cfg: SanitizeConfig = SanitizeConfig(), text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per finding: key, seq, entity_type, recognizer, original_text, score, start, end."""
    return df.select(key, F.posexplode(detect(F.col(text_col), cfg)).alias("seq", "f")).select(key, "seq", "f.entity_type", "f.recognizer", "f.original_text", "f.score", "f.start", "f.end")
