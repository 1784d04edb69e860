r"""Information-theoretic sanitisation of personal data.

Base spans come from four patterns with checks (IPv4 parts, Luhn, digit counts). Each distinct
base value is a protected entity. Corpus co-occurrence then says how strongly the words of the
documents that name an entity reveal it: with document frequencies df over all N documents,
    PMI(e; t) = log2(N df(e, t) / (df(e) df(t))),   IC(e) = log2(N / df(e)),
and PMI / IC is the share of the entity's information that the term gives away (1: the term
occurs in its documents only). Terms at `generalise_at` or more are replaced by their class, at
`remove_at` or more they are removed, wherever they stand, also in documents without an entity.
An entity named once is given away by every word that no other document has.

Offsets are code points, end exclusive. Matching is leftmost and non-overlapping per kind and
a failing match is dropped without a retry. The patterns below are the contract's, made safe
for long runs: possessive, and a run that failed is not tried again from its middle (\G lets
a match begin where the last one ended).

Defined cases: a null text counts as empty (no spans); repeated rows each get the same spans;
documents without a base span get none; a null id is a value like any other; an empty table
gives an empty result. Other columns are kept by `sanitise` (a clashing `sanitised` or `spans`
column is replaced) and not read by `findings`.

Scale: term frequencies are counted as 64-bit hashes, combined map-side. A share of g or more
needs df(t) <= df(e)**g * N**(1 - g), so a document's other terms never meet its entities. Pairs of
entity and term are summed map-side, so an entity in a third of all documents is a few rows per
task; the joins are keyed by term, by (entity, term) or by document and are split by AQE.
Documents that hold a flagged term are found by a join and only they are searched for its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import folded
from .common import SPACE_CLASS, durable, let, text_of

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERMS = "array<struct<start:int,end:int,action:string>>"
#: What a term loses at its ends before it is counted.
EDGES = ".,;:!?()[]{}<>\"'*#$%&|…«»“”"


def occurrences(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value). Gaps and matches alternate, so their lengths add up
    to the offsets."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x.gap)
        end = begin + F.length(x.value)
        return end, F.array(F.struct(begin.alias("start"), end.alias("end"), x.value.alias("value")))

    return folded(F.filter(found, lambda x: x.value.isNotNull()), F.lit(0), step, "struct<start:int,end:int,value:string>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_ok(value: Column) -> Column:
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
    return F.forall(F.split(value, r"\."), part)


def _card_ok(value: Column) -> Column:
    def luhn(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (i % 2 + 1)
            return a + F.when(x > 9, x - 9).otherwise(x)

        return F.length(d).between(13, 19) & (F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0)

    return let(_digits(value), luhn)


def _phone_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start. The first test of each line is cheap and
    spares most documents the search."""
    parts = (
        ("email", text.contains("@"), EMAIL, None),
        ("ip", text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), IP, _ip_ok),
        ("card", text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), CARD, _card_ok),
        ("phone", text.contains("+"), PHONE, _phone_ok),
    )
    none = F.array().cast(SPAN)

    def of(kind: str, may: Column, pattern: str, ok) -> Column:
        found = occurrences(text, pattern)
        if ok:
            found = F.filter(found, lambda x: ok(x.value))
        return F.when(may, F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value")))).otherwise(none)

    return F.concat(*[of(*p) for p in parts])


def term_of(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGES))


COVER = "\x00"


def covered(text: Column, spans: Column) -> Column:
    """The text with every base span blotted out, at its own length."""
    # What lies beyond the last span is a span of nothing at the end.
    whole = F.length(text)
    ordered = F.sort_array(F.concat(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))), F.array(F.struct(whole.alias("start"), whole.alias("end")))))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = F.greatest(m.start, at)
        return F.greatest(m.end, at), F.array(F.substring(text, at + 1, begin - at), F.repeat(F.lit(COVER), F.greatest(m.end - begin, F.lit(0))))

    return F.array_join(folded(ordered, F.lit(0), step, "string"), "")


def row_of() -> Column:
    """A key of id and text."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), text_of()), 256)


def _doc() -> Column:
    return F.xxhash64(F.col("doc_id"), text_of())


def entities_of(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda s: F.xxhash64(s.kind, F.lower(s.value))))


def terms_of(text: Column) -> Column:
    """Hashes of the text's distinct terms, without words that a base span touches."""
    free = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: ~w.contains(COVER))
    return F.array_distinct(F.transform(F.filter(F.transform(free, term_of), lambda t: t != ""), lambda t: F.xxhash64(t)))


def places(text: Column, risky: Column) -> Column:
    """(start, end, action) of the words whose term is in risky, an array of (term, action)."""
    def of(names: Column, actions: Column) -> Column:
        def step(at: Column, word: Column) -> tuple[Column, Column]:
            end = at + F.length(word)
            free = (F.length(word) > 0) & ~word.contains(COVER)
            which = F.when(free, F.array_position(names, F.xxhash64(term_of(word)))).otherwise(F.lit(0).cast("long"))
            here = let(which, lambda w: F.when(w > 0, F.array(F.struct(at.alias("start"), end.alias("end"), F.get(actions, (w - 1).cast("int")).alias("action")))).otherwise(F.array().cast(TERMS)))
            return end + 1, here

        return folded(F.split(text, SPACE_CLASS, -1), F.lit(0), step, TERMS[6:-1])

    # Named first: a lambda would build both lists anew for each word.
    return let(F.transform(risky, lambda r: r.term), lambda names: let(F.transform(risky, lambda r: r.action), lambda actions: of(names, actions)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, row (a key of id and text), doc (the same as a hash)."""
    return docs.select("doc_id", base_spans(text_of()).alias("base"), row_of().alias("row"), _doc().alias("doc"))


def disclosures(scanned: DataFrame, docs: DataFrame, generalise_at: float) -> DataFrame:
    """(entity, term, share) of the terms that give away at least generalise_at of an entity."""
    total = float(scanned.count())
    named = scanned.filter(F.size("base") > 0).select("doc", F.explode(entities_of(F.col("base"))).alias("entity")).groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("copies"))
    named = durable(named, "pii-named")
    # No term seen more often can reach generalise_at, even if it stands beside each mention.
    bound = F.pow("named", F.lit(generalise_at)) * F.pow(F.lit(total), F.lit(1 - generalise_at)) * 1.000001
    entities = named.groupBy("entity").agg(F.sum("copies").alias("named")).filter(F.col("named") < total).withColumn("bound", bound)
    entities = durable(entities, "pii-entities")
    by_doc = named.join(entities, "entity").groupBy("doc").agg(F.collect_list(F.struct("entity", "named", "bound", "copies")).alias("es"), F.max("bound").alias("most"))
    by_doc = durable(by_doc, "pii-by-document")
    words = docs.select(F.explode(terms_of(text_of())).alias("term"))
    seen = words.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    cap = entities.agg(F.max("bound")).first()[0] or 0.0
    seen = durable(seen.filter(F.col("seen") <= cap), "pii-frequencies")
    some = docs.select(_doc().alias("doc"), F.explode(let(base_spans(text_of()), lambda b: F.when(F.size(b) > 0, terms_of(covered(text_of(), b))))).alias("term"))
    rare = some.join(seen, "term").distinct().join(by_doc, "doc").filter("seen <= most")
    pairs = rare.select("term", "seen", F.explode(F.filter("es", lambda e: e.bound >= F.col("seen"))).alias("e"))
    both = pairs.groupBy("e.entity", "term").agg(F.sum("e.copies").alias("both"), F.first("seen").alias("seen"), F.first("e.named").alias("named"))
    share = F.log2(total * F.least("both", "seen", "named") / (F.col("named") * F.col("seen"))) / F.log2(total / F.col("named"))
    return both.select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise_at)


def findings(docs: DataFrame, generalise_at: float = 0.85, remove_at: float = 0.97) -> DataFrame:
    """One row per document: doc_id, base (spans), terms (array of start, end, action), row (null
    without either)."""
    scanned = durable(scan(docs), "pii-scan")
    action = F.when(F.max("share") >= remove_at, "remove").otherwise("generalise")
    risky = durable(disclosures(scanned, docs, generalise_at).groupBy("term").agg(action.alias("action")), "pii-terms")
    holds = docs.select(_doc().alias("doc"), F.explode(terms_of(text_of())).alias("term")).join(risky, "term")
    holds = durable(holds.groupBy("doc").agg(F.collect_set(F.struct("term", "action")).alias("risky")), "pii-holders")
    text = let(F.col("text"), lambda t: covered(t, base_spans(t)))
    found = docs.select(_doc().alias("doc"), text_of().alias("text")).join(holds, "doc").select("doc", places(text, F.col("risky")).alias("terms"))
    found = found.dropDuplicates(["doc"])
    out = scanned.join(found, "doc", "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    return out.select("doc_id", "base", "terms", F.when((F.size("base") > 0) | (F.size("terms") > 0), F.col("row")).alias("row"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans, n_terms."""
    spell = lambda kind, s: F.concat_ws(":", kind, s.start.cast("string"), s.end.cast("string"))
    base = F.transform("base", lambda s: spell(s.kind, s))
    terms = F.transform("terms", lambda s: spell(F.lit("term"), s))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def _class(word: Column) -> Column:
    """The class that stands for a generalised term."""
    return F.when(word.rlike("^[^A-Za-z]*[0-9][^A-Za-z]*$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def rewrite(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans as [KIND], generalised terms as their class, removed terms gone.
    Of overlapping spans the one that begins first (then the longer) is rewritten."""
    cut = lambda s: F.substring(text, s.start + 1, s.end - s.start)
    marks = F.concat(
        F.transform(base, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), F.concat(F.lit("["), F.upper(s.kind), F.lit("]")).alias("by"))),
        F.transform(terms, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), F.when(s.action == "remove", "").otherwise(_class(cut(s))).alias("by"))),
    )
    whole = F.length(text)
    last = F.array(F.struct(whole.alias("start"), (-whole).alias("back"), F.lit("").alias("by")))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        taken = m.start >= at
        return F.when(taken, -m.back).otherwise(at), F.when(taken, F.array(F.substring(text, at + 1, m.start - at), m.by)).otherwise(F.array().cast("array<string>"))

    return F.array_join(folded(F.sort_array(F.concat(marks, last)), F.lit(0), step, "string"), "")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents' own columns plus sanitised (text) and spans (as the digest spells them)."""
    found = findings(docs, **options).filter("row IS NOT NULL").select(F.col("row").alias("__row"), F.struct("base", "terms").alias("__found")).dropDuplicates(["__row"])
    text, base, terms = text_of(), F.col("__found.base"), F.col("__found.terms")
    kept = [c for c in docs.columns if c not in ("sanitised", "spans")]
    at = lambda kind, s: F.concat_ws(":", kind, s.start.cast("string"), s.end.cast("string"))
    spell = F.array_join(F.concat(F.transform(base, lambda s: at(s.kind, s)), F.transform(terms, lambda s: at(F.lit("term"), s))), ",")
    joined = docs.select(*kept, row_of().alias("__row")).join(found, "__row", "left")
    return joined.select(*kept, F.when(F.col("__found").isNull(), text).otherwise(rewrite(text, base, terms)).alias("sanitised"), F.coalesce(spell, F.lit("")).alias("spans"))
