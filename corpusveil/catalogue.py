"""The query catalogue: every operator over the given tables, with the same rows in DuckDB SQL.

The tables hold little personal data, so most queries run on a corpus made from customer keys:
one text per customer with a name, a NIF, phones, an IBAN, an e-mail address, a birth date and
an address, all computed from the key in SQL that both engines read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SanitizeConfig, lenient_config, parse_entities
from .functions import checksum, expr, fixed
from .operators import access, detect, limiter, merge, pixels, redact, report, spans, visual
from .plans.engine import Engine, register_views
from .sources import formats, html, parsers, png, providers, samples, tabular
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the synthesized corpus ---------------------------------------------------------------


def pieces(string: str, wide: str) -> str:
    """SELECT list over customer (as c) in either dialect."""
    k = f"CAST(c_custkey AS {string})"
    bban = f"lpad({k}, 20, '0')"
    check = f"lpad(CAST(98 - CAST(CAST({bban} || '142800' AS {wide}) % 97 AS INT) AS {string}), 2, '0')"
    flat = f"'ES' || {check} || {bban}"
    digits = f"lpad(CAST((c_custkey * 7919) % 100000000 AS {string}), 8, '0')"
    return f"""
    c_custkey AS k,
    CASE c_custkey % 4 WHEN 0 THEN 'GARCIA LOPEZ, MARIA' WHEN 1 THEN 'Perez Ruiz, Juan Carlos' WHEN 2 THEN 'SEGURO GENERAL, ANA' ELSE 'Torres Vega, Luis' END AS name,
    lpad({k}, 8, '0') || substr('{fixed.NIF_LETTERS}', CAST((c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 23 + 1 AS INT), 1) AS nif,
    substr('XYZ', CAST(c_custkey % 3 + 1 AS INT), 1) || lpad({k}, 7, '0') || substr('{fixed.NIF_LETTERS}', CAST(((c_custkey % 3) * 10000000 + c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) % 23 + 1 AS INT), 1) AS nie,
    '+34 6' || substr({digits}, 1, 2) || ' ' || substr({digits}, 3, 3) || ' ' || substr({digits}, 6, 3) AS mobile,
    '9' || {digits} AS landline,
    {flat} AS iban,
    substr({flat}, 1, 4) || ' ' || substr({flat}, 5, 4) || ' ' || substr({flat}, 9, 4) || ' ' || substr({flat}, 13, 4) || ' ' || substr({flat}, 17, 4) || ' ' || substr({flat}, 21, 4) AS iban_spaced,
    'user' || {k} || '@example.com' AS email,
    lpad(CAST(c_custkey % 28 + 1 AS {string}), 2, '0') || '/' || lpad(CAST(c_custkey % 12 + 1 AS {string}), 2, '0') || '/' || CAST(1950 + c_custkey % 50 AS {string}) AS born"""


SPARK_PIECES, DUCK_PIECES = pieces("STRING", "DECIMAL(38,0)"), pieces("VARCHAR", "HUGEINT")
BODY = "'Titular: ' || name || '; DNI: ' || nif || ' Tel: ' || mobile || ' cuenta IBAN: ' || iban_spaced || ' Email: ' || email || ' nacido: ' || born"
CORPUS = f"WITH p AS (SELECT {DUCK_PIECES} FROM customer), t AS (SELECT *, {BODY} AS text FROM p)"


def corpus(spark: SparkSession, sf_dir: str, body: str = BODY) -> DataFrame:
    # Keys are few and their texts cost far more than they do, so they are dealt out first.
    made = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism).selectExpr(*_split_select(SPARK_PIECES))
    return made.withColumn("text", F.expr(body))


def _split_select(select: str) -> list[str]:
    return [x.strip().rstrip(",") for x in select.strip().split("\n")]


def re2(pattern: str) -> str:
    """The JVM's pattern as DuckDB reads it; the same on ASCII text."""
    return pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace(r"[^\S\n]", r"[\t\r\f\v ]").replace("'", "''")


def found_sql(source: str, key: str, pattern: str, prelude: str = "") -> str:
    """Rows (key, start, end, text) of a pattern, from gaps and matches."""
    p = re2(pattern)
    return f"""{prelude or "WITH"}{"," if prelude else ""} m AS (SELECT {key}, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM {source}),
    x AS (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
    y AS (SELECT {key}, hits[i] AS text, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start FROM x)
    SELECT {key}, start, start + length(text) AS "end", text FROM y"""


def found(df: DataFrame, key: str, pattern: str) -> DataFrame:
    hit = df.select(key, F.explode(expr.find_all(F.col("text"), pattern)).alias("m"))
    return hit.select(key, F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.text")


def pattern_query(name: str, pattern: str, body: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(corpus(spark, sf_dir, body), "k", pattern)

    run.__name__ = name
    query(found_sql("t", "k", pattern, f"WITH p AS (SELECT {DUCK_PIECES} FROM customer), t AS (SELECT *, {body} AS text FROM p)"))(run)


# --- flagship and text functions ----------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    each = detect.with_findings(docs, SanitizeConfig(level="strict")).select("lang", F.explode("findings").alias("f"))
    return each.groupBy("lang", "f.entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    CORPUS
    + " SELECT k, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{2,}[,:;]?$') THEN substr(w, 1, 1) || lower(substr(w, 2)) ELSE w END), ' ') AS cased FROM t"
)
def q_title_case(spark, sf_dir):
    return corpus(spark, sf_dir).select("k", expr.title_case_caps(F.col("text")).alias("cased"))


@query(found_sql("documents", "doc_id", fixed.EMAIL))
def q_email_findings(spark, sf_dir):
    hits = detect.BY_NAME["EMAIL"].find(F.col("text"))
    hit = table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("m"))
    return hit.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.text")


@query(f"SELECT lang, count(*) AS docs, sum(len(regexp_extract_all(text, '{fixed.EMAIL}')))::BIGINT AS emails FROM documents GROUP BY lang")
def q_email_by_lang(spark, sf_dir):
    hits = F.size(F.regexp_extract_all("text", F.lit(detect.EMAIL), F.lit(0)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("text").contains("@"), hits).otherwise(0)).alias("emails"))


@query("SELECT c_custkey AS k, CAST(length(s) - strpos(reverse(s), reverse('0')) AS BIGINT) AS last_at, CAST(strpos(s, '0') - 1 AS BIGINT) AS first_at FROM (SELECT c_custkey, c_name AS s FROM customer)")
def q_find_places(spark, sf_dir):
    s = F.col("c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), expr.last_at(s, F.lit("0")).cast("long").alias("last_at"), expr.first_at(s, F.lit("0")).cast("long").alias("first_at"))


# --- recognizers --------------------------------------------------------------------------

pattern_query("q_phone_intl", fixed.PHONE_INTL, "'Tel: ' || mobile || ' o ' || replace(mobile, ' ', '-') || '.'")
pattern_query("q_phone_local", fixed.PHONE_LOCAL, "'Llamar al ' || landline || ' o 6' || substr(landline, 2, 2) || ' ' || substr(landline, 4, 3) || ' ' || substr(landline, 7, 3)")
pattern_query("q_iban_full", fixed.IBAN_FULL, "'IBAN ' || iban_spaced || ' y ' || lower(iban) || ' fin'")
pattern_query("q_iban_labeled", fixed.IBAN_LABELED, "'mi IBAN: ' || iban_spaced || ' fin'")
pattern_query("q_iban_masked", fixed.IBAN_MASKED, "'cuenta ' || substr(iban_spaced, 1, 14) || ' **** **' || substr(iban, 23, 2) || ' y ' || substr(iban_spaced, 1, 14) || ' 1234XXXX'")
pattern_query("q_postal_city", fixed.POSTAL_CITY, "'CP ' || lpad(substr(landline, 2, 5), 5, '0') || ' Madrid (Comunidad)'")
pattern_query("q_address_full", fixed.ADDRESS_FULL, "'Vive en Calle Mayor de la Villa ' || CAST(k % 300 AS INT) || ', 3, 280' || substr(landline, 2, 2) || ' Madrid'")
pattern_query("q_person_structured", fixed.PERSON_STRUCTURED, "'APELLIDOS' || chr(10) || replace(name, ',', '') || chr(10) || 'NOMBRE' || chr(10) || 'ANA' || chr(10) || '123'")
pattern_query("q_dob_raw", fixed.DATE, "'El ' || born || ' y el ' || replace(born, '/', '-')")


def _plain(text: str) -> str:
    r"""The text for a pattern engine whose \b and \s know ASCII only, at the same length: accented
    letters of the pattern bare, all other letters, marks and digits as 0, all blanks as one."""
    bare = f"translate({text}, 'ÁÉÍÓÚÑáéíóúñ', 'AEIOUNaeioun')"
    blank = rf"regexp_replace({bare}, '[\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"
    # RE2 has no intersection of classes: ASCII goes through both replacements unharmed.
    return rf"regexp_replace({blank}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{M}}]|[^\x00-\x7F\P{{N}}]', '0', 'g')"


@query(
    f"WITH d AS (SELECT doc_id, text AS raw, {_plain('text')} AS text FROM documents), f AS ("
    + found_sql("d", "doc_id, raw", fixed.PERSON_INVERTED.replace("ÁÉÍÓÚÑ", "").replace("áéíóúñ", ""))
    + ') SELECT doc_id, start, "end", substr(raw, start + 1, "end" - start) AS text FROM f'
)
def q_person_inverted(spark, sf_dir):
    return found(table(spark, sf_dir, "documents"), "doc_id", fixed.PERSON_INVERTED)


@query(CORPUS + ", v AS (SELECT k, nif, substr('" + fixed.NIF_LETTERS + "', CAST(CAST(substr(nif, 1, 8) AS BIGINT) % 23 + 1 AS INT), 1) = substr(nif, 9, 1) AS valid FROM t) SELECT * FROM v")
def q_nif_valid(spark, sf_dir):
    return corpus(spark, sf_dir).select("k", "nif", checksum.nif_valid(F.col("nif")).alias("valid"))


@query(CORPUS + " SELECT k, nie, substr('" + fixed.NIF_LETTERS + "', CAST(CAST(translate(substr(nie, 1, 1), 'XYZ', '012') || substr(nie, 2, 7) AS BIGINT) % 23 + 1 AS INT), 1) = substr(nie, 9, 1) AS valid FROM t")
def q_nie_valid(spark, sf_dir):
    return corpus(spark, sf_dir).select("k", "nie", checksum.nif_valid(F.col("nie")).alias("valid"))


@query(
    CORPUS
    + ", b AS (SELECT k, CASE WHEN k % 3 = 0 THEN substr(iban, 1, 23) || CAST((CAST(substr(iban, 24, 1) AS INT) + 1) % 10 AS VARCHAR) ELSE iban END AS iban FROM t) SELECT k, iban, CAST(substr(iban, 5) || '1428' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM b"
)
def q_iban_mod97(spark, sf_dir):
    spoilt = F.expr("CASE WHEN k % 3 = 0 THEN substr(iban, 1, 23) || CAST((CAST(substr(iban, 24, 1) AS INT) + 1) % 10 AS STRING) ELSE iban END")
    return corpus(spark, sf_dir).select("k", spoilt.alias("iban")).withColumn("valid", checksum.iban_valid(F.col("iban")))


def _detected(spark, sf_dir, level="standard", body=BODY):
    return detect.findings_table(corpus(spark, sf_dir, body), SanitizeConfig(level=level), key="k").select("k", "entity_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "original_text", "score")


EXPECTED = """, e AS (
  SELECT k, text, 'PERSON_NAME' AS entity_type, name AS original_text, 1.0 AS score, 9 AS start FROM t WHERE k % 4 <> 2
  UNION ALL SELECT k, text, 'DNI_NIE', nif, 1.0, strpos(text, nif) - 1 FROM t WHERE k % 7 <> 0
  UNION ALL SELECT k, text, 'PHONE', mobile, 1.0, strpos(text, mobile) - 1 FROM t
  UNION ALL SELECT k, text, 'IBAN', 'IBAN: ' || iban_spaced, 1.0, strpos(text, 'IBAN:') - 1 FROM t
  UNION ALL SELECT k, text, 'EMAIL', email, 1.0, strpos(text, email) - 1 FROM t
  UNION ALL SELECT k, text, 'DATE_OF_BIRTH', born, 0.65, strpos(text, born) - 1 FROM t)"""


@query(CORPUS + EXPECTED + ' SELECT k, entity_type, CAST(start AS BIGINT) AS start, CAST(start + length(original_text) AS BIGINT) AS "end", original_text, CAST(score AS DOUBLE) AS score FROM e')
def q_detect_standard(spark, sf_dir):
    """The whole chain: patterns, context boost, threshold, containment, person filter. With
    `cuenta` before it the labelled IBAN match reaches the top score and holds the others."""
    return _detected(spark, sf_dir)


@query(
    CORPUS
    + """ SELECT k, CAST(3 AS BIGINT) AS start, 'IBAN: ' || iban_spaced AS original_text, CAST(0.85 AS DOUBLE) AS score FROM t
  UNION ALL SELECT k, 9, iban_spaced, 1.0 FROM t"""
)
def q_iban_label_survives(spark, sf_dir):
    """Without context before the label, the longer match scores lower and is not contained."""
    return _detected(spark, sf_dir, body="'mi IBAN: ' || iban_spaced || ' fin'").select("k", "start", "original_text", "score")


@query(CORPUS + " SELECT entity_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'DATE_OF_BIRTH' AS entity_type, count(*) FILTER (WHERE k % 2 = 0) AS n FROM t) GROUP BY entity_type")
def q_dob_context(spark, sf_dir):
    body = "CASE WHEN k % 2 = 0 THEN 'fecha nacimiento: ' ELSE 'fecha de pago: ' END || born"
    return _detected(spark, sf_dir, body=body).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (SELECT 'standard' AS level, unnest(['DATE_OF_BIRTH','DNI_NIE','EMAIL','IBAN','PERSON_NAME','PHONE']) AS entity_type UNION ALL SELECT 'strict', unnest(['ADDRESS','DATE_OF_BIRTH','DNI_NIE','EMAIL','IBAN','PERSON_NAME','PHONE']))")
def q_level_entities(spark, sf_dir):
    body = BODY + " || '. domicilio Calle Mayor 15'"
    both = [_detected(spark, sf_dir, level, body).select(F.lit(level).alias("level"), "entity_type") for level in fixed.LEVELS]
    return both[0].unionByName(both[1]).distinct()


@query("SELECT unnest(['PERSON','ES_NIF','ES_NIE','EMAIL_ADDRESS','PHONE_NUMBER','IBAN_CODE','ES_ADDRESS','ES_DATE_OF_BIRTH']) AS entity, unnest(['PERSON_NAME','DNI_NIE','DNI_NIE','EMAIL','PHONE','IBAN','ADDRESS','DATE_OF_BIRTH']) AS entity_type")
def q_entity_map(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed.ENTITY_MAP))).alias("entity"))
    return names.withColumn("entity_type", detect.finding_type(F.col("entity")))


@query(
    CORPUS
    + """, n AS (SELECT k, CASE k % 6 WHEN 0 THEN name WHEN 1 THEN 'APELLIDOS' || chr(10) || 'Ruiz' || chr(10) || 'NOMBRE' || chr(10) || 'Ana' WHEN 2 THEN 'Ana' WHEN 3 THEN 'Maria de Lopez' WHEN 4 THEN 'Uno Dos Tres Cuatro Cinco' ELSE 'Condiciones, Ana' END AS person FROM t)
    SELECT k, person, CASE k % 6 WHEN 0 THEN strpos(person, 'SEGURO') = 0 WHEN 1 THEN true ELSE false END AS kept FROM n"""
)
def q_person_filter(spark, sf_dir):
    person = F.expr(r"CASE k % 6 WHEN 0 THEN name WHEN 1 THEN 'APELLIDOS\nRuiz\nNOMBRE\nAna' WHEN 2 THEN 'Ana' WHEN 3 THEN 'Maria de Lopez' WHEN 4 THEN 'Uno Dos Tres Cuatro Cinco' ELSE 'Condiciones, Ana' END")
    return corpus(spark, sf_dir).select("k", person.alias("person")).withColumn("kept", detect.plausible_person(F.col("person")))


@query("""SELECT CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end", entity, kept FROM (VALUES
  (0, 10, 'A', true), (2, 8, 'A', false), (2, 8, 'B', true), (5, 15, 'A', true), (0, 10, 'C', false), (0, 12, 'C', true)) v(a, b, entity, kept)""")
def q_dedup_contained(spark, sf_dir):
    """Of one type the better score wins over what it contains; types do not touch each other."""
    rows = [("A", 0, 10, 0.9), ("A", 2, 8, 0.9), ("B", 2, 8, 0.5), ("A", 5, 15, 0.5), ("C", 0, 10, 0.5), ("C", 0, 12, 0.6)]
    made = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit("r").alias("recognizer"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("text"), F.lit(s).alias("score")) for e, a, b, s in rows])
    both = spark.range(1).select(made.alias("all"), detect.without_contained(made).alias("kept"))
    each = both.select(F.explode("all").alias("f"), "kept")
    return each.select(F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.entity", F.exists("kept", lambda k: k == F.col("f")).alias("kept"))


# --- named-entity layer -------------------------------------------------------------------


def _labels(alias: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.LABELS.items())
    return f"CASE lower({alias}) {cases} ELSE 'SENSITIVE_DATA' END"


@query(f"SELECT p_partkey AS k, label, {_labels('label')} AS entity_type FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Person' WHEN 1 THEN 'phone number' WHEN 2 THEN 'IP address' WHEN 3 THEN 'pet name' ELSE 'iban' END AS label FROM part)")
def q_label_map(spark, sf_dir):
    label = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Person' WHEN 1 THEN 'phone number' WHEN 2 THEN 'IP address' WHEN 3 THEN 'pet name' ELSE 'iban' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), label.alias("label")).withColumn("entity_type", merge.label_type(F.col("label")))


def _finding(entity, text, score):
    return F.struct(F.lit(entity).alias("entity_type"), text.alias("original_text"), score.cast("double").alias("score"))


@query("""SELECT c_custkey AS k, u.i AS i, u.entity_type, u.original_text, u.score FROM customer, LATERAL (
  SELECT 0 AS i, CASE WHEN c_custkey % 2 = 0 THEN 'EMAIL' ELSE 'PERSON_NAME' END AS entity_type, CASE WHEN c_custkey % 2 = 0 THEN 'ana ' || c_name ELSE c_name END AS original_text, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS score
  UNION ALL SELECT 1, 'PHONE', '612345678', 0.5::DOUBLE UNION ALL SELECT 2, 'ADDRESS', 'Calle Mayor', 0.8::DOUBLE) u""")
def q_merge_findings(spark, sf_dir):
    """A duplicate replaces the first one it matches if it scores higher, is dropped otherwise;
    a new text is appended."""
    base = F.array(_finding("PERSON_NAME", F.col("c_name"), F.lit(0.7)), _finding("PHONE", F.lit("612345678"), F.lit(0.5)))
    higher = F.when(F.col("c_custkey") % 2 == 0, 0.9).otherwise(0.6)
    new = F.array(_finding("EMAIL", F.concat(F.lit("ana "), F.col("c_name")), higher), _finding("ADDRESS", F.lit("Calle Mayor"), F.lit(0.8)), _finding("PHONE", F.lit("345"), F.lit(0.4)))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(merge.merge(base, new)).alias("i", "f"))
    return made.select("k", "i", "f.entity_type", "f.original_text", "f.score")


@query("SELECT p_partkey AS k, round_even(p_retailprice / 1000, 2) AS score, p_retailprice / 1000 >= 0.5 AS kept FROM part")
def q_score_rounding(spark, sf_dir):
    one = F.array(F.struct(F.lit("person").alias("label"), F.lit("x").alias("text"), (F.col("p_retailprice") / 1000).alias("score")))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.get(merge.layer_findings(one, 0.5), F.lit(0)).alias("f"), (F.col("p_retailprice") / 1000).alias("raw"))
    return made.select("k", F.coalesce("f.score", F.bround("raw", 2)).alias("score"), F.col("f").isNotNull().alias("kept"))


# --- redaction ----------------------------------------------------------------------------

TWO = "'Email: ' || email || ' DNI: ' || nif || ' otra vez ' || email"


def _two_findings(times: int = 1):
    one = [F.struct(F.lit("EMAIL").alias("entity_type"), F.col("email").alias("original_text"))] * times
    return F.array(*one, F.struct(F.lit("DNI_NIE").alias("entity_type"), F.col("nif").alias("original_text")))


TWO_SQL = f"WITH p AS (SELECT {DUCK_PIECES} FROM customer)"


@query(TWO_SQL + " SELECT k, 'Email: ' || repeat('█', length(email)) || ' DNI: ' || repeat('█', length(nif)) || ' otra vez ' || repeat('█', length(email)) AS redacted FROM p")
def q_redact_black(spark, sf_dir):
    return corpus(spark, sf_dir, TWO).select("k", redact.redact_text(F.col("text"), _two_findings(2), "black").alias("redacted"))


@query(TWO_SQL + " SELECT k, 'Email: [EMAIL] DNI: [DNI_NIE] otra vez [EMAIL]' AS redacted FROM p")
def q_redact_placeholder(spark, sf_dir):
    return corpus(spark, sf_dir, TWO).select("k", redact.redact_text(F.col("text"), _two_findings(2), "placeholder").alias("redacted"))


@query(TWO_SQL + " SELECT k, 'Email: ' || email || ' DNI: [DNI_NIE] otra vez [EMAIL]' AS redacted FROM p")
def q_redact_last_occurrence(spark, sf_dir):
    """One finding replaces one occurrence, the last."""
    return corpus(spark, sf_dir, TWO).select("k", redact.redact_text(F.col("text"), _two_findings(), "blur").alias("redacted"))


@query(TWO_SQL + " SELECT k, 'Email: ' || email || ' DNI: [DNI_NIE] otra vez ' || email AS redacted FROM p")
def q_redact_selective(spark, sf_dir):
    chosen = F.filter(_two_findings(2), lambda f: redact.is_redacted(f.entity_type, ("DNI_NIE",)))
    return corpus(spark, sf_dir, TWO).select("k", redact.redact_text(F.col("text"), chosen, "placeholder").alias("redacted"))


@query(CORPUS + """ SELECT k, 'Titular: ' || CASE WHEN k % 4 = 2 THEN name ELSE '[PERSON_NAME]' END || '; DNI: ' || CASE WHEN k % 7 = 0 THEN nif ELSE '[DNI_NIE]' END || ' Tel: [PHONE] cuenta [IBAN] Email: [EMAIL] nacido: [DATE_OF_BIRTH]' AS redacted FROM t""")
def q_redact_offsets(spark, sf_dir):
    """End to end: detection and one cut by offset."""
    cfg = SanitizeConfig(style="placeholder")
    made = Engine(cfg).sanitize(corpus(spark, sf_dir), key="k", fast=True)
    return made.select("k", F.col("sanitized").alias("redacted"))


@query("SELECT c_custkey, replace(c_name, 'Customer', '[PERSON_NAME]') AS c_name, replace(c_mktsegment, 'BUILD', '[ADDRESS]') AS c_mktsegment FROM customer")
def q_cell_redact(spark, sf_dir):
    found = F.array(F.struct(F.lit("PERSON_NAME").alias("entity_type"), F.lit("Customer").alias("original_text")), F.struct(F.lit("ADDRESS").alias("entity_type"), F.lit("BUILD").alias("original_text")))
    return redact.redact_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), found, ["c_name", "c_mktsegment"], "placeholder")


@query("""SELECT p_partkey AS k, f AS filename, CASE p_partkey % 4 WHEN 0 THEN 'a' || p_partkey || '_sanitized.pdf' WHEN 1 THEN 'b' || p_partkey || '.tar_sanitized.gz' WHEN 2 THEN 'plain' || p_partkey || '_sanitized' ELSE '.hidden' || p_partkey || '_sanitized' END AS output
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dir/a' || p_partkey || '.pdf' WHEN 1 THEN 'x/y/b' || p_partkey || '.tar.gz' WHEN 2 THEN 'plain' || p_partkey ELSE '.hidden' || p_partkey END AS f FROM part)""")
def q_output_filename(spark, sf_dir):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'dir/a' || p_partkey || '.pdf' WHEN 1 THEN 'x/y/b' || p_partkey || '.tar.gz' WHEN 2 THEN 'plain' || p_partkey ELSE '.hidden' || p_partkey END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name.alias("filename")).withColumn("output", redact.output_filename(F.col("filename")))


# --- tables, JSON, HTML, files ------------------------------------------------------------


@query("""SELECT c_nationkey AS nation, string_agg('c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey""")
def q_csv_flatten(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    return tabular.flatten_table(df, "nation", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT '0: n_nationkey' || chr(10) || '1: n_name' || chr(10) || '2: n_regionkey' || chr(10) AS text")
def q_csv_headers_only(spark, sf_dir):
    return spark.range(1).select(F.lit(tabular.headers_only(["n_nationkey", "n_name", "n_regionkey"])).alias("text"))


def _files(df: DataFrame, mime: str, content) -> DataFrame:
    return df.withColumn("mime", F.lit(mime)).withColumn("content", content.cast("binary"))


@query("SELECT n_nationkey AS k, 'key: ' || n_nationkey || chr(10) || '1: ' || n_name || chr(10) AS text FROM nation")
def q_csv_bytes(spark, sf_dir):
    """A file with a quoted line break, an unnamed and an empty column, read by the parser."""
    body = F.concat(F.lit('key,,"re\ngion"\n"'), F.col("n_nationkey").cast("string"), F.lit('","'), F.col("n_name"), F.lit('",\n'))
    return parsers.extract(_files(table(spark, sf_dir, "nation"), "text/csv", body)).select(F.col("n_nationkey").alias("k"), "text")


@query("SELECT c_custkey AS k, 'name: ' || c_name || chr(10) || 'tags.0: ' || c_mktsegment || chr(10) || 'inner.deep.x: ' || chr(10) AS text FROM customer")
def q_json_flatten(spark, sf_dir):
    body = F.format_string('{"name":"%s","n":%d,"tags":["%s",null,true],"inner":{"deep":{"x":""}}}', "c_name", "c_custkey", "c_mktsegment")
    return parsers.extract(_files(table(spark, sf_dir, "customer"), "application/json", body)).select(F.col("c_custkey").alias("k"), "text")


@query("""SELECT c_custkey AS k, '{' || chr(10) || '  "Customer": "[PERSON_NAME]' || substr(c_name, 9) || '",' || chr(10) || '  "n": ' || c_custkey || ',' || chr(10) || '  "l": [' || chr(10) || '    "[PERSON_NAME] x"' || chr(10) || '  ]' || chr(10) || '}' AS content FROM customer""")
def q_json_redact(spark, sf_dir):
    body = F.format_string('{"Customer":"%s","n":%d,"l":["Customer x"]}', "c_name", "c_custkey")
    found = F.array(F.struct(F.lit("PERSON_NAME").alias("entity_type"), F.lit("Customer").alias("original_text")))
    made = parsers.sanitized(_files(table(spark, sf_dir, "customer"), "application/json", body).withColumn("findings", found), "placeholder")
    return made.select(F.col("c_custkey").alias("k"), F.col("sanitized").cast("string").alias("content"))


def _html_sql() -> str:
    out = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<![^>]*>', '<x>', 'g')"
    node = "n"
    for name, char in html.NAMED.items():
        node = f"replace({node}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({out}, '<[^>]*>'), lambda n: regexp_replace({node}, '^\s+|\s+$', '', 'g')), lambda n: n <> ''), chr(10)) AS text FROM pages"


@query(_html_sql())
def q_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@query(_html_sql())
def q_html_bytes(spark, sf_dir):
    """The same through the byte parser."""
    return parsers.extract(_files(table(spark, sf_dir, "pages"), "text/html", F.col("html"))).select("page_id", "text")


_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
_SWAPPED = r"""CASE WHEN regexp_matches(g, '(?is)^(<(script|style)\b|<!--)') THEN
    regexp_extract(g, '(?is)^(<(?:script|style)\b[^>]*>|<!--)', 1) || replace(substr(g, length(regexp_extract(g, '(?is)^(<(?:script|style)\b[^>]*>|<!--)', 1)) + 1), 'the', '[EMAIL]') ELSE g END"""


@query(f"""WITH p AS (SELECT page_id, string_split_regex(html, '{_MARKUP}') AS texts, regexp_extract_all(html, '{_MARKUP}') AS tags FROM pages)
  SELECT page_id, array_to_string(list_transform(range(1, len(texts) + 1), lambda i: replace(texts[i], 'the', '[EMAIL]') || coalesce(list_transform([tags[i]], lambda g: {_SWAPPED})[1], '')), '') AS html FROM p""")
def q_html_redact(spark, sf_dir):
    """Whole pages: texts, comments and scripts change, tags do not."""
    found = F.array(F.struct(F.lit("EMAIL").alias("entity_type"), F.lit("the").alias("original_text")))
    return table(spark, sf_dir, "pages").select("page_id", html.redact_html(F.col("html"), found, lambda e, t: redact.replacement(e, t, "placeholder")).alias("html"))


# --- office files ---------------------------------------------------------------------------

#: Texts without what XML cannot hold, in both dialects.
XML_TEXT = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g')"
LINES = f"WITH d AS (SELECT doc_id, string_split({XML_TEXT}, chr(10)) AS lines FROM documents)"


def _built(spark, sf_dir, mime: str, make) -> DataFrame:
    """One office file per document, of its lines."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0b-\\x1f]", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("_text"), F.lit(mime).alias("mime"))
    return parsers._with(docs, pa.schema([("content", pa.binary())]), lambda t: (make(t.split("\n")),), ("_text",)).drop("_text")


def _rows(lines: list[str]) -> list[list]:
    return [["line", "chars"], *([x, len(x)] for x in lines)]


def _wide(lines: list[str]) -> list[list]:
    """Columns beyond 2,000 repeats of a header and of an empty cell, and a repeated value."""
    return [[("k", 2000), ("v", 1), ("w", 2)], *([("", 2000), (x, 1), ("z", 2)] for x in lines)]


MAKERS = {parsers.DOCX: samples.docx, parsers.ODT: lambda x: samples.odt(x, "the cell of the table"), parsers.XLSX: lambda x: samples.xlsx(_rows(x)), parsers.ODS: lambda x: samples.ods(_wide(x))}


def _office_query(name: str, mime: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsers.extract(_built(spark, sf_dir, mime, MAKERS[mime])).select("doc_id", "text", "error")

    run.__name__ = name
    query(f"{LINES} SELECT doc_id, {sql} AS text, NULL::VARCHAR AS error FROM d")(run)


_FILLED = "list_filter(lines, lambda x: x <> '')"
_office_query("q_docx_text", parsers.DOCX, f"array_to_string({_FILLED}, chr(10))")
_office_query("q_odt_text", parsers.ODT, f"array_to_string(list_concat({_FILLED}, ['the cell of the table', 'the cell of the table']), chr(10))")
_office_query("q_xlsx_text", parsers.XLSX, "'--- Sheet: S ---' || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN x <> '' THEN 'line: ' || x || chr(10) ELSE '' END || 'chars: ' || length(x) || chr(10)), '')")
_office_query("q_ods_text", parsers.ODS, "'--- Sheet: S ---' || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN x <> '' THEN 'v: ' || x || chr(10) ELSE '' END || 'w: z' || chr(10) || 'w: z' || chr(10)), '')")


PDF_LINES = "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\n]', '?', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)"


@query(PDF_LINES + """ SELECT doc_id, CASE WHEN len(lines) = 0 THEN '' ELSE array_to_string(list_transform(lines, lambda x, i: x || CASE WHEN i = len(lines) OR i % 50 = 0 THEN chr(10) || chr(10) ELSE chr(10) END), '') END AS text,
  CAST(greatest(1, ceil(len(lines) / 50)) AS INT) AS pages, NULL::VARCHAR AS error FROM l""")
def q_pdf_text(spark, sf_dir):
    """PDF files of fifty lines a page, every other one with an object stream."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E\\n]", "?"), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("_lines"), F.lit(parsers.PDF).alias("mime"))

    def made(k: int, x: list[str]) -> tuple[bytes]:
        return (samples.pdf([x[i : i + 50] for i in range(0, max(1, len(x)), 50)], k % 2 == 0),)

    files = parsers._with(docs, pa.schema([("content", pa.binary())]), made, ("doc_id", "_lines"))
    return parsers.extract(files.drop("_lines")).select("doc_id", "text", "pages", "error")


def _rewritten_query(name: str, mime: str, sql: str) -> None:
    """Rewritten, and what the parser then reads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.array(F.struct(F.lit("EMAIL").alias("entity_type"), F.lit("the").alias("original_text")))
        made = parsers.sanitized(_built(spark, sf_dir, mime, MAKERS[mime]).withColumn("findings", found), "placeholder")
        return parsers.extract(made.select("doc_id", "mime", F.col("sanitized").alias("content"), "sanitize_error")).select("doc_id", "text", F.coalesce("sanitize_error", "error").alias("error"))

    run.__name__ = name
    query(f"{LINES} SELECT doc_id, {sql} AS text, NULL::VARCHAR AS error FROM d")(run)


_ALL = "replace({}, 'the', '[EMAIL]')"
_rewritten_query("q_docx_rewrite", parsers.DOCX, f"array_to_string(list_transform({_FILLED}, lambda x: {_ALL.format('x')}), chr(10))")
_rewritten_query("q_odt_rewrite", parsers.ODT, f"array_to_string(list_concat(list_transform({_FILLED}, lambda x: regexp_replace(x, 'the', '[EMAIL]')), ['[EMAIL] cell of [EMAIL] table', '[EMAIL] cell of [EMAIL] table']), chr(10))")
_rewritten_query("q_xlsx_rewrite", parsers.XLSX, f"'--- Sheet: S ---' || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN x <> '' THEN 'line: ' || {_ALL.format('x')} || chr(10) ELSE '' END || 'chars: ' || length(x) || chr(10)), '')")
_rewritten_query("q_ods_rewrite", parsers.ODS, f"'--- Sheet: S ---' || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN x <> '' THEN 'v: ' || {_ALL.format('x')} || chr(10) ELSE '' END || 'w: z' || chr(10) || 'w: z' || chr(10)), '')")


def _rtf(text: Column) -> Column:
    """The text as RTF with a font table, and an emoji as two halves."""
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\par ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\uc1 "), text, F.lit(" \\u-10179?\\u-8704?}"))


@query("SELECT doc_id, replace(coalesce(text, ''), chr(13), '') || ' 😀' AS text, NULL::VARCHAR AS error FROM documents")
def q_rtf_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return parsers.extract(_files(docs, "application/rtf", _rtf(F.col("_text")))).select("doc_id", "text", "error")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.es and [EMAIL] of ' ELSE 'a@b.es and a@b.es of ' END || c_name || ' 😀' AS text FROM customer")
def q_rtf_rewrite(spark, sf_dir):
    """Plain text, with the last occurrence of a finding replaced, or without findings."""
    found = F.array(F.struct(F.lit("EMAIL").alias("entity_type"), F.lit("a@b.es").alias("original_text")))
    files = _files(table(spark, sf_dir, "customer"), "text/rtf", _rtf(F.concat(F.lit("a@b.es and a@b.es of "), F.col("c_name"))))
    made = parsers.sanitized(files.withColumn("findings", F.when(F.col("c_custkey") % 2 == 0, found).otherwise(F.array())), "placeholder")
    return made.select(F.col("c_custkey").alias("k"), F.col("sanitized").cast("string").alias("text"))


@query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'cut' WHEN 1 THEN 'damaged' WHEN 2 THEN 'encrypted' WHEN 3 THEN 'empty' WHEN 4 THEN 'half' ELSE 'good' END AS kind, p_partkey % 6 < 4 AS failed, CASE p_partkey % 6 WHEN 4 THEN 'a: �' || chr(10) WHEN 5 THEN p_name END AS text FROM part")
def q_unreadable_files(spark, sf_dir):
    """Broken files give an error in their own row and stop no other."""

    def spoilt(k: int, name: str) -> tuple[bytes]:
        good = samples.docx([name])
        at = good.find(b"document.xml") + 20
        return ((good[: len(good) // 2], good[:at] + b"\xff" * 20 + good[at + 20 :], samples.encrypted(good), b"", b'{"a": "\\ud83d"}', good)[k % 6],)

    kinds = F.array(*map(F.lit, ("cut", "damaged", "encrypted", "empty", "half", "good")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"))
    files = parsers._with(parts, pa.schema([("content", pa.binary())]), spoilt, ("k", "p_name")).withColumn("mime", F.when(F.col("kind") == "half", "application/json").otherwise(parsers.DOCX))
    return parsers.extract(files).select("k", "kind", F.col("error").isNotNull().alias("failed"), "text")


NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.md' WHEN 3 THEN 'd.xlsx' WHEN 4 THEN 'e.exe' ELSE 'noext' END"


@query(f"""SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 4 THEN NULL ELSE 'application/pdf' END AS mime,
  CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'text' WHEN 3 THEN 'spreadsheet' WHEN 4 THEN NULL ELSE 'pdf' END AS category FROM part""")
def q_mime_resolve(spark, sf_dir):
    content = F.when(F.col("p_partkey") % 6 == 5, "%PDF-1.7").otherwise("??").cast("binary")
    mime = formats.resolve_mime(F.expr(NAMES), content, F.lit("made/up"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), mime.alias("mime")).withColumn("category", formats.category(F.col("mime")))


@query("SELECT category, count(*) AS types FROM (VALUES " + ", ".join(f"('{m}', '{c}')" for m, (c, _) in fixed.FORMATS.items()) + ") v(mime, category) GROUP BY category")
def q_format_registry(spark, sf_dir):
    return formats.registry(spark).select("mime", "category").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("types"))


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'File exceeds maximum size of 2000 bytes: ' || n_chars WHEN doc_id % 5 = 0 THEN 'Unsupported file format' END AS refused FROM documents")
def q_size_gate(spark, sf_dir):
    mime = F.when(F.col("doc_id") % 5 != 0, "text/plain")
    return table(spark, sf_dir, "documents").select("doc_id", formats.gate(F.col("n_chars"), mime, 2000).alias("refused"))


@query("SELECT p_partkey AS k, 'a' || p_partkey || '|b|c' AS paths FROM part")
def q_split_paths(spark, sf_dir):
    listed = F.concat(F.lit(" a"), F.col("p_partkey").cast("string"), F.lit(" ,, b,c ,d"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(formats.split_paths(listed, 3), "|").alias("paths"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS content, CASE WHEN c_custkey % 2 = 1 THEN 'Invalid base64 content' END AS error FROM customer")
def q_base64_source(spark, sf_dir):
    encoded = F.when(F.col("c_custkey") % 2 == 0, F.base64(F.col("c_name").cast("binary"))).otherwise("%%%")
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), formats.from_base64(encoded).alias("b"))
    return made.select("k", F.col("b.content").cast("string").alias("content"), "b.error")


@query("SELECT c_custkey AS k, c_name || '��ok' AS text FROM customer")
def q_utf8_decode(spark, sf_dir):
    raw = F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit("FFFE")), F.lit("ok").cast("binary"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), formats.decoded(raw).alias("text"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'error' ELSE 'success' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'Email: [EMAIL]' WHEN 1 THEN 'n,mail' || chr(13) || chr(10) || c_custkey || ',[EMAIL]' || chr(13) || chr(10) WHEN 2 THEN NULL ELSE '<p>mail <b>[EMAIL]</b></p>' END AS content,
  CASE c_custkey % 4 WHEN 0 THEN 'f_sanitized.txt' WHEN 1 THEN 'f_sanitized.csv' WHEN 2 THEN 'f_sanitized.exe' ELSE 'f_sanitized.html' END AS output_filename FROM customer""")
def q_file_pipeline(spark, sf_dir):
    """Text, CSV, unsupported and HTML files through extraction, detection and rewriting."""
    mail, key = F.concat(F.lit("user"), F.col("k").cast("string"), F.lit("@example.com")), F.col("k").cast("string")
    which = F.col("k") % 4
    name = F.when(which == 0, "f.txt").when(which == 1, "f.csv").when(which == 2, "f.exe").otherwise("f.html")
    body = F.when(which == 0, F.concat(F.lit("Email: "), mail)).when(which == 1, F.concat(F.lit("n,mail\n"), key, F.lit(","), mail, F.lit("\n"))).when(which == 2, "x").otherwise(F.concat(F.lit("<p>mail <b>"), mail, F.lit("</b></p>")))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.col("k").alias("doc_id"), name.alias("filename"), body.cast("binary").alias("content"))
    made = Engine(SanitizeConfig(style="placeholder")).sanitize_files(files)
    return made.select("k", "status", F.col("sanitized").cast("string").alias("content"), "output_filename")


# --- placed spans and visual tables -------------------------------------------------------


def _words(spark, sf_dir) -> DataFrame:
    """Words of the conversations' turns with boxes from their numbers."""
    each = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.posexplode(F.split("text", "[ \n]")).alias("seq", "text"))
    return each.select("doc_id", "seq", F.floor(F.col("seq") / 10).alias("block"), F.floor(F.col("seq") / 5).alias("line"), F.when(F.col("seq") % 7 == 3, -1).otherwise(90).alias("conf"), "text", (F.col("seq") % 5 * 10).alias("left"), (F.floor(F.col("seq") / 5) * 12).alias("top"), F.lit(9).alias("width"), F.lit(11).alias("height"))


WORDS_SQL = r"""WITH w AS (SELECT conv_id || '/' || turn AS doc_id, unnest(range(0, len(a))) AS seq, unnest(a) AS text FROM (SELECT *, string_split_regex(text, '[ \n]') AS a FROM conversations)),
  v AS (SELECT *, seq // 10 AS block, seq // 5 AS line FROM w WHERE seq % 7 <> 3 AND trim(text) <> ''),
  s AS (SELECT *, CASE WHEN lag(block) OVER x IS NULL THEN '' WHEN lag(block) OVER x <> block THEN chr(10) || chr(10) WHEN lag(line) OVER x <> line THEN chr(10) ELSE ' ' END AS sep FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY seq)),
  o AS (SELECT *, CAST(sum(length(sep) + length(text)) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS e FROM s)"""


@query(WORDS_SQL + ' SELECT doc_id, seq, e - length(text) AS start, e AS "end" FROM o')
def q_span_offsets(spark, sf_dir):
    placed = spans.with_offsets(spans.word_boxes(_words(spark, sf_dir)))
    return placed.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(WORDS_SQL + " SELECT doc_id, string_agg(sep || text, '' ORDER BY seq) AS text FROM o GROUP BY doc_id")
def q_word_text(spark, sf_dir):
    return spans.assembled(spans.word_boxes(_words(spark, sf_dir)))


RANGES = "SELECT DISTINCT doc_id, unnest([0, 1, 2]) AS finding FROM o"


def _ranges(placed: DataFrame) -> DataFrame:
    each = placed.select("doc_id").distinct().withColumn("finding", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return each.withColumns({"start": F.col("finding") * 9 + 2, "end": F.col("finding") * 23 + 12})


@query(WORDS_SQL + f", f AS ({RANGES}) SELECT f.doc_id, CAST(f.finding AS INT) AS finding, CAST(o.seq AS BIGINT) AS span_seq FROM f JOIN o ON f.doc_id = o.doc_id AND o.e - length(o.text) < f.finding * 23 + 12 AND o.e > f.finding * 9 + 2")
def q_span_resolve(spark, sf_dir):
    placed = spans.with_offsets(spans.word_boxes(_words(spark, sf_dir)))
    return spans.resolve(_ranges(placed), placed).select("doc_id", "finding", F.col("span_seq").cast("long").alias("span_seq"))


@query(
    WORDS_SQL
    + f""", f AS ({RANGES}), h AS (SELECT f.doc_id, f.finding, CAST(o.seq % 3 = 1 AS INT) AS page, o.seq, o.seq % 5 * 10 AS x0, o.seq // 5 * 12 AS y0 FROM f JOIN o ON f.doc_id = o.doc_id AND o.e - length(o.text) < f.finding * 23 + 12 AND o.e > f.finding * 9 + 2),
    g AS (SELECT doc_id, finding, page, count(*) AS n, min(seq) AS first, min(x0) AS x0, min(y0) AS y0, max(x0 + 9) AS x1, max(y0 + 11) AS y1 FROM h GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, finding ORDER BY n DESC, first) AS rk FROM g)
    SELECT f.doc_id, CAST(f.finding AS INT) AS finding, page, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM f JOIN r ON f.doc_id = r.doc_id AND f.finding = r.finding AND rk = 1"""
)
def q_bbox_merge(spark, sf_dir):
    placed = spans.with_offsets(spans.word_boxes(_words(spark, sf_dir))).withColumn("page", (F.col("seq") % 3 == 1).cast("int"))
    made = spans.located(_ranges(placed), placed).filter("page IS NOT NULL")
    return made.select("doc_id", "finding", "page", *[F.col(c).cast("long").alias(c) for c in spans.BOX])


@query("SELECT doc_id, length(trim(text)) / greatest(doc_id % 400, 1) < 10 AS scanned FROM documents")
def q_scanned_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spans.is_scanned(F.col("text"), F.col("doc_id") % 400).alias("scanned"))


COMPONENTS = "SELECT l_orderkey * 10 + l_linenumber AS k, CAST(l_partkey % 300 + 1 AS DOUBLE) AS width, CAST(l_suppkey % 90 + 1 AS DOUBLE) AS height, 1000.0 AS img_width, 800.0 AS img_height, CAST(l_quantity AS DOUBLE) * 40 AS area FROM lineitem"


@query(
    f"""WITH c AS ({COMPONENTS}), d AS (SELECT *, area / (img_width * img_height) AS r, width / height AS a, area / (width * height) AS d FROM c)
    SELECT k, round(greatest(0.4, least(0.4 + 0.2 * (0.5 * (1 - least(abs(a - 3) / 3, 1.0)) + 0.5 * (1 - least(abs(d - 0.15) / 0.20, 1.0))), 0.6)), 2) AS score
    FROM d WHERE r BETWEEN 0.001 AND 0.15 AND a BETWEEN 1.5 AND 8.0 AND d BETWEEN 0.02 AND 0.35"""
)
def q_signature_score(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    made = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % 300 + 1).cast("double").alias("width"), (F.col("l_suppkey") % 90 + 1).cast("double").alias("height"), F.lit(1000.0).alias("img_width"), F.lit(800.0).alias("img_height"), (F.col("l_quantity").cast("double") * 40).alias("area"))
    return visual.signature_candidates(made).select("k", "score")


def _pages_with_ink(spark, sf_dir) -> DataFrame:
    """One PNG per part: a light page with two inked bars whose places and sizes follow the key."""

    def page(k: int) -> tuple[bytes]:
        image = np.full((200, 300, 1 + k % 4), 230, np.uint8)
        image[20 : 20 + 8 + k % 5, 30 : 130 + k % 20, :3] = 40
        image[100 : 103 + k % 3, 150 : 190 + k % 40, :3] = 20
        return (png.encode(image) if k % 9 else b"no image",)

    # Keys are few bytes and lie in few files, their images are work for all cores.
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).repartition(spark.sparkContext.defaultParallelism)
    return parsers._with(parts, pa.schema([("content", pa.binary())]), page, ("k",))


@query("""SELECT k, x0, y0, w, h, NULL::VARCHAR AS error FROM (
    SELECT p_partkey AS k, 30.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, CAST(100 + p_partkey % 20 AS DOUBLE) AS w, CAST(8 + p_partkey % 5 AS DOUBLE) AS h FROM part
    UNION ALL SELECT p_partkey, 150.0, 100.0, CAST(40 + p_partkey % 40 AS DOUBLE), CAST(3 + p_partkey % 3 AS DOUBLE) FROM part) WHERE k % 9 <> 0
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'Not a PNG image' FROM part WHERE p_partkey % 9 = 0""")
def q_ink_components(spark, sf_dir):
    """Boxes of inked components of real images; a file that is none gives an error row."""
    made = pixels.ink_components(_pages_with_ink(spark, sf_dir), ("k",))
    return made.select("k", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("width").alias("w"), F.col("height").alias("h"), "error")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'Not a PNG image' END AS error, CASE WHEN p_partkey % 9 <> 0 THEN 20 * 30 END AS black FROM part")
def q_image_redact(spark, sf_dir):
    """Boxes are filled in the image that comes out; counted by reading it again."""
    box = F.array(F.struct(F.lit(200.0).alias("x0"), F.lit(150.0).alias("y0"), F.lit(230.0).alias("x1"), F.lit(170.0).alias("y1")))
    made = pixels.blacked(_pages_with_ink(spark, sf_dir), box)

    def black(content: bytes | None) -> tuple[int | None]:
        return (int((png.grey(png.decode(content)) == 0).sum()) if content else None,)

    return parsers._with(made, pa.schema([("black", pa.int32())]), black, ("sanitized",)).select("k", F.col("sanitize_error").alias("error"), "black")


@query("""SELECT k, style, CASE WHEN page IS NULL OR page < 0 OR page >= 3 OR k % 11 = 0 THEN 'skip' WHEN style = 'placeholder' AND k % 2 = 1 THEN 'label' ELSE 'black' END AS pdf,
  CASE WHEN k % 11 = 0 THEN 'skip' WHEN style = 'blur' AND k % 20 >= 10 THEN 'blur' WHEN style = 'placeholder' AND k % 2 = 1 THEN 'label' ELSE 'black' END AS image,
  CASE WHEN k % 2 = 0 THEN greatest(0.3, least(CAST(k % 20 * 9 AS DOUBLE) / 60, 1.5)) ELSE greatest(0.3, least(CAST(k % 20 * 9 AS DOUBLE) / 75, 1.5)) END AS scale
  FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 END AS page, unnest(['black', 'blur', 'placeholder']) AS style FROM part)""")
def q_visual_actions(spark, sf_dir):
    k = F.col("p_partkey")
    kind, box = F.when(k % 2 == 0, "FACE").otherwise("EMAIL"), k % 11 != 0
    page = F.when(k % 5 < 4, k % 5)
    parts = table(spark, sf_dir, "part")
    each = [parts.select(k.alias("k"), F.lit(s).alias("style"), redact.pdf_action(page, box, F.lit(3), kind, s).alias("pdf"), redact.image_action(box, k % 20, F.lit(12), kind, s).alias("image"), redact.label_scale((k % 20 * 9).cast("double"), kind).alias("scale")) for s in fixed.STYLES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT p_partkey AS k, CAST(p_size + 100 AS DOUBLE) AS x0, CAST(p_size * 2 + 50 AS DOUBLE) AS y0, CAST(p_size + 110 AS DOUBLE) AS x1, CAST(p_size * 2 + 70 AS DOUBLE) AS y1 FROM part")
def q_translate_bbox(spark, sf_dir):
    s = F.col("p_size").cast("double")
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), s.alias("x0"), (s * 2).alias("y0"), (s + 10).alias("x1"), (s * 2 + 20).alias("y1"), F.lit(100.0).alias("origin_x"), F.lit(50.0).alias("origin_y"))
    return visual.translated(made).drop("origin_x", "origin_y")


@query("SELECT p_partkey AS k, '0:0,' || (10 + p_size) || ':1,' || (11 + p_size) || ':' || (20 + p_size) || ',1:' || (19 + p_size) AS corners FROM part")
def q_corner_order(spark, sf_dir):
    s = F.col("p_size")
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((s + 11, s + 20), (F.lit(0), F.lit(0)), (F.lit(1), s + 19), (s + 10, F.lit(1)))])
    made = F.transform(visual.ordered_corners(points), lambda p: F.concat_ws(":", p.x.cast("string"), p.y.cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(made, ",").alias("corners"))


# --- reports ------------------------------------------------------------------------------

COUNTED = CORPUS + EXPECTED + ", f AS (SELECT * FROM e)"


@query(COUNTED + " SELECT k, entity_type, count(*) AS n FROM f GROUP BY ALL")
def q_summary(spark, sf_dir):
    return report.summary(_detected(spark, sf_dir), "k")


@query(COUNTED + " SELECT k, CAST(sum(n) AS BIGINT) AS total_findings, 'standard' AS level_applied, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS by_type FROM (SELECT k, entity_type, count(*) AS n FROM f GROUP BY ALL) GROUP BY k")
def q_summary_struct(spark, sf_dir):
    made = Engine().detect(corpus(spark, sf_dir)).select("k", report.summary_of(F.col("findings"), "standard").alias("s"))
    spelt = F.array_join(F.transform(F.array_sort(F.map_keys("s.by_type")), lambda t: F.concat(t, F.lit("="), F.element_at("s.by_type", t).cast("string"))), ",")
    return made.select("k", F.col("s.total_findings").cast("long").alias("total_findings"), "s.level_applied", spelt.alias("by_type"))


@query("SELECT c_custkey AS k, c_custkey % 3 = 0 AS has_pii FROM customer")
def q_has_pii(spark, sf_dir):
    body = "CASE WHEN k % 3 = 0 THEN 'escribe a ' || email ELSE 'nada que ver' END"
    return Engine().check_pii(corpus(spark, sf_dir, body), key="k").select("k", "has_pii")


def _entries(spark, sf_dir) -> DataFrame:
    made = Engine().detect(corpus(spark, sf_dir, "CASE WHEN k % 3 = 0 THEN 'escribe a ' || email ELSE 'nada que ver' END"))
    results = made.select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("filename"), F.col("text").cast("binary").alias("content"), F.when(F.col("k") % 10 != 0, F.col("text").cast("binary")).alias("sanitized"), "findings", (F.col("k") % 97).alias("ms"), F.when(F.col("k") % 10 == 0, "bad").alias("error"))
    return report.audit(results, "standard")


AUDIT_SQL = f"WITH p AS (SELECT {DUCK_PIECES} FROM customer), t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'escribe a ' || email ELSE 'nada que ver' END AS text FROM p)"


@query(AUDIT_SQL + " SELECT 'f' || k AS filename, sha256(text) AS input_hash, length(text) AS file_size, CASE WHEN k % 10 <> 0 THEN sha256(text) END AS output_hash, 'standard' AS level, CAST(k % 3 = 0 AS BIGINT) AS total_findings, k % 97 AS processing_time_ms, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'success' END AS status, 'batch' AS source FROM t")
def q_audit(spark, sf_dir):
    return _entries(spark, sf_dir).select("filename", "input_hash", "file_size", "output_hash", "level", "total_findings", "processing_time_ms", "status", "source")


@query("SELECT count(*) AS requests_total, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS requests_success, count(*) FILTER (WHERE c_custkey % 10 = 0) AS requests_failed, CAST(round_even(sum(c_custkey % 97) / count(*), 0) AS BIGINT) AS avg_processing_time_ms FROM customer")
def q_metrics(spark, sf_dir):
    return report.metrics(_entries(spark, sf_dir))


@query("SELECT 'EMAIL' AS entity_type, count(*) AS n FROM customer WHERE c_custkey % 3 = 0")
def q_metrics_by_type(spark, sf_dir):
    return report.metrics_by_type(_entries(spark, sf_dir))


@query("SELECT c_nationkey AS batch_id, count(*) AS total_files, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS successful, count(*) FILTER (WHERE c_custkey % 10 = 0) AS failed FROM customer GROUP BY c_nationkey")
def q_batch_totals(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("batch_id"), F.when(F.col("c_custkey") % 10 == 0, "bad").alias("error"))
    return report.batch_totals(made)


@query("SELECT o_custkey AS batch_id, count(*) AS files FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def q_oversized_batches(spark, sf_dir):
    return report.oversized_batches(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "batch_id"), 10)


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '{"name":"' || c_name || '"}' ELSE '{"name":"' || c_name || '","error":"bad"}' END AS response FROM customer""")
def q_exclude_none(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, "bad").alias("error"))
    return made.select("k", report.response_json(made, ["name", "error"]).alias("response"))


# --- rate limiter -------------------------------------------------------------------------

LIMIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT user_id, event_id, i, [t] AS kept, true AS accepted FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i,
      CASE WHEN len(list_filter(f.kept, lambda x: x > e.t - 86400000000)) < 3 THEN list_append(list_filter(f.kept, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(f.kept, lambda x: x > e.t - 86400000000) END,
      len(list_filter(f.kept, lambda x: x > e.t - 86400000000)) < 3
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
  SELECT user_id, event_id, accepted, CASE WHEN accepted THEN 3 - len(kept) ELSE 0 END AS remaining FROM f"""


@query(LIMIT_SQL)
def q_rate_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return limiter.rate_limited(events, "user_id", "ts", "event_id", 3, 86400).select("user_id", "event_id", "accepted", "remaining")


HEADER_SQL = LIMIT_SQL.rsplit("SELECT", 1)[0] + """SELECT f.user_id, f.event_id,
    CAST(CASE WHEN f.accepted THEN floor((e.t + 86400000000) / 1e6) ELSE floor((f.kept[1] + 86400000000) / 1e6) END AS BIGINT) AS reset_s,
    CAST(CASE WHEN f.accepted THEN 0 ELSE floor((f.kept[1] + 86400000000 - e.t) / 1e6) + 1 END AS BIGINT) AS retry_after_s
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_id = f.event_id"""


@query(HEADER_SQL)
def q_rate_headers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    made = limiter.rate_limited(events, "user_id", "ts", "event_id", 3, 86400)
    return made.select("user_id", "event_id", "reset_s", F.coalesce("retry_after_s", F.lit(0).cast("long")).alias("retry_after_s"))


# --- gates, errors, subtotals, views -------------------------------------------------------


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 AND c_custkey < 600 THEN 200 ELSE 401 END AS status_code FROM customer")
def q_api_keys(spark, sf_dir):
    made = table(spark, sf_dir, "customer")
    sent = made.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("key"), F.col("c_custkey").cast("string"))).alias("api_key"))
    known = made.filter("c_custkey < 600").select(F.concat(F.lit("key"), F.col("c_custkey").cast("string")).alias("api_key"))
    return access.authorised(sent, known).select("k", "status_code")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 422 ELSE 500 END AS status_code, CASE WHEN p_partkey % 3 = 0 THEN 'File is corrupted or unreadable' ELSE 'Internal processing error' END AS single, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Internal processing error' END AS in_batch FROM part")
def q_error_response(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "ValueError").otherwise("KeyError")
    one, many = access.error_response(kind, F.col("p_name")), access.error_response(kind, F.col("p_name"), batch=True)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), one.status_code.alias("status_code"), one.detail.alias("single"), many.detail.alias("in_batch"))


@query(
    CORPUS
    + EXPECTED
    + ", r AS (SELECT k % 4 AS grp, entity_type, count(*) AS n FROM e GROUP BY ROLLUP (k % 4, entity_type)) SELECT coalesce(CAST(grp AS VARCHAR), 'all') AS grp, coalesce(entity_type, 'all') AS entity_type, n FROM r"
)
def q_findings_rollup(spark, sf_dir):
    made = report.rollup(_detected(spark, sf_dir).withColumn("grp", F.col("k") % 4), "grp")
    return made.select(F.coalesce(F.col("grp").cast("string"), F.lit("all")).alias("grp"), F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "n")


@query(CORPUS + EXPECTED + " SELECT entity_type, count(*) AS findings, count(DISTINCT k) AS docs FROM e GROUP BY entity_type")
def q_sql_views(spark, sf_dir):
    register_views(corpus(spark, sf_dir), key="k")
    return spark.sql("SELECT s.entity_type, sum(s.n) AS findings, count(DISTINCT f.k) AS docs FROM pii_summary s JOIN (SELECT DISTINCT k, entity_type FROM pii_findings) f ON s.k = f.k AND s.entity_type = f.entity_type GROUP BY s.entity_type")


# --- the rest of the request path ------------------------------------------------------------


@query(CORPUS + " SELECT k, CASE k % 3 WHEN 2 THEN 1 ELSE 0 END AS n FROM t")
def q_blank_texts(spark, sf_dir):
    """Null and blank texts have no findings."""
    docs = corpus(spark, sf_dir, "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE 'escribe a ' || email END")
    return Engine().detect(docs).select("k", F.coalesce(F.size("findings"), F.lit(0)).alias("n"))


@query(CORPUS + ", w AS (SELECT k, [" + ", ".join(f"'{w}'" for w in fixed.CONTEXT["PERSON"]) + f"][k // 2 % {len(fixed.CONTEXT['PERSON'])} + 1] AS word FROM t) SELECT k, word, CAST(CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS score FROM w WHERE k % 4 <> 2")
def q_person_context(spark, sf_dir):
    """A context word right before a name raises its score; without one it stays."""
    words = F.array(*map(F.lit, fixed.CONTEXT["PERSON"]))
    docs = corpus(spark, sf_dir).select("k", "name", F.get(words, (F.floor(F.col("k") / 2) % len(fixed.CONTEXT["PERSON"])).cast("int")).alias("word"))
    docs = docs.withColumn("text", F.concat(F.when(F.col("k") % 2 == 0, F.concat("word", F.lit(": "))).otherwise("hoy: "), "name", F.lit(";")))
    each = Engine().detect(docs).select("k", "word", F.explode("findings").alias("f"))
    return each.select("k", "word", "f.score")


class _Names:
    """A stand-in model: finds the customer's name, but fails on every fifth text."""

    def predict(self, documents: DataFrame, labels: tuple[str, ...]) -> DataFrame:
        one = F.array(F.struct(F.lit("person").alias("label"), F.lit("Customer").alias("text"), F.lit(0.913).alias("score")))
        return documents.withColumn("predictions", F.when(F.col("k") % 5 != 0, one))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN '[PERSON_NAME]' ELSE 'Customer' END || ' writes from [EMAIL]' AS sanitized, CASE WHEN c_custkey % 5 <> 0 THEN 2 ELSE 1 END AS total, true AS has_pii FROM customer")
def q_layer_pipeline(spark, sf_dir):
    """Findings of a registered model are redacted and counted like the patterns' own."""
    docs = corpus(spark, sf_dir, "'Customer writes from ' || email")
    providers.register("ner", _Names())
    try:
        engine = Engine(SanitizeConfig(style="placeholder"))
        made = engine.sanitize(docs, key="k").select("k", "sanitized", F.col("summary.total_findings").alias("total"))
        return made.join(engine.check_pii(docs, key="k").select("k", "has_pii"), "k")
    finally:
        providers.unregister("ner")


@query("SELECT c_custkey AS k, true AS without_text, 1 AS total, 'f' || c_custkey || '_sanitized.txt' AS output_filename FROM customer")
def q_json_response(spark, sf_dir):
    """The json response carries the findings and no redacted text."""
    docs = corpus(spark, sf_dir, "'escribe a ' || email").withColumn("filename", F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".txt")))
    made = Engine(SanitizeConfig(response="json")).sanitize(docs, key="k")
    return made.select("k", F.col("sanitized").isNull().alias("without_text"), F.col("summary.total_findings").alias("total"), "output_filename")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '{"filename":"f.exe","status":"error","error":"Unsupported file format"}'
  ELSE '{"filename":"f.txt","status":"success","file":"' || to_base64(encode('mail [EMAIL]')) || '"}' END AS response FROM customer""")
def q_full_response(spark, sf_dir):
    k = F.col("c_custkey")
    body = F.concat(F.lit("mail user"), k.cast("string"), F.lit("@example.com")).cast("binary")
    files = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 3 == 0, "f.exe").otherwise("f.txt").alias("filename"), body.alias("content"))
    engine = Engine(SanitizeConfig(style="placeholder"))
    return engine.full_response(engine.sanitize_files(files)).select(F.col("doc_id").alias("k"), "response")


@query("""SELECT c_custkey AS k, true AS timed, '{"level":"INFO","message":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"status":' || c_custkey ELSE '' END || '}' AS line FROM customer""")
def q_log_line(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), report.log_line(F.lit("INFO"), F.col("c_name"), status=F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))).alias("line"))
    stamp = r'"timestamp":"\d{4}-\d\d-\d\dT[0-9:.]+(?:Z|[+-]\d\d:\d\d)",'
    return made.select("k", F.col("line").rlike(stamp).alias("timed"), F.regexp_replace("line", stamp, "").alias("line"))


@query("SELECT 'region.parquet' AS filename, true AS filled UNION ALL SELECT 'nation.parquet', true")
def q_path_source(spark, sf_dir):
    made = formats.read_files(spark, sf_dir, max_size=10_000_000, pattern="{region,nation}.parquet")
    return made.select("filename", (F.length("content") == F.col("length")).alias("filled"))


@query("""SELECT * FROM (VALUES ('', false, 'all'), ('', true, 'all'), (' EMAIL , IBAN,', false, 'EMAIL|IBAN'), ('EMAIL,NOPE', false, 'error'), ('EMAIL,NOPE', true, 'all'), ('level=loud', false, 'error'), ('level=loud', true, 'standard'), ('level=strict', true, 'strict'))
  v(value, lenient, reading)""")
def q_config_reading(spark, sf_dir):
    """Entity lists and levels as the strict and the lenient interface read them."""

    def reading(value: str, lenient: bool) -> str:
        try:
            if value.startswith("level="):
                return (lenient_config(level=value[6:]) if lenient else SanitizeConfig(level=value[6:])).level
            return "|".join(parse_entities(value, lenient) or ("all",))
        except ValueError:
            return "error"

    cases = [(v, n) for v, ns in (("", (False, True)), (" EMAIL , IBAN,", (False,)), ("EMAIL,NOPE", (False, True)), ("level=loud", (False, True)), ("level=strict", (True,))) for n in ns]
    rows = [F.struct(F.lit(v).alias("value"), F.lit(n).alias("lenient"), F.lit(reading(v, n)).alias("reading")) for v, n in cases]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _streamed(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over the files there are has written when it ends."""
    name = f"streamed_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as audit entries that arrive as files."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # In microseconds since the epoch, so that no time zone plays a part.
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return events.select(at.alias("timestamp"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("success").alias("status"), (F.col("event_id") % 97).alias("processing_time_ms"))


@query("SELECT count(*) AS requests_total, count(*) FILTER (WHERE event_id % 7 <> 0) AS requests_success, count(*) FILTER (WHERE event_id % 7 = 0) AS requests_failed, CAST(round_even(sum(event_id % 97) / count(*), 0) AS BIGINT) AS avg_processing_time_ms FROM events")
def q_running_metrics(spark, sf_dir):
    return _streamed(jobs.running_metrics(_event_stream(spark, sf_dir)), "complete")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS requests, count(*) FILTER (WHERE event_id % 7 = 0) AS failed FROM events GROUP BY ALL")
def q_windowed_metrics(spark, sf_dir):
    made = _streamed(jobs.windowed_metrics(_event_stream(spark, sf_dir), "10 minutes", "1 day"), "complete")
    return made.select(F.unix_micros("window.start").alias("start_us"), "requests", "failed")
