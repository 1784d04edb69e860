"""Operators on literal inputs, edge cases included."""

import pytest
from pyspark.sql import functions as F

from corpusveil.config import SanitizeConfig, lenient_config, parse_entities
from corpusveil.functions import checksum, expr, fixed
from corpusveil.operators import detect, limiter, merge, redact, report, spans, visual
from corpusveil.plans.engine import Engine, register_sql_functions
from corpusveil.sources import formats, providers


def column(spark, rows, kind="string"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}").orderBy("i")


def each(spark, rows, f, kind="string"):
    return [r[0] for r in column(spark, rows, kind).select(f(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def matches(spark, rows, pattern):
    return [[m.text for m in r] if r is not None else None for r in each(spark, rows, lambda v: expr.find_all(v, pattern))]


def test_find_all_offsets(spark):
    text = "a 612345678 ñ😀 612 345 678"
    hits = each(spark, [text, "", None], lambda v: expr.find_all(v, fixed.PHONE_LOCAL))
    assert [(h.start, h.end) for h in hits[0]] == [(2, 11), (15, 26)]
    assert all(text[h.start : h.end] == h.text for h in hits[0])
    assert hits[1:] == [[], None]


def test_title_case(spark):
    rows = ["GARCIA LOPEZ, MARIA", "Juan dni A B", "ÁNGEL Ñ ABC1", "GÜELL", ""]
    assert each(spark, rows, expr.title_case_caps) == ["Garcia Lopez, Maria", "Juan dni A B", "Ángel Ñ ABC1", "GÜELL", ""]


def test_places_and_replacement(spark):
    got = each(spark, ["abcabc", "xyz", "", None], lambda v: F.struct(expr.first_at(v, F.lit("bc")), expr.last_at(v, F.lit("bc")), expr.replace_last(v, F.lit("bc"), F.lit("-")), expr.replace_first(v, F.lit("bc"), F.lit("-"))))
    assert [tuple(g) for g in got[:3]] == [(1, 4, "abca-", "a-abc"), (-1, -1, "xyz", "xyz"), (-1, -1, "", "")]


def test_checksums(spark):
    assert each(spark, ["12345678Z", "12345678A", "X1234567L", "x", ""], checksum.nif_valid) == [True, False, True, False, False]
    rows = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051333", "GB82 WEST 1234 5698 7654 32", "nope", ""]
    assert each(spark, rows, checksum.iban_valid) == [True, False, True, False, False]


@pytest.mark.parametrize("text", ["+34 612 345 678", "+34 612345678", "+34-612-345-678", "+34.612.345.678", "+34 912 345 678"])
def test_phone_with_prefix(spark, text):
    assert matches(spark, [text], fixed.PHONE_INTL) == [[text]]


def test_phone_local_and_rejects(spark):
    rows = ["612345678", "612 345 678", "912345678", "12345", "+1 555 123 4567", "text", ""]
    assert matches(spark, rows, fixed.PHONE_LOCAL) == [["612345678"], ["612 345 678"], ["912345678"], [], [], [], []]


def test_address_quirks(spark):
    assert matches(spark, ["Calle Mayor 15, 28001 Madrid"], fixed.ADDRESS_FULL) == [["Calle Mayor 15, 280"]]
    assert matches(spark, ["28001 - Madrid (Madrid)"], fixed.POSTAL_CITY) == [["28001 - Madrid (Madrid)"]]
    assert matches(spark, ["URBANIZACION LOS PINOS 3"], fixed.ADDRESS_FULL) == [["URBANIZACION LOS PINOS 3"]]


def test_detect_line(spark):
    text = "Juan Garcia, DNI: 12345678Z, email: juan@example.com, tel: +34 612345678, IBAN: ES9121000418450200051332"
    found = each(spark, [text, " ", None], lambda v: detect.detect(v))
    assert {(f.entity_type, f.original_text) for f in found[0]} >= {("DNI_NIE", "12345678Z"), ("EMAIL", "juan@example.com"), ("PHONE", "+34 612345678")}
    assert any(f.entity_type == "IBAN" and "ES9121000418450200051332" in f.original_text for f in found[0])
    assert all(text[f.start : f.end] == f.original_text for f in found[0])
    assert found[1:] == [[], []]


def test_levels_and_context(spark):
    rows = ["Vive en Calle Mayor 15", "nacido el 01/02/1980", "pagado el 01/02/1980"]
    standard = each(spark, rows, lambda v: F.transform(detect.detect(v), lambda f: f.entity_type))
    strict = each(spark, rows, lambda v: F.transform(detect.detect(v, SanitizeConfig(level="strict")), lambda f: f.entity_type))
    assert standard == [[], ["DATE_OF_BIRTH"], []] and strict[0] == ["ADDRESS"]


def test_person_filter(spark):
    rows = ["Garcia Lopez, Maria", "APELLIDOS\nGarcia\nNOMBRE\nAna", "Ana", "Ana de Castro", "Condiciones Generales, Ana", "A B C D E", ""]
    assert each(spark, rows, detect.plausible_person) == [True, True, False, False, False, False, False]


def test_merge(spark):
    f = lambda e, t, s: F.struct(F.lit(e).alias("entity_type"), F.lit(t).alias("original_text"), F.lit(s).alias("score"))
    one = lambda old, new: [tuple(x) for x in spark.range(1).select(merge.merge(F.array(*old), F.array(*new) if new else F.array().cast(merge.LAYER))).first()[0]]
    old = [f("EMAIL", "Ana@x.es", 0.5)]
    assert one(old, [f("PERSON_NAME", " ana ", 0.9)]) == [("PERSON_NAME", " ana ", 0.9)]
    assert one(old, [f("PERSON_NAME", "ana", 0.5)]) == [("EMAIL", "Ana@x.es", 0.5)]
    assert one(old, [f("PHONE", None, 0.9)])[1] == ("PHONE", None, 0.9)
    assert one(old, []) == [("EMAIL", "Ana@x.es", 0.5)]
    assert each(spark, ["Person", "pet", "driver license"], merge.label_type) == ["PERSON_NAME", "SENSITIVE_DATA", "SENSITIVE_DATA"]


def test_redaction(spark):
    text = "Mi nombre es Juan Garcia y mi DNI es 12345678Z"
    found = F.array(*[F.struct(F.lit(e).alias("entity_type"), F.lit(t).alias("original_text")) for e, t in (("PERSON_NAME", "Juan Garcia"), ("DNI_NIE", "12345678Z"), ("EMAIL", None), ("EMAIL", ""), ("EMAIL", "missing"))])
    black = each(spark, [text], lambda v: redact.redact_text(v, found, "black"))[0]
    assert black == "Mi nombre es " + "█" * 11 + " y mi DNI es " + "█" * 9 and len(black) == len(text)
    for style in ("blur", "placeholder"):
        assert each(spark, [text], lambda v, s=style: redact.redact_text(v, found, s)) == ["Mi nombre es [PERSON_NAME] y mi DNI es [DNI_NIE]"]
    assert each(spark, ["a Juan Garcia b Juan Garcia"], lambda v: redact.redact_cell(v, found, "placeholder")) == ["a [PERSON_NAME] b [PERSON_NAME]"]
    assert each(spark, ["a.pdf", "x/b.tar.gz", "c", ".d"], redact.output_filename) == ["a_sanitized.pdf", "b.tar_sanitized.gz", "c_sanitized", ".d_sanitized"]


def test_offsets_agree_with_search(spark):
    rows = [f"Email: user{i}@example.com DNI: {i:08d}{fixed.NIF_LETTERS[i % 23]}" for i in range(20)]
    cfg = SanitizeConfig(style="placeholder")
    docs = column(spark, rows).withColumnRenamed("v", "text").withColumnRenamed("i", "doc_id")
    fast, slow = (Engine(cfg).sanitize(docs, fast=f).orderBy("doc_id").collect() for f in (True, False))
    assert [r.sanitized for r in fast] == [r.sanitized for r in slow] == ["Email: [EMAIL] DNI: [DNI_NIE]"] * 20
    assert all(sum(r.summary.by_type.values()) == r.summary.total_findings for r in fast)
    assert Engine(SanitizeConfig(response="json")).sanitize(docs).first().sanitized is None


def test_spans(spark):
    rows = [(1, 0, "", "Juan", 0, 0.0, 0.0, 40.0, 10.0), (1, 1, " ", "Garcia", 0, 45.0, 0.0, 100.0, 10.0)]
    placed = spans.with_offsets(spark.createDataFrame(rows, "doc_id long, seq int, sep string, text string, page int, x0 double, y0 double, x1 double, y1 double"))
    asked = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 11), (1, 4), (3, 6), (100, 200), (-5, 1), (4, 4), (2, 2)])], "doc_id long, finding int, start int, end int")
    n = {r.finding: r["count"] for r in spans.resolve(asked, placed).groupBy("finding").count().collect()}
    assert n == {0: 2, 1: 1, 2: 2, 4: 1, 6: 1}
    box = {r.finding: (r.page, r.x0, r.x1) for r in spans.located(asked, placed).collect()}
    assert box[0] == (0, 0.0, 100.0) and box[3] == (None, None, None)
    assert spans.assembled(placed).first().text == "Juan Garcia"


def test_corners(spark):
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 0), (10, 10), (0, 0), (0, 10))])
    assert [tuple(c) for c in spark.range(1).select(visual.ordered_corners(p)).first()[0]] == [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_reports(spark):
    docs = column(spark, ["a@b.es c@d.es", "nothing"]).withColumnRenamed("v", "text")
    found = detect.with_findings(docs).select("i", F.lit("f").alias("filename"), F.col("text").cast("binary").alias("content"), F.lit(b"").alias("sanitized"), "findings", F.lit(5).alias("ms"), F.when(F.col("i") == 1, "bad").alias("error"))
    audit = report.audit(found, "standard")
    rows = {r.total_findings: r for r in audit.collect()}
    assert rows[2].findings_by_type == {"EMAIL": 2} and rows[2].output_hash is None and rows[0].status == "error"
    assert "a@b.es" not in str(audit.collect())
    m = report.metrics(audit).first()
    assert (m.requests_total, m.requests_success, m.requests_failed, m.avg_processing_time_ms) == (2, 1, 1, 5)
    assert report.metrics(audit.filter("false")).first().avg_processing_time_ms == 0


def test_limiter(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("a", i, t0 + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 59, 60, 61])] + [("b", 9, t0)]
    events = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    got = {r.id: r for r in limiter.rate_limited(events, "k", "ts", "id", 3, 60).collect()}
    assert [got[i].accepted for i in range(7)] == [True, True, True, False, False, True, True] and got[9].accepted
    assert got[3].retry_after_s == 58 and got[0].remaining == 2 and got[0].retry_after_s is None
    assert all(r.accepted for r in limiter.rate_limited(events, "k", "ts", "id", 0, 60).collect())
    assert limiter.rate_limited(events.filter("false"), "k", "ts", "id").count() == 0


def test_config():
    assert parse_entities(" EMAIL, PHONE ,") == ("EMAIL", "PHONE") and parse_entities("") is None and parse_entities("X", lenient=True) is None
    with pytest.raises(ValueError, match="Unknown"):
        parse_entities("EMAIL,X")
    for bad in ({"level": "x"}, {"style": "x"}, {"response": "x"}, {"redact_entities": ("x",)}):
        with pytest.raises(ValueError):
            SanitizeConfig(**bad)
    assert lenient_config("x", "x", "x", "x") == SanitizeConfig()


def test_formats_and_providers(spark):
    got = each(spark, ["a.PDF", "b.htm", "x/c.odt", "noext", "e.exe"], lambda v: formats.resolve_mime(v))
    assert got[:3] == ["application/pdf", "text/html", "application/vnd.oasis.opendocument.text"] and got[3:] == [None, None]
    assert formats.registry(spark).select("mime").distinct().count() == 17
    with pytest.raises(RuntimeError, match="required"):
        providers.provider("ocr")
    with pytest.raises(ValueError):
        providers.register("nope", object())


def test_ner_provider(spark):
    class Names:
        def predict(self, documents, labels):
            return documents.withColumn("predictions", F.array(F.struct(F.lit("person").alias("label"), F.lit("Ana").alias("text"), F.lit(0.875).alias("score"))))

    providers.register("ner", Names())
    try:
        merged = Engine().detect(column(spark, ["Ana a@b.es"]).withColumnRenamed("v", "text")).first().merged
    finally:
        providers.unregister("ner")
    assert ("PERSON_NAME", "Ana", 0.88) in [tuple(m) for m in merged]


def test_sql_functions(spark):
    register_sql_functions(spark)
    assert spark.sql("SELECT mask_text('EMAIL', 'abc', 'black') a, mask_text('EMAIL', 'abc', 'blur') b, nif_letter(12345678) c").first() == ("███", "[EMAIL]", "Z")


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"mail a@b.es \xff")
    (tmp_path / "b.json").write_text('{"m": "a@b.es", "n": 1}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "c.exe").write_text("x")
    files = formats.read_files(spark, str(tmp_path))
    got = {r.filename: r for r in Engine(SanitizeConfig(style="placeholder")).sanitize_files(files).collect()}
    assert bytes(got["a.txt"].sanitized).decode() == "mail [EMAIL] �" and '"[EMAIL]"' in bytes(got["b.json"].sanitized).decode()
    assert got["bad.json"].status == "error" and got["c.exe"].error == "Unsupported file format"
