"""Small office files made from texts: the inputs of the format queries and tests.

Only the parts that a reader needs are written. Characters that XML cannot hold are the caller's
to remove."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape, quoteattr

OPEN_DOCUMENT = "urn:oasis:names:tc:opendocument:xmlns"
OPEN_XML = "http://schemas.openxmlformats.org"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(paragraphs: Iterable[str]) -> bytes:
    """Each paragraph in two runs, cut in its middle."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = "".join(f"<w:p>{run(p[: len(p) // 2])}{run(p[len(p) // 2 :])}</w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="{OPEN_XML}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def _open(kind: str, body: str) -> bytes:
    spaces = " ".join(f'xmlns:{n}="{OPEN_DOCUMENT}:{n}:1.0"' for n in ("office", "table", "text"))
    return zipped({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {spaces}><office:body>{body}</office:body></office:document-content>"})


def odt(paragraphs: Iterable[str], cell: str = "") -> bytes:
    """Paragraphs, and a table of one cell if there is a text for it."""
    p = lambda t: f"<text:p>{escape(t)}</text:p>"
    table = f"<table:table><table:table-row><table:table-cell>{p(cell)}</table:table-cell></table:table-row></table:table>" if cell else ""
    return _open("text", f"<office:text>{''.join(map(p, paragraphs))}{table}</office:text>")


def ods(rows: Iterable[Sequence[tuple[str, int]]], sheet: str = "S") -> bytes:
    """Rows of (text, times the cell repeats)."""
    cell = lambda t, n: f'<table:table-cell table:number-columns-repeated="{n}">{f"<text:p>{escape(t)}</text:p>" if t else ""}</table:table-cell>'
    body = "".join(f"<table:table-row>{''.join(cell(*c) for c in row)}</table:table-row>" for row in rows)
    return _open("spreadsheet", f"<office:spreadsheet><table:table table:name={quoteattr(sheet)}>{body}</table:table></office:spreadsheet>")


def xlsx(rows: Iterable[Sequence[str | int]], sheet: str = "S") -> bytes:
    """Texts as shared strings, integers as numbers."""
    shared: dict[str, int] = {}

    def cell(ref: str, v: str | int) -> str:
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    body = "".join(f'<row r="{i}">{"".join(cell(f"{chr(65 + k)}{i}", v) for k, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    main, rel = f"{OPEN_XML}/spreadsheetml/2006/main", f"{OPEN_XML}/officeDocument/2006/relationships"
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{OPEN_XML}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in shared)}</sst>',
    })


def pdf(pages: Iterable[Sequence[str]], packed: bool = True) -> bytes:
    """Pages of lines in 10 point, 12 apart from the top; odd lines in pieces. Text in the
    Windows code page; the pages' objects lie in an object stream if packed."""
    shown = lambda t: b"(" + t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    streams, kids = {}, []
    for k, lines in enumerate(pages):
        body = [b"BT /F1 10 Tf 12 TL 1 0 0 1 50 780 Tm"]
        for i, line in enumerate(lines):
            body.append(b"[" + shown(line[: len(line) // 2]) + b" -20 " + shown(line[len(line) // 2 :]) + b"] TJ T*" if i % 2 else shown(line) + b" Tj T*")
        streams[5 + 2 * k] = zlib.compress(b"\n".join([*body, b"ET"]))
        objects[4 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k)
        kids.append(b"%d 0 R" % (4 + 2 * k))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [" % len(kids) + b" ".join(kids) + b"] >>"
    out = [b"%PDF-1.5\n"] + [b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (n, len(s)) + s + b"\nendstream\nendobj\n" for n, s in streams.items()]
    if packed:
        head, at = b"", 0
        for n, o in objects.items():
            head, at = head + b"%d %d " % (n, at), at + len(o) + 1
        data = zlib.compress(head + b"\n".join(objects.values()))
        last = 4 + 2 * len(kids)
        out.append(b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (last, len(objects), len(head), len(data)) + data + b"\nendstream\nendobj\n")
    else:
        out += [b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items()]
    return b"".join([*out, b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"])


def encrypted(content: bytes) -> bytes:
    """A zip file whose entries say that they are encrypted."""
    out = bytearray(content)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        start = -1
        while (start := out.find(mark, start + 1)) >= 0:
            out[start + at] |= 1
    return bytes(out)
