"""PDF text and pixels: the parts that the registered queries do not reach."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from corpusveil.config import SanitizeConfig
from corpusveil.operators import pixels
from corpusveil.plans.engine import Engine
from corpusveil.sources import parsers, pdf, png, samples


def one_page(content: bytes, font: bytes, more: bytes = b"") -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[4 0 R]/MediaBox[0 0 200 100]>> endobj\n"
        b"3 0 obj " + font + b" endobj 4 0 obj <</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>/XObject<</X 9 0 R>>>>/Contents[5 0 R]>> endobj\n"
        b"5 0 obj <</Length 6 0 R>> stream\n" + content + b"\nendstream endobj 6 0 obj " + str(len(content)).encode() + b" endobj\n" + more + b"trailer <</Root 1 0 R>>"
    )


def test_strings_and_spacing():
    simple = b"<</Type/Font/Subtype/Type1/FirstChar 97/Widths[500 500 500]/Encoding<</Differences[97/eacute/ntilde/uni20AC 100/fi]>>>>"
    body = rb"BT /F 10 Tf 1 0 0 1 10 50 Tm (a\142\143) Tj 30 0 Td <61> Tj 0 -12 Td [(a) -2000 (b)] TJ (\(x\)\\) ' ET q 2 0 0 2 0 0 cm /X Do Q"
    form = b"9 0 obj <</Subtype/Form/Length 40>> stream\nBT /F 5 Tf 10 10 Td (d) Tj ET\nendstream endobj\n"
    found, pages = pdf.spans(one_page(body, simple, form))
    assert pages == 1 and [(s.sep, s.text) for s in found] == [("", "éñ€"), (" ", "é"), ("\n", "é"), (" ", "ñ"), (" ", "(x)\\"), ("\n", "fi")][: len(found)]
    first = found[0]
    assert (first.x0, first.x1) == (10, 25) and abs(first.y0 - 42) < 1e-9 and abs(first.y1 - 52) < 1e-9


def test_two_byte_codes():
    font = b"<</Type/Font/Subtype/Type0/ToUnicode 7 0 R/DescendantFonts[<</DW 1000/W[1[600 700] 5 7 250]>>]>>"
    cmap = b"1 begincodespacerange <0000><ffff> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0002><0003><0061> <0005><0006>[<4E2D><D83DDE00>] endbfrange"
    more = b"7 0 obj <</Length %d>> stream\n" % len(cmap) + cmap + b"\nendstream endobj\n"
    found, _ = pdf.spans(one_page(b"BT /F 10 Tf 10 50 Td <000100020003000500060009> Tj ET", font, more))
    assert [s.text for s in found] == ["Hiab中😀�"] and abs(found[0].x1 - 10 - (6 + 7 + 10 + 2.5 + 2.5 + 10)) < 1e-9


def test_unreadable_pdf(spark):
    good = samples.pdf([["line one", "line two"]])
    bad = [b"", b"no pdf", good.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R"), good.replace(b"/FlateDecode", b"/LZWDecode"), b"%PDF-1.4 1 0 obj << /Type /Catalog"]
    files = spark.createDataFrame([(i, bytearray(c), parsers.PDF) for i, c in enumerate([*bad, good, good[: len(good) - 40]])], "doc_id int, content binary, mime string")
    got = {r.doc_id: r for r in parsers.extract(files).collect()}
    assert all(got[i].text is None and got[i].error for i in range(4)) and got[5].text == got[6].text == "line one\nline two\n\n"
    placed = {(r.doc_id, r.seq): r for r in parsers.pdf_spans(files).collect()}
    assert {k for k, _ in placed} == {5, 6} and placed[5, 1].sep == "\n" and placed[5, 0].page == 0 and placed[5, 0].x0 == 50


def filtered(image: np.ndarray, kinds: list[int]) -> bytes:
    """Rows with the given filters, by the definition."""
    h, w, c = image.shape
    rows = image.reshape(h, -1).astype(int)
    out = b""
    for y in range(h):
        line = []
        for i in range(w * c):
            a, b = rows[y, i - c] if i >= c else 0, rows[y - 1, i] if y else 0
            d = rows[y - 1, i - c] if y and i >= c else 0
            near = min((abs(a + b - d - v), k, v) for k, v in enumerate((a, b, d)))[2]
            line.append((rows[y, i] - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        out += bytes([kinds[y], *line])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    image = np.random.default_rng(channels).integers(0, 256, (10, 7, channels), np.uint8)
    assert (png.decode(filtered(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])) == image).all() and (png.decode(png.encode(image)) == image).all()
    for bad in (b"", png.encode(image)[:40], png.encode(image).replace(b"IDAT", b"IDAX")):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)


def test_components_against_flood_fill():
    rng = np.random.default_rng(3)
    for density in (0.1, 0.4, 0.6):
        mask = rng.random((30, 40)) < density
        seen, want = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                r, c = todo.pop()
                cells.append((r, c))
                for i in range(max(0, r - 1), min(30, r + 2)):
                    for j in range(max(0, c - 1), min(40, c + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
            r, c = np.array(cells).T
            want.append([c.min(), r.min(), np.ptp(c) + 1, np.ptp(r) + 1, len(cells)])
        assert sorted(pixels.components(mask).tolist()) == sorted(np.array(want).tolist())
    assert len(pixels.components(np.zeros((3, 3), bool))) == 0


def test_ink_and_signature(spark):
    """Strokes close to each other are one component, found at the strict level only."""
    image = np.full((300, 400, 3), 240, np.uint8)
    for k in range(12):
        image[150 + (k % 3) * 12 : 152 + (k % 3) * 12, 100 + k * 9 : 106 + k * 9] = 10
    image[150:176, 100:102] = image[150:176, 206:208] = image[174:176, 100:208] = image[150:152, 100:208] = 10
    mask = pixels.ink(png.grey(image))
    assert mask[151, 104] and not mask[10, 10]
    assert (pixels.closed(mask) >= mask).all()
    images = spark.createDataFrame([(1, bytearray(png.encode(image))), (2, bytearray(b"broken")), (3, None)], "doc_id int, content binary")
    strict = Engine(SanitizeConfig(level="strict"))
    found = strict.visual(images).collect()
    assert len(found) == 1 and found[0].entity_type == "SIGNATURE" and 0.4 <= found[0].score <= 0.6
    assert Engine().visual(images).count() == 0
    made = {r.doc_id: r for r in strict.sanitize_images(images).collect()}
    out = png.decode(bytes(made[1].sanitized))
    assert (out[155:170, 105:200] == 0).all() and (out[:100] == 240).all() and bytes(made[2].sanitized) == b"broken"


def test_ink_in_bands():
    """Bands of rows give the ink of the whole image, whatever its contrast."""
    rng, at = np.random.default_rng(5), np.arange(-7, 8)
    weights = np.exp(-(at**2) / (2 * (0.3 * (14 * 0.5 - 1) + 0.8) ** 2))
    for low, h, w in ((0, 40, 33), (215, 50, 20), (228, 60, 60), (230, 3, 70)):
        grey = rng.integers(low, 231, (h, w)).astype(np.uint8)
        grey[h // 2 : h // 2 + 2, w // 3 : w // 2] = 100
        wide = np.pad(grey.astype(float), 7, mode="edge")
        across = sum(x / weights.sum() * wide[:, k : k + w] for k, x in enumerate(weights))
        mean = np.rint(sum(x / weights.sum() * across[k : k + h] for k, x in enumerate(weights)))
        assert (pixels.ink(grey) == (grey <= mean - 10)).all()


def test_images_are_dealt_out(spark):
    """The keys lie in one file; the images made of them are not one task's work."""
    from corpusveil.catalogue import QUERIES
    from tests.oracle import DATA

    for name in ("q_ink_components", "q_image_redact"):
        assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_png_rows_are_differences():
    """Runs of rows with one filter are undone together; what is written has its rows as differences."""
    image = np.random.default_rng(6).integers(0, 256, (30, 9, 3), dtype=np.uint8)
    image[10:20] = image[10]
    for kind in range(5):
        assert (png.decode(filtered(image, [kind] * 30)) == image).all()
    assert (png.decode(filtered(image, [2, 2, 2, 1, 1, 0, 0, 4, 4, 3] * 3)) == image).all()
    made = png.encode(image)
    at = made.index(b"IDAT") + 4
    raw = np.frombuffer(zlib.decompressobj().decompress(made[at:]), np.uint8).reshape(30, -1)
    assert raw[0, 0] == 0 and (raw[1:, 0] == 2).all() and not raw[11:20, 1:].any() and (png.decode(made) == image).all()
    same = np.repeat(image[:, :, :1], 4, axis=2)
    assert (png.grey(same) == image[:, :, 0]).all()
