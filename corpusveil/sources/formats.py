"""Files as rows: content-type resolution, gates, and the routing of files to extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

PDF_MAGIC = bytes("%PDF", "ascii")


def registry(spark: SparkSession) -> DataFrame:
    """mime, category, extension (null where none names it); a fixed table of some twenty rows."""
    rows = [(m, c, e) for m, (c, exts) in fixed.FORMATS.items() for e in (exts or (None,))]
    made = F.array(*[F.struct(F.lit(m).alias("mime"), F.lit(c).alias("category"), F.lit(e).cast("string").alias("extension")) for m, c, e in rows])
    return spark.range(1).select(F.inline(made))


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))


def resolve_mime(filename: Column, content: Column | None = None, declared: Column | None = None) -> Column:
    """A registered declared type, else the one of the extension, else PDF by its first four
    bytes, else null (unsupported)."""
    by_ext = _lookup({e: m for m, (_, exts) in fixed.FORMATS.items() for e in exts}, extension(filename))
    found = [F.when(declared.isin(*fixed.FORMATS), declared)] if declared is not None else []
    found.append(by_ext)
    if content is not None:
        found.append(F.when(F.substring(content, 1, 4) == F.lit(PDF_MAGIC), "application/pdf"))
    return F.coalesce(*found)


def category(mime: Column) -> Column:
    return _lookup({m: c for m, (c, _) in fixed.FORMATS.items()}, mime)


def gate(length: Column, mime: Column, max_size: int) -> Column:
    """Null, or why the file is refused: too large, or of no supported type."""
    too_large = F.concat(F.lit(f"File exceeds maximum size of {max_size} bytes: "), length.cast("string"))
    return F.when(length > max_size, too_large).when(mime.isNull(), "Unsupported file format")


def read_files(spark: SparkSession, path: str, max_size: int | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id (a hash of the path), filename, length, content. The size gate is a filter on
    length, which Spark applies before it reads a file's bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    if max_size is not None:
        files = files.filter(F.col("length") <= max_size)
    return files.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")


def split_paths(paths: Column, most: int = 10) -> Column:
    """Paths of a comma-separated list, trimmed, without empty ones; at most `most`."""
    return F.slice(F.filter(F.transform(F.split(paths, ","), lambda p: F.btrim(p)), lambda p: p != ""), 1, most)


def from_base64(encoded: Column) -> Column:
    """struct<content, error>; strict decoding, so stray characters are an error."""
    content = F.try_to_binary(encoded, F.lit("base64"))
    return F.struct(content.alias("content"), F.when(content.isNull(), "Invalid base64 content").alias("error"))


def decoded(content: Column) -> Column:
    """UTF-8 text, each malformed sequence replaced."""
    return F.make_valid_utf8(content.cast("string"))
