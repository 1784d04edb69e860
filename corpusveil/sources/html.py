"""HTML text natively: one line per text node, without script, style, comments and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references that pages use most; numeric ones are not decoded here.
NAMED = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&euro;": "€", "&reg;": "®", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Text nodes stripped, empty ones dropped, joined by line breaks. Script and style bodies
    are cut before tags, since they may hold tags in strings."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", "<x>")
    nodes = F.transform(F.split(bare, r"<[^>]*>"), lambda n: F.regexp_replace(decode_entities(n), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")


def redact_html(html: Column, findings: Column, replace: object) -> Column:
    """Every occurrence of each finding replaced in text nodes, comments, and the bodies of script
    and style; tags and attributes stay as they are. replace(type, text) gives the replacement column."""
    pattern = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
    texts, tags = F.split(html, pattern, -1), F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    usable = F.filter(findings, lambda f: F.coalesce(F.length(f.original_text) > 0, F.lit(False)))
    clean = lambda t: F.aggregate(usable, t, lambda a, f: F.replace(a, f.original_text, replace(f.entity_type, f.original_text)))

    def markup(tag: Column) -> Column:
        """A tag as it is; of what holds a text, all but its opening and closing mark cleaned."""
        part = lambda n: F.regexp_extract(tag, r"(?is)^(<(?:script|style)\b[^>]*>|<!--)(.*?)(</(?:script|style)\s*>|-->)$", n)
        return F.when(part(3) != "", F.concat(part(1), clean(part(2)), part(3))).otherwise(tag)

    return F.array_join(F.transform(F.arrays_zip(F.transform(texts, clean).alias("t"), F.transform(tags, markup).alias("g")), lambda p: F.concat(p.t, F.coalesce(p.g, F.lit("")))), "")
