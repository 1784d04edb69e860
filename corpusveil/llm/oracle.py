"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS rank FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap,
             coalesce(sum(3 * source_size) OVER p, 0) AS filled, coalesce(sum(w) OVER p, 0) AS used,
             sum(source_size) OVER () AS total, sum(w) OVER () AS weight
      FROM s WINDOW p AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (weight - used) < w * (total - filled) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
             (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE * w / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d)
SELECT c.doc_id, c.size, t.source_size, t.target,
       CAST(c.size * len(list_filter([0, 1, 2], lambda e: c.size > 0 AND c.b + e * t.source_size + c.size / 2.0 <= t.target)) AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""

_PHRASES = "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|lorem ipsum|click here|subscribe to our newsletter|sign up for|skip to content|back to top|share on facebook|follow us on|todos los derechos reservados|política de cookies|política de privacidad|aviso legal|tous droits réservés|politique de confidentialité|mentions légales|conditions d’utilisation|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
n AS (SELECT k, i, list_slice(words, i, i + 7) AS g FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM n) WHERE c > 1),
rep AS (SELECT k, sum(least(8, i - last))::BIGINT AS n FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -8) AS last FROM dup) GROUP BY k),
l AS (SELECT k, i, line, len(regexp_extract_all(line, '{WORD}')) AS n
      FROM (SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT k, string_split(text, chr(10)) AS lines FROM w))),
j AS (SELECT *, n > 0 AND ((len(regexp_extract_all(line, '[|»›→•]')) >= 3 AND 3 * len(regexp_extract_all(line, '[|»›→•]')) >= n)
          OR (n <= 12 AND regexp_matches(lower(line), '{_PHRASES}'))
          OR len(regexp_extract_all(line, '[#*$%&|<>]')) > n
          OR (n >= 4 AND 2 * len(regexp_extract_all(line, '!!')) >= n)
          OR (n >= 40 AND NOT regexp_matches(line, '[.,;:!?…。！？、،]'))) AS fails FROM l),
a AS (SELECT k, (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup, count(*) FILTER (fails) AS removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fails), '') AS cleaned, coalesce(sum(CASE WHEN fails THEN length(regexp_replace(line, '{SPACE}', '', 'g')) END), 0)::BIGINT AS lost FROM j GROUP BY k),
r AS (SELECT w.doc_id, len(w.words) AS n_words, length(regexp_replace(w.text, '{SPACE}', '', 'g')) AS word_chars,
             len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(a.n_dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, a.removed AS n_removed_lines, a.lost AS lost_chars, sha256(a.cleaned) AS cleaned_sha256
      FROM w LEFT JOIN a USING (k) LEFT JOIN rep USING (k))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept FROM r
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS t FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

# The answer of the next id differs from the own one or is the same text; both are covered: the
# prefix then swallows the last turn too.
OP7 = """
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
l AS (SELECT conv_id, max(i) AS at FROM n WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT n.conv_id, n.text FROM n JOIN l ON n.conv_id = l.conv_id AND n.i = l.at),
o AS (SELECT conv_id, first(text ORDER BY i) AS text FROM n WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT l.conv_id, l.at, a.text AS mine, coalesce(b.text, o.text) AS theirs FROM l JOIN a USING (conv_id) JOIN o USING (conv_id) LEFT JOIN a b ON b.conv_id = l.conv_id + 1),
t AS (SELECT p.conv_id, p.mine, p.theirs, p.mine = p.theirs AS same,
             coalesce(string_agg('<|im_start|>' || n.role || chr(10) || n.text || '<|im_end|>' || chr(10), '' ORDER BY n.i) FILTER (WHERE n.i < p.at OR p.mine = p.theirs), '') AS prompt,
             count(*) FILTER (WHERE n.i < p.at OR p.mine = p.theirs) AS prompt_turns
      FROM p JOIN n ON n.conv_id = p.conv_id AND n.i <= p.at GROUP BY ALL)
SELECT conv_id, prompt_turns, sha256(prompt) AS prompt_sha256,
       sha256(CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || mine || '<|im_end|>' || chr(10) END) AS chosen_sha256,
       CASE WHEN same THEN '' ELSE '22:' || (length(mine) + 32) END AS chosen_mask,
       sha256(CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || theirs || '<|im_end|>' || chr(10) END) AS rejected_sha256,
       CASE WHEN same THEN '' ELSE '22:' || (length(theirs) + 32) END AS rejected_mask
FROM t
"""

ORACLE_SQL = {"op7_preferences": OP7, "op3_mixing": OP3, "op4_quality_rules": OP4, "op6_exact_dedup": OP6}
