"""SQL for DuckDB with the rows of the queries that SQL can express."""

from tilewright.llm import licenses

OP1 = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
           FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations)),
a AS (SELECT conv_id, max(i) AS i, arg_max(text, i) AS good, CASE WHEN count(*) > 1 THEN arg_min(text, i) ELSE '' END AS bad FROM t WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT conv_id, good, bad, CASE WHEN good = bad THEN i ELSE i - 1 END AS n FROM a),
p AS (SELECT b.conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS prompt
      FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i <= b.n GROUP BY b.conv_id)
SELECT b.conv_id, CAST(n AS INTEGER) AS n_prefix_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN good = bad THEN '' ELSE '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) END AS chosen,
  CASE WHEN good = bad THEN '' ELSE '<|im_start|>assistant' || chr(10) || bad || '<|im_end|>' || chr(10) END AS rejected,
  CASE WHEN good = bad THEN '' ELSE '22-' || (32 + length(good)) END AS chosen_mask,
  CASE WHEN good = bad THEN '' ELSE '22-' || (32 + length(bad)) END AS rejected_mask
FROM b LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op9() -> str:
    form = f"trim(regexp_replace(regexp_replace(lower(TEXT), {_quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for a, b in licenses.SPELLINGS:
        form = f"replace({form}, {_quoted(a)}, {_quoted(b)})"
    digest = f"sha256(nullif({form}, ''))"
    values = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.known())
    return f"""
WITH k AS (SELECT {digest.replace("TEXT", "t")} AS digest, min(license) AS license FROM (VALUES {values}) v(license, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {digest.replace("TEXT", "text")} AS digest FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT r, list_sort(list(DISTINCT license)) AS notices, count(*) AS n FROM (SELECT r, {digest.replace("TEXT", "line")} AS digest FROM l) x JOIN k USING (digest) GROUP BY r)
SELECT doc_id, d.digest, k.license, coalesce(array_to_string(notices, ','), '') AS notices, coalesce(h.n, 0) AS n_notice_lines
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN h ON d.r = h.r
"""


OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM d),
g AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) AS BIGINT) AS n_alnum, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON w.r = c.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN 100000 * (word_chars - n_alnum) // word_chars ELSE 0 END AS mark_ratio,
        CASE WHEN n_lines > 0 THEN 100000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN 100000 * n_repeat_words // n_words ELSE 0 END AS repeat_ratio,
        CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length FROM m),
x AS (UNPIVOT v ON mark_ratio, dup_line_ratio, repeat_ratio, word_length INTO NAME ratio VALUE pos),
p AS (SELECT lang, source, ratio, (pos >> greatest(0, length(bin(pos)) - 8)) << greatest(0, length(bin(pos)) - 8) AS pos FROM x WHERE NOT base_failed),
s AS (SELECT 1 AS level, lang, source, ratio, pos, count(*) AS n FROM p GROUP BY ALL
      UNION ALL SELECT 2, lang, NULL, ratio, pos, count(*) FROM p GROUP BY ALL
      UNION ALL SELECT 3, NULL, NULL, ratio, pos, count(*) FROM p GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY pos) AS up, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM s),
q AS (SELECT level, lang, source, ratio, min(pos) FILTER (100 * up >= CASE WHEN ratio IN ('mark_ratio', 'word_length') THEN 25 ELSE 50 END * total) AS a,
        min(pos) FILTER (100 * up >= CASE WHEN ratio IN ('mark_ratio', 'word_length') THEN 75 ELSE 99 END * total) AS b FROM u WHERE level = 3 OR total >= 100 GROUP BY ALL),
e AS (SELECT level, lang, source, ratio, CASE WHEN ratio = 'word_length' THEN a - 6 * (b - a) END AS low, b + CASE WHEN ratio IN ('mark_ratio', 'word_length') THEN 6 ELSE 1 END * (b - a) AS high FROM q WHERE b > a OR level = 3),
z AS (SELECT x.r, x.ratio, x.pos, coalesce(a.high, b.high, c.high) AS high, coalesce(a.low, b.low, c.low) AS low
      FROM x LEFT JOIN e a ON a.level = 1 AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source AND a.ratio = x.ratio
             LEFT JOIN e b ON b.level = 2 AND b.lang IS NOT DISTINCT FROM x.lang AND b.ratio = x.ratio
             LEFT JOIN e c ON c.level = 3 AND c.ratio = x.ratio),
y AS (SELECT r, bool_or(coalesce(pos > high, false) OR coalesce(pos < low, false)) AS beyond, max(high) FILTER (ratio = 'mark_ratio') AS f1, max(high) FILTER (ratio = 'dup_line_ratio') AS f2,
        max(high) FILTER (ratio = 'repeat_ratio') AS f3, max(high) FILTER (ratio = 'word_length') AS f4 FROM z GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept,
  CAST(mark_ratio AS BIGINT) AS mark_ratio, CAST(dup_line_ratio AS BIGINT) AS dup_line_ratio, CAST(repeat_ratio AS BIGINT) AS repeat_ratio, CAST(word_length AS BIGINT) AS word_length,
  CAST(f1 AS BIGINT) AS mark_ratio_fence, CAST(f2 AS BIGINT) AS dup_line_ratio_fence, CAST(f3 AS BIGINT) AS repeat_ratio_fence, CAST(f4 AS BIGINT) AS word_length_fence
FROM v LEFT JOIN y ON v.r = y.r
"""
