"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, len(w[s:s + 12]) AS n, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, s, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""

_MEASURES = r"""
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, *, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {source}),
g AS (SELECT r, s, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, s FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, length(array_to_string(l, '')) AS line_chars,
    length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')) AS dup_line_chars,
    length(regexp_replace(body, '[^\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
bits AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 4 * n_words THEN 8 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN 5 * n_letters < 3 * word_chars THEN 32 ELSE 0 END + CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 128 ELSE 0 END + CASE WHEN 10 * dup_line_chars > 3 * line_chars THEN 256 ELSE 0 END AS fail_bits
  FROM m)
"""

QUALITY_RULES = f"""
WITH {_MEASURES.format(source="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM bits
"""

QUALITY_ABLATION = f"""
WITH {_MEASURES.format(source="documents")},
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('word_length', 4), ('symbols', 8), ('repeated_lines', 16), ('few_letters', 32), ('bullet_lines', 64), ('ellipsis_lines', 128), ('repeated_line_chars', 256))
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only FROM rules LEFT JOIN bits ON true GROUP BY rule
"""

QUALITY_POLICIES = f"""
WITH {_MEASURES.format(source="documents")}, policies(policy, mask) AS (VALUES ('base-1', 3), ('full-1', 31), ('full-2', 511))
SELECT policy, count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected FROM policies, bits GROUP BY policy
"""

_ESC = r"replace(replace(replace({}, '\', '\\'), '<', '\<'), '>', '\>')"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 16) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM a
"""

CHAT_LAYOUTS = rf"""
WITH c AS (SELECT conv_id, turn // 2 AS k, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (
  SELECT conv_id, count(*) = 2 AND list(role ORDER BY turn NULLS FIRST, role, text) = ['user', 'assistant'] AS pair,
    string_agg('<turn ' || {_ESC.format("role")} || '>' || chr(10) || {_ESC.format("text")} || '</turn>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
    coalesce(sum(length({_ESC.format("text")})) FILTER (role = 'assistant'), 0) AS loss
  FROM c GROUP BY conv_id, k)
SELECT conv_id, substr(sha256(CASE WHEN NOT pair THEN 'messages[].content' || chr(10) || 'messages[].role' ELSE [
    'messages[].content' || chr(10) || 'messages[].role', 'conversations[].from' || chr(10) || 'conversations[].value', 'prompt' || chr(10) || 'response', 'input' || chr(10) || 'instruction' || chr(10) || 'output'][conv_id % 4 + 1] END), 1, 16) AS layout,
  sha256(formatted) AS formatted_sha256, CAST(loss AS BIGINT) AS loss_chars
FROM g
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS o FROM g x JOIN g y USING (g) WHERE x.r <> y.r GROUP BY ALL) p
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least ON least.a = d.r
"""

URL_RULES = r"""
WITH rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
f AS (
  SELECT r, max_by(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) AS best
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""

_NEAREST = """
{a} AS MATERIALIZED (
  SELECT r, part, min(row(d, e)) AS best FROM (
    SELECT p.r, p.part, b.e, CAST(coalesce(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT) AS d
    FROM p JOIN {b} b USING (part)) GROUP BY r, part)"""
_RENEWED = """
{to} AS MATERIALIZED (
  SELECT part, e, coalesce(m.c, {b}.c) AS c FROM {b} LEFT JOIN (
    SELECT part, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT part, best[2] AS e, i, sum(y) AS s, count(*) AS n FROM (
        SELECT p.part, a.best, unnest(p.x) AS y, unnest(range(len(p.x))) AS i FROM p JOIN {a} a USING (r, part)) GROUP BY ALL)
    GROUP BY part, e) m USING (part, e))"""
VECTOR_CODES = (
    """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, v, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, v) - 1 AS e, x AS c FROM p) WHERE e < 64),"""
    + ",".join(_NEAREST.format(a=f"a{i}", b=f"b{i}") + "," + _RENEWED.format(a=f"a{i}", b=f"b{i}", to=f"b{i + 1}") for i in range(2))
    + ","
    + _NEAREST.format(a="a2", b="b2")
    + """,
f AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a2 GROUP BY r),
t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, e) FROM b2)) AS codebooks_sha256
FROM f JOIN k USING (r) JOIN t ON k.label IS NOT DISTINCT FROM t.label
"""
)

PERIODIC = r"""
WITH s AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, 4294967295), 4294967295) AS h
  FROM documents),
o AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM s),
d AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM o),
x AS MATERIALIZED (SELECT r, n, unnest(w) AS y, unnest(range(n)) AS i FROM d),
e AS (SELECT x.r, z.i - x.i AS q, x.i FROM x JOIN x z ON x.r = z.r AND x.y = z.y AND z.i > x.i AND z.i - x.i <= x.n // 4),
c AS MATERIALIZED (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS run FROM e)
  GROUP BY r, q, run HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c z WHERE z.r = c.r AND z.q < c.q AND c.q % z.q = 0 AND z.start <= c.start AND z.start + z.length >= c.start + c.length)),
m AS (
  SELECT r, count(*) AS n_runs, min(row(-length, start, q)) AS best, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS said FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
left_over AS (SELECT r, string_agg(y, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
  CAST(1000 * -best[1] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r) LEFT JOIN left_over USING (r)
"""
