"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT *, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS grams FROM w),
e AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS p FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1),
h AS (SELECT doc_id, sum(least(3, coalesce(nxt - p, 3))) AS n_repeat_words
      FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM r) GROUP BY doc_id),
c AS (SELECT g.doc_id, g.source, len(words)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(h.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM g LEFT JOIN h ON g.doc_id = h.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
             OR 10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words AS usual,
             100 * n_symbols > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
             OR 10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words AS strict FROM c),
s AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR usual) AS k FROM f GROUP BY source),
m AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS var FROM s),
v AS (SELECT source, CASE WHEN var > 1e-12
             THEN (k + greatest(mean * (1 - mean) / var - 1, 1.0) * mean) / (n + greatest(mean * (1 - mean) / var - 1, 1.0))
             ELSE mean END >= least(0.5, CASE WHEN var > 1e-12 THEN mean + sqrt(var) ELSE 0.5 END) AS host_bad FROM s, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad,
       NOT base_failed AND NOT (CASE WHEN host_bad THEN strict ELSE usual END) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP3 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS gram
       FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN bg USING (n, gram)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
"""

OP10 = """
WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id AS pair_id, turn, role, text FROM conversations ORDER BY conv_id, turn, role, text),
l AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
m AS (SELECT t.*, last, arg_max(CASE WHEN turn < last THEN text END, CASE WHEN turn < last THEN turn END)
             OVER (PARTITION BY t.pair_id) AS echo
      FROM t LEFT JOIN l ON t.pair_id = l.pair_id),
c AS (SELECT * FROM m WHERE last IS NULL OR turn <= last),
x AS (SELECT pair_id, turn, role, text AS chosen, last IS NOT NULL AND turn = last AS answer, coalesce(echo, '') AS echo FROM c),
s AS (SELECT pair_id, CASE WHEN answer AND chosen <> echo THEN 'chosen' ELSE 'prompt' END AS part, turn, role, chosen AS text FROM x
      UNION ALL SELECT pair_id, 'rejected', turn, role, echo FROM x WHERE answer AND chosen <> echo)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment,
       CASE WHEN part <> 'prompt' THEN length(role) + 5 ELSE 0 END::BIGINT AS train_begin,
       CASE WHEN part <> 'prompt' THEN length(role) + 5 + length(text) + 8 ELSE 0 END::BIGINT AS train_end
FROM s
"""

#: crc32 of an id's decimal text: the table of the 256 bytes' remainders, and its use on ``{id}``
CRC_TABLE = """crc AS (SELECT [list_reduce(list_prepend(x::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                FOR x IN range(256)] AS tab)"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split({id}::VARCHAR, '')]),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

OP11 = """
WITH {table},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, coalesce({crc}, 1) AS h FROM documents, crc),
e AS (SELECT doc_id, words, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS moved FROM d),
f AS (SELECT *, CASE WHEN moved THEN g % n ELSE n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS per FROM f),
w AS (SELECT doc_id, n, i, CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % per + 1] END AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM p)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM isles WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT a.* FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id
         AND (b.len * a.q > a.len * b.q OR (b.len * a.q = a.len * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS txt FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
       (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
""".format(table=CRC_TABLE, crc=CRC.format(id="doc_id"))

OP12 = """
WITH {table},
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS pos
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id AS id, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
pre AS (SELECT id, pos AS d, role, text FROM c JOIN t ON t.conv_id = id - id % 5 AND pos <= h),
took AS (SELECT id, count(*) AS k FROM pre GROUP BY id),
r AS (SELECT * FROM pre UNION ALL
      SELECT c.id, coalesce(k, 0) + pos - h, role, text FROM c JOIN t ON t.conv_id = c.id AND pos > h LEFT JOIN took ON took.id = c.id),
keyed AS (SELECT id, d, strlen(text) AS size, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY id ORDER BY d) AS path FROM r),
path AS (SELECT id, d, size, path, path[:d - 1] AS up FROM keyed UNION ALL SELECT id, 0, 0, [], NULL FROM c),
node AS (SELECT path, d, any_value(up) AS up, min(id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM path GROUP BY path, d),
kids AS (SELECT up, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.path),
tree AS (SELECT a.path, sum((f.n_children = 0)::INT) AS n_leaves, sum(f.saved) AS saved_tokens
         FROM full_node f JOIN path a ON a.id = f.conv_id AND a.d <= f.d GROUP BY a.path),
last AS (SELECT id, max(d) AS d FROM path GROUP BY id),
ends AS (SELECT path, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS ends_sha256 FROM path JOIN last USING (id, d) GROUP BY path)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       tree.n_leaves::BIGINT AS n_leaves, tree.saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_node f JOIN tree ON tree.path = f.path LEFT JOIN full_node p ON p.path = f.up LEFT JOIN ends ON ends.path = f.path
""".format(table=CRC_TABLE, crc=CRC.format(id="conv_id"))

_SCORED = """
k{n} AS (SELECT pattern, kind, 1000 AS score FROM edges WHERE kind >= 0 {found}),
p{n} AS (SELECT k.pattern, k.kind, least(sum(score) // any_value(n), 990) AS share FROM k{n} k JOIN sizes USING (pattern)
         GROUP BY k.pattern, k.kind HAVING count(*) FILTER (score >= 800) >= 3),
s{n} AS (SELECT value, kind, round(1000 * (1 - exp(-sum(round(-ln(1 - share / 1000) * 1000000)::BIGINT) / 1000000)))::INT AS score
         FROM (SELECT value, pattern FROM edges WHERE kind < 0) e JOIN p{n} USING (pattern) GROUP BY value, kind)"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f(kind, form) AS (VALUES (0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, '[0-9]([\x20-]?[0-9])+'),
       (3, '\+[0-9][\x20().0-9-]+[0-9]'), (-1, '[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*')),
m AS (SELECT r, kind, regexp_extract_all(t, form) AS hits, string_split_regex(t, form) AS pieces FROM d, f),
i AS (SELECT r, kind, hits[i] AS value, pieces[i] AS before, pieces[i + 1] AS after, sum(length(pieces[i]) + length(hits[i])) OVER (PARTITION BY r, kind ORDER BY i) AS fin
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
w AS (SELECT *, [x FOR x IN string_split_regex(translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+') IF x <> ''] AS lw,
             [x FOR x IN string_split_regex(translate(after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+') IF x <> ''] AS rw,
             regexp_replace(value, '[^0-9]', '', 'g') AS digits, ltrim(value, '{edges}') AS rest FROM i),
base AS (SELECT r, kind, fin - length(value) AS start, fin, value, lw, rw FROM w WHERE kind = 0
         OR (kind = 1 AND len([x FOR x IN string_split(value, '.') IF CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || ltrim(x, '0'))::INT END > 255]) = 0)
         OR (kind = 2 AND length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)
               ELSE translate(substr(reverse(digits), i, 1), '0123456789', '0246813579') END::INT FOR i IN range(1, length(digits) + 1)]) % 10 = 0)
         OR (kind = 3 AND length(digits) BETWEEN 9 AND 15)),
cand AS (SELECT r, kind, start, start + length(value) AS fin, value, lw, rw
         FROM (SELECT r, kind, fin - length(rest) AS start, rtrim(rest, '{edges}') AS value, lw, rw FROM w WHERE kind = -1) c
         WHERE (contains(value, '@') OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4)
               AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.start + length(c.value) AND c.start < b.fin)),
edges AS (SELECT DISTINCT kind, value, pattern FROM (
          SELECT kind, value, unnest([CASE WHEN len(lw) > 1 THEN lw[-2] || ' ' || lw[-1] || ' _' END,
                                      CASE WHEN len(lw) > 0 AND len(rw) > 0 THEN lw[-1] || ' _ ' || rw[1] END]) AS pattern
          FROM (SELECT * FROM base UNION ALL SELECT * FROM cand)) WHERE pattern IS NOT NULL),
sizes AS (SELECT pattern, count(*) AS n FROM edges GROUP BY pattern),{rounds},
sure AS (SELECT value, arg_min(kind, -score * 10 + kind) AS kind FROM s3 GROUP BY value HAVING max(score) >= 800),
spans AS (SELECT r, kind, start, fin, TRUE AS fixed FROM base UNION ALL SELECT c.r, s.kind, c.start, c.fin, FALSE FROM cand c JOIN sure s USING (value)),
texts AS (SELECT r, fixed, kind, start, fin, ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || fin AS txt FROM spans)
SELECT doc_id, (count(*) FILTER (fixed AND kind = 0))::BIGINT AS n_email, (count(*) FILTER (fixed AND kind = 1))::BIGINT AS n_ip,
       (count(*) FILTER (fixed AND kind = 2))::BIGINT AS n_card, (count(*) FILTER (fixed AND kind = 3))::BIGINT AS n_phone,
       sha256(coalesce(string_agg(txt, ',' ORDER BY kind, start) FILTER (fixed), '')) AS base_sha256,
       coalesce(string_agg(txt, ',' ORDER BY kind, start, fin), '') AS spans
FROM d LEFT JOIN texts ON d.r = texts.r GROUP BY d.r, doc_id
""".replace("{edges}", "\"''()[]{}<>.,;:!?#*%$&|").replace("{rounds}", ",".join(_SCORED.format(
    n=n, found=f"UNION ALL SELECT pattern, s.kind, score FROM edges e JOIN s{n - 1} s USING (value) WHERE e.kind < 0" if n > 1 else "") for n in (1, 2, 3)))

ORACLE: dict[str, str] = {
    "op11_run_detection": OP11,
    "op12_prefix_trie": OP12,
    "op13_pii": OP13,
    "op1_quality_rules": OP1,
    "op10_preference_format": OP10,
    "op3_decontamination": OP3,
}
