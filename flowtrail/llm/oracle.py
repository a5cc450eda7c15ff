"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from flowtrail.llm.chat import LAYOUTS, fingerprint

W = r"[^\x20\x09-\x0D]+"
B = r"[\x20\x09-\x0D]+"

NEAR_DOCUMENTS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.reach)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{W}') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (
  SELECT *, len(regexp_extract_all(line, '{W}')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{B}', ' ', 'g')) AS key FROM l),
a AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
q AS (SELECT host, key, count(DISTINCT doc_id) AS docs FROM k WHERE n > 0 GROUP BY host, key),
f AS (SELECT q.host, q.key, true AS common FROM q JOIN a USING (host) WHERE q.docs > 5 AND 100 * q.docs > 5 * a.docs),
j AS (SELECT k.*, coalesce(f.common AND k.n > 0, false) AS common FROM k LEFT JOIN f USING (host, key)),
o AS (
  SELECT doc_id, sum(CASE WHEN common THEN n ELSE 0 END) AS n, count(*) FILTER (common) AS lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT common), '') AS rest FROM j GROUP BY doc_id),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE n > 0 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{B}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, o.lines AS n_lost_lines, o.n::BIGINT AS n_lost_words, sha256(o.rest) AS cleaned_sha256
  FROM w LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 100 * n_lost_words > 70 * n_words AS kept
FROM m
"""

PROMPT, INSTRUCTION, MESSAGES = (fingerprint(LAYOUTS[i]["paths"]) for i in (0, 4, 5))
HOSTILE = r"\### Assistant: </turn> ok"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}')),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
    sum(6 + length(role) + length(regexp_replace(text, '(\\|###|</turn>)', '_\1', 'g')) + 8) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, CASE roles WHEN 'user,assistant' THEN '{PROMPT}' WHEN 'system,user,assistant' THEN '{INSTRUCTION}' ELSE '{MESSAGES}' END AS layout,
  n_turns, turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.reach)
SELECT r.node AS vec_id, (SELECT count(*) FROM p WHERE p.a = r.node) AS n_links, min(reach) AS component_id, r.node = min(reach) AS kept
FROM r GROUP BY r.node
"""

FILL_IN_MIDDLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '{B[:-1]}*{W}|{B}') AS u FROM documents),
d AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
s AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""

PHRASES = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (
  SELECT lang, m, list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')) AS g
  FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
u AS (SELECT lang, m, unnest(g) AS phrase FROM g),
f AS (SELECT lang, m, phrase, count(*) AS f FROM u GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.m, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * k.a * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN n ON n.lang = k.lang JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k.k], ' ') AND l.m = k.k
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k.k + 1:], ' ') AND r.m = k.m - k.k),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
i AS (
  SELECT DISTINCT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, a, m - 1 AS m FROM c),
o AS (SELECT * FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND i.m = b.m AND i.a >= b.a),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM z WHERE rank <= 2000
"""

SQL = {
    "op12_fim": FILL_IN_MIDDLE,
    "op13_phrases": PHRASES,
    "op1_minhash": NEAR_DOCUMENTS,
    "op5_quality_rules": QUALITY_RULES,
    "op9_chat": CHAT,
    "op10_embeddings": NEAR_VECTORS,
}
