"""DuckDB SQL of those corpus queries that SQL can express."""

from __future__ import annotations

from turnweave.llm.licenses import TEMPLATES, THRESHOLD, Template

_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RANKED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN g.first IS NOT NULL AND g.first IS DISTINCT FROM q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first IS DISTINCT FROM q.page_id THEN g.first END AS refers_to
FROM q LEFT JOIN g USING (payload_digest)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, 3 * source_size AS full_size FROM r),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
        coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
      FROM w WINDOW o AS (ORDER BY full_size::DOUBLE / weight, rank)),
m AS (SELECT *, full_size::DOUBLE / weight AS level, (total - below)::DOUBLE / open <= full_size::DOUBLE / weight AS fits FROM f),
c AS (SELECT below AS lead_below, open AS lead_open, level AS lead_level, rank AS lead_rank FROM m WHERE fits ORDER BY level, rank LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN (level, rank) >= (lead_level, lead_rank) THEN (weight * (total - lead_below))::DOUBLE / lead_open ELSE full_size::DOUBLE END AS target
      FROM m LEFT JOIN c ON true),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CASE WHEN target > 0 THEN size * len(list_filter([0, 1, 2], lambda k: 2 * (k * source_size + before) + size <= 2 * target)) ELSE 0 END::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM g),
q AS (SELECT r, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
f AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
        coalesce(list_sum(list_transform(range(2, len(ws) + 1), lambda i: CASE WHEN ws[i] = ws[i - 1] THEN 1 ELSE 0 END)), 0) AS n_doubled
      FROM d LEFT JOIN q USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_upper <= 40 * n_letters
         AND 100 * n_doubled <= 20 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept
FROM b
"""

NEAR_DUP = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*)::BIGINT AS n_shingles FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w(r, o) AS (SELECT r, r FROM d UNION SELECT w.r, u.b FROM w JOIN u ON u.a = w.o),
m AS (SELECT w.r, min(d.doc_id) AS component_id FROM w JOIN d ON d.r = w.o GROUP BY w.r)
SELECT d.doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""

DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
p AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
      FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM k) WHERE len(ws) >= n)),
h AS (SELECT r, i, p.n AS n, item_id FROM p JOIN k ON k.g = p.g AND k.n = p.n),
x AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
y AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""

CHAT = """
WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN r END AS alone FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, speaker, text, r) - 1 AS number FROM k),
s AS (SELECT DISTINCT conv_id, alone, number // 64 AS sample FROM n),
h AS (SELECT s.conv_id, s.alone, s.sample, max(n.number) AS number
      FROM s JOIN n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.alone IS NOT DISTINCT FROM n.alone AND n.number < 64 * s.sample
      WHERE n.speaker = 'system' GROUP BY 1, 2, 3),
a AS (SELECT conv_id, alone, number // 64 AS sample, number, speaker, text FROM n
      UNION ALL
      SELECT h.conv_id, h.alone, h.sample, n.number, n.speaker, n.text FROM h
      JOIN n ON h.conv_id IS NOT DISTINCT FROM n.conv_id AND h.alone IS NOT DISTINCT FROM n.alone AND h.number = n.number),
v AS (SELECT DISTINCT conv_id, alone, speaker AS perspective FROM n WHERE speaker <> 'system'),
m AS (SELECT v.conv_id, v.alone, a.sample, perspective, a.number, a.speaker, a.text,
        '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
      FROM v JOIN a ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.alone IS NOT DISTINCT FROM a.alone),
o AS (SELECT *, length(head) + length(text) + 11 AS n FROM m),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, alone, sample, perspective ORDER BY number) - n AS begins FROM o)
SELECT conv_id, sample, perspective, sample * 64 AS first_message, count(*)::BIGINT AS n_messages,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY number) AS rendered,
       coalesce(string_agg((begins + length(head))::BIGINT::VARCHAR || '-' || (begins + n - 1)::BIGINT::VARCHAR, ',' ORDER BY number)
         FILTER (WHERE speaker = perspective), '') AS mask
FROM e GROUP BY conv_id, alone, sample, perspective
"""


def _licenses() -> str:
    """Blocks against templates by counting shared words; the template table is the operator's parameter."""

    def row(number: int, t: Template) -> str:
        listed = ", ".join(f"'{w}'" for w in t.words)
        return f"({number}, '{t.label}', {str(t.phrase).lower()}, {t.step}, {t.need(THRESHOLD)}, {len(set(t.words))}, [{listed}])"

    table = ",\n  ".join(row(i, t) for i, t in enumerate(TEMPLATES))
    return f"""
WITH t(id, label, phrase, step, need, n_set, ws) AS (VALUES
  {table}),
k AS (SELECT DISTINCT id, step, unnest(ws) AS word FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
h AS (SELECT r, i, k.id, k.step, k.word FROM p JOIN k ON k.word = p.word),
b AS (SELECT r, id, block, count(DISTINCT word) AS held
      FROM (SELECT r, id, word, unnest([i // step - 1, i // step]) AS block FROM h) WHERE block >= 0 GROUP BY 1, 2, 3),
m AS (SELECT r, label, held::DOUBLE / n_set AS share FROM b JOIN t ON t.id = b.id WHERE NOT phrase AND held >= need),
f AS (SELECT DISTINCT p.r, t.id, t.label, p.i FROM p JOIN t ON t.phrase AND t.ws[1] = p.word JOIN d ON d.r = p.r
      WHERE d.ws[p.i + 1 : p.i + len(t.ws)] = t.ws),
n AS (SELECT r, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word FROM f GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM f) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels
       FROM (SELECT r, label FROM f UNION SELECT r, label FROM m) GROUP BY r),
s AS (SELECT r, max(share) AS score FROM (SELECT r, share FROM m UNION ALL SELECT r, 1.0::DOUBLE FROM f) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN n USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN s USING (r)
"""


SEARCH = f"""
WITH q AS (SELECT DISTINCT item_id, text FROM benchmark),
i AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all({_LOWER}, '{_RANKED}') AS ws FROM q),
x AS (SELECT j, term, count(*)::BIGINT AS times FROM (SELECT j, unnest(ws) AS term FROM i) GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_RANKED}') AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0),
m AS (SELECT r, 100 - 25 + ((25 * len(ws) * docs) // terms) AS m FROM d, s WHERE len(ws) > 0),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY 1, 2),
e AS (SELECT term, count(*)::BIGINT AS df FROM f WHERE term IN (SELECT term FROM x) GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM e, s),
o AS (SELECT j, f.r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM x JOIN f ON f.term = x.term JOIN w ON w.term = x.term JOIN m ON m.r = f.r GROUP BY 1, 2),
k AS (SELECT j, doc_id, score, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank
      FROM o JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (j) WHERE rank <= 20
"""

ORACLES = {
    "op2_warc": WARC,
    "op3_mixing": MIXING,
    "op4_quality": QUALITY,
    "op6_near_dup": NEAR_DUP,
    "op7_decontamination": DECONTAMINATION,
    "op10_chat": CHAT,
    "op11_licenses": _licenses(),
    "op13_ranked_search": SEARCH,
}
