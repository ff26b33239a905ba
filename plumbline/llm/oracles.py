"""The operators' queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from plumbline.llm.quality_rules import LIMITS, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_RULES = " OR ".join(
    test
    for x in LIMITS
    for test in ([f"{x.measure} < {x.least}"] if x.least is not None else []) + ([f"{x.measure} > {x.most}"] if x.most is not None else [])
)

#: Judged documents, as a chain of common table expressions that ends in ``judged``.
JUDGED = rf"""
raw AS (SELECT *, coalesce(text, '') AS t, {_WORDS} AS ws, row_number() OVER () AS rid FROM documents),
windows AS (SELECT rid, i, {{'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]}} AS g FROM raw, unnest(range(1, len(ws) - 1)) AS r(i)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS s(k) GROUP BY rid),
counted AS (
  SELECT raw.*, len(ws)::BIGINT AS n_words_, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '[!?;:]+', '', 'g')))::BIGINT AS n_marks,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper,
    len(list_filter(ws, lambda w: lower(w) IN ({_STOPS})))::BIGINT AS n_stop_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM raw LEFT JOIN covered USING (rid)
),
ratios AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words_ AS n_words,
    CASE WHEN n_words_ = 0 THEN 0.0 ELSE word_chars / n_words_ END AS mean_word_chars,
    CASE WHEN n_words_ = 0 THEN 0.0 ELSE n_symbols / n_words_ END AS symbol_ratio,
    CASE WHEN n_words_ = 0 THEN 0.0 ELSE n_marks / n_words_ END AS mark_ratio,
    CASE WHEN word_chars = 0 THEN 0.0 ELSE n_upper / word_chars END AS upper_ratio,
    CASE WHEN n_words_ = 0 THEN 0.0 ELSE n_stop_words / n_words_ END AS stop_ratio,
    CASE WHEN len(lines) = 0 THEN 0.0 ELSE (len(lines) - len(list_distinct(lines))) / len(lines) END AS dup_line_ratio,
    CASE WHEN n_words_ = 0 THEN 0.0 ELSE n_repeat_words / n_words_ END AS repeat_word_ratio
  FROM counted
),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({_RULES}) AS kept
  FROM ratios
)"""

_FAILED = ", ".join(
    "CASE WHEN " + " OR ".join(([f"{x.measure} < {x.least}"] if x.least is not None else []) + ([f"{x.measure} > {x.most}"] if x.most is not None else [])) + f" THEN '{x.measure}' END" for x in LIMITS
)

_MIX = r"""
WITH drawn AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(CASE WHEN length(coalesce(text, '')) = 0 THEN 0.1
        ELSE 0.1 + 0.9 * length(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]+', '', 'g')) / length(text) END, 1e-9) AS key
  FROM documents
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0 * source_size AS cap FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
),
targets AS (
  SELECT source, source_size, round(least(cap, max(CASE WHEN level <= cap / w THEN level END) OVER () * w)::DOUBLE, 6) AS target FROM levels
),
planned AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3)::BIGINT END AS epochs FROM targets
),
ordered AS (
  SELECT d.*, p.source_size, p.target, p.epochs, greatest(p.target - p.epochs * p.source_size, 0) AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM drawn d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM ordered
"""

_CHAT = r"""
WITH own AS (
  SELECT conv_id AS pair_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
spoken AS (
  SELECT pair_id, max(k) AS z, max(k) FILTER (WHERE rank = 2) AS y FROM (SELECT pair_id, k, row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) AS rank FROM own WHERE role = 'assistant') GROUP BY pair_id
),
t AS (
  SELECT pair_id, 0 AS side, role, text, k FROM own LEFT JOIN spoken USING (pair_id) WHERE z IS NULL OR k <= z
  UNION ALL SELECT pair_id, 1, role, text, k FROM own JOIN spoken USING (pair_id) WHERE k < z
  UNION ALL SELECT s.pair_id, 1, 'assistant', coalesce(o.text, ''), s.z FROM spoken s LEFT JOIN own o ON o.pair_id = s.pair_id AND o.k = s.y
),
c AS (
  SELECT t.*, count(*) OVER (PARTITION BY pair_id, side) AS n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
    (length(role) + 5)::VARCHAR || ':0,' || (length(text) + 8)::VARCHAR || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS runs
  FROM t
),
pairs AS (
  SELECT pair_id, max(CASE WHEN side = 0 THEN n END) AS nc, max(CASE WHEN side = 1 THEN n END) AS nr FROM c GROUP BY pair_id
),
first_diff AS (
  SELECT a.pair_id, min(a.k) AS k FROM c a JOIN c b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
),
cut AS (
  SELECT p.pair_id, nc, nr, coalesce(f.k - 1, least(nc, nr)) AS lcp FROM pairs p LEFT JOIN first_diff f USING (pair_id)
),
split_at AS (
  SELECT *, CASE WHEN nc IS NULL OR nr IS NULL THEN 'unpaired' WHEN nc = nr AND lcp = nc THEN 'equal' WHEN lcp = least(nc, nr) THEN 'prefix' ELSE 'paired' END AS status,
    CASE WHEN nc IS NULL OR nr IS NULL THEN 0 WHEN NOT (nc = nr AND lcp = nc) AND lcp = least(nc, nr) AND lcp > 0 THEN lcp - 1 ELSE lcp END AS p
  FROM cut
)
SELECT split_at.pair_id::BIGINT AS pair_id, status, p::BIGINT AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= p), '') AS prompt,
  CASE WHEN nc IS NOT NULL THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k > p), '') END AS chosen,
  CASE WHEN nc IS NOT NULL THEN coalesce(string_agg(runs, ',' ORDER BY k) FILTER (WHERE side = 0 AND k > p), '') END AS chosen_mask,
  CASE WHEN nr IS NOT NULL THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 1 AND k > p), '') END AS rejected,
  CASE WHEN nr IS NOT NULL THEN coalesce(string_agg(runs, ',' ORDER BY k) FILTER (WHERE side = 1 AND k > p), '') END AS rejected_mask
FROM split_at JOIN c USING (pair_id) GROUP BY split_at.pair_id, status, p, nc, nr
"""

_NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, rid, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) END AS own FROM d
),
class AS (SELECT list_sort(own) AS own, min(rid) AS cid, len(own) AS n FROM s WHERE len(own) > 0 GROUP BY 1, 3),
each AS (SELECT cid, n, unnest(own) AS g FROM class),
near AS (
  SELECT a.cid AS x, b.cid AS y FROM each a JOIN each b ON a.g = b.g AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
placed AS (SELECT s.doc_id, s.rid, len(s.own) AS n, cid FROM s LEFT JOIN class ON len(s.own) > 0 AND list_sort(s.own) = class.own WHERE doc_id IS NOT NULL),
-- nodes are documents: all rows of an id, and of a class, are joined by its first
links AS (
  SELECT DISTINCT p.doc_id AS a, f.doc_id AS b FROM placed p JOIN (SELECT cid, min(doc_id) AS doc_id FROM placed GROUP BY cid) f ON p.cid = f.cid
  UNION SELECT p.doc_id, q.doc_id FROM near JOIN (SELECT cid, min(doc_id) AS doc_id FROM placed GROUP BY cid) p ON p.cid = x JOIN (SELECT cid, min(doc_id) AS doc_id FROM placed GROUP BY cid) q ON q.cid = y
),
sides AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a)
SELECT p.doc_id, p.n::BIGINT AS n_shingles, least(p.doc_id, coalesce(r.low, p.doc_id)) AS component_id, p.doc_id <= coalesce(r.low, p.doc_id) AS kept
FROM placed p LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = p.doc_id
"""

_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i]::INT ELSE (2 * d[i]::INT) // 10 + (2 * d[i]::INT) % 10 END)) % 10 = 0"""
_SPANS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id,
  regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+') AS email,
  regexp_extract_all(x, '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)') AS ip,
  list_transform(regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), lambda v: string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')) AS card,
  list_transform(regexp_extract_all(x, '[+][0-9][\x20().0-9-]+[0-9]'), lambda v: length(regexp_replace(v, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda v: len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda d: len(d) BETWEEN 13 AND 19 AND {_LUHN}))::BIGINT AS n_card,
  len(list_filter(phone, lambda n: n BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m"""

#: crc32 of a number's digits, bit by bit.
_UNIGRAM = rf"""
WITH RECURSIVE crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 1 AS at_, 0 AS bit, xor(4294967295::BIGINT, ascii(left(doc_id::VARCHAR, 1))::BIGINT) AS v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s, CASE WHEN bit = 7 THEN at_ + 1 ELSE at_ END, (bit + 1) % 8,
    xor(CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, CASE WHEN bit = 7 AND at_ < length(s) THEN ascii(substr(s, at_ + 1, 1))::BIGINT ELSE 0 END)
  FROM crc WHERE at_ <= length(s)
),
held AS (SELECT doc_id, xor(v, 4294967295::BIGINT) % 5 = 1 AS held_out FROM crc WHERE at_ > length(s)),
d AS (SELECT row_number() OVER () AS rid, documents.doc_id, coalesce(held_out, false) AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents LEFT JOIN held USING (doc_id)),
tok AS (SELECT rid, doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 1) AS base_score FROM tok LEFT JOIN c USING (t), n GROUP BY rid"""

ORACLES: dict[str, str] = {
    "op10_near_duplicates": _NEAR,
    "media_payloads": """SELECT doc_id, n AS n_bytes, n + p AS payload_bytes, sha256(x || repeat(' ', p)) AS payload_sha256
FROM (SELECT doc_id, x, strlen(x) AS n, CASE WHEN strlen(x) = 0 THEN 192 ELSE (192 - strlen(x) % 192) % 192 END AS p FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))""",
    "pii_counts": _SPANS,
    "unigram_scores": _UNIGRAM,

    "op1_preferences": _CHAT,
    "op3_mixing": _MIX,
    "op6_quality_rules": f"WITH {JUDGED} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM judged",
}
