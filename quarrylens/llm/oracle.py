"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

from quarrylens.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows of 200 bytes of the texts' hexadecimal form, taken from blocks of 1,000 bytes so that no long string is cut a million times.
OP1 = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, k, substr(h, 2000 * k + 1, 2398) AS part FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 200) // 1000 + 1)) AS k FROM t WHERE length(h) >= 400)),
w AS (SELECT r, 1000 * k + q AS p, md5(substr(part, 2 * q + 1, 400)) AS m FROM (SELECT r, k, part, unnest(range(0, length(part) // 2 - 199)) AS q FROM b)),
c AS (SELECT r, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM c)),
s AS (SELECT r, min(p) AS x, max(p) + 200 AS y FROM g GROUP BY r, g),
gone AS (SELECT r, CAST(sum(y - x) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY r),
rest AS (SELECT r, coalesce(lag(y) OVER (PARTITION BY r ORDER BY x), 0) AS x, x AS y FROM s UNION ALL SELECT r, max(y), NULL FROM s GROUP BY r),
kept AS (SELECT t.r, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS kh FROM rest JOIN t ON t.r = rest.r GROUP BY t.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM t LEFT JOIN gone ON gone.r = t.r LEFT JOIN kept ON kept.r = t.r
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op8() -> str:
    measure = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(word_chars, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "mark_ratio": "n_marks / greatest(word_chars, 1)", "upper_ratio": "n_upper / greatest(word_chars, 1)", "n_words": "n_words",
    }
    rejects = " OR ".join(f"{measure[name]} {op} CAST({bound} AS DOUBLE)" for name, op, bound in RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)
), twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS covered FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE m > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda w: lower(w) IN ({stops}))) AS BIGINT) AS n_stop,
    CAST(length(regexp_replace(array_to_string(ws, ''), '[^!?]+', '', 'g')) AS BIGINT) AS n_marks,
    CAST(length(regexp_replace(array_to_string(ws, ''), '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM t LEFT JOIN c ON c.doc_id = t.doc_id
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT ({rejects}) AS kept
FROM m
"""


#: kind, pattern, group that must have the least characters
SECRETS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def op5() -> str:
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts,
        string_split_regex(t, '{pattern}') AS gaps, {least} AS least FROM t"""
        for place, (kind, pattern, group, least) in enumerate(SECRETS)
    )
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (
  SELECT doc_id, place, kind, length(hits[i]) AS n, length(parts[i]) AS part, least,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s FROM i
), f AS (SELECT doc_id, place, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM p WHERE part >= least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg({text}, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg({text}, ',' ORDER BY s, place) AS spans
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""


def op11(rounds: int = 4) -> str:
    """Each round: assign by (distance, index), then the floor of the mean of each entry's parts; unused entries stay."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
d{r} AS MATERIALIZED (SELECT p.r, p.k, arg_min(e, 1000 * (xx - 2 * list_inner_product(x, c) + list_inner_product(c, c)) + e) AS e, min(xx - 2 * list_inner_product(x, c) + list_inner_product(c, c)) AS d FROM p JOIN b{r} b ON b.k = p.k GROUP BY p.r, p.k),"""
        if r < rounds:
            steps += f"""
s{r} AS MATERIALIZED (SELECT k, e, i, floor(sum(y) / count(*)) AS y FROM (SELECT p.k, d.e, unnest(x) AS y, unnest(range(len(x))) AS i FROM p JOIN d{r} d ON d.r = p.r AND d.k = p.k) GROUP BY k, e, i),
b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT k, e, list(y ORDER BY i) AS c FROM s{r} GROUP BY k, e) n ON n.k = b.k AND n.e = b.e),"""
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT r, k, q[k * len(q) // 4 + 1:(k + 1) * len(q) // 4] AS x FROM v, (SELECT unnest(range(4)) AS k))),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= 256),{steps}
o AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k, e, i)) AS sha FROM (SELECT k, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM o JOIN v ON v.r = o.r, h
"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM documents),
c AS (SELECT r, doc_id, t, count(*) AS tf FROM t GROUP BY r, doc_id, t),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY r),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM c GROUP BY t), s),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark)),
m AS (SELECT r, 10 + 90 * n * nn // l AS m FROM d, s),
x AS (SELECT item_id, c.r, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN c ON c.t = q.t JOIN w ON w.t = c.t JOIN m ON m.r = c.r GROUP BY item_id, c.r, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM x WHERE score > 0 AND doc_id IS NOT NULL) WHERE place <= 10
"""


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii_base() -> str:
    """Base spans: matches of each kind, by place; those that fail its test are dropped, not retried."""
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS place, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM t" for k, (kind, pattern) in enumerate(PII))
    text = "kind || ':' || s || ':' || e"
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) ELSE (2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER)) % 10 END)) % 10 = 0"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id AS id, coalesce(text, '') AS text FROM documents),
m AS ({each.replace("doc_id", "r").replace("(t,", "(text,")}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (
  SELECT r, place, kind, hits[i] AS h, regexp_replace(hits[i], '[^0-9]', '', 'g') AS d, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM i
), f AS (
  SELECT r, place, kind, s, s + length(h) AS e FROM p WHERE kind = 'email' OR kind = 'phone' AND length(d) BETWEEN 9 AND 15
    OR kind = 'ip' AND len(list_filter(string_split(h, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('000' || x, 3) AS INTEGER) > 255)) = 0
    OR kind = 'card' AND length(d) BETWEEN 12 AND 19 AND {luhn}
), a AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg({text}, ',' ORDER BY s, place) AS base FROM f GROUP BY r
)
SELECT id AS doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256 FROM t LEFT JOIN a ON a.r = t.r
"""


#: The level at which water stands: with the sources in the order of limit / weight, the first at which those before it are full and it is not.
MIX_SOURCES = f"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS j FROM w),
l AS (SELECT j, lim / weight AS r, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
x AS (SELECT coalesce(min_by(level, j) FILTER (level < r), 'infinity'::DOUBLE) AS level FROM l)
SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(lim, level * weight) END AS target FROM w, x
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1, "op3_pivot_topk": OP3, "op5_secret_ledger": op5(), "op7_minhash_near_dedup": OP7, "op8_quality_rules": op8(), "op11_vector_codes": op11(), "op12_lexical_search": OP12, "pii_base": pii_base(), "mix_sources": MIX_SOURCES}
