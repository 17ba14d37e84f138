"""SQL answers of the queries that SQL can express on whole tables."""

_UPPER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len({_WORDS.format("text")}) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|7')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM s
), l AS (
  SELECT *,
    (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5
     - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place
  FROM r
), t AS (
  SELECT source, source_size,
    CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE)
         ELSE (SELECT min_by(level, place) FROM l WHERE level * weight < cap) * weight END AS target
  FROM l
), q AS (
  SELECT d.row, d.doc_id, d.size, d.source, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), sent AS (
  SELECT q.*, turn, CAST(upto + turn * source_size AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) AS turns(turn) WHERE size > 0
), cut AS (
  SELECT row, sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, turn, size
                              ROWS UNBOUNDED PRECEDING) AS total
  FROM sent
), taken AS (
  SELECT row, count(*) AS times FROM cut
  WHERE total <= 1.5 * (SELECT sum(size) FROM d) GROUP BY row
)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(coalesce(taken.times, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN taken USING (row)
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, {_ALNUM.format(_UPPER.format("coalesce(text, '')"))} AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(_UPPER.format("coalesce(text, '')"))} AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id
), o AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def _ngrams(n: int) -> tuple[str, str, str]:
    """Common table expressions for repeated n-grams and the sum of characters inside them."""
    grams = f"""g{n} AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) > 1 AND gram IS NOT NULL AS dup
  FROM (SELECT doc_id, p, CASE WHEN p + {n - 1} <= len(w) THEN array_to_string(w[p : p + {n - 1}], ' ') END AS gram
        FROM p)
), c{n} AS (
  SELECT doc_id, p, max(CAST(dup AS INTEGER)) OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS inside
  FROM g{n}
), s{n} AS (
  SELECT p.doc_id, CAST(sum(CASE WHEN inside THEN chars ELSE 0 END) AS BIGINT) AS dup_chars_{n},
         CAST(sum(CAST(inside AS INTEGER)) AS BIGINT) AS words_{n}
  FROM c{n} JOIN p USING (doc_id, p) GROUP BY p.doc_id
)"""
    return grams, f"LEFT JOIN s{n} USING (doc_id)", f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}"


_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
_PARTS = [_ngrams(n) for n in _LIMITS]

OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents
), p AS (
  SELECT doc_id, w, p, length(w[p]) AS chars
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), {", ".join(part[0] for part in _PARTS)}, lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again,
         length(array_to_string({_WORDS.format("line")}, '')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE len({_WORDS.format("line")}) > 0
), ls AS (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(again AS INTEGER)) AS BIGINT) AS n_dup_lines,
         CAST(sum(CASE WHEN again THEN chars ELSE 0 END) AS BIGINT) AS dup_line_chars
  FROM lines GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(words_8, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(part[2] for part in _PARTS)}
  FROM d LEFT JOIN ls USING (doc_id) {" ".join(part[1] for part in _PARTS)}
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND {" AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in _LIMITS.items())}
  AND 10 * n_dup_lines <= 3 * n_lines AND 10 * dup_line_chars <= 2 * word_chars AND 10 * n_symbols <= n_words AS kept
FROM m
"""

ORACLES = {"op2_mixing": OP2, "op3_decontamination": OP3, "op6_quality": OP6}
