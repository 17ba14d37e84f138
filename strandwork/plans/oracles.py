"""SQL statements that answer the registered queries independently (DuckDB dialect)."""

from __future__ import annotations

from strandwork.functions.minhash import BASE, PRIME, choose_bands, family, needed_agreement
from strandwork.plans.queries import HIGH, LOW, SEED, TYPES, WEIGHTS


def _hash(*columns: str, seed: int = SEED) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns) + f" || '|{seed}')"


JOINED = "SELECT d.doc_id, d.source, l.quality, length(d.text) AS length FROM documents d JOIN labels l USING (doc_id)"

LABELLED = f"""labelled AS (
  SELECT event_id, event_type, value, CASE WHEN value >= {HIGH} THEN 1 WHEN value <= {LOW} THEN 0 END AS labels
  FROM events WHERE NOT isnan(value) AND (value >= {HIGH} OR value <= {LOW}))"""


def _targets(desired: float, up: float, by: str) -> str:
    """n0, n1 and their target sizes t0, t1."""
    group = f"GROUP BY {by}" if by else ""
    first = f"{by}," if by else ""
    return f"""sizes AS (
  SELECT {first} count(*) FILTER (labels = 0) AS n0, count(*) FILTER (labels = 1) AS n1 FROM labelled {group}),
plan AS (SELECT *, least(n0, n1)::DOUBLE AS mi, greatest(n0, n1)::DOUBLE AS ma, trunc({up} * least(n0, n1)) AS ut FROM sizes),
grown AS (SELECT *, CASE WHEN (mi + ut) / (mi + ut + ma) > {desired}
    THEN trunc(({desired} * (mi + ma) - mi) / (1 - {desired})) ELSE ut END AS u,
  CASE WHEN (mi + ut) / (mi + ut + ma) > {desired} THEN 0 ELSE trunc(ut + mi + ma - (mi + ut) / {desired}) END AS d
  FROM plan),
final AS (SELECT *, n0 = n1 OR mi / (mi + ma) >= {desired} AS same FROM grown),
targets AS (
  SELECT {first} 0 AS label, n0 AS n_before,
    (CASE WHEN same THEN n0 WHEN n1 > n0 THEN mi + u ELSE ma - d END)::BIGINT AS n_after FROM final
  UNION ALL
  SELECT {first} 1, n1, (CASE WHEN same THEN n1 WHEN n1 > n0 THEN ma - d ELSE mi + u END)::BIGINT FROM final)"""


def _edges(table: str, column: str, n: int, by: str = "") -> str:
    first = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {first} list_transform(range({n}), lambda i: CASE WHEN i = {n - 1} THEN mx
    ELSE i * ((mx - mn) / {n - 1}) + mn END) AS edges
  FROM (SELECT {first} min({column}) AS mn, max({column}) AS mx FROM {table} {group})"""


def _histogram(by: str = "") -> str:
    first = f"{by}," if by else ""
    using = f"JOIN edges USING ({by})" if by else ", edges"
    return f"""edges AS ({_edges('orders', 'o_totalprice', 20, by)}),
binned AS (SELECT o_orderkey, o_totalprice, {first} len(list_filter(edges, lambda e: e <= o_totalprice)) AS bin FROM orders {using}),
grid AS (SELECT {first} edges, unnest(range(1, 21)) AS bin FROM edges),
histogram AS (
  SELECT {'g.' + by + ',' if by else ''} g.bin::INT AS bin, g.edges[g.bin] AS lo, coalesce(g.edges[g.bin + 1], g.edges[g.bin]) AS hi,
    count(b.o_orderkey) AS n_before
  FROM grid g LEFT JOIN binned b ON g.bin = b.bin {f'AND g.{by} = b.{by}' if by else ''} GROUP BY ALL)"""


def _caps(by: str = "") -> str:
    on = f"WHERE a.{by} = b.{by}" if by else ""
    first = f"{by}," if by else ""
    a_first = f"a.{by}," if by else ""
    return f"""tried AS (
  SELECT {a_first} a.bin, any_value(a.n_before) AS cap, sum(least(a.n_before, b.n_before)) AS kept, sum(b.n_before) AS total
  FROM histogram a, histogram b {on} GROUP BY {a_first} a.bin),
caps AS (
  SELECT {first} coalesce(min(cap) FILTER (kept >= trunc(0.5 * total)), max(cap))::BIGINT AS cap,
    any_value(total)::BIGINT AS n_rows, trunc(0.5 * any_value(total))::BIGINT AS n_wanted,
    bool_or(kept >= trunc(0.5 * total)) AS reached
  FROM tried {'GROUP BY ' + by if by else ''})"""


RANDOM_SPLIT = f"""random_split AS (
  SELECT o_orderkey, o_custkey, o_totalprice,
    CASE WHEN row_number() OVER (ORDER BY {_hash('o_orderkey')}) <= ceil(0.15 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM orders)"""
GROUP_SPLIT = f"""group_names AS (
  SELECT o_custkey, CASE WHEN row_number() OVER (ORDER BY {_hash('o_custkey')}) <= floor((1 - 0.15) * count(*) OVER ())
    THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT o_custkey FROM orders)),
grouped AS (SELECT o_orderkey, o_custkey, o_totalprice, split FROM orders JOIN group_names USING (o_custkey)),
parameters AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM grouped WHERE split = 'train'),
scaled AS (SELECT o_orderkey, split, (o_totalprice - m) / s AS z, m, s FROM grouped, parameters)"""

# -- sequences


def _sequences(source: str = "SELECT doc_id, source, replace(text, ' ', '') AS seq FROM documents") -> str:
    return f"""seqs AS ({source}),
chars AS (SELECT doc_id, string_split(seq, '') AS c FROM seqs WHERE length(seq) >= 3),
spots AS (SELECT doc_id, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS z FROM chars),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, x || y || z AS gram FROM spots WHERE z IS NOT NULL)"""


def _signatures(source: str | None = None) -> str:
    a, b = family(100)
    head = _sequences(source) if source else _sequences()
    return f"""{head},
prints AS (
  SELECT DISTINCT doc_id, ((unicode(gram)::BIGINT % {PRIME} * {BASE} + unicode(substr(gram, 2))) % {PRIME} * {BASE}
    + unicode(substr(gram, 3))) % {PRIME} AS h FROM grams),
family AS (SELECT unnest(range(100)) AS p, unnest({a}::BIGINT[]) AS a, unnest({b}::BIGINT[]) AS b),
minima AS MATERIALIZED (SELECT doc_id, p, min((a * h::BIGINT + b) % {PRIME}) AS m FROM prints, family GROUP BY doc_id, p)"""


def _edges_lsh(source: str | None = None) -> str:
    count, rows = choose_bands(0.6, 100)
    return f"""{_signatures(source)},
bands AS MATERIALIZED (
  SELECT doc_id, p // {rows} AS band, string_agg(m, ',' ORDER BY p) AS k FROM minima WHERE p < {count * rows} GROUP BY ALL),
candidates AS MATERIALIZED (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y USING (band, k) WHERE x.doc_id < y.doc_id),
edges AS MATERIALIZED (
  SELECT a, b, count(*) / 100.0 AS similarity
  FROM candidates JOIN minima x ON x.doc_id = a JOIN minima y ON y.doc_id = b AND x.p = y.p AND x.m = y.m
  GROUP BY a, b HAVING count(*) >= {needed_agreement(0.6, 100)})"""


def _edges_exact(source: str | None = None) -> str:
    return f"""{_sequences(source) if source else _sequences()},
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM grams x JOIN grams y USING (gram)
  WHERE x.doc_id < y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT a, b, s / (x.n + y.n - s) AS similarity FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE s / (x.n + y.n - s) >= 0.6)"""


# Keep-first scan by ascending id: carry the list of kept ids from row to row.
SCAN = """nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges)),
smaller AS MATERIALIZED (
  SELECT n.id, n.rn, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS ids
  FROM nodes n LEFT JOIN edges e ON e.b = n.id GROUP BY n.id, n.rn),
scan AS (
  SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
  UNION ALL
  SELECT s.rn, CASE WHEN list_has_any(s.ids, scan.kept) THEN scan.kept ELSE list_append(scan.kept, s.id) END
  FROM scan JOIN smaller s ON s.rn = scan.rn + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS id FROM (SELECT kept FROM scan ORDER BY rn DESC LIMIT 1)),
owners AS MATERIALIZED (SELECT b AS id, min(a) AS owner FROM edges WHERE a IN (FROM kept) AND b NOT IN (FROM kept) GROUP BY b),
members AS MATERIALIZED (SELECT id, owner FROM owners UNION SELECT owner, owner FROM owners)"""
REACH = """links AS (
  SELECT a, b FROM edges WHERE a IN (FROM kept) OR b IN (FROM kept)
  UNION SELECT b, a FROM edges WHERE a IN (FROM kept) OR b IN (FROM kept)),
reach AS (SELECT id, id AS other FROM members UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id),
clusters AS (
  SELECT cluster_id, id, id = owner AS is_extreme,
    CASE WHEN id = owner THEN (SELECT count(*) FROM members m WHERE m.owner = members.id) END AS copies
  FROM members JOIN parts USING (id))"""
# Edges between the first rows of distinct profiles, one of them a representative.
HEADS = """heads AS (SELECT min(doc_id) AS id FROM profiles GROUP BY profile)
SELECT a, b, round(similarity, 6) AS similarity FROM edges
WHERE a IN (FROM heads) AND b IN (FROM heads) AND (a IN (FROM kept) OR b IN (FROM kept))"""

JUDGED = """judged AS (
  SELECT d.source, l.quality AS t, (d.n_chars > 1000)::INT AS p FROM documents d JOIN labels l USING (doc_id))"""
CELLS = """count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp,
  count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 1 AND p = 1) AS tp"""
PREDICTED = "predicted AS (SELECT l_linestatus, l_returnflag, l_extendedprice AS t, l_quantity * 2000.0 AS p FROM lineitem)"


def _profile(by: str) -> str:
    """Right-closed bins; the midpoints are those of edges rounded to 3 digits."""
    keys = by.split(", ")
    on = " AND ".join(f"m.{k} = s.{k}" for k in keys)
    return f"""{PREDICTED},
span AS (SELECT {by}, min(t) AS mn, max(t) AS mx FROM predicted GROUP BY {by}),
cut AS (SELECT {by}, list_transform(range(11), lambda i: CASE WHEN i = 10 THEN mx ELSE i * ((mx - mn) / 10) + mn
    - CASE WHEN i = 0 THEN (mx - mn) * 0.001 ELSE 0 END END) AS edges FROM span),
mids AS (SELECT {by}, unnest(range(1, 11)) AS bin, list_transform(edges, lambda e: round(e, 3)) AS e FROM cut),
sums AS (
  SELECT {by}, len(list_filter(edges, lambda e: e < t)) AS bin, count(*) AS n, avg(p - t) AS m, stddev_samp(p - t) AS s
  FROM predicted JOIN cut USING ({by}) GROUP BY ALL),
profile AS (
  SELECT {', '.join('m.' + k for k in keys)}, m.bin::INT AS bin, (m.e[m.bin] + m.e[m.bin + 1]) / 2 AS mid, coalesce(s.n, 0) AS n, s.m, s.s
  FROM mids m LEFT JOIN sums s ON m.bin = s.bin AND {on}),
pairs AS (
  SELECT {', '.join('l.' + k for k in keys)}, l.bin AS low_bin, h.bin AS high_bin, h.mid - l.mid AS dT,
    abs(h.m - 2 * h.s) + abs(l.m + 2 * l.s) AS total_error, l.m AS lm, l.s AS ls, h.m AS hm, h.s AS hs
  FROM profile l JOIN profile h USING ({by}) WHERE h.mid - l.mid >= 0)"""


def _trend(by: str) -> str:
    return f"""SELECT {by}, regr_count(total_error, dT)::BIGINT AS n, round(regr_slope(total_error, dT), 6) AS slope,
  round(regr_intercept(total_error, dT), 3) AS intercept, round(regr_r2(total_error, dT), 6) AS r2 FROM pairs GROUP BY {by}"""


def _phi(z: str) -> str:
    """Normal distribution function by the series z^(2k+1) / (2k+1)!!, summed smallest factor last."""
    term = f"exp((2*k+1) * ln(abs({z})) - (k+1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()) - {z} * {z} / 2)"
    return f"""CASE WHEN abs({z}) > 8 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END WHEN {z} = 0 THEN 0.5
    ELSE 0.5 + sign({z}) * list_sum(list_transform(range(0, 200), lambda k: {term})) / sqrt(2 * pi()) END"""


HISTORY = """history AS (
  SELECT user_id::VARCHAR AS run, event_type AS metric, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step, max(value) AS value
  FROM events GROUP BY ALL)"""
SIZED = "SELECT doc_id, source, replace(text, ' ', '') AS seq FROM documents"


def _label_window(low: float, high: float) -> str:
    return f"CASE WHEN length(seq) >= {high} THEN 1 WHEN length(seq) <= {low} THEN 0 END"


CLASSIFIER_SOURCE = f"""SELECT doc_id, source, seq, labels FROM (
    SELECT *, row_number() OVER (PARTITION BY labels ORDER BY {_hash('doc_id')}) AS rn,
      least(count(*) FILTER (labels = 0) OVER (), count(*) FILTER (labels = 1) OVER ()) AS small,
      count(*) OVER (PARTITION BY labels) AS own, count(*) OVER () AS everything
    FROM (SELECT *, {_label_window(1000, 2000)} AS labels FROM ({SIZED})) WHERE labels IS NOT NULL)
  WHERE rn <= CASE WHEN own = small THEN own ELSE own - trunc(everything - small / 0.5) END"""
REGRESSOR_SOURCE = f"""SELECT doc_id, source, seq, size FROM (
    SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_hash('doc_id')}) AS rn FROM (
      SELECT *, len(list_filter(e, lambda x: x <= size)) AS bin FROM (
        SELECT doc_id, source, seq, length(seq)::DOUBLE AS size FROM ({SIZED})),
      (SELECT list_transform(range(20), lambda i: CASE WHEN i = 19 THEN mx ELSE i * ((mx - mn) / 19) + mn END) AS e
       FROM (SELECT min(length(replace(text, ' ', '')))::DOUBLE AS mn, max(length(replace(text, ' ', '')))::DOUBLE AS mx FROM documents))))
  WHERE rn <= (
    SELECT coalesce(min(cap) FILTER (kept >= trunc(0.5 * total)), max(cap)) FROM (
      SELECT x.i, any_value(x.c) AS cap, sum(least(x.c, y.c)) AS kept, sum(y.c) AS total FROM (FROM sizes_per_bin) x, (FROM sizes_per_bin) y GROUP BY x.i))"""
REGRESSOR_BINS = f"""doc_edges AS (
  SELECT list_transform(range(20), lambda i: CASE WHEN i = 19 THEN mx ELSE i * ((mx - mn) / 19) + mn END) AS e
  FROM (SELECT min(length(seq))::DOUBLE AS mn, max(length(seq))::DOUBLE AS mx FROM ({SIZED}))),
sizes_per_bin AS (
  SELECT g.i, count(d.bin) AS c FROM (SELECT unnest(range(1, 21)) AS i) g LEFT JOIN (
    SELECT len(list_filter(e, lambda x: x <= length(seq))) AS bin FROM ({SIZED}), doc_edges) d ON d.bin = g.i GROUP BY g.i)"""


def _source_split(rows: str) -> str:
    return f"""names AS (
  SELECT source, CASE WHEN row_number() OVER (ORDER BY {_hash('source')}) <= floor((1 - 0.15) * count(*) OVER ())
    THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT source FROM {rows}))"""



CLASSIFIER_JOB = f"""WITH RECURSIVE chosen AS MATERIALIZED ({CLASSIFIER_SOURCE}), {_edges_lsh('SELECT doc_id, source, seq FROM chosen')}, {SCAN},
  left_over AS (SELECT doc_id, source, labels FROM chosen WHERE doc_id NOT IN (SELECT id FROM owners)), {_source_split('left_over')},
  done AS (SELECT doc_id, source, labels, split FROM left_over JOIN names USING (source))"""
REGRESSOR_JOB = f"""WITH RECURSIVE {REGRESSOR_BINS}, chosen AS MATERIALIZED ({REGRESSOR_SOURCE}),
  {_edges_lsh('SELECT doc_id, source, seq FROM chosen')}, {SCAN},
  left_over AS (SELECT doc_id, source, size FROM chosen WHERE doc_id NOT IN (SELECT id FROM owners)), {_source_split('left_over')},
  named AS (SELECT * FROM left_over JOIN names USING (source))"""


def _newton(steps: int) -> str:
    """Unrolled steps for an intercept and two features with a ridge of 1: the inverse of a 3x3 matrix, written out."""
    out = ["step0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(steps):
        out.append(f"""sums{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(v) AS a, sum(v * x1) AS b, sum(v * x2) AS c,
    sum(v * x1 * x1) + 1 AS d, sum(v * x1 * x2) AS e, sum(v * x2 * x2) + 1 AS f, sum(g) AS g0, sum(g * x1) - any_value(b1) AS g1, sum(g * x2) - any_value(b2) AS g2
  FROM (SELECT b0, b1, b2, x1, x2, w * p * (1 - p) AS v, w * (y - p) AS g
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM weighed, step{k} WHERE split = 'train'))),
step{k + 1} AS (SELECT b0 + ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det AS b0,
    b1 + ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det AS b1,
    b2 + ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS b2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM sums{k}))""")
    return ",\n".join(out)


def _named(columns: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, round({value}, 6) AS value FROM {table}" for name, value in columns.items())


def _encoded(words: str, known: str, length: int) -> str:
    """Ids of the words of ``known`` in word order; others are 1."""
    room = length - 2
    return f"""WITH lists AS (SELECT doc_id, source, {words} AS c FROM documents),
  words AS (SELECT doc_id, source, unnest(c) AS word FROM lists),
  vocabulary AS (SELECT word, row_number() OVER (ORDER BY word) + 4 AS id FROM (SELECT DISTINCT word FROM ({known}))),
  spots AS (SELECT doc_id, unnest(c[1:{room}]) AS word, unnest(range(1, least(len(c), {room}) + 1)) AS i FROM lists),
  ids AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY i) AS ids FROM spots LEFT JOIN vocabulary USING (word) GROUP BY doc_id),
  framed AS (SELECT doc_id, list_concat(list_concat([2], ids), [3]) AS f FROM ids)
  SELECT doc_id, md5(array_to_string(list_concat(f, list_transform(range({length} - len(f)), lambda x: 0)), ',')) AS digest,
    len(f)::INT AS n_tokens FROM framed"""


ORACLES = {
    "join_length_exclusive": f"{JOINED} WHERE length(d.text) > 50 AND length(d.text) < 2000 AND l.quality IS NOT NULL",
    "join_length_inclusive": f"{JOINED} WHERE length(d.text) > 50 AND length(d.text) <= 2000 AND l.quality IS NOT NULL",
    "source_sample": f"""SELECT * FROM ({JOINED} ORDER BY {_hash('d.doc_id')} LIMIT 200)
  WHERE length > 50 AND length < 2000 AND quality IS NOT NULL""",
    "invalid_sequences": "SELECT doc_id, n_chars FROM documents WHERE contains(text, ' ')",
    "window_label": f"WITH {LABELLED} SELECT * FROM labelled",
    "class_ratio": f"""WITH {LABELLED} SELECT event_type, count(*) AS n_rows, sum(labels)::BIGINT AS n_positive,
  round(avg(labels), 6) AS ratio FROM labelled GROUP BY event_type""",
    "class_weights": f"""WITH {LABELLED}, p AS (SELECT event_type, avg(labels) AS p FROM labelled GROUP BY event_type)
  SELECT event_type, 0 AS label, round(p / nullif(1 - p, 0), 6) AS weight FROM p UNION ALL SELECT event_type, 1, 1.0::DOUBLE FROM p""",
    "balance_sizes": f"WITH {LABELLED}, {_targets(0.4, 0.25, 'event_type')} SELECT * FROM targets",
    "balanced_down": f"""WITH {LABELLED}, {_targets(0.5, 0.0, '')},
  ranked AS (SELECT event_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {_hash('event_id')}) AS rn FROM labelled)
  SELECT event_id, labels FROM ranked JOIN targets ON label = labels WHERE rn <= n_after""",
    "balanced_up": f"""WITH {LABELLED}, {_targets(0.5, 1.0, '')},
  ranked AS (SELECT event_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {_hash('event_id')}) AS rn FROM labelled),
  draws AS (SELECT label, n_before, unnest(range(n_after)) AS i FROM targets WHERE n_after > n_before),
  hits AS (SELECT label, ('0x' || substr(md5(i::VARCHAR || '|{SEED}'), 1, 15))::BIGINT % n_before AS pos, count(*) AS copies FROM draws GROUP BY ALL)
  SELECT event_id, labels, 1::BIGINT AS copies FROM ranked JOIN targets ON label = labels WHERE n_after <= n_before AND rn <= n_after
  UNION ALL SELECT event_id, labels, copies FROM ranked JOIN hits ON label = labels AND pos = rn - 1""",
    "bin_histogram": f"WITH {_histogram()} SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, n_before FROM histogram",
    "bin_cap": f"WITH {_histogram('o_orderpriority')}, {_caps('o_orderpriority')} SELECT * FROM caps",
    "bin_undersample": f"""WITH {_histogram()}, {_caps()},
  ranked AS (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY bin ORDER BY {_hash('o_orderkey')}) AS rn FROM binned)
  SELECT o_orderkey, o_totalprice FROM ranked, caps WHERE rn <= cap""",
    "shuffled_positions": f"""SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash('o_orderkey')}) - 1 AS position FROM orders""",
    "gather_positions": """WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
  SELECT o_orderkey, count(*) AS times FROM placed JOIN lineitem ON l_orderkey = position GROUP BY o_orderkey""",
    "random_split": f"WITH {RANDOM_SPLIT} SELECT o_orderkey, split FROM random_split",
    "group_split": f"WITH {GROUP_SPLIT} SELECT o_orderkey, o_custkey, split FROM grouped",
    "prefix_split": f"""WITH named AS (SELECT p_partkey, split_part(trim(p_name), ' ', 1) AS p_name_prefix FROM part WHERE p_name IS NOT NULL),
  names AS (SELECT p_name_prefix, CASE WHEN row_number() OVER (ORDER BY {_hash('p_name_prefix')}) <= floor((1 - 0.3) * count(*) OVER ())
    THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT p_name_prefix FROM named))
  SELECT p_partkey, p_name_prefix, split FROM named JOIN names USING (p_name_prefix)""",
    "split_leakage": f"WITH {RANDOM_SPLIT} SELECT o_custkey FROM random_split GROUP BY o_custkey HAVING count(DISTINCT split) > 1",
    "split_leakage_grouped": f"""WITH {GROUP_SPLIT} SELECT count(*) AS n_leaking FROM (
    SELECT o_custkey FROM grouped GROUP BY o_custkey HAVING count(DISTINCT split) > 1)""",
    "split_stats": f"""WITH {GROUP_SPLIT} SELECT split, count(*) AS n, round(avg(o_totalprice), 3) AS mean,
  round(stddev_pop(o_totalprice), 3) AS std FROM grouped GROUP BY split""",
    "standardized": f"WITH {GROUP_SPLIT} SELECT o_orderkey, split, round(z, 6) AS o_totalprice FROM scaled",
    "unstandardized": f"WITH {GROUP_SPLIT} SELECT o_orderkey, round(z * s + m, 4) AS o_totalprice FROM scaled",
    "null_baseline": f"""WITH {GROUP_SPLIT} SELECT split, count(*) AS n, round(sum(z * z), 4) AS sum_square,
  round(avg(z * z), 6) AS null_loss FROM scaled GROUP BY split""",
    "kgrams": f"""WITH {_sequences()} SELECT doc_id, count(gram)::INT AS n_grams, md5(coalesce(string_agg(gram, '' ORDER BY gram), '')) AS digest
  FROM seqs LEFT JOIN grams USING (doc_id) GROUP BY doc_id""",
    "minhash_signatures": f"""WITH {_signatures()} SELECT doc_id, string_agg(m, ',' ORDER BY p) AS signature
  FROM seqs LEFT JOIN minima USING (doc_id) GROUP BY doc_id""",
    "lsh_pairs": f"""WITH RECURSIVE {_edges_lsh()}, {SCAN},
profiles AS (SELECT doc_id, string_agg(m, ',' ORDER BY p) AS profile FROM minima GROUP BY doc_id), {HEADS}""",
    "exact_pairs": f"""WITH RECURSIVE {_edges_exact()}, {SCAN},
profiles AS (SELECT doc_id, string_agg(gram, chr(1) ORDER BY gram) AS profile FROM grams GROUP BY doc_id), {HEADS}""",
    "dedup_clusters": f"WITH RECURSIVE {_edges_lsh()}, {SCAN}, {REACH} SELECT * FROM clusters",
    "dedup_representatives": f"WITH RECURSIVE {_edges_lsh()}, {SCAN} SELECT owner AS id, count(*) AS copies FROM members GROUP BY owner",
    "dedup_seeded": f"""WITH RECURSIVE placed AS (SELECT doc_id AS own, row_number() OVER (ORDER BY {_hash('doc_id')}) AS doc_id, source, text FROM documents),
  {_edges_exact("SELECT doc_id, source, replace(text, ' ', '') AS seq FROM placed")}, {SCAN}
  SELECT own AS id, count(*) AS copies FROM members JOIN placed ON owner = doc_id GROUP BY own""",
    "dedup_rows": f"""WITH RECURSIVE {_edges_lsh()}, {SCAN}
  SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM owners)""",
    "dedup_summary": f"""WITH RECURSIVE {_edges_lsh()}, {SCAN}, {REACH}
  SELECT (SELECT count(*) FROM documents) AS n_before, (SELECT count(*) FROM documents) - (SELECT count(*) FROM owners) AS n_after,
    count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_in_clusters, count(*) FILTER (is_extreme) AS n_representatives FROM clusters""",
    "normalized_sequence": """SELECT doc_id, md5(regexp_replace(array_to_string(string_split(substr(text, 2), ''), ' '), '[UZOB]', 'X', 'g')) AS digest
  FROM documents""",
    "encoded_tokens": _encoded("string_split(text, '')", "SELECT word, 1 AS n FROM words", 512),
    "encoded_words": _encoded("string_split(lower(text), ' ')", "SELECT word, count(DISTINCT doc_id) AS n FROM words GROUP BY word HAVING n > 1", 512),
    "encoded_sequences": _encoded(
        "string_split(regexp_replace(array_to_string(string_split(substr(translate(text, 'uzob', 'UZOB'), 2), ''), ' '), '[UZOB]', 'X', 'g'), ' ')",
        "SELECT word, 1 AS n FROM words WHERE source = (SELECT min(source) FROM documents)",
        256,
    ),
    "argmax_labels": "SELECT vec_id, label, (list_position(embedding, list_max(embedding)) - 1)::INT AS prediction FROM embeddings",
    "weighted_log_loss": """WITH x AS (SELECT label % 2 AS y, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
  ce AS (SELECT y, ln(list_sum(list_transform(v, lambda t: exp(t - list_max(v))))) + list_max(v) - v[y + 1] AS l FROM x),
  p AS (SELECT avg(y) AS p FROM x), w AS (SELECT CASE WHEN y = 1 THEN 1.0 ELSE p / (1 - p) END AS w, l FROM ce, p)
  SELECT round(sum(w * l) / sum(w), 6) AS log_loss FROM w""",
    "confusion": f"WITH {JUDGED} SELECT {CELLS} FROM judged",
    "classification_metrics": f"""WITH {JUDGED}, c AS (SELECT source, {CELLS} FROM judged GROUP BY source)
  SELECT source, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1,
    round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0::DOUBLE
      ELSE (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))::DOUBLE) END, 6) AS matthew FROM c""",
    "regression_metrics": f"""WITH {PREDICTED} SELECT l_returnflag, count(*) AS n, round(avg((p - t) * (p - t)), 1) AS mse,
  round(avg(abs(p - t)), 4) AS mae, round(1 - avg((p - t) * (p - t)) / var_pop(t), 6) AS r2 FROM predicted GROUP BY l_returnflag""",
    "spearman": f"""WITH {PREDICTED}, ranked AS (SELECT l_returnflag,
    rank() OVER (PARTITION BY l_returnflag ORDER BY t) + (count(*) OVER (PARTITION BY l_returnflag, t) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2.0 AS y FROM predicted)
  SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS spearman FROM ranked GROUP BY l_returnflag""",
    "error_profile": f"""WITH {_profile('l_linestatus')} SELECT l_linestatus, bin, n, round(mid, 3) AS mid, round(m, 3) AS mean_error,
  round(s, 3) AS std_error, round(m - s, 3) AS lo, round(m + s, 3) AS hi FROM profile""",
    "error_pairs": f"""WITH {_profile('l_linestatus')} SELECT l_linestatus, low_bin, high_bin, round(dT, 3) AS dT,
  round(total_error, 3) AS total_error FROM pairs""",
    "error_trend": f"WITH {_profile('l_linestatus')} {_trend('l_linestatus')}",
    "overlap_probability": f"""WITH {_profile('l_linestatus')},
  ready AS (SELECT *, dT + hm AS m2, 1 / (2 * ls * ls) - 1 / (2 * hs * hs) AS qa, (dT + hm) / (hs * hs) - lm / (ls * ls) AS qb,
    lm * lm / (2 * ls * ls) - (dT + hm) * (dT + hm) / (2 * hs * hs) - ln(hs / ls) AS qc FROM pairs WHERE dT > 0 AND ls > 0 AND hs > 0),
  roots AS (SELECT *, CASE WHEN qa = 0 THEN [-qc / nullif(qb, 0)]
      ELSE [(-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)] END AS x
    FROM ready WHERE qa = 0 OR qb * qb - 4 * qa * qc >= 0),
  found AS (SELECT *, list_filter(x, lambda v: v > lm AND v < m2)[-1] AS root FROM roots),
  z AS (SELECT *, (coalesce(root, 1.0) - lm) / ls AS z1, (coalesce(root, 1.0) - m2) / hs AS z2 FROM found)
  SELECT l_linestatus, low_bin, high_bin, round(coalesce(root, 1.0), 3) AS crossing, root IS NULL AS is_fallback,
    round(1 - ({_phi('z1')}) + ({_phi('z2')}), 6) AS overlap_probability FROM z""",
    "density_grid": """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2) AS h, min(value) AS mn, max(value) AS mx
    FROM events WHERE NOT isnan(value) GROUP BY event_type),
  grid AS (SELECT event_type, n, h, mn - 3 * h AS x0, mx + 3 * h AS x1, unnest(range(200)) AS point FROM s),
  spots AS (SELECT event_type, n, h, point, x0 + point * ((x1 - x0) / 199) AS x FROM grid)
  SELECT event_type, point::INT AS point, round(any_value(x), 4) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) AS density
  FROM spots JOIN events USING (event_type) WHERE NOT isnan(value) GROUP BY event_type, point""",
    "joint_bins": f"""WITH {PREDICTED}, e1 AS ({_edges('predicted', 't', 20)}), e2 AS ({_edges('predicted', 'p', 20)})
  SELECT len(list_filter(e1.edges, lambda e: e <= t))::INT AS bin_1, len(list_filter(e2.edges, lambda e: e <= p))::INT AS bin_2, count(*) AS n
  FROM predicted, e1, e2 GROUP BY ALL""",
    "metric_history": f"WITH {HISTORY} SELECT run, 'model_' || metric AS metric, step, value FROM history",
    "metric_pivot": f"WITH {HISTORY} SELECT run, step, {', '.join(f'''max(value) FILTER (metric = '{t}') AS {t}''' for t in TYPES)} FROM history GROUP BY run, step",
    "latest_metrics": f"WITH {HISTORY} SELECT run, metric, max(step) AS step, arg_max(value, step) AS value FROM history GROUP BY run, metric",
    "best_step": f"""WITH {HISTORY} SELECT run, step, value FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS rn FROM history WHERE metric = 'view') WHERE rn = 1""",
    "logs_to_columns": """SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step,
    CASE WHEN event_type <> 'error' THEN value END AS loss, CASE WHEN event_type = 'error' THEN (props->>'$.k')::INT END AS k FROM events""",
    "batch_score": f"""SELECT vec_id AS id, label::DOUBLE AS truth,
    round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({WEIGHTS}::DOUBLE[])[i])) + 0.5, 4) AS prediction FROM embeddings""",
    "train_classifier": f"""WITH rows AS (SELECT doc_id, quality AS y, ln(1 + length(text)) AS x1,
    length(text) / (length(text) - length(replace(text, ' ', '')) + 1) AS x2 FROM documents JOIN labels USING (doc_id)),
  parted AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_hash('doc_id')}) <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM rows),
  shares AS (SELECT avg(y) AS p FROM parted WHERE split = 'train'),
  weighed AS (SELECT *, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE shares.p / (1 - shares.p) END AS w FROM (SELECT doc_id, y, x1, x2, split FROM parted), shares),
  {_newton(14).replace('FROM weighed, step', 'FROM (SELECT y, x1, x2, split, w FROM weighed), step')},
  judged AS (SELECT w, y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS q FROM (SELECT y, x1, x2, split, w FROM weighed), step14 WHERE split = 'test'),
  losses AS (SELECT -sum(w * (y * ln(q) + (1 - y) * ln(1 - q))) / sum(w) AS log_loss, ln(2) AS null_loss FROM judged)
  {_named({'intercept': 'b0', 'size': 'b1', 'word_length': 'b2'}, 'step14')} UNION ALL {_named({'log_loss': 'log_loss', 'null_loss': 'null_loss'}, 'losses')}""",
    "train_regressor": f"""WITH rows AS (SELECT l_quantity::DOUBLE AS x1, l_tax::DOUBLE AS x2, l_extendedprice::DOUBLE AS price,
    CASE WHEN row_number() OVER (ORDER BY {_hash('l_orderkey', 'l_linenumber')}) <= ceil(0.15 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM lineitem),
  scale AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM rows WHERE split = 'train'),
  scaled AS (SELECT x1, x2, (price - m) / s AS y, split FROM rows, scale),
  sums AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM scaled WHERE split = 'train'),
  slopes AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM sums),
  model AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM slopes),
  losses AS (SELECT avg(pow(b0 + b1 * x1 + b2 * x2 - y, 2)) AS mse, avg(y * y) AS null_mse FROM scaled, model WHERE split = 'test')
  {_named({'intercept': 'b0', 'l_quantity': 'b1', 'l_tax': 'b2'}, 'model')} UNION ALL {_named({'mse': 'mse', 'null_mse': 'null_mse'}, 'losses')}""",
    "classifier_data": f"{CLASSIFIER_JOB} SELECT * FROM done",
    "classifier_saved": f"""{CLASSIFIER_JOB}
  SELECT doc_id, source, labels, n_train, n_test, mean_train, mean_test, n_in_clusters FROM done, (SELECT count(*) AS n_in_clusters FROM members),
    (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
      round(avg(labels) FILTER (split = 'train'), 6) AS mean_train, round(avg(labels) FILTER (split = 'test'), 6) AS mean_test FROM done)
  WHERE split = 'test'""",
    "regressor_data": f"""{REGRESSOR_JOB}, fitted AS (SELECT avg(size) AS m, stddev_pop(size) AS s FROM named WHERE split = 'train')
  SELECT doc_id, split, round((size - m) / s, 6) AS labels FROM named, fitted""",
    "regressor_saved": f"""{REGRESSOR_JOB}
  SELECT doc_id, split, round(size, 4) AS labels, n_train, n_test, mean_train, std_train, mean_test, std_test FROM named,
    (SELECT {', '.join(f"count(*) FILTER (split = '{x}') AS n_{x}, round(avg(size) FILTER (split = '{x}'), 4) AS mean_{x}, round(stddev_pop(size) FILTER (split = '{x}'), 4) AS std_{x}" for x in ('train', 'test'))} FROM named)""",
    "prediction_report": f"WITH {_profile('l_returnflag, l_linestatus')} {_trend('l_returnflag, l_linestatus')}",
    "history_log": """WITH rows AS (SELECT user_id::VARCHAR AS run, 'Eval/' || event_type AS metric,
    date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step, value, event_id FROM events WHERE NOT isnan(value))
  SELECT run, metric, step, arg_max(value, event_id) AS value FROM rows GROUP BY run, metric, step""",
    "latest_report": f"""WITH {HISTORY}, last AS (SELECT run, metric, arg_max(value, step) AS value FROM history GROUP BY run, metric)
  SELECT run, {', '.join(f"max(value) FILTER (metric = '{t}') AS {t}" for t in TYPES)} FROM last GROUP BY run""",
    "user_map": "SELECT doc_id, text[1:20] AS text, length(text) - length(replace(text, 'e', '')) AS n FROM documents",
    "user_filter": "SELECT doc_id, n_chars FROM documents WHERE 20 * (length(text) - length(replace(text, 'a', ''))) > n_chars",
    "user_reduce": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest FROM documents GROUP BY source",
}
