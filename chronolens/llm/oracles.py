"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, outliers

_CHAT = r"""
WITH n AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT * FROM n WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1),
g AS (SELECT a.conv_id, a.turn, a.text, d.conv_id AS donor, d.text AS answer FROM a JOIN a d ON d.conv_id = xor(a.conv_id, 1)),
s AS (
  SELECT conv_id AS pair_id, true AS chosen, conv_id, turn, role, text FROM n
  UNION ALL SELECT conv_id, false, donor, n.turn, role, n.text FROM n JOIN g USING (conv_id) WHERE n.turn < g.turn OR (n.turn = g.turn AND (role < 'assistant' OR (role = 'assistant' AND n.text < g.text)))
  UNION ALL SELECT conv_id, false, donor, turn, 'assistant', answer FROM g),
t AS (
  SELECT pair_id, chosen, conv_id, role, text,
         row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' || chr(10) AS body
  FROM s),
sides AS (
  SELECT pair_id, min(conv_id) FILTER (chosen) AS chosen_id, min(conv_id) FILTER (NOT chosen) AS rejected_id,
         count(*) FILTER (chosen) AS nc, count(*) FILTER (NOT chosen) AS nr
  FROM t GROUP BY pair_id),
same AS (
  SELECT c.pair_id, c.pos, c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS eq
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.chosen AND NOT r.chosen),
lcp AS (
  SELECT s.pair_id, chosen_id, rejected_id, nc, nr,
         coalesce((SELECT min(pos) - 1 FROM same WHERE same.pair_id = s.pair_id AND NOT eq), least(nc, nr)) AS shared
  FROM sides s),
pieces AS (
  SELECT t.*, l.shared, '0x' || length(head) || CASE WHEN role = 'assistant' THEN ',1x' ELSE ',0x' END || length(body) AS m
  FROM t JOIN lcp l USING (pair_id))
SELECT l.pair_id, l.chosen_id, l.rejected_id, CAST(l.shared AS INTEGER) AS shared, CAST(l.nc AS INTEGER) AS chosen_turns, CAST(l.nr AS INTEGER) AS rejected_turns,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (chosen AND pos <= p.shared), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (chosen AND pos > p.shared), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT p.chosen AND pos > p.shared), '') AS rejected,
       coalesce(string_agg(m, ',' ORDER BY pos) FILTER (chosen AND pos > p.shared), '') AS chosen_mask,
       coalesce(string_agg(m, ',' ORDER BY pos) FILTER (NOT p.chosen AND pos > p.shared), '') AS rejected_mask
FROM lcp l JOIN pieces p ON l.pair_id = p.pair_id
GROUP BY l.pair_id, l.chosen_id, l.rejected_id, l.shared, l.nc, l.nr
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _phrase(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"[i FOR i IN range(0, len(w) - {len(words) - 1}) IF {same}]"


def _license() -> str:
    templates = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(licenses.TEMPLATES))
    of = "CASE " + " ".join(f"WHEN len(tw) <= {c} THEN {c}" for c in sorted(licenses.RUNS)) + " ELSE -1 END"
    places = ",\n".join(f"{_phrase(p)} AS p{k}" for k, (p, _) in enumerate(licenses.PHRASES))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
templates AS (SELECT label, list_distinct(tw) AS tw, {of} AS kind FROM (SELECT label, {_WORDS.format("t")} AS tw FROM (VALUES {templates}) v(i, label, t))),
known AS (SELECT list(DISTINCT w) AS known FROM (SELECT unnest(tw) AS w FROM templates)),
lines AS (
  SELECT r, 0 AS kind, list_distinct({_WORDS.format("line")}) AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  UNION ALL SELECT r, c, list_distinct(w[i + 1:i + 2 * c]) FROM (
    SELECT r, c, w, unnest(range(0, greatest(len(w), 1), c)) AS i FROM (SELECT r, {_WORDS.format("text")} AS w FROM docs WHERE contains(text, chr(10))), (VALUES {", ".join(f"({c})" for c in licenses.RUNS)}) v(c))),
held AS (SELECT r, kind, list_intersect(lw, known) AS lw FROM lines, known),
hits AS (
  SELECT r, label, len(list_intersect(lw, tw)) / len(tw) AS c FROM held l, templates t
  WHERE (l.kind = 0 OR l.kind = t.kind) AND len(list_intersect(lw, tw)) >= ceil(len(tw) * 0.8 - 1e-9)),
best AS (SELECT r, list(DISTINCT label) AS found, max(c) AS score FROM hits GROUP BY r),
words AS (SELECT r, doc_id, {_WORDS.format("text")} AS w FROM docs),
places AS (SELECT r, doc_id, len(w) AS n_words, {places} FROM words),
base AS (SELECT r, doc_id, n_words, {every} AS starts, list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)) AS labels FROM places)
SELECT doc_id, n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
       array_to_string(base.labels, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base.labels || coalesce(found, []))), ',') AS labels, coalesce(score, 0.0) AS score
FROM base LEFT JOIN best USING (r)
"""


SQL: dict[str, str] = {"op8_license_scan": _license(), "op9_preference_format": _CHAT}


_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
e AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
         CASE WHEN t = '' OR h3 % 100 >= 100 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e))
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

#: CRC-32 byte by byte; its table is worked out from the polynomial. Near words are found by their strings with one code point left out.
_VARIANTS = r"""
WITH tab AS (SELECT list(v ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT id, w, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS h FROM each, tab),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS other_n FROM near GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n,
         CASE WHEN b.other_n >= 5 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = b.other_n) END AS form
  FROM words w LEFT JOIN best b USING (word)),
steps AS (
  WITH RECURSIVE s AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
  SELECT word, arg_max(root, k) AS root FROM s GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
"""


def _estimate(name: str, source: str, factor: float) -> str:
    """Means and inverse triangle of the covariance of source's rows by (g, start), in two steps of named columns."""
    p, low = outliers.P, outliers.LOWER
    moments = ", ".join([f"avg(x{i}) AS m{i}" for i in range(p)] + [f"covar_pop(x{i}, x{j}) AS c{i}_{j}" for i, j in low])
    parts = []
    for i, j in low:
        own = f"c{i}_{j} * {factor} + {outliers.FLOORS[i] ** 2 if i == j else 0}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        parts.append(f"sqrt({own}) AS l{i}_{j}" if i == j else f"({own}) / l{j}_{j} AS l{i}_{j}")
    for i in range(p):
        for j in range(i, -1, -1):
            parts.append(f"({int(i == j)}{''.join(f' - l{i}_{k} * w{k}_{j}' for k in range(j, i))}) / l{i}_{i} AS w{i}_{j}")
    kept = ", ".join(["g", "start", *(f"m{i}" for i in range(p)), *(f"w{i}_{j}" for i, j in low), "+".join(f"ln(l{i}_{i})" for i in range(p)) + " AS size"])
    return f"{name} AS MATERIALIZED (SELECT {kept} FROM (SELECT *, {', '.join(parts)} FROM (SELECT g, start, {moments} FROM {source} GROUP BY 1, 2)))"


def _outliers() -> str:
    p, low = outliers.P, outliers.LOWER
    xs = ", ".join(f"x{i}" for i in range(p))
    names = ", ".join(["g", "start", *(f"m{i}" for i in range(p)), *(f"w{i}_{j}" for i, j in low), "size"])
    d2 = " + ".join("(" + " + ".join(f"w{i}_{j} * (x{j} - m{j})" for j in range(i + 1)) + ") ** 2" for i in range(p))
    scale = lambda i: f"greatest((quantile_disc(x{i}, 0.75) - quantile_disc(x{i}, 0.25)) / 1.349, {outliers.FLOORS[i]})"
    middle = ", ".join([f"quantile_disc(x{i}, 0.5) AS m{i}" for i in range(p)] + [f"1 / {scale(i)} AS w{i}_{j}" if i == j else f"0.0 AS w{i}_{j}" for i, j in low])
    steps = []
    for k in range(outliers.STEPS):
        steps += [
            f"far{k} AS (SELECT g, start, {xs}, CAST(floor(log2({d2} + 1e-12) * {outliers.BINS}) AS INTEGER) AS bin FROM v JOIN e{k} USING (g))",
            f"cum{k} AS (SELECT g, start, bin, sum(count(*)) OVER (PARTITION BY g, start ORDER BY bin) AS up, sum(count(*)) OVER (PARTITION BY g, start) AS n FROM far{k} GROUP BY 1, 2, 3)",
            f"in{k} AS (SELECT f.* FROM far{k} f JOIN (SELECT g, start, min(bin) AS edge FROM cum{k} WHERE up >= n * {outliers.H} GROUP BY 1, 2) USING (g, start) WHERE bin <= edge)",
            _estimate(f"e{k + 1}", f"in{k}", outliers.H_FACTOR),
        ]
    least = outliers.LEAST
    return rf"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
tri AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM tri) WHERE k > 1) GROUP BY 1),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS MATERIALIZED (
  SELECT docs.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
stat AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{sql} AS x{i}" for i, (sql, _) in enumerate(outliers.FEATURES.values()))} FROM base),
vec AS MATERIALIZED (SELECT DISTINCT lang, source, {xs} FROM stat WHERE NOT base_failed),
sizes AS (SELECT lang, source, count(*) AS n FROM vec GROUP BY 1, 2),
pools AS (SELECT lang, sum(n) AS wide_n FROM sizes WHERE n < {least} GROUP BY 1),
lead AS (SELECT lang, arg_max({{'l': lang, 's': source}}, (n, source)) AS g FROM sizes WHERE n >= {least} GROUP BY 1),
rest AS (SELECT sum(wide_n) AS rest_n FROM pools WHERE wide_n < {least} AND NOT EXISTS (SELECT 1 FROM lead WHERE lead.lang IS NOT DISTINCT FROM pools.lang)),
most AS (SELECT arg_max(g, (n, CAST(g AS VARCHAR))) AS g FROM (
  SELECT '0' || CAST({{'l': lang, 's': source}} AS VARCHAR) AS g, n FROM sizes WHERE n >= {least} UNION ALL SELECT '1' || CAST({{'l': lang}} AS VARCHAR), wide_n FROM pools WHERE wide_n >= {least})),
named AS MATERIALIZED (
  SELECT s.lang, s.source,
    CASE WHEN n >= {least} THEN '0' || CAST({{'l': s.lang, 's': s.source}} AS VARCHAR) WHEN wide_n >= {least} THEN '1' || CAST({{'l': s.lang}} AS VARCHAR)
         WHEN lead.g IS NOT NULL THEN '0' || CAST(lead.g AS VARCHAR) WHEN rest_n >= {least} THEN '2' ELSE most.g END AS g,
    n >= {least} OR coalesce(wide_n, 0) >= {least} OR (lead.g IS NULL AND coalesce(rest_n, 0) >= {least}) AS member
  FROM sizes s LEFT JOIN pools p ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN lead ON lead.lang IS NOT DISTINCT FROM s.lang, rest, most),
v AS MATERIALIZED (SELECT g, {xs} FROM vec JOIN named ON vec.lang IS NOT DISTINCT FROM named.lang AND vec.source IS NOT DISTINCT FROM named.source WHERE member AND g IS NOT NULL),
v1 AS (SELECT *, 1 AS start FROM v),
{_estimate("whole", "v1", 1.0)},
e0 AS MATERIALIZED (SELECT {names} FROM whole UNION ALL SELECT g, 0, {middle}, 0.0 FROM v GROUP BY g),
{", ".join(steps)},
best AS MATERIALIZED (SELECT * FROM e{outliers.STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY size, start) = 1),
inside AS (SELECT g, start, {xs} FROM v JOIN best USING (g) WHERE {d2} <= {outliers.QUANTILE}),
{_estimate("last", "inside", outliers.Q_FACTOR)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({d2} <= {outliers.CUTOFF}, true) AS kept
FROM stat LEFT JOIN named ON stat.lang IS NOT DISTINCT FROM named.lang AND stat.source IS NOT DISTINCT FROM named.source LEFT JOIN last USING (g)
"""


SQL |= {"op11_robust_outliers": _outliers(), "op12_spelling_variants": _VARIANTS, "op13_fill_in_middle": _MIDDLE}
