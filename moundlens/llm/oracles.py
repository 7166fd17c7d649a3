"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

from moundlens.llm.licenses import TEMPLATES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

DECONTAMINATE = rf"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM parts, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, item FROM doc_windows JOIN item_windows USING (n, win)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY ALL
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY ALL
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM parts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Words have no blanks inside, so joining them by one space keeps sequences apart.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH parts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM parts WHERE len(w) >= 13)
), firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
  FROM wins JOIN firsts USING (win) WHERE first < doc_id
), lost AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(places, []) AS places,
    list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(places, []), k)) AS stay
  FROM parts LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(stay, lambda k: w[k]), ' ')) AS kept_sha256
FROM kept
"""

LINE_DEDUP = rf"""
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS raw, string_split({_LOWERED}, chr(10)) AS low FROM documents
), split AS (
  SELECT doc_id, line, regexp_extract_all(low[line + 1], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, low, unnest(range(len(low))) AS line FROM parts)
), shingles AS (
  SELECT DISTINCT doc_id, line, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, line, w, unnest(range(1, len(w) - 3)) AS k FROM split WHERE len(w) >= 5)
), sizes AS (SELECT doc_id, line, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (
  SELECT a.doc_id, a.line, b.doc_id AS other, b.line AS other_line, count(*) AS met
  FROM shingles a JOIN shingles b
    ON a.s = b.s AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line < a.line))
  GROUP BY ALL
), gone AS (
  SELECT DISTINCT p.doc_id, p.line
  FROM shared p JOIN sizes a ON a.doc_id = p.doc_id AND a.line = p.line
  JOIN sizes b ON b.doc_id = p.other AND b.line = p.other_line
  WHERE 9 * met >= 4 * (a.n + b.n)
), lists AS (SELECT doc_id, list(line ORDER BY line) AS lines FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(raw), 0)::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(lines, ','), '') AS removed_lines,
  sha256(array_to_string(list_transform(
    list_filter(range(1, len(raw) + 1), lambda k: NOT list_contains(coalesce(lines, []), k - 1)), lambda k: raw[k]), chr(10))) AS kept_sha256
FROM parts LEFT JOIN lists USING (doc_id)
"""

_CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\])"
CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), counted AS (
  SELECT *, length(text) // 4 + 4 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
  FROM turns
), led AS (
  SELECT *, place = 1 AND role = 'system' AS sys,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto
  FROM counted
), based AS (
  SELECT *, coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS lead FROM led
), measured AS (
  SELECT *, upto - lead AS stop, upto - lead - tokens AS start, greatest(384 - lead, 128)::BIGINT AS room FROM based
), spanned AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE (stop - 1)::BIGINT // room END AS span FROM measured
), keyed AS (
  SELECT *, span * 2 + CASE WHEN NOT sys AND start::BIGINT // room < span
      AND sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, span) > room THEN 0 ELSE 1 END AS rawkey
  FROM spanned
), aligned AS (
  SELECT *, CASE WHEN sys THEN coalesce(min(CASE WHEN NOT sys THEN rawkey END) OVER (PARTITION BY conv_id), 1) ELSE rawkey END AS win
  FROM keyed
), numbered AS (
  SELECT *, max(stop) OVER (PARTITION BY conv_id, win) AS edge, max(win) OVER (PARTITION BY conv_id) AS lastwin FROM aligned
), windows AS (SELECT conv_id, count(DISTINCT win) AS n FROM numbered GROUP BY ALL),
copies AS (
  SELECT t.*, CASE WHEN sys THEN n WHEN edge - start <= 128 AND win < lastwin THEN 2 ELSE 1 END AS times
  FROM numbered t JOIN windows USING (conv_id)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  sum(times * (9 + length(role) + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))))::BIGINT AS formatted_chars
FROM copies GROUP BY conv_id
"""

_LISTED = ", ".join(
    "({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES)
)
LICENSES = rf"""
WITH listed(k, license, body) AS (VALUES {_LISTED}),
parts AS (
  SELECT k, license, body AS text, TRUE AS entire FROM listed
  UNION ALL
  SELECT 100 + 10 * k + i, license, string_split(body, chr(10) || chr(10))[i], FALSE
  FROM (SELECT *, unnest(range(1, len(string_split(body, chr(10) || chr(10))) + 1)) AS i
        FROM listed WHERE contains(body, chr(10) || chr(10)))
), raw AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), begun AS (
  SELECT *, CASE WHEN line = 0 OR lag(t) OVER (PARTITION BY doc_id ORDER BY line) = '' THEN 1 ELSE 0 END AS b FROM raw
), par AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM begun),
units AS (
  SELECT doc_id, 'line' AS unit, line, t AS text FROM raw
  UNION ALL
  SELECT doc_id, 'paragraph', min(line), string_agg(t, chr(10) ORDER BY line) FROM par GROUP BY doc_id, p HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, 'text', 0, string_agg(t, chr(10) ORDER BY line) FROM par GROUP BY doc_id HAVING max(p) > 1
), cut AS (
  SELECT doc_id, unit, line, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM units
), grams AS (
  SELECT DISTINCT doc_id, unit, line, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM cut WHERE len(w) > 1)
), sizes AS (SELECT doc_id, unit, line, count(*) AS n FROM grams GROUP BY ALL),
tcut AS (
  SELECT k, license, entire, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM parts
), tgrams AS (
  SELECT DISTINCT k, license, entire, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tcut WHERE len(w) > 1)
), tsizes AS (SELECT k, license, count(*) AS n FROM tgrams GROUP BY k, license, entire HAVING entire OR count(*) >= 5),
met AS (
  SELECT doc_id, unit, line, k, count(*) AS shared FROM grams JOIN tgrams USING (g) GROUP BY ALL
), good AS (
  SELECT doc_id, unit, line, license, shared, s.n + t.n AS size
  FROM met JOIN sizes s USING (doc_id, unit, line) JOIN tsizes t USING (k)
  WHERE 20 * shared >= 9 * (s.n + t.n)
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, line ORDER BY shared / (s.n + t.n) DESC, k) = 1
), told AS (
  SELECT doc_id, count(*) AS n,
    array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses,
    string_agg(concat_ws(':', line, unit, license, shared, size), ';' ORDER BY line, unit) AS places
  FROM good GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, coalesce(places, '') AS places
FROM documents LEFT JOIN told USING (doc_id)
"""

DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), grps AS (SELECT DISTINCT lang, source FROM docs),
toks AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS l FROM toks GROUP BY ALL HAVING count(DISTINCT d) >= 3),
own AS (SELECT lang, source, term, count(*) AS c FROM toks GROUP BY ALL),
langs AS (SELECT lang, sum(l) AS nl, count(*) AS v FROM kept GROUP BY lang),
cnt AS (
  SELECT g.lang, g.source, k.term, k.l, coalesce(o.c, 0) AS c
  FROM grps g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n FROM cnt),
shares AS (
  SELECT lang, source, term, c, (1 + 1000000000::HUGEINT * (c + 1) // (n + v)::HUGEINT)::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (l + 1) // (nl + v)::HUGEINT)::BIGINT AS q
  FROM sized JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p)::HUGEINT * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value,
    row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(p.value, 0) DESC, b.source)::INTEGER AS rank
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q)::HUGEINT * (p - q)) // q)::BIGINT AS f,
    row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q)::HUGEINT * (p - q)) // q DESC, term)::INTEGER
  FROM shares WHERE c > 0 AND p > q
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_BLANK_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
INTERACTION = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
rules AS (
  SELECT doc_id, part, len({_BLANK_WORDS}) < 200 AS a,
    100 * len(list_distinct({_BLANK_WORDS})) < 50 * len({_BLANK_WORDS}) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM texts
), told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM rules LEFT JOIN told USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(range(5)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, step, o[step] AS f, list_sum(list_transform(o[1:step], lambda k: 1 << k))::INT AS after
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT part, o, step, f,
    sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & after = 1 << f THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask >> f & 1 = 1 AND mask & after <> 1 << f THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & after = 1 << f THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & after = 1 << f THEN bad ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda k: chr(65 + k::INT)), '') AS filter_order, step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op2_licenses": LICENSES,
    "op4_decontaminate": DECONTAMINATE,
    "op5_chat": CHAT,
    "op6_line_dedup": LINE_DEDUP,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op12_source_divergence": DIVERGENCE,
    "op13_filter_interaction": INTERACTION,
}
