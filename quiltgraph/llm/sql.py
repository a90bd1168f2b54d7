"""SQL of the queries that SQL can express."""

URLS = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, coalesce(html, '') AS html,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM parsed),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT host, path, query, unnest(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1))) AS t
  FROM parts WHERE rest <> ''),
targets AS (
  SELECT host || path || query AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, instr(t, '://') + 3)
    WHEN t LIKE '//%' THEN substr(t, 3) WHEN t LIKE '/%' THEN host || t END AS r
  FROM (SELECT host, path, query, replace(t, '&amp;', '&') AS t FROM tags)),
stated AS (
  SELECT a, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(r, '^[^/?#]*([^?#]*)', 1) || regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS b FROM targets WHERE r IS NOT NULL),
edges AS (SELECT a, b FROM stated WHERE a <> b UNION SELECT b, a FROM stated WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
ruled AS (
  SELECT r.a, u.verdict FROM (SELECT a, b, regexp_extract(b, '^[^/?#]*') AS h, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS p FROM reach) r
  JOIN rules u ON (r.h = u.host OR ends_with(r.h, '.' || u.host)) AND starts_with(r.p, u.path)
  QUALIFY row_number() OVER (PARTITION BY r.a, r.b ORDER BY length(u.host || u.path) DESC) = 1),
classes AS (SELECT a, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM ruled GROUP BY a),
fitting AS (
  SELECT p.page_id, p.host, p.path, p.query, u.host || u.path AS rule, u.verdict FROM parts p
  LEFT JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(u.host || u.path) DESC NULLS LAST) = 1)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.verdict, CASE WHEN c.blocked AND NOT c.allowed THEN 'block' END, 'allow') AS verdict
FROM fitting f LEFT JOIN classes c ON f.host || f.path || f.query = c.a
"""

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
PLACES = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licenses(phrases, sets) -> str:
    """``sets``: (number, label, distinct words, words needed, words of a block) of each template."""
    wanted = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in phrases)
    templates = ", ".join(f"('{label}', {_list(sorted(words))}, {need}, {block})" for _, label, words, need, block in sets)
    return f"""
WITH w AS (SELECT doc_id, {PLACES.format(f"translate(coalesce(text, ''), {UPPER})")} AS w FROM documents),
phrases(p, label) AS (VALUES {wanted}),
hits AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN phrases ON w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM hits GROUP BY doc_id),
templates(label, words, need, block) AS (VALUES {templates}),
starts AS (
  SELECT doc_id, w, label, words, need, block, unnest(range(1, len(w) + 1)) AS i FROM w JOIN templates ON len(list_intersect(words, w)) >= need),
met AS (
  SELECT doc_id, label, len(list_intersect(words, w[i:i + block - 1])) / len(words) AS share FROM starts
  WHERE list_contains(words, w[i]) AND len(list_intersect(words, w[i:i + block - 1])) >= need),
marks AS (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM hits),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM marks GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0.0::DOUBLE)) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


#: Every pair; the forest finds the same links as long as it misses none, and has one leaf on tables this small.
VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM v LEFT JOIN least l ON l.a = vec_id LEFT JOIN counts c ON c.a = vec_id"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN least USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), {UPPER})")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""


SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
sizes AS (SELECT doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def quality_rules(rules, risk: float, error: float, top: int) -> str:
    """``rules``: (name, numerator, denominator)."""
    each = " UNION ALL ".join(f"SELECT doc_id, s, '{name}' AS rule, least({top}, coalesce((100 * {a}) // nullif({b}, 0), 0)) AS v FROM counted" for name, a, b in rules)
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
line_counts AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS again FROM lines GROUP BY doc_id),
counted AS (
  SELECT doc_id, s, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(again, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN line_counts x USING (doc_id)),
measured AS ({each}),
agreed AS (SELECT doc_id, min(quality) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT s, rule, v, y FROM measured JOIN agreed USING (doc_id)),
sizes AS (SELECT s, rule, count(*) FILTER (y = 1) AS good FROM held GROUP BY ALL),
steps AS (
  SELECT s, rule, good, c, (SELECT count(*) FROM held h WHERE h.s = x.s AND h.rule = x.rule AND h.v > c AND y = 1) AS lost,
    (SELECT count(*) FROM held h WHERE h.s = x.s AND h.rule = x.rule AND h.v > c AND y = 0) AS caught
  FROM (SELECT *, unnest(range(0, {top})) AS c FROM sizes) x),
tails AS (
  SELECT *, CASE WHEN lost >= good THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, lost + 1), lambda k: exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1)
    + k * ln({risk / len(rules)!r}::DOUBLE) + (good - k) * ln(1 - {risk / len(rules)!r}::DOUBLE)))) END AS tail FROM steps),
tested AS (
  SELECT *, bool_and(tail <= {error!r}::DOUBLE / ((SELECT count(DISTINCT s) FROM sizes) * {len(rules)})) OVER (PARTITION BY s, rule ORDER BY c DESC) AS certified FROM tails),
cuts AS (SELECT s, rule, c FROM tested WHERE certified AND caught > lost QUALIFY row_number() OVER (PARTITION BY s, rule ORDER BY caught - lost DESC, c DESC) = 1),
above AS (SELECT DISTINCT doc_id FROM measured JOIN cuts USING (s, rule) WHERE v > c),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM above) AS kept FROM judged"""
